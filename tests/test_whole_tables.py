"""Queries take every row of their tables: small tables with ids that a cut by id would lose, against plain Python."""

import math

import pytest

from isoreach.plans import QUERIES
from isoreach.plans.views import Views

CUSTOMERS, SUPPLIERS, PARTS = (3, 51, 135, 1135), (4, 11, 25, 1003, 1005), (5, 21, 2004, 2005)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of small tables, ids beyond 10, 20 and 50 among them."""
    at = str(tmp_path_factory.mktemp("small"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    put("customer", [(i, i % 25) for i in CUSTOMERS], "c_custkey long, c_nationkey int")
    put("supplier", [(i, i % 25, 100.0) for i in SUPPLIERS], "s_suppkey long, s_nationkey int, s_acctbal double")
    put("part", [(i, "a b", "T", f"Brand#{i}", i % 50) for i in PARTS], "p_partkey long, p_name string, p_type string, p_brand string, p_size int")
    put("nation", [(i, f"n{i}", i % 5) for i in range(25)], "n_nationkey int, n_name string, n_regionkey int")
    put("orders", [(97 * i + i % 7, i % 13, 1.0) for i in range(700)], "o_orderkey long, o_custkey long, o_totalprice double")
    return at


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def minutes(v):
    """(node, place) -> minutes by mode and half-life, for all pairs."""
    out = {}
    for o in v.origins.collect():
        for p in v.pois.collect():
            km = metres(o.lat, o.lon, p.plat, p.plon) / 1000
            gap, way = o.gap_o + p.gap_p, km * 1.3
            bus = 0.0 if (o.node_id + p.poi_id) % 3 == 0 else 8 + 2.5 * km
            half = {"t0": 20.0, "t1": 12.0, "t2": 30.0, "t3": 15.0}[p.poi_type]
            assert km <= 15
            out[o.node_id, p.poi_id] = ((way + gap) / 5 * 60, (way + gap) / 15 * 60, 10 + way / 30 * 60 + gap / 5 * 60 + 0.2 * 1.8 / 15, bus), half
    return out


def decayed(ms, half):
    return [0.0 if i == 3 and m <= 0 else 0.5 ** (m / half) for i, m in enumerate(ms)]


def test_modal_queries_keep_all_places(spark, small):
    want = minutes(Views(spark, small))
    got = lambda name: {(r.node_id, r.poi_id): list(r)[2:] for r in QUERIES[name](spark, small).collect()}
    walk, d, share, strike = (got(x) for x in ("fn_05_modal_impedance", "fn_03_decay", "fn_30_breakdown", "scenario_strike"))
    assert want.keys() == walk.keys() == d.keys() == share.keys() == strike.keys() and len(want) == len(CUSTOMERS) * len(SUPPLIERS)
    ranks = {}
    for r in QUERIES["win_01_modal_rank"](spark, small).collect():
        ranks.setdefault((r.node_id, r.poi_id), {})[r.mode] = (r.d, r.rank)
    assert ranks.keys() == want.keys()
    for k, (ms, half) in want.items():
        ds = decayed(ms, half)
        order = sorted(range(4), key=lambda i: (-ds[i], i))
        assert walk[k] == pytest.approx(ms[:3], abs=2e-6) and d[k] == pytest.approx(ds, abs=2e-6)
        assert share[k] == pytest.approx([x / (order.index(i) + 1) for i, x in enumerate(ds)], abs=2e-6)
        assert [ranks[k][m][1] for m in ("walk", "bike", "drive", "bus")] == [order.index(i) + 1 for i in range(4)]
        assert [ranks[k][m][0] for m in ("walk", "bike", "drive", "bus")] == pytest.approx(ds, abs=2e-6)
        assert strike[k] == [0.0]


def test_joins_keep_all_places_and_members(spark, small):
    v = Views(spark, small)
    origins, places, pois, zones = v.origins.collect(), v.places.collect(), v.pois.collect(), v.zones.collect()
    best = lambda o, p: 1 if round(metres(o.lat, o.lon, p.qlat + 0.001, p.qlon), 6) <= round(metres(o.lat, o.lon, p.qlat, p.qlon - 0.002), 6) else 2
    want = {(o.node_id, p.place_id): best(o, p) for o in origins for p in places}
    assert {(r.node_id, r.place_id): r.chosen for r in QUERIES["jn_03_best_candidate"](spark, small).collect()} == want and len(want) == len(CUSTOMERS) * len(PARTS)
    assert sorted(map(tuple, QUERIES["jn_04_distinct_destinations"](spark, small).collect())) == sorted({(p, c) for (_, p), c in want.items()})
    anchors = [a for a in pois if a.poi_type == "t1"]
    near = {p.place_id: min(anchors, key=lambda a, p=p: (round(metres(p.qlat, p.qlon, a.plat, a.plon), 6), a.poi_id)).poi_id for p in places}
    assert {r.place_id: r.poi_id for r in QUERIES["jn_18_nearest_anchor"](spark, small).collect()} == near
    held = {z.zone_id: [o.node_id for o in origins if o.zone == z.zone_id and z.south <= o.lat < z.north and z.west <= o.lon < z.east] for z in zones}
    got = {r.zone_id: (r.n, r.some) for r in QUERIES["jn_19_fragments_in_shape"](spark, small).collect()}
    assert got == {z: (len(ids), ",".join(map(str, sorted(ids)))) for z, ids in held.items() if ids} and any(i > 50 for ids in held.values() for i in ids)


def test_statistics_keep_all_cells_and_values(spark, small):
    zones, values = {}, []
    for r in Views(spark, small).scores.collect():
        zones.setdefault(r.hex_id % 37, []).append((-round(abs(r.b - r.a) * 100, 9), r.hex_id))
        values.append(r.a)
    got = {r.zone: (r.worst, r["mean"], r["at"], r.verdict) for r in QUERIES["agg_23_verdicts"](spark, small).collect()}
    assert got.keys() == zones.keys()
    for z, ds in zones.items():
        worst, mean = -min(ds)[0], -sum(d for d, _ in ds) / len(ds)
        assert got[z] == (pytest.approx(worst), pytest.approx(mean), min(ds)[1], "sensitive" if worst >= 20 else "moderate" if worst >= 5 else "robust")
    breaks = sorted(map(tuple, QUERIES["agg_28_natural_breaks"](spark, small).collect()))
    assert [b[1] for b in breaks] == sorted(set(values))[: len(breaks)] and len(breaks) == min(5, len(set(values))) and sum(b[2] for b in breaks) == len(values)


def test_paths_start_at_all_origins(spark, small):
    v = Views(spark, small)
    length = {}
    for e in v.edges.collect():
        if e.u != e.v:
            length[e.u, e.v] = min(e.length_m, length.get((e.u, e.v), math.inf))
    want = {}
    for o in v.origins.collect():
        best = {o.node_id * 7 % 200: 0.0}
        for _ in range(7):  # an edge has 50 m at least
            for (a, b), x in length.items():
                if a in best and best[a] + x <= 300:
                    best[b] = min(best.get(b, math.inf), best[a] + x)
        want |= {(o.node_id, n): d for n, d in best.items()}
    got = {(r.node_id, r.node): r.dist for r in QUERIES["it_01_bounded_shortest_paths"](spark, small).collect()}
    assert got == want and {k for k, _ in got} == set(CUSTOMERS) and len(got) > 3 * len(CUSTOMERS)
    paths = QUERIES["it_03_paths"](spark, small).collect()
    assert {(r.node_id, r.node): r.dist for r in paths} == want
    for r in paths:
        way = [int(x) for x in r.path.split(">")]
        assert (way[0], way[-1]) == (r.node_id * 7 % 200, r.node) and sum(length[x] for x in zip(way, way[1:])) == r.dist
    walked = {(r.node_id, r.poi_id): (r.walk, r.in_radius) for r in QUERIES["it_02_walk_step"](spark, small).collect()}
    steps = {(o, p.poi_id): d / 1000 + p.gap_p for (o, n), d in want.items() for p in v.pois.collect() if p.poi_id * 7 % 200 == n}
    assert walked == {k: (pytest.approx(km / 5 * 60, abs=1e-6), km <= 0.25) for k, km in steps.items()}
