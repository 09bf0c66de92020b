"""Hand-made values, brute force on small tables, and the failures that must be loud."""

import itertools
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from isoreach.functions import geo, text
from isoreach.operators import checks, components, decay, graph, grid, gtfs, places, scaling, scenarios, spatial
from isoreach.operators import multicriteria as M
from isoreach.operators.components import connected_components
from isoreach.sinks import tables as sinks
from isoreach.sources import config, tables


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_modal_union_vectors(spark):
    d = lambda *xs: [F.lit(float(x)) for x in xs]
    got = one(spark, decay.modal_union(d(0.5, 0.5, 0.2, 0)), decay.modal_union(d(0, 0, 0, 0)), decay.modal_union(d(0.6, 0, 0, 0)), decay.modal_union(d(0.6, 0, 0, 0), "rank_asc"), decay.modal_union(d(1, 0.3, 0, 0)), decay.modal_union(d(0.1, 0.2, 0.3, 0.4, 0.5)))
    five = 1 - math.prod(1 - x / (i + 1) for i, x in enumerate((0.5, 0.4, 0.3, 0.2, 0.1)))
    assert list(got) == pytest.approx([0.65, 0, 0.6, 0.15, 1.0, five])
    with pytest.raises(ValueError):
        decay.weights(4, "other")


def test_decay_vectors(spark):
    z = F.lit(0.0)
    got = one(spark, decay.decay(F.lit(20.0), 20.0), decay.decay(z, 20.0), decay.decay(z, 20.0, transit=True), decay.decay(F.lit(None).cast("double"), 20.0), decay.decay(F.lit(float("inf")), 20.0), decay.decay(F.lit(float("nan")), 20.0))
    assert list(got) == pytest.approx([0.5, 1, 0, 0, 0, 0])
    assert [decay.saturation_rate(k) for k in (5, 10, 30, 50, 80)] == [-0.46, -0.23, -0.08, -0.05, -0.03]
    assert one(spark, decay.reach_m(45.0, 0.5, 20.0))[0] == pytest.approx(15000)


def test_saturation_of_one_and_more(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.2), ("b", 0.9), ("b", 0.9)], "k string, x double").withColumn("c", F.lit(-0.23))
    got = {r.k: r.access for r in decay.saturated(df, ["k"], "x", F.col("c")).collect()}
    g = lambda x: 1 - math.exp(-0.23 * x)
    assert got["a"] == pytest.approx(0.205466, abs=1e-6)
    assert got["b"] == pytest.approx(0.9 * g(2) + 0.2 * (g(3) - g(2)))


def test_choquet(spark):
    xs = [F.lit(0.4)] * 3
    pairs = {(0, 1): 0.07, (1, 2): -0.05}
    assert one(spark, M.choquet(xs, [0.3, 0.4, 0.3], pairs))[0] == pytest.approx(0.4)
    assert one(spark, M.choquet([F.lit(1.7), F.lit(1.0)], [0.55, 0.45], {(0, 1): 0.07}))[0] == pytest.approx(1)


def scalar_credibility(xs, w, b, q=0.02, p=0.06, veto=math.inf):
    c = sum(wi * (1 if x - b >= -q else (x - b + p) / (p - q) if x - b > -p else 0) for x, wi in zip(xs, w)) / sum(w)
    out = c
    if c < 1 and veto < math.inf:
        for x in xs:
            if b - x > veto:
                return 0.0
            if b - x > p and (b - x - p) / (veto - p) > c:
                out *= (1 - (b - x - p) / (veto - p)) / (1 - c)
    return out


def test_outranking(spark):
    same = [F.lit(0.35)] * 5
    got = one(spark, M.outrank_class(same, [0.2] * 5), M.mean_credibility(same, [0.2] * 5))
    assert got[0] == 1 and got[1] == pytest.approx(0.43)
    for d, want in ((0.02, 1), (0.04, 0.5), (0.06, 0)):
        assert one(spark, M.credibility([F.lit(0.51 - d)], [1.0], 0.51))[0] == pytest.approx(want, abs=1e-9)
    rng = random.Random(0)
    for _ in range(15):
        xs, w = [rng.random() for _ in range(3)], [rng.random() + 0.1 for _ in range(3)]
        got = one(spark, *(M.credibility([F.lit(x) for x in xs], w, b, veto=0.3) for b in M.BOUNDS), M.outrank_class([F.lit(x) for x in xs], w, veto=0.3))
        cred = [scalar_credibility(xs, w, b, veto=0.3) for b in M.BOUNDS]
        assert list(got)[:4] == pytest.approx(cred)
        assert got[4] == max([k + 1 for k, c in enumerate(cred) if c >= 0.75], default=0)


def test_text_functions(spark):
    got = one(spark, text.seconds_of(F.lit("25:10:00")), text.hms_of(F.lit(-5)), text.hms_of(F.lit(90600)), text.decimal_comma(F.lit("1.234,5")), text.slug(F.lit("Città di Québec!")), text.first_text(F.lit(" "), F.lit(" b ")), text.multi_match(F.lit("climbing; bouldering"), ["bouldering"]), text.multi_match(F.lit(None).cast("string"), True))
    assert list(got) == [90600, "00:00:00", "25:10:00", 1234.5, "citta_di_quebec", "b", True, False]


def test_geometry(spark):
    got = one(spark, geo.shard_of(F.lit("H0007_0012")), geo.shard_of(F.lit("odd")), geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), geo.coord_key(F.lit(1.0), F.lit(2.5)))
    h = 0
    for c in "odd":
        h = (h * 31 + ord(c)) % 4096
    assert got[0] == "s0001_0003" and got[1] == f"sx{h:04d}" and got[2] == pytest.approx(6371000 * math.pi / 180) and got[3] == "1.000000,2.500000"
    line = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y")) for x in (0, 700, 1200)))
    assert [p.x for p in one(spark, geo.line_samples(line, 500.0))[0]] == [0, 500, 1000, 1200]


def hav(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_distance_joins_against_brute_force(spark):
    rng = random.Random(1)
    left = [(i, rng.uniform(39, 39.3), rng.uniform(9, 9.3)) for i in range(80)] + [(99, 60.0, 30.0)]
    right = [(i, rng.uniform(39, 39.3), rng.uniform(9, 9.3)) for i in range(60)]
    a, b = spark.createDataFrame(left, "i long, lat double, lon double"), spark.createDataFrame(right, "j long, plat double, plon double")
    want = {(x[0], y[0]) for x in left for y in right if hav(*x[1:], *y[1:]) <= 4000}
    assert {(r.i, r.j) for r in spatial.within(a, b, 4000.0, ("lat", "lon"), ("plat", "plon")).collect()} == want
    assert {r.i for r in spatial.reaches(a, b, 4000.0, ("lat", "lon"), ("plat", "plon")).collect()} == {i for i, _ in want}
    near = spatial.nearest(a, b, "i", ("lat", "lon"), ("plat", "plon"), "j", k=3).collect()
    for x in left:
        assert [r.j for r in sorted((r for r in near if r.i == x[0]), key=lambda r: r.rank)] == [y[0] for y in sorted(right, key=lambda y: (hav(*x[1:], *y[1:]), y[0]))[:3]]
    few = spatial.nearest_of_few(a, b, ("lat", "lon"), ("plat", "plon"), "j").select("i", F.col("_near.key").alias("j")).collect()
    assert {(r.i, r.j) for r in few} == {(r.i, r.j) for r in near if r["rank"] == 1}
    assert spatial.nearest(a, b.limit(0), "i", ("lat", "lon"), ("plat", "plon"), "j").count() == 0


@pytest.mark.parametrize("small", [components.SMALL, 0])
def test_components_equal_union_find(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 230)] + [(300, 300), (5, 5), (None, 4)]
    of = {n: n for e in edges if None not in e for n in e}
    for _ in range(len(of)):
        for a, b in edges:
            if a is not None:
                of[a] = of[b] = min(of[a], of[b])
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), "u", "v").collect()
    assert len(got) == len(of) and {r.node: r.component for r in got} == of


def test_components_paths_and_bridges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3), (5, 4)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges, "u", "v").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    e = spark.createDataFrame([(0, 1, 5.0), (0, 1, 2.0), (1, 2, 2.0), (0, 2, 4.0), (2, 3, 10.0)], "u long, v long, length_m double")
    src = spark.createDataFrame([(0,)], "src long")
    paths = {r.node: (r.dist, r.path) for r in graph.shortest_paths(e, src, 9.0, paths=True).collect()}
    assert paths == {0: (0.0, [0]), 1: (2.0, [0, 1]), 2: (4.0, [0, 2])}
    assert {(r.node, r.dist) for r in graph._relaxed(graph.shortest_edges(e), src, 20.0).collect()} == {(0, 0.0), (1, 2.0), (2, 4.0), (3, 14.0)}
    nodes = spark.createDataFrame([(1, 39.0, 9.0), (2, 39.001, 9.0), (3, 39.01, 9.0), (4, 39.02, 9.0)], "node long, lat double, lon double")
    comp = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "node long, component long")
    assert {(r.component, r.node, r.to_node) for r in graph.bridges(nodes, comp).collect()} == {(3, 3, 2), (4, 4, 2)}


def test_greedy_assignment_takes_each_once(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.1)], "k long, la double, lo double")
    right = spark.createDataFrame([(10, 0.0, 0.001), (11, 0.0, 0.002), (12, 0.0, 0.2)], "r long, ra double, ro double")
    got = {r.k: r.r for r in grid.greedy_nearest(left, right, "k", ("la", "lo"), "r", ("ra", "ro")).collect()}
    assert got == {1: 10, 2: 11, 3: 12}


def test_natural_breaks_against_all_cuts(spark):
    rng = random.Random(2)
    xs = sorted(round(rng.random(), 2) for _ in range(14))
    sse = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v) if v else 0
    best = min((sum(sse(xs[a:b]) for a, b in zip((0, *cut), (*cut, len(xs)))), cut) for cut in itertools.combinations(range(1, len(xs)), 2))
    got = sorted(scaling.natural_breaks(spark.createDataFrame([(x,) for x in xs], "x double"), "x", 3).collect(), key=lambda r: r["class"])
    edges = [0, *itertools.accumulate(r.n for r in got)]
    assert sum(sse(xs[a:b]) for a, b in zip(edges, edges[1:])) == pytest.approx(best[0])


def test_mid_ranks(spark):
    rows = spark.createDataFrame([("k", q) for q in (10, 10, 20, 20, 0)], "key string, q long")
    assert {r.q: r.scaled for r in scaling.mid_rank(rows, "key", "q").collect()} == {10: 2500, 20: 7500}


def test_ownership_ties_and_drops(spark):
    df = spark.createDataFrame([(1, {"a": "x;y", "b": "z"}), (2, {"a": "y"}), (3, {"c": "q"}), (4, None)], "place_id long, tags map<string,string>")
    types = {"t0": [{"a": ["x"]}], "t1": [{"a": ["y"]}, {"a": ["y"], "b": True}], "t2": [{"a": ["y"]}]}
    cands = places.candidates(df, types)
    got = {r.place_id: (r.owner, r.is_conflict, r.by_order) for r in places.owners(cands, ["place_id"]).collect()}
    assert got == {1: ("t1", True, False), 2: ("t1", True, True)}
    assert {(r.place_id, r.poi_type) for r in places.drops(cands, ["place_id"]).collect()} == {(1, "t0"), (1, "t2"), (2, "t2")}
    assert one(spark, places.raw_tags(F.create_map(F.lit("k"), F.lit("x; y;w"), F.lit("a"), F.lit("1")), {"k": ["x", "y"], "a": True}))[0] == ["a=1&k=x", "a=1&k=y"]


def test_unknown_ids_fail_loudly(spark):
    df, known = spark.createDataFrame([(1,), (2,)], "i long"), spark.createDataFrame([(1,)], "k long")
    assert [r.i for r in checks.only_known(df, known, "i", "k").collect()] == [1]
    with pytest.raises(Exception, match="unknown i: 2"):
        checks.reject_unknown(df, known, "i", "k").collect()
    assert not checks.covered(known.withColumnRenamed("k", "i"), df, "i") and checks.covered(df, known.withColumnRenamed("k", "i"), "i")


def write(path, body):
    path.write_text(body, encoding="utf-8")
    return str(path)


def test_configuration_files(spark, tmp_path):
    path = write(tmp_path / "c.csv", "capability,services,electre_weight,veto_threshold,enabled\nfood,\"['a', 'b']\",,,\nrest,\"['a']\",\"[1.0]\",0.3,False\n")
    rows = {r.capability: r for r in config.read_capabilities(spark, path).collect()}
    assert rows["food"].weights == [0.5, 0.5] and math.isinf(rows["food"].veto) and rows["food"].enabled
    assert rows["rest"].veto == 0.3 and not rows["rest"].enabled
    with pytest.raises(ValueError):
        config.read_services(spark, path)
    bad = write(tmp_path / "s.csv", "service,poi_types,choquet_capacity,contribution_coefficient\ns,\"['a', 'b']\",[0.5],\"[1, 2]\"\n")
    with pytest.raises(Exception, match="bad lists of service s"):
        config.read_services(spark, bad).collect()
    tax = write(tmp_path / "t.csv", 'poi_type,decay_coefficient,choquet_interactions,tags\np,20,"[None,0.05]","[{""leisure"": ""pitch"", ""access"": [""private"", ""members""]}, {""sport"": true}]"\nq,12,[],"{""amenity"": ""cafe""}"\n')
    got = {r.poi_type: r for r in config.read_taxonomy(spark, tax).collect()}
    assert got["p"].clauses == [{"leisure": ["pitch"], "access": ["private", "members"]}, {"sport": ["true"]}] and got["p"].interactions == [None, 0.05]
    assert got["q"].clauses == [{"amenity": ["cafe"]}] and got["q"].decay_coefficient == 12
    assert config.read_ids(spark, str(tmp_path / "none.csv"), "osmid").count() == 0


def test_zipped_tables(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        z.writestr("stops.txt", "﻿stop_id,stop_name\nA,\"x, y\"\nB,z\n")
    rows = tables.read_zip_csv(spark, str(tmp_path / "feed.zip"), "stops.txt", ["stop_id", "stop_name", "zone_id"]).collect()
    assert [tuple(r) for r in rows] == [("A", "x, y", None), ("B", "z", None)]
    assert tables.read_zip_csv(spark, str(tmp_path / "feed.zip"), "absent.txt", ["a"]).count() == 0


def test_services_of_a_date(spark):
    cal = spark.createDataFrame([("a", "1", "20250101", "20251231"), ("b", "0", "20250101", "20251231"), ("c", "1", "20260101", "20261231")], "service_id string, monday string, start_date string, end_date string")
    ex = spark.createDataFrame([("b", "20250602", "1"), ("a", "20250609", "2")], "service_id string, date string, exception_type string")
    assert {r.service_id for r in gtfs.active_services(cal, ex, "20250602", "monday").collect()} == {"a", "b"}
    assert {r.service_id for r in gtfs.active_services(cal, ex, "20250609", "monday").collect()} == set()


def test_trips_grow_at_either_end(spark):
    times = spark.createDataFrame([("t", "A", "08:00:00", "08:00:00", 1), ("t", "B", "08:10:00", "08:10:00", 2)], "trip_id string, stop_id string, arrival_time string, departure_time string, stop_sequence int")
    new = spark.createDataFrame([("N1", 4), ("N2", 10)], "stop_id string, cum_min int")
    after = sorted(gtfs.extended_trips(times, new, False).collect(), key=lambda r: r.stop_sequence)
    before = sorted(gtfs.extended_trips(times, new, True).collect(), key=lambda r: r.stop_sequence)
    assert [(r.stop_id, r.arrival_time) for r in after] == [("A", "08:00:00"), ("B", "08:10:00"), ("N1", "08:14:00"), ("N2", "08:20:00")]
    assert [(r.stop_id, r.departure_time) for r in before] == [("N2", "07:50:00"), ("N1", "07:56:00"), ("A", "08:00:00"), ("B", "08:10:00")]


def test_scenarios_and_profiles(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, 5.0)], "i long, bus double")
    assert [r.bus for r in scenarios.Strike().transit(rows, "bus").orderBy("i").collect()] == [0.0, 1e10]
    assert scenarios.Scenario().transit(rows, "bus") is rows
    p = scenarios.Profile("student", modes=("walk",), affordability=0.4, paid_types=("cafe",), canteens=(7,))
    df = spark.createDataFrame([(7, "cafe"), (8, "cafe"), (9, "park")], "poi_id long, kind string")
    assert [r.u for r in df.withColumn("u", p.utility("poi_id", "kind")).orderBy("poi_id").collect()] == [1.0, 0.4, 1.0]


def test_column_names_stay_unique():
    assert sinks.column_names(["service quality", "service_quality", "service_quality_2"], 10) == {"service quality": "service_qu", "service_quality": "service__1", "service_quality_2": "service__2"}


def test_hull_holds_all_points(spark):
    rng = random.Random(5)
    pts = [(1, rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(400)] + [(2, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0), (3, 1.0, 1.0)]
    rows = grid.convex_hulls(spark.createDataFrame(pts, "k long, x double, y double"), "k", "x", "y", parts=7).collect()
    ring = [(r.x, r.y) for r in sorted((r for r in rows if r.k == 1), key=lambda r: r.i)]
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    assert all(cross(a, b, p[1:]) >= -1e-12 for a, b in zip(ring, ring[1:] + ring[:1]) for p in pts if p[0] == 1)
    assert set(ring) <= {p[1:] for p in pts} and len([r for r in rows if r.k == 2]) == 1 and len([r for r in rows if r.k == 3]) == 2
