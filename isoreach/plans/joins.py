"""Joins: nearest, within a distance, by rounded coordinates, by zone, and the plain kinds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from isoreach.functions import geo
from isoreach.operators import graph, places, spatial
from isoreach.operators.checks import covered
from isoreach.plans.registry import query

AT, PAT = ("lat", "lon"), ("plat", "plon")
#: Tasks that rows of pairs are dealt to, at most.
MOST_PARTS = 20_000
HAV = "2 * 6371000.0::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h}))"


def hav_sql(a: str, b: str, c: str, d: str) -> str:
    h = f"(power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))"
    return HAV.format(h=h)


NEAREST_SQL = "SELECT node_id, poi_id, round(dist_m, 6) AS dist_m FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY round(dist_m, 6), poi_id) AS r FROM hav_pairs) WHERE r = 1"


def _by_distance(df):
    return df.withColumn("dist_m", F.round("dist_m", 6))


@query("jn_01_nearest", NEAREST_SQL)
def jn_01(v):
    return _by_distance(spatial.nearest(v.origins, v.pois, "node_id", AT, PAT, "poi_id", start_m=400.0)).select("node_id", "poi_id", "dist_m")


@query("jn_02_batch_snap", f"SELECT DISTINCT round(lat, 3) AS klat, round(lon, 3) AS klon, min(dist_m) AS dist_m FROM (SELECT round(lat, 3) AS lat, round(lon, 3) AS lon, round({hav_sql('round(lat, 3)', 'round(lon, 3)', 'plat', 'plon')}, 6) AS dist_m FROM origins, pois) GROUP BY ALL")
def jn_02(v):
    coords = v.origins.select(F.round("lat", 3).alias("klat"), F.round("lon", 3).alias("klon")).dropDuplicates(["klat", "klon"]).withColumn("k", F.concat_ws(",", "klat", "klon"))
    return _by_distance(spatial.nearest(coords, v.pois, "k", ("klat", "klon"), PAT, "poi_id")).select("klat", "klon", "dist_m")


SNAP_SQL = f"""SELECT node_id, place_id, CASE WHEN {{d1}} <= {{d2}} THEN 1 ELSE 2 END AS chosen FROM (SELECT *, qlat + 0.001::DOUBLE AS lat1, qlon AS lon1, qlat AS lat2, qlon - 0.002::DOUBLE AS lon2 FROM (SELECT *, {{d0}} AS near FROM origins, places) WHERE near <= 15000)"""
SNAP_SQL = SNAP_SQL.format(d0=hav_sql('lat', 'lon', 'qlat', 'qlon'), d1=f"round({hav_sql('lat', 'lon', 'lat1', 'lon1')}, 6)", d2=f"round({hav_sql('lat', 'lon', 'lat2', 'lon2')}, 6)")


def _options(lat, lon):
    one = lambda a, b, d: F.struct(a.alias("lat"), b.alias("lon"), F.lit(d).alias("dist_m"))
    return F.array(one(F.col(lat) + 0.001, F.col(lon), 100.0), one(F.col(lat), F.col(lon) - 0.002, 150.0))


@query("jn_03_best_candidate", SNAP_SQL)
def jn_03(v):
    every = v.places.select("place_id", "qlat", "qlon")
    raw = F.struct(F.col("qlat").alias("lat"), F.col("qlon").alias("lon"))
    best = places.best_candidate(F.col("lat"), F.col("lon"), _options("qlat", "qlon"), raw)
    pairs = spatial.within_alike(v.origins, every, 15_000.0, AT, ("qlat", "qlon"), "node_id", "place_id")
    chosen = F.when(best["lat"] > F.col("qlat"), F.lit(1)).otherwise(F.lit(2)).alias("chosen")
    return spatial.each_pair(pairs.select("left_ids", "right_ids", chosen), left_ids="node_id", right_ids="place_id")


@query("jn_04_distinct_destinations", f"SELECT DISTINCT place_id, chosen FROM ({SNAP_SQL})")
def jn_04(v):
    return jn_03(v).select("place_id", "chosen").distinct()


@query("jn_05_rounded_coordinates", "SELECT a.poi_id, min(b.place_id) AS place_id FROM pois a LEFT JOIN places b ON round(a.plat, 3) = round(b.qlat, 3) AND round(a.plon, 3) = round(b.qlon, 3) GROUP BY a.poi_id")
def jn_05(v):
    a = v.pois.select("poi_id", F.round("plat", 3).alias("y"), F.round("plon", 3).alias("x"))
    b = v.places.groupBy(F.round("qlat", 3).alias("y"), F.round("qlon", 3).alias("x")).agg(F.min("place_id").alias("place_id"))
    return a.join(b, ["y", "x"], "left").groupBy("poi_id").agg(F.min("place_id").alias("place_id"))


BEST_OD = "SELECT from_id, to_id, min(access_time + wait_time + ride_time + transfer_time + egress_time) AS t FROM od GROUP BY from_id, to_id"


@query("jn_06_matrix_lookup", f"SELECT node_id, to_id, round(CASE WHEN m.t IS NULL OR m.t <= 0 THEN 0.0::DOUBLE ELSE exp(-ln(2) / 20.0::DOUBLE * m.t) END, 6) AS d FROM (SELECT node_id, node_id % 100 + 1 AS s, node_id % 200 + 1 AS to_id FROM origins) o LEFT JOIN (SELECT from_id, to_id AS k, t FROM ({BEST_OD})) m ON m.from_id = o.s AND m.k = o.to_id")
def jn_06(v):
    from isoreach.operators.decay import decay

    best = v.od.groupBy(F.col("from_id").alias("s"), "to_id").agg(F.min(F.col("access_time") + F.col("wait_time") + F.col("ride_time") + F.col("transfer_time") + F.col("egress_time")).alias("t"))
    want = v.origins.select("node_id", (F.col("node_id") % 100 + 1).alias("s"), (F.col("node_id") % 200 + 1).alias("to_id"))
    return want.join(best, ["s", "to_id"], "left").select("node_id", "to_id", F.round(decay(F.col("t"), 20.0, transit=True), 6).alias("d"))


@query("jn_07_hash_lookup", "SELECT s.s_name AS origin, count(*) AS n FROM od JOIN supplier s ON s.s_suppkey = od.from_id GROUP BY s.s_name")
def jn_07(v):
    rows = v.od.groupBy(F.col("from_id").alias("s_suppkey")).agg(F.count("*").alias("n"))  # before the join: one row an origin
    return rows.join(v.table("supplier").select("s_suppkey", "s_name"), "s_suppkey").select(F.col("s_name").alias("origin"), "n")


@query("jn_08_service_structures", "SELECT r_name AS service, n_name AS poi_type, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey)::INTEGER AS idx, round(1.0::DOUBLE / count(*) OVER (PARTITION BY r_name), 6) AS singleton FROM nation JOIN region ON n_regionkey = r_regionkey")
def jn_08(v):
    w = Window.partitionBy("r_name")
    rows = v.table("nation").join(F.broadcast(v.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("r_name").alias("service"), F.col("n_name").alias("poi_type"), F.row_number().over(w.orderBy("n_nationkey")).alias("idx"), F.round(1.0 / F.count("*").over(w), 6).alias("singleton"))


@query("jn_09_capability_services", "SELECT node_id, r_name AS capability, round(avg(CASE n % 5 WHEN 0 THEN x1 WHEN 1 THEN x2 WHEN 2 THEN x3 WHEN 3 THEN x4 ELSE x5 END), 6) AS score FROM criteria, (SELECT n_nationkey AS n, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY node_id, r_name")
def jn_09(v):
    dims = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select((F.col("n_nationkey") % 5 + 1).alias("idx"), "r_name")
    long = v.criteria.select("node_id", F.posexplode(F.array("x1", "x2", "x3", "x4", "x5")).alias("idx", "x")).withColumn("idx", F.col("idx") + 1)
    return long.join(F.broadcast(dims), "idx").groupBy("node_id", F.col("r_name").alias("capability")).agg(F.round(F.avg("x"), 6).alias("score"))


@query(
    "jn_10_point_in_zone",
    """SELECT node_id, zone_id, inside FROM (SELECT o.node_id, z.zone_id, o.lat >= z.south AND o.lat < z.north AND o.lon >= z.west AND o.lon < z.east AS inside,
    row_number() OVER (PARTITION BY o.node_id ORDER BY (o.lat >= z.south AND o.lat < z.north AND o.lon >= z.west AND o.lon < z.east) DESC, round(power(o.lat - (z.south + z.north) / 2, 2) + power(o.lon - (z.west + z.east) / 2, 2), 12), z.zone_id) AS r FROM origins o, zones z) WHERE r = 1""",
)
def jn_10(v):
    """Zones are few (one array); a node takes the containing zone with the nearest centre, or the nearest centre."""
    zs = v.zones.agg(F.collect_list(F.struct("zone_id", "south", "north", "west", "east")).alias("zs"))

    def ranked(z):
        ring = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((z["west"], z["south"]), (z["east"], z["south"]), (z["east"], z["north"]), (z["west"], z["north"]))))
        far = F.round(F.pow(F.col("lat") - (z["south"] + z["north"]) / 2, 2) + F.pow(F.col("lon") - (z["west"] + z["east"]) / 2, 2), 12)
        return F.struct((~geo.in_polygon(F.col("lon"), F.col("lat"), ring)).alias("out"), far.alias("far"), z["zone_id"].alias("zone_id"))

    best = F.array_min(F.transform("zs", ranked))
    return v.origins.join(F.broadcast(zs), F.lit(True)).withColumn("b", best).select("node_id", F.col("b.zone_id").alias("zone_id"), (~F.col("b.out")).alias("inside"))


@query("jn_11_left_attributes", "SELECT o.node_id, o.zone, z.zone_name, round(z.south, 6) AS south FROM origins o LEFT JOIN zones z ON z.zone_id = o.zone AND z.region < 4")
def jn_11(v):
    z = v.zones.where("region < 4").select(F.col("zone_id").alias("zone"), "zone_name", F.round("south", 6).alias("south"))
    return v.origins.select("node_id", "zone").join(F.broadcast(z), "zone", "left").select("node_id", "zone", "zone_name", "south")


@query("jn_12_full_outer", "SELECT coalesce(a.hex_id, b.hex_id) AS hex_id, round(coalesce(a.a, b.b), 6) AS value FROM (SELECT hex_id, a FROM scores WHERE hex_id % 3 <> 0) a FULL OUTER JOIN (SELECT hex_id, b FROM scores WHERE hex_id % 2 = 0) b ON a.hex_id = b.hex_id")
def jn_12(v):
    a, b = v.scores.where("hex_id % 3 <> 0").select("hex_id", "a"), v.scores.where("hex_id % 2 = 0").select("hex_id", "b")
    return a.join(b, "hex_id", "full_outer").select("hex_id", F.round(F.coalesce("a", "b"), 6).alias("value"))


@query("jn_13_inner", "SELECT s.hex_id, o.zone, round(s.a, 6) AS a FROM scores s JOIN origins o ON o.node_id = s.hex_id WHERE o.zone < 10")
def jn_13(v):
    return v.scores.join(v.origins.where("zone < 10").select(F.col("node_id").alias("hex_id"), "zone"), "hex_id").select("hex_id", "zone", F.round("a", 6).alias("a"))


SCENARIOS = "SELECT hex_id, 0 AS k, a AS s FROM scores UNION ALL SELECT hex_id, 1, b FROM scores UNION ALL SELECT hex_id, 2, (a + b) / 2 FROM scores WHERE hex_id % 4 <> 0"


@query("jn_14_scenario_pairs", f"SELECT x.hex_id, x.k AS left_k, y.k AS right_k, round(y.s - x.s, 6) AS diff FROM ({SCENARIOS}) x JOIN ({SCENARIOS}) y ON x.hex_id = y.hex_id AND x.k < y.k")
def jn_14(v):
    """One pass over the cells: their scenarios sit in one row, so no self-join is needed."""
    third = F.when(F.col("hex_id") % 4 != 0, (F.col("a") + F.col("b")) / 2)
    wide = v.scores.select("hex_id", F.array("a", "b", third).alias("s"))
    pairs = F.array(*(F.struct(F.lit(i).alias("left_k"), F.lit(j).alias("right_k")) for i in range(3) for j in range(i + 1, 3)))
    out = wide.select("hex_id", "s", F.inline(pairs)).select("hex_id", "left_k", "right_k", F.round(F.get("s", F.col("right_k")) - F.get("s", F.col("left_k")), 6).alias("diff"))
    return out.where("diff is not null")


@query("jn_15_compare_by_id", "SELECT hex_id AS node_id, round(b - a, 6) AS change FROM scores WHERE hex_id % 2 = 0")
def jn_15(v):
    base, arm = v.scores.select(F.col("hex_id").alias("node_id"), "a"), v.scores.where("hex_id % 2 = 0").select(F.col("hex_id").alias("node_id"), "b")
    return base.join(arm, "node_id").select("node_id", F.round(F.col("b") - F.col("a"), 6).alias("change"))


@query("jn_16_shared_dropped_added", "SELECT CASE WHEN hex_id % 3 = 0 AND hex_id % 2 = 0 THEN 'shared' WHEN hex_id % 3 = 0 THEN 'dropped' ELSE 'added' END AS state, count(*) AS n FROM scores WHERE hex_id % 3 = 0 OR hex_id % 2 = 0 GROUP BY 1")
def jn_16(v):
    base, new = v.scores.where("hex_id % 3 = 0").select("hex_id"), v.scores.where("hex_id % 2 = 0").select("hex_id")
    parts = ((base.join(new, "hex_id"), "shared"), (base.join(new, "hex_id", "left_anti"), "dropped"), (new.join(base, "hex_id", "left_anti"), "added"))
    out = None
    for df, name in parts:
        one = df.select(F.lit(name).alias("state"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("state").agg(F.count("*").alias("n"))


ADJ_SQL = f"SELECT a.poi_id AS i, b.poi_id AS j FROM pois a, pois b WHERE a.poi_id < b.poi_id AND {hav_sql('a.plat', 'a.plon', 'b.plat', 'b.plon')} <= 700"


@query("jn_17_adjacency", ADJ_SQL)
def jn_17(v):
    a = v.pois.select(F.col("poi_id").alias("i"), F.col("plat").alias("alat"), F.col("plon").alias("alon"))
    b = v.pois.select(F.col("poi_id").alias("j"), F.col("plat").alias("blat"), F.col("plon").alias("blon"))
    return spatial.within(a, b, 700.0, ("alat", "alon"), ("blat", "blon")).where("i < j").select("i", "j")


@query("jn_18_nearest_anchor", f"SELECT place_id, poi_id FROM (SELECT place_id, poi_id, row_number() OVER (PARTITION BY place_id ORDER BY round({hav_sql('qlat', 'qlon', 'plat', 'plon')}, 6), poi_id) AS r FROM places, pois WHERE poi_type = 't1') WHERE r = 1")
def jn_18(v):
    anchors = v.pois.where("poi_type = 't1'").select("poi_id", "plat", "plon")
    d = F.round(geo.haversine_m(F.col("qlat"), F.col("qlon"), F.col("plat"), F.col("plon")), 6)
    near = spatial.nearest(v.places.select("place_id", "qlat", "qlon"), anchors, "place_id", ("qlat", "qlon"), PAT, "poi_id", k=2)
    return places.shortest(near.withColumn("d", d), ["place_id"], ["d", "poi_id"]).select("place_id", "poi_id")


@query("jn_19_fragments_in_shape", "SELECT zone_id, count(*) AS n, string_agg(node_id::VARCHAR, ',' ORDER BY node_id) AS some FROM origins JOIN zones ON zone = zone_id AND lat >= south AND lat < north AND lon >= west AND lon < east GROUP BY zone_id")
def jn_19(v):
    ring = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"))))
    inside = v.origins.join(F.broadcast(v.zones), (F.col("zone") == F.col("zone_id")) & geo.in_polygon(F.col("lon"), F.col("lat"), ring))
    ids = F.transform(F.sort_array(F.collect_list("node_id")), lambda x: x.cast("string"))
    return inside.groupBy("zone_id").agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("some"))


@query("jn_20_reuse_by_coordinate", "SELECT CASE WHEN EXISTS (SELECT 1 FROM pois WHERE round(plat, 3) = round(lat, 3) AND round(plon, 3) = round(lon, 3)) THEN 'carried' ELSE 'new' END AS state, count(*) AS n FROM origins GROUP BY 1")
def jn_20(v):
    old = v.pois.select(F.round("plat", 3).alias("y"), F.round("plon", 3).alias("x")).distinct().withColumn("had", F.lit(True))
    return v.origins.select(F.round("lat", 3).alias("y"), F.round("lon", 3).alias("x")).join(old, ["y", "x"], "left").groupBy(F.when(F.col("had"), F.lit("carried")).otherwise(F.lit("new")).alias("state")).agg(F.count("*").alias("n"))


HEX_SQL = """WITH p AS (SELECT *, lon * 111320.0::DOUBLE * cos(radians(39.22::DOUBLE)) AS x, lat * 111320.0::DOUBLE AS y FROM origins), box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
k AS (SELECT 600.0::DOUBLE / cos(pi() / 6) AS r), cells AS (SELECT c.c, w.w, x0 - r + c.c * 1.5::DOUBLE * r AS cx, y0 - sqrt(3.0::DOUBLE) * r + CASE WHEN c.c % 2 = 0 THEN 0 ELSE sqrt(3.0::DOUBLE) * r / 2 END + w.w * sqrt(3.0::DOUBLE) * r AS cy, x1, y1, r FROM box, k, range(0, 40) c(c), range(0, 40) w(w)),
near AS (SELECT c, w, node_id, row_number() OVER (PARTITION BY c, w ORDER BY round(power(x - cx, 2) + power(y - cy, 2), 4), node_id) AS n, sqrt(power(x - cx, 2) + power(y - cy, 2)) AS d, r FROM cells, p WHERE cx <= x1 + r AND cy <= y1 + sqrt(3.0::DOUBLE) * r)
SELECT node_id, printf('H%04d_%04d', c, w) AS hex_id FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY c, w) AS claim FROM near WHERE n = 1 AND d <= r) WHERE claim = 1"""


@query("jn_21_hex_claim", HEX_SQL)
def jn_21(v):
    from isoreach.operators.grid import claimed_nodes

    return claimed_nodes(v.origins, 600.0, 39.22).select("node_id", "hex_id")


@query("jn_22_display_cells", f"SELECT c, w, node_id FROM (SELECT c, w, node_id, row_number() OVER (PARTITION BY c, w ORDER BY round({hav_sql('clat', 'clon', 'lat', 'lon')}, 6), node_id) AS r FROM (SELECT c.c::INTEGER AS c, w.w::INTEGER AS w, 39.18::DOUBLE + w.w * 0.01::DOUBLE AS clat, 9.05::DOUBLE + c.c * 0.015::DOUBLE AS clon FROM range(0, 9) c(c), range(0, 9) w(w)), origins) WHERE r = 1")
def jn_22(v):
    side = v.spark.range(9)
    cells = side.select(F.col("id").cast("int").alias("c")).crossJoin(side.select(F.col("id").cast("int").alias("w")))  # 81 cells of a lattice
    cells = cells.withColumn("clat", 39.18 + F.col("w") * 0.01).withColumn("clon", 9.05 + F.col("c") * 0.015).withColumn("cell", F.concat_ws("_", "c", "w"))
    near = spatial.nearest(cells, v.origins.select("node_id", "lat", "lon"), "cell", ("clat", "clon"), AT, "node_id", k=3)
    return places.shortest(near.withColumn("d", F.round("dist_m", 6)), ["cell"], ["d", "node_id"]).select("c", "w", "node_id")


@query("jn_23_missing_flag", "SELECT i.id AS poi_id, p.poi_type, p.poi_id IS NULL AS missing FROM (SELECT DISTINCT l_suppkey * 2 AS id FROM lineitem) i LEFT JOIN pois p ON p.poi_id = i.id")
def jn_23(v):
    items = v.table("lineitem").select((F.col("l_suppkey") * 2).alias("poi_id")).distinct()
    return items.join(v.pois.select("poi_id", "poi_type", F.lit(True).alias("there")), "poi_id", "left").select("poi_id", "poi_type", F.col("there").isNull().alias("missing"))


@query("jn_24_greedy_assignment")
def jn_24(v):
    from isoreach.operators.grid import greedy_nearest

    return greedy_nearest(v.zones.select("zone_id", ((F.col("south") + F.col("north")) / 2).alias("zlat"), ((F.col("west") + F.col("east")) / 2).alias("zlon")), v.origins.select("node_id", "lat", "lon"), "zone_id", ("zlat", "zlon"), "node_id", AT)


@query("jn_25_score_report", "SELECT o.from_id, round(sum(p.balance / 10000 * o.n), 6) AS power FROM (SELECT from_id, to_id % 100 + 1 AS k, count(*) AS n FROM od GROUP BY 1, 2) o JOIN pois p ON p.poi_id = o.k JOIN supplier s ON s.s_suppkey = o.from_id GROUP BY o.from_id")
def jn_25(v):
    acc = v.od.groupBy("from_id", (F.col("to_id") % 100 + 1).alias("poi_id")).agg(F.count("*").alias("n"))
    weights = v.pois.select("poi_id", (F.col("balance") / 10000).alias("w"))
    known = v.table("supplier").select(F.col("s_suppkey").alias("from_id"))
    return acc.join(weights, "poi_id").join(known, "from_id", "left_semi").groupBy("from_id").agg(F.round(F.sum(F.col("w") * F.col("n")), 6).alias("power"))


BRIDGE_SQL = f"""WITH RECURSIVE e AS (SELECT i AS u, j AS v FROM ({ADJ_SQL}) UNION SELECT j, i FROM ({ADJ_SQL}) UNION SELECT poi_id, poi_id FROM pois), walk(node, c) AS (SELECT u, u FROM e UNION SELECT e.v, walk.c FROM walk JOIN e ON e.u = walk.node),
comp AS (SELECT node, component, plat, plon FROM (SELECT node, min(c) AS component FROM walk GROUP BY node) JOIN pois ON poi_id = node), main AS (SELECT component AS m FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)
SELECT a.component, count(DISTINCT a.node) AS n, round(min({hav_sql('a.plat', 'a.plon', 'b.plat', 'b.plon')}), 6) AS dist_m FROM comp a, comp b, main WHERE a.component <> m AND b.component = m GROUP BY a.component"""


@query("jn_27_bridge_fragments", BRIDGE_SQL)
def jn_27(v):
    """Each fragment of the adjacency with its number of places and its shortest link to the largest one."""
    from isoreach.operators.components import connected_components

    comp = connected_components(jn_17(v), "i", "j")
    nodes = v.pois.select(F.col("poi_id").alias("node"), F.col("plat").alias("lat"), F.col("plon").alias("lon"))
    every = nodes.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    sizes = every.groupBy("component").agg(F.count("*").alias("n"))
    return graph.bridges(nodes, every).join(sizes, "component").select("component", "n", F.round("dist_m", 6).alias("dist_m"))


@query("jn_28_all_pairs", f"SELECT a.zone_id AS i, b.zone_id AS j, round({hav_sql('a.south', 'a.west', 'b.south', 'b.west')}, 6) AS dist_m FROM zones a, zones b WHERE a.zone_id < b.zone_id")
def jn_28(v):
    """Every two zones with their distance: one row of all zones, a fixed few, meets each."""
    z = F.struct(F.col("zone_id").alias("j"), F.col("south").alias("lat"), F.col("west").alias("lon"))
    every = v.zones.agg(F.collect_list(z).alias("every"))
    pairs = v.zones.join(F.broadcast(every), F.lit(True)).select(F.col("zone_id").alias("i"), "south", "west", F.explode("every").alias("b")).where("i < b.j")
    return pairs.select("i", "b.j", F.round(geo.haversine_m(F.col("south"), F.col("west"), F.col("b.lat"), F.col("b.lon")), 6).alias("dist_m"))


@query("jn_29_point_lookup", f"SELECT from_id, to_id, round(t, 6) AS t FROM ({BEST_OD}) WHERE from_id = 7 AND to_id IN (SELECT to_id FROM od WHERE to_id % 3 = 0)")
def jn_29(v):
    best = v.od.where("from_id = 7").groupBy("from_id", "to_id").agg(F.min(F.col("access_time") + F.col("wait_time") + F.col("ride_time") + F.col("transfer_time") + F.col("egress_time")).alias("t"))
    return best.join(v.od.where("to_id % 3 = 0").select("to_id").distinct(), "to_id", "left_semi").select("from_id", "to_id", F.round("t", 6).alias("t"))


@query("jn_31_stops_in_walk_radius", f"SELECT node_id, count(*) AS n, round(min(dist_m), 6) AS least FROM hav_pairs WHERE dist_m <= 900 GROUP BY node_id")
def jn_31(v):
    return spatial.within(v.origins, v.pois, 900.0, AT, PAT).groupBy("node_id").agg(F.count("*").alias("n"), F.round(F.min("dist_m"), 6).alias("least"))


@query("jn_32_pairs_left_itineraries", "SELECT p.poi_id, z.zone_id, coalesce(s.n, 0) AS n FROM pois p CROSS JOIN zones z LEFT JOIN (SELECT from_id % 100 + 1 AS f, to_id % 25 AS t, count(*) AS n FROM second GROUP BY 1, 2) s ON s.f = p.poi_id AND s.t = z.zone_id")
def jn_32(v):
    slow = v.second.groupBy((F.col("from_id") % 100 + 1).alias("poi_id"), (F.col("to_id") % 25).alias("t")).agg(F.count("*").alias("n"))
    pairs = v.pois.select("poi_id").join(F.broadcast(v.zones.select("zone_id")), F.lit(True))  # every destination zone, a fixed few
    return pairs.join(slow.withColumn("zone_id", F.col("t").cast("int")), ["poi_id", "zone_id"], "left").select("poi_id", "zone_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("src_16_coverage_gate", "SELECT (SELECT count(DISTINCT from_id) FROM od WHERE from_id IN (SELECT poi_id FROM pois)) >= 0.9 * (SELECT count(*) FROM pois) AS covered")
def src_16(v):
    return v.spark.createDataFrame([(covered(v.od.select(F.col("from_id").alias("poi_id")), v.pois, "poi_id"),)], "covered boolean")


@query("agg_02_shortest_edge", "SELECT u, v, min(length_m) AS length_m FROM edges GROUP BY u, v")
def agg_02(v):
    return graph.shortest_edges(v.edges)


ROUTE_SQL = """WITH RECURSIVE e AS (SELECT u, v, min(length_m) AS w FROM edges WHERE u <> v GROUP BY u, v), walk(src, node, d) AS (SELECT n, n, 0.0::DOUBLE FROM (SELECT DISTINCT (node_id * 7) % 200 AS n FROM origins)
UNION SELECT walk.src, e.v, walk.d + e.w FROM walk JOIN e ON e.u = walk.node WHERE walk.d + e.w <= {limit}) SELECT node_id, src, node, round(dist, 6) AS dist FROM (SELECT src::BIGINT AS src, node::BIGINT AS node, min(d) AS dist FROM walk GROUP BY src, node) JOIN (SELECT node_id, (node_id * 7) % 200 AS src FROM origins) USING (src)"""


def _on_graph(v):
    """Every origin on its graph node, by the arithmetic that places have; origins on one node share a search."""
    return v.origins.select("node_id", ((F.col("node_id") * 7) % 200).alias("src"))


@query("it_01_bounded_shortest_paths", ROUTE_SQL.format(limit=300))
def it_01(v):
    sources = _on_graph(v)
    return graph.shortest_paths(v.edges, sources, 300.0).join(sources, "src").select("node_id", "src", "node", F.round("dist", 6).alias("dist"))


@query("it_03_paths")
def it_03(v):
    sources = _on_graph(v)
    return graph.shortest_paths(v.edges, sources, 300.0, paths=True).join(sources, "src").select("node_id", "src", "node", F.round("dist", 6).alias("dist"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("agg_16_components", "WITH RECURSIVE e AS (SELECT u, v FROM edges WHERE length_m < 70 UNION SELECT v, u FROM edges WHERE length_m < 70), walk(node, c) AS (SELECT u, u FROM e UNION SELECT e.v, walk.c FROM walk JOIN e ON e.u = walk.node) SELECT node, min(c) AS component FROM walk GROUP BY node")
def agg_16(v):
    from isoreach.operators.components import connected_components

    return connected_components(v.edges.where("length_m < 70"), "u", "v")


@query("agg_17_cluster_names", f"WITH RECURSIVE e AS (SELECT i AS u, j AS v FROM ({ADJ_SQL}) UNION SELECT j, i FROM ({ADJ_SQL})), walk(node, c) AS (SELECT u, u FROM e UNION SELECT e.v, walk.c FROM walk JOIN e ON e.u = walk.node), comp AS (SELECT node, min(c) AS component FROM walk GROUP BY node) SELECT component, string_agg(DISTINCT s_name, '; ' ORDER BY s_name) AS names FROM comp JOIN supplier ON s_suppkey = node GROUP BY component")
def agg_17(v):
    from isoreach.operators.components import connected_components

    comp = connected_components(jn_17(v), "i", "j").withColumnRenamed("node", "s_suppkey")
    return comp.join(v.table("supplier").select("s_suppkey", "s_name"), "s_suppkey").groupBy("component").agg(F.array_join(F.sort_array(F.collect_set("s_name")), "; ").alias("names"))


@query(
    "it_02_walk_step",
    ROUTE_SQL.format(limit=300).replace("SELECT node_id, src, node, round(dist, 6) AS dist FROM", "SELECT node_id, src, poi_id, round((dist / 1000 + gap_p) / 5.0::DOUBLE * 60, 6) AS walk, dist / 1000 + gap_p <= 0.25 AS in_radius FROM") + " JOIN pois p ON (p.poi_id * 7) % 200 = node",
)
def it_02(v):
    """Places on their graph nodes, bounded paths from the origins, and minutes on foot with the last gap."""
    from isoreach.operators.decay import impedance

    sources = _on_graph(v)
    n = sources.count()
    origins = spatial.alike(sources, "node_id", ["src"], ids="node_ids").drop("node_id")
    on_graph = spatial.alike(v.pois.select("poi_id", ((F.col("poi_id") * 7) % 200).alias("node"), "gap_p"), "poi_id", ["node", "gap_p"], ids="poi_ids")
    paths = graph.shortest_paths(v.edges, origins, 300.0)
    parts = max(v.spark.sparkContext.defaultParallelism, min(MOST_PARTS, n * v.pois.count() // spatial.PART_ROWS))
    walk = impedance("walk", F.col("dist") / 1000, F.lit(0.0), F.col("gap_p"))
    walked = paths.repartition(parts, "src", "node").join(on_graph, "node").select("src", "poi_ids", F.round(walk, 6).alias("walk"), (F.col("dist") / 1000 + F.col("gap_p") <= 0.25).alias("in_radius"))
    pairs = walked.join(F.broadcast(origins) if n <= graph.MOST_SENT else origins, "src")
    return spatial.each_pair(pairs.select("node_ids", "src", "poi_ids", "walk", "in_radius"), node_ids="node_id", poi_ids="poi_id")


@query("it_06_convex_hull")
def it_06(v):
    from isoreach.operators.grid import convex_hulls

    return convex_hulls(v.origins.select("zone", "lon", "lat"), "zone", "lon", "lat")
