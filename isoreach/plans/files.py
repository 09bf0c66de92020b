"""Sources and sinks: tables written in a format and read back by its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoreach.functions import geo
from isoreach.functions.shared import shared_path, through_table
from isoreach.operators import gtfs
from isoreach.plans.registry import query
from isoreach.plans.selection import TRANSIT_SQL
from isoreach.sinks import tables as sinks
from isoreach.sources import config, tables


@query("src_01_taxonomy", "SELECT p_brand AS poi_type, 10.0::DOUBLE + count(*) AS decay_coefficient, count(DISTINCT p_type) AS n_values FROM part GROUP BY p_brand")
def src_01(v):
    path = shared_path(v.spark, "taxonomy")
    one = F.to_json(F.struct(F.sort_array(F.collect_set("p_type")).alias("kind")))
    cells = v.table("part").groupBy(F.col("p_brand").alias("poi_type")).agg((10 + F.count("*")).alias("decay_coefficient"), one.alias("tags"))
    cells.write.csv(path, header=True, quote='"', escape='"')
    t = config.read_taxonomy(v.spark, path)
    return t.select("poi_type", "decay_coefficient", F.size(F.flatten(F.transform("clauses", lambda c: c["kind"]))).cast("long").alias("n_values"))


@query("src_02_services", "SELECT r_name AS service, (row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1)::INTEGER AS idx, n_name AS poi_type, round(0.1::DOUBLE * n_nationkey, 6) AS capacity, n_nationkey::INTEGER AS contribution FROM nation JOIN region ON n_regionkey = r_regionkey")
def src_02(v):
    path = shared_path(v.spark, "services")
    rows = v.table("nation").join(F.broadcast(v.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    listed = rows.groupBy(F.col("r_name").alias("service")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    text = lambda f: F.concat(F.lit("["), F.array_join(F.transform("l", f), ", "), F.lit("]"))
    cells = listed.select("service", text(lambda x: F.concat(F.lit("'"), x["n_name"], F.lit("'"))).alias("poi_types"), text(lambda x: (x["n_nationkey"] * 0.1).cast("string")).alias("choquet_capacity"), text(lambda x: x["n_nationkey"].cast("string")).alias("contribution_coefficient"))
    cells.write.csv(path, header=True, quote='"', escape='"')
    out = config.read_services(v.spark, path, v.table("nation").select(F.col("n_name").alias("poi_type")))
    return out.select("service", "idx", "poi_type", F.round("capacity", 6).alias("capacity"), "contribution")


@query("src_03_capabilities", "SELECT r_name AS capability, 2 AS n, round(0.5::DOUBLE, 6) AS weight, r_regionkey = 1 AS has_veto, r_regionkey <> 2 AS enabled FROM region")
def src_03(v):
    path = shared_path(v.spark, "capabilities")
    k = F.col("r_regionkey")
    v.table("region").select(
        F.col("r_name").alias("capability"), F.lit("['s1', 's2']").alias("services"), F.when(k % 2 == 0, F.lit("[0.5, 0.5]")).alias("electre_weight"),
        F.when(k == 1, F.lit("0.4")).when(k == 3, F.lit("inf")).alias("veto_threshold"), F.when(k == 2, F.lit("False")).alias("enabled"),
    ).write.csv(path, header=True, quote='"', escape='"')
    out = config.read_capabilities(v.spark, path)
    return out.select("capability", F.size("services").alias("n"), F.round(F.get("weights", F.lit(0)), 6).alias("weight"), (F.col("veto") < float("inf")).alias("has_veto"), "enabled")


@query("src_04_tag_codes", "SELECT p_partkey AS id, CASE WHEN p_type LIKE 'STANDARD%' THEN 'S1' WHEN p_type LIKE 'SMALL%' THEN 'S2' ELSE p_type END AS code FROM part")
def src_04(v):
    codes = v.table("part").select("p_type").distinct().select(F.col("p_type").alias("raw_tag"), F.when(F.col("p_type").startswith("STANDARD"), F.lit("S1")).when(F.col("p_type").startswith("SMALL"), F.lit("S2")).alias("code")).where("code is not null")
    path = shared_path(v.spark, "codes")
    codes.write.csv(path, header=True)
    read = v.spark.read.csv(path, header=True, schema="raw_tag string, code string")
    return v.table("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("raw_tag")).join(read, "raw_tag", "left").select("id", F.coalesce("code", "raw_tag").alias("code"))


@query("src_05_canteens", "SELECT DISTINCT s_nationkey::VARCHAR AS osmid FROM supplier")
def src_05(v):
    path = shared_path(v.spark, "canteens")
    v.table("supplier").select(F.col("s_nationkey").alias("osmid"), F.col("s_name").alias("name")).write.csv(path, header=True)
    none = config.read_ids(v.spark, shared_path(v.spark, "absent"), "osmid")
    return config.read_ids(v.spark, path, "osmid").unionByName(none)


@query("src_06_graph_xml", "SELECT u, v, min(length_m) AS length_m FROM edges GROUP BY u, v")
def src_06(v):
    path = shared_path(v.spark, "graph")
    v.edges.select(F.col("u").alias("_source"), F.col("v").alias("_target"), F.col("length_m").alias("length")).write.format("xml").option("rootTag", "graph").option("rowTag", "edge").save(path)
    return tables.read_graph_xml(v.spark, path)


@query("src_07_edge_table", "SELECT u, count(*) AS n FROM edges WHERE length_m < 500 GROUP BY u")
def src_07(v):
    return through_table(v.edges, "edges").where("length_m < 500").groupBy("u").agg(F.count("*").alias("n"))


@query("src_09_universe", "SELECT 'gear' AS q, count(*) AS n FROM places WHERE list_has_any(string_split(kind, '; '), ['GEAR']) UNION ALL SELECT 'widget', count(*) FROM places WHERE list_has_any(string_split(kind, '; '), ['WIDGET'])")
def src_09(v):
    """One scan answers all queries: each row says which it matches."""
    from isoreach.operators.places import clause

    hits = F.array(*(F.when(clause(F.col("tags"), {"kind": [k]}), F.lit(k.lower())) for k in ("GEAR", "WIDGET")))
    return v.places.select(F.explode(F.array_compact(hits)).alias("q")).groupBy("q").agg(F.count("*").alias("n"))


@query("src_10_geojson", "SELECT s_suppkey::VARCHAR AS id, 'Point' AS geom_type, s_name AS name, round(plat, 6) AS lat, round(plon, 6) AS lon FROM supplier JOIN pois ON poi_id = s_suppkey")
def src_10(v):
    path = shared_path(v.spark, "geojson")
    p = v.pois.join(v.table("supplier").select(F.col("s_suppkey").alias("poi_id"), "s_name"), "poi_id")
    feature = F.struct(F.col("poi_id").cast("string").alias("id"), F.create_map(F.lit("name"), F.col("s_name")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("plon", "plat").alias("coordinates")).alias("geometry"))
    p.groupBy((F.col("poi_id") % 4).alias("file")).agg(F.collect_list(feature).alias("features")).write.partitionBy("file").json(path)  # one collection a file
    g = tables.read_geojson(v.spark, path)
    first = F.get("vertices", F.lit(0))
    return g.select("id", "geom_type", F.col("tags")["name"].alias("name"), F.round(first["lat"], 6).alias("lat"), F.round(first["lon"], 6).alias("lon"))


@query("src_11_label_scan", "SELECT p_partkey AS id FROM part WHERE p_type IN ('STANDARD', 'SMALL')")
def src_11(v):
    return v.table("part").select("p_partkey", "p_type").where(F.col("p_type").isin("STANDARD", "SMALL")).select(F.col("p_partkey").alias("id"))


@query("src_13_itineraries", f"SELECT from_id, count(*) AS n, round(avg({TRANSIT_SQL}), 6) AS cost FROM od GROUP BY from_id")
def src_13(v):
    from isoreach.operators.decay import transit_impedance

    path = shared_path(v.spark, "itineraries")
    v.od.write.csv(path, header=True)
    rows = tables.read_itineraries(v.spark, path)
    cost = transit_impedance(*(F.col(c) for c in ("access_time", "wait_time", "ride_time", "transfer_time", "egress_time", "routes")))
    return rows.groupBy("from_id").agg(F.count("*").alias("n"), F.round(F.avg(cost), 6).alias("cost"))


@query("src_14_rows_by_id", "SELECT poi_id, poi_type FROM pois WHERE poi_id IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def src_14(v):
    ids = v.table("lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("poi_id")).distinct()
    return through_table(v.pois, "pois").join(ids, "poi_id", "left_semi").select("poi_id", "poi_type")


HEXED = "SELECT c_custkey AS id, printf('H%04d_%04d', (c_custkey % 23)::INTEGER, (c_custkey % 17)::INTEGER) AS hex_id FROM customer"
SHARDED = f"SELECT id, hex_id, printf('s%04d_%04d', (id % 23)::INTEGER // 4, (id % 17)::INTEGER // 4) AS shard FROM ({HEXED})"


def hexed(v):
    k = F.col("c_custkey")
    return v.table("customer").select(k.alias("id"), geo.hex_id((k % 23).cast("int"), (k % 17).cast("int")).alias("hex_id"))


@query("src_15_shard_read", f"SELECT id, hex_id FROM ({SHARDED}) WHERE shard IN ('s0000_0000', 's0001_0002')")
def src_15(v):
    path = shared_path(v.spark, "shards")
    sinks.write_shards(hexed(v), "hex_id", path)
    return tables.read_shards(v.spark, path, ["s0000_0000", "s0001_0002"]).select("id", "hex_id")


@query("src_17_sparse_values", "SELECT cap, count(*) AS n, round(sum(b - a), 6) AS total FROM scores WHERE b - a > 0 GROUP BY cap")
def src_17(v):
    path = shared_path(v.spark, "sparse")
    sinks.write_sparse(v.scores.select("hex_id", "cap", (F.col("b") - F.col("a")).alias("value")), "value", path)
    return v.spark.read.parquet(path).groupBy("cap").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def _apart(spark, path: str) -> None:
    """Makes the files of a folder ten seconds older, since file times may be whole seconds."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(at):
        fs.setTimes(f.getPath(), f.getModificationTime() - 10_000, -1)


@query("src_18_newest_file", "SELECT hex_id, round(b, 6) AS value FROM scores WHERE hex_id % 4 = 1")
def src_18(v):
    path = shared_path(v.spark, "runs")
    for i, c in enumerate(("a", "b")):
        v.scores.where(f"hex_id % 4 = {i}").select("hex_id", F.col(c).alias("value")).coalesce(1).write.mode("append").csv(path, header=True)
        _apart(v.spark, path)
    return tables.newest_rows(v.spark, path, "hex_id long, value double").select("hex_id", F.round("value", 6).alias("value"))


@query("src_19_clip", "SELECT node_id FROM origins WHERE lon - 9.07003::DOUBLE + (lat - 39.20003::DOUBLE) < 0.06::DOUBLE AND lon > 9.07003::DOUBLE AND lat > 39.20003::DOUBLE")
def src_19(v):
    path = shared_path(v.spark, "points")
    v.origins.select("node_id", "lat", "lon").write.csv(path, header=True)
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((9.07003, 39.20003), (9.13003, 39.20003), (9.07003, 39.26003))))
    near = v.spark.read.csv(path, header=True, schema="node_id long, lat double, lon double").where("lat between 39.2 and 39.26 and lon between 9.07 and 9.13")  # the ring's box first
    return near.where(geo.in_polygon(F.col("lon"), F.col("lat"), ring)).select("node_id")


@query("src_20_price_fallback", "SELECT s_nationkey AS zone, first(s_acctbal ORDER BY CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 2 THEN 2 END, s_acctbal) AS price FROM supplier WHERE s_suppkey % 3 IN (0, 2) GROUP BY s_nationkey")
def src_20(v):
    kind = F.element_at(F.array(F.lit("normal"), F.lit("luxury"), F.lit("cheap")), (F.col("s_suppkey") % 3).cast("int") + 1)
    rows = v.table("supplier").select(F.col("s_nationkey").alias("zone"), kind.alias("kind"), F.col("s_acctbal").alias("price"))
    return tables.by_priority(rows, "zone", {"normal": 1, "cheap": 2}, "kind", "price")


@query("src_22_static_layers", "SELECT upper(n_name) AS label, zone_id FROM nation JOIN zones ON zone_id = n_nationkey WHERE region = 1")
def src_22(v):
    return v.zones.where("region = 1").select(F.upper("zone_name").alias("label"), "zone_id")


@query("src_23_relabel_file", "SELECT CASE WHEN place_id % 20 = 0 THEN 'moved' ELSE brand END AS poi_type, count(*) AS n FROM places WHERE place_id % 50 <> 0 GROUP BY 1")
def src_23(v):
    from isoreach.operators.places import relabelled

    path = shared_path(v.spark, "relabels")
    v.places.select("place_id", F.when(F.col("place_id") % 50 == 0, F.lit("")).when(F.col("place_id") % 20 == 0, F.lit("moved")).alias("new_type")).where("new_type is not null").write.json(path)
    rows = v.places.select("place_id", F.col("tags")["brand"].alias("poi_type"))
    return relabelled(rows, v.spark.read.schema("place_id long, new_type string").json(path)).groupBy("poi_type").agg(F.count("*").alias("n"))


@query("snk_01_wide_csv", "SELECT zone, max(CASE WHEN k = 0 THEN n END) AS c0, max(CASE WHEN k = 1 THEN n END) AS c1 FROM (SELECT zone, node_id % 2 AS k, count(*) AS n FROM origins GROUP BY 1, 2) GROUP BY zone")
def snk_01(v):
    path = shared_path(v.spark, "wide")
    long = v.origins.groupBy("zone", F.concat(F.lit("c"), F.col("node_id") % 2).alias("name")).agg(F.count("*").alias("n"))
    sinks.write_wide_csv(long, ["zone"], "name", "n", ["c0", "c1"], path)
    return v.spark.read.csv(path, header=True, schema="zone int, c0 long, c1 long")


@query("snk_02_recap", "SELECT cap, run, round(avg(x), 6) AS mean FROM (SELECT cap, 0 AS run, a AS x FROM scores UNION ALL SELECT cap, 1, b FROM scores) GROUP BY 1, 2")
def snk_02(v):
    path = shared_path(v.spark, "recap")
    for run, c in enumerate(("a", "b")):
        sinks.append_recap(v.scores.select("cap", F.lit(run).alias("run"), F.col(c).alias("mean")), ["cap", "run"], ["mean"], path)
    return v.spark.read.parquet(path).select("cap", "run", F.round("mean", 6).alias("mean"))


@query("snk_03_missing_rows", "SELECT hex_id, cap FROM scores WHERE hex_id % 3 <> 0")
def snk_03(v):
    have = through_table(v.scores.where("hex_id % 3 = 0").select("hex_id", "cap"), "matrix")
    return sinks.missing_rows(v.scores.select("hex_id", "cap"), have, ["hex_id", "cap"])


@query("snk_04_sparse", "SELECT count(*) AS n FROM scores WHERE b > 0.5")
def snk_04(v):
    path = shared_path(v.spark, "sparse")
    sinks.write_sparse(v.scores.select("hex_id", (F.col("b") - 0.5).alias("value")), "value", path)
    return v.spark.read.parquet(path).agg(F.count("*").alias("n"))


@query("snk_05_bundle", "SELECT from_id, count(*) AS n, round(sum(minutes), 6) AS total FROM second GROUP BY from_id")
def snk_05(v):
    path = shared_path(v.spark, "bundle")
    v.second.sortWithinPartitions("from_id").write.option("compression", "zstd").parquet(path)
    return v.spark.read.parquet(path).groupBy("from_id").agg(F.count("*").alias("n"), F.round(F.sum("minutes"), 6).alias("total"))


@query("snk_06_shards", f"SELECT shard, count(*) AS n FROM ({SHARDED}) GROUP BY shard")
def snk_06(v):
    path = shared_path(v.spark, "shards")
    sinks.write_shards(hexed(v), "hex_id", path)
    return tables.read_shards(v.spark, path).groupBy("shard").agg(F.count("*").alias("n"))


@query("snk_07_measure_views", "SELECT cap, round(avg(a), 6) AS v, 'a' AS measure FROM scores GROUP BY cap UNION ALL SELECT cap, round(avg(b), 6), 'b' FROM scores GROUP BY cap")
def snk_07(v):
    """One written layer with a folder for each measure; a view reads its own folder alone."""
    path = shared_path(v.spark, "measures")
    both = F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in ("a", "b"))))
    v.scores.select("cap", both).write.partitionBy("measure").parquet(path)
    views = [v.spark.read.parquet(path).where(F.col("measure") == m).groupBy("cap", "measure").agg(F.round(F.avg("x"), 6).alias("v")) for m in ("a", "b")]
    return views[0].unionByName(views[1]).select("cap", "v", "measure")


@query("snk_08_short_names", "SELECT 'capability' AS short, 'capability_care' AS long UNION ALL SELECT 'capabili_1', 'capability_nutrition' UNION ALL SELECT 'a_b', 'a b'")
def snk_08(v):
    names = sinks.column_names(["capability_care", "capability_nutrition", "a b"], 10)
    return v.spark.createDataFrame([(s, n) for n, s in names.items()], "short string, long string")


@query("snk_09_type_values_json", "SELECT poi_type, count(*) AS n, max(balance) AS top FROM pois GROUP BY poi_type")
def snk_09(v):
    cells = v.pois.groupBy("poi_type").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("poi_id").cast("string"), "balance")))).alias("json"))
    m = F.from_json("json", "map<string,double>")
    return cells.withColumn("m", m).select("poi_type", F.size("m").cast("long").alias("n"), F.array_max(F.map_values("m")).alias("top"))


@query("snk_10_comparison", "SELECT hex_id, round(a, 6) AS care_base, round(b, 6) AS care_arm, round(b - a, 6) AS dcont FROM scores")
def snk_10(v):
    path = shared_path(v.spark, "comparison")
    v.scores.select("hex_id", F.round("a", 6).alias("care_base"), F.round("b", 6).alias("care_arm"), F.round(F.col("b") - F.col("a"), 6).alias("dcont")).write.csv(path, header=True)
    return v.spark.read.csv(path, header=True, schema="hex_id long, care_base double, care_arm double, dcont double")


@query("snk_11_feed_tables", "SELECT stop_id::VARCHAR AS stop_id, count(*) AS n FROM departures GROUP BY 1")
def snk_11(v):
    path = shared_path(v.spark, "stop_times")
    v.departures.select(F.col("trip_id").cast("string").alias("trip_id"), F.col("stop_id").cast("string").alias("stop_id")).write.csv(path, header=True)
    return v.spark.read.csv(path, header=True, schema="trip_id string, stop_id string").groupBy("stop_id").agg(F.count("*").alias("n"))


@query("snk_12_checkpointed", "SELECT zone, count(*) AS n FROM origins GROUP BY zone")
def snk_12(v):
    return through_table(v.origins.groupBy("zone").agg(F.count("*").alias("n")), "snapped")


@query("snk_13_geojson_rows", "SELECT poi_id, 'Feature' AS kind, round(plon, 6) AS lon FROM pois")
def snk_13(v):
    rows = sinks.geojson_rows(v.pois, "plon", "plat", ["poi_id", "poi_type"])
    j = F.from_json("feature", "type string, geometry struct<type:string,coordinates:array<double>>, properties struct<poi_id:long>")
    return rows.withColumn("j", j).select(F.col("j.properties.poi_id").alias("poi_id"), F.col("j.type").alias("kind"), F.round(F.get("j.geometry.coordinates", F.lit(0)), 6).alias("lon"))


@query("snk_14_results_csv", "SELECT cap, count(*) AS n FROM scores GROUP BY cap")
def snk_14(v):
    path = shared_path(v.spark, "results")
    v.scores.groupBy("cap").agg(F.count("*").alias("n")).write.csv(path, header=True)
    return v.spark.read.csv(path, header=True, schema="cap int, n long")


def feed(v):
    """A timetable: customers' orders as trips, suppliers as stops."""
    li = v.table("lineitem")
    s = F.col
    return {
        "routes": v.table("nation").select(s("n_nationkey").alias("route_id"), s("n_regionkey").alias("agency_id")),
        "agency": v.table("region").select(s("r_regionkey").alias("agency_id"), s("r_name").alias("agency_name")),
        "trips": v.table("orders").select(s("o_orderkey").alias("trip_id"), (s("o_custkey") % 25).cast("int").alias("route_id"), (s("o_orderkey") % 4).alias("service_id"), (s("o_custkey") % 9).alias("shape_id")),
        "stop_times": li.select(s("l_orderkey").alias("trip_id"), s("l_suppkey").alias("stop_id"), s("l_linenumber").cast("int").alias("stop_sequence")),
        "stops": v.table("supplier").select(s("s_suppkey").alias("stop_id"), F.element_at(F.array(F.lit("0"), F.lit("1"), F.lit("2")), (s("s_suppkey") % 3).cast("int") + 1).alias("wheelchair_boarding"), F.when(s("s_suppkey") % 5 == 0, s("s_suppkey") / 5).cast("long").cast("string").alias("parent_station")),
        "calendar": v.spark.range(4).select(s("id").alias("service_id")),
    }


FEED = """WITH r AS (SELECT n_nationkey AS route_id FROM nation WHERE n_regionkey IN (0, 1, 2)), tr AS (SELECT o_orderkey AS trip_id, (o_custkey % 25)::INTEGER AS route_id FROM orders WHERE (o_custkey % 25) IN (SELECT route_id FROM r)),
st AS (SELECT l_orderkey AS trip_id, l_suppkey AS stop_id FROM lineitem WHERE l_orderkey IN (SELECT trip_id FROM tr) AND l_suppkey % 3 <> 2), ok AS (SELECT trip_id FROM st GROUP BY trip_id HAVING count(*) >= 2),
st2 AS (SELECT * FROM st WHERE trip_id IN (SELECT trip_id FROM ok)), used AS (SELECT DISTINCT stop_id FROM st2 UNION SELECT stop_id // 5 FROM st2 WHERE stop_id % 5 = 0)"""


@query("jn_26_feed_cascade", FEED + " SELECT 'stop_times' AS t, count(*) AS n FROM st2 UNION ALL SELECT 'trips', count(*) FROM tr WHERE trip_id IN (SELECT trip_id FROM ok) UNION ALL SELECT 'stops', count(*) FROM supplier WHERE s_suppkey IN (SELECT stop_id FROM used) UNION ALL SELECT 'routes', count(DISTINCT route_id) FROM tr WHERE trip_id IN (SELECT trip_id FROM ok)")
def jn_26(v):
    out = gtfs.restricted(feed(v), F.col("agency_id").isin(0, 1, 2))
    parts = [out[t].select(F.lit(t).alias("t")) for t in ("stop_times", "trips", "stops", "routes")]
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p)
    return all_parts.groupBy("t").agg(F.count("*").alias("n"))


@query("src_12_zipped_feed", "SELECT n_nationkey::VARCHAR AS route_id, n_name AS route_name, NULL::VARCHAR AS absent FROM nation")
def src_12(v):
    path = shared_path(v.spark, "feed") + "/feed.zip"
    rows = v.table("nation").select("n_nationkey", "n_name").collect()  # the table of nations has a fixed few rows
    sinks.write_zip(v.spark, {"routes.txt": "route_id,route_name\n" + "".join(f'{r.n_nationkey},"{r.n_name}"\n' for r in rows)}, path)
    got = tables.read_zip_csv(v.spark, path, "routes.txt", ["route_id", "route_name", "absent"])
    return got.unionByName(tables.read_zip_csv(v.spark, path, "stops.txt", ["route_id", "route_name", "absent"]))
