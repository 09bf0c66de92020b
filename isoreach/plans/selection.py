"""Filters, tags, ownership and identity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from isoreach.functions import geo, text
from isoreach.operators import gtfs, spatial
from isoreach.operators import places as P
from isoreach.operators.scenarios import Profile
from isoreach.plans.registry import query

# The demonstration's types: clauses by type, in order.
TYPES = {
    "metal": [{"kind": ["GEAR", "WIDGET"], "size": True}, {"kind": ["BOLT"]}],
    "plate": [{"kind": ["PLATE"]}, {"kind": ["GEAR"], "brand": ["brand_11", "brand_12", "brand_13"]}],
    "branded": [{"brand": ["brand_11", "brand_21", "brand_31"]}],
}
_HAS = "list_has_any(string_split(kind, '; '), {})"
_C = {
    "m1": f"({_HAS.format(['GEAR', 'WIDGET'])} AND size IS NOT NULL)", "m2": f"{_HAS.format(['BOLT'])}",
    "p1": f"{_HAS.format(['PLATE'])}", "p2": f"({_HAS.format(['GEAR'])} AND brand IN ('brand_11', 'brand_12', 'brand_13'))", "b1": "brand IN ('brand_11', 'brand_21', 'brand_31')",
}
CANDS_SQL = f"""SELECT place_id, 'metal' AS poi_type, 0 AS idx, CASE WHEN {_C['m1']} THEN 2 ELSE 1 END AS specificity FROM places WHERE {_C['m1']} OR {_C['m2']}
UNION ALL SELECT place_id, 'plate', 1, CASE WHEN {_C['p2']} THEN 2 ELSE 1 END FROM places WHERE {_C['p1']} OR {_C['p2']}
UNION ALL SELECT place_id, 'branded', 2, 1 FROM places WHERE {_C['b1']}"""
OWN_SQL = f"""SELECT place_id, first(poi_type ORDER BY specificity DESC, idx) AS owner, count(*) > 1 AS is_conflict,
count(*) > 1 AND list_reverse_sort(list(specificity))[2] = max(specificity) AS by_order FROM ({CANDS_SQL}) GROUP BY place_id"""


@query("flt_01_values_match", f"SELECT place_id FROM places WHERE {_HAS.format(['GEAR', 'RING'])}")
def flt_01(v):
    return v.places.where(text.multi_match(F.col("tags")["kind"], ["GEAR", "RING"])).select("place_id")


@query("flt_02_clause", f"SELECT place_id FROM places WHERE {_C['m1']}")
def flt_02(v):
    return v.places.where(P.clause(F.col("tags"), TYPES["metal"][0])).select("place_id")


@query("flt_03_any_clause", f"SELECT place_id FROM places WHERE {_C['p1']} OR {_C['p2']}")
def flt_03(v):
    return v.places.where(P.any_clause(F.col("tags"), TYPES["plate"])).select("place_id").dropDuplicates(["place_id"])


@query("flt_04_labels", "SELECT place_id, brand FROM places WHERE brand IN ('brand_11', 'brand_21')")
def flt_04(v):
    labels = v.spark.createDataFrame([(["brand_11", "brand_21", "brand_11"],)], "labels array<string>").select(F.explode("labels").alias("brand")).distinct()
    return v.places.select("place_id", F.col("tags")["brand"].alias("brand")).join(F.broadcast(labels), "brand", "left_semi").select("place_id", "brand")


@query("flt_05_source_radius", "SELECT node_id, poi_id, round(dist_m, 6) AS dist_m FROM hav_pairs WHERE dist_m <= 1500")
def flt_05(v):
    near = spatial.within_alike(v.origins, v.pois, 1500.0, ("lat", "lon"), ("plat", "plon"), "node_id", "poi_id")
    return spatial.each_pair(near.select("left_ids", "right_ids", F.round("dist_m", 6).alias("dist_m")), left_ids="node_id", right_ids="poi_id")


@query("flt_06_in_radius_flag", "SELECT node_id, count(*) AS n, count(*) FILTER (dist_m + gap_p * 1000 <= 1500) AS n_in FROM hav_pairs WHERE dist_m <= 1500 GROUP BY node_id")
def flt_06(v):
    few = spatial.alike(v.origins, "node_id", ["lat", "lon"], count="n_origins")
    near = spatial.within(few, spatial.alike(v.pois, "poi_id", ["plat", "plon", "gap_p"]), 1500.0, ("lat", "lon"), ("plat", "plon"))
    n_in = F.sum(F.when(F.col("dist_m") + F.col("gap_p") * 1000 <= 1500, F.col("n")).otherwise(0))
    return spatial.to_all(near.groupBy("node_id").agg(F.sum("n").alias("n"), n_in.alias("n_in")), v.origins, few, "node_id", ["lat", "lon"])


@query("flt_07_any_origin_in_radius", "SELECT poi_id FROM pois WHERE poi_id IN (SELECT poi_id FROM hav_pairs WHERE dist_m <= 400)")
def flt_07(v):
    return spatial.reaches(v.pois, v.origins, 400.0, ("plat", "plon"), ("lat", "lon")).select("poi_id")


@query("flt_08_drop_filter", f"SELECT c.place_id, c.poi_type FROM ({CANDS_SQL}) c JOIN ({OWN_SQL}) o USING (place_id) WHERE c.poi_type = o.owner")
def flt_08(v):
    c = P.candidates(v.places, TYPES)
    return c.join(P.drops(c, ["place_id"]), ["place_id", "poi_type"], "left_anti").select("place_id", "poi_type")


@query("flt_09_study_area", "SELECT node_id FROM origins WHERE lon - 9.07003::DOUBLE + (lat - 39.20003::DOUBLE) < 0.06::DOUBLE AND lon > 9.07003::DOUBLE AND lat > 39.20003::DOUBLE")
def flt_09(v):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((9.07003, 39.20003), (9.13003, 39.20003), (9.07003, 39.26003))))
    return v.origins.where(geo.in_polygon(F.col("lon"), F.col("lat"), ring)).select("node_id")


@query("flt_10_destination_prefilter", "SELECT DISTINCT poi_id, poi_type FROM hav_pairs WHERE dist_m <= 600")
def flt_10(v):
    return spatial.reaches(v.pois, v.origins, 600.0, ("plat", "plon"), ("lat", "lon")).select("poi_id", "poi_type").distinct()


@query("flt_12_enabled_only", "SELECT r_regionkey AS capability, r_name AS name FROM region WHERE r_regionkey <> 2")
def flt_12(v):
    return v.table("region").select(F.col("r_regionkey").alias("capability"), F.col("r_name").alias("name"), (F.col("r_regionkey") != 2).alias("enabled")).where("enabled").drop("enabled")


TRANSIT_SQL = """CASE WHEN routes IS NULL OR routes IN ('', '[WALK]') THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, access_time + wait_time + ((60 - 0.2::DOUBLE * 1.3::DOUBLE) / 60) * ride_time + transfer_time + egress_time + 0.2::DOUBLE * 1.3::DOUBLE) END"""


@query("flt_13_walk_only", f"SELECT routes, count(*) AS n, round(avg({TRANSIT_SQL}), 6) AS cost FROM od GROUP BY routes")
def flt_13(v):
    from isoreach.operators.decay import transit_impedance

    cost = transit_impedance(*(F.col(c) for c in ("access_time", "wait_time", "ride_time", "transfer_time", "egress_time", "routes")))
    return v.od.groupBy("routes").agg(F.count("*").alias("n"), F.round(F.avg(cost), 6).alias("cost"))


@query("flt_14_known_ids", "SELECT from_id, count(*) AS n FROM od WHERE from_id IN (SELECT poi_id FROM pois WHERE poi_id % 2 = 0) GROUP BY from_id")
def flt_14(v):
    from isoreach.operators.checks import only_known

    return only_known(v.od, v.pois.where("poi_id % 2 = 0"), "from_id", "poi_id").groupBy("from_id").agg(F.count("*").alias("n"))


@query("flt_15_wheelchair", "SELECT s_suppkey AS stop_id, CASE s_suppkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '2' END AS flag FROM supplier WHERE s_suppkey % 3 <> 2")
def flt_15(v):
    flag = F.element_at(F.array(F.lit("0"), F.lit("1"), F.lit("2")), (F.col("s_suppkey") % 3).cast("int") + 1)
    return v.table("supplier").select(F.col("s_suppkey").alias("stop_id"), flag.alias("flag")).where(gtfs.accessible(F.col("flag")))


@query("flt_16_paired_non_null", "SELECT hex_id, round(d, 6) AS diff FROM (SELECT hex_id, CASE WHEN hex_id % 5 = 0 THEN NULL ELSE b END - a AS d FROM scores) WHERE d IS NOT NULL AND d <> 0")
def flt_16(v):
    d = F.when(F.col("hex_id") % 5 != 0, F.col("b")) - F.col("a")
    return v.scores.select("hex_id", d.alias("d")).where(F.col("d").isNotNull() & ~F.isnan("d") & (F.col("d") != 0)).select("hex_id", F.round("d", 6).alias("diff"))


@query("flt_17_submerged_cells", "SELECT node_id FROM origins WHERE NOT (lat < 39.2::DOUBLE AND lon < 9.08::DOUBLE AND node_id % 2 = 0)")
def flt_17(v):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((9.0, 39.0), (9.08, 39.0), (9.08, 39.2), (9.0, 39.2))))
    water = geo.in_polygon(F.col("lon"), F.col("lat"), ring)
    return v.origins.where(~(water & (F.col("node_id") % 2 == 0))).select("node_id")


@query("flt_18_hull_keep", "SELECT node_id FROM origins WHERE node_id IN (SELECT node_id FROM hav_pairs WHERE dist_m <= 300) OR (lat > 39.2::DOUBLE AND lat < 39.24::DOUBLE AND lon > 9.07::DOUBLE AND lon < 9.13::DOUBLE)")
def flt_18(v):
    near = spatial.reaches(v.origins, v.pois, 300.0, ("lat", "lon"), ("plat", "plon")).select("node_id")
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((9.07, 39.2), (9.13, 39.2), (9.13, 39.24), (9.07, 39.24))))
    inside = v.origins.where(geo.in_polygon(F.col("lon"), F.col("lat"), ring)).select("node_id")
    return near.union(inside).distinct()


@query("flt_19_used_columns", "SELECT place_id, brand FROM places")
def flt_19(v):
    return v.places.select("place_id", F.col("tags")["brand"].alias("brand"))


RELABEL_SQL = "SELECT place_id, CASE WHEN place_id % 50 = 0 THEN '' WHEN place_id % 20 = 0 THEN 'moved' ELSE brand END AS poi_type FROM places"


@query("flt_20_relabels", f"SELECT * FROM ({RELABEL_SQL}) WHERE poi_type <> ''")
def flt_20(v):
    rows = v.places.select("place_id", F.col("tags")["brand"].alias("poi_type"))
    labels = v.places.select("place_id", F.when(F.col("place_id") % 50 == 0, F.lit("")).when(F.col("place_id") % 20 == 0, F.lit("moved")).alias("new_type")).where("new_type is not null")
    return P.relabelled(rows, labels)


@query("flt_21_place_labels", "SELECT DISTINCT upper(n_name) AS label, CASE WHEN n_regionkey IN (0, 1) THEN 'city' WHEN n_regionkey = 2 THEN 'town' ELSE 'village' END AS kind FROM nation")
def flt_21(v):
    kind = F.when(F.col("n_regionkey").isin(0, 1), F.lit("city")).when(F.col("n_regionkey") == 2, F.lit("town")).otherwise(F.lit("village"))
    return v.table("nation").select(F.upper("n_name").alias("label"), kind.alias("kind")).dropDuplicates(["label", "kind"])


@query("flt_22_neighbourhood_removal", "SELECT poi_type, string_agg(poi_id::VARCHAR, ',' ORDER BY poi_id) AS dropped FROM pois WHERE plat > 39.2::DOUBLE AND plat < 39.24::DOUBLE AND plon > 9.08::DOUBLE AND plon < 9.14::DOUBLE GROUP BY poi_type")
def flt_22(v):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((9.08, 39.2), (9.14, 39.2), (9.14, 39.24), (9.08, 39.24))))
    inside = v.pois.where(geo.in_polygon(F.col("plon"), F.col("plat"), ring))
    ids = F.transform(F.sort_array(F.collect_set("poi_id")), lambda x: x.cast("string"))
    return inside.groupBy("poi_type").agg(F.array_join(ids, ",").alias("dropped"))


@query("flt_23_departure_window", "SELECT trip_id, stop_id, dep_sec FROM departures WHERE dep_sec BETWEEN 28800 AND 32400")
def flt_23(v):
    return v.departures.where(F.col("dep_sec").between(28800, 28800 + 3600)).select("trip_id", "stop_id", "dep_sec")


@query("flt_24_service_dates", "SELECT DISTINCT service_id FROM (SELECT c_custkey AS service_id FROM customer WHERE c_custkey % 7 < 5 UNION SELECT c_custkey FROM customer WHERE c_custkey % 10 = 6) WHERE service_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 15 = 0)")
def flt_24(v):
    k = F.col("service_id")
    c = v.table("customer").select(F.col("c_custkey").alias("service_id"))
    calendar = c.select("service_id", F.when(k % 7 < 5, "1").otherwise("0").alias("thursday"), F.lit("20250101").alias("start_date"), F.lit("20251231").alias("end_date"))
    added, removed = (c.where(w).select("service_id", F.lit("20250605").alias("date"), F.lit(t).alias("exception_type")) for w, t in ((k % 10 == 6, "1"), (k % 15 == 0, "2")))
    return gtfs.active_services(calendar, added.unionByName(removed), "20250605", "thursday")


@query("agg_13_specificity", f"SELECT place_id, poi_type, specificity FROM ({CANDS_SQL})")
def agg_13(v):
    return P.candidates(v.places, TYPES).select("place_id", "poi_type", "specificity")


@query("agg_14_ownership", OWN_SQL)
def agg_14(v):
    return P.owners(P.candidates(v.places, TYPES), ["place_id"])


@query("agg_15_drop_map", f"SELECT c.poi_type, string_agg(c.place_id::VARCHAR, ',' ORDER BY c.place_id) AS dropped FROM ({CANDS_SQL}) c JOIN ({OWN_SQL}) o USING (place_id) WHERE c.poi_type <> o.owner GROUP BY c.poi_type")
def agg_15(v):
    ids = F.transform(F.sort_array(F.collect_set("place_id")), lambda x: x.cast("string"))
    return P.drops(P.candidates(v.places, TYPES), ["place_id"]).groupBy("poi_type").agg(F.array_join(ids, ",").alias("dropped"))


@query("agg_40_combined_request", "SELECT tag, bool_or(value IS NULL) AS any_value, CASE WHEN bool_or(value IS NULL) THEN '*' ELSE string_agg(DISTINCT value, ',' ORDER BY value) END AS request FROM (SELECT p_brand AS tag, CASE WHEN p_brand LIKE '%1' AND p_partkey % 100 = 0 THEN NULL ELSE p_type END AS value FROM part) GROUP BY tag")
def agg_40(v):
    wild = F.col("p_brand").like("%1") & (F.col("p_partkey") % 100 == 0)
    return P.combined_request(v.table("part").select(F.col("p_brand").alias("tag"), F.when(~wild, F.col("p_type")).alias("value")))


@query("set_02_first_clause", f"SELECT place_id, CASE WHEN {_C['m1']} THEN 'gear' WHEN {_C['m2']} THEN 'bolt' WHEN {_C['p1']} THEN 'plate' ELSE '__unmatched__' END AS raw_tag FROM places")
def set_02(v):
    which = P.first_clause(F.col("tags"), [*TYPES["metal"], TYPES["plate"][0]])
    return v.places.select("place_id", F.coalesce(F.get(F.array(*map(F.lit, ("gear", "bolt", "plate"))), which), F.lit("__unmatched__")).alias("raw_tag"))


@query(
    "fn_16_raw_tag_combos",
    """SELECT place_id, 'brand=' || brand || '&kind=' || k AS raw_tag FROM (SELECT place_id, brand, unnest(CASE WHEN len(list_filter(string_split(kind, '; '), lambda x: x IN ('GEAR', 'PLATE', 'SMALL'))) = 0 THEN [kind] ELSE list_filter(string_split(kind, '; '), lambda x: x IN ('GEAR', 'PLATE', 'SMALL')) END) AS k FROM places)""",
)
def fn_16(v):
    return v.places.select("place_id", F.explode(P.raw_tags(F.col("tags"), {"kind": ["GEAR", "PLATE", "SMALL"], "brand": True})).alias("raw_tag"))


@query("fn_12_source_key", "SELECT s_suppkey AS poi_id, '{\"id\":' || s_suppkey || ',\"name\":\"' || s_name || '\"}' AS source_key, s_suppkey AS parsed FROM supplier")
def fn_12(v):
    keyed = v.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).withColumn("source_key", P.source_key(["name", "id"]))
    return keyed.select(F.col("id").alias("poi_id"), "source_key", F.get_json_object("source_key", "$.id").cast("long").alias("parsed"))


@query("jn_30_tag_resolution", "SELECT place_id, CASE WHEN brand LIKE 'brand_1%' THEN 'exact' WHEN brand LIKE 'brand_2%' THEN 'wild' END AS resolved FROM places")
def jn_30(v):
    """Exact tags first, then the tag's wildcard; the first row of the configuration wins."""
    keys = v.places.select("place_id", F.col("tags")["brand"].alias("tag"), F.substring(F.col("tags")["brand"], 1, 7).alias("head"))
    brands = keys.select("tag").distinct()
    exact = brands.where("tag like 'brand_1%'").select("tag", F.lit("exact").alias("t"), F.lit(1).alias("row")).union(brands.where("tag like 'brand_1%'").select("tag", F.lit("later"), F.lit(2)))
    exact = exact.groupBy("tag").agg(F.min_by("t", "row").alias("e"))
    wild = v.spark.createDataFrame([("brand_2", "wild")], "head string, w string")
    return keys.join(F.broadcast(exact), "tag", "left").join(F.broadcast(wild), "head", "left").select("place_id", F.coalesce("e", "w").alias("resolved"))


@query("fn_20_utility", "SELECT poi_id, CASE WHEN poi_id IN (3, 7) THEN 1.0::DOUBLE WHEN poi_type IN ('t0', 't2') THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS utility FROM pois")
def fn_20(v):
    student = Profile("student", affordability=0.4, paid_types=("t0", "t2"), canteens=(3, 7))
    return v.pois.select("poi_id", student.utility("poi_id", "poi_type").alias("utility"))


@query("fn_26_type_codes", "SELECT p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN 'F1' WHEN p_type = 'ECONOMY' THEN 'F2' ELSE coalesce(nullif(p_brand, 'Brand#11'), 'F0') END AS code FROM part")
def fn_26(v):
    code = F.when(F.col("p_type") == "PROMO", F.lit("F1")).when(F.col("p_type") == "ECONOMY", F.lit("F2")).otherwise(F.coalesce(F.nullif("p_brand", F.lit("Brand#11")), F.lit("F0")))
    return v.table("part").select(F.col("p_partkey").alias("id"), code.alias("code"))


@query("agg_12_distinct_snaps", "SELECT k, min(d) AS dist FROM (SELECT (l_partkey % 100) AS k, l_quantity AS d FROM lineitem) GROUP BY k")
def agg_12(v):
    rows = v.table("lineitem").select((F.col("l_partkey") % 100).alias("k"), F.col("l_quantity").alias("d"))
    return rows.groupBy("k").agg(F.min("d").alias("dist"))


@query("win_08_first_claim", "SELECT zone, min(node_id) AS node_id FROM origins GROUP BY zone")
def win_08(v):
    return v.origins.withColumn("r", F.row_number().over(Window.partitionBy("zone").orderBy("node_id"))).where("r = 1").select("zone", "node_id")
