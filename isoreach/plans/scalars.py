"""Scalar functions."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from isoreach.functions import geo, text
from isoreach.operators import decay, gtfs
from isoreach.operators import multicriteria as M
from isoreach.plans.joins import hav_sql
from isoreach.plans.registry import query
from isoreach.sinks.tables import quantised

_K = f"(power(sin(radians(plat - 39.22::DOUBLE) / 2), 2) + cos(radians(39.22::DOUBLE)) * cos(radians(plat)) * power(sin(radians(plon - 9.1::DOUBLE) / 2), 2))"


@query("fn_01_haversine_m", f"SELECT poi_id, round({hav_sql('39.22::DOUBLE', '9.1::DOUBLE', 'plat', 'plon')}, 6) AS m FROM pois")
def fn_01(v):
    return v.pois.select("poi_id", F.round(geo.haversine_m(F.lit(39.22), F.lit(9.1), F.col("plat"), F.col("plon")), 6).alias("m"))


@query("fn_02_haversine_km", f"SELECT poi_id, round(2 * 6371.0088::DOUBLE * asin(sqrt({_K})), 6) AS km FROM pois")
def fn_02(v):
    return v.pois.select("poi_id", F.round(geo.haversine_km(F.lit(39.22), F.lit(9.1), F.col("plat"), F.col("plon")), 6).alias("km"))


@query("fn_04_radius", "SELECT n_nationkey AS k, round(-ln(0.5::DOUBLE) / (ln(2) / (10.0::DOUBLE + n_nationkey)) * 20.0::DOUBLE * 1000 / 60, 6) AS radius_m FROM nation")
def fn_04(v):
    return v.table("nation").select(F.col("n_nationkey").alias("k"), F.round(decay.reach_m(10.0 + F.col("n_nationkey"), 0.5, 20.0), 6).alias("radius_m"))


@query("fn_06_transit_cost", "SELECT from_id, round(sum(greatest(0.0::DOUBLE, access_time + wait_time + ((60 - 0.2::DOUBLE * 2.5::DOUBLE) / 60) * ride_time + transfer_time + egress_time + 0.2::DOUBLE * 2.5::DOUBLE)), 4) AS cost FROM od WHERE routes <> '[WALK]' GROUP BY from_id")
def fn_06(v):
    cost = decay.transit_impedance(*(F.col(c) for c in ("access_time", "wait_time", "ride_time", "transfer_time", "egress_time", "routes")), ticket=decay.TICKETS["rail"])
    return v.od.withColumn("c", cost).where("c > 0").groupBy("from_id").agg(F.round(F.sum("c"), 4).alias("cost"))


@query("fn_07_projection", "SELECT node_id, round(lon * 111320.0::DOUBLE * cos(radians(39.22::DOUBLE)), 4) AS x, round(lat * 111320.0::DOUBLE, 4) AS y FROM origins")
def fn_07(v):
    x, y = geo.to_metres(F.col("lat"), F.col("lon"), F.lit(39.22))
    return v.origins.select("node_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("fn_08_hexagons", "SELECT id, printf('H%04d_%04d', c, w) AS hex_id, round(1.5::DOUBLE * r * c - r, 6) AS cx, round(-sqrt(3.0::DOUBLE) * r + CASE WHEN c % 2 = 0 THEN 0 ELSE sqrt(3.0::DOUBLE) * r / 2 END + w * sqrt(3.0::DOUBLE) * r, 6) AS cy, round(1.5::DOUBLE * r * c - r + r * cos(pi() / 3), 6) AS x1 FROM (SELECT c_custkey AS id, (c_custkey % 23)::INTEGER AS c, (c_custkey % 17)::INTEGER AS w, 500.0::DOUBLE / cos(pi() / 6) AS r FROM customer)")
def fn_08(v):
    col, row = (F.col("c_custkey") % 23).cast("int"), (F.col("c_custkey") % 17).cast("int")
    cx, cy = geo.hex_centre(col, row, F.lit(0.0), F.lit(0.0), 500.0)
    corner = F.get(geo.hex_vertices(cx, cy, geo.hex_steps(500.0)[0]), F.lit(1))
    return v.table("customer").select(F.col("c_custkey").alias("id"), geo.hex_id(col, row).alias("hex_id"), F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"), F.round(corner["x"], 6).alias("x1"))


@query("fn_09_shard_names", "SELECT id, CASE WHEN id % 2 = 0 THEN printf('s%04d_%04d', (id % 23)::INTEGER // 4, (id % 17)::INTEGER // 4) ELSE printf('sx%04d', ((((ascii('q') * 31 + 48 + id // 100 % 10) % 4096 * 31 + 48 + id // 10 % 10) % 4096 * 31 + 48 + id % 10) % 4096)::INTEGER) END AS shard FROM (SELECT c_custkey AS id FROM customer)")
def fn_09(v):
    k = F.col("c_custkey")
    grid = geo.hex_id((k % 23).cast("int"), (k % 17).cast("int"))
    other = F.concat(F.lit("q"), F.lpad((k % 1000).cast("string"), 3, "0"))
    return v.table("customer").select(k.alias("id"), geo.shard_of(F.when(k % 2 == 0, grid).otherwise(other)).alias("shard"))


@query("fn_10_quantise", "SELECT hex_id, CASE WHEN round_even(x * 10000, 0) > 0 THEN round_even(x * 10000, 0)::INTEGER END AS q, round(coalesce(CASE WHEN round_even(x * 10000, 0) > 0 THEN round_even(x * 10000, 0) END, 0) / 10000, 6) AS back FROM (SELECT hex_id, a - 0.3::DOUBLE AS x FROM (SELECT hex_id, round(a, 3) AS a FROM scores))")
def fn_10(v):
    q = quantised(F.round("a", 3) - 0.3)
    return v.scores.select("hex_id", q.alias("q"), F.round(F.coalesce(q, F.lit(0)) / 10000, 6).alias("back"))


@query("fn_11_coordinate_key", "SELECT node_id, printf('%.6f', lat) || ',' || printf('%.6f', lon) AS key FROM origins")
def fn_11(v):
    return v.origins.select("node_id", geo.coord_key(F.col("lat"), F.col("lon")).alias("key"))


@query("fn_13_signature", "SELECT zone, sha1(string_agg(node_id::VARCHAR, ';' ORDER BY node_id::VARCHAR)) AS sig FROM origins GROUP BY zone".replace("sha1(", "sha1("))
def fn_13(v):
    ids = F.sort_array(F.collect_list(F.col("node_id").cast("string")))
    return v.origins.groupBy("zone").agg(F.sha1(F.concat_ws(";", ids).cast("binary")).alias("sig"))


@query("fn_14_slug", "SELECT n_nationkey AS id, regexp_replace(regexp_replace(lower(strip_accents('Città ' || n_name || ' (é)')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM nation")
def fn_14(v):
    return v.table("nation").select(F.col("n_nationkey").alias("id"), text.slug(F.concat(F.lit("Città "), F.col("n_name"), F.lit(" (é)"))).alias("slug"))


@query("fn_15_parsed_cells", "SELECT n_nationkey AS id, n_nationkey + 1 AS first, 2 AS n FROM nation")
def fn_15(v):
    from isoreach.sources.config import list_literal

    cell = F.concat(F.lit("['"), (F.col("n_nationkey") + 1).cast("string"), F.lit("', 'x']"))
    parsed = list_literal(cell, "string")
    return v.table("nation").select(F.col("n_nationkey").alias("id"), F.get(parsed, F.lit(0)).cast("int").alias("first"), F.size(parsed).alias("n"))


@query("fn_17_address", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'zone ' || s_nationkey END AS address, printf('%.4f N %.4f E', plat, plon) AS angular FROM supplier JOIN pois ON poi_id = s_suppkey")
def fn_17(v):
    s = v.pois.join(v.table("supplier").select(F.col("s_suppkey").alias("poi_id"), "s_name", "s_nationkey"), "poi_id")
    street = F.when(F.col("poi_id") % 3 == 0, F.col("s_name")).otherwise(F.lit("  "))
    return s.select(F.col("poi_id").alias("id"), text.first_text(street, F.concat(F.lit("zone "), F.col("s_nationkey").cast("string"))).alias("address"), F.format_string("%.4f N %.4f E", "plat", "plon").alias("angular"))


_LV = "(1 + CASE WHEN a >= 0.35 THEN 1 ELSE 0 END + CASE WHEN a >= 0.51 THEN 1 ELSE 0 END + CASE WHEN a >= 0.66 THEN 1 ELSE 0 END + CASE WHEN a >= 0.8 THEN 1 ELSE 0 END)"


@query("fn_18_class_level", f"SELECT hex_id, {_LV} AS level FROM scores")
def fn_18(v):
    return v.scores.select("hex_id", text.class_level(F.col("a"), M.BOUNDS).alias("level"))


@query("fn_19_constant_rows", f"SELECT hex_id, {_LV} - 1 AS cls, [0.175::DOUBLE, 0.43::DOUBLE, 0.585::DOUBLE, 0.73::DOUBLE, 0.9::DOUBLE][{_LV}] AS score FROM scores")
def fn_19(v):
    xs = [F.col("a")] * 3
    cls = M.outrank_class(xs, [1.0, 2.0, 3.0])
    return v.scores.select("hex_id", cls.alias("cls"), M.class_score(cls).alias("score"))


@query("fn_21_timetable_time", "SELECT trip_id, printf('%02d:%02d:%02d', dep_sec // 3600, dep_sec % 3600 // 60, dep_sec % 60) AS hms, dep_sec AS back FROM departures")
def fn_21(v):
    return v.departures.select("trip_id", text.hms_of(F.col("dep_sec")).alias("hms")).withColumn("back", text.seconds_of(F.col("hms")))


@query("fn_22_mortgage", "SELECT p_partkey AS id, round(r * power(1 + r, 240) / (power(1 + r, 240) - 1), 8) AS factor, 1234.5::DOUBLE AS price, round(700.0::DOUBLE / (p_size + 1), 6) AS surface FROM (SELECT p_partkey, p_size, (1 + p_size % 5) / 1200.0::DOUBLE AS r FROM part)")
def fn_22(v):
    r = (1 + F.col("p_size") % 5) / 1200.0
    g = F.pow(1 + r, F.lit(240))
    return v.table("part").select(F.col("p_partkey").alias("id"), F.round(r * g / (g - 1), 8).alias("factor"), text.decimal_comma(F.lit(" 1.234,50 ")).alias("price"), F.round((1200.0 - M.HOUSING_RESIDUAL) / (F.col("p_size") + 1), 6).alias("surface"))


@query("fn_23_vertices", "SELECT zone_id, 4 AS n, round((south + north) / 2, 6) AS lat, round((west + east) / 2, 6) AS lon FROM zones")
def fn_23(v):
    ring = F.array(*(F.array(x, y) for x, y in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"))))
    parts = F.flatten(F.array(ring))  # the parts of a multi-geometry in one list
    mean = lambda i: F.aggregate(parts, F.lit(0.0), lambda a, p: a + p[i]) / F.size(parts)
    return v.zones.select("zone_id", F.size(parts).alias("n"), F.round(mean(1), 6).alias("lat"), F.round(mean(0), 6).alias("lon"))


@query("fn_24_line_samples", "SELECT id, (ceil(len / 500.0::DOUBLE) + 1)::INTEGER AS n FROM (SELECT p_partkey AS id, 100.0::DOUBLE + p_size * 77 + 250 AS len FROM part)")
def fn_24(v):
    leg = 100.0 + F.col("p_size") * 77
    line = F.array(*(F.struct(F.lit(x).cast("double").alias("x") if not hasattr(x, "cast") else x.alias("x"), F.lit(y).cast("double").alias("y")) for x, y in ((0.0, 0.0), (leg, 0.0), (leg, 250.0))))
    return v.table("part").select(F.col("p_partkey").alias("id"), F.size(geo.line_samples(line, 500.0)).alias("n"))


@query("fn_25_edge_segments", "SELECT u, v, k, round(length_m * k / n, 6) AS at FROM (SELECT u, v, length_m, n, unnest(range(0, n)) AS k FROM (SELECT u, v, min(length_m) AS length_m, greatest(1, ceil(min(length_m) / 250)::BIGINT) AS n FROM edges GROUP BY u, v))")
def fn_25(v):
    from isoreach.operators.graph import shortest_edges

    n = F.greatest(F.lit(1), F.ceil(F.col("length_m") / 250).cast("long"))
    e = shortest_edges(v.edges).withColumn("n", n)
    return e.select("u", "v", "length_m", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")).select("u", "v", "k", F.round(F.col("length_m") * F.col("k") / F.col("n"), 6).alias("at"))


@query("fn_27_ticket_price", "SELECT r_regionkey AS id, CASE r_regionkey % 3 WHEN 0 THEN 1.3::DOUBLE WHEN 1 THEN 1.3::DOUBLE ELSE 2.5::DOUBLE END AS ticket FROM region")
def fn_27(v):
    kind = F.element_at(F.array(F.lit("bus"), F.lit("tram"), F.lit("rail")), (F.col("r_regionkey") % 3).cast("int") + 1)
    price = F.when(F.lit(False), F.lit(0.0))
    for k, t in decay.TICKETS.items():
        price = price.when(kind == k, F.lit(t))
    return v.table("region").select(F.col("r_regionkey").alias("id"), price.alias("ticket"))


@query("fn_28_mutations", "SELECT node_id, round(0.8::DOUBLE * x1 / (0.8::DOUBLE * x1 + 0.8::DOUBLE * x2 + 0.8::DOUBLE * x3), 6) AS w1, round(least(x2, 0.5::DOUBLE), 6) AS capped, round((x3 + 1.0::DOUBLE / 3) / 2, 6) AS blended FROM criteria WHERE x1 + x2 + x3 > 0")
def fn_28(v):
    scaled = F.transform(F.array("x1", "x2", "x3"), lambda x: 0.8 * x)
    total = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x)
    return v.criteria.where("x1 + x2 + x3 > 0").select("node_id", F.round(F.get(F.transform(scaled, lambda x: x / total), F.lit(0)), 6).alias("w1"), F.round(F.least("x2", F.lit(0.5)), 6).alias("capped"), F.round((F.col("x3") + 1.0 / 3) / 2, 6).alias("blended"))


@query("fn_29_metre_block", "SELECT hex_id, floor(lon * 111320.0::DOUBLE * cos(radians(39.22::DOUBLE)) / 500)::BIGINT || '_' || floor(lat * 111320.0::DOUBLE / 500)::BIGINT AS block FROM scores")
def fn_29(v):
    x, y = geo.to_metres(F.col("lat"), F.col("lon"), F.lit(39.22))
    return v.scores.select("hex_id", geo.metre_block(x, y, 500.0).alias("block"))


@query("win_04_hop_minutes", f"SELECT poi_type, poi_id, sum(hop) OVER (PARTITION BY poi_type ORDER BY poi_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cum_min FROM (SELECT poi_type, poi_id, CASE WHEN py IS NULL THEN 0 ELSE greatest(1, round_even(2 * 6371.0088::DOUBLE * asin(sqrt(power(sin(radians(plat - py) / 2), 2) + cos(radians(py)) * cos(radians(plat)) * power(sin(radians(plon - px) / 2), 2))) / 25 * 60, 0)::INTEGER) END AS hop FROM (SELECT *, lag(plat) OVER (PARTITION BY poi_type ORDER BY poi_id) AS py, lag(plon) OVER (PARTITION BY poi_type ORDER BY poi_id) AS px FROM pois))")
def win_04_hops(v):
    return gtfs.hop_minutes(v.pois, "poi_id", "plat", "plon", 25.0, "poi_type").select("poi_type", "poi_id", "cum_min")


@query("win_07_extended_trips", "SELECT trip_id, count(*) + 2 AS n, max(dep) AS last_departure FROM (SELECT trip_id, dep_sec + 600 AS dep FROM departures) GROUP BY trip_id")
def win_07_trips(v):
    t = text.hms_of(F.col("dep_sec"))
    times = v.departures.select("trip_id", F.col("stop_id").cast("string").alias("stop_id"), t.alias("arrival_time"), t.alias("departure_time"), F.lit(1).alias("stop_sequence"))
    new = v.spark.createDataFrame([("N1", 4), ("N2", 10)], "stop_id string, cum_min int")
    out = gtfs.extended_trips(times, new, at_start=False)
    return out.groupBy("trip_id").agg(F.max("stop_sequence").cast("long").alias("n"), text.seconds_of(F.max_by("departure_time", "stop_sequence")).alias("last_departure"))


@query("fn_31_clean_names", "SELECT n_nationkey AS id, regexp_replace(n_name, '[^A-Za-z0-9_]', '_', 'g')[1:10] AS short FROM nation")
def fn_31(v):
    from isoreach.sinks.tables import column_names

    named = v.table("nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # a name for each column, a fixed few
    short = column_names([r.n_name for r in named], 10)
    return v.spark.createDataFrame([(r.n_nationkey, short[r.n_name]) for r in named], "id int, short string")


@query("it_10_recomputed_access", "SELECT node_id, poi_type, round(access, 6) AS access, round(access, 6) AS again FROM type_access")
def it_10(v):
    """The saturated sum by sorted arrays and the same sum by ranks of a window, side by side."""
    from isoreach.plans.capability import CONTRIBUTION, by_type, type_access, unions

    rate = by_type({k: decay.saturation_rate(c) for k, c in CONTRIBUTION.items()})
    r = F.row_number().over(Window.partitionBy("node_id", "poi_type").orderBy(F.desc("rra")))
    ranked = unions(v).withColumn("r", r).withColumn("c", rate)
    again = ranked.groupBy("node_id", "poi_type").agg(F.sum(F.col("rra") * (F.exp(F.col("c") * (F.col("r") - 1)) - F.exp(F.col("c") * F.col("r")))).alias("again"))
    both = type_access(v).join(again, ["node_id", "poi_type"], "full_outer")
    return both.select("node_id", "poi_type", F.round("access", 6).alias("access"), F.round("again", 6).alias("again"))





@query("scenario_strike", "SELECT node_id, poi_id, round(CASE WHEN bus <= 0 THEN 0.0::DOUBLE ELSE exp(-ln(2) / 20 * 1e10::DOUBLE) END, 6) AS d FROM modal")
def scenario_strike(v):
    from isoreach.operators.scenarios import Strike
    from isoreach.plans.capability import by_both, each

    return each(Strike().transit(by_both(v), "bus").select("node_id", "poi_id", "node_ids", "ids", F.round(decay.decay(F.col("bus"), 20.0, transit=True), 6).alias("d")))


@query("scenario_neighbourhood_loss", "SELECT node_id, count(*) AS n FROM modal WHERE NOT (plat > 39.2::DOUBLE AND plat < 39.24::DOUBLE AND plon > 9.08::DOUBLE AND plon < 9.14::DOUBLE AND poi_type = 't1') GROUP BY node_id")
def scenario_loss(v):
    from isoreach.operators.scenarios import NeighbourhoodLoss
    from isoreach.plans.capability import for_origins

    ring = [(9.08, 39.2), (9.14, 39.2), (9.14, 39.24), (9.08, 39.24)]
    drop = NeighbourhoodLoss(ring, ["t1"]).drops(v.pois, "poi_id", "poi_type", "plon", "plat")
    kept = v.pois.join(drop, ["poi_id", "poi_type"], "left_anti")
    return for_origins(v, lambda pairs: pairs.groupBy("node_id").agg(F.sum("n").alias("n")), kept)




@query("fn_32_shades", "SELECT hex_id, printf('#%02X%02X%02X', round_even(255 - a * (255 - 21), 0)::INTEGER, round_even(255 - a * (255 - 187), 0)::INTEGER, round_even(255 - a * (255 - 126), 0)::INTEGER) AS shade FROM (SELECT hex_id, a FROM scores)")
def fn_32(v):
    return v.scores.select("hex_id", text.shade(F.col("a"), (21, 187, 126)).alias("shade"))


@query("fn_33_bitmaps", "SELECT zone, count(DISTINCT node_id) AS n FROM origins GROUP BY zone")
def fn_33(v):
    """Kept places of a zone as bitmaps of 32,768 places each; their bits are the places."""
    words = v.origins.groupBy("zone", F.bitmap_bucket_number("node_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("node_id")).alias("bits"))
    return words.groupBy("zone").agg(F.sum(F.bitmap_count("bits")).alias("n"))


@query("it_07_default_walkability", "SELECT u, v, min(length_m) AS length_m, 5.0::DOUBLE AS wscore, round((min(length_m) / 1000) / 5.0::DOUBLE * 60, 6) AS minutes FROM edges GROUP BY u, v")
def it_07(v):
    from isoreach.operators.graph import shortest_edges

    e = shortest_edges(v.edges).withColumn("wscore", F.lit(5.0))
    return e.withColumn("minutes", F.round(decay.impedance("walk", F.col("length_m") / 1000, F.lit(0.0), F.lit(0.0), F.col("wscore")), 6))
