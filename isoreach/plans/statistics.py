"""Aggregates, windows, classes, scaling, tests and sensitivity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from isoreach.functions import geo, text
from isoreach.operators import multicriteria as M
from isoreach.operators import scaling, significance
from isoreach.plans.registry import query

XS = ["x1", "x2", "x3", "x4", "x5"]
W = [0.2] * 5


def cred_sql(b: str, q: str = "0.02::DOUBLE", p: str = "0.06::DOUBLE") -> str:
    one = "CASE WHEN {x} - {b} >= -{q} THEN 1.0::DOUBLE WHEN {x} - {b} > -{p} THEN ({x} - {b} + {p}) / ({p} - {q}) ELSE 0.0::DOUBLE END"
    return "((" + " + ".join("0.2::DOUBLE * " + one.format(x=x, b=b, q=q, p=p) for x in XS) + ") / (0.2::DOUBLE + 0.2::DOUBLE + 0.2::DOUBLE + 0.2::DOUBLE + 0.2::DOUBLE))"


_CREDS = [cred_sql(f"{b}::DOUBLE") for b in M.BOUNDS]
CLASS_SQL = f"CASE WHEN {_CREDS[3]} >= 0.75 - 1e-12 THEN 4 WHEN {_CREDS[2]} >= 0.75 - 1e-12 THEN 3 WHEN {_CREDS[1]} >= 0.75 - 1e-12 THEN 2 WHEN {_CREDS[0]} >= 0.75 - 1e-12 THEN 1 ELSE 0 END"
_LEAN = M.CUT - 1e-12


def cols():
    return [F.col(x) for x in XS]


@query("agg_01_best_itinerary", "SELECT from_id, to_id, count(*) AS n, round(min(access_time + wait_time + ride_time + transfer_time + egress_time), 6) AS total_time, first(departure ORDER BY round(access_time + wait_time + ride_time + transfer_time + egress_time, 9), draw, departure) AS departure FROM od GROUP BY from_id, to_id")
def agg_01(v):
    total = F.col("access_time") + F.col("wait_time") + F.col("ride_time") + F.col("transfer_time") + F.col("egress_time")
    return v.od.withColumn("t", total).groupBy("from_id", "to_id").agg(F.count("*").alias("n"), F.round(F.min("t"), 6).alias("total_time"), F.min_by("departure", F.struct(F.round("t", 9), "draw", "departure")).alias("departure"))


@query("agg_07_choquet_max", "SELECT node_id, round(sum((x - prev) * top), 6) AS score FROM (SELECT node_id, x, lag(x, 1, 0.0::DOUBLE) OVER w AS prev, max(v) OVER (PARTITION BY node_id ORDER BY x, v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS top FROM (SELECT node_id, unnest([x1, x2, x3]) AS x, unnest([0.9::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE]) AS v FROM criteria) WINDOW w AS (PARTITION BY node_id ORDER BY x, v)) GROUP BY node_id")
def agg_07(v):
    return v.criteria.select("node_id", F.round(M.choquet_max(cols()[:3], [0.9, 0.5, 0.7]), 6).alias("score"))


@query("agg_08_electre_tri", f"SELECT node_id, {CLASS_SQL} AS cls FROM criteria")
def agg_08(v):
    return v.criteria.select("node_id", M.outrank_class(cols(), W, cut=_LEAN).alias("cls"))


@query("agg_09_electre_continuous", f"SELECT node_id, round(({' + '.join(_CREDS)}) / 4, 6) AS score FROM criteria")
def agg_09(v):
    return v.criteria.select("node_id", F.round(M.mean_credibility(cols(), W), 6).alias("score"))


GRID = [(0.01, 0.05, 0.7), (0.02, 0.06, 0.75), (0.03, 0.09, 0.8)]
_GRID_SQL = " UNION ALL ".join(f"SELECT {i} AS params_id, {q}::DOUBLE AS q, {p}::DOUBLE AS p, {c}::DOUBLE AS cut" for i, (q, p, c) in enumerate(GRID))
_GRID_CLASS = "CASE " + " ".join(f"WHEN {cred_sql(f'{M.BOUNDS[k]}::DOUBLE', 'q', 'p')} >= cut - 1e-12 THEN {k + 1}" for k in (3, 2, 1, 0)) + " ELSE 0 END"


@query("agg_10_electre_parameters", f"SELECT params_id, {_GRID_CLASS} AS cls, count(*) AS n FROM criteria, ({_GRID_SQL}) GROUP BY 1, 2")
def agg_10(v):
    params = v.spark.createDataFrame([(i, *g) for i, g in enumerate(GRID)], "params_id int, q double, p double, cut double")
    rows = v.criteria.join(F.broadcast(params), F.lit(True))  # a few settings
    return rows.select("params_id", M.outrank_class(cols(), W, q=F.col("q"), p=F.col("p"), cut=F.col("cut") - 1e-12, constant=False).alias("cls")).groupBy("params_id", "cls").agg(F.count("*").alias("n"))


@query(
    "agg_11_housing",
    """SELECT id, round(rent, 6) AS rent, round(buy, 6) AS buy, 'Q' || (1 + greatest(0, CASE WHEN c20 >= 0.75 THEN 1 ELSE 0 END, CASE WHEN c28 >= 0.75 THEN 2 ELSE 0 END, CASE WHEN c42 >= 0.75 THEN 3 ELSE 0 END, CASE WHEN c56 >= 0.75 THEN 4 ELSE 0 END)) AS category FROM (SELECT *,
    (least(1, greatest(0, (rent - 20 + 6) / 4)) + least(1, greatest(0, (buy - 20 + 6) / 4))) / 2 AS c20, (least(1, greatest(0, (rent - 28 + 6) / 4)) + least(1, greatest(0, (buy - 28 + 6) / 4))) / 2 AS c28,
    (least(1, greatest(0, (rent - 42 + 6) / 4)) + least(1, greatest(0, (buy - 42 + 6) / 4))) / 2 AS c42, (least(1, greatest(0, (rent - 56 + 6) / 4)) + least(1, greatest(0, (buy - 56 + 6) / 4))) / 2 AS c56
    FROM (SELECT p_partkey AS id, 700.0::DOUBLE / (10 + p_size % 30 + 0.3::DOUBLE) AS rent, 700.0::DOUBLE / (12 + p_partkey % 25 + 0.7::DOUBLE) AS buy FROM part))""",
)
def agg_11(v):
    p = v.table("part").select(F.col("p_partkey").alias("id"), (F.lit(700.0) / (10 + F.col("p_size") % 30 + 0.3)).alias("rent"), (F.lit(700.0) / (12 + F.col("p_partkey") % 25 + 0.7)).alias("buy"))
    cls = M.outrank_class([F.col("rent"), F.col("buy")], [0.5, 0.5], M.HOUSING_BOUNDS, M.HOUSING_Q, M.HOUSING_P, constant=False)
    return p.select("id", F.round("rent", 6).alias("rent"), F.round("buy", 6).alias("buy"), F.element_at(F.array(*map(F.lit, M.HOUSING_CLASSES)), cls + 1).alias("category"))


@query("agg_18_record_collapse", "SELECT p_brand AS key, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, last(p_retailprice ORDER BY p_partkey) AS last_price, first(nullif(p_name, 'x') ORDER BY p_partkey) AS first_name FROM part GROUP BY p_brand")
def agg_18(v):
    return v.table("part").groupBy(F.col("p_brand").alias("key")).agg(
        F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("types"), F.max_by("p_retailprice", "p_partkey").alias("last_price"),
        F.min_by(F.col("p_name"), F.when(F.col("p_name") != "x", F.col("p_partkey"))).alias("first_name"),
    )


@query("agg_20_recap", "SELECT cap, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, count(*) FILTER (a = 0) AS zeros FROM scores GROUP BY cap")
def agg_20(v):
    return v.scores.groupBy("cap").agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.count_if(F.col("a") == 0).alias("zeros"))


_LV = "(1 + CASE WHEN {x} >= 0.35 THEN 1 ELSE 0 END + CASE WHEN {x} >= 0.51 THEN 1 ELSE 0 END + CASE WHEN {x} >= 0.66 THEN 1 ELSE 0 END + CASE WHEN {x} >= 0.8 THEN 1 ELSE 0 END)"


@query("agg_21_changes", f"SELECT cap, round(100.0::DOUBLE * avg(CASE WHEN {_LV.format(x='a')} <> {_LV.format(x='b')} THEN 1.0::DOUBLE ELSE 0 END), 6) AS pct_changed, round(avg(abs(b - a)), 6) AS mean_abs FROM scores GROUP BY cap")
def agg_21(v):
    changed = text.class_level(F.col("a"), M.BOUNDS) != text.class_level(F.col("b"), M.BOUNDS)
    return v.scores.groupBy("cap").agg(F.round(100 * F.avg(changed.cast("double")), 6).alias("pct_changed"), F.round(F.avg(F.abs(F.col("b") - F.col("a"))), 6).alias("mean_abs"))


_NOISE = "((((hex_id * 31 + rep * 17) % 101) - 50)::DOUBLE / 1000.0::DOUBLE)"


@query("agg_22_noise_stability", f"SELECT hex_id, cls AS modal, round(n::DOUBLE / 20, 6) AS stability FROM (SELECT hex_id, cls, count(*) AS n, row_number() OVER (PARTITION BY hex_id ORDER BY count(*) DESC, cls) AS r FROM (SELECT hex_id, {_LV.format(x='x')} AS cls FROM (SELECT hex_id, a + {_NOISE} AS x FROM scores, (SELECT unnest(range(0, 20)) AS rep))) GROUP BY hex_id, cls) WHERE r = 1")
def agg_22(v):
    """Draws by a hash of cell and repetition; the repetitions of a cell stay in its row, so nothing is multiplied or shuffled."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda rep: text.class_level(F.col("a") + ((F.col("hex_id") * 31 + rep * 17) % 101 - 50) / 1000.0, M.BOUNDS))
    counted = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.struct((-F.size(F.filter("draws", lambda d: d == k))).alias("n"), k.alias("cls")))
    best = v.scores.withColumn("draws", draws).withColumn("best", F.array_min(counted))
    return best.select("hex_id", F.col("best.cls").alias("modal"), F.round(-F.col("best.n") / 20.0, 6).alias("stability"))


@query("agg_23_verdicts", "SELECT zone, round(max(d), 6) AS worst, round(avg(d), 6) AS mean, first(hex_id ORDER BY d DESC, hex_id) AS at, CASE WHEN max(d) >= 20 THEN 'sensitive' WHEN max(d) >= 5 THEN 'moderate' ELSE 'robust' END AS verdict FROM (SELECT hex_id, hex_id % 37 AS zone, round(abs(b - a) * 100, 9) AS d FROM scores) GROUP BY zone")
def agg_23(v):
    rows = v.scores.select("hex_id", (F.col("hex_id") % 37).alias("zone"), F.round(F.abs(F.col("b") - F.col("a")) * 100, 9).alias("d"))
    verdict = F.when(F.max("d") >= 20, F.lit("sensitive")).when(F.max("d") >= 5, F.lit("moderate")).otherwise(F.lit("robust"))
    return rows.groupBy("zone").agg(F.round(F.max("d"), 6).alias("worst"), F.round(F.avg("d"), 6).alias("mean"), F.min_by("hex_id", F.struct(-F.col("d"), "hex_id")).alias("at"), verdict.alias("verdict"))


@query(
    "agg_24_bootstrap_ci",
    """WITH d AS (SELECT cap, b - a AS x, row_number() OVER (PARTITION BY cap ORDER BY hex_id) - 1 AS i, count(*) OVER (PARTITION BY cap) AS n FROM scores),
    draws AS (SELECT d.cap, rep, x FROM (SELECT DISTINCT cap, n FROM d) g, (SELECT unnest(range(0, 40)) AS rep), LATERAL (SELECT unnest(range(0, n)) AS j) j JOIN d ON d.cap = g.cap AND d.i = ('0x' || md5(rep || ':' || j.j)[1:12])::BIGINT % g.n),
    m AS (SELECT cap, rep, median(x) AS med FROM draws GROUP BY cap, rep) SELECT cap, round(quantile_cont(med, 0.025), 4) AS lo, round(quantile_cont(med, 0.975), 4) AS hi FROM m GROUP BY cap""",
)
def agg_24(v):
    return significance.bootstrap_median(v.scores.select("cap", "hex_id", (F.col("b") - F.col("a")).alias("x")), "cap", "hex_id", "x", reps=40).select("cap", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query(
    "agg_25_signed_rank",
    """WITH d AS (SELECT cap, round(b - a, 9) AS x FROM scores WHERE round(b - a, 9) <> 0), r AS (SELECT *, rank() OVER (PARTITION BY cap ORDER BY abs(x)) + (count(*) OVER (PARTITION BY cap, abs(x)) - 1) / 2.0::DOUBLE AS rk FROM d)
    SELECT cap, count(*) AS n, round(sum(rk * sign(x)), 6) AS w, round(sum(CASE WHEN x > 0 THEN rk ELSE 0 END), 6) AS w_plus FROM r GROUP BY cap""",
)
def agg_25(v):
    return significance.signed_rank(v.scores.select("cap", F.round(F.col("b") - F.col("a"), 9).alias("x")), "cap", "x").select("cap", "n", F.round("w", 6).alias("w"), F.round("w_plus", 6).alias("w_plus"))


@query(
    "agg_25_block_permutation",
    """WITH d AS (SELECT cap, round(b - a, 9) AS x, floor(lon * 111320.0::DOUBLE * cos(radians(39.22::DOUBLE)) / 500)::BIGINT * 100000 + floor(lat * 111320.0::DOUBLE / 500)::BIGINT AS block FROM scores WHERE round(b - a, 9) <> 0),
    r AS (SELECT *, (rank() OVER (PARTITION BY cap ORDER BY abs(x)) + (count(*) OVER (PARTITION BY cap, abs(x)) - 1) / 2.0::DOUBLE) * sign(x) AS s FROM d), wb AS (SELECT cap, block, sum(s) AS s FROM r GROUP BY cap, block),
    p AS (SELECT cap, rep, sum(s * CASE WHEN md5(block || ':' || rep)[1:1] < '8' THEN 1 ELSE -1 END) AS w FROM wb, (SELECT unnest(range(0, 99)) AS rep) GROUP BY cap, rep),
    o AS (SELECT cap, sum(s) AS w0, count(*) AS n_blocks FROM wb GROUP BY cap) SELECT o.cap, o.n_blocks, round((1.0::DOUBLE + count(*) FILTER (abs(p.w) >= abs(o.w0) - 1e-6)) / 100, 6) AS p_value FROM o JOIN p ON p.cap = o.cap GROUP BY o.cap, o.n_blocks""",
)
def agg_25_block(v):
    x, y = geo.to_metres(F.col("lat"), F.col("lon"), F.lit(39.22))
    block = F.floor(x / 500) * 100000 + F.floor(y / 500)
    return significance.block_permutation(v.scores.select("cap", F.round(F.col("b") - F.col("a"), 9).alias("x"), block.alias("block")), "cap", "x", "block", reps=99).select("cap", "n_blocks", F.round("p_value", 6).alias("p_value"))


@query("agg_26_benjamini_hochberg", "WITH p AS (SELECT s_suppkey AS id, ((s_suppkey * 37) % 1009)::DOUBLE / 1009 AS p FROM supplier), r AS (SELECT *, rank() OVER (ORDER BY p) AS rk, count(*) OVER () AS n FROM p) SELECT id, round(least(1.0::DOUBLE, min(p * n / rk) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r")
def agg_26(v):
    p = v.table("supplier").select(F.col("s_suppkey").alias("id"), (((F.col("s_suppkey") * 37) % 1009).cast("double") / 1009).alias("p"))
    return significance.benjamini_hochberg(p, "p").select("id", F.round("q", 6).alias("q"))


@query("agg_27_paired_t", "SELECT cap, count(*) AS n, round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 4) AS t, round(skewness(x), 4) AS skew FROM (SELECT cap, b - a AS x FROM scores) GROUP BY cap")
def agg_27(v):
    x = F.col("b") - F.col("a")
    n = F.count("*")
    pop = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)  # the sample skewness
    return v.scores.groupBy("cap").agg(n.alias("n"), F.round(F.avg(x) / (F.stddev_samp(x) / F.sqrt(n)), 4).alias("t"), F.round(pop, 4).alias("skew"))


@query("agg_28_natural_breaks")
def agg_28(v):
    return scaling.natural_breaks(v.scores.select(F.col("a").alias("x")), "x", 5)


@query("agg_29_summary", "SELECT cap, round(avg(a), 6) AS mean, round(median(a), 6) AS median, round(stddev_samp(a), 6) AS sd, round(min(a), 6) AS lo, round(max(a), 6) AS hi FROM scores GROUP BY cap")
def agg_29(v):
    return v.scores.groupBy("cap").agg(*(F.round(f, 6).alias(n) for n, f in (("mean", F.avg("a")), ("median", F.median("a")), ("sd", F.stddev_samp("a")), ("lo", F.min("a")), ("hi", F.max("a")))))


@query("agg_30_path_walkability", "SELECT u, round(sum(length_m * (1 + v % 5)) / sum(length_m), 6) AS w FROM edges GROUP BY u")
def agg_30(v):
    return v.edges.groupBy("u").agg(F.round(F.sum(F.col("length_m") * (1 + F.col("v") % 5)) / F.sum("length_m"), 6).alias("w"))


_Q = "SELECT l_suppkey % 7 AS key, round_even(l_discount * 10000, 0)::BIGINT AS q FROM lineitem WHERE l_discount > 0"


@query("agg_31_quantile_scaling", f"WITH h AS (SELECT key, q, count(*) AS n FROM ({_Q}) GROUP BY key, q) SELECT key, q, n, round_even(round(10000 * (sum(n) OVER w - n / 2.0::DOUBLE) / sum(n) OVER (PARTITION BY key), 6), 0)::BIGINT AS scaled FROM h WINDOW w AS (PARTITION BY key ORDER BY q ROWS UNBOUNDED PRECEDING)")
def agg_31(v):
    q = v.table("lineitem").where("l_discount > 0").select((F.col("l_suppkey") % 7).alias("key"), F.bround(F.col("l_discount") * 10000, 0).cast("long").alias("q"))
    return scaling.mid_rank(q, "key", "q")


@query("agg_31_report_bins", f"WITH x AS (SELECT key, q, min(q) OVER (PARTITION BY key) AS lo, max(q) OVER (PARTITION BY key) AS hi FROM ({_Q})) SELECT key, least(9, floor((q - lo) * 10.0::DOUBLE / greatest(1, hi - lo)))::INTEGER AS bin, count(*) AS n, min(q) AS least_q, max(q) AS most_q FROM x GROUP BY 1, 2")
def agg_31_bins(v):
    q = v.table("lineitem").where("l_discount > 0").select((F.col("l_suppkey") % 7).alias("key"), F.bround(F.col("l_discount") * 10000, 0).cast("long").alias("q"))
    return scaling.report_bins(q, "key", "q", 10)


_HEAD = "SELECT stop_id, dep_sec - lag(dep_sec) OVER (PARTITION BY stop_id ORDER BY dep_sec, trip_id) AS gap FROM departures"


@query("agg_32_headway_wait", f"SELECT stop_id, round(median(gap / 60.0::DOUBLE) / 2, 6) AS wait_min FROM ({_HEAD}) WHERE gap > 0 AND gap <= 10800 GROUP BY stop_id")
def agg_32(v):
    from isoreach.operators.gtfs import headways

    return headways(v.departures).groupBy("stop_id").agg(F.round(F.median(F.col("gap") / 60.0) / 2, 6).alias("wait_min"))


@query("win_03_lag", f"SELECT stop_id, count(*) AS n, sum(gap)::BIGINT AS total FROM ({_HEAD}) WHERE gap IS NOT NULL GROUP BY stop_id")
def win_03(v):
    gap = F.col("dep_sec") - F.lag("dep_sec").over(Window.partitionBy("stop_id").orderBy("dep_sec", "trip_id"))
    return v.departures.select("stop_id", gap.alias("gap")).where("gap is not null").groupBy("stop_id").agg(F.count("*").alias("n"), F.sum("gap").alias("total"))


@query("agg_33_weighted_neighbours", "SELECT node_id, round(sum(balance / greatest(25, dist_m)) / sum(1 / greatest(25, dist_m)), 4) AS wait FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY round(dist_m, 6), poi_id) AS r FROM hav_pairs) WHERE r <= 3 GROUP BY node_id")
def agg_33(v):
    from isoreach.operators import spatial

    near = spatial.nearest(v.origins.select("node_id", "lat", "lon"), v.pois.select("poi_id", "plat", "plon", "balance"), "node_id", ("lat", "lon"), ("plat", "plon"), "poi_id", k=4)
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("node_id").orderBy(F.round("dist_m", 6), "poi_id"))).where("r <= 3")
    w = 1 / F.greatest(F.lit(25.0), F.col("dist_m"))
    return ranked.groupBy("node_id").agg(F.round(F.sum(F.col("balance") * w) / F.sum(w), 4).alias("wait"))


@query("agg_34_best_option", "SELECT from_id, option, round(t, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY round(t, 6), option) AS r FROM (SELECT from_id, draw AS option, sum(ride_time + wait_time) AS t FROM od GROUP BY from_id, draw)) WHERE r = 1")
def agg_34(v):
    legs = v.od.groupBy("from_id", F.col("draw").alias("option")).agg(F.round(F.sum(F.col("ride_time") + F.col("wait_time")), 6).alias("total"))
    best = legs.groupBy("from_id").agg(F.min(F.struct("total", "option")).alias("b"))
    return best.select("from_id", F.col("b.option").alias("option"), F.col("b.total").alias("total"))


@query("agg_35_two_stops", "SELECT l_orderkey AS trip_id, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2")
def agg_35(v):
    return v.table("lineitem").groupBy(F.col("l_orderkey").alias("trip_id")).agg(F.count("*").alias("n")).where("n >= 2")


@query("agg_36_iso_bands", "SELECT cap, floor(a / 0.2::DOUBLE)::INTEGER AS band, count(*) AS n FROM (SELECT cap, round(a, 3) + 0.0005::DOUBLE AS a FROM scores) GROUP BY 1, 2")
def agg_36(v):
    return v.scores.groupBy("cap", F.floor((F.round("a", 3) + 0.0005) / 0.2).cast("int").alias("band")).agg(F.count("*").alias("n"))


@query("agg_37_bounding_box", "SELECT round(min(lat), 6) AS south, round(max(lat), 6) AS north, round(min(lon), 6) AS west, round(max(lon), 6) AS east, round(avg(lat), 6) AS mean_lat FROM origins")
def agg_37(v):
    return v.origins.agg(*(F.round(f, 6).alias(n) for n, f in (("south", F.min("lat")), ("north", F.max("lat")), ("west", F.min("lon")), ("east", F.max("lon")), ("mean_lat", F.avg("lat")))))


@query("agg_38_average_speed", "SELECT stop_id, round((max(trip_id) - min(trip_id)) * 0.05::DOUBLE / ((max(dep_sec) - min(dep_sec)) / 3600.0::DOUBLE), 6) AS kmh FROM departures GROUP BY stop_id HAVING max(dep_sec) > min(dep_sec)")
def agg_38(v):
    span = v.departures.groupBy("stop_id").agg(((F.max("trip_id") - F.min("trip_id")) * 0.05).alias("km"), (F.max("dep_sec") - F.min("dep_sec")).alias("sec"))
    return span.where("sec > 0").select("stop_id", F.round(F.col("km") / (F.col("sec") / 3600.0), 6).alias("kmh"))


@query("agg_39_type_services", "SELECT p_brand AS poi_type, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS services FROM part GROUP BY p_brand")
def agg_39(v):
    return v.table("part").groupBy(F.col("p_brand").alias("poi_type")).agg(F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("services"))


@query("agg_41_weighted_mean", "SELECT node_id, round((0.4::DOUBLE * x1 + 0.35::DOUBLE * x2 + 0.25::DOUBLE * x3), 6) AS score FROM criteria")
def agg_41(v):
    return v.criteria.select("node_id", F.round(sum((F.lit(w) * F.col(x) for w, x in zip((0.35, 0.25), ("x2", "x3"))), F.lit(0.4) * F.col("x1")), 6).alias("score"))


@query("agg_42_stability_wide", "SELECT hex_id % 50 AS node, round(max(CASE WHEN cap = 0 THEN a END), 6) AS c0, round(max(CASE WHEN cap = 1 THEN a END), 6) AS c1, round(max(CASE WHEN cap = 2 THEN a END), 6) AS c2, round(least(max(CASE WHEN cap = 0 THEN a END), max(CASE WHEN cap = 1 THEN a END), max(CASE WHEN cap = 2 THEN a END)), 6) AS worst FROM scores GROUP BY 1")
def agg_42(v):
    wide = v.scores.groupBy((F.col("hex_id") % 50).alias("node")).pivot("cap", [0, 1, 2]).agg(F.max("a"))
    return wide.select("node", *(F.round(F.col(str(k)), 6).alias(f"c{k}") for k in range(3)), F.round(F.least(F.col("0"), F.col("1"), F.col("2")), 6).alias("worst"))


@query("agg_43_describe", "SELECT cap, count(b) AS n, round(avg(b), 6) AS mean, round(stddev_samp(b), 6) AS std, round(quantile_cont(b, 0.25), 6) AS p25, round(quantile_cont(b, 0.5), 6) AS p50, round(quantile_cont(b, 0.75), 6) AS p75 FROM scores GROUP BY cap")
def agg_43(v):
    return v.scores.groupBy("cap").agg(F.count("b").alias("n"), F.round(F.avg("b"), 6).alias("mean"), F.round(F.stddev_samp("b"), 6).alias("std"), *(F.round(F.percentile("b", p), 6).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)))


@query("win_04_running_sum", "SELECT l_orderkey AS trip, l_linenumber::INTEGER AS seq, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING), 6) AS km FROM lineitem")
def win_04(v):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return v.table("lineitem").select(F.col("l_orderkey").alias("trip"), F.col("l_linenumber").cast("int").alias("seq"), F.round(F.sum("l_quantity").over(w), 6).alias("km"))


@query("win_05_mid_rank", "WITH h AS (SELECT l_quantity AS q, count(*) AS n FROM lineitem GROUP BY 1) SELECT q, round((sum(n) OVER (ORDER BY q ROWS UNBOUNDED PRECEDING) - n / 2.0::DOUBLE) / sum(n) OVER (), 6) AS ecdf FROM h")
def win_05(v):
    h = v.table("lineitem").groupBy(F.col("l_quantity").alias("q")).agg(F.count("*").alias("n")).withColumn("key", F.lit(0))
    return scaling.ecdf(h, "key", "q", "n").select("q", F.round("ecdf", 6).alias("ecdf"))


@query("win_06_average_rank", "SELECT hex_id, round(rank() OVER (PARTITION BY cap ORDER BY d) + (count(*) OVER (PARTITION BY cap, d) - 1) / 2.0::DOUBLE, 6) AS rank FROM (SELECT hex_id, cap, round(abs(b - a), 9) AS d FROM scores)")
def win_06(v):
    d = v.scores.select("hex_id", "cap", F.round(F.abs(F.col("b") - F.col("a")), 9).alias("d"))
    return d.select("hex_id", F.round(significance.average_rank("cap", "d"), 6).alias("rank"))


@query("win_07_renumber", "SELECT l_orderkey AS trip, l_partkey AS stop, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey, l_extendedprice)::INTEGER AS seq FROM lineitem")
def win_07(v):
    return v.table("lineitem").select(F.col("l_orderkey").alias("trip"), F.col("l_partkey").alias("stop"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_linenumber"), "l_partkey", "l_suppkey", "l_extendedprice")).alias("seq"))


@query("win_09_surrogate_id", "SELECT poi_id, row_number() OVER (ORDER BY plat, plon, poi_id)::BIGINT AS sid FROM pois")
def win_09(v):
    return scaling.dense_ids(v.pois, ["plat", "plon", "poi_id"], "sid").select("poi_id", "sid")


@query("win_10_rank_p_values", "SELECT s_suppkey AS id, rank() OVER (ORDER BY (s_suppkey * 37) % 19)::INTEGER AS r FROM supplier")
def win_10(v):
    p = v.table("supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 37) % 19).alias("p"))
    below = p.groupBy("p").agg(F.count("*").alias("n")).withColumn("k", F.lit(0))
    r = below.select("p", (F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).cast("int").alias("r"))
    return p.join(r, "p").select("id", "r")


@query("win_11_tail_sums", "SELECT node_id, j::INTEGER AS j, round(sum(x) OVER (PARTITION BY node_id ORDER BY x, j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS tail FROM (SELECT node_id, unnest([x1, x2, x3]) AS x, unnest([0, 1, 2]) AS j FROM criteria)")
def win_11(v):
    long = v.criteria.select("node_id", F.posexplode(F.array("x1", "x2", "x3")).alias("j", "x"))
    return long.select("node_id", "j", F.round(F.sum("x").over(Window.partitionBy("node_id").orderBy("x", "j").rowsBetween(0, Window.unboundedFollowing)), 6).alias("tail"))


@query("win_12_nearest_stop", "SELECT zone, node_id, round(d, 6) AS d FROM (SELECT zone, node_id, abs(lat - 39.22::DOUBLE) AS d, row_number() OVER (PARTITION BY zone ORDER BY round(abs(lat - 39.22::DOUBLE), 9), node_id) AS r FROM origins) WHERE r = 1")
def win_12(v):
    d = F.abs(F.col("lat") - 39.22)
    best = v.origins.groupBy("zone").agg(F.min(F.struct(F.round(d, 9).alias("k"), "node_id")).alias("b"))
    return best.select("zone", F.col("b.node_id").alias("node_id"), F.round("b.k", 6).alias("d"))


@query("top_02_mismatches_first", "SELECT hex_id, a > b AS mismatch, round(a, 6) AS a FROM scores ORDER BY a > b DESC, a DESC, hex_id LIMIT 40")
def top_02(v):
    return v.scores.select("hex_id", (F.col("a") > F.col("b")).alias("mismatch"), F.col("a")).orderBy(F.desc("mismatch"), F.desc("a"), "hex_id").limit(40).select("hex_id", "mismatch", F.round("a", 6).alias("a"))


@query("top_03_k_nearest", "SELECT node_id, poi_id, r::INTEGER AS r FROM (SELECT node_id, poi_id, row_number() OVER (PARTITION BY node_id ORDER BY round(dist_m, 6), poi_id) AS r FROM hav_pairs) WHERE r <= 3")
def top_03(v):
    from isoreach.operators import spatial

    near = spatial.nearest(v.origins.select("node_id", "lat", "lon"), v.pois.select("poi_id", "plat", "plon"), "node_id", ("lat", "lon"), ("plat", "plon"), "poi_id", k=4)
    return near.withColumn("r", F.row_number().over(Window.partitionBy("node_id").orderBy(F.round("dist_m", 6), "poi_id"))).where("r <= 3").select("node_id", "poi_id", "r")


@query("top_04_seeded_sample", "SELECT node_id FROM origins ORDER BY md5('42:' || node_id), node_id LIMIT 100")
def top_04(v):
    """100 nodes in the order of a hash with a seed."""
    return v.origins.orderBy(F.md5(F.concat_ws(":", F.lit(42), "node_id").cast("binary")), "node_id").limit(100).select("node_id")


@query("top_05_stride", "SELECT zone, node_id FROM (SELECT zone, node_id, row_number() OVER (PARTITION BY zone ORDER BY node_id) AS r FROM origins) WHERE r % 5 = 0")
def top_05(v):
    return v.origins.withColumn("r", F.row_number().over(Window.partitionBy("zone").orderBy("node_id"))).where("r % 5 = 0").select("zone", "node_id")


@query("top_06_total_order", "SELECT cap, string_agg(hex_id::VARCHAR, ',' ORDER BY a DESC, hex_id) AS ids FROM scores WHERE a > 0.95 GROUP BY cap")
def top_06(v):
    rows = F.array_sort(F.collect_list(F.struct((-F.col("a")).alias("k"), "hex_id")))
    return v.scores.where("a > 0.95").groupBy("cap").agg(F.array_join(F.transform(rows, lambda r: r["hex_id"].cast("string")), ",").alias("ids"))


@query("top_07_newest", "SELECT o_custkey AS key, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS newest FROM orders GROUP BY o_custkey")
def top_07(v):
    return v.table("orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@query("set_01_union_keep_first", "SELECT id, first(src ORDER BY src) AS src FROM (SELECT poi_id AS id, 0 AS src FROM pois WHERE poi_id % 2 = 0 UNION ALL SELECT poi_id, 1 FROM pois WHERE poi_id % 3 = 0) GROUP BY id")
def set_01(v):
    a, b = v.pois.where("poi_id % 2 = 0").select(F.col("poi_id").alias("id"), F.lit(0).alias("src")), v.pois.where("poi_id % 3 = 0").select(F.col("poi_id").alias("id"), F.lit(1).alias("src"))
    return a.unionByName(b).groupBy("id").agg(F.min("src").alias("src"))


@query("set_03_intersect_except", "SELECT id, 'both' AS part FROM (SELECT l_suppkey AS id FROM lineitem INTERSECT SELECT poi_id FROM pois WHERE poi_id % 2 = 0) UNION ALL SELECT id, 'only' FROM (SELECT l_suppkey AS id FROM lineitem EXCEPT SELECT poi_id FROM pois WHERE poi_id % 2 = 0)")
def set_03(v):
    ids, even = v.table("lineitem").select(F.col("l_suppkey").alias("id")).distinct(), v.pois.where("poi_id % 2 = 0").select(F.col("poi_id").alias("id"))
    return ids.intersect(even).withColumn("part", F.lit("both")).unionByName(ids.subtract(even).withColumn("part", F.lit("only")))


@query("set_04_union_fragments", "SELECT from_id, count(*) AS n FROM (SELECT from_id, to_id FROM od WHERE draw = 1 UNION ALL SELECT from_id, to_id FROM od WHERE draw = 2 UNION ALL SELECT from_id, to_id FROM second) GROUP BY from_id")
def set_04(v):
    parts = [v.od.where("draw = 1"), v.od.where("draw = 2"), v.second]
    out = parts[0].select("from_id", "to_id")
    for p in parts[1:]:
        out = out.unionByName(p.select("from_id", "to_id"))
    return out.groupBy("from_id").agg(F.count("*").alias("n"))


@query("set_05_parents", "SELECT DISTINCT id FROM (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 4 = 0 UNION SELECT s_nationkey::BIGINT FROM supplier WHERE s_suppkey % 4 = 0)")
def set_05(v):
    s = v.table("supplier").where("s_suppkey % 4 = 0")
    return s.select(F.col("s_suppkey").alias("id")).union(s.select(F.col("s_nationkey").cast("long"))).distinct()


@query("set_06_drop_union", "SELECT DISTINCT poi_type, poi_id FROM (SELECT poi_type, poi_id FROM pois WHERE poi_id % 10 = 0 UNION SELECT poi_type, poi_id FROM pois WHERE plat > 39.24::DOUBLE)")
def set_06(v):
    return v.pois.where("poi_id % 10 = 0").select("poi_type", "poi_id").union(v.pois.where("plat > 39.24D").select("poi_type", "poi_id")).distinct()


@query("set_07_append_feeds", "SELECT id, name, zone FROM (SELECT n_nationkey AS id, n_name AS name, n_regionkey AS zone FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region)")
def set_07(v):
    a = v.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("zone"))
    return a.unionByName(v.table("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), allowMissingColumns=True)


_P = [(0, 0.8), (1, 1.0), (2, 1.25)]


@query("it_08_one_at_a_time", "SELECT params_id, cap, round(avg(CASE WHEN {a} <> {b} THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct_changed FROM (SELECT p.params_id, s.cap, s.a, least(1.0::DOUBLE, s.a * p.f) AS x FROM scores s, ({p}) p) GROUP BY 1, 2".format(a=_LV.format(x="a"), b=_LV.format(x="x"), p=" UNION ALL ".join(f"SELECT {i} AS params_id, {f}::DOUBLE AS f" for i, f in _P)))
def it_08(v):
    params = v.spark.createDataFrame(_P, "params_id int, f double")
    rows = v.scores.join(F.broadcast(params), F.lit(True)).withColumn("x", F.least(F.lit(1.0), F.col("a") * F.col("f")))
    changed = text.class_level(F.col("a"), M.BOUNDS) != text.class_level(F.col("x"), M.BOUNDS)
    return rows.groupBy("params_id", "cap").agg(F.round(F.avg(F.when(changed, 100.0).otherwise(0.0)), 6).alias("pct_changed"))


@query("it_09_cross_check", "SELECT node_id, cls, cls AS other FROM (SELECT node_id, CASE " + " ".join(f"WHEN {_CREDS[k]} >= {_LEAN!r}::DOUBLE THEN {k + 1}" for k in (3, 2, 1, 0)) + " ELSE 0 END AS cls FROM criteria)")
def it_09(v):
    """The class by column expressions against the class by a long table of criteria and bounds."""
    direct = v.criteria.select("node_id", M.outrank_class(cols(), W, cut=_LEAN, constant=False).alias("cls"))
    bounds = v.spark.createDataFrame(list(enumerate(M.BOUNDS)), "k int, b double")
    long = v.criteria.select("node_id", F.posexplode(F.array(*cols())).alias("j", "x")).join(F.broadcast(bounds), F.lit(True))
    one = F.when(F.col("x") - F.col("b") >= -M.Q, 1.0).when(F.col("x") - F.col("b") > -M.P, (F.col("x") - F.col("b") + M.P) / (M.P - M.Q)).otherwise(0.0)
    cred = long.groupBy("node_id", "k").agg(F.avg(one).alias("c"))
    other = cred.groupBy("node_id").agg(F.coalesce(F.max(F.when(F.col("c") >= _LEAN, F.col("k") + 1)), F.lit(0)).alias("other"))
    return direct.join(other, "node_id", "full_outer").select("node_id", "cls", "other")
