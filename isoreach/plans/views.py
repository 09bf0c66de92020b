"""Domain views over the tables: the same integer arithmetic as DataFrames and as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoreach.functions.shared import visible


def spread(key: str, prime: int, base: float, width: float) -> Column:
    """A coordinate from an integer key."""
    return F.lit(base) + ((F.col(key) * prime) % 1000).cast("double") / 1000.0 * width


def _sql_spread(key: str, prime: int, base: float, width: float) -> str:
    return f"{base}::DOUBLE + (({key} * {prime}) % 1000)::DOUBLE / 1000.0::DOUBLE * {width}::DOUBLE"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        visible(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def origins(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("node_id"), spread("c_custkey", 7919, 39.18, 0.08).alias("lat"), spread("c_custkey", 104729, 9.05, 0.12).alias("lon"),
            F.col("c_nationkey").alias("zone"), ((F.col("c_custkey") % 7) / 100.0).alias("gap_o"),
        )

    @cached_property
    def pois(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("poi_id"), spread("s_suppkey", 6007, 39.18, 0.08).alias("plat"), spread("s_suppkey", 9973, 9.05, 0.12).alias("plon"),
            F.concat(F.lit("t"), (F.col("s_suppkey") % 4).cast("string")).alias("poi_type"), ((F.col("s_suppkey") % 5) / 100.0).alias("gap_p"),
            F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("pzone"),
        )

    @cached_property
    def places(self) -> DataFrame:
        """The larger set of places, with tags."""
        return self.table("part").select(
            F.col("p_partkey").alias("place_id"), spread("p_partkey", 3571, 39.18, 0.08).alias("qlat"), spread("p_partkey", 8123, 9.05, 0.12).alias("qlon"),
            F.create_map(
                F.lit("kind"), F.concat_ws("; ", "p_type", F.regexp_replace(F.upper("p_name"), " ", "; ")), F.lit("brand"), F.lower(F.regexp_replace("p_brand", "#", "_")),
                F.lit("size"), F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("string")),
            ).alias("tags"),
        )

    @cached_property
    def od(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_orderkey").alias("departure"), F.col("l_linenumber").cast("int").alias("draw"),
            (F.col("l_quantity") / 10.0).alias("access_time"), (F.col("l_discount") * 100.0).alias("wait_time"), (F.col("l_extendedprice") / 2000.0).alias("ride_time"),
            (F.col("l_tax") * 50.0).alias("transfer_time"), (F.col("l_linenumber") % 5).cast("double").alias("egress_time"),
            F.when(F.col("l_returnflag") == "N", F.lit("[WALK]")).otherwise(F.col("l_returnflag")).alias("routes"),
        )

    @cached_property
    def second(self) -> DataFrame:
        return self.table("orders").select(F.col("o_custkey").alias("from_id"), (F.col("o_orderkey") % 100).alias("to_id"), F.col("o_orderkey").alias("trip_id"), (F.col("o_totalprice") / 5000.0).alias("minutes"))

    @cached_property
    def departures(self) -> DataFrame:
        """Departures by stop; seconds may pass a day."""
        return self.table("events").select(F.col("event_id").alias("trip_id"), (F.col("user_id") % 40).alias("stop_id"), ((F.col("event_id") * 7919) % 90000).cast("int").alias("dep_sec"), F.col("event_type"), F.col("value"))

    @cached_property
    def criteria(self) -> DataFrame:
        x = lambda j: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.element_at("embedding", j).cast("double") + 1) / 2))
        return self.table("embeddings").select(F.col("vec_id").alias("node_id"), F.col("label"), *(x(j).alias(f"x{j}") for j in range(1, 6)))

    @cached_property
    def scores(self) -> DataFrame:
        """Two scenarios of one score on a lattice of cells."""
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("hex_id"), spread("c_custkey", 7919, 39.18, 0.08).alias("lat"), spread("c_custkey", 104729, 9.05, 0.12).alias("lon"),
            (((k * 7919) % 1000).cast("double") / 1000.0).alias("a"), (((k * 7919 + (k % 11) * 13) % 1000).cast("double") / 1000.0).alias("b"), (k % 3).cast("int").alias("cap"),
        )

    @cached_property
    def zones(self) -> DataFrame:
        k = F.col("n_nationkey")
        south, west = F.lit(39.18) + (k % 5).cast("double") * 0.016, F.lit(9.05) + F.floor(k / 5).cast("double") * 0.024
        return self.table("nation").select(k.alias("zone_id"), F.col("n_name").alias("zone_name"), F.col("n_regionkey").alias("region"), south.alias("south"), (south + 0.014).alias("north"), west.alias("west"), (west + 0.022).alias("east"))

    @cached_property
    def edges(self) -> DataFrame:
        """A directed street graph on nodes 0 to 199 with parallel edges."""
        k = F.col("o_orderkey")
        return self.table("orders").select(((k * 31) % 200).alias("u"), ((k * 17 + F.col("o_custkey")) % 200).alias("v"), (F.lit(50.0) + (k % 97).cast("double") * 10.0).alias("length_m"))


SQL_VIEWS = {
    "origins": f"SELECT c_custkey AS node_id, {_sql_spread('c_custkey', 7919, 39.18, 0.08)} AS lat, {_sql_spread('c_custkey', 104729, 9.05, 0.12)} AS lon, c_nationkey AS zone, (c_custkey % 7)::DOUBLE / 100.0::DOUBLE AS gap_o FROM customer",
    "pois": f"SELECT s_suppkey AS poi_id, {_sql_spread('s_suppkey', 6007, 39.18, 0.08)} AS plat, {_sql_spread('s_suppkey', 9973, 9.05, 0.12)} AS plon, 't' || (s_suppkey % 4) AS poi_type, (s_suppkey % 5)::DOUBLE / 100.0::DOUBLE AS gap_p, s_acctbal AS balance, s_nationkey AS pzone FROM supplier",
    "places": f"SELECT p_partkey AS place_id, {_sql_spread('p_partkey', 3571, 39.18, 0.08)} AS qlat, {_sql_spread('p_partkey', 8123, 9.05, 0.12)} AS qlon, p_type || '; ' || replace(upper(p_name), ' ', '; ') AS kind, lower(replace(p_brand, '#', '_')) AS brand, CASE WHEN p_size % 3 <> 0 THEN p_size::VARCHAR END AS size FROM part",
    "od": "SELECT l_suppkey AS from_id, l_partkey AS to_id, l_orderkey AS departure, l_linenumber::INTEGER AS draw, l_quantity / 10.0::DOUBLE AS access_time, l_discount * 100.0::DOUBLE AS wait_time, l_extendedprice / 2000.0::DOUBLE AS ride_time, l_tax * 50.0::DOUBLE AS transfer_time, (l_linenumber % 5)::DOUBLE AS egress_time, CASE WHEN l_returnflag = 'N' THEN '[WALK]' ELSE l_returnflag END AS routes FROM lineitem",
    "second": "SELECT o_custkey AS from_id, o_orderkey % 100 AS to_id, o_orderkey AS trip_id, o_totalprice / 5000.0::DOUBLE AS minutes FROM orders",
    "departures": "SELECT event_id AS trip_id, user_id % 40 AS stop_id, ((event_id * 7919) % 90000)::INTEGER AS dep_sec, event_type, value FROM events",
    "criteria": "SELECT vec_id AS node_id, label, " + ", ".join(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (embedding[{j}]::DOUBLE + 1) / 2)) AS x{j}" for j in range(1, 6)) + " FROM embeddings",
    "scores": f"SELECT c_custkey AS hex_id, {_sql_spread('c_custkey', 7919, 39.18, 0.08)} AS lat, {_sql_spread('c_custkey', 104729, 9.05, 0.12)} AS lon, ((c_custkey * 7919) % 1000)::DOUBLE / 1000.0::DOUBLE AS a, ((c_custkey * 7919 + (c_custkey % 11) * 13) % 1000)::DOUBLE / 1000.0::DOUBLE AS b, (c_custkey % 3)::INTEGER AS cap FROM customer",
    "zones": "SELECT n_nationkey AS zone_id, n_name AS zone_name, n_regionkey AS region, south, south + 0.014::DOUBLE AS north, west, west + 0.022::DOUBLE AS east FROM (SELECT *, 39.18::DOUBLE + (n_nationkey % 5)::DOUBLE * 0.016::DOUBLE AS south, 9.05::DOUBLE + (n_nationkey // 5)::DOUBLE * 0.024::DOUBLE AS west FROM nation)",
    "edges": "SELECT (o_orderkey * 31) % 200 AS u, (o_orderkey * 17 + o_custkey) % 200 AS v, 50.0::DOUBLE + (o_orderkey % 97)::DOUBLE * 10.0::DOUBLE AS length_m FROM orders",
    "hav_pairs": "SELECT *, 2 * 6371000.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h)) AS dist_m FROM (SELECT *, power(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * power(sin(radians(plon - lon) / 2), 2) AS h FROM origins, pois)",
    "modal": "SELECT *, CASE WHEN (node_id + poi_id) % 3 = 0 THEN 0.0::DOUBLE ELSE 8.0::DOUBLE + 2.5::DOUBLE * dist_m / 1000 END AS bus, dist_m / 1000 * 1.3::DOUBLE AS km FROM hav_pairs WHERE dist_m <= 15000",
    "decays": """SELECT node_id, poi_id, poi_type, dist_m, walk, bike, drive, bus, exp(-ln(2) / half * walk) AS dw, exp(-ln(2) / half * bike) AS db, exp(-ln(2) / half * drive) AS dd,
        CASE WHEN bus <= 0 THEN 0.0::DOUBLE ELSE exp(-ln(2) / half * bus) END AS dt
        FROM (SELECT *, (km + gap_o + gap_p) / 5.0::DOUBLE * 60 AS walk, (km + gap_o + gap_p) / 15.0::DOUBLE * 60 AS bike,
            10.0::DOUBLE + km / 30.0::DOUBLE * 60 + (gap_o + gap_p) / 5.0::DOUBLE * 60 + 0.2::DOUBLE * 1.8::DOUBLE / 15.0::DOUBLE AS drive,
            CASE poi_type WHEN 't0' THEN 20.0::DOUBLE WHEN 't1' THEN 12.0::DOUBLE WHEN 't2' THEN 30.0::DOUBLE ELSE 15.0::DOUBLE END AS half FROM modal)""",
    "rras": """SELECT *, 1 - (1 - l[1]) * (1 - l[2] * (1.0::DOUBLE / 2)) * (1 - l[3] * (1.0::DOUBLE / 3)) * (1 - l[4] * (1.0::DOUBLE / 4)) AS rra
        FROM (SELECT *, list_reverse_sort([dw, db, dd, dt]) AS l FROM decays)""",
    "type_access": """SELECT node_id, poi_type, sum(rra * (exp(c * (r - 1)) - exp(c * r))) AS access FROM (SELECT *, row_number() OVER (PARTITION BY node_id, poi_type ORDER BY rra DESC) AS r,
        CASE poi_type WHEN 't0' THEN -0.23::DOUBLE WHEN 't1' THEN -0.08::DOUBLE WHEN 't2' THEN -0.05::DOUBLE ELSE -0.46::DOUBLE END AS c FROM rras) GROUP BY node_id, poi_type""",
    "services": """SELECT node_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.55::DOUBLE * a + 0.45::DOUBLE * b + 0.07::DOUBLE * least(a, b)) / 1.07::DOUBLE)) AS s1,
        greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.35::DOUBLE * c + 0.65::DOUBLE * d - 0.05::DOUBLE * least(c, d)) / 0.95::DOUBLE)) AS s2
        FROM (SELECT node_id, coalesce(least(1.0::DOUBLE, max(CASE WHEN poi_type = 't0' THEN access END)), 0) AS a, coalesce(least(1.0::DOUBLE, max(CASE WHEN poi_type = 't1' THEN access END)), 0) AS b,
            coalesce(least(1.0::DOUBLE, max(CASE WHEN poi_type = 't2' THEN access END)), 0) AS c, coalesce(least(1.0::DOUBLE, max(CASE WHEN poi_type = 't3' THEN access END)), 0) AS d FROM type_access GROUP BY node_id)""",
}
