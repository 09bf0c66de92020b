"""Configuration tables: places, services and capabilities as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return df


def list_literal(cell: Column, kind: str) -> Column:
    """A list written with square brackets and single or double quotes; an apostrophe within a text stays."""
    return F.from_json(F.regexp_replace(F.regexp_replace(cell, r"(?<=[\[,]\s{0,9})'|'(?=\s*[,\]])", '"'), r"\bNone\b", "null"), f"array<{kind}>")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """poi_type, decay_coefficient, clauses (array of key to values), interactions. A tags cell holds one clause or several; true takes any value. A bad cell fails the job."""
    df = _csv(spark, path, ["poi_type", "decay_coefficient", "tags"])
    cell = F.when(F.trim("tags").startswith("{"), F.concat(F.lit("["), F.trim("tags"), F.lit("]"))).otherwise(F.trim("tags"))
    many = F.from_json(F.regexp_replace(cell, r':\s*("[^"]*"|true)', r": [$1]"), "array<map<string,array<string>>>")
    half = F.col("decay_coefficient").try_cast("double")
    bad = F.col("poi_type").isNull() | half.isNull() | (half <= 0) | many.isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad row of place types: "), F.coalesce("poi_type", F.lit("without a name"))))).otherwise(F.col("poi_type"))
    out = df.select(checked.cast("string").alias("poi_type"), half.alias("decay_coefficient"), many.alias("clauses"), (list_literal(F.col("choquet_interactions"), "double") if "choquet_interactions" in df.columns else F.lit(None).cast("array<double>")).alias("interactions"))
    return out


def read_services(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """service, idx, poi_type, capacity, contribution: one row for each place type of a service. Lists of unequal length, repeated types and unknown types fail the job."""
    df = _csv(spark, path, ["service", "poi_types", "choquet_capacity", "contribution_coefficient"])
    lists = df.select("service", list_literal(F.col("poi_types"), "string").alias("t"), list_literal(F.col("choquet_capacity"), "double").alias("c"), list_literal(F.col("contribution_coefficient"), "int").alias("k"))
    bad = F.col("t").isNull() | F.col("c").isNull() | F.col("k").isNull() | (F.size("t") != F.size("c")) | (F.size("t") != F.size("k")) | (F.size(F.array_distinct("t")) != F.size("t"))
    name = F.when(bad, F.raise_error(F.concat(F.lit("bad lists of service "), F.col("service")))).otherwise(F.col("service")).cast("string")
    out = lists.select(name.alias("service"), F.posexplode(F.arrays_zip("t", "c", "k")).alias("idx", "z")).select("service", "idx", F.col("z.t").alias("poi_type"), F.col("z.c").alias("capacity"), F.col("z.k").alias("contribution"))
    if known is None:
        return out
    from isoreach.operators.checks import reject_unknown

    return reject_unknown(out, known, "poi_type", "poi_type")


def read_capabilities(spark: SparkSession, path: str) -> DataFrame:
    """capability, services, weights (equal where blank), veto (infinite where blank), enabled (true where blank)."""
    df = _csv(spark, path, ["capability", "services"])
    get = lambda c: df[c] if c in df.columns else F.lit(None).cast("string")
    services = list_literal(df["services"], "string")
    weights = F.coalesce(list_literal(F.nullif(F.trim(get("electre_weight")), F.lit("")), "double"), F.transform(services, lambda s: F.lit(1.0) / F.size(services)))
    veto = F.trim(get("veto_threshold"))
    return df.select("capability", services.alias("services"), weights.alias("weights"), F.when(F.coalesce(veto, F.lit("")).isin("", "inf"), F.lit(float("inf"))).otherwise(veto.try_cast("double")).alias("veto"), F.coalesce(F.nullif(F.trim(get("enabled")), F.lit("")).try_cast("boolean"), F.lit(True)).alias("enabled"))


def read_ids(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The distinct ids of a file; none where there is no file."""
    try:
        return _csv(spark, path, [column]).select(F.trim(column).alias(column)).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{column} string")
