"""Filters by known ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def only_known(df: DataFrame, known: DataFrame, key: str, known_key: str) -> DataFrame:
    """The rows whose id is known."""
    ids = known.select(F.col(known_key).alias(key)).distinct()
    return df.join(ids, key, "left_semi")


def reject_unknown(df: DataFrame, known: DataFrame, key: str, known_key: str) -> DataFrame:
    """The rows as they are; the job fails if an id is not known."""
    ids = known.select(F.col(known_key).alias(key)).distinct().withColumn("_known", F.lit(True))
    joined = df.join(ids, key, "left")
    checked = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.col(key).cast("string")))).otherwise(F.col("_known"))
    return joined.withColumn("_known", checked).where("_known").drop("_known")


def covered(have: DataFrame, want: DataFrame, key: str, least: float = 0.9) -> bool:
    """Whether at least a share ``least`` of the wanted ids is there; no wanted ids are covered."""
    wanted = want.select(key).distinct()
    n = wanted.count()
    return not n or wanted.join(have.select(key).distinct(), key, "left_semi").count() >= least * n
