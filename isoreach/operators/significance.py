"""Paired tests between two scenarios. Random draws are digests of the ids and the repetition, so they can be repeated anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _digest(*columns: str) -> Column:
    return F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in columns)).cast("binary"))


def average_rank(key: str, value: str) -> Column:
    """Ranks from 1; equal values share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(key).orderBy(value)) + (F.count("*").over(Window.partitionBy(key, value)) - 1) / 2.0


def _ranked(df: DataFrame, key: str, diff: str) -> DataFrame:
    """Distinct sizes of the differences, their counts and shared ranks: windows see distinct values, not rows."""
    sizes = df.where(F.col(diff) != 0).withColumn("_d", F.abs(diff)).groupBy(key, "_d").agg(F.count("*").alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("_rank", below + (F.col("_n") + 1) / 2.0).select(key, "_d", "_rank")


def signed_rank(df: DataFrame, key: str, diff: str) -> DataFrame:
    """key, n, w (sum of signed ranks), w_plus; differences of 0 are left out."""
    rows = df.where(F.col(diff) != 0).withColumn("_d", F.abs(diff)).join(_ranked(df, key, diff), [key, "_d"])
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("_rank") * F.signum(diff)).alias("w"), F.sum(F.when(F.col(diff) > 0, F.col("_rank")).otherwise(0.0)).alias("w_plus"))


def block_permutation(df: DataFrame, key: str, diff: str, block: str, reps: int) -> DataFrame:
    """key, n_blocks, p_value of the signed-rank sum where whole blocks change their sign.

    Ranks are summed by block first, so the repetitions multiply blocks, not rows.
    """
    rows = df.where(F.col(diff) != 0).withColumn("_d", F.abs(diff)).join(_ranked(df, key, diff), [key, "_d"])
    sums = rows.groupBy(key, block).agg(F.sum(F.col("_rank") * F.signum(diff)).alias("s"))
    observed = sums.groupBy(key).agg(F.sum("s").alias("w0"), F.count("*").alias("n_blocks"))
    sign = F.when(F.substring(_digest(block, "rep"), 1, 1) < "8", 1.0).otherwise(-1.0)
    drawn = sums.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).groupBy(key, "rep").agg(F.sum(F.col("s") * sign).alias("w"))
    both = drawn.join(observed, key)
    return both.groupBy(key, "n_blocks").agg(((1.0 + F.count_if(F.abs("w") >= F.abs("w0") - 1e-6)) / (reps + 1)).alias("p_value"))


def bootstrap_median(df: DataFrame, key: str, order: str, value: str, reps: int, level: float = 0.95) -> DataFrame:
    """key, lo, hi: the percentile interval of the median over samples of a key's rows with replacement.

    A row's place in sample ``rep`` is drawn by a digest of rep and place, and joined to the rows by key
    and place.
    """
    placed = df.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    sized = placed.join(df.groupBy(key).agg(F.count("*").alias("_n")), key)
    draws = sized.select(key, F.col("_i").alias("_j"), "_n").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    at = F.conv(F.substring(_digest("rep", "_j"), 1, 12), 16, 10).cast("long") % F.col("_n")
    taken = draws.select(key, "rep", at.alias("_i")).groupBy(key, "rep", "_i").agg(F.count("*").alias("_times"))
    medians = taken.join(placed.select(key, "_i", value), [key, "_i"]).groupBy(key, "rep").agg(F.percentile(value, 0.5, F.col("_times")).alias("med"))
    a = (1 - level) / 2
    return medians.groupBy(key).agg(F.percentile("med", a).alias("lo"), F.percentile("med", 1 - a).alias("hi"))


def benjamini_hochberg(df: DataFrame, p: str) -> DataFrame:
    """The rows with ``q``: p-values adjusted for the false discovery rate. Distinct p-values alone go through the windows."""
    sizes = df.groupBy(p).agg(F.count("*").alias("_n"))
    rank = F.coalesce(F.sum("_n").over(Window.orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    total = F.sum("_n").over(Window.orderBy(p).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    raw = sizes.withColumn("_q", F.col(p) * total / rank)
    q = F.least(F.lit(1.0), F.min("_q").over(Window.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)))
    return df.join(raw.withColumn("q", q).select(p, "q"), p)
