"""Quantile scaling, bins, breaks and surrogate ids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ecdf(hist: DataFrame, key: str, value: str, n: str) -> DataFrame:
    """The histogram with ``ecdf``: the share below a value and half of those equal to it. Windows see one row for each distinct value of a key."""
    below = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("ecdf", (F.sum(n).over(below) - F.col(n) / 2.0) / F.sum(n).over(Window.partitionBy(key)))


def mid_rank(rows: DataFrame, key: str, value: str, scale: int = 10_000) -> DataFrame:
    """key, value, n, scaled: positive whole values mapped to their mid-rank of ``scale``, ties to even."""
    hist = rows.where(F.col(value) > 0).groupBy(key, value).agg(F.count("*").alias("n"))
    return ecdf(hist, key, value, "n").select(key, value, "n", F.bround(F.round(F.col("ecdf") * scale, 6), 0).cast("long").alias("scaled"))


def report_bins(rows: DataFrame, key: str, value: str, bins: int) -> DataFrame:
    """key, bin, n, least_q, most_q over bins of equal width between a key's least and greatest value; the last bin has its upper end."""
    hist = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) * float(bins) / F.greatest(F.lit(1), hi - lo))).cast("int")
    return hist.withColumn("bin", at).groupBy(key, "bin").agg(F.sum("n").alias("n"), F.min(value).alias("least_q"), F.max(value).alias("most_q"))


def dense_ids(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Ids from 1 in the total order of the columns, without one window over all rows: ranges first, then places within them."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    inner = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return inner.join(F.broadcast(base), "_p").withColumn(out, (F.col("_base") + F.col("_r")).cast("long")).drop("_p", "_r", "_base")  # a row a partition


def natural_breaks(rows: DataFrame, value: str, k: int) -> DataFrame:
    """class, upper, n: the k classes of one-dimensional values with the least summed squared deviation.

    Dynamic programming over the distinct values with their counts, so Spark first sums repeats up.
    """
    hist = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count("*").alias("n")).withColumn("one", F.lit(1))

    def broken(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        x, n = pdf["x"].to_numpy(float), pdf["n"].to_numpy(float)
        m, c = len(x), min(k, len(x))
        s0, s1, s2 = (np.concatenate([[0.0], np.cumsum(a)]) for a in (n, n * x, n * x * x))

        def cost(i, j):  # of values i to j - 1, for arrays i
            w = s0[j] - s0[i]
            return s2[j] - s2[i] - (s1[j] - s1[i]) ** 2 / w

        best = np.full((c + 1, m + 1), np.inf)
        cut = np.zeros((c + 1, m + 1), int)
        best[0, 0] = 0.0
        for g in range(1, c + 1):
            for j in range(g, m + 1):
                i = np.arange(g - 1, j)
                total = best[g - 1, i] + cost(i, j)
                at = int(total.argmin())
                best[g, j], cut[g, j] = total[at], i[at]
        out, j = [], m
        for g in range(c, 0, -1):
            i = cut[g, j]
            out.append((g - 1, float(x[j - 1]), int(n[i:j].sum())))
            j = i
        return pd.DataFrame(out[::-1], columns=["class", "upper", "n"])

    return hist.groupBy("one").applyInPandas(broken, "class int, upper double, n long")
