"""Exact length histogram: totals, quantiles and truncated totals for every context limit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoreach.functions.shared import through_table
from isoreach.llm.blocks import blocks, tidy
from isoreach.llm.bpe import Codec

RANGE = 1024


def token_lengths(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens for every row; null and empty texts have 0. Rows that repeat stay, null ids too; an empty table gives no rows."""
    kind = docs.schema[id_col].dataType.simpleString()

    def counted(batches):
        codec = Codec.of(tokenizer)
        for batch in batches:
            for part in blocks(batch):
                _, n = codec.encode([(t or "").encode() for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(counted), f"doc_id {kind}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """A row for each length that occurs: n_docs, and by running sums docs_upto, tokens_upto, docs_over, tokens_over, total_tokens, truncated_total and quantile.

    ``truncated_total`` is what stays of all tokens where documents are cut at this length;
    ``quantile`` is the share of documents no longer than it. Lengths are summed within ranges of
    RANGE lengths and over the ranges, so no window sees all lengths. An empty table gives no rows.
    """
    h = through_table(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "length-histogram")
    h = h.withColumn("r", F.expr(f"n_tokens div {RANGE}"))
    h = h.withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    by_range = h.groupBy("r").agg(F.sum("n_docs").alias("rd"), F.sum("tokens").alias("rt"))
    upto = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_range = by_range.select("r", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for c, w, n in (("rd", upto, "d0"), ("rt", upto, "t0"), ("rd", every, "all_docs"), ("rt", every, "total_tokens"))))
    own = Window.partitionBy("r").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(by_range, "r").select(
        "n_tokens", "n_docs", "all_docs", "total_tokens",
        (F.col("d0") + F.sum("n_docs").over(own)).alias("docs_upto"),
        (F.col("t0") + F.sum("tokens").over(own)).alias("tokens_upto"),
    )
    return out.select(
        "n_tokens", "n_docs", "docs_upto", "tokens_upto",
        (F.col("all_docs") - F.col("docs_upto")).alias("docs_over"),
        (F.col("total_tokens") - F.col("tokens_upto")).alias("tokens_over"),
        "total_tokens",
        (F.col("tokens_upto") + F.col("n_tokens") * (F.col("all_docs") - F.col("docs_upto"))).alias("truncated_total"),
        (F.col("docs_upto") / F.col("all_docs")).alias("quantile"),
    )


def at_limit(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_over, truncated_total for any limits, read from the suffix sums at the greatest length within each limit.

    One pass over the histogram keeps one row a limit; an empty histogram gives zeros. A limit that repeats stays.
    """
    answer = lambda x: F.struct(F.col("docs_over"), (F.col("tokens_upto") + F.lit(x) * F.col("docs_over")).alias("truncated_total"))
    all_docs = F.coalesce(F.max(F.col("docs_upto") + F.col("docs_over")), F.lit(0))
    found = []
    for x in limits:
        below = F.max_by(F.when(F.col("n_tokens") <= x, answer(int(x))), F.when(F.col("n_tokens") <= x, F.col("n_tokens")))
        none = F.struct(all_docs.alias("docs_over"), (F.lit(int(x)) * all_docs).alias("truncated_total"))
        found.append(F.struct(F.lit(int(x)).cast("long").alias("limit"), F.coalesce(below, none).alias("a")))
    out = histogram.agg(F.array(*found).alias("found")).select(F.explode("found").alias("f"))
    return out.select("f.limit", "f.a.docs_over", "f.a.truncated_total")


def length_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The least length that a share ``q`` of documents does not exceed."""
    return histogram.filter(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
