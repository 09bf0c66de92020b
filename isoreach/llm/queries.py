"""The contract queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoreach.functions.shared import visible
from isoreach.llm import bpe_table, decontaminate, langid, minhash, pii, quality, repair, sharding, token_counts, toxicity


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def small_batches(spark: SparkSession) -> None:
    """Batches of fewer rows than the default, since a row may be a long text; both sides of the pipe hold some of them. Workers are told where this package lies."""
    visible(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, n: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def op1_pigeonhole_myers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_viterbi_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 3) != 1))
    out = langid.identify(docs, model)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("lang").alias("lang_pred"), "score", F.size("spans").alias("n_spans"))


def op3_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.references(docs))


def op4_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.fit(docs, labels.where(fold("doc_id", 5) != 0))
    out = toxicity.score(docs, machine)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_bootstrapped_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents"), keep=False)
    counts = (pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS)
    return out.select("doc_id", *counts, F.sha2(pii.as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"))


def op6_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.balanced_shards(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.token_lengths(table(spark, sf_dir, "documents"), tokenizer_path()))


def op8_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = repair.write_ids(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)
    return repair.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_table.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pigeonhole_myers, op2_viterbi_spans, op3_divergence, op4_factorization_machine, op5_bootstrapped_context,
        op6_karmarkar_karp, op7_length_histogram, op8_repair_ids, op9_distinct_word_bpe, op10_dart_minhash,
    )
}
ORACLE_SQL: dict[str, str] = {}
