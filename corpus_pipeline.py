"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

1. language ID: texts without a known language for half of their letters go; ``lang`` becomes the language found
2. near duplicates: one document of each class of similar texts stays, the one with the least id (by text, so no text of a repeated id is lost)
3. benchmark decontamination: documents that hold a test item, up to its edit budget, go
4. personal data: spans are replaced by their kind in angle brackets, ``n_chars`` follows
5. BPE: token ids of every document, and digests of the ids and of the text they decode to

SQL expresses none of the models and signatures, so there is no oracle; the tests hold every stage
against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoreach.functions.shared import through_table
from isoreach.llm import bpe_table, decontaminate, langid, minhash, pii
from isoreach.llm.queries import small_batches, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts and texts without a letter go; repeated rows are judged alike; no labelled row at all leaves no row."""
    small_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a word stay. Null ids are compared like others and an id that repeats with other texts keeps one row for each class."""
    small_batches(spark)
    return minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts stay; ids of the items may be null or repeat; an empty benchmark removes nothing."""
    small_batches(spark)
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts stay null, and so does their ``n_chars``; all other columns stay as they are, whatever their names."""
    text = pii.redacted(F.col("row")["text"], F.col("spans"))
    out = pii.find(docs).select("row", text.alias("text"))
    put = {"text": F.col("text"), "n_chars": F.length("text")}
    return out.select(*((put[f.name].cast(f.dataType) if f.name in put else F.col("row")[f.name]).alias(f.name) for f in docs.schema))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts have no ids and decode to the empty text; repeated and null ids keep their rows."""
    small_batches(spark)
    out = bpe_table.encode_decode(docs, tokenizer_path(), chunk_bytes=4 << 20)  # half the default: workers of earlier stages hold memory too
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [("language ID", language), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("personal data", personal_data), ("BPE", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = through_table(docs, name.replace(" ", "-"))
    return docs
