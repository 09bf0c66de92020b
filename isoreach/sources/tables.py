"""Itineraries, places, graphs and stores from files."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OD = "from_id long, to_id long, departure long, draw int, access_time double, wait_time double, ride_time double, transfer_time double, egress_time double, routes string"


def read_itineraries(spark: SparkSession, path: str) -> DataFrame:
    """Typed CSV of itineraries; blanks are null. Only the columns that a query uses are parsed."""
    return spark.read.csv(path, header=True, schema=OD)


def read_graph_xml(spark: SparkSession, path: str) -> DataFrame:
    """u, v, length_m: the shortest of parallel edges of an XML graph whose edge elements have source, target and length."""
    rows = spark.read.format("xml").option("rowTag", "edge").schema("_source long, _target long, length double").load(path)
    return rows.groupBy(F.col("_source").alias("u"), F.col("_target").alias("v")).agg(F.min("length").alias("length_m"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """id, geom_type, tags, vertices (lon, lat) of the features of a collection; points, lines and polygon rings alike."""
    schema = "features array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    numbers = F.transform(F.regexp_extract_all(F.col("f.geometry.coordinates"), F.lit(r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)"), 0), lambda m: F.split(F.regexp_replace(m, r"[\[\s]", ""), ","))
    vertices = F.transform(numbers, lambda p: F.struct(p[0].cast("double").alias("lon"), p[1].cast("double").alias("lat")))
    return f.select(F.col("f.id").alias("id"), F.col("f.geometry.type").alias("geom_type"), F.col("f.properties").alias("tags"), vertices.alias("vertices"))


def read_zip_csv(spark: SparkSession, path: str, name: str, columns: list[str]) -> DataFrame:
    """The text columns of one CSV in a zip that Spark's reader can open; no rows where the member is absent."""

    def unpacked(batches):
        import csv

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    if name not in z.namelist():
                        continue
                    with z.open(name) as f:
                        reader = csv.DictReader(io.TextIOWrapper(f, "utf-8-sig"))
                        held: list[dict] = []
                        for row in reader:
                            held.append(row)
                            if len(held) == 10_000:
                                yield _rows(held, columns)
                                held = []
                        if held:
                            yield _rows(held, columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpacked, ", ".join(f"{c} string" for c in columns))


def _rows(held: list[dict], columns: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in held], pa.string()) for c in columns], names=columns)


def read_shards(spark: SparkSession, path: str, shards: list[str] | None = None) -> DataFrame:
    """The store's rows; only the folders of the named shards are read."""
    df = spark.read.parquet(path)
    return df if shards is None else df.where(F.col("shard").isin(shards))


def newest_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the newest CSV file under a path (of equally new ones the last by name)."""
    df = spark.read.csv(path, header=True, schema=schema).select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_modification_time").alias("_t"))
    newest = df.agg(F.max(F.struct("_t", "_f")).alias("m")).select(F.col("m._f").alias("_f"))
    return df.join(F.broadcast(newest), "_f").drop("_f", "_t")  # one row


def by_priority(rows: DataFrame, key: str, priority: dict[str, int], kind: str, value: str) -> DataFrame:
    """Of each key the value of the kind that comes first; kinds without a place are left out."""
    rank = F.when(F.lit(False), 0)
    for k, i in priority.items():
        rank = rank.when(F.col(kind) == k, i)
    ranked = rows.withColumn("_r", rank).where("_r is not null")
    return ranked.groupBy(key).agg(F.min_by(value, F.struct("_r", value)).alias(value))
