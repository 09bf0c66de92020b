"""Results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.functions.geo import shard_of


def write_wide_csv(long: DataFrame, key: list[str], name: str, value: str, names: list[str], path: str) -> None:
    """One row a key with a column for each name. The writer keeps Spark's parts; join them outside if one file is wanted."""
    long.groupBy(*key).pivot(name, names).agg(F.first(value)).write.csv(path, header=True, mode="errorifexists")


def append_recap(df: DataFrame, keys: list[str], values: list[str], path: str) -> None:
    df.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values)).write.mode("append").parquet(path)


def missing_rows(want: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """What a store lacks: the rows to compute again after a broken run."""
    return want.join(have.select(*keys).distinct(), keys, "left_anti")


def write_sparse(df: DataFrame, value: str, path: str) -> None:
    df.where(F.col(value) > 0).write.parquet(path)


def write_shards(df: DataFrame, hexagon: str, path: str) -> None:
    """Folders by shard; rows of a shard are brought together first, so a folder has few files."""
    out = df.withColumn("shard", shard_of(F.col(hexagon)))
    out.repartition("shard").sortWithinPartitions("shard", hexagon).write.partitionBy("shard").parquet(path)


def quantised(value, scale: int = 10_000):
    """Values as whole numbers of 1/scale, ties to even; null for 0 and less."""
    q = F.bround(value * scale, 0).cast("int")
    return F.when(q > 0, q)


def geojson_rows(df: DataFrame, lon: str, lat: str, properties: list[str]) -> DataFrame:
    """One point feature a row, as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def column_names(names: list[str], width: int) -> dict[str, str]:
    """Unique names of at most ``width`` characters: letters, digits and underscores, numbered where they clash."""
    out, taken = {}, set()
    for n in names:
        base = "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in n)[:width] or "c"
        name, i = base, 1
        while name.lower() in taken:
            tail = f"_{i}"
            name, i = base[: width - len(tail)] + tail, i + 1
        taken.add(name.lower())
        out[n] = name
    return out


def write_zip(spark, members: dict[str, str], path: str) -> None:
    """Texts as the members of one zip, in any store that Spark's file systems reach; for feeds of a size that the driver holds."""
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(held.getvalue()))
    finally:
        out.close()
