"""Byte-balanced shards by Karmarkar-Karp differencing.

A group (rows with equal text) is indivisible. Differencing keeps partial partitions, each a vector of
``shards`` sums, and repeatedly joins the two with the largest spread in opposite order, so that large
sums meet small ones. One heap over all groups would not scale, so it runs in levels: groups are hashed
into buckets of some thousand groups, differencing packs each bucket into ``shards`` packs of nearly
equal bytes, and the packs are the groups of the next level, until few enough remain for one heap.
Groups over ``1 / (shards * HEAVY)`` of all bytes (at most ``shards * HEAVY`` can exist) and some
LAST_HEAP / 4 others, by a hash, skip the packing: the last heap sees the large ones whole and evens
out with the small ones.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoreach.functions.shared import through_table
from isoreach.llm.skew import join_hot

HEAVY = 32
BUCKET_GROUPS = 4096
LAST_HEAP = 60_000
CELL_ROWS = 50_000


def karmarkar_karp(sizes, ways: int) -> np.ndarray:
    """The part (0 to ``ways`` - 1) of each size, by largest differencing; ties by position.

    Empty input gives an empty array.
    """
    n = len(sizes)
    part = np.zeros(n, np.int64)
    if n == 0 or ways == 1:
        return part
    heap, sums, made, serial = [], {}, {}, n
    for i, s in enumerate(sizes):
        v = np.zeros(ways, np.int64)
        v[0] = s
        sums[i] = v  # sorted, largest first
        heap.append((-int(s), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        sums[serial] = both[order]
        made[serial] = (a, b, order.astype(np.int16))
        heapq.heappush(heap, (-int(both[order[0]] - both[order[-1]]), serial))
        serial += 1
    todo = [(heap[0][1], np.arange(ways))]  # node, the part that each of its places became
    while todo:
        node, label = todo.pop()
        if node < n:
            part[node] = label[0]
            continue
        a, b, order = made.pop(node)
        own = np.empty(ways, np.int64)
        own[order] = label
        todo += [(a, own), (b, own[::-1])]
    return part


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """``groups`` (key string, bytes long) with ``shard``; every key once.

    An empty table stays empty. Groups without bytes are dealt like others.
    """
    spark = groups.sparkSession
    total, n = groups.agg(F.sum("bytes"), F.count("*")).first()
    if not n:
        return groups.select("key", F.lit(0).alias("shard")).limit(0)
    heavy_at = max(1, (total or 0) // (shards * HEAVY))
    heavy = groups.filter(F.col("bytes") > heavy_at) if n > LAST_HEAP else groups
    links, level, left = [], 0, groups.filter(F.col("bytes") <= heavy_at) if n > LAST_HEAP else groups.limit(0)
    m = n if n > LAST_HEAP else 0
    loose_of = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(max(1, n))) < LAST_HEAP // 4  # about so many single groups even out what packs leave
    loose = left.where(loose_of)
    left = left.where(~loose_of)
    while m > LAST_HEAP:
        buckets = max(1, -(-m // BUCKET_GROUPS))

        link = through_table(left.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInPandas(_packing(shards, level), "key string, bytes long, pack string"), "packs")
        links.append(link)
        left = through_table(link.groupBy(F.col("pack").alias("key")).agg(F.sum("bytes").alias("bytes")), "pack-sums")
        m, level = left.count(), level + 1
    rows = [(r.key, r.bytes, False) for r in heavy.unionByName(loose).select("key", "bytes").collect()] + [(r.key, r.bytes, True) for r in left.collect()]
    rows.sort(key=lambda r: (-r[1], r[0]))
    at = karmarkar_karp([r[1] for r in rows], shards)
    dealt = spark.createDataFrame([(r[0], int(p), r[2]) for r, p in zip(rows, at)], "key string, shard int, pack boolean")
    out, down = dealt.filter(~F.col("pack")).select("key", "shard"), dealt.filter("pack").select("key", "shard")
    for link in reversed(links):
        down = link.join(down.withColumnRenamed("key", "pack"), "pack").select("key", "shard")
    return out.unionByName(down)


def _packing(ways: int, level: int):
    """A bucket of groups to the packs that differencing deals them to."""

    def packed(pdf):
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True]).reset_index(drop=True)
        at = karmarkar_karp(pdf["bytes"].to_numpy(), ways)
        return pdf.assign(pack=[f"{level}/{b}/{p}" for b, p in zip(pdf["bucket"], at)])[["key", "bytes", "pack"]]

    return packed


def balanced_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Every row of ``docs`` with its size, shard and slot: doc_id, size, text_crc32, shard, slot.

    Size is the UTF-8 length (null: 0) plus ``overhead``. Rows with equal text share a shard; null is a
    group of its own, apart from the empty text. Slots run gapless from 0 within a shard, by a hash of
    the id and then the id; repeated ids keep one slot each. Other columns are ignored. An empty table
    gives no rows. A hot text is summed before any exchange, and its rows get their shard by broadcast.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.md5(text.cast("binary")), F.octet_length(text).cast("string")), F.lit("null")).alias("key"),
    )
    rows = through_table(rows, "shard-rows")
    groups = through_table(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("times")), "shard-groups")
    dealt = through_table(assign_groups(groups.select("key", "bytes"), shards).join(groups.select("key", "times"), "key"), "shard-of-group")
    spread = max(1, rows.count() // (shards * CELL_ROWS))  # cells of a shard, so that no window sees more than some CELL_ROWS rows
    placed = join_hot(rows, dealt, ["key"], "times").withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(spread)))
    placed = through_table(placed.select("doc_id", "size", "text_crc32", "shard", "cell"), "shard-placed")
    cells = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = cells.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("shard", "cell", F.coalesce("base", F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("rank", rank).join(before, ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"))
