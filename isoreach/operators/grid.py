"""Hexagon lattices over points, and one-to-one assignment."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoreach.functions import geo


def claimed_nodes(nodes: DataFrame, cell_m: float, lat0: float, key: str = "node_id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """node, col, row, hex_id: each lattice centre takes its nearest node within the circumradius, and of several centres for a node the first by column and row.

    Only the centres around a node are tried: those of its own column and the two on either side, two
    rows up and down, which is all that the circumradius can reach; so the work is linear in the nodes.
    """
    radius, dx, dy = geo.hex_steps(cell_m)
    x, y = geo.to_metres(F.col(lat), F.col(lon), F.lit(lat0))
    at = nodes.select(key, x.alias("x"), y.alias("y"))
    box = at.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    near = at.join(F.broadcast(box), F.lit(True)).withColumn("col", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda k: (F.round((F.col("x") - F.col("x0") + radius) / dx) + k).cast("int"))))
    near = near.withColumn("row", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda k: (F.round((F.col("y") - F.col("y0") + dy) / dy) + k).cast("int"))))
    cx, cy = geo.hex_centre(F.col("col"), F.col("row"), F.col("x0"), F.col("y0"), cell_m)
    near = near.withColumn("cx", cx).withColumn("cy", cy).where((F.col("col") >= 0) & (F.col("row") >= 0) & (F.col("cx") <= F.col("x1") + radius) & (F.col("cy") <= F.col("y1") + dy))
    near = near.withColumn("d2", F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)).where(F.sqrt("d2") <= radius)
    best = near.groupBy("col", "row").agg(F.min_by(key, F.struct(F.round("d2", 4), key)).alias(key))
    first = best.withColumn("claim", F.row_number().over(Window.partitionBy(key).orderBy("col", "row"))).where("claim = 1")
    return first.select(key, "col", "row", geo.hex_id(F.col("col"), F.col("row")).alias("hex_id"))


def greedy_nearest(left: DataFrame, right: DataFrame, key: str, left_at: tuple[str, str], right_key: str, right_at: tuple[str, str]) -> DataFrame:
    """Each left row (few, by key) takes its nearest right row that no earlier one has: key, right_key, dist_m.

    With n left rows a row needs at most its n nearest, so Spark finds these and only n * n rows are
    settled in order.
    """
    from isoreach.operators.spatial import nearest

    n = left.count()
    if not n:
        return left.limit(0).select(key).withColumn(right_key, F.lit(None).cast("long")).withColumn("dist_m", F.lit(0.0))
    rows = nearest(left, right, key, left_at, right_at, right_key, k=n).select(key, right_key, "dist_m").collect()
    options: dict = {}
    for r in rows:
        heapq.heappush(options.setdefault(r[0], []), (r[2], r[1]))
    taken, out = set(), []
    for k in sorted(options):
        while options[k]:
            d, r = heapq.heappop(options[k])
            if r not in taken:
                taken.add(r)
                out.append((k, r, d))
                break
    types = dict(left.dtypes) | dict(right.dtypes)
    return left.sparkSession.createDataFrame(out, f"{key} {types[key]}, {right_key} {types[right_key]}, dist_m double")


def convex_hulls(points: DataFrame, key: str, x: str, y: str, parts: int = 64) -> DataFrame:
    """key, i, x, y: the corners of each key's convex hull, against the clock from the least point.

    A key's points are dealt to ``parts`` tasks, and the hull of the parts' hulls, which have few corners, is the
    hull of all. Points without a coordinate are left out.
    """
    kind = dict(points.dtypes)[key]
    dealt = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("key"), F.col(x).alias("x"), F.col(y).alias("y"), F.pmod(F.xxhash64(x, y), F.lit(parts)).alias("part"))
    some = dealt.groupBy("key", "part").applyInPandas(_hull, f"key {kind}, i int, x double, y double")
    return some.groupBy("key").applyInPandas(_hull, f"key {kind}, i int, x double, y double").withColumnRenamed("key", key)


def _hull(pdf):
    import pandas as pd

    pts = sorted(set(zip(pdf["x"], pdf["y"])))
    ring = []
    for order in (pts, pts[::-1]):
        chain: list = []
        for p in order:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        ring += chain[:-1]
    ring = ring or pts
    return pd.DataFrame({"key": [pdf["key"].iloc[0]] * len(ring), "i": range(len(ring)), "x": [p[0] for p in ring], "y": [p[1] for p in ring]})
