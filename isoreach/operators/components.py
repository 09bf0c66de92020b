"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.functions.shared import through_table

#: Rows of a round's table of least neighbours that go out by broadcast, at most: about 16 MB.
SMALL = 500_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """node, component (the least node of its component), for every node of an edge.

    Each round links every node's larger neighbours to its least neighbour and then its smaller ones
    (large star, small star); the number of rounds grows with the logarithm of the longest path. Rounds
    are written to the shared folder; it is an error if they do not settle. While the links are few
    (counted), the least neighbours go to them by broadcast; many links are joined by shuffle. Loops and
    repeated edges are allowed, edges with a null end are ignored, and an empty table gives no rows.
    """
    clean = through_table(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null"), "edges")
    links = through_table(clean.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(links)
    for _ in range(max_rounds if mark[0] else 0):
        sent = F.broadcast if 2 * mark[0] <= SMALL else (lambda table: table)  # a link has two nodes
        up = links.select(F.col("v").alias("u"), F.col("u").alias("v"))  # u is the greater end of every link
        least = links.unionByName(up).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = up.join(sent(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sent(low), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        links = through_table(small, "links")
        now = _mark(links)
        if now == mark:
            break
        mark = now
    else:
        if mark[0]:
            raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    root = links.select(F.col("u").alias("node"), F.col("v").alias("component"))  # one link a node, now that nothing changes
    nodes = clean.select(F.col("u").alias("node")).union(clean.select("v")).distinct()
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _mark(links: DataFrame) -> tuple:
    """Count and hash sum: equal for equal links."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
