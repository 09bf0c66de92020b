"""Joins of rows with one row for each key, where a key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1 / HOT of all rows is hot, so there are fewer than HOT of them whatever the input.
HOT = 1000


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], times: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key and the number of its rows in the column ``times``.

    Hot keys go to the rows by broadcast, at most HOT rows of the table; the others are shuffled. Both
    sides should be read from tables, since they are read twice. Rows with a null key find no partner.
    """
    total = table.agg(F.sum(times)).first()[0] or 0
    own = [c for c in rows.columns]
    more = [c for c in table.columns if c not in keys]
    limit = total // HOT
    hot = table.where(F.col(times) > limit)
    few = F.broadcast(hot)
    near = rows.join(few, keys).select(*own, *more)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(times) <= limit), keys).select(*own, *more)
    return near.unionByName(far)
