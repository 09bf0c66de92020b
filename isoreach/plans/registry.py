"""The named queries and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from isoreach.plans.views import SQL_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a ``Views`` as a query; views that the SQL names are put before it."""

    def take(f):
        from isoreach.plans.views import Views

        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return f

    return take


def with_views(sql: str) -> str:
    used = [v for v in SQL_VIEWS if re.search(rf"\b{v}\b", sql)]
    more = True
    while more:
        more = False
        for v in SQL_VIEWS:
            if v not in used and any(re.search(rf"\b{v}\b", SQL_VIEWS[u]) for u in used):
                used.append(v)
                more = True
    used = [v for v in SQL_VIEWS if v in used]
    body = sql.strip()
    if not used:
        return body
    ctes = ", ".join(f"{v} AS ({SQL_VIEWS[v].strip()})" for v in used)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"
