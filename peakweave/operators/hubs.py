"""Joins on keys of which some hold very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key from which its rows stay where they are and meet a broadcast row instead; at most one key in so many rows is such a hub.
HUB_ROWS = 500_000


def hub_join(left: DataFrame, right: DataFrame, key: str, count: str, rows: int | None = None, hub_rows: int = HUB_ROWS) -> DataFrame:
    """Inner join of left with right, which has one row a key and, in ``count``, the number of left rows with that key or more.

    Rows of keys beyond ``hub_rows`` aren't shuffled: the right rows of these, fewer than left's rows / ``hub_rows``, are broadcast.
    rows: a bound of the left rows of any key, if one is known; where it is no more than ``hub_rows`` there can be no hub, and the join is a plain one.
    """
    if rows is not None and rows <= hub_rows:
        return left.join(right.drop(count), key)
    values = [c for c in right.columns if c not in (key, count)]
    hubs = right.filter(F.col(count) > hub_rows).select(key, F.struct(*values).alias("__hub"))
    met = left.join(F.broadcast(hubs), key, "left")
    at_hub = met.filter("__hub IS NOT NULL").select(*left.columns, *[F.col(f"__hub.{c}").alias(c) for c in values])
    others = met.filter("__hub IS NULL").drop("__hub").join(right.filter(F.col(count) <= hub_rows).drop(count), key)
    return at_hub.unionByName(others.select(*at_hub.columns))
