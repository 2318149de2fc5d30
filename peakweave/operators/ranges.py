"""Dealing the rows of a table by ranges of an order, so that running totals don't need one task for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampled rows for each bound, and ranges at most: bounds are compared by halves in one expression.
SAMPLE, MOST = 30, 2000


def with_range(rows: DataFrame, order: list[Column], name: str = "_part", buckets: int | None = None) -> DataFrame:
    """Adds the number of a row's range in the ascending order of the given expressions, from 0; every row of a range comes before every row of the next.

    Bounds are quantiles of a sample of ``SAMPLE`` rows a bucket (those of least hash, so that a row's range is the same whenever it is
    computed again). By default there are as many buckets as shuffle partitions, up to ``MOST``.
    """
    spark = rows.sparkSession
    buckets = min(MOST, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    sample = rows.select(key.alias("key")).orderBy(F.xxhash64("key"), "key").limit(SAMPLE * buckets).collect()
    kind = rows.select(key.alias("key")).schema["key"].dataType
    values = sorted((tuple(r["key"]) for r in sample), key=lambda t: [(x is not None, x) for x in t])
    bounds = sorted(set(values[k * len(values) // buckets] for k in range(1, buckets)), key=lambda t: [(x is not None, x) for x in t]) if values else []

    def bound(t: tuple) -> Column:
        return F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(t, kind.fields, strict=True)])

    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("_key") < bound(bounds[mid]), place(low, mid)).otherwise(place(mid + 1, high))

    return rows.withColumn("_key", key).withColumn(name, place(0, len(bounds))).drop("_key")
