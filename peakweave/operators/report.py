"""Report tables: filter, find, sort, page, update; and grouped statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where(table: DataFrame, **equal) -> DataFrame:
    """Rows whose columns have the given values, one to any number of them."""
    for c, v in equal.items():
        table = table.filter(F.col(c) == v)
    return table


def distinct_first(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    rest = [c for c in table.columns if c not in keys]
    best = table.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return best.select(*keys, *[F.col("x")[c].alias(c) for c in rest])


def page(table: DataFrame, sort: str | None = None, descending: bool = False, start: int = 0, rows: int = -1, tiebreak: list[str] | None = None) -> DataFrame:
    """Rows from ``start``, -1 for all, sorted by a column read as whole numbers; what isn't one sorts as 0."""
    if sort:
        number = F.coalesce(F.expr(f"try_cast(regexp_extract(cast(`{sort}` as string), '^-?[0-9]+', 0) as bigint)"), F.lit(0))
        table = table.orderBy(number.desc() if descending else number.asc(), *(tiebreak or []))
    if start:
        table = table.offset(start)
    return table if rows < 0 else table.limit(rows)


def find(table: DataFrame, column: str, value, order: list[str]) -> DataFrame:
    """The first row with the value."""
    return table.filter(F.col(column) == value).orderBy(*order).limit(1)


def update(table: DataFrame, changes: dict[str, object], **equal) -> DataFrame:
    """The table with columns set where others have the given values."""
    test: Column = F.lit(True)
    for c, v in equal.items():
        test = test & (F.col(c) == v)
    return table.select(*[F.when(test, F.lit(changes[c])).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns])


def per_key_and_all(table: DataFrame, key: str, *measures: Column, everything: object = -1) -> DataFrame:
    """Measures for each key and, under ``everything``, for the whole table."""
    kind = table.schema[key].dataType
    out = table.rollup(key).agg(F.grouping(key).alias("_g"), *measures)
    return out.withColumn(key, F.when(F.col("_g") == 1, F.lit(everything).cast(kind)).otherwise(F.col(key))).drop("_g")


def share(condition: Column) -> Column:
    """Percent of rows where it holds."""
    return 100.0 * F.avg(condition.cast("double"))


def lists(table: DataFrame, key: str, column: str, separator: str = ",") -> DataFrame:
    """key, n, list: distinct values in order, joined."""
    return table.groupBy(key).agg(F.countDistinct(column).alias("n"), F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), separator).alias("list"))


def numbered(table: DataFrame, order: list[str], within: list[str]) -> DataFrame:
    """Adds ``row_no`` from 1 within each group."""
    return table.withColumn("row_no", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
