"""String, path and number helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """What follows the last dot of the base name, in lower case; empty if none."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def without_extension(path: Column) -> Column:
    """The path up to the last dot of its base name."""
    return F.regexp_replace(path, r"\.[^./\\]*$", "")


def ranges(text: Column) -> Column:
    """"1-3,5" as [1, 2, 3, 5]."""
    parts = F.filter(F.split(F.regexp_replace(text, r"\s", ""), ","), lambda p: p != "")
    return F.flatten(F.transform(parts, lambda p: F.sequence(F.regexp_extract(p, r"^(\d+)", 1).cast("int"), F.regexp_extract(p, r"(\d+)$", 1).cast("int"))))


def round_to(x: Column, digits: int) -> Column:
    """Rounded half away from zero."""
    return F.round(x, digits)


def round_scaled(x: Column, digits: int) -> Column:
    """Rounded half away from zero after scaling in double precision, as SQL engines on doubles do: 0.63355 * 1e4 falls below 6335.5, so it gives 0.6335, where ``round_to`` goes by decimal digits (0.6336)."""
    scale = 10.0**digits
    return F.round(x * scale) / scale


def log_score(hit: Column, background: Column) -> Column:
    """Natural log of the ratio; null where either isn't positive."""
    return F.when((hit > 0) & (background > 0), F.log(hit / background))


def binomial_tail(k: int, n: int, p: float) -> float:
    """Probability of k or more of n."""
    from math import comb

    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


def combinations(rows: DataFrame, array_col: str, k: int) -> DataFrame:
    """One row per choice of k elements of an array, in order, as ``combination``; k is a small constant, 1 at least."""
    out = rows.withColumn("_at", F.array().cast("array<int>"))
    for _ in range(k):
        later = F.sequence(F.coalesce(F.try_element_at("_at", F.lit(-1)), F.lit(-1)) + 1, F.size(array_col))
        out = out.withColumn("_next", F.explode(F.filter(later, lambda i: i < F.size(array_col)))).withColumn("_at", F.array_append("_at", F.col("_next"))).drop("_next")
    return out.withColumn("combination", F.transform("_at", lambda i: F.get(array_col, i))).drop("_at")


def histogram(rows: DataFrame, value: str, width: float) -> DataFrame:
    """bin (floor of value / width) and count."""
    return rows.groupBy(F.floor(F.col(value) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
