"""Operators on sets of spectra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakweave.operators.ranges import with_range
from peakweave.session import written


def at_least_peaks(spectra: DataFrame, n: int, empty: bool = False) -> DataFrame:
    """Spectra with at least n peaks; with ``empty``, the others stay without peaks."""
    enough = F.size("peaks") >= n
    return spectra.withColumn("peaks", F.when(enough, F.col("peaks")).otherwise(F.slice("peaks", 1, 0))) if empty else spectra.filter(enough)


def of_kind(spectra: DataFrame, *frag_types: str) -> DataFrame:
    """Spectra of the given fragmentation types."""
    return spectra.filter(F.col("frag_type").isin(*frag_types))


def of_charge(spectra: DataFrame, charges: str, empty: bool = True) -> DataFrame:
    """Spectra of charges such as "1-3,5"; the others stay without peaks, or go."""
    keep = [c for part in charges.split(",") for c in range(int(part.split("-")[0]), int(part.split("-")[-1]) + 1)]
    ok = F.col("charge").isin(keep)
    return spectra.withColumn("peaks", F.when(ok, F.col("peaks")).otherwise(F.slice("peaks", 1, 0))) if empty else spectra.filter(ok)


def renumbered(spectra: DataFrame, order: list[str], column: str = "scan", buckets: int | None = None) -> DataFrame:
    """Consecutive numbers from 1 in the given order, by ranges: each range counts its own rows, and the sizes of those before it are added."""
    dealt = with_range(spectra, [F.col(c) for c in order], "_part", buckets)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(sizes), "_part").withColumn(column, own + F.col("_before")).drop("_part", "_before")


def append(*sets: DataFrame) -> DataFrame:
    """All rows of all sets, with set_no from 0; columns that a set lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("set_no", F.lit(n)) for n, s in enumerate(sets)])


def weave(*sets: DataFrame, order: str = "spec_idx") -> DataFrame:
    """Round robin: the first spectrum of each set, then the second, ... numbered in ``position`` from 1."""
    ranked = append(*[renumbered(s, [order], "local_idx") for s in sets])
    return renumbered(ranked, ["local_idx", "set_no"], "position")


def merged_peaks(spectra: DataFrame, group: list[str]) -> DataFrame:
    """One spectrum per group: all peaks together in m/z order, those of exactly one m/z summed; ``n_merged`` counts spectra."""
    peaks = spectra.select(*group, F.inline("peaks"))
    summed = peaks.groupBy(*group, "mz").agg(F.sum("intensity").alias("intensity"), F.max("tol").alias("tol"))
    lists = summed.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("mz", "intensity", "tol"))).alias("peaks"))
    return lists.join(spectra.groupBy(*group).agg(F.count(F.lit(1)).alias("n_merged")), group)


def consecutive_blocks(spectra: DataFrame, n: int, order: str = "spec_idx") -> DataFrame:
    """Merges each spectrum with the next n: blocks of n + 1 in the given order."""
    numbered = renumbered(spectra, [order], "_no")
    return merged_peaks(numbered.withColumn("block", F.floor((F.col("_no") - 1) / (n + 1)).cast("long")), ["block"])


def parallel(*sets: DataFrame, order: str = "spec_idx") -> DataFrame:
    """Merges the spectra of the same position in each set."""
    return merged_peaks(written(append(*[renumbered(s, [order], "position") for s in sets]), "sets"), ["position"])  # read for peaks and for numbers


def runs(spectra: DataFrame, partition: list[str], order: list[str], value: str, longest: int | None = None) -> DataFrame:
    """Adds ``run``: consecutive spectra of equal ``value`` share a number; a run longer than ``longest`` is cut into pieces of it."""
    w = Window.partitionBy(*partition).orderBy(*order)
    fresh = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    out = spectra.withColumn("_f", fresh).withColumn("run", F.sum("_f").over(w).cast("long"))
    if longest:
        place = F.row_number().over(Window.partitionBy(*partition, "run").orderBy(*order)) - 1
        out = out.withColumn("_f", F.when(place % longest == 0, 1).otherwise(0)).withColumn("run", F.sum("_f").over(w).cast("long"))
    return out.drop("_f")


def last_ms1(spectra: DataFrame, order: list[str], partition: list[str], columns: list[str]) -> DataFrame:
    """Each spectrum above level 1 with columns of the latest level-1 spectrum before it (prefix ms1_)."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.last(F.when(F.col("ms_level") == 1, F.col(c)), ignorenulls=True).over(w).alias(f"ms1_{c}") for c in columns]
    return spectra.select("*", *carried).filter("ms_level > 1")


def mass_histogram(spectra: DataFrame, resolution: float = 0.1) -> DataFrame:
    """bin (rounded parent mass / resolution), n, members (spec_idx, ascending)."""
    return spectra.groupBy(F.round(F.col("parent_mass") / resolution).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("spec_idx")).alias("members"))


def average_intensity(spectra: DataFrame) -> DataFrame:
    """One row: the mean intensity of all peaks, and their number."""
    return spectra.select(F.inline("peaks")).agg(F.avg("intensity").alias("average"), F.count(F.lit(1)).alias("n"))


def parts(spectra: DataFrame, n: int, key: str = "spec_idx") -> DataFrame:
    """Adds ``part`` from 0 to n - 1, of nearly equal sizes, by the key's hash."""
    return spectra.withColumn("part", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def differences(a: DataFrame, b: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """Rows that only one table has (side: first or second), numbers compared to so many digits."""
    def rounded(df: DataFrame) -> DataFrame:
        return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])

    x, y = rounded(a), rounded(b.select(*a.columns))
    return x.exceptAll(y).withColumn("side", F.lit("first")).unionByName(y.exceptAll(x).withColumn("side", F.lit("second")))


def extracted(spectra: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The listed spectra with the list's other columns."""
    return spectra.join(wanted, keys)


def updated(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with changed rows in place of those of the same key, and new ones added."""
    return table.join(changes.select(*keys), keys, "left_anti").select(*table.columns).unionByName(changes.select(*table.columns))
