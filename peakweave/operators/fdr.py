"""Target-decoy statistics: best match per key, cumulative rates, q-values and cutoffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakweave.operators.ranges import with_range


def top_hit(psms: DataFrame, keys: list[str], score: str = "score", tiebreak: list[str] | None = None, ascending: bool = False) -> DataFrame:
    """The best row of each key; ties go to the first in ``tiebreak`` order.

    Stated as max_by over a struct, so each task reduces its own rows before the shuffle and a key
    with very many rows costs no more than any other.
    """
    value = F.col(score) if ascending else -F.col(score)
    order = F.struct(value.isNull().alias("n"), value.alias("v"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(tiebreak or [])])
    rest = [c for c in psms.columns if c not in keys]
    best = psms.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("best"))
    return best.select(*keys, *[F.col("best")[c].alias(c) for c in rest]).select(*psms.columns)


def merge_target_decoy(targets: DataFrame, decoys: DataFrame, keys: list[str], score: str = "score", tiebreak: list[str] | None = None) -> DataFrame:
    """Best of both searches for each key; a target wins a tie with a decoy."""
    both = targets.withColumn("is_decoy", F.lit(False)).unionByName(decoys.withColumn("is_decoy", F.lit(True)))
    return top_hit(both, keys, score, ["is_decoy", *(tiebreak or [])])


def cumulative_fdr(psms: DataFrame, partition: list[str] | None = None, score: str = "score", tiebreak: list[str] | None = None, scale: float = 1.0, buckets: int | None = None, autoscale: bool = False) -> DataFrame:
    """Adds raw_fdr (decoys * scale / targets so far, at most 1, and 1 before the first target) and fdr (its running minimum from the end), for each value of ``partition`` or over all.

    autoscale: scale is targets / decoys of the partition; partitions without decoys go.

    A window over all rows, or over a few large partitions, would send them to a few tasks. Instead rows are dealt by ranges of partition and score;
    each stretch of a range counts and minimises on its own, and totals of the stretches before (minima of those behind) are joined back: as many rows
    as there are ranges and partitions.
    """
    bins = list(partition or [])
    tie = [F.col(c) for c in tiebreak or []]
    one = F.col("is_decoy").cast("long")
    dealt = with_range(psms, [*map(F.col, bins), -F.col(score), *tie], "_part", buckets)
    keys = ["_part", *bins]
    sizes = dealt.groupBy(*keys).agg(F.sum(one).alias("_pd"), F.sum(1 - one).alias("_pt"))
    whole = Window.partitionBy(*bins) if bins else Window.partitionBy(F.lit(0))
    ahead = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sizes = sizes.select(*keys, F.coalesce(F.sum("_pd").over(ahead), zero).alias("_bd"), F.coalesce(F.sum("_pt").over(ahead), zero).alias("_bt"), F.sum("_pd").over(whole).alias("_nd"), F.sum("_pt").over(whole).alias("_nt"))
    if autoscale:
        sizes = sizes.filter("_nd > 0")
    factor = F.col("_nt") / F.col("_nd") if autoscale else F.lit(float(scale))
    out = dealt.join(sizes if bins else F.broadcast(sizes), keys)  # without partitions, one row a range
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *tie).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_d", F.col("_bd") + F.sum(one).over(w)).withColumn("_t", F.col("_bt") + F.sum(1 - one).over(w))
    out = out.withColumn("raw_fdr", F.when(F.col("_t") == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("_d") * factor / F.col("_t"))))
    # frames that end with the partition are evaluated anew for each row; the reverse order's frames that begin with it aren't
    back = Window.partitionBy(*keys).orderBy(F.asc(score), *[F.desc(c) for c in tiebreak or []]).rowsBetween(Window.unboundedPreceding, 0)
    lows = out.groupBy(*keys).agg(F.min("raw_fdr").alias("_low"))
    behind = whole.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    lows = lows.select(*keys, F.min("_low").over(behind).alias("_after"))
    out = out.join(lows if bins else F.broadcast(lows), keys)
    out = out.withColumn("fdr", F.least(F.min("raw_fdr").over(back), F.coalesce("_after", F.lit(1.0))))
    return out.select(*psms.columns, "raw_fdr", "fdr")


def prefix_cutoff(rated: DataFrame, threshold: float, keep_first: bool = False, score: str = "score", tiebreak: list[str] | None = None) -> DataFrame:
    """Rows up to the last whose fdr passes. fdr never falls along the order, so that prefix is a filter.

    keep_first also keeps the best row where nothing passes.
    """
    if not keep_first:
        return rated.filter(F.col("fdr") <= threshold)
    order = F.struct((-F.col(score)).alias("v"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(tiebreak or [])])
    first = rated.groupBy().agg(F.min(order).alias("_first"))
    return rated.filter((F.col("fdr") <= threshold) | (order == first.scalar()))


def split_fdr(psms: DataFrame, bins: list[str], score: str = "score", tiebreak: list[str] | None = None, autoscale: bool = False) -> DataFrame:
    """Each bin rated on its own; a bin without decoys is dropped. autoscale: scale = targets / decoys of the bin."""
    if autoscale:
        return cumulative_fdr(psms, bins, score, tiebreak, autoscale=True)
    some = psms.filter("is_decoy").select(*bins).distinct()
    return cumulative_fdr(psms.join(some, bins, "left_semi").select(*psms.columns), bins, score, tiebreak)


def remove_decoys(psms: DataFrame) -> DataFrame:
    """Target rows only."""
    return psms.filter(~F.col("is_decoy"))


def protein_level(psms: DataFrame, threshold: float, score: str = "score", tiebreak: list[str] | None = None, decoy_prefix: str = "XXX") -> DataFrame:
    """Matches of proteins that pass at protein level, and of their decoy counterparts."""
    best = top_hit(psms, ["protein"], score, tiebreak)
    passing = prefix_cutoff(cumulative_fdr(best, None, score, tiebreak), threshold).filter(~F.col("is_decoy"))
    names = passing.select("protein").union(passing.select(F.concat(F.lit(decoy_prefix), F.col("protein")))).distinct()
    return psms.join(names, "protein", "left_semi").select(*psms.columns)
