"""Library searches scored by distributions: how far a replicate's ions stray from the library's, and so how likely a cosine is."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakweave.functions import peptide as P
from peakweave.operators import kernels
from peakweave.operators.library import candidates
from peakweave.operators.sequencing import annotated_peaks
from peakweave.session import ship

#: Bands of relative intensity, buckets of log2 ratios and their range. Fixed values.
BANDS, BUCKETS, LOWEST, HIGHEST = 10, 200, -4.0, 4.0


def ion_vectors(spectra: DataFrame, tolerance: float) -> DataFrame:
    """spec_idx, ion, number, value, relative: roots of the intensities at the ions of ``annotation`` (the strongest peak of each), scaled to length 1, and as a share of the largest."""
    at = annotated_peaks(spectra, tolerance).select("spec_idx", "ion", "number", "mz")
    peaks = spectra.select("spec_idx", F.inline("peaks")).groupBy("spec_idx", "mz").agg(F.max("intensity").alias("intensity"))
    found = at.join(peaks, ["spec_idx", "mz"]).filter("intensity > 0").withColumn("value", F.sqrt("intensity"))
    w = Window.partitionBy("spec_idx")
    found = found.withColumn("value", F.col("value") / F.sqrt(F.sum(F.col("value") * F.col("value")).over(w)))
    return found.select("spec_idx", "ion", "number", "value", (F.col("value") / F.max("value").over(w)).alias("relative"))


def trained(replicates: DataFrame, consensus: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(ratios, losses) of replicate spectra against the library entry of their annotation and charge.

    ratios: band, bucket, n: log2 of replicate over entry at ions that both have, by the entry's relative intensity; buckets of equal width, outer ones
    open. losses: band, lost, kept: entry ions that the replicate lacks or has. Both have at most BANDS * BUCKETS rows.
    """
    keys = ["annotation", "charge"]
    pairs = replicates.select(F.col("spec_idx").alias("replicate"), *keys).join(consensus.select(F.col("spec_idx").alias("entry"), *keys), keys).select("replicate", "entry")
    own = ion_vectors(consensus, tolerance).select(F.col("spec_idx").alias("entry"), "ion", "number", F.col("value").alias("e"), "relative")
    seen = ion_vectors(replicates, tolerance).select(F.col("spec_idx").alias("replicate"), "ion", "number", F.col("value").alias("r"))
    both = pairs.join(own, "entry").join(seen, ["replicate", "ion", "number"], "left")
    both = both.withColumn("band", F.floor(F.least("relative", F.lit(0.999999)) * BANDS).cast("int"))
    step = (HIGHEST - LOWEST) / BUCKETS
    bucket = F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor((F.log2(F.col("r") / F.col("e")) - LOWEST) / step))).cast("int")
    ratios = both.filter("r IS NOT NULL").groupBy("band", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    losses = both.groupBy("band").agg(F.sum(F.when(F.col("r").isNull(), 1).otherwise(0)).alias("lost"), F.count("r").alias("kept"))
    return ratios, losses


def model(ratios: DataFrame, losses: DataFrame, points: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(factors, their probabilities by band, probability of a loss by band): the histograms thinned to ``points`` factors. A band that training never saw keeps every ion as it is."""
    step = (HIGHEST - LOWEST) / BUCKETS
    n = np.zeros((BANDS, BUCKETS))
    for r in ratios.collect():  # BANDS * BUCKETS rows at most
        n[r["band"], r["bucket"]] = r["n"]
    loss = np.zeros(BANDS)
    for r in losses.collect():
        loss[r["band"]] = r["lost"] / (r["lost"] + r["kept"])
    thin = n.reshape(BANDS, points, -1)
    centre = LOWEST + step * (np.arange(BUCKETS) + 0.5)
    total = thin.sum(2)
    mean = np.where(total > 0, (thin * centre.reshape(points, -1)).sum(2) / np.maximum(total, 1), 0.0)
    share = np.where(total.sum(1, keepdims=True) > 0, total / np.maximum(total.sum(1, keepdims=True), 1), np.eye(points)[0])
    return 2.0**mean, share, loss


def score_distributions(consensus: DataFrame, factors: np.ndarray, shares: np.ndarray, loss: np.ndarray, tolerance: float, bins: int = 50) -> DataFrame:
    """spec_idx and below: for cosines from 0 to 1 in ``bins`` steps, the probability that a replicate of the entry has a smaller one."""
    ship(consensus.sparkSession)
    rows = ion_vectors(consensus, tolerance).withColumn("band", F.floor(F.least("relative", F.lit(0.999999)) * BANDS).cast("int"))
    lists = rows.groupBy("spec_idx").agg(F.array_sort(F.collect_list(F.struct("ion", "number", "value", "band"))).alias("x"))
    # few bytes, but much work: all tasks get a share
    lists = lists.repartition(int(consensus.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    @F.pandas_udf("array<double>")
    def spread(values: pd.Series, bands: pd.Series) -> pd.Series:
        return pd.Series([kernels.cosine_distribution(np.asarray(v, float), np.asarray(b, int), factors, shares, loss, bins).tolist() for v, b in zip(values, bands, strict=True)])

    return lists.select("spec_idx", spread(F.col("x")["value"], F.col("x")["band"]).alias("below"))


def searched(queries: DataFrame, library: DataFrame, below: DataFrame, mz_tolerance: float, tolerance: float) -> DataFrame:
    """query, entry, is_decoy, cosine, explained, score of candidates by parent m/z and charge: the share of replicates with a smaller cosine, times the share of the query's intensity at the entry's ions.

    The cosine is over the entry's ions, on roots of intensities. Queries of charge 0 meet every charge.
    """
    found = candidates(queries, library, mz_tolerance).select("query", "entry", "is_decoy")
    q = queries.select(F.col("spec_idx").alias("query"), "peaks", F.col("charge").alias("query_charge"))
    e = library.select(F.col("spec_idx").alias("entry"), "annotation", F.col("charge").alias("entry_charge"))
    met = found.join(q, "query").join(e, "entry").filter("query_charge = 0 OR query_charge = entry_charge")
    total = F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["intensity"])
    ions = met.select("query", "entry", "is_decoy", "peaks", total.alias("total"), F.inline(P.ions(F.col("annotation"))))
    top = F.array_max(F.transform(F.filter("peaks", lambda p: F.abs(p["mz"] - F.col("mz")) <= tolerance), lambda p: p["intensity"]))
    own = ion_vectors(library, tolerance).select(F.col("spec_idx").alias("entry"), "ion", "number", F.col("value").alias("e"))
    at = ions.withColumn("i", F.coalesce(top, F.lit(0.0))).join(own, ["entry", "ion", "number"], "left")
    dot = F.sum(F.sqrt("i") * F.coalesce("e", F.lit(0.0)))
    sums = at.groupBy("query", "entry", "is_decoy").agg(F.when(F.sum("i") > 0, dot / F.sqrt(F.sum("i"))).otherwise(0.0).alias("cosine"), F.when(F.max("total") > 0, F.least(F.lit(1.0), F.sum("i") / F.max("total"))).otherwise(0.0).alias("explained"))
    place = F.least(F.size("below"), F.greatest(F.lit(1), F.floor(F.col("cosine") * (F.size("below") - 1)).cast("int") + 1))
    scored = sums.join(below.select(F.col("spec_idx").alias("entry"), "below"), "entry")
    return scored.select("query", "entry", "is_decoy", "cosine", "explained", (F.element_at("below", place) * F.col("explained")).alias("score"))


def shared_tags(query_tags: DataFrame, entry_tags: DataFrame, tolerance: float, least: int = 1) -> DataFrame:
    """query, entry, shared: pairs with at least so many tags of the same letters and about the same mass before them; both tables have spec_idx, tag, before."""
    from peakweave.operators.pairs import band_join

    a = query_tags.select(F.col("spec_idx").alias("query"), "tag", F.col("before").alias("query_before"))
    b = entry_tags.select(F.col("spec_idx").alias("entry"), "tag", F.col("before").alias("entry_before"))
    return band_join(a, b, "query_before", "entry_before", tolerance, on=["tag"]).groupBy("query", "entry").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)
