"""Spectral libraries: filters, searches, decoys, maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakweave.operators.pairs import band_join


def filtered(library: DataFrame, fdr: float | None = None, p_value: float | None = None, envelope: float | None = None, annotations: list[str] | None = None, without_residues: str | None = None, charges: list[int] | None = None) -> DataFrame:
    """Entries with an annotation that pass all given thresholds; -1 turns one off."""
    out = library.filter(F.col("annotation").isNotNull() & (F.col("annotation") != ""))
    for name, most in (("fdr", fdr), ("p_value", p_value), ("envelope", envelope)):
        if most is not None and most != -1:
            out = out.filter(F.col(name) <= most)
    if annotations is not None:
        out = out.filter(F.col("annotation").isin(annotations))
    if without_residues:
        out = out.filter(~F.col("annotation").rlike(f"[{without_residues}]"))
    return out.filter(F.col("charge").isin(charges)) if charges else out


def candidates(queries: DataFrame, library: DataFrame, tolerance: float) -> DataFrame:
    """query, entry: pairs with parent m/z at most ``tolerance`` apart."""
    q = queries.select(F.col("spec_idx").alias("query"), F.col("parent_mz").alias("query_mz"))
    e = library.select(F.col("spec_idx").alias("entry"), F.col("parent_mz").alias("entry_mz"), *[c for c in ("is_decoy",) if c in library.columns])
    return band_join(q, e, "query_mz", "entry_mz", tolerance)


def scored(found: DataFrame, query_vectors: DataFrame, entry_vectors: DataFrame) -> DataFrame:
    """Adds dot and shared of candidates from binned vectors (spec_idx, bin, value); pairs that share no bin go."""
    a = query_vectors.select(F.col("spec_idx").alias("query"), "bin", F.col("value").alias("a"))
    b = entry_vectors.select(F.col("spec_idx").alias("entry"), "bin", F.col("value").alias("b"))
    keys = [c for c in found.columns]
    return found.join(a, "query").join(b, ["entry", "bin"]).groupBy(*keys).agg(F.sum(F.col("a") * F.col("b")).alias("dot"), F.count(F.lit(1)).alias("shared"))


def scored_candidates(queries: DataFrame, library: DataFrame, tolerance: float, query_vectors: DataFrame, entry_vectors: DataFrame) -> DataFrame:
    """What ``scored`` gives for ``candidates``, without a table of candidates: both sides take their bins along into the join by mass."""
    from peakweave.operators.pairs import bin_lists, with_bin_products

    q = queries.join(bin_lists(query_vectors), "spec_idx").select(F.col("spec_idx").alias("query"), F.col("parent_mz").alias("query_mz"), F.col("bins").alias("bins1"))
    e = library.join(bin_lists(entry_vectors), "spec_idx").select(F.col("spec_idx").alias("entry"), F.col("parent_mz").alias("entry_mz"), *[c for c in ("is_decoy",) if c in library.columns], F.col("bins").alias("bins2"))
    return with_bin_products(band_join(q, e, "query_mz", "entry_mz", tolerance), "dot")


def dot_bias(matches: DataFrame, query_vectors: DataFrame, entry_vectors: DataFrame) -> DataFrame:
    """Adds bias, the penalty of matches (query, entry, dot) whose similarity rests on few bins, or on too many alike.

    The bias itself is the root of the cosine of the vectors' fourth powers, divided by dot (see pairs.dot_bias_penalty).
    """
    from peakweave.operators.pairs import dot_bias_penalty

    fourth = F.pow("value", F.lit(4.0))
    side = lambda v, name, c: v.select(F.col("spec_idx").alias(name), "bin", (fourth / F.sqrt(F.sum(fourth * fourth).over(Window.partitionBy("spec_idx")))).alias(c))
    powers = matches.select("query", "entry").join(side(query_vectors, "query", "a"), "query").join(side(entry_vectors, "entry", "b"), ["entry", "bin"]).groupBy("query", "entry").agg(F.sum(F.col("a") * F.col("b")).alias("_c"))
    out = matches.join(powers, ["query", "entry"], "left")
    return out.withColumn("bias", dot_bias_penalty(F.sqrt(F.coalesce("_c", F.lit(0.0))) / F.col("dot"))).drop("_c")


def biased_classes(queries: DataFrame, library: DataFrame, tolerance: float, vectors: DataFrame, digits: int | None = None) -> DataFrame:
    """members1 (queries), members2 (entries), dot (rounded, if digits are given), shared and bias of ``dot_bias`` of candidates that share a bin.

    queries, library: parent_mz, node, members (see pairs.classes); vectors: spec_idx (a node), bin, value. Both sides take their bins and the fourth
    powers along into the join by mass, so no match is shuffled.
    """
    from peakweave.operators.pairs import dot_bias_penalty

    fourth = F.pow("value", F.lit(4.0))
    w = Window.partitionBy("spec_idx")
    both = vectors.withColumn("fourth", fourth / F.sqrt(F.sum(fourth * fourth).over(w)))
    bins = both.groupBy(F.col("spec_idx").alias("node")).agg(F.array_sort(F.collect_list(F.struct("bin", "value", "fourth"))).alias("bins"))
    side = lambda rows, n, name: rows.join(bins, "node").select(F.col("members").alias(f"members{n}"), F.col("parent_mz").alias(name), F.col("bins").alias(f"bins{n}"))
    found = band_join(side(queries, 1, "query_mz"), side(library, 2, "entry_mz"), "query_mz", "entry_mz", tolerance)
    products = F.flatten(F.transform("bins1", lambda x: F.transform(F.filter("bins2", lambda y: y["bin"] == x["bin"]), lambda y: F.struct((x["value"] * y["value"]).alias("v"), (x["fourth"] * y["fourth"]).alias("f")))))
    out = found.select("members1", "members2", products.alias("_x")).filter(F.size("_x") > 0)
    total = lambda f: F.aggregate("_x", F.lit(0.0), lambda s, v: s + v[f])
    dot = total("v") if digits is None else F.round(total("v"), digits)
    out = out.select("members1", "members2", dot.alias("dot"), F.size("_x").cast("long").alias("shared"), total("f").alias("_c"))
    return out.withColumn("bias", dot_bias_penalty(F.sqrt("_c") / F.col("dot"))).drop("_c")


def top_hits(matches: DataFrame, k: int, least_score: float = 0.0, least_shared: int = 1) -> DataFrame:
    """The k best entries of each query with their rank; ties to the smaller entry. The frame is cut per task before the shuffle."""
    kept = matches.filter((F.col("dot") >= least_score) & (F.col("shared") >= least_shared))
    w = Window.partitionBy("query").orderBy(F.desc("dot"), "entry")
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def target_decoy_winners(matches: DataFrame, bias: Column | None = None) -> DataFrame:
    """query, entry, is_decoy, dot, score: the winning side of each query; none where both sides are equal.

    score = 0.6 dot + 0.4 delta - bias (fixed weights), where delta is the lead over the second of its side and the best of the other, missing ones counting 0.
    """
    w = Window.partitionBy("query", "is_decoy").orderBy(F.desc("dot"), "entry")
    two = matches.withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    side = two.groupBy("query", "is_decoy").agg(F.max(F.when(F.col("_r") == 1, F.struct("dot", "entry"))).alias("x"), F.max(F.when(F.col("_r") == 2, F.col("dot"))).alias("second"))
    side = side.select("query", "is_decoy", F.col("x.dot").alias("dot"), F.col("x.entry").alias("entry"), F.coalesce("second", F.lit(0.0)).alias("second"))
    both = side.groupBy("query").agg(*[F.max(F.when(F.col("is_decoy") == d, F.struct("dot", "entry", "second"))).alias(n) for n, d in (("t", False), ("d", True))])
    t, d = (F.coalesce(F.col(f"{n}.dot"), F.lit(0.0)) for n in "td")
    out = both.filter(t != d).withColumn("is_decoy", d > t).withColumn("w", F.when(t > d, F.col("t")).otherwise(F.col("d"))).withColumn("other", F.least(t, d))
    score = 0.6 * F.col("w.dot") + 0.4 * (F.col("w.dot") - F.greatest("w.second", "other")) - (bias if bias is not None else F.lit(0.0))
    return out.select("query", F.col("w.entry").alias("entry"), "is_decoy", F.col("w.dot").alias("dot"), score.alias("score"))


def truncated(library: DataFrame, peaks: int = 500) -> DataFrame:
    """Entries with their strongest peaks only, and ``cut`` where some went."""
    from peakweave.operators.peaks import top_k

    return top_k(library.withColumn("cut", F.size("peaks") > peaks), peaks)


def removed(library: DataFrame, ids: DataFrame, key: str = "spec_idx") -> DataFrame:
    """Without the listed entries."""
    return library.join(ids.select(key), key, "left_anti")


def peak_statistics(library: DataFrame) -> DataFrame:
    """annotation, n, peaks (mean number), intensity (mean total)."""
    total = F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["intensity"])
    return library.groupBy("annotation").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("peaks")).alias("peaks"), F.avg(total).alias("intensity"))


def decoys(library: DataFrame, tolerance: float, seed: int = 1) -> DataFrame:
    """Shuffled entries: R, K and P stay, and peaks at b and y ions of the peptide move to those of its shuffle; other peaks stay."""
    from peakweave.functions import arrays as A
    from peakweave.functions import peptide as P

    old, new = P.ions(P.unmodified(F.col("annotation"))), P.ions(F.col("decoy"))
    out = library.withColumn("decoy", P.shuffled(F.col("annotation"), seed)).withColumn("_old", old).withColumn("_new", new)

    def moved(p: Column) -> Column:
        near = F.filter(F.transform("_old", lambda o, i: F.struct(F.abs(o["mz"] - p["mz"]).alias("d"), i.alias("i"))), lambda x: x["d"] <= tolerance)
        return F.coalesce(F.get("_new", F.array_min(near)["i"])["mz"], p["mz"])

    return out.withColumn("peaks", A.by_mz(A.map_peaks(F.col("peaks"), mz=moved))).withColumn("annotation", F.col("decoy")).withColumn("is_decoy", F.lit(True)).drop("decoy", "_old", "_new")


def substituted(library: DataFrame, source: str, target: str, tolerance: float) -> DataFrame:
    """Predicted spectra of the peptides with the first ``source`` residue replaced by ``target``: ions that hold it move by the mass difference."""
    from peakweave.functions import arrays as A
    from peakweave.functions import peptide as P

    changed = F.regexp_replace(F.col("annotation"), f"^([^{source}]*){source}", f"$1{target}")
    old, new = P.ions(F.col("annotation")), P.ions(F.col("_changed"))
    out = library.filter(F.col("annotation").contains(source)).withColumn("_changed", changed).withColumn("_old", old).withColumn("_new", new)

    def moved(p: Column) -> Column:
        near = F.filter(F.transform("_old", lambda o, i: F.struct(F.abs(o["mz"] - p["mz"]).alias("d"), i.alias("i"))), lambda x: x["d"] <= tolerance)
        return F.coalesce(F.get("_new", F.array_min(near)["i"])["mz"], p["mz"])

    return out.withColumn("peaks", A.by_mz(A.map_peaks(F.col("peaks"), mz=moved))).withColumn("annotation", F.col("_changed")).drop("_changed", "_old", "_new")
