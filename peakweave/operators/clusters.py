"""Clusters of spectra: summaries, details, purity, medoids, and clustering itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakweave.functions.arrays import PROTON
from peakweave.operators import pairs as J
from peakweave.operators.components import connected_components
from peakweave.session import written


def summary(members: DataFrame, groups: list[str], group_col: str = "group") -> DataFrame:
    """cluster_idx, n_spectra, sum_intensity and a count for each file group."""
    count = [F.sum(F.when(F.col(group_col) == g, 1).otherwise(0)).alias(f"n_{g.lower()}") for g in groups]
    return members.groupBy("cluster_idx").agg(F.count(F.lit(1)).alias("n_spectra"), F.sum("precursor_intensity").alias("sum_intensity"), *count)


def parent_mz(charge: Column, mass: Column) -> Column:
    """m/z of a singly charged mass at a charge; the mass itself for charge 0."""
    return F.when(charge > 0, (mass + (charge - 1) * PROTON) / charge).otherwise(mass)


def detail(members: DataFrame, spectra: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Member rows with attributes of their spectra, null where the spectrum is missing."""
    return members.join(spectra.select(*keys, *columns), keys, "left")


def purity(members: DataFrame, annotation: str = "annotation") -> DataFrame:
    """cluster_idx, n, n_identified, representative, n_representative, purity (of the identified): the representative is the commonest annotation, ties to the first by name; parts of mixtures, joined by '!', count each."""
    each = members.select("cluster_idx", F.explode_outer(F.split(annotation, "!")).alias("a"))
    votes = each.filter("a IS NOT NULL").groupBy("cluster_idx", "a").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("cluster_idx").agg(F.min_by(F.struct("a", "n"), F.struct((-F.col("n")).alias("m"), "a")).alias("x"))
    total = members.groupBy("cluster_idx").agg(F.count(F.lit(1)).alias("n"), F.count(annotation).alias("n_identified"))
    out = total.join(best, "cluster_idx", "left")
    return out.select("cluster_idx", "n", "n_identified", F.col("x.a").alias("representative"), F.coalesce("x.n", F.lit(0)).alias("n_representative"), F.when(F.col("n_identified") > 0, F.col("x.n") / F.col("n_identified")).alias("purity"))


def medoids(vectors: DataFrame, group: str, id_col: str, vector_col: str, parts: int = 16) -> DataFrame:
    """group, id, total: of each group the row with the largest sum of cosines to all of it, ties to the smaller id.

    The sum of cosines to a group is the dot product with the sum of its unit vectors, so no pairs are formed; that sum is taken over
    salted parts of the group, element by element, and is one short row a group.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    v = F.transform(vector_col, lambda x: x.cast("double"))
    rows = vectors.select(F.col(group).alias("g"), F.col(id_col).alias("id"), v.alias("v")).withColumn("n", F.sqrt(dot(F.col("v"), F.col("v")))).filter("n > 0")
    units = rows.select("g", "id", F.transform("v", lambda x: x / F.col("n")).alias("u"))
    sums = units.select("g", F.posexplode("u")).groupBy("g", "pos").agg(F.sum("col").alias("s")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("xs"))
    sums = sums.select("g", F.transform("xs", lambda x: x["s"]).alias("t"))
    total = units.join(sums, "g").select("g", "id", F.round(dot(F.col("u"), F.col("t")), 9).alias("total"))
    best = total.groupBy("g").agg(F.min_by(F.struct("id", "total"), F.struct((-F.col("total")).alias("m"), "id")).alias("x"))
    return best.select(F.col("g").alias(group), F.col("x.id").alias(id_col), F.col("x.total").alias("total"))


def cosine_clusters(spectra: DataFrame, width: float, tolerance: float, core: float = 0.7, matched: int = 5) -> DataFrame:
    """spec_idx, cluster_idx: components of spectra of neighbouring mass with a cosine of at least ``core`` over ``matched`` peaks; the rest are clusters of their own.

    Equal spectra are compared with others as one, so copies cost a row each and no pairs.
    """
    lists = spectra.filter("parent_mass IS NOT NULL").groupBy("parent_mass", "peaks").agg(F.array_sort(F.collect_list("spec_idx")).alias("ids"))
    lists = written(lists.withColumn("node", F.get("ids", F.lit(0))), "clusters")
    # members of a class are one node if they link to each other; otherwise each is a node
    self = lists.filter(F.size("ids") > 1).select("node", F.col("peaks").alias("peaks1"), F.col("peaks").alias("peaks2"), F.lit(0.0).alias("shift"))
    solid = J.similar(self, tolerance, core, matched).select("node", F.lit(True).alias("_s"))
    known = lists.join(solid, "node", "left").withColumn("ids", F.when(F.col("_s"), F.array("ids")).otherwise(F.transform("ids", lambda x: F.array(x))))
    nodes = written(known.select("parent_mass", "peaks", F.explode("ids").alias("ids")), "clusters")
    ends = nodes.select("parent_mass", "peaks", F.array(F.get("ids", F.lit(0)), F.element_at("ids", -1)).alias("members"))
    met = J.class_pairs(ends, width, ["peaks"]).filter(F.get("members1", F.lit(0)) != F.get("members2", F.lit(0)))
    edges = J.similar(met.select(F.get("members1", F.lit(0)).alias("spec1"), F.get("members2", F.lit(0)).alias("spec2"), "shift", "peaks1", "peaks2"), tolerance, core, matched)
    named = connected_components(edges, "spec1", "spec2")
    of = nodes.select(F.explode("ids").alias("_id"), F.get("ids", F.lit(0)).alias("_rep"))
    out = spectra.select("spec_idx").join(of, F.col("spec_idx") == F.col("_id"), "left").join(named, F.col("_rep") == F.col("node"), "left")
    return out.select("spec_idx", F.coalesce("component", "_rep", "spec_idx").alias("cluster_idx"))


def dissimilar_tops(edges: DataFrame, k: int, tolerance: float, most: int) -> DataFrame:
    """Edges (with peaks1, peaks2) of which at most ``most`` of the first spectrum's k strongest peaks lack a counterpart among the second's."""
    top = lambda c: F.slice(F.reverse(F.array_sort(F.transform(c, lambda p: F.struct(p["intensity"].alias("i"), p["mz"].alias("mz"))))), 1, k)
    lone = F.size(F.filter(top("peaks1"), lambda p: ~F.exists(top("peaks2"), lambda q: F.abs(p["mz"] - q["mz"]) <= tolerance)))
    return edges.filter(lone <= most)


def redundant(members: DataFrame) -> DataFrame:
    """Adds ``rank`` of a cluster's members by precursor intensity, largest first, ties by scan."""
    return members.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_idx").orderBy(F.desc("precursor_intensity"), "scan")))
