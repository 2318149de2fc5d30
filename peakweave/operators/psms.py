"""Operators on peptide-spectrum matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakweave.functions import peptide as P
from peakweave.operators.proteins import heads
from peakweave.session import written

#: Matches, or proteins, that one row of equal ones carries at most.
MEMBERS = 1024


def select(psms: DataFrame, charge: int | None = None, tryptic: int | None = None, first_scan: int | None = None, last_scan: int | None = None, p_value: float | None = None) -> DataFrame:
    """Matches of a charge, with at least so many tryptic ends, in a range of scans, of at most a p-value."""
    tests = [
        F.col("charge") == charge if charge is not None else None,
        P.tryptic_ends(F.col("annotation")) >= tryptic if tryptic is not None else None,
        F.col("scan") >= first_scan if first_scan is not None else None,
        F.col("scan") <= last_scan if last_scan is not None else None,
        F.col("p_value") <= p_value if p_value is not None else None,
    ]
    for t in tests:
        if t is not None:
            psms = psms.filter(t)
    return psms


def subtract(psms: DataFrame, other: DataFrame, invert: bool = False, keys: tuple[str, ...] = ("scan",)) -> DataFrame:
    """Matches whose key ``other`` doesn't have; inverted, those whose key it has."""
    return psms.join(other.select(*keys).distinct(), list(keys), "left_semi" if invert else "left_anti").select(*psms.columns)


def attach(psms: DataFrame, spectra: DataFrame, keys: tuple[str, ...] = ("file_idx", "scan")) -> DataFrame:
    """Matches with the columns of their spectra."""
    return psms.join(spectra, list(keys))


def without_match(spectra: DataFrame, psms: DataFrame, keys: tuple[str, ...] = ("file_idx", "scan")) -> DataFrame:
    """Spectra that have no match."""
    return spectra.join(psms.select(*keys).distinct(), list(keys), "left_anti").select(*spectra.columns)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """scan, first, second (annotations, '---' where missing), same (folded I/L and Q/K), same_mods: full outer by scan; one match a scan in each."""
    left = a.select("scan", F.col("annotation").alias("first"))
    right = b.select("scan", F.col("annotation").alias("second"))
    both = left.join(right, "scan", "full_outer")
    both = both.select("scan", F.coalesce("first", F.lit("---")).alias("first"), F.coalesce("second", F.lit("---")).alias("second"))
    found = (F.col("first") != "---") & (F.col("second") != "---")
    same = found & (P.folded(F.col("first")) == P.folded(F.col("second")))
    mods = lambda c: F.array_sort(F.transform(P.modifications(F.col(c)), lambda m: m["mass"]))
    return both.select("*", same.alias("same"), (found & (mods("first") == mods("second"))).alias("same_mods"))


def sequence_match(a: Column, b: Column) -> Column:
    """Percent of positions that agree after the best alignment: 100 * (1 - edit distance / longer length)."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 100.0 * (1 - F.levenshtein(a, b) / longest)).otherwise(100.0)


def consensus(psms: DataFrame, members: DataFrame, keys: tuple[str, ...] = ("file_idx", "scan")) -> DataFrame:
    """cluster_idx, annotation, votes, p_value, scan: of each cluster the annotation with most votes (then the better p-value, then by name), at its best match."""
    hits = psms.select(*keys, "annotation", "p_value").join(members.select(*keys, "cluster_idx"), list(keys))
    votes = hits.groupBy("cluster_idx", "annotation").agg(F.count(F.lit(1)).alias("votes"), F.min("p_value").alias("p_value"), F.min_by("scan", F.struct("p_value", "scan")).alias("scan"))
    best = votes.groupBy("cluster_idx").agg(F.min_by(F.struct("annotation", "votes", "p_value", "scan"), F.struct((-F.col("votes")).alias("v"), "p_value", "annotation")).alias("x"))
    return best.select("cluster_idx", "x.*")


def consensus_compat(psms: DataFrame, members: DataFrame, keys: tuple[str, ...] = ("file_idx", "scan")) -> DataFrame:
    """As consensus, but annotations are taken in alphabetical order, and a later one replaces the held one if it has more votes or a better p-value."""
    hits = psms.select(*keys, "annotation", "p_value").join(members.select(*keys, "cluster_idx"), list(keys))
    votes = hits.groupBy("cluster_idx", "annotation").agg(F.count(F.lit(1)).alias("votes"), F.min("p_value").alias("p_value"), F.min_by("scan", F.struct("p_value", "scan")).alias("scan"))
    lists = votes.groupBy("cluster_idx").agg(F.array_sort(F.collect_list(F.struct("annotation", "votes", "p_value", "scan"))).alias("xs"))
    held = F.aggregate(F.slice("xs", 2, 1 << 30), F.element_at("xs", 1), lambda a, x: F.when((x["votes"] > a["votes"]) | (x["p_value"] < a["p_value"]), x).otherwise(a))
    return lists.select("cluster_idx", held.alias("x")).select("cluster_idx", "x.*")


def parsimony(psms: DataFrame, scan: str = "scan", protein: str = "protein", max_rounds: int = 1000) -> DataFrame:
    """Rows of the proteins of a greedy cover: again and again the protein with most scans left (ties to the first by name) takes all their rows.

    Only proteins that share a scan affect each other, and scans left only become fewer: so each round takes every protein that
    is the best of all that hold one of its scans.
    """
    left = written(psms.select(F.col(scan).alias("s"), F.col(protein).alias("p")).filter("s IS NOT NULL AND p IS NOT NULL").distinct(), "cover")
    owners = []
    for _ in range(max_rounds):
        sized = left.join(left.groupBy("p").agg(F.count(F.lit(1)).alias("n")), "p")
        best = sized.groupBy("s").agg(F.min(F.struct((-F.col("n")).alias("m"), "p")).alias("b"))
        won = best.groupBy("b.p").agg(F.count(F.lit(1)).alias("won"), F.min(-F.col("b.m")).alias("n")).filter("won = n").select("p")
        taken = written(left.join(won, "p", "left_semi"), "cover")
        if taken.isEmpty():
            break
        owners.append(taken)
        left = written(left.join(taken.select("s").distinct(), "s", "left_anti"), "cover")
    else:
        raise RuntimeError(f"scans weren't covered in {max_rounds} rounds")
    if not owners:
        return psms.limit(0)
    kept = reduce(DataFrame.unionByName, owners)
    return psms.join(kept, (psms[scan] == kept["s"]) & (psms[protein] == kept["p"]), "left_semi").select(*psms.columns)


def mod_counts(psms: DataFrame) -> DataFrame:
    """residues, mass (rounded half away from zero), n: modifications of target matches."""
    targets = psms.filter(~F.col("is_decoy"))
    mods = targets.select(F.inline(P.modifications(F.col("annotation"))))
    return mods.select("residues", F.round("mass").cast("int").alias("mass")).groupBy("residues", "mass").agg(F.count(F.lit(1)).alias("n"))


def mod_matrix(counts: DataFrame, residues: list[str]) -> DataFrame:
    """mass and one column of counts for each residue."""
    return counts.groupBy("mass").pivot("residues", residues).agg(F.sum("n")).na.fill(0)


def in_networks(psms: DataFrame, contigs: DataFrame) -> DataFrame:
    """Matches whose spectra are members of a contig (spec_idx)."""
    return psms.join(contigs.select("spec_idx").distinct(), "spec_idx", "left_semi").select(*psms.columns)


def variants(psms: DataFrame, proteins: DataFrame, overlap: float = 0.5, k: int = 4) -> DataFrame:
    """psm_id, db_index, start_aa, end_aa, variant, region: where a peptide's plain residues (I as L, Q as K) lie in proteins.

    Candidates share the peptide's first ``k`` letters with a place of the protein. A variant is a peptide and its rounded mass; a region a run of
    places of a protein whose neighbours overlap by at least that share of the shorter.
    """
    peptides = psms.select("psm_id", P.folded(F.col("annotation")).alias("pep"), F.round(P.residue_mass(F.col("annotation"))).cast("long").alias("mass")).filter(F.length("pep") >= k)
    # equal peptides and equal sequences are found once; their members meet at the end, where they are, so no row of the result is shuffled
    own = written(_members(peptides, ["pep", "mass"], "psm_id"), "variants")
    folded = written(_members(proteins.filter("db_index IS NOT NULL").select("db_index", F.translate("sequence", "IQ", "LK").alias("sequence")), ["sequence"], "db_index"), "variants")
    first = folded.groupBy("sequence").agg(F.min(F.get("db_index", F.lit(0))).alias("db_index"))
    plain = own.select("pep", F.substring("pep", 1, k).alias("head")).distinct()
    found = plain.join(heads(first, k), "head").join(first, "db_index").select("pep", "sequence", F.col("position").alias("start_aa"))
    found = found.filter(F.substr("sequence", F.col("start_aa"), F.length("pep")) == F.col("pep")).withColumn("end_aa", F.col("start_aa") + F.length("pep") - 1)
    w = Window.partitionBy("sequence").orderBy("start_aa", "end_aa")
    before = F.max("end_aa").over(w.rowsBetween(Window.unboundedPreceding, -1))
    shared = before - F.col("start_aa") + 1
    fresh = F.when(before.isNull() | (shared < overlap * (F.col("end_aa") - F.col("start_aa") + 1)), 1).otherwise(0)
    placed = found.withColumn("_f", fresh).withColumn("region", F.sum("_f").over(w).cast("int")).drop("_f")
    spark = psms.sparkSession
    met = placed.join(own, "pep").join(folded, "sequence").select("psm_id", "db_index", "start_aa", "end_aa", F.concat_ws("/", "pep", "mass").alias("variant"), "region")
    # each row stands for up to MEMBERS ** 2 of the result, so they are dealt to all tasks
    met = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    rest = ["start_aa", "end_aa", "variant", "region"]
    return met.select(F.explode("psm_id").alias("psm_id"), "db_index", *rest).select("psm_id", F.explode("db_index").alias("db_index"), *rest)


def _members(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows of equal keys as one, with an array of the named column; of more than ``MEMBERS`` there are several rows."""
    lists = rows.groupBy(*keys).agg(F.collect_list(F.struct(name)).alias("_m"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("_m") - 1) / MEMBERS).cast("int")), lambda i: F.slice("_m", i * MEMBERS + 1, MEMBERS))
    return lists.select(*keys, F.explode(parts).alias("_m")).select(*keys, F.col(f"_m.{name}").alias(name))


def supported_mods(psms: DataFrame, least: int) -> DataFrame:
    """residues, mass, n, peptides: modifications of target matches that at least so many different peptides show."""
    targets = psms.filter(~F.col("is_decoy")).select(P.unmodified(F.col("annotation")).alias("plain"), F.inline(P.modifications(F.col("annotation"))))
    counts = targets.groupBy("residues", F.round("mass").cast("int").alias("mass")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("plain").alias("peptides"))
    return counts.filter(F.col("peptides") >= least)


def as_proteins(psms: DataFrame) -> DataFrame:
    """db_index, id, description, sequence: the distinct plain peptides of the matches as a database, numbered in their order."""
    from peakweave.operators.spectra import renumbered

    plain = psms.select(P.unmodified(F.col("annotation")).alias("sequence")).filter("sequence <> ''").distinct()
    out = renumbered(plain, ["sequence"], "_no")
    return out.select((F.col("_no") - 1).cast("int").alias("db_index"), F.concat(F.lit("PEP"), F.col("_no").cast("string")).alias("id"), F.lit("").alias("description"), "sequence")
