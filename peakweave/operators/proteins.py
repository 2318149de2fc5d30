"""Protein databases: decoys, coverage, substring, tag and mass searches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from peakweave.functions import peptide as P
from peakweave.operators import kernels
from peakweave.operators.pairs import band_join
from peakweave.session import ship, written


def with_decoys(proteins: DataFrame, prefix: str = "XXX") -> DataFrame:
    """The proteins and, for each, its reversed sequence under a prefixed name."""
    decoys = proteins.select(*[F.concat(F.lit(prefix), "id").alias("id") if c == "id" else F.reverse("sequence").alias("sequence") if c == "sequence" else F.col(c) for c in proteins.columns if c != "is_decoy"])
    return proteins.drop("is_decoy").withColumn("is_decoy", F.lit(False)).unionByName(decoys.withColumn("is_decoy", F.lit(True)))


def coverage(hits: DataFrame, proteins: DataFrame) -> DataFrame:
    """db_index, covered (distinct residues), total (residues counted each time), redundancy, percent of the length.

    hits: db_index, start_aa, end_aa. Intervals are merged by order rather than exploded: each adds what lies behind the furthest end so far.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("db_index").orderBy("start_aa", "end_aa").rowsBetween(Window.unboundedPreceding, -1)
    furthest = F.coalesce(F.max("end_aa").over(w), F.lit(-(1 << 30)))
    fresh = F.greatest(F.lit(0), F.col("end_aa") - F.greatest(F.col("start_aa") - 1, furthest))
    merged = hits.groupBy("db_index", "start_aa", "end_aa").agg(F.count(F.lit(1)).alias("_n")).withColumn("_f", fresh)
    sums = merged.groupBy("db_index").agg(F.sum("_f").alias("covered"), F.sum((F.col("end_aa") - F.col("start_aa") + 1) * F.col("_n")).alias("total"))
    return sums.join(proteins, "db_index").select("db_index", "covered", "total", (F.col("total") / F.col("covered")).alias("redundancy"), (100.0 * F.col("covered") / F.col("length")).alias("percent"))


#: Peptides up to which they are broadcast to the places of sequences, with up to 16 letters each on average; beyond, both sides are shuffled.
BROADCAST_PEPTIDES = 100_000


def letters(sequence: Column) -> Column:
    """The sequence as bytes, one a letter, so that a place is found without counting from the start; what is no ASCII letter counts as ?."""
    return F.encode(F.regexp_replace(sequence, r"[^\x00-\x7f]", "?"), "utf-8")


def heads(proteins: DataFrame, n: int) -> DataFrame:
    """db_index, position (from 1), head: the n letters at each place. Rows are small: the sequence itself isn't repeated."""
    rows = proteins.filter(F.length("sequence") >= n).select("db_index", F.transform(F.array(letters(F.col("sequence"))), lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.struct(i.alias("position"), F.substr(s, i, F.lit(n)).alias("head"))))[0].alias("places"))
    return rows.select("db_index", F.inline("places")).withColumn("head", F.col("head").cast("string"))


#: Words up to which every sequence is searched for one after the other, where it lies; and their places that are passed on at once.
SCANNED, PLACES = 64, 100_000


def _scanned(proteins: DataFrame, words: list[str], name: str, flanks: bool = False) -> DataFrame:
    """name (a word), db_index, position (from 1) of all occurrences, overlapping ones too; with flanks before and after too, the residue masses on either side."""
    ship(proteins.sparkSession)
    kind = to_arrow_type(proteins.schema["db_index"].dataType)

    def sums(sequence: str) -> np.ndarray:
        """0 and the prefix masses, added up as ``running_sums`` does."""
        weights = np.zeros(128)
        for x, m in kernels.RESIDUES.items():
            weights[ord(x)] = m
        codes = np.frombuffer(sequence.encode("utf-32-le"), np.uint32)
        values = np.where(codes < 128, weights[np.minimum(codes, 127)], 0.0)
        step = max(16, math.ceil(math.sqrt(len(values))))
        chunks = np.cumsum(np.pad(values, (0, -len(values) % step)).reshape(-1, step), axis=1)
        before = np.concatenate([[0.0], np.cumsum(chunks[:, -1])[:-1]])
        return np.concatenate([[0.0], (before[:, None] + chunks).ravel()[: len(values)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [name, "db_index", "position", *(["before", "after"] if flanks else [])]
        types = [pa.string(), kind, pa.int32(), pa.float64(), pa.float64()]
        columns: list[list] = [[] for _ in names]

        def shown() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=names)
            for c in columns:
                c.clear()
            return out

        for b in batches:
            for own, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sequence = text.as_py()
                p = None
                for word in words if sequence else ():
                    at = sequence.find(word)
                    while at >= 0:
                        columns[0].append(word)
                        columns[1].append(own)
                        columns[2].append(at + 1)
                        if flanks:
                            p = sums(sequence) if p is None else p
                            columns[3].append(float(p[at]))
                            columns[4].append(float(p[-1] - p[at + len(word)]))
                        if len(columns[0]) >= PLACES:
                            yield shown()
                        at = sequence.find(word, at + 1)
        if columns[0]:
            yield shown()

    shape = f"{name} string, db_index {proteins.schema['db_index'].dataType.simpleString()}, position int" + (", before double, after double" if flanks else "")
    return proteins.select("db_index", "sequence").mapInArrow(run, shape)


def tag_places(proteins: DataFrame, tags: list[str]) -> DataFrame:
    """tag, db_index, pos (from 1), before and after: the rows of ``tag_index`` for a few tags; only their places are formed."""
    return _scanned(proteins, [t for t in tags if t], "tag", flanks=True).withColumnRenamed("position", "pos")


def substring_search(proteins: DataFrame, peptides: DataFrame, classes: tuple[int, ...] = (8, 4, 2, 1)) -> DataFrame:
    """peptide, db_index, position (from 1): all occurrences, overlapping ones too; empty peptides have none.

    A few peptides are sought one after the other in each sequence, where it lies. More meet only places with their first k letters, and are then compared in the sequence; k is the largest of ``classes`` that
    isn't longer than the peptide, so a short peptide doesn't make the others meet more places.
    """
    at_most = lambda n: classes[n - 1] if n else 1 << 30
    size = [F.count(F.when((F.length("peptide") >= k) & (F.length("peptide") < at_most(n)), 1)) for n, k in enumerate(classes)]
    *counts, letters_ = peptides.agg(*size, F.sum(F.length("peptide"))).first()
    if sum(counts) <= SCANNED and (letters_ or 0) <= 16 * BROADCAST_PEPTIDES:
        return _scanned(proteins, [r[0] for r in peptides.filter(F.length("peptide") > 0).select("peptide").collect()], "peptide")
    few = sum(counts) <= BROADCAST_PEPTIDES and (letters_ or 0) <= 16 * BROADCAST_PEPTIDES
    out = []
    for n, k in enumerate(classes):
        if not counts[n]:
            continue
        own = peptides.filter((F.length("peptide") >= k) & (F.length("peptide") < at_most(n))).select("peptide", F.substring("peptide", 1, k).alias("head"))
        # the places are many times what the size of the sequences lets expect, and must not be broadcast
        met = heads(proteins, k).join(F.broadcast(own), "head") if few else own.join(heads(proteins, k).hint("merge"), "head")
        if at_most(n) > k + 1:  # else the head is the peptide
            whole = proteins.select("db_index", letters(F.col("sequence")).alias("letters"))
            met = met.join(whole, "db_index").filter(F.substr("letters", F.col("position"), F.length("peptide")) == F.encode("peptide", "utf-8"))
        out.append(met.select("peptide", "db_index", "position"))
    if not out:
        return proteins.limit(0).select(F.lit("").alias("peptide"), "db_index", F.lit(0).alias("position"))
    return reduce(DataFrame.unionByName, out)


def tag_index(proteins: DataFrame, k: int = 3) -> DataFrame:
    """tag, db_index, pos (from 1), before and after (residue masses on either side)."""
    p = proteins.filter(F.length("sequence") >= k).select("db_index", "sequence", F.split("sequence", "").alias("letters"), P.prefix_masses(F.col("sequence"), plain=True).alias("p"))
    place = lambda i: F.struct(F.array_join(F.slice("letters", i, k), "").alias("tag"), i.alias("pos"), F.coalesce(F.get("p", i - 2), F.lit(0.0)).alias("before"), (F.element_at("p", -1) - F.get("p", i + k - 2)).alias("after"))
    return p.select("db_index", F.inline(F.transform(F.sequence(F.lit(1), F.length("sequence") - k + 1), place))).select("tag", "db_index", "pos", "before", "after")


def tag_search(tags: DataFrame, proteins: DataFrame, tolerance: float, flanks: int = 1, k: int = 3, reach: int = 40) -> DataFrame:
    """spec_idx, tag, db_index, pos, matched flanks: places with the tag where at least ``flanks`` of its flanking masses are sums of the residues next to it.

    tags: spec_idx, tag, before, after. Up to ``reach`` residues are summed on either side; the sequence's prefix masses are joined to matching places only.
    Equal sequences are searched once, and their places handed to each.
    """
    members = proteins.filter(F.length("sequence") >= k).select("db_index", "sequence")
    own = written(members.select("sequence").distinct().withColumn("_class", F.monotonically_increasing_id()), "sequences")
    p = own.select("_class", P.prefix_masses(F.col("sequence"), plain=True).alias("p"))
    found = tags.select("spec_idx", "tag", "before", "after").join(heads(own.withColumnRenamed("_class", "db_index"), k).select(F.col("head").alias("tag"), F.col("db_index").alias("_class"), F.col("position").alias("pos")), "tag").join(p, "_class")
    q = lambda i: F.coalesce(F.get("p", i - 1), F.lit(0.0))
    left = F.transform(F.sequence(F.greatest(F.lit(0), F.col("pos") - 1 - reach), F.col("pos") - 1), lambda i: q(F.col("pos") - 1) - q(i))
    right = F.transform(F.sequence(F.col("pos") + k - 1, F.least(F.size("p"), F.col("pos") + k - 1 + reach)), lambda i: q(i) - q(F.col("pos") + k - 1))
    hit = lambda sums, mass: F.exists(sums, lambda s: F.abs(s - F.col(mass)) <= tolerance).cast("int")
    near = found.withColumn("matched", hit(left, "before") + hit(right, "after")).filter(F.col("matched") >= flanks).select("spec_idx", "tag", "_class", "pos", "matched")
    return members.join(own, "sequence").select("db_index", "_class").join(near, "_class").select("spec_idx", "tag", "db_index", "pos", "matched")


def mass_search(spectra: DataFrame, proteins: DataFrame, tolerance: float, longest: int = 50) -> DataFrame:
    """spec_idx, db_index, start_aa, end_aa, error: stretches of proteins (at most ``longest`` residues) whose mass is the spectrum's residue mass within the tolerance."""
    p = proteins.select("db_index", P.prefix_masses(F.col("sequence"), plain=True).alias("p")).filter(F.size("p") > 0)
    q = lambda i: F.coalesce(F.get("p", i - 1), F.lit(0.0))
    ends = F.transform("p", lambda m, e: F.transform(F.sequence(F.greatest(F.lit(0), e - longest + 1), e), lambda s: F.struct((s + 1).alias("start_aa"), (e + 1).alias("end_aa"), (m - q(s)).alias("mass"))))
    spans = p.select("db_index", F.inline(F.flatten(ends)))
    own = spectra.select("spec_idx", (F.col("parent_mass") - 19.01784115).alias("residue_mass"))
    found = band_join(own, spans, "residue_mass", "mass", tolerance)
    return found.select("spec_idx", "db_index", "start_aa", "end_aa", (F.col("mass") - F.col("residue_mass")).alias("error"))


#: Alignments that a task keeps for pairs of the same sequences, and their letters.
ALIGNED, LETTERS = 200_000, 20_000_000


def aligned(pairs: DataFrame, match: int = 2, mismatch: int = -1, gap: int = -2) -> DataFrame:
    """db_index1, db_index2, score, row1, row2: the best global alignment of each pair's sequence1 and sequence2, as rows with gaps. Pairs of the same two sequences are aligned once in a task, as long as it holds no more than ``ALIGNED`` others."""
    ship(pairs.sparkSession)

    def run(batches):
        known: dict[tuple[str, str], tuple[int, str, str]] = {}
        letters_held = 0
        for b in batches:
            rows = []
            for two in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                found = known.get(two)
                if found is None:
                    found = kernels.align_sequences(two[0] or "", two[1] or "", match, mismatch, gap)
                    if letters_held > LETTERS or len(known) >= ALIGNED:
                        known, letters_held = {}, 0
                    known[two] = found
                    letters_held += 2 * len(found[1])
                rows.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]], names=["db_index1", "db_index2", "score", "row1", "row2"])

    kind = [pairs.schema[c].dataType.simpleString() for c in ("db_index1", "db_index2")]
    return pairs.select("db_index1", "db_index2", "sequence1", "sequence2").mapInArrow(run, f"db_index1 {kind[0]}, db_index2 {kind[1]}, score long, row1 string, row2 string")


def homologues(proteins: DataFrame, k: int = 6, least: int = 2) -> DataFrame:
    """db_index1 < db_index2, shared: proteins with at least so many different stretches of k residues in common. A stretch that many proteins have pairs them all, so k should be long enough to be rare."""
    # proteins with the same stretches are one class; only classes meet, and their pairs are spread to the members
    sets = heads(proteins, k).groupBy("db_index").agg(F.array_sort(F.collect_set("head")).alias("heads")).filter(F.size("heads") >= least)
    classes = sets.groupBy("heads").agg(F.min("db_index").alias("class"))
    words = classes.select("class", F.explode("heads").alias("head"))
    members = sets.join(classes, "heads").select("db_index", "class")
    both = words.select(F.col("class").alias("class1"), "head").join(words.select(F.col("class").alias("class2"), "head"), "head").filter("class1 <= class2")
    near = both.groupBy("class1", "class2").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)
    side = lambda n: members.select(F.col("db_index").alias(f"_m{n}"), F.col("class").alias(f"class{n}"))
    spread = near.join(side(1), "class1").join(side(2), "class2").filter("class1 < class2 OR _m1 < _m2")
    return spread.select(F.least("_m1", "_m2").alias("db_index1"), F.greatest("_m1", "_m2").alias("db_index2"), "shared")


def match_peptide(peaks: list[list[tuple[float, float]]], parent_masses: list[float], prefixes: list[float], tolerance: float = 0.5, end: float = 1.0) -> float:
    """Summed intensity of peaks at a peptide's prefix masses, over spectra of parts of it. Small, for checks.

    Each spectrum takes its best start among the prefixes and its better direction: as it is, or as complements
    (parent mass - m/z + ``end``). Both kinds of mass include ``end`` at the first residue.
    """
    total = 0.0
    for own, parent in zip(peaks, parent_masses, strict=True):
        ways = [own, [(parent - m + end, i) for m, i in own]]
        total += max(sum(i for m, i in way if any(abs(m - end + start - p) <= tolerance for p in prefixes)) for way in ways for start in prefixes)
    return total
