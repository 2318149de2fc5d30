"""Column expressions over peptide strings. Modified residues are written (S,79.966); [12.5] is a mass gap; flanks are K.PEPTIDE.R."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakweave.functions.arrays import PROTON, WATER, running_sums
from peakweave.operators.kernels import RESIDUES

_TOKEN = r"\([A-Z]+,-?[0-9.]+\)|\[-?[0-9.]+\]|[A-Z]"


def masses() -> Column:
    """The residue masses as a map of letters."""
    return F.create_map(*[F.lit(x) for item in RESIDUES.items() for x in item])


def without_flanks(peptide: Column) -> Column:
    """PEPTIDE of K.PEPTIDE.R."""
    return F.regexp_replace(peptide, r"^[A-Z*_-]?\.(.*)\.[A-Z*_-]?$", "$1")


def unmodified(peptide: Column) -> Column:
    """The plain residues."""
    return F.regexp_replace(F.regexp_replace(without_flanks(peptide), r"\(([A-Z]+),-?[0-9.]+\)", "$1"), r"\[-?[0-9.]+\]", "")


def modifications(peptide: Column) -> Column:
    """array<struct<residues, mass>>."""
    found = F.regexp_extract_all(peptide, F.lit(r"\(([A-Z]+),(-?[0-9.]+)\)"), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, r"\(([A-Z]+),", 1).alias("residues"), F.regexp_extract(m, r",(-?[0-9.]+)\)", 1).cast("double").alias("mass")))


def mod_positions(peptide: Column) -> Column:
    """Positions, from 1, of the last residue of each modification in the plain sequence."""
    plain = F.regexp_replace(without_flanks(peptide), r"\[-?[0-9.]+\]", "")
    marked = F.split(F.regexp_replace(F.regexp_replace(plain, r"\(([A-Z]+),-?[0-9.]+\)", "$1*"), r"", ""), r"\*", -1)
    ends = F.slice(marked, F.lit(1), F.size(marked) - 1)
    return F.transform(ends, lambda _, i: F.aggregate(F.slice(ends, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)))


def from_signed(peptide: Column) -> Column:
    """S+80 or T-18 to (S,80) and (T,-18)."""
    return F.regexp_replace(F.regexp_replace(peptide, r"([A-Z])\+([0-9.]+)", "($1,$2)"), r"([A-Z])(-[0-9.]+)", "($1,$2)")


def to_signed(peptide: Column) -> Column:
    """(S,80) to S+80, (T,-18) to T-18."""
    return F.regexp_replace(F.regexp_replace(peptide, r"\(([A-Z]+),(-[0-9.]+)\)", "$1$2"), r"\(([A-Z]+),([0-9.]+)\)", "$1+$2")


def _steps(peptide: Column) -> Column:
    table = masses()

    def one(t: Column) -> Column:
        letters = F.regexp_extract(t, "([A-Z]+)", 1)
        own = F.aggregate(F.split(letters, ""), F.lit(0.0), lambda a, c: a + F.coalesce(F.try_element_at(table, c), F.lit(0.0)))
        return own + F.coalesce(F.try_to_number(F.regexp_extract(t, r"(-?[0-9]+\.?[0-9]*)", 1), F.lit("S999999.999999")).cast("double"), F.lit(0.0))

    return F.transform(F.regexp_extract_all(without_flanks(peptide), F.lit(_TOKEN), F.lit(0)), one)


def residue_mass(peptide: Column) -> Column:
    """Sum of residues, modifications and gaps; unknown letters weigh nothing."""
    return F.aggregate(_steps(peptide), F.lit(0.0), lambda a, x: a + x)


def parent_mass(peptide: Column) -> Column:
    """Singly protonated mass."""
    return residue_mass(peptide) + WATER + PROTON


def prefix_masses(peptide: Column, plain: bool = False) -> Column:
    """Cumulative masses from the first residue on, the whole included. plain: letters only, which is faster."""
    table = masses()
    letters = F.transform(F.filter(F.split(peptide, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(0.0)))
    return running_sums(letters if plain else _steps(peptide))


def ions(peptide: Column) -> Column:
    """array<struct<ion, number, mz>> of singly charged b and y ions, without the whole peptide."""

    def found(s: Column) -> Column:
        n = F.size(s["p"])
        inner = F.slice(s["p"], F.lit(1), F.greatest(n - 1, F.lit(0)))
        b = F.transform(inner, lambda m, i: F.struct(F.lit("b").alias("ion"), (i + 1).alias("number"), (m + PROTON).alias("mz")))
        y = F.transform(inner, lambda m, i: F.struct(F.lit("y").alias("ion"), (n - 1 - i).alias("number"), (s["whole"] - m + WATER + PROTON).alias("mz")))
        return F.concat(b, y)

    # each value is worked out once a peptide, rather than once an ion
    whole = lambda steps: F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)
    sums = F.transform(F.array(_steps(peptide)), lambda steps: F.struct(running_sums(steps).alias("p"), whole(steps).alias("whole")))
    return F.transform(sums, found)[0]


def charge(peptide: Column, mz: Column) -> Column:
    """The whole number nearest to mass / m/z, at least 1."""
    return F.greatest(F.round(parent_mass(peptide) / mz).cast("int"), F.lit(1))


def tryptic_ends(peptide: Column) -> Column:
    """0, 1 or 2: how many ends of K.PEPTIDE.R a cut behind K or R (or the protein's end) explains."""
    first = peptide.rlike(r"^[KR*_-]?\.").cast("int")
    last = (peptide.rlike(r"[KR]\)?(?:,[0-9.]+\))?\.[A-Z*_-]?$") | peptide.rlike(r"\.[*_-]?$")).cast("int")
    return first + last


def folded(peptide: Column) -> Column:
    """I as L and Q as K, for comparison."""
    return F.translate(unmodified(peptide), "IQ", "LK")


def decoy(sequence: Column) -> Column:
    """The reversed sequence."""
    return F.reverse(sequence)


def shuffled(peptide: Column, seed: int = 1) -> Column:
    """A decoy peptide: R, K and P stay in place, the others are put in the order of hashes of (seed, peptide, place)."""
    letters = F.split(unmodified(peptide), "")
    free = F.filter(letters, lambda c: ~c.isin("R", "K", "P"))
    mixed = F.transform(F.array_sort(F.transform(free, lambda c, i: F.struct(F.xxhash64(F.lit(seed), peptide, i).alias("h"), i.alias("i"), c.alias("c")))), lambda s: s["c"])

    def place(c: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(letters, F.lit(1), i), lambda x: ~x.isin("R", "K", "P")))
        return F.when(c.isin("R", "K", "P"), c).otherwise(F.get(mixed, before))

    return F.array_join(F.transform(letters, place), "")
