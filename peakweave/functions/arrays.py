"""Column expressions over arrays of peaks, struct<mz, intensity, tol>, sorted by m/z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed masses in Dalton: proton, water, the least amino acid mass (glycine).
PROTON, WATER, LEAST_RESIDUE = 1.00727646688, 18.010564686, 57.0214637230


def peak(mz: Column, intensity: Column, tol: Column) -> Column:
    """One peak."""
    return F.struct(mz.cast("double").alias("mz"), intensity.cast("double").alias("intensity"), tol.cast("double").alias("tol"))


def map_peaks(peaks: Column, mz=None, intensity=None, tol=None) -> Column:
    """Peaks with changed fields; each function takes the peak."""
    return F.transform(peaks, lambda p: peak(mz(p) if mz else p["mz"], intensity(p) if intensity else p["intensity"], tol(p) if tol else p["tol"]))


def total_intensity(peaks: Column) -> Column:
    """Sum of intensities, 0 for no peaks."""
    return F.aggregate(peaks, F.lit(0.0), lambda a, p: a + p["intensity"])


def norm(peaks: Column) -> Column:
    """Euclidean length of the intensities."""
    return F.sqrt(F.aggregate(peaks, F.lit(0.0), lambda a, p: a + p["intensity"] * p["intensity"]))


def lowest_quarter(peaks: Column) -> Column:
    """The floor(n/4) lowest intensities, ascending."""
    ordered = F.array_sort(F.transform(peaks, lambda p: p["intensity"]))
    return F.slice(ordered, F.lit(1), F.floor(F.size(peaks) / 4).cast("int"))


def mean(values: Column) -> Column:
    """Mean of an array of numbers, 0 for none."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(0.0)


def noise_level(peaks: Column, least: int = 10) -> Column:
    """Mean of the lowest quarter of intensities; 0 for fewer than ``least`` peaks."""
    return F.when(F.size(peaks) < least, F.lit(0.0)).otherwise(mean(lowest_quarter(peaks)))


def density(peaks: Column) -> Column:
    """Peaks per Dalton between the first and the last, 0 for fewer than two."""
    span = F.element_at(peaks, -1)["mz"] - F.element_at(peaks, 1)["mz"]
    return F.when((F.size(peaks) > 1) & (span > 0), F.size(peaks) / span).otherwise(0.0)


def by_mz(peaks: Column) -> Column:
    """Sorted by m/z, then intensity and tolerance."""
    return F.array_sort(peaks)


def running_sums(values: Column) -> Column:
    """The sums of an array of doubles up to each place. Chunks of about the square root of the length run on their own first, so long arrays take little more than time in proportion."""
    zero = F.lit(0.0)
    let = lambda f, **of: F.transform(F.array(F.struct(*[v.alias(k) for k, v in of.items()])), f)[0]  # noqa: E731  (each value is evaluated once)
    along = lambda part: F.slice(F.aggregate(part, F.array(zero), lambda a, x: F.array_append(a, F.element_at(a, -1) + x)), F.lit(2), F.size(part))
    chunked = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s["v"]) - 1) / s["step"]).cast("int")), lambda k: along(F.slice(s["v"], k * s["step"] + 1, s["step"])))
    before = lambda t: F.aggregate(t["chunks"], F.array(zero), lambda a, c: F.array_append(a, F.element_at(a, -1) + F.element_at(c, -1)))
    joined = lambda u: F.flatten(F.zip_with(u["chunks"], F.slice(u["before"], F.lit(1), F.size(u["chunks"])), lambda c, b: F.transform(c, lambda x: b + x)))
    whole = let(lambda s: let(lambda t: let(joined, chunks=t["chunks"], before=before(t)), chunks=chunked(s)), v=values, step=F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(values)))).cast("int"))
    return F.when(F.size(values) > 0, whole).otherwise(F.array().cast("array<double>"))
