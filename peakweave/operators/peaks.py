"""Per-spectrum operators on a ``peaks`` array: all are column expressions, so no row leaves its task or the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakweave.functions import arrays as A

PEAKS = "peaks"


def normalize_total(spectra: DataFrame, total: float = 100.0) -> DataFrame:
    """Intensities scaled to a given sum; a spectrum without intensity stays."""
    s = A.total_intensity(F.col(PEAKS))
    return spectra.withColumn("_s", s).withColumn(PEAKS, F.when(F.col("_s") > 0, A.map_peaks(F.col(PEAKS), intensity=lambda p: p["intensity"] * total / F.col("_s"))).otherwise(F.col(PEAKS))).drop("_s")


def normalize_l2(spectra: DataFrame) -> DataFrame:
    """Intensities scaled to Euclidean length 1."""
    return spectra.withColumn("_s", A.norm(F.col(PEAKS))).withColumn(PEAKS, F.when(F.col("_s") > 0, A.map_peaks(F.col(PEAKS), intensity=lambda p: p["intensity"] / F.col("_s"))).otherwise(F.col(PEAKS))).drop("_s")


def transform_intensity(spectra: DataFrame, how: str) -> DataFrame:
    """how: sqrt, log (natural, of 1 + intensity), abs, or rank (dense, 1 for the lowest)."""
    if how == "rank":
        levels = F.array_sort(F.array_distinct(F.transform(PEAKS, lambda p: p["intensity"])))
        return spectra.withColumn("_l", levels).withColumn(PEAKS, A.map_peaks(F.col(PEAKS), intensity=lambda p: F.array_position("_l", p["intensity"]))).drop("_l")
    f = {"sqrt": F.sqrt, "log": F.log1p, "abs": F.abs}[how]
    return spectra.withColumn(PEAKS, A.map_peaks(F.col(PEAKS), intensity=lambda p: f(p["intensity"])))


def set_tolerance(spectra: DataFrame, da: float | None = None, ppm: float | None = None) -> DataFrame:
    """A peak tolerance in Dalton, or m/z * ppm * 1e-6."""
    return spectra.withColumn(PEAKS, A.map_peaks(F.col(PEAKS), tol=lambda p: F.lit(da) if da is not None else p["mz"] * ppm * 1e-6))


def set_parent(spectra: DataFrame, parent_mz: Column | None = None, parent_mass: Column | None = None) -> DataFrame:
    """Keeps parent mass (singly charged), m/z and charge consistent: M = z * mz - (z - 1) * proton. A charge of 0 counts as 1."""
    z = F.greatest(F.col("charge"), F.lit(1))
    if parent_mz is not None:
        return spectra.withColumn("parent_mz", parent_mz).withColumn("parent_mass", F.col("parent_mz") * z - (z - 1) * A.PROTON)
    return spectra.withColumn("parent_mass", parent_mass).withColumn("parent_mz", (F.col("parent_mass") + (z - 1) * A.PROTON) / z)


def shift_mz(spectra: DataFrame, offset: float) -> DataFrame:
    """A constant added to every m/z."""
    return spectra.withColumn(PEAKS, A.map_peaks(F.col(PEAKS), mz=lambda p: p["mz"] + offset))


def round_mz(spectra: DataFrame, resolution: float) -> DataFrame:
    """m/z in units of the resolution, to the nearest; peaks of one unit merge, with summed intensity and the largest tolerance."""
    units = A.map_peaks(F.col(PEAKS), mz=lambda p: F.floor(p["mz"] / resolution + 0.5))

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["mz"] == p["mz"])
        last = F.try_element_at(acc, F.lit(-1))
        return F.when(same, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(A.peak(p["mz"], last["intensity"] + p["intensity"], F.greatest(last["tol"], p["tol"]))))).otherwise(F.concat(acc, F.array(p)))

    return spectra.withColumn(PEAKS, F.aggregate(units, F.array().cast("array<struct<mz:double,intensity:double,tol:double>>"), step))


def reverse(spectra: DataFrame, offset: float = 0.0, proton: float = A.PROTON) -> DataFrame:
    """Complementary masses: parent mass - proton + offset - m/z, in rising order."""
    return spectra.withColumn(PEAKS, F.reverse(A.map_peaks(F.col(PEAKS), mz=lambda p: F.col("parent_mass") - proton + offset - p["mz"])))


def rotate(spectra: DataFrame, offset: float, cyclic: float = 0.0) -> DataFrame:
    """m/z shifted by the offset on a circle of the parent mass (plus ``cyclic``): what leaves one end enters at the other."""
    circle = F.col("parent_mass") + cyclic
    return spectra.withColumn(PEAKS, A.by_mz(A.map_peaks(F.col(PEAKS), mz=lambda p: F.pmod(p["mz"] + offset, circle))))


def add_terminals(spectra: DataFrame, intensity: float = 1.0, tolerance: float = 0.5, water: float = A.WATER, proton: float = A.PROTON) -> DataFrame:
    """Peaks at 0 and at the full residue mass (parent mass - water - proton), unless a peak lies within the tolerance."""
    full = F.col("parent_mass") - water - proton
    ends = F.array(*[A.peak(at, F.lit(intensity), F.lit(tolerance)) for at in (F.lit(0.0), full)])
    lone = F.filter(ends, lambda e: ~F.exists(F.col(PEAKS), lambda p: F.abs(p["mz"] - e["mz"]) <= tolerance))
    return spectra.withColumn(PEAKS, A.by_mz(F.concat(F.col(PEAKS), lone)))


def remove_terminals(spectra: DataFrame, tolerance: float = 0.5, water: float = A.WATER, proton: float = A.PROTON) -> DataFrame:
    """Without peaks below the least residue mass, or less than that below the full residue mass."""
    full = F.col("parent_mass") - water - proton
    return spectra.withColumn(PEAKS, F.filter(PEAKS, lambda p: (p["mz"] >= A.LEAST_RESIDUE - tolerance) & (p["mz"] <= full - A.LEAST_RESIDUE + tolerance)))


def low_intensity(spectra: DataFrame, least: float) -> DataFrame:
    """Peaks with at least that intensity."""
    return spectra.withColumn(PEAKS, F.filter(PEAKS, lambda p: p["intensity"] >= least))


def mass_range(spectra: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Peaks with low <= m/z <= high."""
    out = F.col(PEAKS)
    if low is not None:
        out = F.filter(out, lambda p: p["mz"] >= low)
    if high is not None:
        out = F.filter(out, lambda p: p["mz"] <= high)
    return spectra.withColumn(PEAKS, out)


def snr_filter(spectra: DataFrame, ratio: float, least: int = 10) -> DataFrame:
    """Peaks with at least ``ratio`` times the noise level."""
    return spectra.withColumn("_n", A.noise_level(F.col(PEAKS), least)).withColumn(PEAKS, F.filter(PEAKS, lambda p: p["intensity"] >= ratio * F.col("_n"))).drop("_n")


def deviation_filter(spectra: DataFrame, times: float) -> DataFrame:
    """Peaks above mean + times * standard deviation (population) of the lowest quarter of intensities; spectra with fewer than 4 peaks stay."""
    q = A.lowest_quarter(F.col(PEAKS))
    out = spectra.withColumn("_q", q).withColumn("_m", A.mean(F.col("_q")))
    # summed value by value, as SQL does: intensities equal to the threshold are decided by its last bit
    mean = lambda a, x: a["mean"] + (x - a["mean"]) / (a["n"] + 1)
    step = lambda a, x: F.struct((a["n"] + 1).alias("n"), mean(a, x).alias("mean"), (a["m2"] + (x - a["mean"]) * (x - mean(a, x))).alias("m2"))
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean", "m2")])
    out = out.withColumn("_sd", F.aggregate("_q", start, step, lambda a: F.when(a["n"] > 0, F.sqrt(a["m2"] / a["n"])).otherwise(0.0)))
    kept = F.filter(PEAKS, lambda p: p["intensity"] > F.col("_m") + times * F.col("_sd"))
    return out.withColumn(PEAKS, F.when(F.size("_q") > 0, kept).otherwise(F.col(PEAKS))).drop("_q", "_m", "_sd")


def top_k(spectra: DataFrame, k: int) -> DataFrame:
    """The k most intense peaks, of equal ones those with larger m/z, in m/z order."""
    ranked = F.slice(F.reverse(F.array_sort(F.transform(PEAKS, lambda p, i: F.struct(p["intensity"].alias("intensity"), i.alias("i"), p.alias("p"))))), 1, k)
    return spectra.withColumn(PEAKS, F.transform(F.array_sort(F.transform(ranked, lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p")))), lambda x: x["p"]))


def rank_filter(spectra: DataFrame, max_rank: int, radius: float = A.LEAST_RESIDUE - 1, first: int | None = 1000) -> DataFrame:
    """Peaks whose intensity has dense rank ``max_rank`` or better among the peaks less than ``radius`` away, after a cut to the ``first`` most intense (None: without one)."""
    def better(p: Column) -> Column:
        near = F.filter("_all", lambda q: (F.abs(q["mz"] - p["mz"]) < radius) & (q["intensity"] > p["intensity"]))
        return F.size(F.array_distinct(F.transform(near, lambda q: q["intensity"])))

    return (spectra if first is None else top_k(spectra, first)).withColumn("_all", F.col(PEAKS)).withColumn(PEAKS, F.filter(PEAKS, lambda p: better(p) < max_rank)).drop("_all")


def window_filter(spectra: DataFrame, width: float, keep: int) -> DataFrame:
    """In each window [k * width, (k + 1) * width) the ``keep`` most intense peaks; ties to the smaller m/z."""
    def ahead(p: Column) -> Column:
        return F.size(F.filter("_all", lambda q: (F.floor(q["mz"] / width) == F.floor(p["mz"] / width)) & ((q["intensity"] > p["intensity"]) | ((q["intensity"] == p["intensity"]) & (q["mz"] < p["mz"])))))

    return spectra.withColumn("_all", F.col(PEAKS)).withColumn(PEAKS, F.filter(PEAKS, lambda p: ahead(p) < keep)).drop("_all")


def precursor_window(spectra: DataFrame, below: float = 17.0, above: float = 15.0) -> DataFrame:
    """Without peaks strictly between parent m/z - below and parent m/z + above."""
    return spectra.withColumn(PEAKS, F.filter(PEAKS, lambda p: (p["mz"] <= F.col("parent_mz") - below) | (p["mz"] >= F.col("parent_mz") + above)))


def remove_reduced_precursors(spectra: DataFrame, tolerance: float, proton: float = A.PROTON) -> DataFrame:
    """Without peaks within the tolerance of (M + (z - 1) * proton) / z for any z from 1 to the charge."""
    z = F.sequence(F.lit(1), F.greatest(F.col("charge"), F.lit(1)))
    out = spectra.withColumn("_r", F.transform(z, lambda k: (F.col("parent_mass") + (k - 1) * proton) / k))
    return out.withColumn(PEAKS, F.filter(PEAKS, lambda p: ~F.exists("_r", lambda m: F.abs(p["mz"] - m) <= tolerance))).drop("_r")


def merge_close(spectra: DataFrame, tolerance: float, sum_intensity: bool = True) -> DataFrame:
    """Peaks within the tolerance of a group's first peak merge: m/z of the most intense (the first of equal ones), intensity summed or largest."""
    start = F.array().cast("array<struct<base:double,mz:double,top:double,sum:double,tol:double>>")

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        join = (F.size(acc) > 0) & (p["mz"] - last["base"] <= tolerance)
        group = lambda base, mz, top, total, tol: F.struct(base.alias("base"), mz.alias("mz"), top.alias("top"), total.alias("sum"), tol.alias("tol"))
        more = p["intensity"] > last["top"]
        merged = group(last["base"], F.when(more, p["mz"]).otherwise(last["mz"]), F.greatest(last["top"], p["intensity"]), last["sum"] + p["intensity"], F.when(more, p["tol"]).otherwise(last["tol"]))
        fresh = group(p["mz"], p["mz"], p["intensity"], p["intensity"], p["tol"])
        return F.when(join, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, F.array(fresh)))

    groups = F.aggregate(PEAKS, start, step)
    return spectra.withColumn(PEAKS, F.transform(groups, lambda g: A.peak(g["mz"], g["sum"] if sum_intensity else g["top"], g["tol"])))


def symmetric_pairs(spectra: DataFrame, tolerance: float, water: float = A.WATER, proton: float = A.PROTON) -> DataFrame:
    """One row per pair of peaks that add up to the full mass (parent mass - proton + water shift of 0) within the tolerance: spec_idx, i, j, error."""
    full = F.col("parent_mass") - proton
    out = spectra.select("spec_idx", "parent_mass", PEAKS, F.posexplode(PEAKS).alias("i", "p"))
    near = F.filter(F.transform(PEAKS, lambda q, j: F.struct(j.alias("j"), (q["mz"] + F.col("p.mz") - full).alias("error"))), lambda x: (x["j"] >= F.col("i")) & (F.abs(x["error"]) <= tolerance))
    return out.select("spec_idx", "i", F.inline(near))


def make_symmetric(spectra: DataFrame, tolerance: float, proton: float = A.PROTON) -> DataFrame:
    """Adds the complement (parent mass - proton - m/z), with intensity 0, of every peak that has none within the tolerance."""
    full = F.col("parent_mass") - proton
    lone = F.filter("_all", lambda p: ~F.exists("_all", lambda q: F.abs(q["mz"] + p["mz"] - full) <= tolerance))
    return spectra.withColumn("_all", F.col(PEAKS)).withColumn(PEAKS, A.by_mz(F.concat(F.col(PEAKS), A.map_peaks(lone, mz=lambda p: full - p["mz"], intensity=lambda p: F.lit(0.0))))).drop("_all")


def by_position(spectra: DataFrame, positions: list[int]) -> DataFrame:
    """The peaks at the given positions, from 0."""
    return spectra.withColumn(PEAKS, F.filter(PEAKS, lambda p, i: i.isin(positions)))


def positions_of(spectra: DataFrame, masses: list[float], tolerance: float) -> DataFrame:
    """spec_idx, mass, position of the nearest peak within the tolerance, -1 if none."""
    each = spectra.select("spec_idx", PEAKS, F.explode(F.array(*[F.lit(float(m)) for m in masses])).alias("mass"))
    near = F.filter(F.transform(PEAKS, lambda p, i: F.struct(F.abs(p["mz"] - F.col("mass")).alias("d"), i.alias("i"))), lambda x: x["d"] <= tolerance)
    return each.select("spec_idx", "mass", F.coalesce(F.array_min(near)["i"], F.lit(-1)).alias("position"))


def measures(spectra: DataFrame) -> DataFrame:
    """spec_idx, n_peaks, tic, noise, density."""
    p = F.col(PEAKS)
    return spectra.select("spec_idx", F.size(p).alias("n_peaks"), A.total_intensity(p).alias("tic"), A.noise_level(p).alias("noise"), A.density(p).alias("density"))


def exploded(spectra: DataFrame, *keep: str) -> DataFrame:
    """One row per peak: spec_idx, the columns to keep, mz, intensity."""
    return spectra.select("spec_idx", *keep, F.inline(PEAKS)).drop("tol")


def gathered(rows: DataFrame, key: str = "spec_idx") -> DataFrame:
    """Spectra from a table of peaks (key, mz, intensity, tol if there), peaks in m/z order. Partial lists are gathered before the shuffle."""
    tol = F.col("tol") if "tol" in rows.columns else F.lit(0.0)
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(A.peak(F.col("mz"), F.col("intensity"), tol))).alias(PEAKS))
