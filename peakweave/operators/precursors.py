"""Operators around the precursor: its charge and mass from the survey spectrum, isotope filters, spectra of one precursor combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakweave.functions import arrays as A
from peakweave.operators import kernels
from peakweave.operators.peaks import gathered
from peakweave.operators.spectra import last_ms1

#: Difference of isotopes in Dalton.
ISOTOPE = 1.00286864


def _nearest(peaks: Column, mz: Column, tolerance: float) -> Column:
    """Intensity of the strongest peak within the tolerance, 0 if none."""
    return F.coalesce(F.array_max(F.transform(F.filter(peaks, lambda p: F.abs(p["mz"] - mz) <= tolerance), lambda p: p["intensity"])), F.lit(0.0))


def envelope_model(mass: Column, size: int) -> Column:
    """Isotope envelope of an average peptide, scaled to 1 (see kernels.envelope)."""
    mean = mass / 1800.0
    terms = [F.lit(1.0)]
    for k in range(1, size):
        terms.append(terms[-1] * mean / k)
    total = sum(terms[1:], terms[0])
    return F.array(*[t / total for t in terms])


def divergence(observed: Column, model: Column) -> Column:
    """Sum of p log(p / q) of two arrays, the first scaled to 1; null for nothing observed."""
    total = F.aggregate(observed, F.lit(0.0), lambda a, x: a + x)
    parts = F.zip_with(observed, model, lambda o, q: F.when(o > 0, (o / total) * F.log((o / total) / q)).otherwise(0.0))
    return F.when(total > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))


def with_survey(spectra: DataFrame, order: list[str], partition: list[str]) -> DataFrame:
    """Spectra above level 1 with the peaks of the latest survey spectrum before them, as ms1_peaks."""
    return last_ms1(spectra, order, partition, ["peaks"])


def guess(surveyed: DataFrame, tolerance: float, charges: tuple[int, ...] = (1, 2, 3, 4), offsets: tuple[int, ...] = (0, 1), size: int = 4) -> DataFrame:
    """charge, parent_mz and parent_mass corrected by the survey spectrum, and precursor_kl, the fit (lower is better).

    Each charge and number of isotopes that the recorded m/z may lie above the first is tried; spectra whose survey shows nothing stay as they are.
    """
    tried = []
    for z in charges:
        for k in offsets:
            mz = F.col("parent_mz") - k * ISOTOPE / z
            seen = F.array(*[_nearest(F.col("ms1_peaks"), mz + n * ISOTOPE / z, tolerance) for n in range(size)])
            fit = F.when(F.get(seen, 0) > 0, divergence(seen, envelope_model((mz - A.PROTON) * z, size)))
            tried.append(F.struct(fit.alias("kl"), F.lit(k).alias("k"), F.lit(z).alias("z"), mz.alias("mz")))
    best = F.array_min(F.filter(F.array(*tried), lambda t: t["kl"].isNotNull()))
    out = surveyed.withColumn("_b", best).withColumn("precursor_kl", F.col("_b.kl"))
    out = out.withColumn("charge", F.coalesce("_b.z", "charge")).withColumn("parent_mz", F.coalesce("_b.mz", "parent_mz"))
    return out.withColumn("parent_mass", F.col("parent_mz") * F.greatest("charge", F.lit(1)) - (F.greatest("charge", F.lit(1)) - 1) * A.PROTON).drop("_b", "ms1_peaks")


def isotope_filter(guessed: DataFrame, most: float = 0.0) -> DataFrame:
    """Spectra whose precursor fits better than ``most``; 0 keeps all."""
    return guessed if most == 0 else guessed.filter(F.col("precursor_kl") < most)


def prefix_scores(spectra: DataFrame, ions: list[tuple[float, float, float]], tolerance: float) -> DataFrame:
    """Peaks read as prefix masses, their intensity a log-likelihood.

    ions: (offset from the prefix mass, probability of a peak there, background probability). Each candidate prefix mass gets log(p / q) for every ion with a
    peak and log((1 - p) / (1 - q)) for every one without.
    """
    from math import log

    first = ions[0][0]

    def score(m: Column) -> Column:
        parts = [F.when(F.size(F.filter(F.col("_all"), _at(m, o, tolerance))) > 0, log(p / b)).otherwise(log((1 - p) / (1 - b))) for o, p, b in ions]
        return sum(parts[1:], parts[0])

    return spectra.withColumn("_all", F.col("peaks")).withColumn("peaks", A.map_peaks(F.col("peaks"), mz=lambda p: p["mz"] - first, intensity=lambda p: score(p["mz"] - first))).drop("_all")


def _at(m: Column, offset: float, tolerance: float):
    return lambda q: F.abs(q["mz"] - m - offset) <= tolerance


def weighted_mass(rows: DataFrame, key: str) -> DataFrame:
    """key, mz: the intensity-weighted mean m/z of each group of peaks."""
    return rows.groupBy(key).agg((F.sum(F.col("mz") * F.col("intensity")) / F.sum("intensity")).alias("mz"))


def boosted(spectra: DataFrame, group: list[str], tolerance: float) -> DataFrame:
    """group, peaks: spectra of one precursor (by several fragmentations) combined; peaks within one tolerance-wide bin add up, times the number of kinds that show them."""
    return boosted_peaks(spectra.select(*group, "frag_type", F.inline("peaks")), group, tolerance)


#: Peaks that a task combines, about.
TASK_PEAKS = 250_000


def boosted_peaks(peaks: DataFrame, group: list[str], tolerance: float, n: int = 0) -> DataFrame:
    """What ``boosted`` gives, of a table of peaks: group, frag_type, mz, intensity, tol. n: their number, if known; tasks then grow in number with it, not in size."""
    each = peaks.withColumn("_bin", F.floor(F.col("mz") / (2 * tolerance) + 0.5).cast("long"))
    tasks = n // TASK_PEAKS + 1
    if tasks > int(peaks.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        each = each.repartition(tasks, *group)
    kinds = each.groupBy(*group, "_bin", "frag_type").agg(F.sum(F.col("mz") * F.col("intensity")).alias("m"), F.sum("intensity").alias("i"), F.max("tol").alias("tol"))
    bins = kinds.groupBy(*group, "_bin").agg((F.sum("m") / F.sum("i")).alias("mz"), F.sum("i").alias("i"), F.count("frag_type").alias("kinds"), F.max("tol").alias("tol"))
    return bins.groupBy(*group).agg(F.array_sort(F.collect_list(A.peak(F.col("mz"), F.col("i") * F.col("kinds"), F.col("tol")))).alias("peaks"))


def merged_stages(spectra: DataFrame, tolerance: float) -> DataFrame:
    """spec_idx, peaks: each second-stage spectrum with the peaks of the third stage that its own peaks support (same m/z, or complement of the third stage's precursor), summed.

    Third-stage rows have ``parent_spec``, the second-stage spectrum that they come from.
    """
    two = spectra.filter("ms_level = 2").select("spec_idx", "parent_mass", F.col("peaks").alias("own"))
    three = spectra.filter("ms_level = 3").select(F.col("parent_spec").alias("spec_idx"), F.col("parent_mass").alias("mass3"), F.col("peaks").alias("p3"))
    both = two.join(three, "spec_idx")
    kept = F.filter("p3", lambda p: F.exists(F.col("own"), lambda q: (F.abs(p["mz"] - q["mz"]) <= tolerance) | (F.abs(F.col("mass3") - A.PROTON - p["mz"] - q["mz"]) <= tolerance)))
    rows = both.select("spec_idx", F.inline(kept)).unionByName(two.select("spec_idx", F.inline("own")))
    return gathered(rows.groupBy("spec_idx", "mz").agg(F.sum("intensity").alias("intensity"), F.max("tol").alias("tol")))


def placements(psms: DataFrame, most: int = 2) -> DataFrame:
    """psm_id, positions: the ways to put ``n_mods`` equal modifications (at most ``most``) on the residues of ``plain`` that ``sites`` lists, in rising order."""
    open_ = F.filter(F.sequence(F.lit(1), F.length("plain")), lambda i: F.contains(F.col("sites"), F.substr(F.col("plain"), i, F.lit(1))))
    rows = psms.select("psm_id", "n_mods", open_.alias("open"), F.array().cast("array<int>").alias("positions"))
    out = rows.filter("n_mods = 0").select("psm_id", "positions")
    now = rows.filter("n_mods > 0")
    for n in range(1, most + 1):
        now = now.withColumn("next", F.explode(F.filter("open", lambda i: i > F.coalesce(F.array_max("positions"), F.lit(0))))).withColumn("positions", F.array_append("positions", F.col("next"))).drop("next")
        out = out.unionByName(now.filter(F.col("n_mods") == n).select("psm_id", "positions"))
    return out


def penalties(frequencies: DataFrame, average_intensity: float, least: float = 0.01) -> DataFrame:
    """mass, penalty: -log10 of a modification's share, as a share of the rarest one's, times the average intensity; frequencies under ``least`` aren't known."""
    known = frequencies.filter(F.col("frequency") >= least).withColumn("_p", -F.log10("frequency"))
    top = known.agg(F.max("_p").alias("_t"))
    return known.select("mass", F.when(top.scalar() > 0, F.col("_p") / top.scalar() * average_intensity).otherwise(0.0).alias("penalty"))


def partners(modified: DataFrame, unmodified: DataFrame) -> DataFrame:
    """Each modified match with the best (by score, then psm_id) unmodified match of its plain peptide and charge, as ``partner``."""
    w = Window.partitionBy("plain", "charge").orderBy(F.desc("score"), "psm_id")
    best = unmodified.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("plain", "charge", F.col("psm_id").alias("partner"))
    return modified.join(best, ["plain", "charge"])


def contig_spectra(contigs: DataFrame) -> DataFrame:
    """Contigs as spectra (spec_idx, parent_mass, peaks), so that pairs, alignment and assembly run on them again."""
    pk = F.transform("vertices", lambda v: A.peak(v["mz"] - F.element_at("vertices", 1)["mz"], v["score"], F.lit(0.0)))
    return contigs.filter(F.size("vertices") > 0).select(F.col("contig_idx").alias("spec_idx"), (F.element_at("vertices", -1)["mz"] - F.element_at("vertices", 1)["mz"] + 19.01784115).alias("parent_mass"), pk.alias("peaks"))


def contig_statistics(contigs: DataFrame) -> DataFrame:
    """contig_idx, n_vertices, n_spectra, mean_members, gaps (steps between vertices), explained (percent of steps that are a residue's mass within 0.05)."""
    near = list(kernels.RESIDUES.values())
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size("vertices") - 1, F.lit(1))), lambda i: F.get("vertices", i)["mz"] - F.get("vertices", i - 1)["mz"])
    steps = F.when(F.size("vertices") > 1, steps).otherwise(F.array().cast("array<double>"))
    fit = F.filter(steps, lambda d: F.exists(F.array(*[F.lit(m) for m in near]), lambda m: F.abs(d - m) <= 0.05))
    spec = F.array_distinct(F.flatten(F.transform("vertices", lambda v: F.transform(v["members"], lambda x: x["spec_idx"]))))
    members = F.aggregate("vertices", F.lit(0), lambda a, v: a + F.size(v["members"]))
    return contigs.select("contig_idx", F.size("vertices").alias("n_vertices"), F.size(spec).alias("n_spectra"), (members / F.size("vertices")).alias("mean_members"), F.size(steps).alias("gaps"), F.when(F.size(steps) > 0, 100.0 * F.size(fit) / F.size(steps)).otherwise(0.0).alias("explained"))
