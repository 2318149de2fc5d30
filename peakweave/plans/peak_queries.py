"""Queries over peak lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakweave.operators import peaks as P
from peakweave.sources.tables import view, with_views

R = 6


def _spectra(spark, d):
    return P.gathered(view(spark, d, "peaks").drop("peak_no", "part_no"))


def _with_parent(spark, d):
    return _spectra(spark, d).join(view(spark, d, "spectra").select("spec_idx", "parent_mass", "charge", "frag_type"), "spec_idx")


def _out(spectra):
    return P.exploded(spectra).select("spec_idx", F.round("mz", R).alias("mz"), F.round("intensity", R).alias("intensity"))


def peaks_normalize_tic(spark, d):
    return _out(P.normalize_total(_spectra(spark, d)))


def peaks_normalize_l2(spark, d):
    return _out(P.normalize_l2(_spectra(spark, d)))


def peaks_sqrt(spark, d):
    return _out(P.transform_intensity(_spectra(spark, d), "sqrt"))


def peaks_rank_intensity(spark, d):
    return _out(P.transform_intensity(_spectra(spark, d), "rank"))


def peaks_low_intensity(spark, d):
    return _out(P.low_intensity(_spectra(spark, d), 20000))


def peaks_mass_range(spark, d):
    return _out(P.mass_range(_spectra(spark, d), 400, 1500))


def peaks_noise_snr(spark, d):
    return _out(P.snr_filter(_spectra(spark, d), 2.0, least=4))


def peaks_deviation_filter(spark, d):
    return _out(P.deviation_filter(_spectra(spark, d), 2.0))


def peaks_topk(spark, d):
    return _out(P.top_k(_spectra(spark, d), 3))


def peaks_window_filter(spark, d):
    return _out(P.window_filter(_spectra(spark, d), 400, 1))


def peaks_rank_filter(spark, d):
    return _out(P.rank_filter(_spectra(spark, d), 1, 300.0))


def peaks_merge_close(spark, d):
    return _out(P.merge_close(_spectra(spark, d), 150.0))


def peaks_round_mz(spark, d):
    return _out(P.round_mz(_spectra(spark, d), 100.0))


def peaks_tolerance_ppm(spark, d):
    return P.set_tolerance(_spectra(spark, d), ppm=20).select("spec_idx", F.inline("peaks")).select("spec_idx", "mz", F.round("tol", 9).alias("tol"))


def peaks_reverse(spark, d):
    return _out(P.reverse(_with_parent(spark, d)))


def peaks_shift(spark, d):
    return _out(P.shift_mz(_spectra(spark, d), 1.5))


def peaks_rotate(spark, d):
    return _out(P.rotate(_with_parent(spark, d), 500.0))


def peaks_remove_reduced_precursors(spark, d):
    return _out(P.remove_reduced_precursors(_with_parent(spark, d), 50.0))


def peaks_terminals(spark, d):
    return _out(P.add_terminals(P.remove_terminals(_with_parent(spark, d))))


def peaks_symmetric_pairs(spark, d):
    return P.symmetric_pairs(_with_parent(spark, d), 50.0).select("spec_idx", "i", "j", F.round("error", R).alias("error"))


def peaks_make_symmetric(spark, d):
    return _out(P.make_symmetric(_with_parent(spark, d), 50.0))


def tic(spark, d):
    m = P.measures(_spectra(spark, d))
    return m.select("spec_idx", "n_peaks", F.round("tic", R).alias("tic"), F.round("density", R).alias("density"))


def parent_mass_mz(spark, d):
    s = P.set_parent(view(spark, d, "spectra"), parent_mass=F.col("parent_mass"))
    return s.select("spec_idx", F.round("parent_mass", R).alias("parent_mass"), F.round("parent_mz", R).alias("parent_mz"))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}


def _sql(body: str, where: str = "") -> str:
    return with_views(f"SELECT spec_idx, round(mz, {R}) AS mz, round(intensity, {R}) AS intensity FROM ({body}) {where}", "peaks")


def _parent_sql(body: str) -> str:
    return with_views(f"WITH j AS (SELECT p.spec_idx, mz, intensity, parent_mass, charge FROM peaks p JOIN spectra s USING (spec_idx)) SELECT spec_idx, round(mz, {R}) AS mz, round(intensity, {R}) AS intensity FROM ({body})", "peaks", "spectra")


_N = "row_number() OVER (PARTITION BY spec_idx ORDER BY intensity)"
_C = "count(*) OVER (PARTITION BY spec_idx)"
_ORDER = "ORDER BY mz, intensity"
_PROTON, _WATER, _GLY = 1.00727646688, 18.010564686, 57.0214637230
ORACLES = {
    "peaks_merge_close": with_views(f"""WITH RECURSIVE r AS (SELECT spec_idx, mz, intensity, row_number() OVER (PARTITION BY spec_idx ORDER BY mz, intensity) AS k FROM peaks),
        w(spec_idx, k, base, g) AS (SELECT spec_idx, k, mz, k FROM r WHERE k = 1 UNION ALL SELECT w.spec_idx, r.k, CASE WHEN r.mz - w.base <= 150 THEN w.base ELSE r.mz END, CASE WHEN r.mz - w.base <= 150 THEN w.g ELSE r.k END FROM w JOIN r ON r.spec_idx = w.spec_idx AND r.k = w.k + 1)
        SELECT spec_idx, round(arg_min(mz, (-intensity, k)), {R}) AS mz, round(sum(intensity), {R}) AS intensity FROM w JOIN r USING (spec_idx, k) GROUP BY spec_idx, g""", "peaks"),
    "peaks_normalize_tic": _sql("SELECT spec_idx, mz, intensity * 100 / sum(intensity) OVER (PARTITION BY spec_idx) AS intensity FROM peaks"),
    "peaks_normalize_l2": _sql("SELECT spec_idx, mz, intensity / sqrt(sum(intensity * intensity) OVER (PARTITION BY spec_idx)) AS intensity FROM peaks"),
    "peaks_sqrt": _sql("SELECT spec_idx, mz, sqrt(intensity) AS intensity FROM peaks"),
    "peaks_rank_intensity": _sql("SELECT spec_idx, mz, dense_rank() OVER (PARTITION BY spec_idx ORDER BY intensity)::DOUBLE AS intensity FROM peaks"),
    "peaks_low_intensity": _sql("SELECT * FROM peaks WHERE intensity >= 20000"),
    "peaks_mass_range": _sql("SELECT * FROM peaks WHERE mz BETWEEN 400 AND 1500"),
    "peaks_noise_snr": _sql(f"SELECT *, CASE WHEN c < 4 THEN 0 ELSE avg(CASE WHEN n <= c // 4 THEN intensity END) OVER (PARTITION BY spec_idx) END AS noise FROM (SELECT *, {_N} AS n, {_C} AS c FROM peaks)", "WHERE intensity >= 2.0 * noise"),
    "peaks_deviation_filter": _sql(f"SELECT *, avg(CASE WHEN n <= c // 4 THEN intensity END) OVER (PARTITION BY spec_idx) AS m, stddev_pop(CASE WHEN n <= c // 4 THEN intensity END) OVER (PARTITION BY spec_idx) AS s FROM (SELECT *, {_N} AS n, {_C} AS c FROM peaks)", "WHERE c < 4 OR intensity > m + 2.0 * s"),
    "peaks_topk": _sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spec_idx ORDER BY mz, intensity) AS i FROM peaks) QUALIFY row_number() OVER (PARTITION BY spec_idx ORDER BY intensity DESC, i DESC) <= 3"),
    "peaks_window_filter": _sql("SELECT * FROM peaks QUALIFY rank() OVER (PARTITION BY spec_idx, floor(mz / 400) ORDER BY intensity DESC, mz) <= 1"),
    "peaks_rank_filter": _sql("SELECT a.spec_idx, a.mz, a.intensity FROM peaks a WHERE NOT EXISTS (SELECT 1 FROM peaks b WHERE a.spec_idx = b.spec_idx AND abs(a.mz - b.mz) < 300.0 AND b.intensity > a.intensity)"),
    "peaks_round_mz": _sql("SELECT spec_idx, floor(mz / 100.0 + 0.5) AS mz, sum(intensity) AS intensity FROM peaks GROUP BY 1, 2"),
    "peaks_tolerance_ppm": with_views("SELECT spec_idx, mz, round(mz * 20 * 1e-6, 9) AS tol FROM peaks", "peaks"),
    "peaks_reverse": _parent_sql(f"SELECT *, parent_mass - {_PROTON} - mz AS m2 FROM j").replace("round(mz", "round(m2"),
    "peaks_shift": _sql("SELECT spec_idx, mz + 1.5 AS mz, intensity FROM peaks"),
    "peaks_rotate": _parent_sql("SELECT spec_idx, (mz + 500.0) - floor((mz + 500.0) / parent_mass) * parent_mass AS mz, intensity FROM j"),
    "peaks_remove_reduced_precursors": _parent_sql(f"SELECT * FROM j WHERE NOT list_bool_or(list_transform(range(1, greatest(charge, 1) + 1), lambda z: abs(mz - (parent_mass + (z - 1) * {_PROTON}) / z) <= 50.0))"),
    "peaks_terminals": _parent_sql(f"""SELECT spec_idx, mz, intensity FROM kept UNION ALL
        SELECT spec_idx, t.at AS mz, 1.0 AS intensity FROM (SELECT DISTINCT spec_idx, unnest([0.0, parent_mass - {_WATER} - {_PROTON}]) AS at FROM j) t
        WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.spec_idx = t.spec_idx AND abs(k.mz - t.at) <= 0.5)""").replace("WITH j", "WITH j", 1).replace(
        "JOIN spectra s USING (spec_idx)) SELECT", f"JOIN spectra s USING (spec_idx)), kept AS (SELECT * FROM j WHERE mz >= {_GLY} - 0.5 AND mz <= parent_mass - {_WATER} - {_PROTON} - {_GLY} + 0.5) SELECT", 1),
    "peaks_symmetric_pairs": with_views(f"""WITH j AS (SELECT spec_idx, mz, parent_mass, (row_number() OVER (PARTITION BY spec_idx {_ORDER}) - 1)::INT AS i FROM peaks JOIN spectra USING (spec_idx))
        SELECT a.spec_idx, a.i, b.i AS j, round(b.mz + a.mz - (a.parent_mass - {_PROTON}), {R}) AS error FROM j a JOIN j b ON a.spec_idx = b.spec_idx AND b.i >= a.i AND abs(b.mz + a.mz - (a.parent_mass - {_PROTON})) <= 50.0""", "peaks", "spectra"),
    "peaks_make_symmetric": _parent_sql(f"SELECT spec_idx, mz, intensity FROM j UNION ALL SELECT spec_idx, parent_mass - {_PROTON} - mz, 0.0 FROM j a WHERE NOT EXISTS (SELECT 1 FROM j b WHERE a.spec_idx = b.spec_idx AND abs(b.mz + a.mz - (a.parent_mass - {_PROTON})) <= 50.0)"),
    "tic": with_views(f"SELECT spec_idx, count(*)::INT AS n_peaks, round(sum(intensity), {R}) AS tic, round(CASE WHEN count(*) > 1 AND max(mz) > min(mz) THEN count(*) / (max(mz) - min(mz)) ELSE 0 END, {R}) AS density FROM peaks GROUP BY 1", "peaks"),
    "parent_mass_mz": with_views(f"SELECT spec_idx, round(parent_mass, {R}) AS parent_mass, round((parent_mass + (greatest(charge, 1) - 1) * {_PROTON}) / greatest(charge, 1), {R}) AS parent_mz FROM spectra", "spectra"),
}
