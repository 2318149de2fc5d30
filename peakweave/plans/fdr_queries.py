"""Target-decoy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakweave.operators import fdr
from peakweave.sources.tables import view, with_views

TIE = ["psm_id"]
R = 9


def _rated(spark, d):
    return fdr.cumulative_fdr(fdr.top_hit(view(spark, d, "psms"), ["scan", "file_idx"], tiebreak=TIE), tiebreak=TIE)


def fdr_concatenated(spark, d):
    out = _rated(spark, d)
    return out.select("psm_id", "scan", "file_idx", "score", "is_decoy", F.round("raw_fdr", R).alias("raw_fdr"), F.round("fdr", R).alias("fdr"))


def fdr_prefix_cutoff(spark, d):
    out = fdr.remove_decoys(fdr.prefix_cutoff(_rated(spark, d), 0.2))
    return out.select("psm_id", "scan", "file_idx", "score", F.round("fdr", R).alias("fdr"))


def top_hit_per_scan(spark, d):
    return fdr.top_hit(view(spark, d, "psms"), ["scan", "file_idx"], tiebreak=TIE).select("psm_id", "scan", "file_idx", "score", "annotation")


def fdr_separate(spark, d):
    p = view(spark, d, "psms")
    both = fdr.merge_target_decoy(p.filter("NOT is_decoy"), p.filter("is_decoy"), ["scan"], tiebreak=TIE)
    out = fdr.cumulative_fdr(both, tiebreak=TIE)
    return out.select("psm_id", "scan", "score", "is_decoy", F.round("fdr", R).alias("fdr"))


def fdr_split_charge(spark, d):
    out = fdr.split_fdr(view(spark, d, "psms"), ["charge"], tiebreak=TIE, autoscale=True)
    return out.select("psm_id", "charge", "score", F.round("raw_fdr", R).alias("raw_fdr"), F.round("fdr", R).alias("fdr"))


def fdr_peptide_level(spark, d):
    best = fdr.top_hit(view(spark, d, "psms"), ["annotation", "charge", "file_idx"], tiebreak=TIE)
    out = fdr.cumulative_fdr(best, ["charge"], tiebreak=TIE)
    return out.select("psm_id", "annotation", "charge", "file_idx", F.round("fdr", R).alias("pep_fdr"))


def fdr_protein_level(spark, d):
    out = fdr.protein_level(view(spark, d, "psms").withColumn("protein", F.expr("concat(CASE WHEN is_decoy THEN 'XXX' ELSE '' END, protein)")), 0.3, tiebreak=TIE)
    return out.select("psm_id", "protein", "score")


def remove_decoys(spark, d):
    return fdr.remove_decoys(view(spark, d, "psms")).select("psm_id", "scan", "score")


_TOP = "(SELECT * FROM psms QUALIFY row_number() OVER (PARTITION BY scan, file_idx ORDER BY score DESC, psm_id) = 1)"


def _cum(src: str, part: str = "", scale: str = "1.0") -> str:
    o = f"{part} ORDER BY score DESC, psm_id"
    n = f"sum(is_decoy::INT) OVER ({o} ROWS UNBOUNDED PRECEDING)"
    t = f"sum(1 - is_decoy::INT) OVER ({o} ROWS UNBOUNDED PRECEDING)"
    return f"""(SELECT *, min(raw) OVER ({o} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM
        (SELECT *, CASE WHEN {t} = 0 THEN 1.0 ELSE least(1.0, {n} * {scale} / {t}::DOUBLE) END AS raw FROM {src}))"""


QUERIES = {f.__name__: f for f in (fdr_concatenated, fdr_prefix_cutoff, top_hit_per_scan, fdr_separate, fdr_split_charge, fdr_peptide_level, fdr_protein_level, remove_decoys)}
ORACLES = {
    "fdr_concatenated": with_views(f"SELECT psm_id, scan, file_idx, score, is_decoy, round(raw, 9)::DOUBLE AS raw_fdr, round(q, 9)::DOUBLE AS fdr FROM {_cum(_TOP)}", "psms"),
    "fdr_prefix_cutoff": with_views(f"SELECT psm_id, scan, file_idx, score, round(q, 9)::DOUBLE AS fdr FROM {_cum(_TOP)} WHERE q <= 0.2 AND NOT is_decoy", "psms"),
    "top_hit_per_scan": with_views(f"SELECT psm_id, scan, file_idx, score, annotation FROM {_TOP}", "psms"),
    "fdr_separate": with_views(f"SELECT psm_id, scan, score, is_decoy, round(q, 9)::DOUBLE AS fdr FROM {_cum('(SELECT * FROM psms QUALIFY row_number() OVER (PARTITION BY scan ORDER BY score DESC, is_decoy, psm_id) = 1)')}", "psms"),
    "fdr_split_charge": with_views(f"SELECT psm_id, charge, score, round(raw, 9)::DOUBLE AS raw_fdr, round(q, 9)::DOUBLE AS fdr FROM {_cum('(SELECT *, (sum(1 - is_decoy::INT) OVER (PARTITION BY charge))::DOUBLE / nullif(sum(is_decoy::INT) OVER (PARTITION BY charge), 0) AS sc FROM psms QUALIFY sum(is_decoy::INT) OVER (PARTITION BY charge) > 0)', 'PARTITION BY charge', 'sc')}", "psms"),
    "fdr_peptide_level": with_views(f"SELECT psm_id, annotation, charge, file_idx, round(q, 9)::DOUBLE AS pep_fdr FROM {_cum('(SELECT * FROM psms QUALIFY row_number() OVER (PARTITION BY annotation, charge, file_idx ORDER BY score DESC, psm_id) = 1)', 'PARTITION BY charge')}", "psms"),
    "fdr_protein_level": with_views(f"""WITH named AS (SELECT psm_id, score, is_decoy, concat(CASE WHEN is_decoy THEN 'XXX' ELSE '' END, protein) AS protein FROM psms),
        ok AS (SELECT protein FROM {_cum('(SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY protein ORDER BY score DESC, psm_id) = 1)')} WHERE q <= 0.3 AND NOT is_decoy)
        SELECT psm_id, protein, score FROM named WHERE protein IN (SELECT protein FROM ok UNION SELECT concat('XXX', protein) FROM ok)""", "psms"),
    "remove_decoys": with_views("SELECT psm_id, scan, score FROM psms WHERE NOT is_decoy", "psms"),
}
