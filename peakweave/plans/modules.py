"""Named modules: inputs by name and text parameters in, one table out. What a module does is composed from the operators.

``python -m peakweave.plans.modules NAME PARAMS OUT input=path ...`` runs one from Parquet tables.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakweave.operators import clusters, fdr, graph, library, pairs, peaks, precursors, proteins, psms, sequencing, spectra
from peakweave.sources.tables_text import Parameters


@dataclass(frozen=True)
class Module:
    """A named operation with the inputs and parameters that it must have."""

    run: Callable[[dict[str, DataFrame], Parameters], DataFrame]
    inputs: tuple[str, ...]
    required: tuple[str, ...] = ()

    def __call__(self, inputs: dict[str, DataFrame], params: Parameters) -> DataFrame:
        if missing := [n for n in self.inputs if n not in inputs] + [n for n in self.required if n not in params]:
            raise ValueError(f"missing: {', '.join(missing)}")
        return self.run(inputs, params)


def convert(i: dict[str, DataFrame], p: Parameters) -> DataFrame:
    """Filters and conversions of spectra, in a fixed order; a parameter that isn't given leaves its step out."""
    s = i["spectra"]
    if "FILTER_INPUT_CHARGES" in p:
        s = spectra.of_charge(s, p["FILTER_INPUT_CHARGES"])
    if "FILTER_ACTIVATION" in p:
        s = spectra.of_kind(s, *p.choices("FILTER_ACTIVATION"))
    if p.flag("FIX_CHARGE_ZEROS"):
        s = s.withColumn("charge", F.when(F.col("charge") == 0, F.lit(int(p.number("DEFAULT_CHARGE", 2)))).otherwise(F.col("charge")))
    if "CONVERT_CHARGE" in p:
        s = sequencing.deconvoluted(s, p.number("TOLERANCE_PEAK", 0.02)).join(s.drop("peaks"), "spec_idx")
    if "MERGE_CONSECUTIVE" in p:
        s = spectra.consecutive_blocks(s, int(p["MERGE_CONSECUTIVE"])).withColumnRenamed("block", "spec_idx")
    if "FILTER_CHARGES" in p:
        s = spectra.of_charge(s, p["FILTER_CHARGES"])
    if "MASS_OFFSET" in p:
        s = peaks.shift_mz(s, p.number("MASS_OFFSET", 0))
    if "ACTIVATION" in p:
        s = s.withColumn("frag_type", F.lit(p["ACTIVATION"]))
    if "FILTER_STDDEV_PEAK_INT" in p:
        s = peaks.deviation_filter(s, p.number("FILTER_STDDEV_PEAK_INT", 2))
    if "RANK_FILTER" in p:
        s = peaks.rank_filter(s, int(p["RANK_FILTER"]), p.number("RANK_FILTER_RADIUS", 56.0214637230))
    if "TOP_PEAKS" in p:
        s = peaks.top_k(s, int(p["TOP_PEAKS"]))
    if "SET_SCAN_NUMS" in p:
        s = spectra.renumbered(s, ["spec_idx"], "scan")
    if p.flag("COMPRESS"):
        s = spectra.at_least_peaks(s, 1)
    if p.flag("ABS_INTENSITIES"):
        s = peaks.transform_intensity(s, "abs")
    if p.flag("FILTER_PRECURSOR_WINDOW"):
        s = peaks.precursor_window(s)
    if "MIN_PEAK_INT" in p:
        s = peaks.low_intensity(s, p.number("MIN_PEAK_INT", 0))
    if "FILENAME" in p:
        s = s.withColumn("file_name", F.lit(p["FILENAME"]))
    if p.flag("REMOVE_ETD_REDUCED_Z"):
        s = peaks.remove_reduced_precursors(s, p.number("TOLERANCE_PM", 0.5))
    return s


def filter_edges(i: dict[str, DataFrame], p: Parameters) -> DataFrame:
    """Edges by p-value and ratio, triangles, variants, unique masses, edge rate and component size, in that order."""
    e, s = i["edges"], i["spectra"]
    if "MAX_PVALUE" in p:
        e = pairs.significant(e, pairs.score_statistics(e), p.number("MAX_PVALUE", 0.05), p.number("MIN_RATIO", 0) if "MIN_RATIO" in p else None).select(*e.columns)
    if p.flag("FILTER_TRIGS"):
        e = graph.in_triangles(e, p.number("TOLERANCE_PM", 1.0))
    if "MAX_SPEC_PER_VARIANT" in p:
        e = graph.limit_per_variant(e, s, int(p["MAX_SPEC_PER_VARIANT"]))
    if "MAX_UNIQUE_MASS_NUMBER" in p:
        e = graph.limit_unique_masses(e, s, int(p["MAX_UNIQUE_MASS_NUMBER"]))
    if "EDGE_FDR" in p:
        e = pairs.edge_fdr(e, p.number("EDGE_FDR", 1.0))
    if "MAX_COMPONENT_SIZE" in p:
        e = graph.limit_component_size(e, int(p["MAX_COMPONENT_SIZE"]))
    return e


def peptide_fdr(i: dict[str, DataFrame], p: Parameters) -> DataFrame:
    """Target-decoy filtering: concatenated, separate (inputs targets and decoys), or split by columns."""
    how, tie, cut = p.get("TDA_TYPE", "concatenated"), ["psm_id"], p.number("FDR_THRESHOLD", 0.01)
    if how == "separate":
        both = fdr.merge_target_decoy(i["targets"], i["decoys"], ["file_idx", "scan"], tiebreak=tie)
    else:
        both = fdr.top_hit(i["psms"], ["file_idx", "scan"], tiebreak=tie)
    if how.startswith("split"):
        rated = fdr.split_fdr(both, p.choices("SPLIT_COLUMNS") or ["charge"], tiebreak=tie, autoscale=p.flag("PEPTIDE_FDR_AUTOSCALE"))
    else:
        rated = fdr.cumulative_fdr(both, tiebreak=tie, scale=p.number("PEPTIDE_FDR_SCALE", 1.0))
    kept = fdr.prefix_cutoff(rated, cut, p.flag("KEEP_FIRST"), tiebreak=tie)
    return fdr.remove_decoys(kept) if p.flag("FDR_REMOVE_DECOYS", True) else kept


def cosine_network(i: dict[str, DataFrame], p: Parameters) -> DataFrame:
    """Edges of the cosine network."""
    return pairs.cosine_network(i["spectra"], p.number("MAX_SHIFT", 1.0), p.number("TOLERANCE_PEAK", 0.5), p.number("PAIRS_MIN_COSINE", 0.7), int(p.number("MIN_MATCHED_PEAKS", 6)), p.number("MIN_RATIO", 0.0), p.number("TOLERANCE_PM", 0.0))


def library_create(i: dict[str, DataFrame], p: Parameters) -> DataFrame:
    """Annotated entries that pass the thresholds."""
    off = lambda n: p.number(n, -1)
    return library.filtered(i["spectra"], off("FDR") if "fdr" in i["spectra"].columns else None, off("PVALUE") if "p_value" in i["spectra"].columns else None, off("ENVELOPE") if "envelope" in i["spectra"].columns else None, without_residues=p.get("EXCLUDE_RESIDUES"))


def library_search(i: dict[str, DataFrame], p: Parameters) -> DataFrame:
    """Winners of a target-decoy search, or the top hits of a library without decoys."""
    width = p.number("BIN_WIDTH", 1.0005)
    vectors = lambda s: pairs.binned(s.select("spec_idx", F.inline("peaks")), width)
    found = library.scored(library.candidates(i["spectra"], i["library"], p.number("TOLERANCE_PM", 1.0)), vectors(i["spectra"]), vectors(i["library"]))
    if "is_decoy" in i["library"].columns:
        return library.target_decoy_winners(found)
    return library.top_hits(found, int(p.number("TOP_HITS", 1)), p.number("SCORE_THRESHOLD", 0.0), int(p.number("MIN_SHARED_PEAKS", 1)))


def assembly(i: dict[str, DataFrame], p: Parameters) -> DataFrame:
    """Contigs of the components of aligned pairs."""
    tol, s = p.number("TOLERANCE_PEAK", 0.05), i["spectra"]
    side = lambda n: s.select(F.col("spec_idx").alias(f"spec{n}"), F.col("peaks").alias(f"peaks{n}"), F.col("parent_mass").alias(f"mass{n}"))
    both = i["edges"].select("spec1", "spec2").join(side(1), "spec1").join(side(2), "spec2")
    return sequencing.assembled(s, sequencing.spectral_alignments(both, tol), tol)


MODULES: dict[str, Module] = {
    "convert": Module(convert, ("spectra",)),
    "cosine_network": Module(cosine_network, ("spectra",)),
    "modified_pairs": Module(lambda i, p: pairs.best_shift_pairs(i["spectra"], p.number("MAX_SHIFT", 100), p.number("TOLERANCE_PEAK", 0.5), least_ratio=p.number("MIN_RATIO", 0), least_matched=int(p.number("MIN_MATCHED_PEAKS", 6))), ("spectra",)),
    "overlap_pairs": Module(lambda i, p: pairs.overlap_pairs(i["spectra"], p.number("TOLERANCE_PEAK", 0.5), p.number("MIN_OVERLAP", 300), int(p.number("MIN_MATCHED_PEAKS", 6)), p.number("MAX_JUMP", 400)), ("spectra",)),
    "filter_edges": Module(filter_edges, ("edges", "spectra")),
    "cluster": Module(lambda i, p: clusters.cosine_clusters(i["spectra"], p.number("TOLERANCE_PM", 1), p.number("TOLERANCE_PEAK", 0.5), p.number("MIN_COSINE", 0.7), int(p.number("MIN_MATCHED_PEAKS", 5))), ("spectra",)),
    "cluster_purity": Module(lambda i, p: clusters.purity(i["members"]), ("members",)),
    "deconvolute": Module(lambda i, p: sequencing.deconvoluted(i["spectra"], p.number("TOLERANCE_PEAK", 0.02)), ("spectra",)),
    "tags": Module(lambda i, p: sequencing.tags(i["spectra"], int(p.number("TAG_LEN", 3)), p.number("TOLERANCE_PEAK", 0.05), int(p.number("MAX_TAGS", 10)), int(p.number("DOUBLE_AA_JUMPS", 0))), ("spectra",)),
    "tag_pairs": Module(lambda i, p: sequencing.shared_tag_pairs(i["tags"], p.number("TOLERANCE_PM", 1)), ("tags",)),
    "tag_search": Module(lambda i, p: proteins.tag_search(i["tags"], i["proteins"], p.number("TOLERANCE_PM", 0.5), int(p.number("MIN_FLANKS", 1)), int(p.number("TAG_LEN", 3))), ("tags", "proteins")),
    "first_correct_tag": Module(lambda i, p: sequencing.first_correct_tag(i["tags"], i["psms"]), ("tags", "psms")),
    "peptide_fdr": Module(peptide_fdr, ()),
    "propagate": Module(lambda i, p: graph.propagate(i["edges"], i["seeds"], int(p.number("MAX_STEPS", 5))), ("edges", "seeds")),
    "stars": Module(lambda i, p: sequencing.stars(i["spectra"], i["edges"], p.number("TOLERANCE_PEAK", 0.5)), ("spectra", "edges")),
    "assembly": Module(assembly, ("spectra", "edges")),
    "meta_assembly": Module(lambda i, p: sequencing.meta_assembled(i["contigs"], p.number("TOLERANCE_PEAK", 0.05), p.number("MIN_OVERLAP", 200), int(p.number("MIN_MATCHED_PEAKS", 4))), ("contigs",)),
    "cyclic": Module(lambda i, p: sequencing.cyclic(i["spectra"], p.number("TOLERANCE_PEAK", 0.05)), ("spectra",)),
    "precursors": Module(lambda i, p: precursors.isotope_filter(precursors.guess(precursors.with_survey(i["spectra"], ["scan"], ["file_name"]), p.number("TOLERANCE_PEAK", 0.05)), p.number("STRICT_FILTER", 0)), ("spectra",)),
    "merge_stages": Module(lambda i, p: precursors.merged_stages(i["spectra"], p.number("TOLERANCE_PEAK", 0.5)), ("spectra",)),
    "boost": Module(lambda i, p: precursors.boosted(i["spectra"], p.choices("KEYS") or ["precursor"], p.number("TOLERANCE_PEAK", 0.05)), ("spectra",)),
    "penalties": Module(lambda i, p: precursors.penalties(i["frequencies"], p.number("AVERAGE_INTENSITY", 1.0)), ("frequencies",)),
    "supported_mods": Module(lambda i, p: psms.supported_mods(i["psms"], int(p.number("MIN_PEPTIDES", 2))), ("psms",)),
    "peptide_database": Module(lambda i, p: psms.as_proteins(i["psms"]), ("psms",)),
    "compare_psms": Module(lambda i, p: psms.compare(i["first"], i["second"]), ("first", "second")),
    "subtract_psms": Module(lambda i, p: psms.subtract(i["psms"], i["other"], p.flag("INVERT")), ("psms", "other")),
    "de_novo": Module(lambda i, p: sequencing.de_novo(i["spectra"], p.number("TOLERANCE_PEAK", 0.05)), ("spectra",)),
    "spectral_probability": Module(lambda i, p: sequencing.spectral_probability(i["spectra"]), ("spectra",)),
    "protein_alignment": Module(lambda i, p: sequencing.protein_alignments(i["candidates"], p.number("TOLERANCE_PEAK", 0.5), p.number("MOD_PENALTY", 0.3), int(p.number("MAX_NUM_MODS", 1))), ("candidates",)),
    "localisation": Module(lambda i, p: sequencing.localisation(i["psms"], p.number("TOLERANCE_PEAK", 0.5)), ("psms",)),
    "library_create": Module(library_create, ("spectra",)),
    "library_decoys": Module(lambda i, p: library.decoys(i["library"], p.number("TOLERANCE_PEAK", 0.5), int(p.number("SEED", 1))), ("library",)),
    "library_search": Module(library_search, ("spectra", "library")),
    "library_truncate": Module(lambda i, p: library.truncated(i["library"], int(p.number("MAX_PEAKS", 500))), ("library",)),
    "library_remove": Module(lambda i, p: library.removed(i["library"], i["ids"]), ("library", "ids")),
    "library_peaks": Module(lambda i, p: library.peak_statistics(i["library"]), ("library",)),
    "library_substitute": Module(lambda i, p: library.substituted(i["library"], p["FROM"], p["TO"], p.number("TOLERANCE_PEAK", 0.5)), ("library",), ("FROM", "TO")),
    "protein_decoys": Module(lambda i, p: proteins.with_decoys(i["proteins"], p.get("PREFIX", "XXX")), ("proteins",)),
    "protein_coverage": Module(lambda i, p: proteins.coverage(i["hits"], i["proteins"]), ("hits", "proteins")),
    "parsimony": Module(lambda i, p: psms.parsimony(i["psms"]), ("psms",)),
    "mod_counts": Module(lambda i, p: psms.mod_counts(i["psms"]), ("psms",)),
    "variants": Module(lambda i, p: psms.variants(i["psms"], i["proteins"], p.number("MIN_OVERLAP", 0.5)), ("psms", "proteins")),
    "extract": Module(lambda i, p: spectra.extracted(i["spectra"], i["wanted"], p.choices("KEYS") or ["file_name", "scan"]), ("spectra", "wanted")),
    "explained_intensity": Module(lambda i, p: sequencing.explained_intensity(i["spectra"], p.number("TOLERANCE_PEAK", 0.5)), ("spectra",)),
    "match_features": Module(lambda i, p: sequencing.match_features(i["spectra"], p.number("TOLERANCE_PEAK", 0.5)), ("spectra",)),
    "mass_errors": Module(lambda i, p: sequencing.mass_errors(sequencing.annotated_peaks(i["spectra"], p.number("TOLERANCE_PEAK", 0.5)), p.number("BIN_PPM", 5.0)), ("spectra",)),
    "pair_quality": Module(lambda i, p: pairs.precision_recall(i["edges"], i["gold"]), ("edges", "gold")),
    "modification_frequencies": Module(lambda i, p: pairs.modification_frequencies(i["edges"], p.number("RESOLUTION", 1.0), p.number("MAX_MOD_MASS", 100.0)), ("edges",)),
}


def run(name: str, inputs: dict[str, DataFrame], params: Parameters | None = None) -> DataFrame:
    """One module by name."""
    if name not in MODULES:
        raise ValueError(f"no module {name}; there are {', '.join(sorted(MODULES))}")
    return MODULES[name](inputs, params or Parameters())


def main(args: list[str]) -> None:
    """NAME PARAMS OUT input=path ..."""
    name, params, out, *inputs = args
    spark = SparkSession.builder.getOrCreate()
    text = "\n".join(r["value"] for r in spark.read.text(params).collect())
    tables = {k: spark.read.parquet(v) for k, _, v in (x.partition("=") for x in inputs)}
    run(name, tables, Parameters.from_text(text)).write.parquet(out)


if __name__ == "__main__":
    main(sys.argv[1:])
