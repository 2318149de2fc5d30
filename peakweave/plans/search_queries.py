"""Queries over libraries, matches and pairs: searches by distributions and tags, maintenance, modules, and alignments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from peakweave.functions import arrays as A
from peakweave.functions import peptide, text
from peakweave.operators import clusters, distributions, library, pairs, proteins, psms, sequencing, spectra
from peakweave.operators import peaks as P
from peakweave.plans import modules
from peakweave.plans.network_queries import _B, _E, _edges, _spectra
from peakweave.plans.psm_queries import _ANN, _DUCK_PEPTIDES, _MASS, _annotated, _peptides
from peakweave.plans.sequencing_queries import _spectra as _prefix_spectra
from peakweave.plans.sequencing_queries import _tags_sql
from peakweave.session import written
from peakweave.sources.tables import table, view, with_views
from peakweave.sources.tables_text import Parameters

R = 6


def _consensus(spark, d):
    """A library: one spectrum per distinct peptide, peaks at its ions."""
    p = _peptides(spark, d).filter("length(plain) > 1").groupBy("plain").agg(F.min("psm_id").alias("spec_idx"))
    peaks = F.transform(peptide.ions(F.col("plain")), lambda i: A.peak(i["mz"], i["number"] + 0.123, F.lit(0.0)))
    return p.select("spec_idx", F.col("plain").alias("annotation"), F.lit(2).alias("charge"), peptide.parent_mass(F.col("plain")).alias("parent_mz"), A.by_mz(peaks).alias("peaks"))


def _replicates(spark, d):
    """Three replicates of each entry: other intensities, and a sixth of the ions lost."""
    p = _peptides(spark, d).filter("length(plain) > 1").groupBy("plain").agg(F.min("psm_id").alias("entry")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2))))
    seed = lambda i: F.col("entry") + i["number"] + F.col("copy")
    kept = F.filter(peptide.ions(F.col("plain")), lambda i: seed(i) % 6 != 0)
    peaks = F.transform(kept, lambda i: A.peak(i["mz"], (i["number"] + 0.123) * (1.31 + seed(i) % 5), F.lit(0.0)))
    return p.select((F.col("entry") * 3 + F.col("copy")).alias("spec_idx"), F.col("plain").alias("annotation"), F.lit(2).alias("charge"), peptide.parent_mass(F.col("plain")).alias("parent_mz"), A.by_mz(peaks).alias("peaks"))


def distribution_ratios(spark, d):
    return distributions.trained(_replicates(spark, d), _consensus(spark, d), 0.001)[0]


def distribution_losses(spark, d):
    return distributions.trained(_replicates(spark, d), _consensus(spark, d), 0.001)[1]


def distribution_search(spark, d):
    """Replicates against the library and its reversed peptides, scored by the distributions that the replicates teach."""
    # the parts are read once for the library and once for the replicates; both are read often
    lib, replicates = written(_consensus(spark, d), "library"), written(_replicates(spark, d), "replicates")
    fit = distributions.model(*distributions.trained(replicates, lib, 0.001))
    decoys = lib.withColumn("annotation", F.reverse("annotation")).withColumn("spec_idx", -F.col("spec_idx"))
    decoys = decoys.withColumn("peaks", A.by_mz(F.transform(peptide.ions(F.col("annotation")), lambda i: A.peak(i["mz"], i["number"] + 0.123, F.lit(0.0)))))
    both = written(lib.withColumn("is_decoy", F.lit(False)).unionByName(decoys.withColumn("is_decoy", F.lit(True))), "library")
    below = distributions.score_distributions(both, *fit, 0.001)
    found = distributions.searched(replicates, both, written(below, "below"), 0.01, 0.001)
    return found.select("query", "entry", "is_decoy", F.round("cosine", R).alias("cosine"), F.round("explained", R).alias("explained"), F.round("score", R).alias("score"))


def library_tag_prefilter(spark, d):
    t = sequencing.tags(_prefix_spectra(spark, d), 4, 0.01, 3).select("spec_idx", "tag", "before")
    return distributions.shared_tags(t, t, 0.02, 2).filter("query <> entry")


def _library(spark, d):
    return _spectra(spark, d).withColumn("annotation", F.col("frag_type"))


def library_truncate(spark, d):
    out = library.truncated(_library(spark, d), 3)
    return out.select("spec_idx", "cut", F.size("peaks").alias("n_peaks"), F.round(F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["intensity"]), 2).alias("total"))


def library_remove(spark, d):
    ids = table(spark, d, "events").filter("event_type = 'error'").select(F.col("event_id").alias("spec_idx"))
    return library.removed(view(spark, d, "spectra").select("spec_idx", "charge"), ids)


def library_peak_statistics(spark, d):
    s = library.peak_statistics(_library(spark, d))
    return s.select("annotation", "n", F.round("peaks", R).alias("peaks"), F.round("intensity", 4).alias("intensity"))


def library_create(spark, d):
    lib = view(spark, d, "spectra").select("spec_idx", F.col("frag_type").alias("annotation"), (F.col("charge") / 10).alias("p_value"), "charge")
    return modules.run("library_create", {"spectra": lib}, Parameters({"PVALUE": "0.3", "EXCLUDE_RESIDUES": "O"})).select("spec_idx", "annotation")


def module_convert(spark, d):
    """Several steps of the conversion by one set of parameters."""
    s = _spectra(spark, d).withColumn("parent_mz", F.col("parent_mass"))
    p = Parameters({"FILTER_ACTIVATION": "F;O", "MASS_OFFSET": "1.5", "TOP_PEAKS": "4", "FILTER_PRECURSOR_WINDOW": "1", "MIN_PEAK_INT": "5000", "FILENAME": "converted"})
    return modules.run("convert", {"spectra": s}, p).select("spec_idx", "frag_type", "file_name", F.inline("peaks")).select("spec_idx", "frag_type", "file_name", "mz", "intensity")


def module_filter_edges(spark, d):
    none = table(spark, d, "part").select(F.col("p_partkey").alias("spec_idx"), F.lit(1.0).alias("parent_mass"))
    return modules.run("filter_edges", {"edges": _edges(spark, d), "spectra": none}, Parameters({"MAX_PVALUE": "0.2"})).select("spec1", "spec2")


def module_modification_frequencies(spark, d):
    f = modules.run("modification_frequencies", {"edges": _edges(spark, d)}, Parameters({"RESOLUTION": "2", "MAX_MOD_MASS": "20"}))
    return f.select("mass", F.round("frequency", 9).alias("frequency"))


def module_penalties(spark, d):
    f = table(spark, d, "part").groupBy(F.col("p_size").cast("double").alias("mass")).agg((F.count(F.lit(1)) / 2000).alias("frequency"))
    return modules.run("penalties", {"frequencies": f}, Parameters({"AVERAGE_INTENSITY": "3"})).select("mass", F.round("penalty", 9).alias("penalty"))


def module_supported_mods(spark, d):
    return modules.run("supported_mods", {"psms": _annotated(spark, d)}, Parameters({"MIN_PEPTIDES": "3"}))


def module_peptide_database(spark, d):
    return modules.run("peptide_database", {"psms": _annotated(spark, d)}).select("db_index", "id", "sequence")


def module_subtract(spark, d):
    p = view(spark, d, "psms")
    return modules.run("subtract_psms", {"psms": p, "other": p.filter("is_decoy")}, Parameters({"INVERT": "1"})).select("psm_id", "scan")


def cluster_ranks(spark, d):
    o = table(spark, d, "orders")
    return clusters.redundant(o.select(F.col("o_custkey").alias("cluster_idx"), F.col("o_orderkey").alias("scan"), F.col("o_totalprice").alias("precursor_intensity"))).select("cluster_idx", "scan", F.col("rank").cast("long").alias("rank"))


def psm_in_networks(spark, d):
    members = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("spec_idx"))
    return psms.in_networks(view(spark, d, "psms").withColumn("spec_idx", F.col("psm_id")), members).select("psm_id", "scan")


def psm_append(spark, d):
    p = view(spark, d, "psms").select("psm_id", "scan", "score")
    return spectra.append(p.filter("score > 300"), p.filter("score <= 300"), p)


def psm_sorted(spark, d):
    return spectra.renumbered(view(spark, d, "psms").select("psm_id", "scan", "file_idx"), ["file_idx", "scan", "psm_id"], "place").select("psm_id", F.col("place").cast("long").alias("place"))


def pairs_sorted(spark, d):
    e = _edges(spark, d).select("spec1", "spec2", "score1", "score2", (-F.least("score1", "score2")).alias("low"), (-F.greatest("score1", "score2")).alias("high"))
    return spectra.renumbered(e, ["low", "high", "spec1", "spec2"], "place").select("spec1", "spec2", F.col("place").cast("long").alias("place"))


def pair_dissimilar_tops(spark, d):
    both = pairs.class_pairs(pairs.classes(_spectra(spark, d), ["peaks"]), 0.2, ["peaks"])
    return pairs.expanded(clusters.dissimilar_tops(both, 3, 50.0, 1).select("members1", "members2"))


def spectral_stars(spark, d):
    out = sequencing.band_stars(_spectra(spark, d), 0.2, 20.0)
    return out.select("spec_idx", F.inline("peaks")).select("spec_idx", "mz", F.round("intensity", 2).alias("intensity"))


def peak_positions(spark, d):
    return P.positions_of(P.gathered(view(spark, d, "peaks").select("spec_idx", "mz", "intensity")), [400.0, 1000.0], 60.0).select("spec_idx", "mass", F.col("position").cast("int").alias("position"))


def combinations_of(spark, d):
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return text.combinations(n, "names", 3).select("n_regionkey", F.array_join("combination", "|").alias("combination"))


def annotation_charge(spark, d):
    p = _peptides(spark, d).filter("plain <> ''")
    return p.select("psm_id", peptide.charge(F.col("plain"), F.col("price")).alias("charge"))


def mod_positions(spark, d):
    a = _annotated(spark, d).withColumn("annotation", F.concat("annotation", F.lit("(K,1.5)A")))
    return a.select("psm_id", F.array_join(F.transform(peptide.mod_positions(F.col("annotation")), lambda i: i.cast("string")), ",").alias("positions"))


def score_histogram(spark, d):
    return text.histogram(view(spark, d, "psms"), "score", 25.0)


def log_scores(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.round(F.coalesce(text.log_score(F.col("c_acctbal"), F.lit(100.0)), F.lit(0.0)), R).alias("score"))


def mass_error_histogram(spark, d):
    s = _consensus(spark, d).withColumn("spec_no", F.col("spec_idx")).withColumn("peaks", A.map_peaks(F.col("peaks"), mz=lambda p: p["mz"] * (1 + (F.col("spec_no") % 7 - 3 + 0.5) * 2e-6)))
    e = sequencing.mass_errors(sequencing.annotated_peaks(s, 0.05), 2.0)
    return e.groupBy().agg(F.sum("n").alias("n"), F.round(F.sum("share"), 6).alias("share"))


def protein_alignment(spark, d):
    p = _peptides(spark, d).select(F.col("psm_id").cast("int").alias("db_index"), F.col("plain").alias("sequence"))
    near = proteins.homologues(p, 8, 3)
    side = lambda n: p.select(F.col("db_index").alias(f"db_index{n}"), F.col("sequence").alias(f"sequence{n}"))
    return proteins.aligned(near.join(side(1), "db_index1").join(side(2), "db_index2")).select("db_index1", "db_index2", "score")


def protein_homologues(spark, d):
    p = _peptides(spark, d).select(F.col("psm_id").cast("int").alias("db_index"), F.col("plain").alias("sequence"))
    return proteins.homologues(p, 8, 3)


def spectrum_projection(spark, d):
    s = _prefix_spectra(spark, d)
    return sequencing.projected(pairs.mass_pairs(s, 20.0), s, 0.02, 4).select("spec1", "spec2", F.round("score", 4).alias("score"), "matched")


def pair_orientation(spark, d):
    e = _edges(spark, d).select("spec1", "spec2", F.col("score1").alias("direct"), F.col("score2").alias("flipped"))
    return sequencing.oriented(e)


def run_alignment(spark, d):
    """Spectra of the kinds F and O of each file, as two runs."""
    v = pairs.binned(view(spark, d, "peaks"), 200.0)
    s = view(spark, d, "spectra").filter("frag_type IN ('F', 'O')").select("spec_idx", F.col("file_idx").alias("pair"), F.when(F.col("frag_type") == "F", 1).otherwise(2).alias("run"))
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("pair", "run").orderBy("spec_idx")) - 1)
    return sequencing.aligned_runs(v.join(s, "spec_idx").select("pair", "run", "place", "bin", "value")).select("pair", "place1", "place2", F.round("similarity", R).alias("similarity"))


def tag_search(spark, d):
    t = sequencing.tags(_prefix_spectra(spark, d), 3, 0.01, 2).select("spec_idx", "tag", "before", "after")
    p = _peptides(spark, d).select(F.col("psm_id").cast("int").alias("db_index"), F.col("plain").alias("sequence"))
    return proteins.tag_search(t, p, 0.01, 2)


_ENVELOPES = "SELECT p_partkey AS spec_idx, p_retailprice + 400.0 AS parent_mass, p_size + 1.0 AS a, p_size * 0.7 + 2 AS b, p_size * 0.3 + 1 AS c, p_size * 0.1 AS d FROM part"


def envelope_scores(spark, d):
    e = spark.sql(_ENVELOPES.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
    s = e.select("spec_idx", F.col("parent_mass").cast("double").alias("parent_mass"), F.array(*[F.col(c).cast("double") for c in "abcd"]).alias("isotopes"))
    return sequencing.envelope_scores(s).select("spec_idx", F.round("envelope_score", R).alias("envelope_score"))


#: low, high, vectors, coefficients, gamma and rho of a small model.
_SVM = {"low": [0.0, 0.0], "high": [9000.0, 24.0], "vectors": [[0.5, -0.5], [-0.25, 0.75], [0.0, 0.1]], "coefficients": [1.5, -0.75, 0.5], "gamma": 0.8, "rho": 0.1}


def svm_scores(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return sequencing.svm_scores(c, ["c_acctbal", "c_nationkey"], _SVM).select("c_custkey", F.round("svm_score", R).alias("svm_score"))


#: Offset from the prefix mass, probability of a peak there, background.
_IONS = [(1.0, 0.6, 0.1), (41.0, 0.3, 0.05), (-39.0, 0.2, 0.1)]


def prefix_scores(spark, d):
    from peakweave.operators import precursors

    s = P.gathered(view(spark, d, "peaks").select("spec_idx", "mz", "intensity"))
    return P.exploded(precursors.prefix_scores(s, _IONS, 0.5)).select("spec_idx", F.round("mz", 4).alias("mz"), F.round("intensity", R).alias("score"))


def merged_stages(spark, d):
    """Spectra of the kind P as a third stage of the spectrum that their file's number names."""
    from peakweave.operators import precursors

    s = _spectra(spark, d).join(view(spark, d, "spectra").select("spec_idx", F.col("file_idx").alias("parent_spec")), "spec_idx")
    m = precursors.merged_stages(s.withColumn("ms_level", F.when(F.col("frag_type") == "P", 3).otherwise(2)), 10.0)
    return m.select("spec_idx", F.inline("peaks")).select("spec_idx", "mz", F.round("intensity", 2).alias("intensity"))


def modified_partners(spark, d):
    from peakweave.operators import precursors

    p = _peptides(spark, d).filter("plain <> ''").select("psm_id", F.substring("plain", 1, 4).alias("plain"), (F.col("size") % 3).alias("charge"), F.col("price").alias("score"))
    return precursors.partners(p.filter("psm_id % 2 = 0"), p.filter("psm_id % 2 = 1")).select("psm_id", "partner")


def psm_variants(spark, d):
    """Places of short peptides in the sequences of parts, and the regions that they form."""
    p = _peptides(spark, d)
    short = p.filter("length(plain) >= 12").select("psm_id", F.substring("plain", 3, 8).alias("annotation"))
    db = p.select(F.col("psm_id").cast("int").alias("db_index"), F.col("plain").alias("sequence"))
    return psms.variants(short, db, 0.5).select("psm_id", "db_index", "start_aa", "end_aa", "region")


def library_substituted(spark, d):
    out = library.substituted(_consensus(spark, d), "S", "T", 0.001)
    return out.select("spec_idx", "annotation", F.size("peaks").alias("n_peaks"))


def spectra_clusters(spark, d):
    return clusters.cosine_clusters(_spectra(spark, d), 0.2, 20.0, 0.3, 1)


def overlap_pairs(spark, d):
    return pairs.overlap_pairs(_prefix_spectra(spark, d), 0.02, 400.0, 8, 400.0).select("spec1", "spec2", F.round("shift1", 3).alias("shift1"), "matched")


def probability_pairs(spark, d):
    s = _prefix_spectra(spark, d).withColumn("peaks", A.map_peaks(F.col("peaks"), intensity=lambda p: p["intensity"] % 3)).withColumn("score", F.lit(6.0))
    out = sequencing.probability_pairs(s, 0.5, 0.9)
    return out.select("spec1", "spec2", F.round("joint", 9).alias("joint"), F.round("p1", 9).alias("p1"), F.round("p2", 9).alias("p2"))


def deconvoluted_spectra(spark, d):
    out = sequencing.deconvoluted(_spectra(spark, d), 0.02)
    return out.select("spec_idx", F.size("peaks").alias("n_peaks"))


def cyclic_sequences(spark, d):
    return sequencing.cyclic(_prefix_spectra(spark, d), 0.01).select("spec_idx", "sequence")


def survey_precursors(spark, d):
    """Precursors of spectra after the latest survey spectrum of their file."""
    s = _spectra(spark, d).join(view(spark, d, "spectra").select("spec_idx", "file_idx"), "spec_idx").withColumn("ms_level", F.when(F.col("frag_type") == "P", 1).otherwise(2)).withColumn("parent_mz", F.col("parent_mass"))
    from peakweave.operators import precursors

    out = precursors.guess(precursors.with_survey(s, ["spec_idx"], ["file_idx"]), 30.0)
    return out.select("spec_idx", "charge", F.round("precursor_kl", R).alias("precursor_kl"))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_TRAIN = f"""pep AS ({_DUCK_PEPTIDES}), u AS (SELECT plain, min(psm_id) AS entry FROM pep WHERE length(plain) > 1 GROUP BY 1), l AS (SELECT entry, plain, length(plain) AS n, unnest(range(1, length(plain) + 1)) AS i FROM u),
    m AS (SELECT entry, i, n, sum({_MASS}[substr(plain, i, 1)]) OVER (PARTITION BY entry ORDER BY i) AS b, sum({_MASS}[substr(plain, i, 1)]) OVER (PARTITION BY entry) AS w FROM l),
    ions AS (SELECT entry, 'b' AS ion, i AS number, b + 1.00727646688 AS mz FROM m WHERE i < n UNION ALL SELECT entry, 'y', n - i, w - b + 18.010564686 + 1.00727646688 FROM m WHERE i < n),
    pk AS (SELECT entry, -1 AS copy, mz, number + 0.123 AS intensity FROM ions UNION ALL SELECT entry, copy, mz, (number + 0.123) * (1.31 + (entry + number + copy) % 5) FROM ions, (SELECT unnest([0, 1, 2]) AS copy) WHERE (entry + number + copy) % 6 <> 0),
    an AS (SELECT i.entry, copy, ion, number, sqrt(max(p.intensity)) AS value FROM ions i JOIN pk p ON p.entry = i.entry AND abs(p.mz - i.mz) <= 0.001 GROUP BY 1, 2, 3, 4),
    nv AS (SELECT entry, copy, ion, number, value / sqrt(sum(value * value) OVER (PARTITION BY entry, copy)) AS value FROM an),
    c AS (SELECT entry, ion, number, value, floor(least(value / max(value) OVER (PARTITION BY entry), 0.999999) * 10)::INT AS band FROM nv WHERE copy = -1),
    r AS (SELECT * FROM nv WHERE copy >= 0), k AS (SELECT DISTINCT entry, copy FROM r),
    j AS (SELECT c.band, c.value AS e, r.value AS r FROM c JOIN k USING (entry) LEFT JOIN r ON r.entry = c.entry AND r.copy = k.copy AND r.ion = c.ion AND r.number = c.number)"""
_PT = f"pt AS ({_DUCK_PEPTIDES})"
ORACLES = {
    "distribution_ratios": f"WITH {_TRAIN} SELECT band, greatest(0, least(199, floor((log2(r / e) + 4) / 0.04)))::INT AS bucket, count(*) AS n FROM j WHERE r IS NOT NULL GROUP BY 1, 2",
    "distribution_losses": f"WITH {_TRAIN} SELECT band, count(*) FILTER (r IS NULL) AS lost, count(r) AS kept FROM j GROUP BY 1",
    "library_tag_prefilter": f"WITH {_tags_sql(4, 3)} SELECT a.spec_idx AS query, b.spec_idx AS entry, count(*) AS shared FROM tags a JOIN tags b ON a.tag = b.tag AND a.spec_idx <> b.spec_idx AND abs(a.before - b.before) <= 0.02 GROUP BY 1, 2 HAVING count(*) >= 2",
    "library_truncate": with_views("""WITH r AS (SELECT spec_idx, intensity, row_number() OVER (PARTITION BY spec_idx ORDER BY intensity DESC) AS k, count(*) OVER (PARTITION BY spec_idx) AS n FROM peaks WHERE spec_idx IN (SELECT spec_idx FROM spectra))
        SELECT spec_idx, n > 3 AS cut, least(n, 3)::INT AS n_peaks, round(sum(intensity), 2) AS total FROM r WHERE k <= 3 GROUP BY spec_idx, n""", "spectra", "peaks"),
    "library_remove": with_views("SELECT spec_idx, charge FROM spectra WHERE spec_idx NOT IN (SELECT event_id FROM events WHERE event_type = 'error')", "spectra"),
    "library_peak_statistics": with_views(f"WITH t AS (SELECT spec_idx, count(*) AS n, sum(intensity) AS i FROM peaks GROUP BY 1) SELECT frag_type AS annotation, count(*) AS n, round(avg(t.n), {R}) AS peaks, round(avg(i), 4) AS intensity FROM spectra JOIN t USING (spec_idx) GROUP BY 1", "spectra", "peaks"),
    "library_create": with_views("SELECT spec_idx, frag_type AS annotation FROM spectra WHERE charge / 10 <= 0.3 AND frag_type NOT LIKE '%O%'", "spectra"),
    "module_convert": with_views("""WITH p AS (SELECT spec_idx, frag_type, parent_mass, mz + 1.5 AS mz, intensity, row_number() OVER (PARTITION BY spec_idx ORDER BY intensity DESC, mz DESC) AS k FROM peaks JOIN spectra USING (spec_idx) WHERE frag_type IN ('F', 'O'))
        SELECT spec_idx, frag_type, 'converted' AS file_name, mz, intensity FROM p WHERE k <= 4 AND intensity >= 5000 AND (mz <= parent_mass - 17 OR mz >= parent_mass + 15)""", "spectra", "peaks"),
    "module_filter_edges": "",
    "module_modification_frequencies": "",
    "module_penalties": """WITH f AS (SELECT p_size::DOUBLE AS mass, count(*) / 2000 AS x FROM part GROUP BY 1), k AS (SELECT mass, -log10(x) AS p FROM f WHERE x >= 0.01) SELECT mass, CASE WHEN (SELECT max(p) FROM k) > 0 THEN round(p / (SELECT max(p) FROM k) * 3, 9) ELSE 0.0 END::DOUBLE AS penalty FROM k""",
    "module_supported_mods": f"WITH {_ANN} SELECT substr(plain, 1, 1) AS residues, round(size * 1.5)::INT AS mass, count(*) AS n, count(DISTINCT plain) AS peptides FROM ann WHERE NOT is_decoy GROUP BY 1, 2 HAVING count(DISTINCT plain) >= 3",
    "module_peptide_database": f"WITH {_ANN}, s AS (SELECT DISTINCT plain AS sequence FROM ann) SELECT (row_number() OVER (ORDER BY sequence) - 1)::INT AS db_index, concat('PEP', (row_number() OVER (ORDER BY sequence))::VARCHAR) AS id, sequence FROM s",
    "module_subtract": with_views("SELECT psm_id, scan FROM psms WHERE scan IN (SELECT scan FROM psms WHERE is_decoy)", "psms"),
    "cluster_ranks": "SELECT o_custkey AS cluster_idx, o_orderkey AS scan, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders",
    "psm_in_networks": with_views("SELECT psm_id, scan FROM psms WHERE psm_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')", "psms"),
    "psm_append": with_views("SELECT psm_id, scan, score, CASE WHEN score > 300 THEN 0 ELSE 1 END::INT AS set_no FROM psms UNION ALL SELECT psm_id, scan, score, 2 FROM psms", "psms"),
    "psm_sorted": with_views("SELECT psm_id, row_number() OVER (ORDER BY file_idx, scan, psm_id) AS place FROM psms", "psms"),
    "pairs_sorted": f"WITH {_E} SELECT spec1, spec2, row_number() OVER (ORDER BY least(score1, score2) DESC, greatest(score1, score2) DESC, spec1, spec2) AS place FROM edges",
    "pair_dissimilar_tops": with_views(f"""WITH {_B}, t AS (SELECT spec_idx, mz FROM (SELECT *, row_number() OVER (PARTITION BY spec_idx ORDER BY intensity DESC, mz DESC) AS k FROM peaks) WHERE k <= 3),
        x AS (SELECT spec1, spec2, a.mz, EXISTS (SELECT 1 FROM t b WHERE b.spec_idx = spec2 AND abs(a.mz - b.mz) <= 50) AS met FROM pr JOIN t a ON a.spec_idx = spec1 WHERE spec2 IN (SELECT spec_idx FROM peaks))
        SELECT spec1, spec2 FROM x GROUP BY 1, 2 HAVING count(*) FILTER (NOT met) <= 1""", "spectra", "peaks"),
    "spectral_stars": with_views(f"""WITH {_B}, e AS (SELECT spec1 AS a, spec2 AS b, shift AS s FROM pr UNION ALL SELECT spec2, spec1, -shift FROM pr), n AS (SELECT spec_idx, mz, intensity, row_number() OVER () AS id FROM peaks),
        k AS (SELECT DISTINCT a, b, p.id, p.mz, p.intensity FROM e JOIN n p ON p.spec_idx = a JOIN peaks q ON q.spec_idx = b WHERE abs(p.mz - q.mz) <= 20 OR abs(p.mz - s - q.mz) <= 20)
        SELECT a AS spec_idx, mz, round(sum(intensity), 2) AS intensity FROM k GROUP BY 1, 2""", "spectra", "peaks"),
    "peak_positions": with_views("""WITH r AS (SELECT spec_idx, mz, row_number() OVER (PARTITION BY spec_idx ORDER BY mz, intensity) - 1 AS k FROM peaks), m AS (SELECT unnest([400.0, 1000.0])::DOUBLE AS mass),
        s AS (SELECT DISTINCT spec_idx, mass FROM r, m), f AS (SELECT spec_idx, mass, arg_min(k, (abs(mz - mass), k)) AS k FROM r, m WHERE abs(mz - mass) <= 60 GROUP BY 1, 2) SELECT spec_idx, mass, coalesce(k, -1)::INT AS position FROM s LEFT JOIN f USING (spec_idx, mass)""", "peaks"),
    "combinations_of": "SELECT a.n_regionkey, concat(a.n_name, '|', b.n_name, '|', c.n_name) AS combination FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name JOIN nation c ON b.n_regionkey = c.n_regionkey AND b.n_name < c.n_name",
    "annotation_charge": f"WITH {_PT} SELECT psm_id, greatest(round((list_sum(list_transform(string_split(plain, ''), lambda c: {_MASS}[c])) + 18.010564686 + 1.00727646688) / price), 1)::INT AS charge FROM pt WHERE plain <> ''",
    "mod_positions": f"WITH {_ANN} SELECT psm_id, concat('1,', (length(plain) + 1)::VARCHAR) AS positions FROM ann",
    "score_histogram": with_views("SELECT floor(score / 25.0)::BIGINT AS bin, count(*) AS count FROM psms GROUP BY 1", "psms"),
    "tag_search": f"""WITH {_tags_sql(3, 2)}, pr AS (SELECT psm_id::INT AS db_index, plain AS sequence, unnest(range(1, length(plain) + 1)) AS k FROM pep),
        c AS (SELECT db_index, k, sum({_MASS}[substr(sequence, k, 1)]) OVER (PARTITION BY db_index ORDER BY k) AS q FROM pr UNION ALL SELECT psm_id::INT, 0, 0.0 FROM pep),
        f AS (SELECT DISTINCT t.spec_idx, t.tag, t.before, t.after, pr.db_index, pr.k AS pos, length(sequence) AS n FROM tags t JOIN pr ON substr(sequence, k, 3) = tag),
        g AS (SELECT f.*, EXISTS (SELECT 1 FROM c JOIN c s ON c.db_index = s.db_index WHERE c.db_index = f.db_index AND c.k BETWEEN greatest(0, f.pos - 41) AND f.pos - 1 AND s.k = f.pos - 1 AND abs(s.q - c.q - f.before) <= 0.01)::INT +
            EXISTS (SELECT 1 FROM c JOIN c s ON c.db_index = s.db_index WHERE c.db_index = f.db_index AND c.k BETWEEN f.pos + 2 AND least(f.n, f.pos + 42) AND s.k = f.pos + 2 AND abs(c.q - s.q - f.after) <= 0.01)::INT AS matched FROM f)
        SELECT spec_idx, tag, db_index, pos::INT AS pos, matched FROM g WHERE matched >= 2""",
    "envelope_scores": f"""WITH e AS ({_ENVELOPES}), m AS (SELECT spec_idx, parent_mass / 1800.0 AS u, a, b, c, d, a + b + c + d AS t FROM e), q AS (SELECT *, 1 + u + u * u / 2 + u * u * u / 6 AS z FROM m),
        p AS (SELECT spec_idx, unnest([a / t, b / t, c / t, d / t]) AS o, unnest([1 / z, u / z, u * u / 2 / z, u * u * u / 6 / z]) AS x FROM q)
        SELECT spec_idx, round(sum(CASE WHEN o > 0 THEN o * ln(o / x) ELSE 0 END), {R}) AS envelope_score FROM p GROUP BY 1""",
    "svm_scores": f"""WITH s AS (SELECT c_custkey, greatest(-1, least(1, 2 * (c_acctbal - {_SVM["low"][0]}) / {_SVM["high"][0] - _SVM["low"][0]} - 1)) AS x, greatest(-1, least(1, 2 * (c_nationkey - {_SVM["low"][1]}) / {_SVM["high"][1] - _SVM["low"][1]} - 1)) AS y FROM customer)
        SELECT c_custkey, round({" + ".join(f"{k} * exp(-{_SVM['gamma']} * (pow(x - ({v[0]}), 2) + pow(y - ({v[1]}), 2)))" for k, v in zip(_SVM["coefficients"], _SVM["vectors"], strict=True))} - {_SVM["rho"]}, {R})::DOUBLE AS svm_score FROM s""",
    "prefix_scores": with_views("WITH n AS (SELECT spec_idx, mz, row_number() OVER () AS id FROM peaks), " + ", ".join(f"h{k} AS (SELECT DISTINCT a.id FROM n a JOIN n b ON a.spec_idx = b.spec_idx AND abs(b.mz - (a.mz - 1.0) - ({o})) <= 0.5)" for k, (o, _, _) in enumerate(_IONS)) + " SELECT spec_idx, round(mz - 1.0, 4) AS mz, round(" + " + ".join(f"CASE WHEN id IN (SELECT id FROM h{k}) THEN ln({p} / {b}) ELSE ln({1 - p} / {1 - b}) END" for k, (_, p, b) in enumerate(_IONS)) + f", {R})::DOUBLE AS score FROM n", "peaks"),
    "merged_stages": with_views("""WITH own AS (SELECT s.spec_idx, mz, intensity FROM spectra s JOIN peaks USING (spec_idx) WHERE frag_type <> 'P'), n AS (SELECT p.spec_idx, file_idx AS parent, parent_mass, mz, intensity, row_number() OVER () AS id FROM peaks p JOIN spectra USING (spec_idx) WHERE frag_type = 'P'),
        k AS (SELECT DISTINCT parent AS spec_idx, n.id, n.mz, n.intensity FROM n JOIN own q ON q.spec_idx = n.parent WHERE abs(n.mz - q.mz) <= 10 OR abs(parent_mass - 1.00727646688 - n.mz - q.mz) <= 10)
        SELECT spec_idx, mz, round(sum(intensity), 2) AS intensity FROM (SELECT spec_idx, mz, intensity FROM own UNION ALL SELECT spec_idx, mz, intensity FROM k) GROUP BY 1, 2""", "spectra", "peaks"),
    "modified_partners": f"WITH {_PT}, x AS (SELECT psm_id, substr(plain, 1, 4) AS plain, size % 3 AS charge, price AS score FROM pt WHERE plain <> ''), b AS (SELECT plain, charge, psm_id AS partner FROM x WHERE psm_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY plain, charge ORDER BY score DESC, psm_id) = 1) SELECT psm_id, partner FROM x JOIN b USING (plain, charge) WHERE psm_id % 2 = 0",
    "psm_variants": f"""WITH {_PT}, a AS (SELECT psm_id, translate(substr(plain, 3, 8), 'IQ', 'LK') AS pep FROM pt WHERE length(plain) >= 12), s AS (SELECT psm_id::INT AS db_index, translate(plain, 'IQ', 'LK') AS sequence, unnest(range(1, length(plain) - 6)) AS k FROM pt WHERE length(plain) >= 8),
        f AS (SELECT a.psm_id, db_index, k::INT AS start_aa, (k + 7)::INT AS end_aa FROM a JOIN s ON substr(sequence, k, 8) = pep),
        w AS (SELECT *, max(end_aa) OVER (PARTITION BY db_index ORDER BY start_aa, end_aa, psm_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f)
        SELECT psm_id, db_index, start_aa, end_aa, (sum(CASE WHEN before IS NULL OR before - start_aa + 1 < 4 THEN 1 ELSE 0 END) OVER (PARTITION BY db_index ORDER BY start_aa, end_aa, psm_id))::INT AS region FROM w""",
    "log_scores": f"SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal / 100.0), {R}) ELSE 0.0 END::DOUBLE AS score FROM customer",
    "mass_error_histogram": f"WITH {_PT}, u AS (SELECT DISTINCT plain FROM pt WHERE length(plain) > 1) SELECT sum(2 * (length(plain) - 1))::BIGINT AS n, 1.0::DOUBLE AS share FROM u",
    "protein_homologues": f"""WITH {_PT}, w AS (SELECT DISTINCT psm_id::INT AS p, substr(plain, i, 8) AS h FROM (SELECT psm_id, plain, unnest(range(1, length(plain) - 6)) AS i FROM pt WHERE length(plain) >= 8))
        SELECT a.p AS db_index1, b.p AS db_index2, count(*) AS shared FROM w a JOIN w b ON a.h = b.h AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 3""",
}


def _fill() -> None:
    """SQL that other queries have already."""
    from peakweave.plans.network_queries import ORACLES as own

    ORACLES["module_filter_edges"] = own["pair_p_value"].replace("p1 <= 0.3 AND p2 <= 0.3", "p1 <= 0.2 AND p2 <= 0.2").replace(f", round(p1, {R})::DOUBLE AS p_value1, round(p2, {R})::DOUBLE AS p_value2", "")
    ORACLES["module_modification_frequencies"] = own["mod_frequencies"]


_fill()
