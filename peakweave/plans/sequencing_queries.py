"""Queries that sequence, localise and assemble: over spectra of prefix masses of the peptide-like strings of ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakweave.functions import arrays as A
from peakweave.functions import peptide
from peakweave.operators import library, pairs, precursors, proteins, sequencing
from peakweave.operators.kernels import RESIDUES
from peakweave.plans.network_queries import _LIB, WIDTH
from peakweave.plans.network_queries import _spectra as _mass_spectra
from peakweave.plans.psm_queries import _DUCK_PEPTIDES, _MASS, _peptides
from peakweave.session import written
from peakweave.sources.tables import view, with_views

R = 6


def _spectra(spark, d):
    """One spectrum per distinct peptide: prefix masses, the intensity their place from 1."""
    p = _peptides(spark, d).filter("plain <> ''").groupBy("plain").agg(F.min("psm_id").alias("spec_idx"))
    masses = peptide.prefix_masses(F.col("plain"), plain=True)
    peaks = F.concat(F.array(A.peak(F.lit(0.0), F.lit(1.0), F.lit(0.0))), F.transform(masses, lambda m, i: A.peak(m, i + 1.0, F.lit(0.0))))
    return p.select("spec_idx", F.col("plain").alias("annotation"), (F.element_at(masses, -1) + 19.01784115).alias("parent_mass"), peaks.alias("peaks"), F.lit(2).alias("charge"))


def sequence_tags(spark, d):
    return sequencing.tags(_spectra(spark, d), 3, 0.01, 5).select("spec_idx", "rank", "tag", F.round("before", 4).alias("before"), (F.round("after", 4) + 0.0).alias("after"), "score")


def first_correct_tag(spark, d):
    s = _spectra(spark, d)
    return sequencing.first_correct_tag(sequencing.tags(s, 3, 0.01, 5), s).withColumn("rank", F.coalesce("rank", F.lit(-1)))


def de_novo(spark, d):
    return sequencing.de_novo(_spectra(spark, d), 0.01).select("spec_idx", F.round("score", 4).alias("score"), "sequence")


def spectral_probability(spark, d):
    s = _spectra(spark, d).withColumn("score", F.lit(12.0))
    return sequencing.spectral_probability(s).select("spec_idx", F.round("p_value", 12).alias("p_value"))


def tag_pairs(spark, d):
    return sequencing.shared_tag_pairs(sequencing.tags(_spectra(spark, d), 4, 0.01, 3), 0.02)


def spectral_alignment(spark, d):
    both = pairs.mass_pairs(_spectra(spark, d), 1.0, ["peaks"])
    return sequencing.spectral_alignments(both, 0.02).select("spec1", "spec2", F.round("score", 4).alias("score"), F.size("matched").alias("n_matched"))


def assembled_contigs(spark, d):
    s = _spectra(spark, d)
    a = sequencing.spectral_alignments(pairs.mass_pairs(s, 0.5, ["peaks"]), 0.02).filter("size(matched) >= 6")
    return precursors.contig_statistics(sequencing.assembled(s, a, 0.02))


def annotated_peaks(spark, d):
    s = _spectra(spark, d).withColumn("peaks", F.transform(peptide.ions(F.col("annotation")), lambda i: A.peak(i["mz"] + 0.001, i["number"].cast("double"), F.lit(0.0))))
    a = sequencing.annotated_peaks(s.withColumn("peaks", A.by_mz(F.col("peaks"))), 0.005)
    return a.select("spec_idx", "ion", "number", F.round("mz", 4).alias("mz"), F.round("error", 4).alias("error"))


def explained_intensity(spark, d):
    s = _spectra(spark, d).withColumn("peaks", F.transform("peaks", lambda p: A.peak(p["mz"] + 1.00727646688, p["intensity"], p["tol"])))
    return sequencing.explained_intensity(s, 0.001).select("spec_idx", F.round("explained", 4).alias("explained"))


def match_features(spark, d):
    s = _spectra(spark, d).withColumn("peaks", F.transform(peptide.ions(F.col("annotation")), lambda i: A.peak(i["mz"], i["number"].cast("double"), F.lit(0.0))))
    f = sequencing.match_features(s.withColumn("peaks", F.filter("peaks", lambda p, i: i % 2 == 0)), 1e-6)
    return f.select("spec_idx", "n_peaks", F.round("explained_peaks", 4).alias("explained_peaks"), F.round("b_found", 4).alias("b_found"), F.round("y_found", 4).alias("y_found"), "longest", (F.round("mass_error_ppm", 2) + 0.0).alias("mass_error_ppm"))


def site_localisation(spark, d):
    s = _spectra(spark, d).select(F.col("spec_idx").alias("psm_id"), F.col("annotation").alias("plain"), F.lit(79.9663).alias("mod_mass"), F.transform("peaks", lambda p: A.peak(p["mz"] + 1.00727646688, p["intensity"], p["tol"])).alias("peaks"))
    return sequencing.localisation(s, 0.01).select("psm_id", "position", F.round("share", R).alias("share"))


def library_decoys(spark, d):
    return library.decoys(_spectra(spark, d), 0.01).select("spec_idx", "annotation", "is_decoy")


def library_dot_bias(spark, d):
    s = _mass_spectra(spark, d).withColumnRenamed("parent_mass", "parent_mz").withColumn("is_query", F.col("spec_idx") % 10 == 0)
    c = written(pairs.classes(s, ["peaks", "is_query"], "parent_mz").withColumn("node", F.get("members", F.lit(0))), "classes")
    v = pairs.binned(c.select(F.col("node").alias("spec_idx"), F.inline("peaks")), 50.0)
    m = library.biased_classes(c.filter("is_query"), c.filter("NOT is_query"), 2 * WIDTH, v, R)
    first = m.select(F.explode("members1").alias("query"), "members2", "bias")
    return first.select("query", F.explode("members2").alias("entry"), "bias")


def boosted_spectra(spark, d):
    p = view(spark, d, "peaks").select("spec_idx", "mz", "intensity", F.lit(0.0).alias("tol"))
    s = p.join(view(spark, d, "spectra").select("spec_idx", "frag_type", F.col("file_idx").alias("precursor")), "spec_idx")
    b = precursors.boosted_peaks(s, ["precursor"], 25.0, p.count())
    return b.select("precursor", F.size("peaks").alias("n_peaks"), F.round(F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["intensity"]), 2).alias("total"))


def weighted_masses(spark, d):
    return precursors.weighted_mass(view(spark, d, "peaks"), "spec_idx").select("spec_idx", F.round("mz", R).alias("mz"))


def mod_placements(spark, d):
    p = _peptides(spark, d).filter("plain <> ''").select("psm_id", "plain", F.lit("ST").alias("sites"), (F.col("psm_id") % 3).cast("int").alias("n_mods"))
    return precursors.placements(p).select("psm_id", F.array_join(F.transform("positions", lambda i: i.cast("string")), ",").alias("positions"))


def mass_to_stretch(spark, d):
    own = _spectra(spark, d).select("spec_idx", "parent_mass")
    seq = _peptides(spark, d).select(F.col("psm_id").cast("int").alias("db_index"), F.col("plain").alias("sequence"))
    return proteins.mass_search(own, seq, 0.001, 60).select("spec_idx", "db_index", "start_aa", "end_aa")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}
_PEP = f"pep AS ({_DUCK_PEPTIDES}), u AS (SELECT plain, min(psm_id) AS spec_idx FROM pep WHERE plain <> '' GROUP BY 1)"
_PREFIX = f"""l AS (SELECT spec_idx, plain, unnest(range(1, length(plain) + 1)) AS k FROM u),
    pk AS (SELECT spec_idx, k, sum({_MASS}[substr(plain, k, 1)]) OVER (PARTITION BY spec_idx ORDER BY k) AS mz, (k::DOUBLE) AS intensity FROM l)"""


def _tags_sql(length: int, most: int, tolerance: float = 0.01) -> str:
    """Tables up to ``tags``: all paths of residue-sized steps, ranked."""
    residues = ", ".join(f"('{r}', {m:.12f}::DOUBLE)" for r, m in RESIDUES.items() if r != "L")
    joins = " ".join(f"JOIN st s{n} ON s{n}.spec_idx = s{n - 1}.spec_idx AND s{n}.a = s{n - 1}.b" for n in range(2, length + 1))
    score = " + ".join(["s1.ia", *[f"s{n}.ib" for n in range(1, length + 1)]])
    return f"""{_PEP}, {_PREFIX}, pz AS (SELECT * FROM pk UNION ALL SELECT spec_idx, 0, 0.0, 1.0 FROM u), res(r, m) AS (VALUES {residues}),
        st AS (SELECT a.spec_idx, a.k AS a, b.k AS b, a.mz AS ma, b.mz AS mb, a.intensity AS ia, b.intensity AS ib, r FROM pz a JOIN pz b ON a.spec_idx = b.spec_idx AND b.mz > a.mz AND b.mz - a.mz < 200 JOIN res ON abs(b.mz - a.mz - m) <= {tolerance} + 1e-6),
        paths AS (SELECT s1.spec_idx, concat({", ".join(f"s{n}.r" for n in range(1, length + 1))}) AS tag, s1.ma AS before, s{length}.mb AS last, {score} AS score, s1.a AS i, s{length}.b AS e FROM st s1 {joins}),
        tags AS (SELECT spec_idx, tag, before, w.mz - last AS after, score, row_number() OVER (PARTITION BY spec_idx ORDER BY score DESC, tag, i, e) AS rank
            FROM paths JOIN (SELECT spec_idx, max(mz) AS mz FROM pk GROUP BY 1) w USING (spec_idx) QUALIFY rank <= {most})"""


_IONS = f"""{_PEP}, {_PREFIX}, w AS (SELECT spec_idx, max(mz) AS whole, max(k) AS n FROM pk GROUP BY 1),
    io AS (SELECT spec_idx, 'b' AS ion, k AS number, k - 1 AS idx, mz + 1.00727646688 AS mz, n FROM pk JOIN w USING (spec_idx) WHERE k < n
        UNION ALL SELECT spec_idx, 'y', n - k, n - 1 + k - 1, whole - mz + 18.010564686 + 1.00727646688, n FROM pk JOIN w USING (spec_idx) WHERE k < n)"""
ORACLES = {
    "match_features": f"""WITH {_IONS}, p AS (SELECT spec_idx, mz FROM io WHERE idx % 2 = 0), h AS (SELECT * FROM io WHERE EXISTS (SELECT 1 FROM p WHERE p.spec_idx = io.spec_idx AND abs(p.mz - io.mz) <= 1e-6)),
        g AS (SELECT spec_idx, ion, number - row_number() OVER (PARTITION BY spec_idx, ion ORDER BY number) AS g FROM h), r AS (SELECT spec_idx, max(c) AS longest FROM (SELECT spec_idx, ion, g, count(*) AS c FROM g GROUP BY 1, 2, 3) GROUP BY 1),
        f AS (SELECT spec_idx, count(*) FILTER (ion = 'b') AS b, count(*) FILTER (ion = 'y') AS y FROM h GROUP BY 1), c AS (SELECT spec_idx, count(*) AS n_peaks FROM p GROUP BY 1)
        SELECT w.spec_idx, coalesce(n_peaks, 0)::INT AS n_peaks, CASE WHEN n_peaks > 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS explained_peaks, coalesce(round(100.0 * b / (n - 1), 4), 0.0)::DOUBLE AS b_found, coalesce(round(100.0 * y / (n - 1), 4), 0.0)::DOUBLE AS y_found,
            coalesce(longest, 0)::INT AS longest, 0.0::DOUBLE AS mass_error_ppm FROM w LEFT JOIN c USING (spec_idx) LEFT JOIN f USING (spec_idx) LEFT JOIN r USING (spec_idx)""",
    "site_localisation": f"""WITH {_IONS}, pz AS (SELECT spec_idx, mz + 1.00727646688 AS mz, k AS i FROM pk UNION ALL SELECT spec_idx, 1.00727646688, 1 FROM u), spots AS (SELECT spec_idx, k AS position FROM pk),
        v AS (SELECT io.spec_idx, position, mz + CASE WHEN (ion = 'b' AND number >= position) OR (ion = 'y' AND number > n - position) THEN 79.9663 ELSE 0 END AS mz FROM io JOIN spots USING (spec_idx)),
        x AS (SELECT a.spec_idx, a.position, coalesce(sum(i) FILTER (EXISTS (SELECT 1 FROM v WHERE v.spec_idx = a.spec_idx AND v.position = a.position AND abs(v.mz - p.mz) <= 0.01)), 0) AS w FROM spots a JOIN pz p ON a.spec_idx = p.spec_idx GROUP BY 1, 2),
        y AS (SELECT *, w - min(w) OVER (PARTITION BY spec_idx) AS d FROM x), z AS (SELECT *, sum(d) OVER (PARTITION BY spec_idx) AS t, count(*) OVER (PARTITION BY spec_idx) AS c FROM y)
        SELECT spec_idx AS psm_id, position::INT AS position, round(CASE WHEN t > 0 THEN d / t ELSE 1 / c END, {R})::DOUBLE AS share FROM z""",
    "sequence_tags": f"WITH {_tags_sql(3, 5)} SELECT spec_idx, rank::INT AS rank, tag, round(before, 4) AS before, round(after, 4) + 0.0 AS after, score FROM tags",
    "first_correct_tag": f"""WITH {_tags_sql(3, 5)}, f AS (SELECT spec_idx, min(rank)::INT AS rank FROM tags JOIN u USING (spec_idx) WHERE contains(replace(plain, 'L', 'I'), replace(tag, 'L', 'I')) GROUP BY 1)
        SELECT spec_idx, coalesce(rank, -1)::INT AS rank FROM u LEFT JOIN f USING (spec_idx)""",
    "tag_pairs": f"""WITH {_tags_sql(4, 3)}, f AS (SELECT DISTINCT spec_idx, tag, 0 AS side, before AS flank FROM tags UNION SELECT DISTINCT spec_idx, tag, 1, after FROM tags)
        SELECT DISTINCT a.spec_idx AS spec1, b.spec_idx AS spec2 FROM f a JOIN f b ON a.tag = b.tag AND a.side = b.side AND a.spec_idx < b.spec_idx AND abs(a.flank - b.flank) <= 0.02""",
    "explained_intensity": f"""WITH {_PEP}, {_PREFIX}, w AS (SELECT spec_idx, max(mz) AS whole FROM pk GROUP BY 1), b AS (SELECT spec_idx, mz FROM pk JOIN w USING (spec_idx) WHERE mz < whole - 1e-6),
        ions AS (SELECT spec_idx, mz + 1.00727646688 AS mz FROM b UNION ALL SELECT spec_idx, whole - mz + 18.010564686 + 1.00727646688 FROM b JOIN w USING (spec_idx)),
        own AS (SELECT spec_idx, mz + 1.00727646688 AS mz, k AS i FROM pk UNION ALL SELECT spec_idx, 1.00727646688, 1 FROM u),
        c AS (SELECT own.*, EXISTS (SELECT 1 FROM ions WHERE ions.spec_idx = own.spec_idx AND abs(ions.mz - own.mz) <= 0.001) AS hit FROM own JOIN w USING (spec_idx) WHERE own.mz >= 57.0214637230 AND own.mz <= whole - 37)
        SELECT u.spec_idx, coalesce(round(100 * sum(i) FILTER (hit) / sum(i), 4), 0.0)::DOUBLE AS explained FROM u LEFT JOIN c USING (spec_idx) GROUP BY 1""",
    "library_dot_bias": with_views(f"""WITH {_LIB}, f AS (SELECT spec_idx, bin, pow(value, 4) AS x FROM v), g AS (SELECT spec_idx, bin, x / sqrt(sum(x * x) OVER (PARTITION BY spec_idx)) AS x FROM f),
        p AS (SELECT query, entry, sum(a.x * b.x) AS c FROM m JOIN g a ON a.spec_idx = query JOIN g b ON b.spec_idx = entry AND a.bin = b.bin GROUP BY 1, 2), r AS (SELECT query, entry, sqrt(c) / dot AS b FROM m JOIN p USING (query, entry))
        SELECT query, entry, CASE WHEN b < 0.1 THEN 0.12 WHEN b <= 0.35 THEN 0.0 WHEN b <= 0.4 THEN 0.12 WHEN b <= 0.45 THEN 0.18 ELSE 0.24 END::DOUBLE AS bias FROM r""", "spectra", "peaks"),
    "de_novo": f"WITH {_PEP} SELECT spec_idx, ((length(plain) - 1) * length(plain) / 2)::DOUBLE AS score, replace(plain, 'L', 'I') AS sequence FROM u",
    "annotated_peaks": f"""WITH {_PEP}, l AS (SELECT spec_idx, length(plain) AS n, plain, unnest(range(1, length(plain) + 1)) AS i FROM u),
        m AS (SELECT spec_idx, i, n, sum({_MASS}[substr(plain, i, 1)]) OVER (PARTITION BY spec_idx ORDER BY i) AS b, sum({_MASS}[substr(plain, i, 1)]) OVER (PARTITION BY spec_idx) AS w FROM l),
        x AS (SELECT spec_idx, 'b' AS ion, i AS number, b + 1.00727646688 AS mz FROM m WHERE i < n UNION ALL SELECT spec_idx, 'y', n - i, w - b + 18.010564686 + 1.00727646688 FROM m WHERE i < n)
        SELECT a.spec_idx, a.ion, a.number::INT AS number, round(arg_min(p.mz + 0.001, (-p.number, p.mz)), 4) AS mz, round(arg_min(p.mz + 0.001, (-p.number, p.mz)) - any_value(a.mz), 4) AS error
        FROM x a JOIN x p ON a.spec_idx = p.spec_idx AND abs(p.mz + 0.001 - a.mz) <= 0.005 GROUP BY 1, 2, 3""",
    "mass_to_stretch": f"""WITH {_PEP}, l AS (SELECT psm_id, plain, unnest(range(1, length(plain) + 1)) AS i FROM pep),
        c AS (SELECT psm_id::INT AS db_index, i, sum({_MASS}[substr(plain, i, 1)]) OVER (PARTITION BY psm_id ORDER BY i) AS m FROM l), z AS (SELECT * FROM c UNION ALL SELECT DISTINCT db_index, 0, 0.0 FROM c),
        s AS (SELECT db_index, a.i + 1 AS start_aa, b.i AS end_aa, b.m - a.m AS mass FROM z a JOIN c b USING (db_index) WHERE b.i > a.i AND b.i <= a.i + 60),
        o AS (SELECT spec_idx, list_sum(list_transform(string_split(plain, ''), lambda x: {_MASS}[x])) AS mass FROM u)
        SELECT spec_idx, db_index, start_aa::INT AS start_aa, end_aa::INT AS end_aa FROM o JOIN s ON floor(s.mass) BETWEEN floor(o.mass) - 1 AND floor(o.mass) + 1 AND abs(o.mass - s.mass) <= 0.001""",
    "weighted_masses": with_views(f"SELECT spec_idx, round(sum(mz * intensity) / sum(intensity), {R}) AS mz FROM peaks GROUP BY 1", "peaks"),
    "boosted_spectra": with_views("""WITH g AS (SELECT p.spec_idx, mz, intensity, frag_type, s.file_idx AS precursor FROM peaks p JOIN spectra s USING (spec_idx)),
        b AS (SELECT precursor, floor(mz / 50.0 + 0.5) AS bin, sum(intensity) * count(DISTINCT frag_type) AS i FROM g GROUP BY 1, 2) SELECT precursor, count(*)::INT AS n_peaks, round(sum(i), 2) AS total FROM b GROUP BY 1""", "peaks", "spectra"),
    "mod_placements": f"""WITH pep AS ({_DUCK_PEPTIDES}), c AS (SELECT psm_id, (psm_id % 3)::INT AS k, list_filter(range(1, length(plain) + 1), lambda i: substr(plain, i, 1) IN ('S', 'T')) AS s FROM pep WHERE plain <> ''),
        p AS (SELECT psm_id, k, unnest(s) AS a, s FROM c)
        SELECT psm_id, '' AS positions FROM c WHERE k = 0 UNION ALL SELECT psm_id, a::VARCHAR FROM p WHERE k = 1 UNION ALL
        SELECT psm_id, concat(a::VARCHAR, ',', b::VARCHAR) FROM (SELECT psm_id, a, unnest(list_filter(s, lambda x: x > a)) AS b FROM p WHERE k = 2)""",
}
