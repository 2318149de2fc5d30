"""Queries over pairs of spectra, graphs and libraries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from peakweave.functions import text
from peakweave.operators import graph, library, pairs
from peakweave.operators import peaks as P
from peakweave.sources.tables import table, view, with_views

R = 6
#: Width of mass bands, so narrow that a spectrum has a few partners.
WIDTH = 0.2


def _spectra(spark, d):
    return P.gathered(view(spark, d, "peaks")).join(view(spark, d, "spectra").select("spec_idx", "parent_mass", "charge", "frag_type"), "spec_idx")


def _edges(spark, d):
    """Pairs of parts in an order's neighbouring lines, as edges between spectra: one giant component."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_quantity")
    a = l.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("s1"), F.col("l_discount").alias("d1"), F.col("l_quantity").alias("q1"))
    e = a.join(l, ["l_orderkey", "l_linenumber"]).filter("s1 <> l_partkey")
    e = e.select(F.least("s1", "l_partkey").alias("spec1"), F.greatest("s1", "l_partkey").alias("spec2"), text.round_scaled(F.col("l_extendedprice") / 1e5, 4).alias("score1"), text.round_scaled(F.col("d1") * 10, 4).alias("score2"), (F.col("q1") - 25).alias("shift1"), (F.col("l_quantity") - 20).alias("shift2"), "l_orderkey")
    return e.groupBy("spec1", "spec2").agg(*[F.max(c).alias(c) for c in ("score1", "score2", "shift1", "shift2", "l_orderkey")])


def _steps(spark, d):
    """From each event to the next of its user, and to the next of its user and type: a directed graph without cycles, a component for each user."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    follow = lambda *by: e.select(F.col("event_id").alias("spec1"), F.lead("event_id").over(Window.partitionBy(*by).orderBy("event_id")).alias("spec2"), text.round_scaled(F.col("value") / 500 + 0.001, 4).alias("score1"))
    return follow("user_id").union(follow("user_id", "event_type")).filter("spec2 IS NOT NULL").distinct().withColumn("score2", F.col("score1"))


def pair_band_join(spark, d):
    met = pairs.class_pairs(pairs.classes(view(spark, d, "spectra")), WIDTH)
    return pairs.expanded(met.select("members1", "members2", F.round("shift", R).alias("shift")))


def pair_cosine_binned(spark, d):
    v = pairs.binned(view(spark, d, "peaks"), 50.0)
    s = view(spark, d, "spectra").join(pairs.bin_lists(v), "spec_idx")
    found = pairs.with_bin_products(pairs.mass_pairs(s, WIDTH, ["bins"]), "cosine")
    return found.select("spec1", "spec2", F.round("cosine", R).alias("cosine"), "shared")


def pair_greedy_cosine(spark, d):
    e = pairs.class_network(_spectra(spark, d), WIDTH, 20.0, 0.2, 1, least_peaks=1)
    return pairs.expanded(e.select("members1", "members2", F.round("score1", R).alias("score1"), F.round("score2", R).alias("score2")))


def pair_best_shift(spark, d):
    """Within the module's own 100 Dalton, as modifications shift by more than a narrow band; a row with each copy of a spectrum, pairs between the others."""
    e = pairs.best_shift_links(_spectra(spark, d), 100.0, 20.0)
    return e.select("spec1", "spec2", F.round("shift1", 4).alias("shift1"), F.round("score1", R).alias("score1"), F.round("score2", R).alias("score2"), "matched", "copy")


def pair_dense_cosine(spark, d):
    v = table(spark, d, "embeddings")
    near = pairs.band_join(v.select(F.col("vec_id").alias("spec1"), F.col("embedding").alias("a"), F.col("vec_id").cast("double").alias("m1")), v.select(F.col("vec_id").alias("spec2"), F.col("embedding").alias("b"), F.col("vec_id").cast("double").alias("m2")), "m1", "m2", 20.0)
    both = near.filter("spec1 < spec2").withColumn("cosine", pairs.dense_cosine(F.col("a"), F.col("b")))
    return both.select("spec1", "spec2", F.round("cosine", 5).alias("cosine"))


def score_means_variance(spark, d):
    s = pairs.score_statistics(_edges(spark, d))
    return s.select("spec", "n", F.round("mean", 10).alias("mean"), F.round("sd", 10).alias("sd"))


def pair_p_value(spark, d):
    e = _edges(spark, d)
    out = pairs.significant(e, pairs.score_statistics(e), 0.3)
    return out.select("spec1", "spec2", F.round("p_value1", R).alias("p_value1"), F.round("p_value2", R).alias("p_value2"))


def pair_score_filter(spark, d):
    return pairs.at_least(_edges(spark, d), 0.3).select("spec1", "spec2", "score1", "score2")


def pair_intersection(spark, d):
    e = _edges(spark, d)
    other = e.filter("score1 > 0.4").select(F.col("spec2").alias("spec1"), F.col("spec1").alias("spec2"))
    return pairs.in_both(e, other).select("spec1", "spec2")


def mod_frequencies(spark, d):
    f = pairs.modification_frequencies(_edges(spark, d), 2.0, 20.0)
    return f.select("mass", F.round("frequency", 9).alias("frequency"))


def edge_fdr(spark, d):
    e = _edges(spark, d).withColumn("is_decoy", F.col("l_orderkey") % 3 == 0)
    return pairs.edge_fdr(e, 0.32).select("spec1", "spec2", "is_decoy")


def pair_precision_recall(spark, d):
    e = _edges(spark, d)
    out = pairs.precision_recall(e, e.filter("score2 > 0.2"))
    return out.select("bin", "detected", "correct", text.round_scaled(F.col("precision"), R).alias("precision"), text.round_scaled(F.col("recall"), R).alias("recall"))


def triangles(spark, d):
    return graph.in_triangles(_edges(spark, d), 1.0).select("spec1", "spec2", "shift1")


def components(spark, d):
    return graph.components(_steps(spark, d))


def component_sizes(spark, d):
    return graph.component_sizes(_steps(spark, d))


def component_min_size(spark, d):
    return graph.at_least_size(_steps(spark, d), 60).select("spec1", "spec2")


def component_size_filter(spark, d):
    return graph.limit_component_size(_steps(spark, d), 20).select("spec1", "spec2", "score1", "score2")


def limit_per_variant(spark, d):
    masses = table(spark, d, "part").select(F.col("p_partkey").alias("spec_idx"), (F.col("p_size") * 1.0).alias("parent_mass"))
    return graph.limit_per_variant(_edges(spark, d), masses, 2).select("spec1", "spec2")


def limit_unique_masses(spark, d):
    masses = table(spark, d, "part").select(F.col("p_partkey").alias("spec_idx"), (F.col("p_size") * 1.0).alias("parent_mass"))
    return graph.limit_unique_masses(_edges(spark, d), masses, 4).select("spec1", "spec2")


def propagation(spark, d):
    e = _steps(spark, d).withColumn("edge_fdr", F.lit(0.02))
    seeds = table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("node"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("annotation"), F.lit(0.01).alias("fdr"))
    return graph.propagate(e, seeds).select("node", "annotation", F.round("fdr", 9).alias("fdr"), "step")


def lightest_paths(spark, d):
    seeds = table(spark, d, "region").select((F.col("r_regionkey") + 1).cast("long").alias("node"))
    return graph.lightest_paths(_edges(spark, d).withColumn("w", F.lit(1.0)), seeds, "w").select("node", F.col("distance").cast("int").alias("distance"), "source")


def heaviest_path(spark, d):
    return graph.heaviest_path(_steps(spark, d)).select("component", F.round("weight", R).alias("weight"), F.array_join("path", " ").alias("path"))


def topological_order(spark, d):
    return graph.topological_order(_steps(spark, d)).select("component", "node", "layer")


def components_giant(spark, d):
    return graph.components(_edges(spark, d))


def _library(spark, d):
    s = view(spark, d, "spectra").withColumn("parent_mz", F.col("parent_mass"))
    v = pairs.binned(view(spark, d, "peaks"), 50.0)
    q, e = s.filter("spec_idx % 10 = 0"), s.filter("spec_idx % 10 <> 0").withColumn("is_decoy", F.col("frag_type") == "F")
    return library.scored_candidates(q, e, 2 * WIDTH, v, v)


def library_search_topk(spark, d):
    hits = library.top_hits(_library(spark, d).withColumn("dot", F.round("dot", R)), 3, 0.1)
    return hits.select("query", "entry", "rank", "dot", "shared")


def library_target_decoy(spark, d):
    w = library.target_decoy_winners(_library(spark, d).withColumn("dot", F.round("dot", R)))
    return w.select("query", "entry", "is_decoy", "dot", F.round("score", R).alias("score"))


def library_filter(spark, d):
    lib = table(spark, d, "part").select(F.col("p_partkey").alias("spec_idx"), F.col("p_brand").alias("annotation"), (F.col("p_size") / 50).alias("p_value"), (F.col("p_size") % 4).alias("charge"))
    return library.filtered(lib, p_value=0.5, without_residues="5", charges=[1, 2]).select("spec_idx", "annotation")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_E = """edges AS (SELECT least(a.l_partkey, b.l_partkey) AS spec1, greatest(a.l_partkey, b.l_partkey) AS spec2, max(round(b.l_extendedprice / 1e5, 4)) AS score1, max(round(a.l_discount * 10, 4)) AS score2,
    max(a.l_quantity - 25) AS shift1, max(b.l_quantity - 20) AS shift2, max(a.l_orderkey) AS l_orderkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber
    WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2)"""
_D = """sp AS (SELECT DISTINCT * FROM (SELECT event_id AS spec1, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS spec2, round(value / 500 + 0.001, 4) AS score1 FROM events
    UNION ALL SELECT event_id, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id), round(value / 500 + 0.001, 4) FROM events) WHERE spec2 IS NOT NULL)"""
_B = "pr AS (SELECT a.spec_idx AS spec1, b.spec_idx AS spec2, a.parent_mass - b.parent_mass AS shift FROM spectra a JOIN spectra b ON a.spec_idx < b.spec_idx AND b.parent_mass BETWEEN a.parent_mass - 1 AND a.parent_mass + 1 WHERE abs(a.parent_mass - b.parent_mass) <= 0.2)"
_V = """bv AS (SELECT spec_idx, floor(mz / 50.0)::INT AS bin, sum(sqrt(intensity)) AS value FROM peaks GROUP BY 1, 2),
    v AS (SELECT spec_idx, bin, value / sqrt(sum(value * value) OVER (PARTITION BY spec_idx)) AS value FROM bv)"""
_ST = f"{_E}, st AS (SELECT spec, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS sd FROM (SELECT spec1 AS spec, score1 AS score FROM edges UNION ALL SELECT spec2, score2 FROM edges) GROUP BY 1)"
_LIB = f"""{_V}, lib AS (SELECT q.spec_idx AS query, e.spec_idx AS entry, e.frag_type = 'F' AS is_decoy FROM spectra q JOIN spectra e ON e.parent_mass BETWEEN q.parent_mass - 1 AND q.parent_mass + 1
    WHERE q.spec_idx % 10 = 0 AND e.spec_idx % 10 <> 0 AND abs(q.parent_mass - e.parent_mass) <= 0.4),
    m AS (SELECT query, entry, is_decoy, round(sum(a.value * b.value), {R}) AS dot, count(*) AS shared FROM lib JOIN v a ON a.spec_idx = query JOIN v b ON b.spec_idx = entry AND a.bin = b.bin GROUP BY 1, 2, 3)"""


def _tail(n: int) -> str:
    z = f"((score{n} - m{n}) / s{n})"
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    p = f"(0.39894228 * exp(-{z} * {z} / 2) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"CASE WHEN abs(s{n}) < 1e-6 THEN 2.0 WHEN {z} >= 0 THEN {p} ELSE 1 - {p} END"


_CC = f"""{_D}, cc AS (SELECT event_id AS node, min(event_id) OVER (PARTITION BY user_id) AS component FROM events QUALIFY count(*) OVER (PARTITION BY user_id) > 1)"""
ORACLES = {
    "pair_band_join": with_views(f"WITH {_B} SELECT spec1, spec2, round(shift, {R}) AS shift FROM pr", "spectra"),
    "pair_cosine_binned": with_views(f"WITH {_B}, {_V} SELECT spec1, spec2, round(sum(a.value * b.value), {R}) AS cosine, count(*) AS shared FROM pr JOIN v a ON a.spec_idx = spec1 JOIN v b ON b.spec_idx = spec2 AND a.bin = b.bin GROUP BY 1, 2", "spectra", "peaks"),
    "pair_dense_cosine": "SELECT a.vec_id AS spec1, b.vec_id AS spec2, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND b.vec_id <= a.vec_id + 20",
    "score_means_variance": f"WITH {_ST} SELECT spec, n, round(mean, 10) AS mean, round(sd, 10) AS sd FROM st",
    "pair_p_value": f"""WITH {_ST}, j AS (SELECT spec1, spec2, score1, score2, a.mean AS m1, a.sd AS s1, b.mean AS m2, b.sd AS s2 FROM edges JOIN st a ON a.spec = spec1 JOIN st b ON b.spec = spec2)
        SELECT spec1, spec2, round(p1, {R})::DOUBLE AS p_value1, round(p2, {R})::DOUBLE AS p_value2 FROM (SELECT *, {_tail(1)} AS p1, {_tail(2)} AS p2 FROM j) WHERE p1 <= 0.3 AND p2 <= 0.3""",
    "pair_score_filter": f"WITH {_E} SELECT spec1, spec2, score1, score2 FROM edges WHERE least(score1, score2) >= 0.3",
    "pair_intersection": f"WITH {_E} SELECT spec1, spec2 FROM edges WHERE score1 > 0.4",
    "mod_frequencies": f"""WITH {_E}, s AS (SELECT abs(trunc(x / 2.0))::BIGINT AS k FROM (SELECT shift1 AS x FROM edges UNION ALL SELECT shift2 FROM edges)), c AS (SELECT k, count(*) AS n FROM s WHERE k <> 0 GROUP BY 1)
        SELECT (k * 2.0)::DOUBLE AS mass, CASE WHEN n <= 1 OR k * 2.0 > 20 THEN 0.0 ELSE round(n / (SELECT sum(n) FROM c), 9) END::DOUBLE AS frequency FROM c""",
    "edge_fdr": f"""WITH {_E}, s AS (SELECT *, least(score1, score2) AS m, l_orderkey % 3 = 0 AS is_decoy FROM edges), c AS (SELECT m, sum(is_decoy::INT) AS d, sum(1 - is_decoy::INT) AS t FROM s GROUP BY 1),
        u AS (SELECT m, d, sum(t) OVER (ORDER BY m DESC) AS t, sum(d) OVER (ORDER BY m DESC) - d AS dd FROM c), h AS (SELECT min(m) AS th FROM u WHERE d > 0 AND t > 0 AND dd / (t + dd) <= 0.32)
        SELECT spec1, spec2, is_decoy FROM s, h WHERE th IS NULL OR m >= th""",
    "pair_precision_recall": f"""WITH {_E}, b AS (SELECT floor(score1 / 0.1)::INT AS bin, count(*) AS n, count(*) FILTER (score2 > 0.2) AS g FROM edges GROUP BY 1),
        c AS (SELECT bin, (sum(n) OVER (ORDER BY bin DESC))::BIGINT AS detected, (sum(g) OVER (ORDER BY bin DESC))::BIGINT AS correct FROM b)
        SELECT bin, detected, correct, round(correct / detected, {R}) AS precision, round(correct / (SELECT count(*) FROM edges WHERE score2 > 0.2), {R}) AS recall FROM c""",
    "triangles": f"""WITH {_E}, t AS (SELECT x.spec1 AS a, x.spec2 AS b, y.spec2 AS c, abs(x.shift1) AS s1, abs(y.shift1) AS s2, abs(z.shift1) AS s3 FROM edges x JOIN edges y ON x.spec2 = y.spec1 JOIN edges z ON z.spec1 = x.spec1 AND z.spec2 = y.spec2),
        k AS (SELECT * FROM t WHERE abs(2 * greatest(s1, s2, s3) - s1 - s2 - s3) <= 1.0), u AS (SELECT a AS p, b AS q FROM k UNION SELECT b, c FROM k UNION SELECT a, c FROM k) SELECT spec1, spec2, shift1 FROM edges JOIN u ON spec1 = p AND spec2 = q""",
    # every edge weighs what its first event does, so the heaviest path goes through all events of a user
    "heaviest_path": f"WITH {_CC} SELECT component, round(sum(round(value / 500 + 0.001, 4)) FILTER (node <> last), {R}) AS weight, string_agg(node::VARCHAR, ' ' ORDER BY node) AS path FROM (SELECT *, max(node) OVER (PARTITION BY component) AS last FROM cc) JOIN events ON node = event_id GROUP BY 1",
    "components": f"WITH {_CC} SELECT node, component FROM cc",
    "components_giant": f"""WITH RECURSIVE {_E}, bi AS (SELECT spec1 AS u, spec2 AS v FROM edges UNION SELECT spec2, spec1 FROM edges), walk(node) AS (SELECT min(u) FROM bi UNION SELECT v FROM walk JOIN bi ON node = u)
        SELECT node, (SELECT min(u) FROM bi) AS component FROM walk""",
    "component_sizes": f"WITH {_CC} SELECT component, count(*) AS nodes, (SELECT count(*) FROM sp JOIN cc c2 ON spec1 = c2.node WHERE c2.component = cc.component) AS edges FROM cc GROUP BY 1",
    "component_min_size": f"WITH {_CC} SELECT spec1, spec2 FROM sp JOIN cc ON spec1 = node WHERE component IN (SELECT component FROM cc GROUP BY 1 HAVING count(*) >= 60)",
    "lightest_paths": f"""WITH RECURSIVE {_E}, bi AS (SELECT spec1 AS u, spec2 AS v FROM edges UNION SELECT spec2, spec1 FROM edges), walk(node, source, distance) AS (SELECT (r_regionkey + 1)::BIGINT, (r_regionkey + 1)::BIGINT, 0 FROM region UNION SELECT v, source, distance + 1 FROM walk JOIN bi ON node = u WHERE distance < 6)
        SELECT node, min(distance)::INT AS distance, arg_min(source, distance * 1000 + source) AS source FROM walk GROUP BY 1""",
    "propagation": f"""WITH RECURSIVE {_D}, bi AS (SELECT spec1 AS u, spec2 AS v, score1 AS w FROM sp UNION ALL SELECT spec2, spec1, score1 FROM sp),
        known(node, annotation, fdr, step) AS (SELECT event_id, concat('u', user_id::VARCHAR), 0.01::DOUBLE, 0 FROM events WHERE event_type = 'purchase' UNION ALL
        (SELECT v, arg_min(annotation, (-w, u)), arg_min(fdr + 0.02 - fdr * 0.02, (-w, u)), any_value(step) + 1 FROM known JOIN bi ON node = u
         WHERE step < 5 AND v NOT IN (SELECT node FROM recurring.known) GROUP BY v))
        SELECT node, annotation, round(fdr, 9) AS fdr, step::INT AS step FROM known""",
    "topological_order": f"""WITH RECURSIVE {_CC}, walk(node, layer) AS (SELECT node, 0 FROM cc WHERE node NOT IN (SELECT spec2 FROM sp) UNION SELECT spec2, layer + 1 FROM walk JOIN sp ON node = spec1)
        SELECT component, node, max(layer)::INT AS layer FROM walk JOIN cc USING (node) GROUP BY 1, 2""",
    "library_search_topk": with_views(f"WITH {_LIB} SELECT query, entry, (row_number() OVER (PARTITION BY query ORDER BY dot DESC, entry))::INT AS rank, dot, shared FROM m WHERE dot >= 0.1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY dot DESC, entry) <= 3", "spectra", "peaks"),
    "library_target_decoy": with_views(f"""WITH {_LIB}, r AS (SELECT *, row_number() OVER (PARTITION BY query, is_decoy ORDER BY dot DESC, entry) AS n FROM m),
        s AS (SELECT query, is_decoy, max(dot) FILTER (n = 1) AS top, max(entry) FILTER (n = 1) AS entry, coalesce(max(dot) FILTER (n = 2), 0) AS sec FROM r GROUP BY 1, 2),
        w AS (SELECT s.*, coalesce(o.top, 0) AS other FROM s LEFT JOIN s o ON s.query = o.query AND s.is_decoy <> o.is_decoy)
        SELECT query, entry, is_decoy, top AS dot, round(0.6 * top + 0.4 * (top - greatest(sec, other)), {R})::DOUBLE AS score FROM w WHERE top > other""", "spectra", "peaks"),
    "library_filter": "SELECT p_partkey AS spec_idx, p_brand AS annotation FROM part WHERE p_size / 50 <= 0.5 AND NOT contains(p_brand, '5') AND p_size % 4 IN (1, 2) AND p_brand <> ''",
}
