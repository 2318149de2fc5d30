"""Goldens and brute force for what SQL can't express."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peakweave.functions import peptide, text
from peakweave.operators import clusters, fdr, graph, kernels, library, pairs, peaks, precursors, proteins, psms, report, sequencing, spectra
from peakweave.operators.components import connected_components
from peakweave.plans import modules, network_queries, psm_queries
from peakweave.sources.tables_text import Parameters

E = "spec1 long, spec2 long, score1 double, score2 double, shift1 double, shift2 double"
PEAKS = "array<struct<mz:double,intensity:double,tol:double>>"


def edges(spark, rows):
    return spark.createDataFrame([(a, b, s, s, d, 0.0) for a, b, s, d in rows], E)


def spectra_of(spark, rows):
    return spark.createDataFrame([(i, pm, 1, [(m, v, 0.0) for m, v in p]) for i, pm, p in rows], f"spec_idx long, parent_mass double, charge int, peaks {PEAKS}")


def test_fdr_golden(spark):
    rows = [(7 - k, c == "D", k) for k, c in enumerate("TTDTTDT")]
    got = fdr.cumulative_fdr(spark.createDataFrame(rows, "score int, is_decoy boolean, psm_id int"), tiebreak=["psm_id"], buckets=3).orderBy("psm_id").collect()
    assert [round(r["raw_fdr"], 6) for r in got] == [0, 0, 0.5, round(1 / 3, 6), 0.25, 0.5, 0.4]
    assert [r["fdr"] for r in got] == [0, 0, 0.25, 0.25, 0.25, 0.4, 0.4]
    none = fdr.cumulative_fdr(spark.createDataFrame([(1.0, True, 1)], "score double, is_decoy boolean, psm_id int"), tiebreak=["psm_id"])
    assert fdr.prefix_cutoff(none, 0.01).count() == 0 and fdr.prefix_cutoff(none, 0.01, keep_first=True, tiebreak=["psm_id"]).count() == 1


def test_target_wins_a_tie(spark):
    t = spark.createDataFrame([(1, 5.0, 1)], "scan int, score double, psm_id int")
    d = spark.createDataFrame([(1, 5.0, 0)], "scan int, score double, psm_id int")
    assert not fdr.merge_target_decoy(t, d, ["scan"], tiebreak=["psm_id"]).first()["is_decoy"]


def test_four_nodes(spark):
    got = graph.component_sizes(edges(spark, [(1, 2, 1.0, 0.0), (3, 2, 1.0, 0.0)])).collect()
    assert [(r["component"], r["nodes"], r["edges"]) for r in got] == [(1, 3, 2)]


def test_components_against_union_find(spark):
    r = random.Random(1)
    rows = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (5000, 5000)]
    parent = {x: x for e in rows for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in rows:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(rows, "a long, b long")).collect()
    assert {x["node"]: x["component"] for x in got} == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_greedy(mz1, i1, mz2, i2, shift, tol):
    a, b = np.sqrt(i1) / np.sqrt(sum(i1)), np.sqrt(i2) / np.sqrt(sum(i2))
    found = sorted({(-a[i] * b[j], i, j) for i in range(len(a)) for j in range(len(b)) for s in {0.0, shift} if abs(mz1[i] - s - mz2[j]) <= tol})
    used1, used2, score = set(), set(), 0.0
    for v, i, j in found:
        if i not in used1 and j not in used2:
            used1.add(i)
            used2.add(j)
            score -= v
    return score, len(used1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(50, 90), st.integers(1, 9)), min_size=1, max_size=9), st.lists(st.tuples(st.integers(50, 90), st.integers(1, 9)), min_size=1, max_size=9), st.integers(-5, 5))
def test_greedy_cosine(x, y, shift):
    x, y = sorted(x), sorted(y)
    arrays = [np.array(v, float) for p in (x, y) for v in zip(*p, strict=True)]
    got = kernels.greedy_match(*arrays, float(shift), 1.0)
    want = brute_greedy(*arrays, float(shift), 1.0)
    assert abs(got[0] - want[0]) < 1e-9 and got[1] == want[1] and got[0] <= 1 + 1e-9
    assert abs(kernels.greedy_match(*arrays, 0.0, 1.0)[0] - kernels.greedy_match(*arrays[2:], *arrays[:2], 0.0, 1.0)[0]) < 0.2


def test_many_cosines_at_once():
    r = np.random.default_rng(8)
    own = [[np.sort(r.uniform(50, 90, n)), r.uniform(1, 9, n)] for n in r.integers(1, 12, 80)]
    shift = r.integers(-3, 4, 40).astype(float)
    for projected in (False, True):
        left, right = own[:40], own[40:]
        many = kernels.greedy_match_many(*(np.concatenate([x[k] for x in left]) for k in (0, 1)), np.array([len(x[0]) for x in left]), *(np.concatenate([x[k] for x in right]) for k in (0, 1)), np.array([len(x[0]) for x in right]), shift, 1.5, projected=projected)
        for k in range(40):
            assert np.allclose([m[k] for m in many], kernels.greedy_match(*left[k], *right[k], shift[k], 1.5, projected=projected))


def test_cosine_network_finds_all_close_pairs(spark):
    r = random.Random(2)
    rows = [(i, r.uniform(400, 420), sorted((r.uniform(50, 390), r.uniform(1, 9)) for _ in range(8))) for i in range(60)]
    got = pairs.cosine_network(spectra_of(spark, rows), 2.0, 5.0, 0.3, 2).collect()
    want = set()
    for (i, m, p), (j, n, q) in itertools.combinations(rows, 2):
        if abs(m - n) <= 2.0:
            c, k = brute_greedy(*[np.array(v) for z in (p, q) for v in zip(*z, strict=True)], m - n, 5.0 + 1e-6)
            if c >= 0.3 and k >= 2:
                want.add((i, j))
    assert {(x["spec1"], x["spec2"]) for x in got} == want and want


def test_component_size_limit(spark):
    rows = [(i, i + 1, 1.0 - i / 100, 0.0) for i in range(12)]
    got = graph.limit_component_size(edges(spark, rows), 6)
    assert max(r["nodes"] for r in graph.component_sizes(got).collect()) <= 6
    kept = {(r["spec1"], r["spec2"]) for r in got.collect()}
    assert (0, 1) in kept and (11, 12) not in kept


def test_triangles(spark):
    rows = [(1, 2, 1.0, 10.0), (2, 3, 1.0, 5.0), (1, 3, 1.0, 15.2), (3, 4, 1.0, 7.0)]
    assert {(r["spec1"], r["spec2"]) for r in graph.in_triangles(edges(spark, rows), 0.5).collect()} == {(1, 2), (2, 3), (1, 3)}
    assert graph.in_triangles(edges(spark, rows), 0.1).count() == 0


def test_variant_and_mass_limits(spark):
    masses = spark.createDataFrame([(i, float(m)) for i, m in enumerate([100, 200, 200, 200, 300, 400])], "spec_idx long, parent_mass double")
    rows = [(0, 1, 0.9, 0.0), (0, 2, 0.8, 0.0), (0, 3, 0.7, 0.0), (0, 4, 0.6, 0.0), (4, 5, 0.5, 0.0)]
    assert {(r["spec1"], r["spec2"]) for r in graph.limit_per_variant(edges(spark, rows), masses, 2).collect()} == {(0, 1), (0, 2), (0, 4), (4, 5)}
    assert {(r["spec1"], r["spec2"]) for r in graph.limit_unique_masses(edges(spark, rows), masses, 3).collect()} == {(0, 1), (0, 2), (0, 3), (0, 4)}


def test_paths_and_order(spark):
    e = edges(spark, [(1, 2, 1.0, 0.0), (2, 4, 5.0, 0.0), (1, 3, 4.0, 0.0), (3, 4, 1.0, 0.0)])
    assert graph.heaviest_path(e).first()["path"] == [1, 2, 4]
    assert {r["node"]: r["position"] for r in graph.topological_order(e).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    near = graph.lightest_paths(e, spark.createDataFrame([(1,)], "node long")).collect()
    assert {r["node"]: r["distance"] for r in near} == {1: 0, 2: 1, 3: 4, 4: 5}
    assert {r["position"] for r in graph.topological_order(edges(spark, [(1, 2, 1.0, 0.0), (2, 1, 1.0, 0.0)])).collect()} == {-1}


def test_propagation(spark):
    e = edges(spark, [(1, 2, 0.9, 0.0), (2, 3, 0.8, 0.0), (1, 3, 0.5, 0.0), (3, 4, 0.9, 0.0)]).withColumn("edge_fdr", F.lit(0.1))
    seeds = spark.createDataFrame([(1, "PEP", 0.01)], "node long, annotation string, fdr double")
    got = {r["node"]: (r["step"], round(r["fdr"], 4), r["source"]) for r in graph.propagate(e, seeds, 3).collect()}
    assert got == {1: (0, 0.01, 1), 2: (1, 0.109, 1), 3: (1, 0.109, 1), 4: (2, 0.1981, 3)}


def test_edge_rate(spark):
    rows = [(1, 2, 0.9, False), (3, 4, 0.8, False), (5, 6, 0.7, True), (7, 8, 0.6, False), (9, 10, 0.5, True)]
    e = spark.createDataFrame([(a, b, s, s, d) for a, b, s, d in rows], "spec1 long, spec2 long, score1 double, score2 double, is_decoy boolean")
    assert pairs.edge_fdr(e, 0.3).count() == 5 and pairs.edge_fdr(e, 0.1).count() == 3
    assert pairs.edge_fdr(e.filter("NOT is_decoy"), 0.1).count() == 3


def test_peaks(spark):
    s = spectra_of(spark, [(1, 500.0, [(100.0, 4.0), (100.4, 9.0), (200.0, 1.0)]), (2, 500.0, [])])
    get = lambda df: [(round(p["mz"], 3), round(p["intensity"], 3)) for p in df.filter("spec_idx = 1").first()["peaks"]]
    assert get(peaks.merge_close(s, 0.5)) == [(100.4, 13.0), (200.0, 1.0)]
    assert get(peaks.normalize_total(s, 14)) == [(100.0, 4.0), (100.4, 9.0), (200.0, 1.0)]
    assert get(peaks.top_k(s, 2)) == [(100.0, 4.0), (100.4, 9.0)]
    assert get(peaks.rank_filter(s, 1, 50.0)) == [(100.4, 9.0), (200.0, 1.0)]
    assert get(peaks.reverse(peaks.reverse(s))) == get(s)
    for f in (peaks.normalize_l2, lambda x: peaks.snr_filter(x, 2.0), lambda x: peaks.deviation_filter(x, 2), lambda x: peaks.round_mz(x, 0.5), lambda x: peaks.window_filter(x, 50, 1), lambda x: peaks.make_symmetric(x, 0.5)):
        assert f(s).filter("spec_idx = 2").first()["peaks"] == []
    assert peaks.positions_of(s, [100.3, 150.0], 0.2).orderBy("spec_idx", "mass").collect()[0]["position"] == 1


def test_peptides(spark):
    rows = [("K.PEP(S,79.966)TIDER.A",), ("PEPTIDE",), ("A.PE[12.5]PTIDE.K",)]
    df = spark.createDataFrame(rows, "p string")
    p = F.col("p")
    got = df.select(peptide.unmodified(p).alias("u"), peptide.residue_mass(p).alias("m"), peptide.tryptic_ends(p).alias("t"), F.size(peptide.ions(p)).alias("n"), peptide.mod_positions(p).alias("at")).collect()
    mass = lambda s: sum(kernels.RESIDUES[c] for c in s)
    assert [r["u"] for r in got] == ["PEPSTIDER", "PEPTIDE", "PEPTIDE"]
    assert np.allclose([r["m"] for r in got], [mass("PEPSTIDER") + 79.966, mass("PEPTIDE"), mass("PEPTIDE") + 12.5])
    assert [r["t"] for r in got][0] == 2 and [r["n"] for r in got] == [16, 12, 14] and got[0]["at"] == [4]
    assert df.select(peptide.shuffled(F.lit("ARNDKCEP")).alias("s")).first()["s"][1::3] == "RKP"
    assert spark.range(1).select(text.ranges(F.lit("1-3, 5"))).first()[0] == [1, 2, 3, 5]


def test_tags_and_de_novo(spark):
    seq = "PEPTIDE"
    masses = list(itertools.accumulate(kernels.RESIDUES[c] for c in seq))
    s = spectra_of(spark, [(1, masses[-1] + 19.01784115, [(0.0, 1.0)] + [(m, 5.0) for m in masses])])
    best = sequencing.tags(s, 3, 0.01, 5).collect()
    assert {r["tag"].replace("L", "I") for r in best} <= {seq[i : i + 3] for i in range(5)} and len(best) == 5
    assert sequencing.de_novo(s, 0.01).first()["sequence"] == "PEPTIDE"
    rank = sequencing.first_correct_tag(sequencing.tags(s, 3, 0.01, 5), spark.createDataFrame([(1, "PEPTIDE")], "spec_idx long, annotation string"))
    assert rank.first()["rank"] == 1


def test_spectral_probability():
    r = {round(m / 1.0005) for x, m in kernels.RESIDUES.items() if x != "L"}
    target, at = 300, {57: 2, 170: 3}

    def all_ways(m, s, p):
        if m == target:
            return [(s, p)]
        return [w for x in (round(v / 1.0005) for k, v in kernels.RESIDUES.items() if k != "L") if m + x <= target for w in all_ways(m + x, s + (at.get(m + x, 0) if m + x < target else 0), p / 19)]

    ways = all_ways(0, 0, 1.0)
    want = sum(p for s, p in ways if s >= 3) / sum(p for _, p in ways)
    got = kernels.spectral_probability(np.array([57 * 1.0005, 170 * 1.0005]), np.array([2.0, 3.0]), target * 1.0005, 3)
    assert abs(got - want) < 1e-12 and 57 in r


def test_alignment_and_assembly(spark):
    full = list(itertools.accumulate(kernels.RESIDUES[c] for c in "PEPTIDE"))
    a = [(m, 5.0) for m in full]
    b = [(m + (80.0 if k >= 3 else 0.0), 5.0) for k, m in enumerate(full)]
    s = spectra_of(spark, [(1, full[-1], a), (2, full[-1] + 80, b)])
    both = pairs.mass_pairs(s, 100.0, ["peaks"])
    out = sequencing.spectral_alignments(both, 0.01)
    assert len(out.first()["matched"]) == 7
    contig = sequencing.assembled(s, out, 0.01).first()
    assert len(contig["vertices"]) >= 4 and contig["left_out"] == []
    got = kernels.penalty_alignment(np.array([m + (80.0 if k >= 3 else 0.0) for k, m in enumerate(full)]), np.ones(7), "AAPEPTIDEAA", 0.01, 0.05, 1)
    assert got[1] == 2 and "(T,80.00)" in got[3]


def test_other_kernels(spark):
    assert kernels.envelope_score(kernels.envelope(1200.0), 1200.0) < 1e-9 < kernels.envelope_score(np.array([0.0, 1, 0]), 1200.0)
    mz, i = kernels.deconvolute(np.array([500.0 + k * 1.00286864 / 2 for k in range(4)]), kernels.envelope(998.0, 4) * 100, 3, 0.01)
    assert len(mz) == 1 and abs(mz[0] - (1000 - 1.00727646688)) < 1e-6
    model = {"low": [0.0, 0.0], "high": [1.0, 1.0], "vectors": [[1.0, 1.0]], "coefficients": [2.0], "gamma": 0.5, "rho": 1.0}
    got = sequencing.svm_scores(spark.createDataFrame([(1.0, 5.0), (0.0, 1.0)], "a double, b double"), ["a", "b"], model).collect()
    assert np.allclose([r["svm_score"] for r in got], [1.0, 2 * np.exp(-2) - 1])


def test_psms(spark):
    p = spark.createDataFrame([(1, 1, "A"), (1, 2, "A"), (1, 1, "B"), (2, 1, "B"), (3, 3, "C")], "psm_id int, scan int, protein string")
    assert {(r["scan"], r["protein"]) for r in psms.parsimony(p).collect()} == {(1, "A"), (2, "A"), (3, "C")}
    prot = spark.createDataFrame([(0, "AAPEPTIDEKK")], "db_index int, sequence string")
    v = psms.variants(spark.createDataFrame([(1, "PEPTLDE"), (2, "TIDEQ")], "psm_id long, annotation string"), prot).orderBy("psm_id").collect()
    assert [(r["start_aa"], r["end_aa"], r["region"]) for r in v] == [(3, 9, 1), (6, 10, 1)]
    members = spark.createDataFrame([(0, 1, 7), (0, 2, 7), (0, 3, 7)], "file_idx int, scan int, cluster_idx int")
    votes = spark.createDataFrame([(0, 1, "A", 0.5), (0, 2, "A", 0.4), (0, 3, "B", 0.1)], "file_idx int, scan int, annotation string, p_value double")
    assert psms.consensus(votes, members).first()["annotation"] == "A" and psms.consensus_compat(votes, members).first()["annotation"] == "B"


def test_proteins(spark):
    prot = spark.createDataFrame([(0, "P0", "", "AAPEPTIDEKK")], "db_index int, id string, description string, sequence string")
    assert [r["sequence"] for r in proteins.with_decoys(prot).orderBy("is_decoy").collect()] == ["AAPEPTIDEKK", "KKEDITPEPAA"]
    before, after = (sum(kernels.RESIDUES[c] for c in s) for s in ("PEP", "EKK"))
    tags = spark.createDataFrame([(1, "TID", before, after), (2, "TID", 5.0, 6.0)], "spec_idx long, tag string, before double, after double")
    assert [tuple(r) for r in proteins.tag_search(tags, prot, 0.01, 2).collect()] == [(1, "TID", 0, 6, 2)]
    s = spark.createDataFrame([(1, sum(kernels.RESIDUES[c] for c in "PTIDE") + 19.01784115)], "spec_idx long, parent_mass double")
    assert {(r["start_aa"], r["end_aa"]) for r in proteins.mass_search(s, prot, 0.001).collect()} == {(4, 8), (5, 9)}  # EPTID weighs the same
    hits = spark.createDataFrame([(0, 1, 4), (0, 2, 3), (0, 8, 9), (0, 1, 4)], "db_index int, start_aa int, end_aa int")
    c = proteins.coverage(hits, spark.createDataFrame([(0, 12)], "db_index int, length int")).first()
    assert (c["covered"], c["total"], c["percent"]) == (6, 12, 50.0)


def test_match_golden():
    own = [[(102.05, 1.0), (215.13, 1.0), (330.16, 1.0)], [(102.05, 1.0), (215.13, 1.0), (330.16, 1.0), (10.05, 1.0), (459.05, 1.0)], [(148.04, 1.0), (263.07, 1.0), (376.15, 1.0)]]
    prefixes = [1, 98.05, 227.1, 324.15, 425.2, 538.28, 653.31, 782.35]
    assert proteins.match_peptide(own, [477.2] * 3, prefixes) == 10


def test_library(spark):
    m = spark.createDataFrame([(1, 10, False, 0.9), (1, 11, False, 0.5), (1, 12, True, 0.7), (2, 10, False, 0.6), (2, 12, True, 0.6), (3, 12, True, 0.4)], "query long, entry long, is_decoy boolean, dot double")
    got = {r["query"]: (r["entry"], r["is_decoy"], round(r["score"], 6)) for r in library.target_decoy_winners(m).collect()}
    assert got == {1: (10, False, round(0.54 + 0.4 * 0.2, 6)), 3: (12, True, round(0.24 + 0.16, 6))}
    lib = spark.createDataFrame([(1, "PEPTIDEK", [(98.06, 5.0, 0.0)])], f"spec_idx long, annotation string, peaks {PEAKS}")
    d = library.decoys(lib, 0.1).first()
    assert sorted(d["annotation"]) == sorted("PEPTIDEK") and d["is_decoy"] and d["annotation"][0] == "P"
    assert library.substituted(lib, "T", "S", 0.1).first()["annotation"] == "PEPSIDEK"


def test_sets(spark):
    a = spectra_of(spark, [(k, 100.0 + k, [(50.0, 1.0)]) for k in range(5)])
    assert [r["spec_idx"] for r in spectra.weave(a.filter("spec_idx < 2"), a.filter("spec_idx >= 2")).orderBy("position").collect()] == [0, 2, 1, 3, 4]
    assert spectra.consecutive_blocks(a, 1).count() == 3 and spectra.parallel(a, a).first()["n_merged"] == 2
    assert spectra.at_least_peaks(a, 2, empty=True).filter("size(peaks) = 0").count() == 5
    assert {r["part"] for r in spectra.parts(a, 2).collect()} <= {0, 1}
    groups = clusters.cosine_clusters(a, 10.0, 0.5, 0.9, 1)
    assert groups.select("cluster_idx").distinct().count() == 1


def test_report_pages(spark):
    t = spark.createDataFrame([(str(k), "x") for k in (10, 9, 100, 1)] + [("-", "x")], "n string, v string")
    assert [r["n"] for r in report.page(t, "n", start=1, rows=3).collect()] == ["1", "9", "10"]
    assert [r["n"] for r in report.page(t, "n", descending=True).collect()][0] == "100"


def test_modules(spark):
    s = spectra_of(spark, [(k, 400.0 + k / 10, [(50.0 + 7 * j, 1.0 + j) for j in range(8)]) for k in range(4)])
    e = modules.run("cosine_network", {"spectra": s}, Parameters.from_text("MAX_SHIFT=5\nMIN_MATCHED_PEAKS=3"))
    assert e.count() == 6
    kept = modules.run("filter_edges", {"edges": e.withColumn("shift2", F.lit(0.0)), "spectra": s}, Parameters.from_text("FILTER_TRIGS=1\nMAX_COMPONENT_SIZE=3"))
    assert kept.count() <= 6
    assert modules.run("convert", {"spectra": s}, Parameters.from_text("TOP_PEAKS=3\nMIN_PEAK_INT=7")).first()["peaks"] != []
    with pytest.raises(ValueError):
        modules.run("tags", {})
    with pytest.raises(ValueError):
        modules.run("none", {})


def test_precursors(spark):
    mz, z = 500.0, 2
    model = kernels.envelope((mz - 1.00727646688) * z, 4) * 100
    survey = [(mz + k * precursors.ISOTOPE / z, float(v), 0.0) for k, v in enumerate(model)]
    rows = [(1, 1, 0.0, 0.0, 0, survey), (2, 2, mz + precursors.ISOTOPE / z, 0.0, 1, [(100.0, 5.0, 0.0)])]
    s = spark.createDataFrame(rows, f"spec_idx long, ms_level int, parent_mz double, parent_mass double, charge int, peaks {PEAKS}").withColumn("run", F.lit(1))
    got = precursors.guess(precursors.with_survey(s, ["spec_idx"], ["run"]), 0.01).first()
    assert got["charge"] == 2 and abs(got["parent_mz"] - mz) < 1e-6 and got["precursor_kl"] < 1e-9
    assert precursors.isotope_filter(precursors.guess(precursors.with_survey(s, ["spec_idx"], ["run"]), 0.01), 0.1).count() == 1


def test_combined_spectra(spark):
    s = spark.createDataFrame([(1, "CID", [(100.0, 1.0, 0.0), (150.0, 2.0, 0.0)]), (1, "ETD", [(100.1, 1.0, 0.0)])], f"pre int, frag_type string, peaks {PEAKS}")
    assert [p["intensity"] for p in precursors.boosted(s, ["pre"], 0.5).first()["peaks"]] == [4.0, 2.0]
    two = spark.createDataFrame([(1, 2, None, 500.0, [(100.0, 1.0, 0.0)]), (9, 3, 1, 250.0, [(100.2, 3.0, 0.0), (180.0, 1.0, 0.0)])], f"spec_idx long, ms_level int, parent_spec long, parent_mass double, peaks {PEAKS}")
    assert [p["mz"] for p in precursors.merged_stages(two, 0.5).first()["peaks"]] == [100.0, 100.2]
    p = spark.createDataFrame([(1, "STAS", "ST", 2), (2, "AAA", "S", 1), (3, "SA", "S", 0)], "psm_id int, plain string, sites string, n_mods int")
    assert sorted((r["psm_id"], r["positions"]) for r in precursors.placements(p).collect()) == [(1, [1, 2]), (1, [1, 4]), (1, [2, 4]), (3, [])]
    f = spark.createDataFrame([(16.0, 0.5), (80.0, 0.05), (1.0, 0.0)], "mass double, frequency double")
    assert {r["mass"]: round(r["penalty"], 4) for r in precursors.penalties(f, 10.0).collect()} == {16.0: round(10 * np.log10(0.5) / np.log10(0.05), 4), 80.0: 10.0}
    q = spark.createDataFrame([(1, "PEP", 2, 1.0), (2, "PEP", 2, 5.0)], "psm_id int, plain string, charge int, score double")
    assert precursors.partners(q.filter("psm_id = 1"), q).first()["partner"] == 2


def test_contigs_again(spark):
    c = spark.createDataFrame([(1, [(10.0, 5.0, [(1, 0), (2, 0)]), (81.0371, 5.0, [(1, 1)])])], "contig_idx long, vertices array<struct<mz:double,score:double,members:array<struct<spec_idx:long,peak_idx:int>>>>")
    r = precursors.contig_statistics(c).first()
    assert (r["n_vertices"], r["n_spectra"], r["mean_members"], r["gaps"], r["explained"]) == (2, 2, 1.5, 1, 100.0)
    assert round(precursors.contig_spectra(c).first()["parent_mass"], 3) == round(71.0371 + 19.01784115, 3)


def test_prefix_scores(spark):
    s = spectra_of(spark, [(1, 500.0, [(101.00727, 5.0), (83.0, 1.0)])])
    got = [p["intensity"] for p in precursors.prefix_scores(s, [(1.00727, 0.8, 0.1), (-17.0, 0.5, 0.1)], 0.05).first()["peaks"]]
    assert sorted(round(x, 4) for x in got) == sorted([round(float(np.log(8) + np.log(5)), 4), round(float(np.log(8) + np.log(0.5 / 0.9)), 4)])


def test_contigs_of_contigs(spark):
    full = list(itertools.accumulate(kernels.RESIDUES[c] for c in "PEPTIDESEQW"))
    part = lambda n, a, b: (n, [(full[k] - full[a], 5.0, [(n, k)]) for k in range(a, b)])
    c = spark.createDataFrame([part(1, 0, 8), part(2, 3, 11)], "contig_idx long, vertices array<struct<mz:double,score:double,members:array<struct<spec_idx:long,peak_idx:int>>>>")
    r = sequencing.meta_assembled(c, 0.01, 200.0, 3).first()
    assert len(r["vertices"]) == 11 and r["left_out"] == []


def test_rings(spark):
    masses = list(itertools.accumulate(kernels.RESIDUES[c] for c in "GAVW"))
    s = spectra_of(spark, [(1, masses[-1] + 1.00727646688, [(m + 1.00727646688, 5.0) for m in masses[:-1]])])
    assert sequencing.cyclic(s, 0.01).first()["sequence"] == "AVWG"


def test_mods_and_databases(spark):
    p = spark.createDataFrame([("PE(P,16)K", False), ("(P,16)EK", False), ("(S,80)K", False), ("(S,80)A", True)], "annotation string, is_decoy boolean")
    assert [(r["residues"], r["mass"], r["n"]) for r in psms.supported_mods(p, 2).collect()] == [("P", 16, 2)]
    assert [r["sequence"] for r in psms.as_proteins(p).orderBy("db_index").collect()] == ["PEK", "PEPK", "SA", "SK"]


def test_match_features(spark):
    ions = peptide.ions(F.lit("PEPTIDE"))
    mz = {(r["ion"], r["number"]): r["mz"] for r in spark.range(1).select(F.inline(ions)).collect()}
    own = sorted([mz["b", 2], mz["b", 3], mz["b", 4], mz["y", 1], 5000.0])
    s = spark.createDataFrame([(1, "PEPTIDE", sum(kernels.RESIDUES[c] for c in "PEPTIDE") + 18.010564686 + 1.00727646688, [(m, 1.0, 0.0) for m in own])], f"spec_idx long, annotation string, parent_mass double, peaks {PEAKS}")
    r = sequencing.match_features(s, 0.01).first()
    assert (r["n_peaks"], r["explained_peaks"], r["b_found"], r["longest"]) == (5, 80.0, 50.0, 3) and abs(r["mass_error_ppm"]) < 1e-6


def test_text_helpers(spark):
    df = spark.createDataFrame([("a/b\\\\c.Tar.GZ", ["x", "y", "z"]), ("none", ["x"]), ("", [])], "p string, xs array<string>")
    got = df.select(text.base_name(F.col("p")).alias("b"), text.extension(F.col("p")).alias("e"), text.without_extension(F.col("p")).alias("w")).collect()
    assert [r["b"] for r in got] == ["c.Tar.GZ", "none", ""] and [r["e"] for r in got] == ["gz", "", ""]
    assert sorted(r["combination"] for r in text.combinations(df, "xs", 2).collect()) == [["x", "y"], ["x", "z"], ["y", "z"]]
    assert abs(text.binomial_tail(2, 3, 0.5) - 0.5) < 1e-12
    assert {r["bin"]: r["count"] for r in text.histogram(spark.createDataFrame([(0.5,), (1.2,), (1.9,)], "v double"), "v", 1.0).collect()} == {0: 1, 1: 2}


def test_rounding_as_sql_does(spark):
    duckdb = pytest.importorskip("duckdb")
    xs = [63355 / 1e5, 56495 / 1e5, 0.12345, 0.5, -0.63355, 0.0, 1.00005, 2.675, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(text.round_scaled(F.col("x"), 4)).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 4)", [x]).fetchone()[0] for x in xs]


def test_edge_scores_are_rounded_as_in_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, k + 1, k + 1, p, 0.05, 1.0) for k, p in enumerate([63355.0, 33845.0, 56495.0, 12345.0, 100395.0])]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_discount double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = network_queries._edges(spark, str(tmp_path)).select("spec1", "spec2", "score1", "score2").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"WITH {network_queries._E} SELECT spec1, spec2, score1, score2 FROM edges").fetchall())


def test_precision_is_rounded_as_in_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, n, 2 * k + n, 15000.0, 0.05 if k <= 41 else 0.0, 1.0) for k in range(1, 641) for n in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_discount double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = network_queries.pair_precision_recall(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == con.execute(network_queries.ORACLES["pair_precision_recall"]).fetchall() == [(1, 640, 41, 0.064062, 1.0)]


def test_ion_masses_are_worked_out_once_a_peptide(spark):
    plan = spark.range(1).select(F.lit("PEPTIDEK").alias("p")).select(peptide.ions(F.col("p")).alias("ions"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 1  # before: 32, most of them inside functions of each ion
    got = [tuple(r) for r in spark.createDataFrame([("GA",)], "p string").select(F.inline(peptide.ions(F.col("p")))).collect()]
    assert [(i, n) for i, n, _ in got] == [("b", 1), ("y", 1)] and got[0][2] == pytest.approx(57.0214637 + 1.0072765) and got[1][2] == pytest.approx(71.0371138 + 18.0105647 + 1.0072765)


def test_peptides_are_dealt_to_all_tasks(spark):
    assert psm_queries._peptides(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_binned_pairs_are_not_shuffled(spark):
    v = spark.createDataFrame([(1, 0, 0.6), (1, 3, 0.8), (2, 3, 1.0), (3, 7, 1.0), (4, 0, 0.8), (4, 3, 0.6)], "spec_idx long, bin int, value double")
    s = spark.createDataFrame([(k, 100.0) for k in (1, 2, 3, 4)], "spec_idx long, parent_mass double")
    plain = pairs.binned_cosine(pairs.mass_pairs(s, 0.1), v)
    both = pairs.mass_pairs(s.join(pairs.bin_lists(v), "spec_idx"), 0.1, ["bins"])
    key = lambda df: sorted((r["spec1"], r["spec2"], round(r["cosine"], 9), r["shared"]) for r in df.collect())
    assert key(pairs.with_bin_products(both, "cosine")) == key(plain) == [(1, 2, 0.8, 1), (1, 4, 0.96, 2), (2, 4, 0.6, 1)]
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert shuffles(pairs.with_bin_products(both, "cosine")) == shuffles(both)


def test_scored_candidates_equal_the_two_steps(spark):
    v = spark.createDataFrame([(k, b, ((k * 7 + b * 3) % 5 + 1) / 5) for k in range(20) for b in range(k % 4)], "spec_idx long, bin int, value double")
    s = spark.createDataFrame([(k, k / 10.0, k % 2 == 0) for k in range(20)], "spec_idx long, parent_mz double, is_decoy boolean")
    q, e = s.filter("spec_idx % 3 = 0"), s.filter("spec_idx % 3 <> 0")
    key = lambda df: sorted((r["query"], r["entry"], r["is_decoy"], round(r["dot"], 9), r["shared"]) for r in df.collect())
    want = key(library.scored(library.candidates(q, e, 0.5), v, v))
    assert want and key(library.scored_candidates(q, e, 0.5, v, v)) == want
