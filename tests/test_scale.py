"""Operators that work in rounds or in bounded pieces, against plain versions."""

import random

import numpy as np
import pytest

from peakweave.operators import graph, kernels, sequencing
from peakweave.operators.components import connected_components


def random_edges(seed, nodes, n):
    r = random.Random(seed)
    return [(r.randrange(nodes), r.randrange(nodes), r.randrange(6) / 4, r.randrange(6) / 4) for _ in range(n)]


@pytest.mark.parametrize("few", [40, 10_000])
def test_components_by_rounds(spark, few):
    rows = [(k, k + 1) for k in range(300)] + [(1000 + k, 999) for k in range(200)] + [x[:2] for x in random_edges(1, 5000, 900)] + [(-7, -7)]
    parent = {x: x for e in rows for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in rows:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = connected_components(spark.createDataFrame(rows, "a long, b long"), few=few, hub_rows=50).collect()
    assert len(got) == len(parent) and {x["node"]: x["component"] for x in got} == {x: root(x) for x in parent}


@pytest.mark.parametrize("few", [30, 10_000])
def test_orientation_by_rounds(spark, few):
    rows = list({x[:2]: x for x in random_edges(3, 150, 260)}.values()) + [(500 + k, 501 + k, k / 7, 1.0) for k in range(60)] + [(900, 900, 1.0, 2.0)]
    parent, turn = {}, {}
    for a, b, d, f in sorted(rows, key=lambda x: (-max(x[2:]), *x[:2])):
        for x in (a, b):
            parent.setdefault(x, {x})
            turn.setdefault(x, 0)
        if parent[a] is not parent[b]:
            flip = turn[a] ^ turn[b] ^ (f > d)
            for x in parent[b]:
                turn[x] ^= flip
            parent[a] |= parent[b]
            for x in parent[b]:
                parent[x] = parent[a]
    want = {x: bool(turn[x] ^ turn[min(parent[x])]) for x in parent}
    got = sequencing.oriented(spark.createDataFrame(rows, "spec1 long, spec2 long, direct double, flipped double"), few=few).collect()
    assert len(got) == len(want) and {x["node"]: x["reversed"] for x in got} == want


def test_lightest_edges_go_as_round_by_round():
    for seed in range(60):
        rows = random_edges(seed, 40, 90)
        a, b = [x[0] for x in rows], [x[1] for x in rows]
        for most, part in ((5, 20), (8, 3), (1, 2)):
            todo, want = [list(range(len(rows)))], []
            while todo:
                left, parts = todo.pop(), []
                for k in left:
                    near = [p for p in parts if {a[k], b[k]} & p[0]]
                    parts = [p for p in parts if p not in near] + [({a[k], b[k]}.union(*(p[0] for p in near)), sorted([k, *(e for p in near for e in p[1])]))]
                for nodes, own in parts:
                    if len(nodes) <= most:
                        want += own
                    else:
                        todo.append(own[max(1, len(nodes) // part) :])
            assert sorted(graph.lightest_gone(a, b, most, part)) == sorted(want)


def test_components_are_streamed_whole(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(100 * c + k, 100 * c + k + 1, 1.0, 1.0) for c in range(9) for k in range(c + 1)]
        e = spark.createDataFrame(rows, "spec1 long, spec2 long, score1 double, score2 double")
        assert {x["node"]: x["layer"] for x in graph.topological_order(e).collect()} == {100 * c + k: k for c in range(9) for k in range(c + 2)}
        assert {x["component"]: x["path"] for x in graph.heaviest_path(e).collect()} == {100 * c: [100 * c + k for k in range(c + 2)] for c in range(9)}
        r = random.Random(5)
        cells = [(p, run, place, b, r.random()) for p in range(12) for run in (1, 2) for place in range(p % 4 + 1) for b in range(3)]
        got = {}
        for x in sequencing.aligned_runs(spark.createDataFrame(cells, "pair long, run int, place int, bin long, value double")).collect():
            got.setdefault(x["pair"], []).append((x["place1"], x["place2"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    value = {c[:4]: c[4] for c in cells}
    for p in range(12):
        n = p % 4 + 1
        table = np.array([[sum(value[p, 1, i, b] * value[p, 2, j, b] for b in range(3)) for j in range(n)] for i in range(n)])
        assert sorted(got[p]) == kernels.align_runs(table)


def test_runs_of_many_scans_align_as_few_do():
    r = np.random.default_rng(4)
    large = np.where(r.random((60, 50)) < 0.1, r.random((60, 50)), 0)
    total = lambda way, t: sum(t[a, b] for a, b in way)
    best = np.zeros((61, 51))
    for i in range(60):
        for j in range(50):
            best[i + 1, j + 1] = max(best[i, j] + large[i, j], best[i, j + 1], best[i + 1, j])
    way = kernels.align_runs(large)
    assert abs(total(way, large) - best[-1, -1]) < 1e-2 and all(a < c and b < d for (a, b), (c, d) in zip(way, way[1:], strict=False))


def test_searches_where_sequences_lie(spark, monkeypatch):
    from peakweave.operators import proteins

    r = random.Random(8)
    seqs = [(k, "".join(r.choice("ACDKé" if k % 3 else "ACDK") for _ in range(r.randrange(80)))) for k in range(40)] + [(40, None), (41, "AAAA"), (42, "AAAA")]
    p = spark.createDataFrame(seqs, "db_index int, sequence string")
    words = spark.createDataFrame([(w,) for w in ("A", "AA", "ACD", "AA", "", "DKACA", "ACDKACDKA")], "peptide string")
    want = sorted((w, k, i + 1) for w in ("A", "AA", "ACD", "AA", "DKACA", "ACDKACDKA") for k, s in seqs if s for i in range(len(s)) if s.startswith(w, i))
    monkeypatch.setattr(proteins, "PLACES", 9)
    assert sorted(map(tuple, proteins.substring_search(p, words).collect())) == want
    monkeypatch.setattr(proteins, "SCANNED", 0)
    assert sorted(map(tuple, proteins.substring_search(p, words).collect())) == want
    plain = p.filter("sequence IS NOT NULL AND NOT contains(sequence, 'é')")
    tags = spark.createDataFrame([("ACD",), ("AAA",)], "tag string")
    index = proteins.tag_index(plain).join(tags, "tag").select("tag", "db_index", "pos", "before", "after")
    assert sorted(map(tuple, proteins.tag_places(plain, ["ACD", "AAA"]).collect())) == sorted(map(tuple, index.collect())) != []


def test_equal_sequences_are_searched_once(spark):
    from peakweave.operators import proteins

    tags = spark.createDataFrame([(1, "TID", 97.05276, 0.0), (1, "TID", 500.0, 0.0)], "spec_idx long, tag string, before double, after double")
    got = {}
    for n in (1, 30):
        p = spark.createDataFrame([(k, "GGPEPTIDE" if k % 2 else "AATID") for k in range(2 * n)], "db_index int, sequence string")
        got[n] = [tuple(x) for x in proteins.tag_search(tags, p, 0.01, 1).collect()]
    one = {x[2] % 2: x for x in got[1]}
    assert one and sorted(got[30]) == sorted((s, t, k, pos, m) for k in range(60) for s, t, i, pos, m in got[1] if i == k % 2)


def test_boosted_peaks_in_more_tasks(spark):
    from pyspark.sql import functions as F

    from peakweave.operators import precursors

    r = random.Random(6)
    rows = [(r.randrange(9), r.choice("FOP"), float(r.randrange(300)), 1.0 + r.randrange(5), 0.0) for _ in range(400)]
    t = spark.createDataFrame(rows, "precursor long, frag_type string, mz double, intensity double, tol double")
    many = precursors.boosted_peaks(t, ["precursor"], 25.0, 9 * precursors.TASK_PEAKS)
    assert many.rdd.getNumPartitions() == 10 or spark.conf.get("spark.sql.adaptive.enabled") == "true"
    s = t.groupBy("precursor", "frag_type").agg(F.collect_list(F.struct("mz", "intensity", "tol")).alias("peaks"))
    bins = {}
    for p, kind, m, i, _ in rows:
        bins.setdefault((p, int(m / 50 + 0.5)), []).append((kind, i))
    want = {(p, round(sum(i for _, i in v) * len({k for k, _ in v}), 6)) for (p, _), v in bins.items()}
    for got in (many, precursors.boosted(s, ["precursor"], 25.0)):
        assert {(x["precursor"], round(q["intensity"], 6)) for x in got.collect() for q in x["peaks"]} == want


def test_deconvolution_of_rows(spark):
    rows = [(1, [(300.0, 9.0, 0.0), (300.5014, 5.0, 0.0), (301.0028, 2.0, 0.0), (500.0, 1.0, 0.0)], 2), (2, None, 2), (3, [], None), (4, [(100.0, 2.0, 0.0)], None)]
    s = spark.createDataFrame(rows, "spec_idx long, peaks array<struct<mz:double,intensity:double,tol:double>>, charge int")
    got = {x["spec_idx"]: [(round(p["mz"], 3), p["intensity"]) for p in x["peaks"]] for x in sequencing.deconvoluted(s).collect()}
    assert got == {1: [(300.0, 11.0), (500.0, 1.0), (599.996, 5.0)], 2: [], 3: [], 4: [(100.0, 2.0)]}


def test_mgf_lines():
    from peakweave.sources.spectra_files import parse_mgf

    row = parse_mgf("BEGIN IONS\nSCANS=7\nPEPMASS=5.5 9\nCHARGE=2+\n\n .5 1\n1e1\t2.0\n3 4 x\n+2 5\nEND IONS", "f")
    assert (row["scan"], row["charge"], row["parent_mz"]) == (7, 2, 5.5)
    assert [(p["mz"], p["intensity"]) for p in row["peaks"]] == [(0.5, 1.0), (2.0, 5.0), (10.0, 2.0)]
