"""Brute force for searches by distributions, alignments, orientation, and for operators that work in rounds."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakweave.functions import arrays, peptide
from peakweave.operators import clusters, distributions, graph, kernels, library, pairs, proteins, psms, sequencing
from peakweave.plans import catalogue
from peakweave.sinks import files as sinks

E = "spec1 long, spec2 long, score1 double, score2 double, shift1 double, shift2 double"


def test_cosine_distribution_against_all_cases():
    factors = np.array([[0.5, 2.0], [1.0, 1.5]])
    shares = np.array([[0.25, 0.75], [0.5, 0.5]])
    loss = np.array([0.2, 0.1])
    values, bands = np.array([0.8, 0.5, 0.33]), np.array([1, 0, 0])
    values /= np.linalg.norm(values)
    cases = []
    for picks in itertools.product(range(3), repeat=3):
        p, r = 1.0, []
        for k, x in enumerate(picks):
            b = bands[k]
            p *= loss[b] if x == 2 else (1 - loss[b]) * shares[b][x]
            r.append(0.0 if x == 2 else factors[b][x])
        y = values * r
        cases.append((float(values @ y / np.linalg.norm(y)) if y.any() else 0.0, p))
    got = kernels.cosine_distribution(values, bands, factors, shares, loss, bins=20, grid=400)
    for k in range(21):
        low, high = (sum(p for c, p in cases if c < k / 20 + e) for e in (-0.03, 0.03))
        assert low - 0.02 <= got[k] <= high + 0.02
    assert (np.diff(got) >= -1e-12).all()


def test_joint_probability_against_all_peptides():
    masses = [round(v / 1.0005) for k, v in kernels.RESIDUES.items() if k != "L"]
    first, second, target = {57: 2, 170: 3, 71: 1}, {57: 1, 128: 4, 185: 2}, 300

    def ways(m, a, b, p):
        if m == target:
            return [(a, b, p)]
        inner = lambda own, x: own.get(x, 0) if x < target else 0
        return [w for x in masses if m + x <= target for w in ways(m + x, a + inner(first, m + x), b + inner(second, m + x), p / len(masses))]

    all_ = ways(0, 0, 0, 1.0)
    total = sum(p for *_, p in all_)
    arrays_ = lambda own: (np.array([k * 1.0005 for k in own]), np.array([float(v) for v in own.values()]))
    for least in ((3, 2), (0, 1), (5, 5), (2, 7)):
        got = kernels.joint_probability(*arrays_(first), *arrays_(second), target * 1.0005, *least)
        want = [sum(p for a, b, p in all_ if test(a, b)) / total for test in (lambda a, b: a >= least[0] and b >= least[1], lambda a, b: a >= least[0], lambda a, b: b >= least[1])]
        assert np.allclose(got, want)


def test_projection_against_all_points():
    r = np.random.default_rng(3)
    for _ in range(60):
        a, b = np.sort(r.uniform(0, 50, r.integers(1, 7))), np.sort(r.uniform(0, 60, r.integers(1, 7)))
        i, j = r.integers(1, 9, len(a)).astype(float), r.integers(1, 9, len(b)).astype(float)
        best = -1.0
        for at in range(len(a) + 1):
            total = 0.0
            for k, m in enumerate(a):
                near = [y for x, y in zip(b, j, strict=True) if abs(x - m - (0 if k < at else 5.0)) <= 3]
                total += max(near) + i[k] if near else 0
            best = max(best, total)
        assert abs(kernels.project(a, i, b, j, 5.0, 3.0)[0] - best) < 1e-9


def test_best_overlap_against_all_shifts():
    r = np.random.default_rng(11)
    for _ in range(80):
        a, b = np.sort(r.integers(0, 40, r.integers(1, 8))).astype(float), np.sort(r.integers(0, 40, r.integers(1, 8))).astype(float)
        i, j = r.integers(1, 9, len(a)).astype(float), r.integers(1, 9, len(b)).astype(float)
        best = (0.0, 0.0, 0.0, 0)
        for s in sorted({x - y for x in a for y in b}):
            if min(a[-1], b[-1] + s) - max(a[0], b[0] + s) < 5:
                continue
            own = [any(abs(x - s - y) <= 0.5 for y in b) for x in a]
            other = [any(abs(x - s - y) <= 0.5 for x in a) for y in b]
            new = (s, i[own].sum() / i.sum(), j[other].sum() / j.sum(), sum(own))
            if new[1] + new[2] > best[1] + best[2] + 1e-12:
                best = new
        assert np.allclose(kernels.best_overlap(a, i, b, j, 0.5, 5), best)


def test_runs_and_sequences_against_recursion():
    r = random.Random(4)
    for _ in range(60):
        n, m = r.randint(1, 5), r.randint(1, 5)
        s = np.array([[r.choice([0.0, 0.3, 0.7, 1.0]) for _ in range(m)] for _ in range(n)])

        def best(i, j, s=s, n=n, m=m):
            return 0.0 if i == n or j == m else max(s[i, j] + best(i + 1, j + 1), best(i + 1, j), best(i, j + 1))

        found = kernels.align_runs(s)
        assert abs(sum(s[a, b] for a, b in found) - best(0, 0)) < 1e-4 * (n + m)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(found))
        x, y = ("".join(r.choice("AB") for _ in range(r.randint(0, 6))) for _ in "xy")

        def score(i, j, x=x, y=y):
            if i == len(x) or j == len(y):
                return -2 * (len(x) - i + len(y) - j)
            return max((2 if x[i] == y[j] else -1) + score(i + 1, j + 1), score(i + 1, j) - 2, score(i, j + 1) - 2)

        total, left, right = kernels.align_sequences(x, y)
        assert total == score(0, 0) and left.replace("-", "") == x and right.replace("-", "") == y
        assert total == sum(-2 if "-" in p else 2 if p[0] == p[1] else -1 for p in zip(left, right, strict=True))


def test_orientation(spark):
    """Spectra of a component are turned as a hidden choice says, whose edges score best the right way."""
    r = random.Random(5)
    turned = {n: r.random() < 0.5 for n in range(40)}
    rows = []
    for n in range(1, 40):
        for m in r.sample(range(n), min(n, 3)):
            same = turned[n] == turned[m]
            rows.append((m, n, 1.0 + r.random() if same else 0.5, 0.5 if same else 1.0 + r.random()))
    got = {x["node"]: x["reversed"] for x in sequencing.oriented(spark.createDataFrame(rows, "spec1 long, spec2 long, direct double, flipped double")).collect()}
    assert got == {n: turned[n] != turned[0] for n in turned}


def random_edges(r, nodes, n):
    ends = {tuple(sorted(r.sample(range(nodes), 2))) for _ in range(n)}
    return [(a, b, r.choice([0.1, 0.5, 0.9]), r.choice([0.2, 0.5]), float(r.randint(0, 6)), 0.0) for a, b in sorted(ends)]


def test_variant_limit_is_the_greedy_one(spark):
    r = random.Random(6)
    rows = random_edges(r, 12, 60)
    mass = {n: float(r.choice([100, 200, 300])) for n in range(12)}
    spectra = spark.createDataFrame(list(mass.items()), "spec_idx long, parent_mass double")
    for most in (0, 1, 2):
        count, want = {}, set()
        for a, b, s, t, _, _ in sorted(rows, key=lambda e: (-min(e[2], e[3]), -max(e[2], e[3]), e[0], e[1])):
            if count.get((a, mass[b]), 0) < most and count.get((b, mass[a]), 0) < most:
                count[a, mass[b]] = count.get((a, mass[b]), 0) + 1
                count[b, mass[a]] = count.get((b, mass[a]), 0) + 1
                want.add((a, b))
        got = graph.limit_per_variant(spark.createDataFrame(rows, E), spectra, most).collect()
        assert {(x["spec1"], x["spec2"]) for x in got} == want and len(got) == len(want)


def test_cover_is_the_greedy_one(spark):
    r = random.Random(7)
    rows = [(k, r.randint(0, 30), f"p{r.randint(0, 12)}") for k in range(120)]
    left = {}
    for _, s, p in rows:
        left.setdefault(p, set()).add(s)
    owner = {}
    while any(left.values()):
        best = min((p for p in left if left[p]), key=lambda p: (-len(left[p]), p))
        taken = left.pop(best)
        owner.update(dict.fromkeys(taken, best))
        left = {p: s - taken for p, s in left.items()}
    got = psms.parsimony(spark.createDataFrame(rows, "psm_id long, scan int, protein string")).collect()
    assert sorted(x["psm_id"] for x in got) == [k for k, s, p in rows if owner[s] == p]


def test_paths_and_triangles(spark):
    r = random.Random(8)
    rows = random_edges(r, 25, 60)
    near = {}
    for a, b, s, *_ in rows:
        near.setdefault(a, []).append((b, s))
        near.setdefault(b, []).append((a, s))
    best = {3: (0.0, 3), 11: (0.0, 11)}
    for _ in range(30):
        for a in list(best):
            for b, w in near.get(a, ()):
                way = (best[a][0] + w, best[a][1])
                if b not in best or (round(way[0], 9), way[1]) < (round(best[b][0], 9), best[b][1]):
                    best[b] = way
    got = graph.lightest_paths(spark.createDataFrame(rows, E), spark.createDataFrame([(3,), (11,)], "node long")).collect()
    assert {x["node"]: round(x["distance"], 6) for x in got} == {n: round(d, 6) for n, (d, _) in best.items()}
    shift = {(a, b): s for a, b, _, _, s, _ in rows}
    want = set()
    for a, b, c in itertools.combinations(range(25), 3):
        if all(p in shift for p in ((a, b), (b, c), (a, c))):
            x = sorted((shift[a, b], shift[b, c], shift[a, c]))
            if abs(x[2] - x[0] - x[1]) <= 1.0:
                want |= {(a, b), (b, c), (a, c)}
    assert {(x["spec1"], x["spec2"]) for x in graph.in_triangles(spark.createDataFrame(rows, E), 1.0).collect()} == want and want


def test_hubs_lose_nothing(spark):
    from peakweave.operators.hubs import hub_join

    left = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(300)], "k long, v long")
    right = left.groupBy("k").count().withColumn("name", F.concat(F.lit("n"), F.col("k").cast("string")))
    for most in (1, 20, 1000):
        got = hub_join(left, right, "k", "count", 300, most)
        assert got.columns == ["k", "v", "name"] and sorted(x["v"] for x in got.collect()) == list(range(300))
        assert all(x["name"] == f"n{x['k']}" for x in got.collect())
    from peakweave.operators.components import connected_components

    r = random.Random(3)
    ends = [(0, k) for k in range(1, 60)] + [(60 + k, 61 + k) for k in range(30)] + [(r.randint(100, 140), r.randint(100, 140)) for _ in range(30)]
    table = spark.createDataFrame(ends, "a long, b long")
    assert sorted(map(tuple, connected_components(table, hub_rows=5).collect())) == sorted(map(tuple, connected_components(table).collect()))


def test_substrings_of_every_length(spark):
    r = random.Random(9)
    seqs = {k: "".join(r.choice("AB") for _ in range(r.randint(0, 60))) for k in range(8)}
    peps = ["A", "AB", "BBA", "ABAB", "ABABA", "ABABABAB", "BABABABABAB", ""]
    got = proteins.substring_search(spark.createDataFrame(list(seqs.items()), "db_index int, sequence string"), spark.createDataFrame([(p,) for p in peps], "peptide string")).collect()
    want = [(p, k, i + 1) for p in peps if p for k, s in seqs.items() for i in range(len(s)) if s.startswith(p, i)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 1000, 30_000])
def test_running_sums(spark, n):
    x = np.random.default_rng(n).integers(0, 100, n).astype(float)
    got = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(arrays.running_sums(F.col("x")).alias("s")).first()["s"]
    assert np.allclose(got, np.cumsum(x))


def test_distribution_search_prefers_targets(spark):
    rows = catalogue.queries()["distribution_search"](spark, "/root/testdata/sf0.001").toPandas()
    best = rows.sort_values("score").groupby("query").tail(1)
    assert (best["query"] // 3 == best["entry"]).mean() > 0.9 and rows["score"].between(0, 1).all() and rows["cosine"].between(0, 1 + 1e-9).all()


def test_html_report_is_escaped(spark, tmp_path):
    sinks.html(spark.createDataFrame([(1, "<b>&"), (2, None)], "k int, name string"), str(tmp_path / "r"))
    page = spark.read.text(str(tmp_path / "r"), wholetext=True).first()["value"]
    assert "<td>1</td><td>&lt;b&gt;&amp;</td>" in page and page.startswith("<!DOCTYPE html>")


def test_peptide_positions_of_long_sequences(spark):
    s = "ACDEFGHIK" * 4000
    p = spark.createDataFrame([(s,)], "s string").select(peptide.prefix_masses(F.col("s"), plain=True).alias("p")).first()["p"]
    assert len(p) == len(s) and abs(p[-1] - sum(kernels.RESIDUES[c] for c in s)) < 1e-4


def test_trained_model_counts_losses():
    factors, shares, loss = distributions.model(_rows([{"band": 9, "bucket": 100, "n": 4}]), _rows([{"band": 9, "lost": 1, "kept": 3}]))
    assert loss[9] == 0.25 and abs(factors[9][5] - 2**0.02) < 1e-9 and shares[9][5] == 1 and np.allclose(shares.sum(1), 1)


class _rows(list):
    def collect(self):
        return self


def test_copies_of_proteins_meet_as_one(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ABC") for _ in range(rng.randint(0, 12))) for _ in range(12)] + [None]
    rows = [(k, texts[rng.randrange(13)]) for k in range(60)] + [(5, "ABCABCAB"), (7, texts[0])]
    got = proteins.homologues(spark.createDataFrame(rows, "db_index int, sequence string"), 3, 2)
    words: dict = {}
    for k, t in rows:
        words.setdefault(k, set()).update(t[i : i + 3] for i in range(len(t or "") - 2))
    want = {(a, b, len(words[a] & words[b])) for a in words for b in words if a < b and len(words[a] & words[b]) >= 2}
    assert got.count() == len(want) and {tuple(r) for r in got.collect()} == want


def test_equal_pairs_are_aligned_once(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    calls, real, taken = [], kernels.align_sequences, []
    monkeypatch.setattr(kernels, "align_sequences", lambda a, b, *x: calls.append((a, b)) or real(a, b, *x))
    pairs = spark.createDataFrame([(k, k + 1, "ACDE" if k % 2 else None, "ACE") for k in range(6)], "db_index1 int, db_index2 int, sequence1 string, sequence2 string")
    monkeypatch.setattr(type(pairs), "mapInArrow", lambda self, f, schema: taken.append(f) or self)
    proteins.aligned(pairs)
    table = pa.RecordBatch.from_pylist([r.asDict() for r in pairs.collect()])
    rows = [r for b in taken[0](iter([table, table])) for r in b.to_pylist()]
    assert len(rows) == 12 and len(calls) == 2 and {(r["row1"], r["row2"]) for r in rows} == {("ACDE", "AC-E"), ("---", "ACE")}


def _copied(spark, n=40):
    """n copies each of three spectra, two of which differ by 0.05 Dalton, their ids mixed."""
    kinds = [(100.0, [(10.0, 1.0), (20.0, 2.0)]), (100.05, [(10.0, 2.0), (30.0, 1.0)]), (300.0, [(10.0, 1.0)])]
    rows = [(3 * c + k, m, [(mz, i, 0.0) for mz, i in p]) for c in range(n) for k, (m, p) in enumerate(kinds)]
    return spark.createDataFrame(rows, "spec_idx long, parent_mass double, peaks array<struct<mz:double,intensity:double,tol:double>>")


def test_copies_of_spectra_meet_as_one_class(spark):
    s = _copied(spark)
    ids = [(r["spec_idx"], r["parent_mass"]) for r in s.collect()]
    want = sorted((a, b) for a, m in ids for b, k in ids if a < b and abs(m - k) <= 0.1)
    rows = pairs.classes(s, ["peaks"], most=50)
    met = pairs.class_pairs(rows, 0.1, ["peaks"])
    assert rows.count() == 3 and met.count() == 5  # 3,140 pairs
    assert sorted(tuple(r) for r in pairs.expanded(met).select("spec1", "spec2").collect()) == want
    assert sorted(tuple(r) for r in pairs.expanded(pairs.class_pairs(pairs.classes(s, ["peaks"], most=7), 0.1)).select("spec1", "spec2").collect()) == want
    plain = pairs.greedy_cosine(pairs.mass_pairs(s, 0.1, ["peaks"]), 0.5).select("spec1", "spec2", "cosine", F.least("matched1", "matched2"), "shift")
    got = pairs.cosine_network(s, 0.1, 0.5, 0.1, 1, least_peaks=1).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in plain.filter("cosine >= 0.1 AND matched >= 1").collect())


def test_network_pairs_are_scored_by_class(spark, monkeypatch):
    seen = []
    plain = pairs.greedy_cosine
    monkeypatch.setattr(pairs, "greedy_cosine", lambda p, *a, **k: seen.append(p.count()) or plain(p, *a, **k))
    assert pairs.cosine_network(_copied(spark, 20), 0.1, 0.5, 0.1, 1, least_peaks=1).count() == 40 * 39 // 2 + 20 * 19 // 2
    assert seen == [5]


def test_clusters_compare_copies_once(spark, monkeypatch):
    seen = []
    plain = pairs.similar
    monkeypatch.setattr(pairs, "similar", lambda p, *a, **k: seen.append(p.count()) or plain(p, *a, **k))
    got = {r["spec_idx"]: r["cluster_idx"] for r in clusters.cosine_clusters(_copied(spark, 20), 0.1, 0.5, 0.1, 1).collect()}
    assert got == {i: 2 if i % 3 == 2 else 0 for i in range(60)}
    assert seen == [3, 2]
    # equal spectra that don't link to each other stay apart
    apart = {r["cluster_idx"] for r in clusters.cosine_clusters(_copied(spark, 4), 0.1, 0.5, 0.1, 3).collect()}
    assert apart == set(range(12))


def test_stars_of_copies(spark):
    s = _copied(spark, 5).filter("spec_idx < 14")
    edges = pairs.mass_pairs(s, 0.1).select("spec1", "spec2", F.col("shift").alias("shift1"))
    rows = lambda df: sorted((r["spec_idx"], [(p["mz"], p["intensity"]) for p in r["peaks"]]) for r in df.collect())
    assert rows(sequencing.band_stars(s, 0.1, 0.5)) == rows(sequencing.stars(s, edges, 0.5))


def test_dot_bias_of_copies(spark):
    s = _copied(spark, 6).withColumnRenamed("parent_mass", "parent_mz").withColumn("q", F.col("spec_idx") % 2 == 0)
    v = pairs.binned(s.select("spec_idx", F.inline("peaks")), 5.0)
    want = library.dot_bias(library.scored_candidates(s.filter("q"), s.filter("NOT q"), 0.1, v, v), v, v).select("query", "entry", F.round("dot", 9), "bias")
    c = pairs.classes(s, ["peaks", "q"], "parent_mz").withColumn("node", F.get("members", F.lit(0)))
    found = library.biased_classes(c.filter("q"), c.filter("NOT q"), 0.1, v)
    assert found.count() == 5
    got = found.select(F.explode("members1").alias("query"), "members2", "dot", "bias").select("query", F.explode("members2").alias("entry"), F.round("dot", 9), "bias")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_distribution_search_reads_parts_once(spark):
    found = catalogue.queries()["distribution_search"](spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and not [f for f in found.inputFiles() if f.endswith("/part.parquet")]


def test_variants_of_copies_meet_at_the_end(spark):
    p = spark.createDataFrame([(i, "PEPTIDE" if i % 2 else "GASPK") for i in range(30)], "psm_id long, annotation string")
    db = spark.createDataFrame([(i, "GASPKPEPTIDEPEPTLDE" if i % 3 else "KKKK") for i in range(20)], "db_index int, sequence string")
    out = psms.variants(p, db)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Window ")  # rows are made above all that sorts or shuffles them
    rows = {(r["psm_id"], r["db_index"], r["start_aa"], r["end_aa"], r["region"]) for r in out.collect()}
    want = {(i, j, a, b, g) for i in range(30) for j in range(20) if j % 3 for a, b, g in ([(6, 12, 2), (13, 19, 3)] if i % 2 else [(1, 5, 1)])}
    assert rows == want and out.count() == len(want)


@pytest.mark.parametrize("most", [1, 4])
def test_unique_masses_in_rounds_as_one_by_one(spark, most):
    r = random.Random(5)
    ends = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(250)})
    rows = [(a, b, r.randrange(20) / 10, r.randrange(20) / 10) for a, b in ends]
    mass = {n: float(r.randrange(1, 9)) for n in range(40)}
    order = sorted(rows, key=lambda x: (-min(x[2:]), -max(x[2:]), x[:2]))
    keep = graph._unique_masses(*[[x[k] for x in order] for k in (0, 1)], *[[mass[x[k]] for x in order] for k in (0, 1)], most)
    e = spark.createDataFrame(rows, "spec1 long, spec2 long, score1 double, score2 double")
    got = graph.limit_unique_masses(e, spark.createDataFrame(list(mass.items()), "spec_idx long, parent_mass double"), most, few=0)
    assert {x[:2] for x in got.collect()} == {order[k][:2] for k in keep}


def test_best_shift_links_of_blocks_against_single_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 4)
    r = random.Random(3)
    rows = [(i, 400.0 + r.randrange(3000) / 10, sorted((float(r.randrange(900)), float(r.randrange(1, 9)), 0.0) for _ in range(r.randrange(1, 6)))) for i in range(70)]
    rows += [(70 + i, *rows[i][1:]) for i in range(5)]
    s = spark.createDataFrame(rows, "spec_idx long, parent_mass double, peaks array<struct<mz:double,intensity:double,tol:double>>")
    got = pairs.best_shift_links(s, 100.0, 3.0).collect()
    assert sorted((x["spec1"], x["spec2"]) for x in got if x["copy"]) == [(i, 70 + i) for i in range(5)]
    values = lambda found: sorted((x[0], x[1], *[round(v, 9) for v in x[2:6]]) for x in found)
    want = pairs.best_shift_pairs(s.filter("spec_idx < 70"), 100.0, 3.0).collect()
    assert len(want) > 100 and values(x for x in got if not x["copy"]) == values(want)


def test_best_shift_query_pairs_beyond_a_narrow_band(spark):
    found = catalogue.queries()["pair_best_shift"](spark, "/root/testdata/sf0.001")
    assert found.filter("abs(shift1) > 50").count() > 1000


def test_deviation_filter_of_ties_as_sql(spark):
    import duckdb

    from peakweave.operators import peaks
    from peakweave.plans import peak_queries

    r, rows = random.Random(1), []
    for k in range(400):
        a = r.randrange(90000, 5000000)
        b = a + 2 * r.randrange(1, 800000)
        tie = b + (b - a) // 2  # the mean and two deviations of a and b
        lows = [a, b, tie] + [tie + r.randrange(1, 100000) for _ in range(5)]
        rows += [(k, 0, j, float(j + 1), v / 100, 0.0) for j, v in enumerate(lows)]
    names = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?, ?, ?)", rows)
    want = con.execute(peak_queries.ORACLES["peaks_deviation_filter"]).fetchall()
    t = spark.createDataFrame(rows, names).selectExpr("l_orderkey AS spec_idx", "l_quantity * 40 AS mz", "l_extendedprice AS intensity")
    got = peaks.exploded(peaks.deviation_filter(peaks.gathered(t), 2.0)).select("spec_idx", "mz", "intensity").collect()
    assert sorted(tuple(x) for x in got) == sorted(want)
