import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from peakweave.llm import simhash


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abC Ä\n\x1f\u0085é🙂", max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_long_fingerprint():
    text = " ".join(f"w{i * i % 977}" for i in range(3000))
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=12), st.integers(0, 2**32), st.integers(1, 9), st.integers(1, 2))
def test_bit_slices(base, seed, radius, width):
    r = np.random.default_rng(seed)
    groups = []
    for n in r.integers(2, 90, 3):
        rows = r.choice(np.array(base, np.uint64), (n, width))
        for row in rows:
            for b in r.integers(0, 64, r.integers(0, radius + 2)):
                row[r.integers(width)] ^= np.uint64(1) << np.uint64(b)
        groups.append(rows)
    a, b = simhash.bit_sliced_links(groups, radius)
    got = sorted((min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True))
    want, first = [], 0
    for g in groups:
        want += [(first + i, first + j) for j in range(len(g)) for i in range(j) if sum(int(x ^ y).bit_count() for x, y in zip(g[i], g[j], strict=True)) <= radius]
        first += len(g)
    assert got == sorted(want)


def classes(fps, radius=2):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components_against_all_pairs(spark):
    r = np.random.default_rng(4)
    texts, n = [], 0
    for _ in range(40):
        words = [f"w{x}" for x in r.integers(0, 5000, 400)]
        for _ in range(r.integers(1, 6)):
            texts.append((n, " ".join(words)))
            n += 1
            words[r.integers(len(words))] = f"v{n}"
    docs = spark.createDataFrame([*texts, (n, ""), (n + 1, None), (n + 2, "one"), (n + 3, " \n")], "doc_id long, text string")
    want = classes({i: brute_fingerprint(t or "") for i, t in [(r["doc_id"], r["text"]) for r in docs.collect()]})
    for tile in (simhash.TILE,):
        got = simhash.near_duplicates(docs)
        assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want
    assert len(set(want.values())) < len(want)


def test_tiles_lose_no_link(spark):
    r = np.random.default_rng(5)
    base = int(r.integers(2**62))
    fps = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 63, (60, 2))}
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    from peakweave.operators.components import connected_components

    got = {x["node"]: x["component"] for x in connected_components(simhash.links(table, tile=7)).collect()}
    want = classes({f: f for f in fps})
    assert got == {k: v for k, v in want.items() if k in got}
    assert all(k in got or list(want.values()).count(want[k]) == 1 for k in want)


def test_similar_texts_and_clean_ones(spark, awkward):
    r = np.random.default_rng(6)
    texts = []
    for i in range(30):
        words = [f"w{x}" for x in r.integers(0, 3000, 300)]
        texts.append((10 * i, " ".join(words)))
        for k in range(1, 4):
            near = list(words)
            near[r.integers(300)] = "other"
            texts.append((10 * i + k, " ".join(near)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_classes(docs).collect()}
    assert got == {i: i // 10 * 10 for i, _ in texts}
    assert sorted(x["doc_id"] for x in simhash.one_of_each(docs).collect()) == [10 * i for i in range(30)]
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(x["doc_id"] or -1 for x in kept.collect()) == [-1, 1, 2, 4, 5, 7, 8]


def test_similarity_is_counted_on_the_sets(spark):
    r = np.random.default_rng(8)
    texts = []
    for k in range(60):  # families around one text each, with similarities on both sides of 0.8; some texts have few shingles
        words = [f"w{x}" for x in r.integers(0, 9000, 9 if k % 6 == 0 else r.integers(40, 400))]
        texts.append(" ".join(words))
        for _ in range(6):
            near = list(words)
            if k % 6 == 0:
                near = near[: r.integers(7, 10)]
            else:
                at = r.integers(0, len(words) - 1)
                near[at : at + round(len(words) * r.uniform(0.02, 0.25))] = [f"v{x}" for x in r.integers(0, 10**6, 3)]
            texts.append(" ".join(near))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    parent, pairs = list(range(len(texts))), []

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                pairs.append((j, i))
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    a, b = simhash.exact_links([simhash.shingle_set(t) for t in texts])
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(pairs)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_classes(docs).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    assert 60 < len(set(got.values())) < len(texts)


def test_awkward(awkward, nothing):
    got = simhash.near_duplicates(awkward)
    assert got.count() == awkward.count()
    by_id = {r["doc_id"]: r["component_id"] for r in got.collect()}
    assert by_id[2] == by_id[3] == by_id[6] == 2
    assert simhash.near_duplicates(nothing).count() == simhash.one_of_each(nothing).count() == 0
