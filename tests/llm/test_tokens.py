"""Token counts, byte-level BPE and packing against the libraries themselves."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from peakweave.llm import bpe, packing, token_counts


@pytest.fixture(scope="module")
def encoding():
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_match_library(awkward):
    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in awkward.collect())
    got = token_counts.token_counts(awkward, limit=100).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)


def test_counts_of_a_corpus(spark):
    """Several blocks and buckets, of which words are counted once each."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3)
    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = list(texts)
    want = {i: len(e.ids) for i, e in zip(ids, t.encode_batch([texts[i] for i in ids], add_special_tokens=False), strict=True)}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs).collect()} == want
    rows = spark.createDataFrame([(k, [f"w{(j * 7 + k) % 50}\0" for j in range(30)]) for k in range(9)], "block long, words array<string>")
    c = token_counts.counter(token_counts.VOCABULARY)
    got = {}
    for r in token_counts.piece_counts(rows, token_counts.VOCABULARY, bucket=20).collect():
        places, n = token_counts.unpacked(r["counts"])[0].reshape(2, -1).tolist()
        got.setdefault(r["of"], {}).update(zip(places, n, strict=True))
    for r in rows.collect():
        assert got[r["block"]] == dict(enumerate(c.count(r["words"])))


def test_round_trip_matches_library(awkward, encoding):
    want = sorted((r["doc_id"] or -1, *digests(encoding.encode_ordinary(r["text"] or ""), r["text"] or "")) for r in awkward.collect())
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.bpe_round_trip(awkward).collect()) == want


def digests(ids, text):
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_ids_decode_to_text(awkward):
    encoded = bpe.bpe_encode(awkward.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    back = {r["doc_id"]: bytes(r["data"]).decode() for r in bpe.bpe_decode(encoded).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in awkward.collect() if r["doc_id"] is not None}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=90), min_size=1, max_size=20))
def test_trees_agree(words):
    pairs = bpe.byte_pairs(bpe.VOCABULARY)
    for w in words:
        alone = pairs.encode_long(w)
        assert pairs.decode(alone) == w
        if len(w) <= bpe.SHORT:
            assert pairs.encode_matrix([w], max(2, 1 << (len(w) - 1).bit_length())) == [alone]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text(encoding, text):
    pairs = bpe.byte_pairs(bpe.VOCABULARY)
    words = bpe.word_finder()(text)
    pairs.cache.fill(set(words))
    assert np.frombuffer(pairs.encode(words), "<u4").tolist() == encoding.encode_ordinary(text)


def test_packing(awkward):
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    capacity = 128
    got = packing.pack_documents(awkward, capacity=capacity).collect()
    texts = {(r["doc_id"], r["text"] or "") for r in awkward.collect()}
    for doc_id, text in texts:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        mine = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == doc_id})
        first = len(ids) % capacity or min(capacity, len(ids))
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        assert mine == [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    assert len([r for r in got if r["doc_id"] == 1]) == 2


def brute_sum_of_squares(sizes, capacity, weigh_new):
    gaps, out = [], []
    square = lambda g: sum(g.count(x) ** 2 for x in set(g) if x)
    for s in sizes:
        fits = [(square(gaps[:i] + [g - s] + gaps[i + 1 :]), g, i) for i, g in enumerate(gaps) if g >= s]
        if weigh_new or not fits:
            fits.append((square([*gaps, capacity - s]), capacity, len(gaps)))
        best = min(fits)
        if best[1] == capacity:
            gaps.append(capacity)
        i = max(i for i, g in enumerate(gaps) if g == best[1])
        gaps[i] -= s
        out.append(square(gaps))
    return out


@pytest.mark.parametrize("weigh_new", [True, False])
@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=25))
def test_sum_of_squares_is_least(weigh_new, sizes):
    where, at = packing.sum_of_squares(np.array(sizes), 12, weigh_new)
    used, got = {}, []
    for s, w, a in zip(sizes, where.tolist(), at.tolist(), strict=True):
        assert used.get(w, 0) == a
        used[w] = a + s
        assert used[w] <= 12
        gaps = [12 - u for u in used.values()]
        got.append(sum(gaps.count(x) ** 2 for x in set(gaps) if x))
    assert got == brute_sum_of_squares(sizes, 12, weigh_new)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=25))
def test_packed_is_whole(sizes):
    where, at = packing.packed(np.array(sizes), 12)
    assert sorted(set(where.tolist())) == list(range(where.max() + 1))
    for w in set(where.tolist()):
        end = 0
        for a, s in sorted((a, s) for a, s, x in zip(at.tolist(), sizes, where.tolist(), strict=True) if x == w):
            assert a == end
            end += s
        assert end <= 12


def test_packs_tightly():
    sizes = np.random.default_rng(1).integers(1, 2049, 4000)
    where, _ = packing.packed(sizes, 2048)
    assert where.max() + 1 <= 1.006 * -(-sizes.sum() // 2048)


def test_packing_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = {packing.pack_documents(docs.repartition(n)).select("sequence_id").distinct().count() for n in (1, 16)}
    total = packing.pack_documents(docs).agg({"length": "sum"}).first()[0]
    assert max(counts) - min(counts) <= 1 and max(counts) <= -(-total // 2048) + 2


def test_long_pretoken(encoding):
    pairs = bpe.byte_pairs(bpe.VOCABULARY)
    word = ("abcdefgh" * 3 + "zzzzz") * 4000
    assert np.frombuffer(pairs.encode([word]), "<u4").tolist() == encoding.encode_ordinary(word) and word not in pairs.cache


def test_empty_tables(nothing):
    assert token_counts.token_counts(nothing).count() == bpe.bpe_round_trip(nothing).count() == packing.pack_documents(nothing).count() == 0
