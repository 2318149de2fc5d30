"""Operator 6: byte-level BPE encoding and decoding with segment trees.

Each pre-token is merged by a segment tree over its byte positions. A live position's leaf holds
rank * width + position of the pair that starts there, or a bound above all; the root is so the
leftmost pair of least rank. A merge writes the pair's token at its left position, kills the right one
and changes two leaves besides (the live neighbours), each a walk of log(width) nodes to the root.

Short pre-tokens, nearly all of any text, run many at once, one row of a matrix each; long ones run alone.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.llm.common import blocks, texts
from peakweave.llm.pretokens import Cache, word_finder
from peakweave.llm.token_counts import arrow_type

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens up to this many bytes are merged in matrices.
SHORT = 64
#: Rows of a matrix.
ROWS = 8192


class BytePairs:
    """Ranks of a vocabulary, as a table of mergeable pairs."""

    def __init__(self, path: str):
        import base64

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        get = self.ranks.get
        for t, r in self.ranks.items():
            for cut in range(1, len(t)):
                a, b = get(t[:cut]), get(t[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = r
        # the same pairs in an open table: probes step by one, at most half of it is taken
        bits = int(2 * len(self.pairs)).bit_length()
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int64)
        left_k = np.fromiter(self.pairs, np.int64, len(self.pairs))
        left_v = np.fromiter(self.pairs.values(), np.int64, len(self.pairs))
        slot = self._slot(left_k)
        self.probes = 0
        while len(left_k):
            self.probes += 1
            free = self.keys[slot] < 0
            taken, first = np.unique(slot[free], return_index=True)
            at = np.flatnonzero(free)[first]
            self.keys[taken], self.values[taken] = left_k[at], left_v[at]
            rest = np.ones(len(left_k), bool)
            rest[at] = False
            left_k, left_v, slot = left_k[rest], left_v[rest], (slot[rest] + 1) & self.mask
        self.bound = 1 << 20
        self.cache = Cache(self.encode_words)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or ``bound`` if it can't merge."""
        keys = a << 20 | b
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], self.bound)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    def encode_matrix(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of words of at most ``width`` bytes, a power of two."""
        n, stop = len(words), self.bound * width
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        size = np.fromiter(map(len, words), np.int64, n)
        ids = self.byte_ids[raw]
        at = np.arange(width)
        tree = np.full((n, 2 * width), stop, np.int64)
        rows, cols = np.nonzero(at[:-1] < size[:, None] - 1)
        r = self.rank(ids[rows, cols], ids[rows, cols + 1])
        tree[rows, width + cols] = np.where(r < self.bound, r * width + cols, stop)
        for level in range(width.bit_length() - 1):
            lo = width >> (level + 1)
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        live = at < size[:, None]
        # next and previous live position, width and -1 beyond the ends; one column of margin on either side
        after = np.tile(np.arange(1, width + 1), (n, 1))
        after[np.arange(n), size - 1] = width
        before = np.tile(np.arange(-1, width - 1), (n, 1))

        def put(who: np.ndarray, pos: np.ndarray, key: np.ndarray) -> None:
            node = width + pos
            tree[who, node] = key
            node >>= 1
            while node[0]:
                tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
                node >>= 1

        who = np.flatnonzero(tree[:, 1] < stop)
        while len(who):
            key = tree[who, 1]
            left = key % width
            ids[who, left] = key // width
            right = after[who, left]
            beyond = after[who, right]
            live[who, right] = False
            after[who, left] = beyond
            inner = beyond < width
            before[who[inner], beyond[inner]] = left[inner]
            put(who, right, np.full(len(who), stop))
            fresh = np.full(len(who), stop)
            w, p, q = who[inner], left[inner], beyond[inner]
            r = self.rank(ids[w, p], ids[w, q])
            fresh[inner] = np.where(r < self.bound, r * width + p, stop)
            put(who, left, fresh)
            prior = before[who, left]
            inner = prior >= 0
            w, p, q = who[inner], prior[inner], left[inner]
            if len(w):
                r = self.rank(ids[w, p], ids[w, q])
                put(w, p, np.where(r < self.bound, r * width + p, stop))
            who = who[tree[who, 1] < stop]
        ends = np.cumsum(live.sum(1)) * 4
        data = ids[live].astype("<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode_long(self, word: bytes) -> bytes:
        """Ids of one word of any length. Tree, ids and neighbours are arrays of 8 or 4 bytes an item, some 40 bytes a byte of the word."""
        n = len(word)
        width = 1 << max(1, (n - 1).bit_length())
        stop, pairs = self.bound * width, self.pairs
        start = self.byte_ids[np.frombuffer(word, np.uint8)]
        tree_ = np.full(2 * width, stop, np.int64)
        r = self.rank(start[:-1], start[1:])
        tree_[width : width + n - 1] = np.where(r < self.bound, r * width + np.arange(n - 1), stop)
        for level in range(width.bit_length() - 1, 0, -1):
            lo = 1 << (level - 1)
            tree_[lo : 2 * lo] = np.minimum(tree_[2 * lo : 4 * lo : 2], tree_[2 * lo + 1 : 4 * lo : 2])
        # memory views index faster than numpy arrays and hold no objects
        tree, ids = memoryview(tree_), memoryview(start.astype(np.int32))
        after, before = memoryview(np.arange(1, n + 1, dtype=np.int64)), memoryview(np.arange(-1, n - 1, dtype=np.int64))

        def put(pos: int, key: int) -> None:
            node = width + pos
            tree[node] = key
            while node > 1:
                other = tree[node ^ 1]
                if other < key:
                    key = other
                node >>= 1
                if tree[node] == key:
                    return
                tree[node] = key

        while tree[1] < stop:
            rank, left = divmod(tree[1], width)
            right = after[left]
            beyond = after[right]
            ids[left], ids[right] = rank, -1
            after[left] = beyond
            put(right, stop)
            r = None
            if beyond < n:
                before[beyond] = left
                r = pairs.get(rank << 20 | ids[beyond])
            put(left, stop if r is None else r * width + left)
            if (prior := before[left]) >= 0:
                r = pairs.get(ids[prior] << 20 | rank)
                put(prior, stop if r is None else r * width + prior)
        out = np.asarray(ids)
        return out[out >= 0].astype("<u4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token."""
        raw = [w.encode() for w in words]
        out: list[bytes] = [b""] * len(raw)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            if len(w) > SHORT:
                out[i] = self.encode_long(w)
            elif w:
                by_width.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, at in by_width.items():
            for k in range(0, len(at), ROWS):
                part = at[k : k + ROWS]
                for i, ids in zip(part, self.encode_matrix([raw[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def encode(self, words: list[str]) -> bytes:
        """Ids of a text from its pre-tokens."""
        return b"".join(map(self.cache.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def byte_pairs(vocabulary: str) -> BytePairs:
    """One table a worker."""
    import public_tokenizers

    return BytePairs(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))


def encoded_blocks(batches, pairs: BytePairs):
    """(ids of rows, texts, encodings) block by block."""
    find = word_finder()
    for keys, held in blocks(batches):
        words = [find(t) for t in held]
        pairs.cache.fill(set().union(*words))
        yield keys, held, [pairs.encode(w) for w in words]


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row: id_col and ids, an array of token ids.

    Null text encodes as empty: no ids; null ids stay null. A very long text is a block of its own. Repeated rows each get a
    row; an empty table gives an empty table; columns of other names are not read. Special strings are ordinary text.
    """

    def run(batches):
        pairs = byte_pairs(vocabulary)
        for keys, _, ids in encoded_blocks(batches, pairs):
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int64)
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keys, id_type), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)], names=["id", "ids"])

    source = texts(docs, id_col, text_col)
    id_type = arrow_type(source)
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row: id_col and data, the bytes that the ids stand for; null ids give empty bytes.

    An id that the vocabulary doesn't have is an error. Repeated rows each get a row; an empty table gives an empty table.
    """

    def run(batches):
        tokens = byte_pairs(vocabulary).tokens
        for b in batches:
            data = [b"".join(map(tokens.__getitem__, x.as_py() or ())) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["id", "data"])

    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, data binary").withColumnRenamed("id", id_col)


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row: id_col, n_tokens, ids_sha256, decoded_sha256, without shipping ids out of the worker.

    Null text counts as empty: no ids, the digests of nothing; null ids stay null. A very long text is a block of its own.
    Repeated rows each get a row; an empty table gives an empty table; columns of other names are not read.
    """

    def run(batches):
        pairs = byte_pairs(vocabulary)
        for keys, _, ids in encoded_blocks(batches, pairs):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, id_type), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(pairs.decode(x)).hexdigest() for x in ids])],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = texts(docs, id_col, text_col)
    id_type = arrow_type(source)
    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
