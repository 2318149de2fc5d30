"""Operator 8: packing documents into sequences by sums of squares.

A document's pieces go to sequences so that the sum, over all residual gaps, of the squared
number of open sequences with that gap becomes smallest; a new sequence is one of the choices. Full pieces fill a sequence
each. Pieces are dealt into groups of about ``GROUP_PIECES`` whatever the files they come from, and a group is packed longest
pieces first. What its open sequences hold in the end, and for comparison all pieces, are placed by the same rule with a new
sequence only where no open one has room, and the fewest sequences count. A group so leaves a sequence or two unfilled.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.llm.common import blocks, texts
from peakweave.llm.pretokens import Cache, lettered, word_finder
from peakweave.llm.token_counts import arrow_type
from peakweave.session import written

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2048
END = 0
#: Pieces of a group, on average.
GROUP_PIECES = 25_000


def sum_of_squares(sizes: np.ndarray, capacity: int, weigh_new: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each item, in the order given. Ties go to the fullest sequence, last to a new one.

    Putting size s where the gap is g changes the sum by 2(N[g-s] - N[g]) + 2 for g > s, and by 1 - 2N[s] for g = s, as a
    closed sequence has no gap; a new sequence changes it by 2N[capacity-s] + 1. Without ``weigh_new`` a new one is opened only
    where no open one has room.
    """
    n = len(sizes)
    where, at = np.empty(n, np.int64), np.empty(n, np.int64)
    count = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    far = np.int64(1) << 40
    # far where no sequence has the gap, else -count
    lack = np.full(capacity + 1, far, np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        best, gain = capacity, far
        if s < capacity:
            if weigh_new:
                gain = 2 * int(count[capacity - s]) + 1
            change = lack[s + 1 : capacity] + count[1 : capacity - s]
            if len(change):
                k = int(change.argmin())
                if change[k] < far // 2 and 2 * int(change[k]) + 2 <= gain:
                    best, gain = s + 1 + k, 2 * int(change[k]) + 2
            if count[s] and 1 - 2 * int(count[s]) <= gain:
                best = s
        if best == capacity:
            bin_, made = made, made + 1
        else:
            bin_ = open_[best].pop()
            count[best] -= 1
            lack[best] = -count[best] if count[best] else far
        where[i], at[i] = bin_, capacity - best
        if left := best - s:
            open_[left].append(bin_)
            count[left] += 1
            lack[left] = -count[left]
    return where, at


def packed(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each item, longest first by sums of squares: what takes fewest sequences of three ways.

    These are a new sequence as one of the choices; that, and then the items of open sequences placed once more, with a new
    sequence only where no open one has room; and all items so.
    """
    order = np.argsort(-sizes, kind="stable")
    where, at = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    where[order], at[order] = sum_of_squares(sizes[order], capacity)
    filled = np.bincount(where, sizes)
    loose = order[filled[where[order]] < capacity]
    if len(loose):
        w, a = sum_of_squares(sizes[loose], capacity, weigh_new=False)
        old = np.unique(where[loose])
        if w.max() + 1 < len(old):
            where[loose], at[loose] = old[w], a
    w, a = sum_of_squares(sizes[order], capacity, weigh_new=False)
    if w.max() + 1 < len(np.unique(where)):
        where[order], at[order] = w, a
    return np.unique(where, return_inverse=True)[1], at


class Encoder:
    """Ids by the tokenizers library, pre-token by pre-token; its added tokens are recognised as by default."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.added = {k: np.array([i], "<u4").tobytes() for k, i in added.items()}
        self.model, self.find = tokenizer.model, word_finder()
        self.cache = Cache(self.compute)

    def compute(self, words: list[str]) -> list[bytes]:
        tokenize = self.model.tokenize
        return [self.added.get(w) or np.array([t.id for t in tokenize(lettered(w))], "<u4").tobytes() for w in words]

    def words(self, text: str) -> list[str]:
        """Pre-tokens and added tokens in order."""
        if any(a in text for a in self.added):
            return [w for k, part in enumerate(self.special.split(text)) for w in ((part,) if k % 2 else self.find(part))]
        return self.find(text)

    def encode(self, held: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        self.cache.trim()
        get = self.cache.__getitem__
        return [b"".join(map(get, self.words(t))) for t in held]


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One encoder a worker."""
    return Encoder(vocabulary)


def pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int) -> DataFrame:
    """A written table of all pieces: id, piece, start, length, ids_crc32 and place, a number of the piece's own."""
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        enc, place = encoder(vocabulary), TaskContext.get().partitionId() << 40
        for keys, held in blocks(batches):
            rows = []
            for key, ids in zip(keys, enc.encode(held), strict=True):
                ids += end
                n = len(ids) // 4
                first = n % capacity or min(n, capacity)
                cuts = [0, *range(first, n + 1, capacity)]
                rows += [(key, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            kinds = (id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], pa.array(np.arange(place, place + len(rows)))], names=["id", "piece", "start", "length", "ids_crc32", "place"])
            place += len(rows)

    source = texts(docs, id_col, text_col)
    id_type = arrow_type(source)
    return written(source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, place long"), "pieces")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and one closing id 0. Longer than ``capacity``, it is cut into pieces of that
    length, of which the first may be shorter. Null text counts as empty: a piece of length 1; null ids stay null. A very long
    text is a block of its own, and its pieces go to all groups. Repeated rows are packed each; an empty table gives an empty
    table; columns of other names are not read.
    """
    found = pieces(docs, id_col, text_col, vocabulary, capacity)
    groups = max(1, -(-found.count() // group_pieces))

    def pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by("place")  # whatever the order in which a shuffle delivers them
        where, at = packed(rows.column("length").to_numpy(), capacity)
        out = rows.select(["id", "piece", "start", "length", "ids_crc32"])
        out = out.append_column("sequence_id", pa.array(where + (key[0].as_py() << 40))).append_column("offset", pa.array(at))
        yield from out.combine_chunks().to_batches()

    dealt = found.withColumn("part", F.pmod(F.xxhash64("place"), F.lit(groups)))
    shape = f"id {found.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("part").applyInArrow(pack, shape).withColumnRenamed("id", id_col)
