"""Operator 2: token counts by pre-token.

Blocks of documents are cut into pre-tokens once: a block keeps its documents' pre-token frequencies, packed, and
lists its different pre-tokens. The lists are dealt into buckets by the pre-token's hash; a bucket counts the pieces of
each of its distinct pre-tokens once and joins the counts to the lists. Counts go back to the blocks, and each block sums
its documents' frequencies times counts. No sequence of ids is ever made, frequencies are never dealt by pre-token, and as
a block names a pre-token once, none is more than a small share of its bucket.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.llm.common import blocks, texts
from peakweave.llm.pretokens import lettered
from peakweave.session import written

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048


class PieceCounter:
    """Counts as the tokenizer file gives them: its added tokens first, then normaliser, pre-token pattern and model."""

    def __init__(self, vocabulary: str):
        import json

        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.normalize = self.tokenizer.normalizer.normalize_str

    def count(self, words: list[str]) -> list[int]:
        """Pieces of each pre-token."""
        tokenize = self.tokenizer.model.tokenize
        return [len(tokenize(lettered(w))) for w in words]

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """A text's pre-tokens with their frequencies, and the number of added tokens in it."""
        found = 0
        if any(a in text for a in self.added):
            parts = self.special.split(text)
            found = len(parts) - 1
        else:
            parts = (text,)
        out: Counter = Counter()
        for p in parts:
            out.update(self.pattern.findall(p.lower() if p.isascii() else self.normalize(p)))
        return out, found


@functools.lru_cache(maxsize=2)
def counter(vocabulary: str) -> PieceCounter:
    """One counter a worker."""
    return PieceCounter(vocabulary)


#: Characters of text in a block; a longer text is a block of its own.
BLOCK = 8 << 20
#: Pre-tokens of a bucket, on average, as the blocks list them.
BUCKET = 100_000


def packed(*numbers: np.ndarray, text: bytes = b"") -> bytes:
    """Deflated 32-bit integers, first all their lowest bytes, then the next, and bytes."""
    flat = np.concatenate(numbers).astype("<u4")
    planes = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T)
    return zlib.compress(len(flat).to_bytes(4, "little") + planes.tobytes() + text, 1)


def unpacked(data: bytes) -> tuple[np.ndarray, bytes]:
    """The integers and bytes of ``packed``."""
    raw = zlib.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(raw, np.uint8, 4 * n, 4).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4")[:, 0].astype(np.int64), raw[4 + 4 * n :]


def pretoken_frequencies(docs: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """A written table with one row a block: block, words (its different pre-tokens), ids, n_bytes and added (added tokens) of its documents, and packed.

    packed: for each document, how many of the block's words it has, then which (in rising order, as steps from one to the next), then how often each.
    """

    def run(batches):
        from pyspark import TaskContext

        c, base = counter(vocabulary), TaskContext.get().partitionId() << 32
        for k, (ids, held) in enumerate(blocks(batches, BLOCK)):
            place: dict[str, int] = {}
            added, parts = [], []
            for t in held:
                found, n = c.frequencies(t)
                added.append(n)
                parts.append((np.fromiter((place.setdefault(w, len(place)) for w in found), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))))
            size = np.array([len(p) for p, _ in parts])
            which, times = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
            order = np.lexsort((which, np.repeat(np.arange(len(size)), size)))
            which = which[order]
            first = (np.cumsum(size) - size)[size > 0]
            steps = np.diff(which, prepend=0)
            steps[first] = which[first]
            whole = lambda values, kind: pa.array([values], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + k]), whole(list(place), pa.string()), whole(ids, id_type), whole([len(t.encode()) for t in held], pa.int64()), whole(added, pa.int64()), pa.array([packed(size, steps, times[order])], pa.binary())],
                names=["block", "words", "ids", "n_bytes", "added", "packed"],
            )

    source = texts(docs, id_col, text_col)
    id_type = arrow_type(source)
    return written(source.mapInArrow(run, f"block long, words array<string>, ids array<{source.schema['id'].dataType.simpleString()}>, n_bytes array<long>, added array<long>, packed binary"), "pre-tokens")


def piece_counts(rows: DataFrame, vocabulary: str, bucket: int = BUCKET) -> DataFrame:
    """of (a block) and counts, packed places in its list with the pieces there; a block has a row for each bucket that holds some of its words.

    rows: block and words, a list of different ones.
    """
    buckets = max(1, -(-(rows.agg(F.sum(F.size("words"))).first()[0] or 0) // bucket))

    def deal(batches):
        for b in batches:
            for block, words in zip(b.column("block").to_pylist(), b.column("words"), strict=True):
                raw = [w.encode() for w in words.as_py()]
                own = np.fromiter((zlib.crc32(w) for w in raw), np.int64, len(raw)) % buckets
                order = np.argsort(own, kind="stable")
                found, first = np.unique(own[order], return_index=True)
                parts = np.split(order, first[1:]) if len(found) else []
                lists = [packed(p, np.array([len(raw[i]) for i in p.tolist()]), text=b"".join(raw[i] for i in p.tolist())) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(np.full(len(found), block)), pa.array(lists, pa.binary())], names=["bucket", "of", "words"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, known = counter(vocabulary), {}
        for b in batches:
            out = []
            for x in b.column("words").to_pylist():
                numbers, raw = unpacked(x)
                places, size = numbers.reshape(2, -1)
                words = [raw[e - k : e].decode() for e, k in zip(np.cumsum(size).tolist(), size.tolist(), strict=True)]
                fresh = [w for w in words if w not in known]
                known.update(zip(fresh, c.count(fresh), strict=True))
                out.append(packed(places, np.fromiter(map(known.__getitem__, words), np.int64, len(words))))
            yield pa.RecordBatch.from_arrays([b.column("of"), pa.array(out, pa.binary())], names=["of", "counts"])

    dealt = rows.select("block", "words").mapInArrow(deal, "bucket int, of long, words binary")
    return dealt.groupBy("bucket").applyInArrow(count, "of long, counts binary")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_tokens, over_limit.

    vocabulary: a file of the tokenizers library (a name among the public files, or a path). Null text
    counts as empty: 0 bytes, 0 tokens. A very long text is a block of its own. Repeated rows each get a row, null ids stay
    null, an empty table gives an empty table; columns of other names are not read. Special strings in a text
    count as their one token, as the library does by default.
    """
    rows = pretoken_frequencies(docs, id_col, text_col, vocabulary)
    kind = rows.schema["ids"].dataType.elementType.simpleString()

    def total(block: pa.Table, counts: pa.Table) -> pa.Table:
        ids, n_bytes, added = (block.column(c).combine_chunks().flatten() for c in ("ids", "n_bytes", "added"))
        found = [unpacked(x)[0].reshape(2, -1) for x in counts.column("counts").to_pylist()]
        pieces = np.zeros(sum(x.shape[1] for x in found), np.int64)
        for places, n in found:
            pieces[places] = n
        flat, _ = unpacked(block.column("packed")[0].as_py())
        size = flat[: len(ids)]
        steps, times = flat[len(ids) :].reshape(2, -1)
        run = np.concatenate([[0], np.cumsum(steps)])
        which = run[1:] - np.repeat(run[np.cumsum(size) - size], size)
        sums = np.concatenate([[0], np.cumsum(pieces[which] * times)])
        ends = np.cumsum(size)
        tokens = added.to_numpy() + sums[ends] - sums[ends - size]
        return pa.table([ids, n_bytes, pa.array(tokens), pa.array(tokens > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    both = rows.drop("words").groupBy("block").cogroup(piece_counts(rows, vocabulary).groupBy("of"))
    return both.applyInArrow(total, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", "over_limit")


def arrow_type(source: DataFrame):
    """The Arrow type of the id column."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(source.schema["id"].dataType)
