"""Operator 1: quality by a convolutional network over bytes, in numpy.

A text is cut into overlapping chunks that cover it whole. Bytes become short vectors; learned filters
slide over each chunk, and each filter keeps its largest answer there (max pooling). A small layer turns
a chunk's answers into evidence, whose maximum and mean over all chunks give one probability.
Labels, languages, sources and ids are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.llm.common import texts
from peakweave.llm.token_counts import arrow_type

CHUNK, STEP = 256, 224
WIDTH, STRIDE, SIZE = 8, 2, 8
FILTERS, HIDDEN = 32, 16
#: Chunks that pass through the network together.
SLAB = 128
#: Labelled rows of each class that training takes at most, with their whole texts.
TRAIN_ROWS = 2500
#: Share of them that also yields a short example.
SHORT = 0.2
EPOCHS, BATCH, RATE = 8, 32, 0.003
THRESHOLD = 0.7


def chunks_of(text: bytes) -> np.ndarray:
    """(k, CHUNK) bytes that cover the text, the last padded with zeros; one chunk of zeros for an empty text."""
    k = 1 + max(0, -(-(len(text) - CHUNK) // STEP))
    flat = np.zeros((k - 1) * STEP + CHUNK, np.uint8)
    flat[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (k, CHUNK), (STEP, 1))


def filled(length: int) -> np.ndarray:
    """The share that a text of so many bytes fills of each of its chunks; the rest is padding."""
    k = 1 + max(0, -(-(length - CHUNK) // STEP))
    return (np.minimum(length - np.arange(k) * STEP, CHUNK) / CHUNK).astype(np.float32)


def cut_up(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chunks of all texts, what each text fills of its own, and the number of chunks of each text."""
    parts = [chunks_of(t) for t in held]
    return np.concatenate(parts), np.concatenate([filled(len(t)) for t in held]), np.array([len(c) for c in parts])


def byte_vectors() -> np.ndarray:
    """The fixed vector of each byte: kinds of characters, and a random part that tells bytes apart."""
    b = np.arange(256)
    kinds = [(b >= 97) & (b <= 122), (b >= 65) & (b <= 90), (b == 32) | (b == 10), b >= 128]
    part = np.random.default_rng(7).normal(0, 0.5, (256, SIZE - len(kinds)))
    part[0] = 0
    return np.ascontiguousarray(np.concatenate([np.stack(kinds, 1), part], 1), np.float32)


@dataclass
class ByteNet:
    """Weights of the network. ``prior`` is used alone where training had not both classes."""

    vectors: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    prior: float | None = None

    @classmethod
    def fresh(cls, seed: int = 1, prior: float | None = None) -> ByteNet:
        r = np.random.default_rng(seed)
        f = lambda *s: r.normal(0, (2 / s[0]) ** 0.5, s).astype(np.float32)
        zero = lambda n: np.zeros(n, np.float32)
        return cls(byte_vectors(), f(WIDTH * SIZE, FILTERS), zero(FILTERS), f(FILTERS + 1, HIDDEN), zero(HIDDEN), f(2 * HIDDEN, 1)[:, 0], zero(1), prior)

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, places, WIDTH * SIZE), what the filters see."""
        e = self.vectors[chunks].reshape(len(chunks), CHUNK * SIZE)
        return np.lib.stride_tricks.as_strided(e, (len(chunks), (CHUNK - WIDTH) // STRIDE + 1, WIDTH * SIZE), (e.strides[0], STRIDE * SIZE * 4, 4))

    def pooled(self, chunks: np.ndarray, fills: np.ndarray) -> np.ndarray:
        """Each filter's largest answer in each chunk, rectified, and the share of the chunk that the text fills."""
        out = np.empty((len(chunks), FILTERS + 1), np.float32)
        out[:, FILTERS] = fills
        for k in range(0, len(chunks), SLAB):
            w = self.windows(chunks[k : k + SLAB])
            out[k : k + SLAB, :FILTERS] = np.maximum((w.reshape(-1, WIDTH * SIZE) @ self.filters).reshape(len(w), -1, FILTERS).max(1) + self.filter_bias, 0)
        return out

    def scores(self, held: list[bytes]) -> np.ndarray:
        """The probability of each text."""
        if self.prior is not None:
            return np.full(len(held), self.prior)
        out, at, size = np.empty(len(held)), 0, 0
        for i, t in enumerate(held):
            size += len(t) // STEP + 1
            if size >= 4096 or i == len(held) - 1:
                chunks, fills, count = cut_up(held[at : i + 1])
                h = np.maximum(self.pooled(chunks, fills) @ self.hidden + self.hidden_bias, 0)
                first = np.cumsum(count) - count
                z = np.concatenate([np.maximum.reduceat(h, first), np.add.reduceat(h, first) / count[:, None]], 1) @ self.out + self.out_bias
                out[at : i + 1] = 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(float)))
                at, size = i + 1, 0
        return out

    def train(self, held: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 3) -> None:
        """Cross entropy by Adam over whole texts; gradients go through each filter's largest answer only."""
        names = ("filters", "filter_bias", "hidden", "hidden_bias", "out", "out_bias")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        r, step = np.random.default_rng(seed), 0
        for epoch in range(epochs):
            order = r.permutation(len(held))
            now = rate * (1 - epoch / epochs) + rate / 20
            for k in range(0, len(order), BATCH):
                who = order[k : k + BATCH]
                g = self.gradients([held[i] for i in who], labels[who])
                step += 1
                for name, d in g.items():
                    m[name] += 0.1 * (d - m[name])
                    v[name] += 0.01 * (d * d - v[name])
                    w = getattr(self, name)
                    w -= (now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def gradients(self, held: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        chunks, fills, count = cut_up(held)
        doc, first = np.repeat(np.arange(len(held)), count), np.cumsum(count) - count
        z, at = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int64)
        slabs = [slice(k, k + SLAB) for k in range(0, len(chunks), SLAB)]
        for part in slabs:
            win = self.windows(chunks[part])
            answers = (win.reshape(-1, WIDTH * SIZE) @ self.filters).reshape(len(win), -1, FILTERS)
            at[part] = answers.argmax(1)
            z[part] = np.take_along_axis(answers, at[part][:, None, :], 1)[:, 0] + self.filter_bias
        a = np.concatenate([np.maximum(z, 0), fills[:, None]], 1)
        u = a @ self.hidden + self.hidden_bias
        h = np.maximum(u, 0)
        top = np.maximum.reduceat(h, first)
        mean = np.add.reduceat(h, first) / count[:, None]
        both = np.concatenate([top, mean], 1)
        p = 1 / (1 + np.exp(-np.clip(both @ self.out + self.out_bias, -30, 30)))
        d = ((p - y) / len(held)).astype(np.float32)
        d_both = d[:, None] * self.out
        is_top = h == top[doc]
        share = is_top / np.maximum(1, np.add.reduceat(is_top.astype(np.float32), first))[doc]
        d_h = d_both[doc, :HIDDEN] * share + d_both[doc, HIDDEN:] / count[doc][:, None]
        d_u = (d_h * (u > 0)).astype(np.float32)
        d_z = (d_u @ self.hidden[:FILTERS].T) * (z > 0)
        filters = np.zeros_like(self.filters)
        for part in slabs:  # what the largest answers saw, a slab at a time
            win = self.windows(chunks[part])
            filters += np.einsum("nf,nfk->kf", d_z[part], win[np.arange(len(win))[:, None], at[part]], optimize=True)
        return {"filters": filters, "filter_bias": d_z.sum(0), "hidden": a.T @ d_u, "hidden_bias": d_u.sum(0), "out": both.T @ d, "out_bias": d.sum(keepdims=True)}


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> tuple[list[bytes], np.ndarray, dict[int, int]]:
    """Whole texts and labels of at most ``per_class`` labelled rows of each class (those of least id hash), and the number of all labelled ids by class.

    Ids are chosen from the labels alone; the bounded list is then broadcast to the one scan that finds their texts. Of repeated
    ids the least text counts.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    ids = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = texts(docs, id_col, text_col).join(F.broadcast(ids[0].union(ids[1])), "id").select("id", "text", "y")
    found = rows.groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y")).orderBy("id").toArrow()
    return [t.as_py().encode() for t in found.column("text")], found.column("y").to_numpy().astype(np.float32), sizes


def with_short(held: list[bytes], y: np.ndarray, share: float = SHORT, seed: int = 11) -> tuple[list[bytes], np.ndarray]:
    """The examples and, made from a share of them, short ones: the first 16 to 96 bytes of texts with label 1, the last of those with label 0.

    Few labelled texts are that short, and an almost empty chunk looks like a monotonous one to maxima alone.
    """
    r, more, labels = np.random.default_rng(seed), [], []
    for t, label in zip(held, y, strict=True):
        if r.random() < share:
            n = int(r.integers(16, 97))
            more.append(t[:n] if label else t[-n:])
            labels.append(label)
    return [*held, *more], np.concatenate([y, np.array(labels, np.float32)])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = TRAIN_ROWS) -> ByteNet:
    """A network trained on the driver on a bounded sample: the whole texts of ``per_class`` labelled rows a class.

    Training sees both classes about equally often; the last bias then moves by the log-odds that the labels as a whole have
    beyond that, so that scores are probabilities among documents like the labelled ones. With one class only (or no labelled text at all) the model is that constant (0.5 without any).
    """
    held, y, sizes = training_rows(docs, labels, id_col, text_col, label_col, per_class)
    if len(set(y.tolist())) < 2:
        return ByteNet.fresh(prior=float(y[0]) if len(y) else 0.5)
    net = ByteNet.fresh()
    net.train(*with_short(held, y))
    net.out_bias += np.float32(np.log(sizes[1] / sizes[0]) - np.log(y.sum() / (1 - y).sum()))
    return net


def score(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col and score, from 0 to 1.

    Whole texts are scored, however long, some thousand chunks at a time; null text counts as empty, which is one chunk
    of zeros. Null ids stay null. Repeated rows each get a row; an empty table gives an empty table; other columns are not read.
    """

    def run(batches):
        for b in batches:
            p = net.scores([(t.as_py() or "").encode() for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(id_type), pa.array(p, pa.float64())], names=["id", "score"])

    source = texts(docs, id_col, text_col)
    id_type = arrow_type(source)
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, net: ByteNet, least: float, text_col: str = "text") -> DataFrame:
    """The rows whose text scores at least ``least``, with all their columns, whatever their names.

    Null text counts as empty. Repeated rows stay or go together; an empty table gives an empty table.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            p = net.scores([(t.as_py() or "").encode() for t in b.column(at)])
            yield b.filter(pa.array(p >= least))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that no training sees: crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2
