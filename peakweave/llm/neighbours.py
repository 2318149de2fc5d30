"""Operator 9: approximate nearest neighbours with an inverted multi-index.

Unit vectors are cut into halves, each quantised by its own centroids; a pair of centroids is a cell, and
every vector is filed in one. A query visits cells in the order of the summed distances of its halves to
the two centroids, by a heap that holds the next cell of each first centroid, until it has met a set share of all
entries; only these are ranked, by their true cosine in double precision. Entries are dealt into blocks by first
centroid and id, each once; a query's list of cells goes to the blocks that hold some, which stream the lists past
their entries, and only a block's best leave it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakweave.llm.token_counts import arrow_type
from peakweave.session import written

CENTROIDS = 1024
#: Rows that the centroids are fitted on at most, chosen by id hash.
FIT_ROWS = 20_000
#: Share of all entries that a query meets at least.
SHARE = 0.2
#: Groups of first centroids, and entries of a block; a group with more is dealt into several by id.
GROUPS, ENTRY_BLOCK = 64, 50_000
#: Queries whose cells one task lists.
PROBES = 128


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def fit_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means; an empty cluster takes the row farthest from its centroid."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    c = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    square = (x * x).sum(1)[:, None]
    for _ in range(rounds):
        d = square - 2 * x @ c.T + (c * c).sum(1)
        own = d.argmin(1)
        n, total = np.bincount(own, minlength=k), np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[d.min(1).argmax()])
    return c


class MultiIndex:
    """Centroids of both halves."""

    def __init__(self, x: np.ndarray, k: int):
        self.dim, self.cut = x.shape[1], x.shape[1] // 2
        u = unit(x)
        self.first, self.second = fit_centroids(u[:, : self.cut], k), fit_centroids(u[:, self.cut :], k)

    def distances(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = u[:, : self.cut], u[:, self.cut :]
        f = lambda x, c: np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1))
        return f(a, self.first), f(b, self.second)

    def cells(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d1, d2 = self.distances(u)
        return d1.argmin(1), d2.argmin(1)

    def visit(self, d1: np.ndarray, d2: np.ndarray, count: np.ndarray, wanted: int) -> np.ndarray:
        """The numbers (first * second centroids + second) of the cells met in the order of d1 + d2 until they hold ``wanted`` entries; empty cells left out."""
        order = np.argsort(d2, kind="stable")
        rows, ranks = np.nonzero(count[:, order])  # each row's cells by distance
        size, cell = count[rows, order[ranks]].tolist(), rows * len(d2) + order[ranks]
        distance = (d1[rows] + d2[order[ranks]]).tolist()
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])).tolist()
        last = [*(i - 1 for i in first[1:]), len(rows) - 1]
        heap = [(distance[i], i, end) for i, end in zip(first, last, strict=True)]
        heapq.heapify(heap)
        out, met = [], 0
        while heap and met < wanted:
            _, i, end = heap[0]
            out.append(i)
            met += size[i]
            if i < end:
                heapq.heapreplace(heap, (distance[i + 1], i + 1, end))
            else:
                heapq.heappop(heap)
        return cell[out]


def usable(vectors: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values (double) of the vectors that take part: of the length ``dim``, finite, not zero.

    Values are scaled by a power of two, so that the largest lies between a half and 1; no cosine changes by that.
    """
    keep, rows = [], []
    for i, v in enumerate(vectors):
        if v.is_valid and len(v) and (dim is None or len(v) == dim) and not v.values.null_count:
            x = v.values.to_numpy().astype(np.float64)
            if np.isfinite(x).all() and x.any():
                keep.append(i)
                rows.append(np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])))
    return np.array(keep, np.int64), np.array(rows).reshape(len(rows), -1) if rows else np.zeros((0, dim or 0))


class Block:
    """Entries of one block: ids, vectors and cells, without repeats of an (id, vector)."""

    def __init__(self, dim: int):
        self.dim, self.seen = dim, {}

    def add(self, ids: list, vectors: list[bytes], cells: list[int]) -> None:
        self.seen.update(zip(zip(ids, vectors, strict=True), cells, strict=True))

    def close(self) -> None:
        """From now on queries come: entries are put in the order of their cells."""
        cells = np.fromiter(self.seen.values(), np.int64, len(self.seen))
        order = np.argsort(cells, kind="stable")
        held = list(self.seen)
        self.ids = np.array([held[i][0] for i in order])
        self.vectors = np.frombuffer(b"".join(held[i][1] for i in order), np.float64).reshape(-1, self.dim)
        self.cells, self.size = np.unique(cells, return_counts=True)
        self.start = np.cumsum(self.size) - self.size
        self.norm, self.unit = np.linalg.norm(self.vectors, axis=1), unit(self.vectors)
        # an id can be here with several vectors
        self.repeats = int(np.unique(self.ids, return_counts=True)[1].max()) if len(self.ids) else 1
        self.seen = {}

    def nearest(self, query_id, query: np.ndarray, cells: np.ndarray, k: int) -> list[tuple]:
        """(id, cosine) of the k nearest entries of the cells, nearest first, ties to the smaller id."""
        at = np.searchsorted(self.cells, cells)
        at = at[(at < len(self.cells)) & (self.cells[np.minimum(at, len(self.cells) - 1)] == cells)] if len(self.cells) else at[:0]
        size = self.size[at]
        met = np.repeat(self.start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        met = met[self.ids[met] != query_id]
        rough, most = self.unit[met] @ query, k * self.repeats
        if len(met) > most:
            met = met[rough >= np.partition(rough, len(rough) - most)[len(rough) - most] - 1e-9 * np.linalg.norm(query)]
        exact = (self.vectors[met] * query).sum(1) / (self.norm[met] * np.linalg.norm(query))
        found: dict = {}
        for j in np.lexsort((self.ids[met], -exact)).tolist():
            if len(found) == k:
                break
            found.setdefault(self.ids[met[j]], exact[j])
        return list(found.items())


def nearest_neighbours(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, centroids: int = CENTROIDS, share: float = SHARE, fit_rows: int = FIT_ROWS, entry_block: int = ENTRY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row that ``is_query`` (a condition on the table) selects.

    Nearness is the cosine of the original vectors in double precision; ties go to the smaller id. A row is
    no candidate of its own query, nor are rows that repeat its id; of repeated ids one result stays, and of a repeated
    query id the least vector asks. A query meets ``share`` of all entries, and 10 * (k + 1) at least, so that with fewer than
    k candidates all are returned. Vectors that are null, empty, zero, not finite, or of another length than most of the
    fitted rows take no part; null ids neither. An empty table gives an empty table. Columns of other names are not read.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query")).filter("id IS NOT NULL AND vector IS NOT NULL")
    id_type, kind = arrow_type(source), source.schema["id"].dataType.simpleString()
    shape = f"query_id {kind}, rank int, vec_id {kind}, score double"
    total = source.count()
    sample = source.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < (1 << 20) * min(1.0, 1.5 * fit_rows / max(1, total))).select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(fit_rows).toArrow()
    lengths = [len(v) for v in sample.column("vector").combine_chunks() if v.is_valid and len(v)]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
    _, x = usable(sample.column("vector").combine_chunks(), dim) if dim else (None, np.zeros((0, 0)))
    if not len(x):
        return spark.createDataFrame([], shape)
    index = MultiIndex(x, centroids)
    wide, groups = len(index.second), min(GROUPS, len(index.first))

    def file(batches):
        for b in batches:
            keep, rows = usable(b.column(1), dim)
            c1, c2 = index.cells(unit(rows)) if len(keep) else (keep, keep)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array([r.tobytes() for r in rows], pa.binary()), b.column(2).take(pa.array(keep)), pa.array(c1 * wide + c2, pa.int32())], names=["id", "vec", "query", "cell"])

    entries = written(source.mapInArrow(file, f"id {kind}, vec binary, query boolean, cell int"), "multi-index")
    count = np.zeros((len(index.first), wide), np.int32)
    found = entries.select("cell", "id").distinct().groupBy("cell").agg(F.count(F.lit(1)).cast("int").alias("n")).toArrow()  # centroids squared rows at most, 8 bytes each
    count.reshape(-1)[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    wanted = max(10 * (k + 1), int(np.ceil(share * count.sum())))
    held = np.bincount(np.arange(len(index.first)) % groups, count.sum(1), groups)
    salts = np.maximum(1, np.ceil(held / entry_block)).astype(int)

    def probe(batches):
        for b in batches:
            if not b.num_rows:
                continue
            d1, d2 = index.distances(unit(np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(-1, dim)))
            for i in range(b.num_rows):
                cells = np.sort(index.visit(d1[i], d2[i], count, wanted))
                group = cells // wide % groups
                order = np.argsort(group, kind="stable")
                own, n = np.unique(group, return_counts=True)
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                at = pa.array(np.full(len(own), i))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(own, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(cells[order], pa.int32()))], names=["id", "vec", "part", "cells"])

    salt = lambda part: F.element_at(F.array(*[F.lit(int(s)) for s in salts]), part + 1)
    part = (F.floor(F.col("cell") / wide) % groups).cast("int")
    filed = entries.select("id", "vec", part.alias("part"), F.array("cell").alias("cells"), F.lit(0).alias("asks")).withColumn("salt", F.pmod(F.xxhash64("id", "vec"), salt(F.col("part"))).cast("int"))
    asked = entries.filter("query").groupBy("id").agg(F.min("vec").alias("vec"))
    tasks = min(10_000, -(-entries.filter("query").count() // PROBES) or 1)  # few rows, but much work on each
    probes = asked.repartition(tasks, "id").mapInArrow(probe, f"id {kind}, vec binary, part int, cells array<int>")
    probes = probes.select("*", F.lit(1).alias("asks"), F.explode(F.sequence(F.lit(0), salt(F.col("part")) - 1)).alias("salt"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, closed = Block(dim), False
        for b in batches:
            ids, vecs, cells, asks = b.column("id").to_pylist(), b.column("vec").to_pylist(), b.column("cells"), b.column("asks").to_numpy()
            n = int((asks == 0).sum())
            if n and (closed or asks[:n].any()):
                raise RuntimeError("entries must come before queries")
            block.add(ids[:n], vecs[:n], cells[:n].flatten().to_pylist())
            if n == len(asks):
                continue
            if not closed:
                block.close()
                closed = True
            rows = [(ids[i], *x) for i in range(n, len(ids)) for x in block.nearest(ids[i], np.frombuffer(vecs[i], np.float64), cells[i].values.to_numpy(), k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((id_type, id_type, pa.float64()))], names=["query_id", "vec_id", "score"])

    keys = ["part", "salt"]
    # dealt by block; sorted so that the entries of a block come first
    dealt = filed.unionByName(probes).select(*keys, "asks", "id", "vec", "cells").repartition(*keys).sortWithinPartitions(*keys, "asks")
    best = dealt.groupBy(*keys).applyInArrow(rank, f"query_id {kind}, vec_id {kind}, score double")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
