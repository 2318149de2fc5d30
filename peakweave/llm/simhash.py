"""Operator 5: near duplicates by SimHash, compared in bit slices.

Copies collapse to one row a fingerprint. Fingerprints within the radius r agree, of r + 2 bands of bits,
in two at least; each pair of bands is a key, and fingerprints that share a key's bits are compared. The
comparison stores 64 fingerprints as 64 bit planes of one word each: a query's differing bits are added
lane by lane with carry-save counters, and a word is abandoned once all its lanes exceed the radius.
Links become components by star contraction.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.llm.common import texts
from peakweave.llm.token_counts import arrow_type
from peakweave.operators.components import connected_components
from peakweave.operators.hubs import hub_join
from peakweave.session import written

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints of one tile; a key with more is compared tile by tile, each pair of tiles a row of its own.
TILE = 4096


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the text's word shingles, repeats included: a bit is 1 if it is set in over half of their hashes."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = len(words) - shingle + 1
    hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    whole = n // 255 * 255
    total = np.add.reduce(bits[whole:], axis=0, dtype=np.int64)
    if whole:  # sums of 255 ones fit a byte
        total += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: id_col and fp, the fingerprint as a signed long. Null or wordless text has 0."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py() or "", shingle) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(id_type), pa.array(fps.view(np.int64))], names=["id", "fp"])

    source = texts(docs, id_col, text_col)
    id_type = arrow_type(source)
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


#: Groups up to this size are compared pair by pair, a lane for each pair; larger ones fingerprint by fingerprint, a lane for each partner.
PAIRWISE = 32
#: Pairs that are sliced together.
PAIRS = 1 << 14


def bit_sliced_links(groups: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within the radius in each group, each pair once, as positions in the groups laid end to end.

    A group is an array of unsigned 64-bit words, a row (of one or more words) for each fingerprint. Lanes would stay
    empty in words of small groups; their pairs fill words of their own.
    """
    size = np.array([len(g) for g in groups])
    start = np.cumsum(size) - size
    rows = np.concatenate(groups).reshape(int(size.sum()), -1)
    out = [_pair_lanes(rows, size[size <= PAIRWISE], start[size <= PAIRWISE], radius)]
    if (large := np.flatnonzero(size > PAIRWISE)).size:
        at = np.concatenate([np.arange(start[k], start[k] + size[k]) for k in large])
        a, b = _partner_lanes([groups[k] for k in large], radius)
        out.append((at[a], at[b]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _pair_lanes(rows: np.ndarray, size: np.ndarray, start: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of small groups: a bit plane holds one differing bit of 64 pairs a word."""
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(size).tolist():
        i, j = np.triu_indices(n, 1)
        base = start[size == n][:, None]
        first.append((base + i).reshape(-1))
        second.append((base + j).reshape(-1))
    first, second = np.concatenate(first), np.concatenate(second)
    exact = radius & (radius + 1) == 0
    keep = []
    for k in range(0, len(first), PAIRS):
        differ = rows[first[k : k + PAIRS]] ^ rows[second[k : k + PAIRS]]
        n = len(differ)
        bits = np.unpackbits(differ.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
        bits = np.pad(bits, ((0, -n % 64), (0, 0)), constant_values=1)  # lanes without a pair exceed any radius
        planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
        counters = [np.zeros(planes.shape[1], np.uint64) for _ in range(int(radius).bit_length())]
        over, word = np.zeros(planes.shape[1], np.uint64), np.arange(planes.shape[1])
        for p in range(len(planes)):
            carry = planes[p, word]
            for c in counters:
                was = c.copy()
                c ^= carry
                carry &= was
            over |= carry
            if p % 32 == 31:
                dead = over if exact else over | _above(counters, radius)
                alive = np.flatnonzero(dead != ~np.uint64(0))
                if len(alive) < len(word):
                    word, over, counters = word[alive], over[alive], [c[alive] for c in counters]
                if not len(word):
                    break
        within = ~(over if exact else over | _above(counters, radius))
        lanes = np.unpackbits(within.view(np.uint8).reshape(len(within), 8), axis=1, bitorder="little")
        w, lane = np.nonzero(lanes)
        hit = word[w] * 64 + lane
        keep.append(k + hit[hit < n])
    keep = np.concatenate(keep) if keep else np.zeros(0, np.int64)
    return first[keep], second[keep]


def _partner_lanes(groups: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of large groups: a bit plane holds one bit of 64 fingerprints a word, and each fingerprint meets the words from its own on."""
    size = np.array([len(g) for g in groups])
    rows = np.concatenate(groups).reshape(int(size.sum()), -1)
    width = rows.shape[1]
    words = -(-size // 64)
    first = np.cumsum(words) - words
    place = np.repeat(first * 64, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    lanes = np.zeros((int(words.sum()) * 64, width), np.uint64)
    lanes[place] = rows
    row_at = np.full(len(lanes), -1)
    row_at[place] = np.arange(len(rows))
    pack = lambda x: np.packbits(x.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    planes = [pack(((lanes[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(np.uint8)) for k in range(64 * width)]
    used = pack((row_at >= 0).astype(np.uint8))
    # a query meets the words from its own on
    own = place // 64
    meets = np.repeat(first + words, size) - own
    ones = ~np.uint64(0)
    exact = radius & (radius + 1) == 0  # then a carry out of the counters is what exceeds the radius
    out_a, out_b = [], []
    at, step = 0, 1 << 18
    bounds = np.cumsum(meets)
    while at < len(place):
        to = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + step, "right")))
        n = meets[at:to]
        query = np.repeat(np.arange(at, to), n)
        word = np.repeat(own[at:to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        lane = (place[query] % 64).astype(np.uint64)
        later = np.where(word == own[query], (ones << lane) << np.uint64(1), ones)
        over = ~(used[word] & later)
        counters = [np.zeros(len(query), np.uint64) for _ in range(int(radius).bit_length())]
        for k in range(64 * width):
            carry = planes[k][word] ^ (np.uint64(0) - ((rows[query, k // 64] >> np.uint64(k % 64)) & np.uint64(1)))
            for c in counters:
                was = c.copy()
                c ^= carry
                carry &= was
            over |= carry
            if k % 8 == 7:
                dead = over if exact else over | _above(counters, radius)
                keep = np.flatnonzero(dead != ones)
                if len(keep) < len(over):
                    query, word, over = query[keep], word[keep], over[keep]
                    counters = [c[keep] for c in counters]
                if not len(keep):
                    break
        within = ~(over if exact else over | _above(counters, radius))
        for i in range(64):
            hit = np.flatnonzero((within >> np.uint64(i)) & np.uint64(1))
            out_a.append(query[hit])
            out_b.append(row_at[word[hit] * 64 + i])
        at = to
    empty = np.zeros(0, np.int64)
    return np.concatenate(out_a or [empty]), np.concatenate(out_b or [empty])


def _above(counters: list[np.ndarray], limit: int) -> np.ndarray:
    """Lanes whose counter (lowest bit first) exceeds the limit."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for i in range(len(counters) - 1, -1, -1):
        if limit >> i & 1:
            equal = equal & counters[i]
        else:
            above = above | (equal & counters[i])
            equal = equal & ~counters[i]
    return above


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Fewest links that connect the same nodes: each node to the root that it reaches."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if parent[x] != x]
    return nodes, [root(x) for x in nodes]


def links(distinct_fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect all fingerprints within the radius, from a table of distinct ``fp``.

    Links found in one task are thinned to a spanning forest of the same nodes, so components are whole.
    """
    bands = radius + 2
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    masks = []
    for i, j in combinations(range(bands), 2):
        m = sum((1 << edges[k + 1]) - (1 << edges[k]) for k in (i, j))
        masks.append(m - (1 << 64) if m >> 63 else m)
    keys = F.array(*[F.struct(F.lit(n).alias("no"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for n, m in enumerate(masks)])
    keyed = distinct_fps.select("fp", F.explode(keys).alias("key")).select("fp", "key.no", "key.bits")
    shared = keyed.groupBy("no", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, own).alias("x"), F.greatest(t, own).alias("y")))
    dealt = keyed.join(shared, ["no", "bits"]).select("no", "bits", "fp", F.explode(pairs).alias("p"))
    groups = dealt.groupBy("no", "bits", "p").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")

    def run(batches):
        for b in batches:
            held, size = [], 0
            for fps in b.column(0):
                held.append(np.asarray(fps.values).view(np.uint64))
                size += len(held[-1])
                if size >= 1 << 14:
                    yield found(held)
                    held, size = [], 0
            if held:
                yield found(held)

    def found(held):
        flat = np.concatenate(held).view(np.int64)
        a, b = spanning(*(flat[x] for x in bit_sliced_links(held, radius)))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


#: For near copies by similarity: words of shingles, 64-bit words of a fingerprint, differing bits of candidates.
#: Shingle sets with a Jaccard similarity of 0.8 differ in 15 % of the bits on average, 77 of 512, give or take 8; sets of four
#: and five shingles in 19 %, 96 bits, give or take 9. The radius leaves five deviations above that.
WIDE_SHINGLE, WIDE_WORDS, WIDE_RADIUS = 5, 8, 140
#: Bytes of shingle hashes, and sets, of one tile when candidates are confirmed.
SET_BYTES, SET_TILE = 1 << 21, 512


def shingle_set(text: str, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """Distinct hashes of the text's word shingles in ascending order; of all words if there are no more than a shingle's. A wordless text has none."""
    from xxhash import xxh64_intdigest

    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(parts[i:] for i in range(shingle)), strict=False)) if len(parts) > shingle else [b" ".join(parts)]
    n = max(1, len(parts) - shingle + 1)
    return np.unique(np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, n))


def wide_marks(seed: np.ndarray, words: int = WIDE_WORDS) -> tuple[bytes, bytes]:
    """SimHash of 64 * words bits of a shingle set, and the low halves of the least hash in each word's mix (MinHash). An empty set has zeros.

    Each shingle's hash is mixed anew for every 64 bits.
    """
    if not len(seed):
        return bytes(8 * words), bytes(4 * words)
    total = np.zeros((words, 64), np.int64)
    least = np.full(words, ~np.uint64(0))
    mixes = (np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    for k in range(0, len(seed), 2040):
        some = seed[k : k + 2040]
        x = some + mixes
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        least = np.minimum(least, x.min(axis=1))
        bits = np.unpackbits(x.view(np.uint8).reshape(words, len(some), 8), axis=2, bitorder="little")
        for n in range(0, len(some), 255):  # sums of 255 ones fit a byte
            total += np.add.reduce(bits[:, n : n + 255], axis=1, dtype=np.uint8)
    return np.packbits((2 * total > len(seed)).reshape(-1), bitorder="little").tobytes(), least.astype(np.uint32).tobytes()


def wide_fingerprint(text: str, shingle: int = WIDE_SHINGLE, words: int = WIDE_WORDS) -> bytes:
    """SimHash of 64 * words bits. A wordless text has zeros."""
    return wide_marks(shingle_set(text, shingle), words)[0]


def exact_links(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (arrays without repeats) with a Jaccard similarity of 0.8 or more, each pair once. Common elements are counted, not estimated."""
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), size)[np.argsort(element, kind="stable")]
    held = np.bincount(element, minlength=1)
    first = np.cumsum(held) - held
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(sets)):
        mine = element[start[i] : start[i] + size[i]]
        mine = mine[held[mine] > 1]
        n = held[mine]
        at = np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(holders[at], minlength=len(sets))
        # common / (size + size - common) >= 4 / 5
        hit = np.flatnonzero((common > 0) & (9 * common >= 4 * (size + size[i])))
        hit = hit[hit > i]
        out_a.append(np.full(len(hit), i))
        out_b.append(hit)
    return np.concatenate(out_a), np.concatenate(out_b)


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, words: int = WIDE_WORDS, radius: int = WIDE_RADIUS, tile: int = TILE) -> DataFrame:
    """One row per input row: id_col, text_hash and component_id, the smallest id reachable over links between similar texts.

    Two texts link if their shingle sets have a Jaccard similarity of 0.8 or more, counted on the sets. Candidates share two of
    ``words`` least hashes, which pairs with a similarity of 0.8 do with a probability of 0.9999 (for eight), and their
    SimHashes, compared in bit slices, differ in ``radius`` bits at most. All sets that candidates connect are compared with each other.
    Null and wordless texts have no shingles and are one class. A null id counts for no class's id. Repeated rows each get a
    row; an empty table gives an empty table; other columns are not read.
    """

    def marks(batches):
        for b in batches:
            nodes, fps, minima = [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py() or "", shingle)
                fp, least = wide_marks(s, words)
                nodes.append(set_hash(s))
                fps.append(fp)
                minima.append(least)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(id_type), b.column(2), pa.array(nodes, pa.int64()), pa.array(fps, pa.binary()), pa.array(minima, pa.binary())], names=["id", "text_hash", "node", "fp", "minima"])

    source = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    id_type = arrow_type(source)
    kind = source.schema["id"].dataType.simpleString()
    marked = written(source.mapInArrow(marks, f"id {kind}, text_hash long, node long, fp binary, minima binary"), "wide-fingerprints")
    distinct = marked.groupBy("node").agg(F.min("id").alias("least"), F.min_by("text_hash", "id").alias("text_hash"), F.min("fp").alias("fp"), F.min("minima").alias("minima"), F.count(F.lit(1)).alias("copies"))
    least, total = written(distinct, "wide-distinct"), marked.count()
    least_hash = lambda i: F.substring("minima", 4 * i + 1, 4)
    keys = F.array(*[F.xxhash64(F.lit(n), least_hash(i), least_hash(j)) for n, (i, j) in enumerate(combinations(range(words), 2))])
    keyed = least.filter("least IS NOT NULL").select("node", F.explode(keys).alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "wide-keys")
    held = keyed.join(F.broadcast(shared), "key") if shared.count() <= BROADCAST_ROWS else hub_join(keyed, shared.withColumn("rows", F.col("n")), "key", "rows", total)
    held = written(held.select("key", "node", "n"), "wide-held")
    # keys with the same nodes are compared once: their number, and two hashes of all, tell sets of nodes apart
    alike = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("two"))
    tiled = alike.groupBy("n", "one", "two").agg(F.min("key").alias("key")).select("key", "n", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, own).alias("x"), F.greatest(t, own).alias("y")))
    dealt = hub_join(held.select("key", "node"), tiled, "key", "n", total).select("key", "node", F.explode(pairs).alias("p"))
    groups = dealt.join(least.select("node", "fp"), "node").groupBy("key", "p").agg(F.collect_list("node").alias("ids"), F.collect_list("fp").alias("fps")).filter(F.size("ids") > 1).select("ids", "fps")

    def found(ids, held):
        flat = np.concatenate(ids)
        a, b = spanning(*(flat[x] for x in bit_sliced_links(held, radius)))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def compare(batches):
        for b in batches:
            ids, held, size = [], [], 0
            for i, fps in zip(b.column(0), b.column(1), strict=True):
                ids.append(np.asarray(i.values))
                held.append(np.frombuffer(b"".join(fps.as_py()), np.uint64).reshape(-1, words))
                size += len(ids[-1])
                if size >= 1 << 14:
                    yield found(ids, held)
                    ids, held, size = [], [], 0
            if ids:
                yield found(ids, held)

    candidates = connected_components(groups.mapInArrow(compare, "a long, b long"))
    central = held.groupBy("node").agg(F.sum("n").alias("met"))
    joined = connected_components(_confirmed(source, least.join(central, "node"), candidates, shingle, total))
    member = least.join(joined, "node", "left").select("node", "least", "copies", F.coalesce("component", "node").alias("component"))
    ids = member.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    named = hub_join(member, ids, "component", "nodes", total).select("node", "copies", "component_id")
    return hub_join(marked.select("id", "text_hash", "node"), named, "node", "copies", total).select(F.col("id").alias(id_col), "text_hash", "component_id")


def set_hash(s: np.ndarray) -> int:
    """One signed 64-bit hash of a shingle set."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(s.tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def _confirmed(source: DataFrame, least: DataFrame, candidates: DataFrame, shingle: int, total: int) -> DataFrame:
    """(a, b): links that connect all similar sets of each component of candidates, from the texts that have their least ids.

    All sets of a component are first compared with that of its most central node (the one that met most others among the
    candidates). Those that link to it are of one class, so what is left to compare are pairs with one of the others. These are
    compared tile by tile, each pair of tiles a row of its own.
    """

    def sets_of(batches):
        seen: set[int] = set()  # repeated rows of a task count once
        for b in batches:
            rows = []
            for i, (node, text) in enumerate(zip(b.column("node").to_pylist(), b.column("text"), strict=True)):
                if node not in seen:
                    seen.add(node)
                    rows.append((i, shingle_set(text.as_py() or "", shingle).tobytes()))
            at = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("component", "node", "central")), pa.array([h for _, h in rows], pa.binary())], names=["component", "node", "central", "hashes"])

    wanted = least.join(candidates, "node").select("least", F.col("text_hash").alias("wanted_hash"), "node", "component", "met")
    first = wanted.groupBy("component").agg(F.max_by("node", F.struct("met", "node")).alias("central"), F.count(F.lit(1)).alias("nodes"))
    wanted = written(hub_join(wanted.drop("met"), first, "component", "nodes", total), "wide-candidates")
    small = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    members = source.join(small, (F.col("id") == F.col("least")) & (F.col("text_hash") == F.col("wanted_hash"))).select("component", "node", "central", "text")
    sets = written(members.mapInArrow(sets_of, "component long, node long, central long, hashes binary"), "wide-sets")

    def judge(batches):
        for b in batches:
            tied = []
            for mine, other in zip(b.column("hashes"), b.column("first"), strict=True):
                x, y = np.frombuffer(mine.as_py(), np.uint64), np.frombuffer(other.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                tied.append(9 * common >= 4 * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("component", "node", "central")), pa.array(tied, pa.bool_()), pa.array([len(h.as_py()) for h in b.column("hashes")], pa.int64())], names=["component", "node", "central", "tied", "bytes"])

    centre = sets.filter("node = central").groupBy("component").agg(F.min("hashes").alias("first"))
    counts = sets.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
    judged = hub_join(sets, centre.join(counts, "component"), "component", "nodes", total).select("component", "node", "central", "hashes", "first")
    judged = written(judged.mapInArrow(judge, "component long, node long, central long, tied boolean, bytes long"), "wide-judged")
    tiles = lambda which: F.ceil(F.greatest(F.sum(F.when(which, F.col("bytes"))) / SET_BYTES, F.count(F.when(which, 1)) / SET_TILE)).cast("int")
    shape = judged.groupBy("component").agg(F.coalesce(tiles(~F.col("tied")), F.lit(0)).alias("rest"), F.coalesce(tiles(F.col("tied")), F.lit(0)).alias("ties"), F.count(F.lit(1)).alias("nodes"))
    open_ = written(shape.filter("rest > 0"), "wide-open")
    known = hub_join(judged.select("component", "node", "tied").dropDuplicates(["component", "node"]), open_, "component", "nodes", total).select("node", "tied", "rest", "ties")
    number = lambda of: F.pmod(F.xxhash64("node"), of).cast("int")
    own = F.when(F.col("tied"), F.col("rest") + number(F.greatest("ties", F.lit(1)))).otherwise(number(F.greatest("rest", F.lit(1))))
    others = F.sequence(F.lit(0), F.col("rest") + F.when(F.col("tied"), 0).otherwise(F.col("ties")) - 1)
    pairs = F.transform(others, lambda t: F.struct(F.least(t, own).alias("x"), F.greatest(t, own).alias("y")))
    known = written(known.select("node", pairs.alias("pairs")), "wide-tiles")
    side = F.broadcast(known) if (known.agg(F.sum(F.size("pairs"))).first()[0] or 0) <= BROADCAST_ROWS else known
    dealt = sets.select("component", "node", "hashes").join(side, "node").select("component", "node", "hashes", F.explode("pairs").alias("p"))
    groups = dealt.groupBy("component", "p").agg(F.collect_list(F.struct("node", "hashes")).alias("sets")).filter(F.size("sets") > 1).select("sets")

    def confirm(batches):
        for b in batches:
            for group in b.column(0):
                nodes, at = np.unique(np.asarray(group.values.field("node")), return_index=True)
                hashes = group.values.field("hashes")
                a, c = spanning(*(nodes[x] for x in exact_links([np.frombuffer(hashes[int(i)].as_py(), np.uint64) for i in at])))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    ties = judged.filter("tied AND node <> central").select(F.col("node").alias("a"), F.col("central").alias("b"))
    return ties.union(groups.mapInArrow(confirm, "a long, b long"))


#: Rows up to which the list of copies is broadcast (16 bytes each); beyond, it is joined by a shuffle.
BROADCAST_ROWS = 250_000


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of the table without near copies: of each class the row with the smallest id stays, with all its columns.

    Of rows that repeat that id one stays. Rows with a null id all stay, unless a text like theirs has an id. Texts aren't
    shuffled as long as the list of copies is small enough to broadcast.
    """
    key, mark = (next(n for n in (name + "_" * k for k in range(1, 99)) if n not in docs.columns) for name in ("copy_id", "copy_hash"))
    classes = written(similar_classes(docs, id_col, text_col, **settings), "classes")
    copies = written(classes.filter(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(key), F.col("text_hash").alias(mark)).distinct(), "copies")
    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(mark))
    small = copies.count() <= BROADCAST_ROWS
    kept = docs.join(F.broadcast(copies) if small else copies, same, "left_anti")
    twice = classes.filter(F.col(id_col) == F.col("component_id")).groupBy(id_col).count().filter("count > 1").select(F.col(id_col).alias(key))
    twice = written(twice, "repeated-ids")
    n = twice.count()
    if not n:
        return kept
    twice = F.broadcast(twice) if n <= BROADCAST_ROWS else twice
    again = F.col(id_col) == F.col(key)
    return kept.join(twice, again, "left_anti").unionByName(kept.join(twice, again, "left_semi").dropDuplicates([id_col]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per input row: id_col, fp (signed long), component_id, the smallest id reachable over links.

    Null, empty and wordless texts have fingerprint 0 and link like any other; equal fingerprints
    always link. Rows with a null id count for no component's id (null where a component has no other).
    Repeated rows each get a row; an empty table gives an empty table; other columns are not read.
    """
    marked = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    least = written(marked.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("copies")), "distinct")
    total = marked.count()
    joined = connected_components(links(least.select("fp"), radius))
    member = least.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", "copies", F.coalesce("component", "fp").alias("component"))
    ids = member.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    named = hub_join(member, ids, "component", "nodes", total).select("fp", "copies", "component_id")
    return hub_join(marked, named, "fp", "copies", total).select(id_col, "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    """The fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
