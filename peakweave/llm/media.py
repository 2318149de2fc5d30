"""Operator 10: media columns over content-addressed tar shards.

A text's bytes, filled up with bytes 255 to rows of 576 samples, are stored as an 8-bit grey PNG image
(lossless). Images go to tar shards in the shared folder, each named by the digest of its samples and stored
once however often the text occurs: texts that occur once are stored where they are read, the others are
brought together first. Rows carry digest, shard, offset and length. Header-only range reads (33 bytes)
fill the metadata columns; the columns on the samples come from a read of the whole image.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.llm.common import texts
from peakweave.operators.hubs import hub_join
from peakweave.session import scratch, written

#: Samples of a row of pixels.
ROW = 576
#: A shard is closed beyond this size.
SHARD_BYTES = 256 << 20
#: Bytes that hold a PNG's signature and header chunk.
HEADER = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    """The text's bytes, then bytes 255 up to a positive multiple of ROW."""
    return text + b"\xff" * (max(1, -(-len(text) // ROW)) * ROW - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """8-bit grey, ROW wide, unfiltered rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def from_png(image: bytes) -> bytes:
    """The samples of an image that ``to_png`` made; checksums are verified."""
    width, height, _ = read_header(image)
    at, data = 8, []
    while at < len(image):
        n = struct.unpack(">I", image[at : at + 4])[0]
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk of the image is damaged")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def file_system(folder: str):
    """pyarrow's file system for a folder, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1) if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1))


class ShardWriter:
    """Tar files of one task attempt; those of an attempt that failed are referred to by no row."""

    def __init__(self, folder: str, name: str, limit: int):
        self.fs, self.path = file_system(folder)
        self.fs.create_dir(self.path)
        self.name, self.limit, self.count, self.out, self.at = name, limit, 0, None, 0

    def put(self, digest: str, image: bytes) -> tuple[str, int, int]:
        """(shard, offset, length) of the image."""
        if self.out is None:
            self.shard = f"{self.name}-{self.count:04d}.tar"
            self.out, self.at = self.fs.open_output_stream(f"{self.path}/{self.shard}"), 0
            self.count += 1
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(image)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + image + bytes(-len(image) % 512))
        place = (self.shard, self.at + len(head), len(image))
        self.at += len(head) + len(image) + -len(image) % 512
        if self.at >= self.limit:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


_PLACE = ("n_bytes", "digest", "shard", "offset", "length")


def store(keyed: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes an image of each row's text, the last column, to shards in ``folder``: the other columns, n_bytes, digest, shard, offset, length.

    A written table, so that images of task attempts that failed are referred to by no row.
    """
    names = [*keyed.columns[:-1], *_PLACE]

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        out = ShardWriter(folder, f"{task.partitionId():06d}-{task.taskAttemptId()}", shard_bytes)
        for b in batches:
            rows = []
            for t in b.column(b.num_columns - 1):
                raw = (t.as_py() or "").encode()
                payload = payload_of(raw)
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((len(raw), digest, *out.put(digest, to_png(payload))))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)]], names=names)
        out.close()

    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keyed.schema.fields[:-1])
    return written(keyed.mapInArrow(run, f"{shape}n_bytes long, digest string, shard string, offset long, length long"), "media-places")


def _reads(places: DataFrame, folder: str, shape: str, look) -> DataFrame:
    """places with the columns of ``shape``, which ``look`` makes from a range reader, shard, offset and length."""
    names, kinds = zip(*[f.split() for f in shape.split(", ")], strict=True)
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}

    def run(batches):
        fs, path = file_system(folder)
        held: dict = {}

        def read(shard: str, offset: int, length: int) -> bytes:
            if shard not in held:
                for f in held.values():
                    f.close()
                held.clear()
                held[shard] = fs.open_input_file(f"{path}/{shard}")
            return held[shard].read_at(length, offset)

        for b in batches:
            rows = [look(read, *at) for at in zip(*[b.column(c).to_pylist() for c in ("shard", "offset", "length")], strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)]], names=[*b.schema.names, *names])

    before = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in places.schema.fields)
    return places.mapInArrow(run, before + shape)


def headers(places: DataFrame, folder: str) -> DataFrame:
    """places (shard, offset, length and any other columns) with width, height and depth, from range reads of HEADER bytes each."""
    return _reads(places, folder, "width int, height int, depth int", lambda read, shard, offset, length: read_header(read(shard, offset, HEADER)))


def contents(places: DataFrame, folder: str) -> DataFrame:
    """places with what the samples of the stored image say: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, samples.

    samples: their mean, and the shares of them below 64, 128, 192 and 256.
    """

    def look(read, shard: str, offset: int, length: int) -> tuple:
        image = read(shard, offset, length)
        payload = from_png(image)
        sample = np.frombuffer(payload, np.uint8)
        shares = np.bincount(sample >> 6, minlength=4) / len(sample)
        samples = f"mean={sample.mean():.4f};" + ",".join(f"{x:.4f}" for x in shares)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), samples

    return _reads(places, folder, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, samples string", look)


def features(places: DataFrame, folder: str) -> DataFrame:
    """places with the columns of ``headers`` and ``contents``, and feature, a string of the size and what the samples say."""
    out = contents(headers(places, folder), folder)
    return out.withColumn("feature", F.concat_ws(";", F.concat_ws("x", "width", "height", "depth"), "samples")).drop("samples")


#: Texts that occur more than once, up to which the list of their hashes (8 bytes each) is broadcast; beyond, all texts are brought together by digest.
BROADCAST_ROWS = 1_000_000


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """One row per input row: id_col, n_bytes, digest, shard, offset, length and the columns of ``features``. Equal texts have equal values.

    folder: where shards go, by default a new one in the shared folder. Null text counts as empty (one row of bytes 255); a very
    long text is one image. Repeated rows each get a row and share an image; null ids stay null; an empty table gives an empty
    table; columns of other names are not read.
    """
    folder = folder or scratch(docs.sparkSession, "media")
    source = texts(docs, id_col, text_col).select("id", F.xxhash64("text").alias("hash"), "text")
    twice = written(source.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "media-copies")
    if twice.count() <= BROADCAST_ROWS:
        alone = store(source.join(F.broadcast(twice), "hash", "left_anti").select("id", "text"), folder)
        several = source.join(F.broadcast(twice.select("hash")), "hash", "left_semi")
    else:
        alone, several = None, source
    several = several.select("id", F.sha2("text", 256).alias("content"), "text")
    stored = store(several.groupBy("content").agg(F.count(F.lit(1)).alias("copies"), F.min("text").alias("text")), folder)
    shared = hub_join(several.select("id", "content"), features(stored, folder), "content", "copies").drop("content")
    out = shared if alone is None else features(alone, folder).unionByName(shared)
    return out.withColumnRenamed("id", id_col)
