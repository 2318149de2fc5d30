"""What the text operators share: their two columns, and blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text that one block holds in memory at once, in bytes; a single longer text is a block of its own.
BLOCK_BYTES = 4 << 20


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, null texts as empty; other columns can have any name."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) lists with about ``limit`` characters each."""
    ids: list = []
    held: list[str] = []
    size = 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            t = t.as_py() or ""
            ids.append(i)
            held.append(t)
            size += len(t)
            if size >= limit:
                yield ids, held
                ids, held, size = [], [], 0
    if ids:
        yield ids, held
