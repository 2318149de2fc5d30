"""Streams of spectra: an extension, as nothing here has a batch counterpart with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.operators.report import distinct_first


def filtered(spectra: DataFrame, least_peaks: int) -> DataFrame:
    """Row-wise filters run on streams as they are."""
    return spectra.filter(F.size("peaks") >= least_peaks)


def counts(events: DataFrame, time: str, window: str, late: str, *keys: str) -> DataFrame:
    """Rows per window and key; rows that come later than ``late`` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"))


def search_into(spectra: DataFrame, search, path: str, checkpoint: str):
    """Starts a query that searches each batch of spectra with ``search(batch)`` (query, dot, entry, ...) and appends the best hit of each."""
    def batch(rows: DataFrame, number: int) -> None:
        best = distinct_first(search(rows).withColumn("_o", -F.col("dot")), ["query"], ["_o", "entry"]).drop("_o")
        best.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return spectra.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
