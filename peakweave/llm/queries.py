"""The registered query of each text operator, over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakweave.llm import bpe, html_text, licences, media, neighbours, packing, private_data, quality, simhash, token_counts
from peakweave.session import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; Python workers get this package."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    net = quality.fit(docs, labels.filter(~quality.held_out()))
    scored = quality.score(docs, net)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_data.private_data(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_term")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(read(spark, sf_dir, "documents"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents"))


_QUERIES = (op1_quality, op2_token_counts, op3_private_data, op4_html_text, op5_simhash, op6_bpe, op7_licences, op8_packing, op9_neighbours, op10_media)
_ORACLES: dict[str, str] = {"op7_licences": licences.oracle()}


def queries() -> dict:
    """Name -> callable(spark, sf_dir)."""
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL."""
    return dict(_ORACLES)
