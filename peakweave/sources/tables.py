"""Spectral views over the plain test tables: a fixed renaming of columns, so one SQL serves as oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: DuckDB and Spark read these alike. name -> SQL over the raw tables.
VIEWS = {
    "psms": """SELECT event_id AS psm_id, CAST(user_id AS INT) AS scan, event_type AS annotation, value AS score,
        event_type = 'error' AS is_decoy, CAST(event_id % 4 AS INT) AS charge, CAST(event_id % 7 AS INT) AS file_idx,
        concat('prot', CAST(user_id % 40 AS STRING)) AS protein FROM events""",
    "peaks": """SELECT l_orderkey AS spec_idx, round(l_quantity * 40 + l_discount * 100, 4) AS mz, l_extendedprice AS intensity,
        l_linenumber AS peak_no, l_partkey AS part_no FROM lineitem""",
    "spectra": """SELECT o_orderkey AS spec_idx, round(o_totalprice / 100, 4) AS parent_mass, o_custkey AS file_idx,
        CAST(substr(o_orderpriority, 1, 1) AS INT) AS charge, o_orderstatus AS frag_type FROM orders""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One raw table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One spectral view."""
    sql = VIEWS[name]
    raw = sql.rsplit("FROM ", 1)[1].strip()
    return spark.sql(sql.rsplit("FROM ", 1)[0] + "FROM {raw}", raw=table(spark, sf_dir, raw))


def with_views(sql: str, *names: str) -> str:
    """The oracle SQL with the named views in front."""
    heads = ", ".join(f"{n} AS ({VIEWS[n].replace('AS STRING', 'AS VARCHAR')})" for n in names)
    body = sql.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{heads}, {body[len(start):]}"
    return f"WITH {heads} {body}"
