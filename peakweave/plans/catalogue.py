"""Every registered query over the spectral operators, with its SQL oracle."""

from __future__ import annotations

from peakweave.plans import fdr_queries, file_queries, network_queries, peak_queries, psm_queries, search_queries, sequencing_queries

_MODULES = (fdr_queries, file_queries, peak_queries, psm_queries, network_queries, search_queries, sequencing_queries)


def queries() -> dict:
    """Name -> callable(spark, sf_dir)."""
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    """Name -> DuckDB SQL over the same tables."""
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
