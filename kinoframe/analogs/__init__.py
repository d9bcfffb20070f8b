"""Test analogs: each operator family run on the driver's testdata tables.

Every analog reads whole tables from ``sf_dir`` (no id subsets, no row caps)
mapping from film tables to testdata tables.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate analog {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    # Importing the modules fills the registries.
    from kinoframe.analogs import (  # noqa: F401
        a_export,
        a_nest,
        a_merge,
        a_normalize,
        a_ingest,
        a_refresh,
        a_features,
        a_models,
        a_streams,
        a_scalar,
        a_film,
        a_batches,
        a_rows,
    )
