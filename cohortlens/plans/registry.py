"""Registry of named queries: report/operator name -> Spark plan and SQL oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import stored_tables

MODULES = ["section1", "section2", "section3", "section4", "section5", "extras", "ops", "ingest_ops"]


def _load():
    spark_fns, sql = {}, {}
    for m in MODULES:
        mod = importlib.import_module(f"{__package__}.{m}")
        spark_fns.update(mod.SPARK)
        sql.update(mod.SQL)
    return spark_fns, sql


def reports() -> dict[str, Callable]:
    """name -> function(tables) -> DataFrame."""
    return _load()[0]


def tables_for(spark: SparkSession, sf_dir: str):
    """Canonical tables for ``sf_dir``: the materialised store (written once per input
    fingerprint under the shared checkpoint folder)."""
    return stored_tables(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """name -> function(spark, sf_dir) -> DataFrame over the bound test tables."""
    out = {}
    for name, fn in _load()[0].items():
        def run(spark, sf_dir, _fn=fn):
            return _fn(tables_for(spark, sf_dir))
        out[name] = run
    return out


def oracle_sql() -> dict[str, str]:
    return dict(_load()[1])
