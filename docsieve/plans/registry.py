"""Registry of queries: each entry is a DataFrame builder and, where SQL can say the same, its SQL text."""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docsieve.session import ensure_checkpoint_dir

Builder = Callable[[SparkSession, str], DataFrame]

_BUILDERS: dict[str, Builder] = {}
_SQL: dict[str, str] = {}

_GROUPS = ("scans", "predicates", "mutations", "dedups", "unions", "merges", "scalars", "graphs", "functions", "streams")


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under ``name`` with its SQL counterpart."""

    def add(builder: Builder) -> Builder:
        if name in _BUILDERS:
            raise ValueError(f"query registered twice: {name}")
        _BUILDERS[name] = builder
        if sql is not None:
            _SQL[name] = sql
        return builder

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder, for queries that write and read back."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def load() -> tuple[dict[str, Builder], dict[str, str]]:
    for group in _GROUPS:
        importlib.import_module(f"docsieve.plans.{group}")
    return dict(_BUILDERS), dict(_SQL)
