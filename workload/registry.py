"""Registered queries: name -> Spark function, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimloom.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql.strip()
        return fn

    return add


class Tables:
    """The given tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def spread(self, name: str) -> DataFrame:
        """A table for CPU-heavy row work: small files are spread over all cores."""
        return spread(getattr(self, name))

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def load_all() -> None:
    import importlib

    for name in ("sources", "filters", "joins", "aggregates", "scalars", "jobs", "streams"):
        importlib.import_module(f"workload.{name}")
