"""How a query is registered: its DataFrame and, where SQL expresses it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class Catalogue:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def register(f):
            n = name or f.__name__
            self.queries[n] = f
            if sql is not None:
                self.sql[n] = sql
            return f

        return register

    def select(self, name: str, dialect: str, sql: str | None = None) -> None:
        """A statement of the SELECT dialect; sql: what DuckDB runs, where that isn't the same text."""
        import re

        used = [t for t in TABLES if re.search(rf"\b{t}\b", dialect)]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from granary.operators.dialect import select

            for t in used:
                load(spark, sf_dir, t).createOrReplaceTempView(t)
            return select(spark, dialect)

        self.queries[name] = run
        self.sql[name] = sql or dialect


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
