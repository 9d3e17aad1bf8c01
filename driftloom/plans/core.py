"""Registration of queries, and the text that runs in Spark and in the SQL oracle alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftloom.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with SQL in which tables go by their names."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def plain(name: str, text: str, oracle: str | None = None) -> None:
    """Registers a query that is SQL itself; tables stand in braces. oracle: its other spelling, where dialects differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text})

    QUERIES[name] = run
    sql = oracle or text
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    SQL[name] = sql
