"""Query registry and table access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.sources.files import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its result gets plain types (see `plain`)."""

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: plain(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table for heavy narrow work: spread over the cores if it has few splits."""
    return spread(table(spark, sf, name))


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, doubles rounded to 6 digits."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint").alias(f.name)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # + 0.0 turns a negative zero into a plain one
            c = (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(f.name)
        out.append(c)
    return df.select(*out)


def widen(sql: str, columns: tuple[str, ...]) -> str:
    """The same rows with some whole-number columns as bigint."""
    casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({casts}) FROM ({sql})"
