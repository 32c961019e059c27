"""Stored tables: knowledge base, gold questions, result log, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark import schemas
from docspark.operators.stats import PRODUCTION
from docspark.sources import store
from docspark.sources.store import BUCKETS, align_schema


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored table with the columns of `schema`; older files may lack some."""
    return align_schema(spark.read.option("mergeSchema", "true").parquet(path), schema)


def write_kb(
    documents: DataFrame, chunks: DataFrame, path: str, keys: DataFrame | None = None, buckets: int = BUCKETS
) -> None:
    """Documents and chunks in place of the stored ones of the same paths, published as one.

    `keys` (source_path) names the paths that are replaced if some of them have no document any more.
    """
    incoming = documents.select("source_path") if keys is None else keys.select("source_path")
    parts = {"documents": (documents, schemas.DOCUMENTS), "chunks": (chunks, schemas.CHUNKS)}
    store.replace(path, parts, incoming, "source_path", buckets)


def read_kb(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (
        store.read(spark, path, "documents", schemas.DOCUMENTS),
        store.read(spark, path, "chunks", schemas.CHUNKS),
    )


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions: a JSON array, or one object per line."""
    head = spark.read.text(path).where("trim(value) <> ''").first()
    is_array = head is not None and head["value"].lstrip().startswith("[")
    raw = spark.read.option("multiLine", str(is_array).lower()).schema(schemas.GOLD).json(path)
    if raw.where("id is not null").isEmpty():
        raise ValueError("gold table needs an id column")
    return raw


def write_gold(gold: DataFrame, path: str) -> None:
    """One JSON object per line, text as it is."""
    gold.write.mode("overwrite").json(path)


def read_log(spark: SparkSession, path: str, schema: str = schemas.LOG, fmt: str = "csv") -> DataFrame:
    """Result log as `csv` with quoted line breaks, or as a table such as `parquet`.

    Columns are found by name, so an older log without variants can be read;
    its rows belong to the production variant. A CSV file is read by one task, as
    a line break may be part of a value; a large log belongs in Parquet, which is split.
    """
    if fmt == "csv":
        options = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}
        raw = spark.read.options(**options).csv(path)
    else:
        raw = spark.read.option("mergeSchema", "true").format(fmt).load(path)
    typed = align_schema(
        raw.select(
            *[
                (F.nullif(c, F.lit("")).alias(c) if fmt == "csv" else F.col(c))
                if c in raw.columns
                else F.lit(None).cast("string").alias(c)
                for c in T.StructType.fromDDL(schema).fieldNames()
            ]
        ),
        schema,
    )
    if "variacao_retrieval" in raw.columns:
        return typed
    return typed.withColumn("variacao_retrieval", F.lit(PRODUCTION))


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """CSV with a header and quoted line breaks, for logs and reports."""
    out = df.select(*columns) if columns else df
    flat = out.select(
        *[
            F.to_json(f.name).alias(f.name)
            if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
            else F.col(f.name)
            for f in out.schema.fields
        ]
    )
    flat.write.mode("overwrite").options(header="true", quote='"', escape='"').csv(path)


def write_log(log: DataFrame, path: str, fmt: str = "csv") -> None:
    """Result log, columns in their stored order: as `csv`, or as a table that many tasks can read (`parquet`)."""
    if fmt == "csv":
        write_csv(log, path, schemas.LOG_COLUMNS)
    else:
        log.select(*schemas.LOG_COLUMNS).write.mode("overwrite").format(fmt).save(path)


def write_report(df: DataFrame, folder: str, name: str, fmt: str = "csv") -> None:
    """One report table below a folder."""
    if fmt == "csv":
        write_csv(df, f"{folder}/{name}")
    else:
        df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")
