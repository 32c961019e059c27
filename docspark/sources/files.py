"""Readers of raw and Markdown documents."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import paths
from docspark.session import local_path


def decode_utf8(content: Column) -> Column:
    """Bytes as UTF-8 text, invalid bytes dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def _files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    )
    local = F.regexp_replace("path", r"^file:/+", "/")
    # name and size are known without reading the content; empty files are skipped
    return found.where(F.col("path").rlike(suffix) & (F.col("length") > 0)).select(
        local.alias("source_path"), F.col("content")
    )


def read_raw(spark: SparkSession, root: str) -> DataFrame:
    """Raw documents below a folder, or one file: ``(source_path, raw)``."""
    files = _files(spark, root, paths.TEXT_SUFFIXES)
    return files.select("source_path", decode_utf8(F.col("content")).alias("raw"))


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """Markdown documents below a folder, or one file: ``(source_path, text)``."""
    files = _files(spark, root, paths.MARKDOWN_SUFFIX)
    name = F.col("source_path")
    return files.select(
        paths.normalise(name, paths.basename(name)).alias("source_path"),
        decode_utf8(F.col("content")).alias("text"),
    )


def write_texts(df: DataFrame, root: str, key: str, text: str) -> None:
    """A folder `key=value` for each value, with one file of its texts, a line end behind each.

    What `partitionBy(key).text(root)` writes. On a file system that tasks see as their own, they write the files
    themselves: Spark's writers take tens of milliseconds a file there, and its commit moves one after the other.
    A file comes into place whole, so a task may run twice.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    folder = local_path(df.sparkSession, root)
    if folder is None:
        df.select(text, key).repartition(key).write.partitionBy(key).text(root)
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((k, t) for b in batches for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True))
        for value, group in groupby(pairs, lambda pair: pair[0]):
            place = os.path.join(folder, f"{key}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}")
            os.makedirs(place, exist_ok=True)
            begun = os.path.join(place, f"_{uuid.uuid4().hex}")
            with open(begun, "wb") as out:
                out.writelines((t or "").encode() + b"\n" for _, t in group)
            os.replace(begun, os.path.join(place, "part-0.txt"))
            yield pa.RecordBatch.from_arrays([pa.array([value], pa.string())], names=["key"])

    os.makedirs(folder, exist_ok=True)
    done = rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key string")
    done.agg(F.count("*")).collect()


def spread(df: DataFrame) -> DataFrame:
    """Give every core some rows when an input has fewer splits than cores.

    Text work is narrow and heavy, so a few large splits would leave cores
    idle. Inputs with enough splits are left as they are.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism * 3
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
