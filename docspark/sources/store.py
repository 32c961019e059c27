"""Stored tables that change by key: one bucketed table per store, overwritten part by part.

All tables of a store are rows of one Parquet table, told apart by `kind`, each in a column of its own. The table is
partitioned by a hash of the key and bucketed by the key, so that a change is a dynamic partition overwrite of the
parts that its keys fall into, in one job for all tables, and joins on the key need no exchange of stored rows. The
folder is the table; a session registers it in its catalogue when it comes to it. One writer at a time.

Every part keeps a row without content for each table, so that a part whose rows are all gone is overwritten as well.
Files from before a column was added give null for it. A row with a null key stays until its part is written with
that key among the keys again, as nulls never match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.session import stage, unstage

#: Buckets of a new store, and of each part that is overwritten on its own: 8 parts by default.
BUCKETS = 64
_PART_BUCKETS = 8
_LAYOUT = "buckets int, parts int"
_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def align_schema(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Columns of `schema` in its order and types; missing ones are null."""
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def column(f: T.StructField) -> Column:
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        same = df.schema[f.name].dataType.simpleString() == f.dataType.simpleString()
        return F.col(f.name) if same else F.col(f.name).try_cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in target.fields])


def _nullable(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType))
    return T.MapType(_nullable(kind.keyType), _nullable(kind.valueType)) if isinstance(kind, T.MapType) else kind


def _struct(schema: str | T.StructType) -> T.StructType:
    """The schema as it is stored: a part may have no row, so every column can be null."""
    return _nullable(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _layout(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """Buckets and parts of a store, None if there is none."""
    try:
        row = spark.read.schema(_LAYOUT).json(f"{path}/layout").first()
    except AnalysisException:
        return None
    return (row["buckets"], row["parts"]) if row else None


def _table(spark: SparkSession, path: str, key: T.StructField, columns: list[T.StructField], buckets: int, new: bool = False) -> str:
    """Register the folder with these columns; the name of the table."""
    fields = T.StructType([T.StructField("_key", key.dataType), *columns]).toDDL()
    name = "docspark_" + hashlib.md5(f"{path}|{fields}|{buckets}".encode()).hexdigest()
    location = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({fields}, part int, kind string) USING parquet PARTITIONED BY (part, kind) "
        f"CLUSTERED BY (_key) SORTED BY (_key) INTO {buckets} BUCKETS LOCATION '{location}/rows'"
    )
    if not new:
        spark.catalog.recoverPartitions(name)  # what other sessions have written
        spark.catalog.refreshTable(name)
    return name


def read(
    spark: SparkSession, path: str, name: str, schema: str | T.StructType, key: str = "source_path", only: list[int] | None = None
) -> DataFrame:
    """A stored table, or its parts `only`; bucketed by its key."""
    target = _struct(schema)
    layout = _layout(spark, path)
    if layout is None:
        return spark.createDataFrame([], target)
    table = _table(spark, path, target[key], [T.StructField(name, target)], layout[0])
    rows = spark.table(table).where((F.col("kind") == name) & F.col(name).isNotNull())
    if only is not None:
        rows = rows.where(F.col("part").isin(only))
    return rows.select(*[F.col("_key").alias(key) if f.name == key else F.col(f"{name}.{f.name}") for f in target.fields])


@contextmanager
def _overwrite_mode(spark: SparkSession, mode: str) -> Iterator[None]:
    before = spark.conf.get(_OVERWRITE)
    spark.conf.set(_OVERWRITE, mode)  # a table takes it from the session only
    try:
        yield
    finally:
        spark.conf.set(_OVERWRITE, before)


def replace(
    path: str, tables: dict[str, tuple[DataFrame, str | T.StructType]], keys: DataFrame, key: str, buckets: int = BUCKETS
) -> None:
    """Put rows in place of all stored ones with a key of `keys`; a key without new rows is deleted.

    Only the parts of these keys are read and written. The new rows must not bring other keys. `buckets` counts
    for a new store.
    """
    spark = keys.sparkSession
    found = _layout(spark, path)
    buckets, parts = found or (buckets, max(1, buckets // _PART_BUCKETS))
    incoming = stage(keys.select(key).repartition(buckets, key).distinct())
    touched = [r[0] for r in incoming.select(_part(key, parts)).distinct().collect()]  # at most the parts
    schemas = {name: _struct(schema) for name, (_, schema) in tables.items()}
    key_field = next(iter(schemas.values()))[key]
    columns = [T.StructField(name, s) for name, s in schemas.items()]
    stored = T.StructType([T.StructField("_key", key_field.dataType), *columns, T.StructField("part", T.IntegerType()), T.StructField("kind", T.StringType())])
    gone = incoming.repartition(buckets, key)  # meets the stored rows in their buckets
    packed = spark.createDataFrame([(None, *[None] * len(columns), p, name) for p in touched for name in schemas], stored)
    for name, (rows, _) in tables.items():
        kept = read(spark, path, name, schemas[name], key, touched).join(gone, key, "left_anti")
        now = kept.unionByName(align_schema(rows, schemas[name]))
        whole = F.struct(*[F.col(f.name) for f in schemas[name].fields]).alias(name)
        of_kind = now.select(F.col(key).alias("_key"), whole, _part(key, parts).alias("part"), F.lit(name).alias("kind"))
        packed = packed.unionByName(of_kind, allowMissingColumns=True)
    # stored before they take their place: a table that is read can't be overwritten
    new = stage(packed)
    table = _table(spark, path, key_field, columns, buckets, found is None)
    # one task writes a bucket of a part, several where a hot key makes it large
    bucketed = new.withColumn("_bucket", F.pmod(F.hash("_key"), F.lit(buckets)))
    dealt = bucketed.hint("rebalance", "part", "_bucket").drop("_bucket")
    # a new store has no layout yet: whatever a writer that died has left there goes
    with _overwrite_mode(spark, "dynamic" if found else "static"):
        dealt.write.insertInto(table, overwrite=True)
    if found is None:
        spark.createDataFrame([(buckets, parts)], _LAYOUT).coalesce(1).write.mode("overwrite").json(f"{path}/layout")
    unstage(new, incoming)
