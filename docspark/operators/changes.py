"""What changed between two versions of keyed rows, by a hash tree of buckets, documents and chunks.

A leaf is a chunk with the digest of what is encoded. The digest of a document sums up its leaves, that of a bucket
its documents, both whatever the order. Versions are compared from the top: only documents of buckets that differ
are looked at, only leaves of documents that differ are joined. Sums are made before the shuffle, so a document
with many chunks, or a bucket with many documents, gathers nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a leaf, and of a node.
LEAF = ("bucket", "source_path", "id", "digest")
NODE = ("n", "mixed", "total")
#: What can have happened to a chunk.
ADDED, CHANGED, KEPT, REMOVED = "added", "changed", "kept", "removed"


def leaves(rows: DataFrame, buckets: int, text: str = "document") -> DataFrame:
    """(bucket, source_path, id, digest) of rows (source_path, id, text, ...)."""
    bucket = F.pmod(F.xxhash64("source_path"), F.lit(buckets)).cast("int")
    return rows.select(bucket.alias("bucket"), "source_path", "id", F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"))


def _node(*parts: str) -> list[Column]:
    """Number, exclusive or and sum of the hashes of the parts; 128 bits tell versions apart."""
    return [
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*parts)).alias("mixed"),
        F.sum(F.shiftright(F.xxhash64(F.lit(1), *parts), 24)).alias("total"),
    ]


def document_nodes(leaf_rows: DataFrame) -> DataFrame:
    return leaf_rows.groupBy("bucket", "source_path").agg(*_node("id", "digest"))


def bucket_nodes(documents: DataFrame) -> DataFrame:
    return documents.groupBy("bucket").agg(*_node("source_path", *NODE))


def differing(now: DataFrame, before: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys of nodes that are not alike in both versions, or only in one."""
    old = before.select(*[F.col(c).alias(f"_{c}") for c in (*keys, *NODE)])
    same_key = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c == "source_path" else F.col(c) == F.col(f"_{c}") for c in keys]
    both = now.select(*keys, *NODE).join(old, same_key, "full")
    alike = F.lit(True)
    for c in NODE:
        alike = alike & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return both.where(~alike).select(*[F.coalesce(c, f"_{c}").alias(c) for c in keys])


def leaf_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(source_path, id, change) of every chunk of either version; both hold leaves of the same buckets.

    Leaves of documents that are alike are kept without being joined.
    """
    changed = differing(document_nodes(now), document_nodes(before), ("bucket", "source_path"))
    path = changed.select(F.col("source_path").alias("_path"))
    of_changed = F.col("source_path").eqNullSafe(F.col("_path"))
    quiet = now.join(path, of_changed, "left_anti").select("source_path", "id", F.lit(KEPT).alias("change"))
    new = now.join(path, of_changed, "left_semi").select("source_path", "id", "digest")
    old = before.join(path, of_changed, "left_semi").select(F.col("source_path").alias("_source"), F.col("id").alias("_id"), F.col("digest").alias("_digest"))
    both = new.join(old, F.col("id") == F.col("_id"), "full")
    change = (
        F.when(F.col("_id").isNull(), ADDED).when(F.col("id").isNull(), REMOVED)
        .when(F.col("digest") == F.col("_digest"), KEPT).otherwise(CHANGED)
    )
    return quiet.unionByName(both.select(F.coalesce("source_path", "_source").alias("source_path"), F.coalesce("id", "_id").alias("id"), change.alias("change")))


def index_changes(rows: DataFrame, stored: DataFrame, buckets: int = 256) -> DataFrame:
    """(source_path, id, change): what an index of `stored` rows needs to become one of `rows` (source_path, id, document).

    Buckets that are alike are not compared further.
    """
    now, before = leaves(rows, buckets), leaves(stored, buckets)
    open_ = differing(bucket_nodes(document_nodes(now)), bucket_nodes(document_nodes(before)), ("bucket",))
    open_ = F.broadcast(open_)  # at most the buckets
    alike = now.join(open_, "bucket", "left_anti").select("source_path", "id", F.lit(KEPT).alias("change"))
    return alike.unionByName(leaf_changes(now.join(open_, "bucket", "left_semi"), before.join(open_, "bucket", "left_semi")))
