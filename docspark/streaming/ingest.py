"""Continuous ingestion: every micro-batch replaces the documents it brings.

The batch replacement by key, run per micro-batch. A repeated batch is harmless,
because it replaces what it brought before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docspark.operators import chunking, kb
from docspark.plans import flows
from docspark.session import stage, unstage
from docspark.sources import tables


def replace_documents(
    records: DataFrame, path: str, keep: str = "all", buckets: int = tables.BUCKETS
) -> None:
    """Write records over the stored rows of the same paths.

    Only the buckets the incoming paths fall into are read and rewritten;
    `buckets` counts for a new base only.
    """
    documents, chunks = flows.knowledge_base(records, keep)
    tables.write_kb(documents, chunks, path, records, buckets)


def ingest_stream(
    documents: DataFrame,
    path: str,
    checkpoint: str,
    config: chunking.ChunkConfig,
    ingested_at: Callable[[], object] = F.current_timestamp,
    buckets: int = tables.BUCKETS,
    order: str | None = None,
) -> StreamingQuery:
    """Start ingesting a stream of ``(source_path, text)`` until its end so far.

    If a batch brings a path twice, the row with the largest `order` stays, a
    column such as the time of change; without one, the larger text hash. A
    path whose new text has no chunk loses those it had.
    """
    newest_by = F.col(order) if order else F.sha2("text", 256)

    def one_batch(batch: DataFrame, _: int) -> None:
        newest = stage(kb.latest_wins(batch, ["source_path"], [newest_by]).select("source_path", "text"))
        records = stage(
            chunking.topic_records(newest, config, ingested_at(), empty_blocks=True)
        )
        documents, chunks = flows.knowledge_base(records)
        tables.write_kb(documents, chunks, path, newest, buckets)
        unstage(records, newest)

    return (
        documents.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
