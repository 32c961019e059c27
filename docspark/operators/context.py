"""Ranked hits to length-bounded contexts and prompts.

A query has at most k hits, and k is a parameter, so one group is small. The
running total and the text both need the hits of a query together: one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import prompts

# Fixed value: default size of a context in characters.
MAX_CONTEXT_CHARS = 6000


def context_blocks(hits: DataFrame, max_chars: int = MAX_CONTEXT_CHARS) -> DataFrame:
    """Hits with their text block, the running length and whether they fit.

    The first block always fits; blocks follow while the total stays within
    `max_chars`. Line breaks between blocks are not counted.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    block = prompts.context_block(
        *[F.col(c) for c in (
            "rank", "software", "hierarquia", "titulo", "source_path", "distance", "document"
        )]
    )
    return (
        hits.withColumn("block", block)
        .withColumn("total_chars", F.sum(F.length("block")).over(upto))
        .withColumn(
            "kept",
            (F.row_number().over(order) == 1) | (F.col("total_chars") <= max_chars),
        )
    )


def build_context(hits: DataFrame, max_chars: int = MAX_CONTEXT_CHARS) -> DataFrame:
    """One context per query, with a notice if hits were left out."""

    def ordered(keep, value):
        rows = F.array_sort(F.collect_list(F.when(keep, F.struct("rank", value.alias("v")))))
        return F.transform(rows, lambda r: r["v"])

    grouped = (
        context_blocks(hits, max_chars)
        .groupBy("query_id")
        .agg(
            ordered(F.col("kept"), F.col("block")).alias("blocks"),
            ordered(
                F.lit(True),
                prompts.source_line(F.col("software"), F.col("hierarquia"), F.col("titulo")),
            ).alias("sources"),
            F.max(~F.col("kept")).alias("context_truncated"),
            F.count("*").alias("hits"),
        )
    )
    notice = F.when(F.col("context_truncated"), F.array(F.lit(prompts.TRUNCATION_NOTICE)))
    shown = F.concat("blocks", F.coalesce(notice, F.array().cast("array<string>")))
    return grouped.select(
        "query_id",
        F.array_join(shown, "\n\n").alias("context"),
        "context_truncated",
        F.size("blocks").cast("bigint").alias("blocks_kept"),
        "hits",
        prompts.sources_block(F.col("sources")).alias("sources"),
    )


def answer_prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Prompt per question; a question without hits says so."""
    joined = questions.join(contexts, "query_id", "left")
    context = F.coalesce("context", F.lit(""))
    sources = F.coalesce("sources", F.lit(prompts.NO_SOURCES))
    return joined.select(
        "query_id",
        prompts.answer_prompt(F.col("question"), context, sources).alias("prompt"),
        F.coalesce("context_truncated", F.lit(False)).alias("context_truncated"),
    )
