"""The three flows: documents to an index, questions to prompts, log to reports."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark import schemas
from docspark.operators import changes, chunking, context, evaluate, extract, kb, stats, vectors
from docspark.session import stage
from docspark.sources import files, store, tables


# Fixed value: columns of the stored pages.
MARKDOWN = "source_path string, output_path string, markdown string"
DIGESTS = "source_path string, id string, digest string"


@dataclass(frozen=True)
class Encoder:
    """A user encoder and the facts stored with its vectors."""

    make: Callable[[], Callable[[list[str]], Any]]
    dim: int
    model: str
    provider: str = "user"
    source: str = "local"
    backend: str = "user"
    batch_size: int = 500

    def properties(self) -> dict[str, str]:
        return {
            "embedding_model": self.model,
            "embedding_model_provider": self.provider,
            "embedding_model_dimension": str(self.dim),
            "embedding_model_source": self.source,
        }


def records_of_pages(pages: DataFrame, config: chunking.ChunkConfig, ingested_at) -> DataFrame:
    """Chunk records of raw pages ``(source_path, html)``: one narrow plan."""
    docs = extract.to_markdown(pages, "html", "text").select("source_path", "text")
    return chunking.topic_records(docs, config, ingested_at, empty_blocks=True)


def knowledge_base(records: DataFrame, keep: str = "all") -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of records, as stored in an empty base. No shuffle."""
    kept = kb.surviving_blocks(records, keep)
    documents = tables.align_schema(kb.document_rows(kept), schemas.DOCUMENTS)
    chunks = kept.where("texto is not null").withColumnRenamed("texto", "conteudo_texto")
    return documents, tables.align_schema(chunks, schemas.CHUNKS)


def index_rows(documents: DataFrame, chunks: DataFrame, encoder: Encoder) -> DataFrame:
    """Vector rows of a knowledge base: id, document, metadata, embedding."""
    rows = vectors.vector_rows(
        kb.kb_rows(documents, chunks), encoder.backend, encoder.properties()
    )
    return vectors.embed(
        rows, "document", encoder.make, encoder.dim, encoder.batch_size
    )


def replace_vectors(rows: DataFrame, paths: DataFrame, index_path: str) -> None:
    """Put vector rows in place of all those of the given paths (source_path).

    A later `refresh_index` takes them as unknown and encodes these paths again.
    """
    keyed = rows.withColumn("source_path", F.col("metadata.source_path"))
    unknown = rows.sparkSession.createDataFrame([], DIGESTS)
    store.replace(index_path, {"vectors": (keyed, keyed.schema), "digests": (unknown, DIGESTS)}, paths, "source_path")


def read_index(spark, index_path: str, encoder: Encoder) -> DataFrame:
    """The stored vector rows."""
    empty_kb = [spark.createDataFrame([], s) for s in (schemas.DOCUMENTS, schemas.CHUNKS)]
    schema = index_rows(*empty_kb, encoder).schema.add("source_path", "string")
    return store.read(spark, index_path, "vectors", schema).drop("source_path")


def refresh_index(documents: DataFrame, chunks: DataFrame, encoder: Encoder, index_path: str, paths: DataFrame) -> DataFrame:
    """Bring the stored vectors of `paths` (source_path) to the given documents and chunks; what changed.

    Only chunks whose text is new or different are encoded, and only vectors of documents with a change are
    written; vectors of another encoder are all different. Digests are stored beside the vectors, so finding what
    changed reads no vector. Returns (source_path, id, change).
    """
    spark = documents.sparkSession
    facts = F.lit("|".join(f"{k}={v}" for k, v in sorted(encoder.properties().items())))
    rows = vectors.vector_rows(kb.kb_rows(documents, chunks), encoder.backend, encoder.properties())
    rows = stage(rows.withColumn("source_path", F.col("metadata.source_path")))
    keyed = rows.select("source_path", "id", F.concat_ws("|", "document", facts).alias("document"))
    now = changes.leaves(keyed, store.BUCKETS)
    digests = now.select("source_path", "id", "digest")
    wanted = paths.select("source_path").distinct()
    before = store.read(spark, index_path, "digests", DIGESTS).join(wanted, "source_path", "left_semi")
    before = before.withColumn("bucket", F.pmod(F.xxhash64("source_path"), F.lit(store.BUCKETS)).cast("int"))
    found = stage(changes.leaf_changes(now, before.select(*changes.LEAF)))
    touched = found.where(F.col("change") != changes.KEPT).select("source_path").distinct()
    fresh = rows.join(found.where(F.col("change").isin(changes.ADDED, changes.CHANGED)).select("id"), "id", "left_semi")
    encoded = vectors.embed(fresh, "document", encoder.make, encoder.dim, encoder.batch_size)
    # the chunks around them take their vector along, with the facts of this run
    kept = rows.join(touched, "source_path", "left_semi").join(found.where(F.col("change") == changes.KEPT).select("id"), "id", "left_semi")
    old = store.read(spark, index_path, "vectors", encoded.schema).select(F.col("id").alias("_id"), "embedding")
    carried = kept.join(old, F.col("id") == F.col("_id")).drop("_id").select(*encoded.columns)
    new = encoded.unionByName(carried)
    of_touched = digests.join(touched, "source_path", "left_semi")
    store.replace(index_path, {"vectors": (new, new.schema), "digests": (of_touched, DIGESTS)}, touched, "source_path")
    return found


def search(
    questions: DataFrame, index: DataFrame, encoder: Encoder, k: int,
    max_context_chars: int = context.MAX_CONTEXT_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """Ranked hits with payload, and one context per question.

    `questions` holds ``(query_id, question)``, the text that is searched for.
    """
    # stored, as the search reads the vectors several times and encoding is dear
    asked = stage(
        vectors.embed(
            questions.select("query_id", "question"), "question", encoder.make, encoder.dim,
            encoder.batch_size,
        )
    )
    hits = stage(vectors.knn(asked, index.select("id", "embedding"), k))
    full = vectors.hits_with_payload(hits, index.drop("embedding"))
    return full, context.build_context(full, max_context_chars)


@dataclass
class Timings:
    """Seconds per stage of a run."""

    seconds: dict[str, float] = field(default_factory=dict)

    def stage(self, name: str, work: Callable[[], Any]) -> Any:
        start = time.perf_counter()
        try:
            return work()
        finally:
            self.seconds[name] = time.perf_counter() - start


def run_pipeline(
    spark, source_root: str, markdown_path: str, kb_path: str, index_path: str,
    encoder: Encoder, ingested_at, config: chunking.ChunkConfig | None = None,
) -> Timings:
    """Convert, ingest and encode a folder of raw documents, stage by stage.

    What was stored before stays: the documents of the folder replace those with
    the same path, with all their chunks and vectors, and only the buckets they
    fall into are written. Each stage writes a table the next one reads, so a
    lost executor never costs more than the stage it was in.
    """
    config = config or chunking.ChunkConfig.from_env()
    timings = Timings()

    pages: list[DataFrame] = []

    def convert() -> None:
        raw = files.spread(files.read_raw(spark, source_root))
        pages.append(stage(extract.convert(raw, source_root, "")))
        store.replace(markdown_path, {"pages": (pages[0], MARKDOWN)}, pages[0], "output_path")

    def ingest() -> None:
        docs = pages[0].select(
            F.ltrim("output_path", F.lit("/")).alias("source_path"), F.col("markdown").alias("text")
        )
        records = stage(
            chunking.topic_records(docs, config, ingested_at, empty_blocks=True)
        )
        documents, chunks = knowledge_base(records)
        tables.write_kb(documents, chunks, kb_path, docs)

    def encode() -> None:
        paths = pages[0].select(F.ltrim("output_path", F.lit("/")).alias("source_path"))
        documents, chunks = (
            t.join(paths, "source_path", "left_semi") for t in tables.read_kb(spark, kb_path)
        )
        refresh_index(documents, chunks, encoder, index_path, paths)

    timings.stage("convert", convert)
    timings.stage("ingest", ingest)
    timings.stage("encode", encode)
    return timings


def report_tables(consolidated: DataFrame, order: str = "row_no") -> dict[str, DataFrame]:
    """Report tables of a consolidated log.

    About fifteen tables read the same rows: pass a stored or persisted table.
    """
    retrieval, generation = schemas.RETRIEVAL_METRICS, schemas.GENERATION_METRICS
    by_variant_r = stats.variant_summary(consolidated, retrieval, "retrieval")
    by_variant_g = stats.variant_summary(consolidated, generation, "generation")
    first = stats.first_variant(consolidated, order) if order in consolidated.columns else None
    return {
        "resumo_metricas_retrieval": stats.group_summary(consolidated, retrieval, "retrieval"),
        "resumo_metricas_generation": stats.group_summary(consolidated, generation, "generation"),
        "comparativo_variantes": stats.baseline_delta(by_variant_r, retrieval, first).unionByName(
            stats.baseline_delta(by_variant_g, generation, first)
        ),
        "variantes_retrieval": by_variant_r,
        "variantes_generation": by_variant_g,
        "ranking_composto": stats.rank_models(consolidated),
        "melhor_variante": stats.best_variant(consolidated, (*retrieval, *generation)),
    }


def analysis_tables(consolidated: DataFrame) -> dict[str, DataFrame]:
    """Tables of the per-model analysis (scores with cut-offs)."""
    return {
        "matriz_consolidada_por_modelo": stats.model_matrix(consolidated),
        "ranking_modelos": stats.ranking(consolidated),
        "resultados_resumidos": stats.model_profile(consolidated),
        "estatisticas_gerais": stats.general_stats(consolidated),
        "estatisticas_descritivas": stats.describe_metrics(consolidated),
        "casos_interessantes": stats.interesting_cases(consolidated),
        "curvas_k": stats.k_curves(consolidated),
        "correlacoes": stats.corr_matrix(consolidated),
        "radar": stats.radar(consolidated),
    }


def write_reports(reports: dict[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    for name, df in reports.items():
        tables.write_report(df, folder, name, fmt)


def experiment_grid(
    gold: DataFrame, chosen: Sequence[evaluate.Variant], models: Sequence[str]
) -> DataFrame:
    """Question x variant x model with the columns an answering job needs."""
    return evaluate.grid(gold.select("id", "pergunta"), chosen, models)
