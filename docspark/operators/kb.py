"""The knowledge base: keyed replacement, lookup, search.

A key may hold a large share of the rows. Newest-per-key work limits every map
task to one row per key before the shuffle, joins leave skewed keys to adaptive
execution, and nothing is gathered per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Letters a case-blind search folds, and the snippet length.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
SNIPPET_CHARS = 800


def latest_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of every key by the given order."""
    newest = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def surviving_blocks(records: DataFrame, keep: str = "all") -> DataFrame:
    """Records of all blocks of a file, or with `keep="last"` of its last one.

    `last` is what is left when blocks that share the key of their file are
    stored one by one; the survivor then counts as the only block.
    """
    if keep not in ("last", "all"):
        raise ValueError("keep must be last or all")
    if keep == "all":
        return records
    return records.where("block_no = last_block").withColumn("block_no", F.lit(1))


def document_rows(records: DataFrame) -> DataFrame:
    """One document row per block: that of its first record. No shuffle."""
    first = (F.col("chunk_ordem") == 1) & (F.col("subchunk_ordem") == 1)
    return records.where(first | F.col("texto").isNull()).select(
        "source_path", "nome_software", "nome_arquivo", "arquivo_hash", "ingestao_em", "block_no"
    )


def replace_by_key(
    documents: DataFrame, chunks: DataFrame, records: DataFrame, keep: str = "all"
) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks after new records replace those of the same path."""
    kept = surviving_blocks(records, keep)
    new_documents = document_rows(kept)
    new_chunks = kept.where("texto is not null").withColumnRenamed("texto", "conteudo_texto")
    incoming = new_documents.select("source_path")
    return (
        documents.join(incoming, "source_path", "left_anti").unionByName(
            new_documents.select(*documents.columns)
        ),
        chunks.join(incoming, "source_path", "left_anti").unionByName(
            new_chunks.select(*chunks.columns)
        ),
    )


def cascade(chunks: DataFrame, deleted: DataFrame, key: str = "source_path") -> DataFrame:
    """Chunks left after their documents are deleted."""
    return chunks.join(deleted.select(key), key, "left_anti")


def purge(
    documents: DataFrame, chunks: DataFrame, names: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Drop documents whose path or file name is listed in `names.name`."""
    listed = names.select("name")
    by_path = listed.withColumnRenamed("name", "source_path")
    by_file = listed.withColumnRenamed("name", "nome_arquivo")
    gone = documents.join(by_path, "source_path", "left_semi").select("source_path").union(
        documents.join(by_file, "nome_arquivo", "left_semi").select("source_path")
    )
    left = documents.join(by_path, "source_path", "left_anti").join(
        by_file, "nome_arquivo", "left_anti"
    )
    return left, cascade(chunks, gone)


KB_COLUMNS = (
    "id", "nome_software", "source_path", "chunk_ordem", "subchunk_ordem", "subchunk_total",
    "hierarquia", "titulo", "conteudo_texto", "arquivo_hash", "arquivo_ingestao_em",
    "conteudo_hash", "conteudo_ingestao_em", "block_no",
)


def block_label() -> Column:
    """Part of an id that tells the later blocks of a file apart, null for the first."""
    return F.when(F.col("block_no") > 1, F.concat(F.lit("block_"), F.col("block_no").cast("string")))


def _chunk_id() -> Column:
    return F.concat_ws("|", "source_path", block_label(), "chunk_ordem", "subchunk_ordem")


def kb_rows(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks with their document: the columns that are encoded."""
    d = documents.select(
        "source_path", "block_no", "nome_software", "arquivo_hash",
        F.col("ingestao_em").alias("arquivo_ingestao_em"),
    )
    c = chunks.withColumnRenamed("ingestao_em", "conteudo_ingestao_em")
    if "id" not in c.columns:
        c = c.withColumn("id", _chunk_id())
    of_document = ("nome_software", "arquivo_hash", "arquivo_ingestao_em")
    same = (F.col("c.source_path") == F.col("d.source_path")) & F.col("c.block_no").eqNullSafe(F.col("d.block_no"))
    side = {n: "d" if n in of_document else "c" for n in KB_COLUMNS}
    return c.alias("c").join(d.alias("d"), same).select(*[F.col(f"{side[n]}.{n}") for n in KB_COLUMNS])


def rows_of_records(records: DataFrame, keep: str = "all") -> DataFrame:
    """The same rows straight from chunk records, which carry their document: no join."""
    kept = surviving_blocks(records, keep).where("texto is not null")
    return kept.withColumns(
        {
            "id": _chunk_id(),
            "conteudo_texto": F.col("texto"),
            "arquivo_ingestao_em": F.col("ingestao_em"),
            "conteudo_ingestao_em": F.col("ingestao_em"),
        }
    ).select(*KB_COLUMNS)


def contains_term(c: Column, term: str) -> Column:
    """LIKE '%term%', blind to the case of ASCII letters; % and _ are wildcards."""
    folded = F.translate(c, ASCII_UPPER, ASCII_LOWER)
    pattern = "%" + term.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER)) + "%"
    return F.like(folded, F.lit(pattern), F.lit("\x1b"))


def snippet(c: Column) -> Column:
    return F.concat(
        F.substring(c, 1, SNIPPET_CHARS),
        F.when(F.length(c) > SNIPPET_CHARS, F.lit("...")).otherwise(F.lit("")),
    )


# Fixed value: documents are read by path, then by block, chunk and part.
READING_ORDER = ("source_path", "block_no", "chunk_ordem", "subchunk_ordem")


def search_term(
    kb: DataFrame, term: str, limit: int = 10, order: Sequence[str] = READING_ORDER
) -> DataFrame:
    """First matches by title or text, in reading order, with a snippet."""
    return (
        kb.where(contains_term(F.col("titulo"), term) | contains_term(F.col("conteudo_texto"), term))
        .orderBy(*order)
        .limit(limit)
        .select(
            "id", "nome_software", "hierarquia", "titulo",
            snippet(F.col("conteudo_texto")).alias("trecho"),
        )
    )


def document_list(documents: DataFrame) -> DataFrame:
    """Documents with a note in place of missing audit fields."""
    note = F.lit("[não informado]")
    return documents.select(
        "nome_software",
        "nome_arquivo",
        *[
            F.coalesce(F.nullif(c, F.lit("")), note).alias(c)
            for c in ("source_path", "arquivo_hash", "ingestao_em")
        ],
    )


def kb_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: numbers of documents and chunks, and text lengths."""
    d = documents.agg(F.count("*").alias("documentos"))
    c = chunks.agg(
        F.count("*").alias("chunks"),
        F.coalesce(F.sum(F.length("conteudo_texto")), F.lit(0)).alias("caracteres"),
        F.coalesce(F.max(F.length("conteudo_texto")), F.lit(0)).cast("bigint").alias("maior_chunk"),
    )
    # two one-row tables side by side
    return d.withColumn("_k", F.lit(1)).join(c.withColumn("_k", F.lit(1)), "_k").drop("_k")


def chunk_sample(chunks: DataFrame, n: int = 5, order: Sequence[str] = READING_ORDER) -> DataFrame:
    """The first chunks with the length of their text."""
    return (
        chunks.orderBy(*order)
        .limit(n)
        .select(
            "hierarquia", "titulo", F.length("conteudo_texto").alias("tamanho"), "conteudo_hash",
            "ingestao_em",
        )
    )


def upsert(
    index: DataFrame, rows: DataFrame, key: str = "id", prune: bool = False, order: str | None = None
) -> DataFrame:
    """Rows replace those with the same id; others stay unless `prune` is set.

    The index is only probed for the ids of the batch, never sorted. If a batch
    brings an id twice, the row with the largest `order` stays, or without an
    order the one with the largest hash.
    """
    by = F.col(order) if order else F.xxhash64(*rows.columns)
    fresh = latest_wins(rows, [key], [by])
    left = index.limit(0) if prune else index.join(rows.select(key), key, "left_anti")
    return left.unionByName(fresh, allowMissingColumns=True)


def index_health(
    spark: SparkSession, index: DataFrame | None, properties: dict[str, str], reason: str = ""
) -> DataFrame:
    """One row: status, number of vectors and the properties of the index."""
    facts = [F.lit(str(v)).alias(name) for name, v in properties.items()]
    if index is None:
        return spark.range(1).select(
            F.lit("degraded").alias("status"),
            F.lit(None).cast("bigint").alias("chunks_indexed"),
            F.lit(reason or "index not found").alias("error"),
            *facts,
        )
    return index.agg(F.count("*").alias("chunks_indexed")).select(
        F.lit("ok").alias("status"), "chunks_indexed", F.lit(None).cast("string").alias("error"),
        *facts,
    )
