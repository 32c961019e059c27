"""Knowledge base: replacement, cascade, purge, join, search, vector rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators import changes, chunking, kb, postings, vectors
from docspark.plans import flows
from docspark.session import checkpoint_dir, stage
from docspark.sources import tables
from docspark.streaming import ingest, newest
from docspark_checks import chunk_queries, fixtures, page_queries
from docspark_checks.chunk_queries import RECORDS_SQL, records
from docspark_checks.fixtures import duck
from docspark_checks.registry import query, table

_PATH = fixtures.MARKDOWN_PATH
_FILE = "'doc_' || CAST(doc_id AS STRING) || '.md'"


@query(
    "latest_wins",
    """SELECT 'k' || CAST(doc_id % 300 AS VARCHAR) AS source_path, max(doc_id) AS version, arg_max(sha256(text), doc_id) AS hash
 FROM documents GROUP BY doc_id % 300""",
)
def latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    versions = table(spark, sf, "documents").selectExpr(
        "'k' || CAST(doc_id % 300 AS STRING) AS source_path", "doc_id AS version",
        "sha2(text, 256) AS hash",
    )
    return kb.latest_wins(versions, ["source_path"], [F.col("version")])


def _toxic(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").where("toxic = 1").select("doc_id")


@query(
    "cascade_delete",
    """SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return kb.cascade(chunks, _toxic(spark, sf), "doc_id")


@query(
    "purge_source",
    duck(f"""WITH d AS (SELECT {_PATH} AS source_path, {_FILE} AS nome_arquivo, doc_id FROM documents),
 n AS (SELECT CASE WHEN doc_id % 2 = 0 THEN source_path ELSE nome_arquivo END AS name FROM d JOIN labels USING (doc_id) WHERE quality = 0),
 k AS (SELECT * FROM d WHERE source_path NOT IN (SELECT name FROM n) AND nome_arquivo NOT IN (SELECT name FROM n))
 SELECT 'documents' AS kind, source_path FROM k UNION ALL SELECT 'chunks', source_path FROM k"""),
)
def purge_source(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").selectExpr(
        "doc_id", f"{_PATH} AS source_path", f"{_FILE} AS nome_arquivo"
    )
    bad = docs.join(table(spark, sf, "labels").where("quality = 0"), "doc_id")
    names = bad.selectExpr("CASE WHEN doc_id % 2 = 0 THEN source_path ELSE nome_arquivo END AS name")
    left, chunks = kb.purge(docs, docs.select("source_path", "doc_id"), names)
    return left.select(F.lit("documents").alias("kind"), "source_path").unionByName(
        chunks.select(F.lit("chunks").alias("kind"), "source_path")
    )


KB_SQL = (
    RECORDS_SQL
    + """,
 lastb AS (SELECT source_path, max(block_no) AS b FROM topics GROUP BY source_path),
 kb AS (SELECT t.source_path || '|' || chunk_ordem || '|' || subchunk_ordem AS id, nome_software, t.source_path, chunk_ordem, subchunk_ordem, subchunk_total,
   hierarquia, titulo, texto AS conteudo_texto, sha256(CASE WHEN md.text LIKE '%' || chr(10) THEN left(md.text, len(md.text) - 1) ELSE md.text END) AS arquivo_hash,
   '2026-01-01T00:00:00Z' AS arquivo_ingestao_em, sha256(texto) AS conteudo_hash, '2026-01-01T00:00:00Z' AS conteudo_ingestao_em
   FROM topics t JOIN lastb l ON l.source_path = t.source_path AND l.b = t.block_no JOIN md ON md.source_path = t.source_path)"""
)


# the same with all blocks of a file, later ones with their number in the id
KB_ALL_SQL = (
    RECORDS_SQL
    + """,
 kb AS (SELECT t.source_path || CASE WHEN block_no > 1 THEN '|block_' || block_no ELSE '' END || '|' || chunk_ordem || '|' || subchunk_ordem AS id, nome_software, t.source_path, chunk_ordem,
   subchunk_ordem, subchunk_total, hierarquia, titulo, texto AS conteudo_texto,
   sha256(CASE WHEN md.text LIKE '%' || chr(10) THEN left(md.text, len(md.text) - 1) ELSE md.text END) AS arquivo_hash, '2026-01-01T00:00:00Z' AS arquivo_ingestao_em,
   sha256(texto) AS conteudo_hash, '2026-01-01T00:00:00Z' AS conteudo_ingestao_em, block_no::BIGINT AS block_no FROM topics t JOIN md ON md.source_path = t.source_path)"""
)
_VECTOR_ID = (
    "'id_' || sha256(source_path || CASE WHEN block_no > 1 THEN '|block_' || block_no ELSE '' END || '|chunk_' || chunk_ordem || '|sub_' || subchunk_ordem)"
)


def _kb(spark: SparkSession, sf: str, keep: str = "all") -> tuple[DataFrame, DataFrame]:
    # stored, as documents and chunks both come from the records
    return flows.knowledge_base(stage(records(spark, sf)), keep)


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return kb.rows_of_records(records(spark, sf))


@query("kb_join", KB_SQL + " SELECT * FROM kb")
def kb_join(spark: SparkSession, sf: str) -> DataFrame:
    return kb.kb_rows(*_kb(spark, sf, "last")).drop("block_no")


@query("kb_join_all", KB_ALL_SQL + " SELECT * FROM kb")
def kb_join_all(spark: SparkSession, sf: str) -> DataFrame:
    return kb.kb_rows(*_kb(spark, sf))


@query(
    "term_search",
    KB_ALL_SQL
    + """ SELECT id, nome_software, hierarquia, titulo, substr(conteudo_texto, 1, 800) || CASE WHEN len(conteudo_texto) > 800 THEN '...' ELSE '' END AS trecho
 FROM kb WHERE titulo ILIKE '%TOPIC 1%' OR conteudo_texto ILIKE '%TOPIC 1%' ORDER BY source_path, block_no, chunk_ordem, subchunk_ordem LIMIT 10""",
)
def term_search(spark: SparkSession, sf: str) -> DataFrame:
    return kb.search_term(_rows(spark, sf), "TOPIC 1", 10)


def _indexed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    path = f"{checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}"
    postings.store(postings.number(stage(_rows(spark, sf))), path)
    return postings.read(spark, path)


@query(
    "term_search_indexed",
    KB_ALL_SQL
    + " UNION ALL ".join(
        f"""{" " if i else " "}(SELECT '{term}' AS term, id, nome_software, hierarquia, titulo, substr(conteudo_texto, 1, 800) || CASE WHEN len(conteudo_texto) > 800 THEN '...' ELSE '' END AS trecho
 FROM kb WHERE titulo ILIKE '%{term}%' OR conteudo_texto ILIKE '%{term}%' ORDER BY source_path, block_no, chunk_ordem, subchunk_ordem LIMIT 10)"""
        for i, term in enumerate(("TOPIC 1", "t_pic%2", "to"))
    ),
)
def term_search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The term search over a stored trigram index: a plain term, one with wildcards, one too short for the index."""
    rows, lists = _indexed(spark, sf)
    found = None
    for term in ("TOPIC 1", "t_pic%2", "to"):
        hits = postings.search_term(rows, lists, term, 10).select(F.lit(term).alias("term"), "*")
        found = hits if found is None else found.unionByName(hits)
    return found


@query(
    "kb_stats",
    KB_ALL_SQL
    + """ SELECT (SELECT count(DISTINCT (doc_id, block_no)) FROM reg) AS documentos, count(*) AS chunks, sum(len(conteudo_texto))::BIGINT AS caracteres, max(len(conteudo_texto)) AS maior_chunk FROM kb""",
)
def kb_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = fixtures.markdown(spark, sf).select("source_path", "text")
    documents = chunking.documents(docs, F.lit(chunk_queries.STAMP).cast("timestamp"))
    return kb.kb_stats(documents, _rows(spark, sf))


@query(
    "vector_ids",
    KB_ALL_SQL
    + f""" SELECT {_VECTOR_ID} AS id,
 'Software: ' || nome_software || ' | Tópico: ' || hierarquia || ' - ' || titulo || chr(10) || 'Conteúdo: ' || conteudo_texto AS document,
 nome_software AS software, conteudo_hash, 'm' AS embedding_model FROM kb""",
)
def vector_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors.vector_rows(_rows(spark, sf), "user", {"embedding_model": "m"})
    return rows.select(
        "id", "document", "metadata.software", "metadata.conteudo_hash", "metadata.embedding_model"
    )


@query(
    "vector_upsert",
    """WITH m AS (SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN 'text ' || n_chars ELSE 'label ' || quality END AS payload, l.doc_id IS NOT NULL AS fresh
 FROM documents d FULL JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)
 SELECT 'keep' AS mode, id, payload FROM m UNION ALL SELECT 'prune', id, payload FROM m WHERE fresh""",
)
def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    index = table(spark, sf, "documents").selectExpr("doc_id AS id", "'text ' || n_chars AS payload")
    rows = (
        table(spark, sf, "labels")
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.concat(F.lit("label "), F.max("quality").cast("string")).alias("payload"))
    )
    kept = kb.upsert(index, rows).select(F.lit("keep").alias("mode"), "id", "payload")
    pruned = kb.upsert(index, rows, prune=True)
    return kept.unionByName(pruned.select(F.lit("prune").alias("mode"), "id", "payload"))


@query("index_health", "SELECT 'ok' AS status, count(*) AS chunks_indexed, '64' AS dimension FROM embeddings")
def index_health(spark: SparkSession, sf: str) -> DataFrame:
    health = kb.index_health(spark, table(spark, sf, "embeddings"), {"dimension": "64"})
    return health.select("status", "chunks_indexed", "dimension")


@query(
    "document_list",
    RECORDS_SQL
    + """ SELECT DISTINCT soft AS nome_software, split_part(source_path, '/', 3) AS nome_arquivo, source_path,
 sha256(CASE WHEN md.text LIKE '%' || chr(10) THEN left(md.text, len(md.text) - 1) ELSE md.text END) AS arquivo_hash, '2026-01-01T00:00:00Z' AS ingestao_em FROM reg JOIN md USING (doc_id)""",
)
def document_list(spark: SparkSession, sf: str) -> DataFrame:
    docs = fixtures.markdown(spark, sf).select("source_path", "text")
    return kb.document_list(chunking.documents(docs, F.lit(chunk_queries.STAMP).cast("timestamp")))


@query(
    "chunk_sample",
    KB_ALL_SQL
    + """ SELECT hierarquia, titulo, len(conteudo_texto) AS tamanho, conteudo_hash, conteudo_ingestao_em AS ingestao_em FROM kb ORDER BY source_path, block_no, chunk_ordem, subchunk_ordem LIMIT 5""",
)
def chunk_sample(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _rows(spark, sf).withColumnRenamed("conteudo_ingestao_em", "ingestao_em")
    return kb.chunk_sample(chunks, 5)


_REPLACED_SQL = KB_ALL_SQL + """, fresh AS (SELECT DISTINCT md.source_path FROM md JOIN labels USING (doc_id)) """
_REPLACED = """SELECT kb.source_path, chunk_ordem, subchunk_ordem, conteudo_texto FROM kb WHERE source_path NOT IN (SELECT source_path FROM fresh)
 UNION ALL SELECT source_path, 1, 1, '# New' || chr(10) || source_path FROM fresh"""
_STAMP = chunk_queries.STAMP


def _fresh_records(spark: SparkSession, sf: str, text) -> DataFrame:
    """The labelled documents come again with a new text."""
    docs = fixtures.markdown(spark, sf)
    fresh = docs.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id").select(
        "source_path", text.alias("text")
    )
    return stage(
        chunking.topic_records(fresh, chunk_queries.CONFIG, F.lit(_STAMP).cast("timestamp"), empty_blocks=True)
    )


def _new_text():
    return F.concat(F.lit("# New\n"), F.col("source_path"))


@query("replace_by_key", _REPLACED_SQL + _REPLACED)
def replace_by_key(spark: SparkSession, sf: str) -> DataFrame:
    documents, chunks = _kb(spark, sf)
    _, left = kb.replace_by_key(documents, chunks, _fresh_records(spark, sf, _new_text()))
    return left.select("source_path", "chunk_ordem", "subchunk_ordem", "conteudo_texto")


def _stored(spark: SparkSession, sf: str, text) -> tuple[DataFrame, DataFrame]:
    """A base on disk, written with 32 buckets, then changed by documents that come again."""
    path = f"{checkpoint_dir(spark)}/kb-{uuid.uuid4().hex}"
    docs = fixtures.markdown(spark, sf).select("source_path", "text")
    first = stage(
        chunking.topic_records(docs, chunk_queries.CONFIG, F.lit(_STAMP).cast("timestamp"), empty_blocks=True)
    )
    ingest.replace_documents(first, path, buckets=32)
    ingest.replace_documents(_fresh_records(spark, sf, text), path)
    return tables.read_kb(spark, path)


@query("kb_incremental", _REPLACED_SQL + _REPLACED)
def kb_incremental(spark: SparkSession, sf: str) -> DataFrame:
    _, chunks = _stored(spark, sf, _new_text())
    return chunks.select("source_path", "chunk_ordem", "subchunk_ordem", "conteudo_texto")


@query(
    "kb_replace_empty",
    _REPLACED_SQL
    + """SELECT 'document' AS kind, source_path, count(DISTINCT block_no) AS n FROM reg JOIN md USING (doc_id) WHERE source_path NOT IN (SELECT source_path FROM fresh) GROUP BY source_path
 UNION ALL SELECT 'document', source_path, 1 FROM fresh
 UNION ALL SELECT 'chunk', source_path, count(*) FROM kb WHERE source_path NOT IN (SELECT source_path FROM fresh) GROUP BY source_path""",
)
def kb_replace_empty(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose new text is a bare title keep no chunk."""
    documents, chunks = _stored(spark, sf, F.lit("Empty manual\n"))
    counted = [
        t.groupBy("source_path").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "source_path", "n")
        for kind, t in (("document", documents), ("chunk", chunks))
    ]
    return counted[0].unionByName(counted[1])


def _lengths():
    """An encoder for checks: the length of a text and a constant."""
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


@query(
    "index_incremental",
    _REPLACED_SQL
    + f"""SELECT id, len('Software: ' || nome_software || ' | Tópico: ' || hierarquia || ' - ' || titulo || chr(10) || 'Conteúdo: ' || conteudo_texto)::DOUBLE AS length
 FROM (SELECT *, {_VECTOR_ID} AS id FROM kb WHERE source_path NOT IN (SELECT source_path FROM fresh)) t(kid, nome_software, source_path, chunk_ordem, subchunk_ordem, subchunk_total, hierarquia, titulo, conteudo_texto, h, i, ch, ci, block_no, id)
 UNION ALL SELECT 'id_' || sha256(source_path || '|chunk_1|sub_1'), len('Software: New | Tópico: New > New - New' || chr(10) || 'Conteúdo: # New' || chr(10) || source_path)::DOUBLE FROM fresh""",
)
def index_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors on disk; documents that come again bring new ones and lose all they had."""
    encoder = flows.Encoder(_lengths, 2, "lengths")
    path = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    for found in (records(spark, sf), _fresh_records(spark, sf, _new_text())):
        documents, chunks = flows.knowledge_base(stage(found))
        flows.replace_vectors(flows.index_rows(documents, chunks, encoder), documents, path)
    return flows.read_index(spark, path, encoder).select("id", F.get("embedding", F.lit(0)).cast("double").alias("length"))


_SAME_COLUMNS = "t(kid, nome_software, source_path, chunk_ordem, subchunk_ordem, subchunk_total, hierarquia, titulo, conteudo_texto, h, i, ch, ci, block_no, id)"


@query(
    "index_changes",
    _REPLACED_SQL
    + f""", old AS (SELECT * FROM (SELECT *, {_VECTOR_ID} AS id FROM kb) {_SAME_COLUMNS}),
 new AS (SELECT source_path, id, conteudo_texto FROM old WHERE source_path NOT IN (SELECT source_path FROM fresh)
  UNION ALL SELECT source_path, 'id_' || sha256(source_path || '|chunk_1|sub_1'), '# New' || chr(10) || source_path FROM fresh)
 SELECT coalesce(n.source_path, o.source_path) AS source_path, coalesce(n.id, o.id) AS id,
  CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.conteudo_texto = n.conteudo_texto THEN 'kept' ELSE 'changed' END AS change
 FROM new n FULL JOIN old o ON o.id = n.id""",
)
def index_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What an index of all documents needs once the labelled ones have a new text."""

    def leaves(rows: DataFrame) -> DataFrame:
        id_ = vectors.vector_id(F.col("source_path"), F.col("chunk_ordem"), F.col("subchunk_ordem"), kb.block_label())
        return rows.select("source_path", id_.alias("id"), F.col("conteudo_texto").alias("document"))

    stored, fresh = stage(leaves(_rows(spark, sf))), stage(leaves(kb.rows_of_records(_fresh_records(spark, sf, _new_text()))))
    now = stored.join(fresh.select("source_path").distinct(), "source_path", "left_anti").unionByName(fresh)
    return changes.index_changes(now, stored)


@query("documentation_run", "SELECT 'document' AS kind, count(*) AS n FROM pages UNION ALL SELECT 'without vector', 0")
def documentation_run(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of pages converted, ingested and encoded: a document for each page, a vector for each chunk."""
    out = [f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}" for name in ("markdown", "kb", "index")]
    encoder = flows.Encoder(_lengths, 2, "lengths")
    stamp = F.lit(_STAMP).cast("timestamp")
    flows.run_pipeline(spark, page_queries.page_folder(spark, sf), *out, encoder, stamp, chunk_queries.CONFIG)
    documents, chunks = tables.read_kb(spark, out[1])
    index = flows.read_index(spark, out[2], encoder).select("id")
    id_ = vectors.vector_id(F.col("source_path"), F.col("chunk_ordem"), F.col("subchunk_ordem"), kb.block_label())
    without = chunks.select(id_.alias("id")).join(index, "id", "left_anti")
    counted = documents.select("source_path").distinct().agg(F.count("*").alias("n")).select(F.lit("document").alias("kind"), "n")
    return counted.unionByName(without.agg(F.count("*").alias("n")).select(F.lit("without vector").alias("kind"), "n"))


@query("newest_replay", "SELECT user_id, epoch_us(max(ts)) AS newest, count(*) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id")
def newest_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The newest event of every user out of a stream that brings the events in another order, four files one by one."""
    events = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    base = f"{checkpoint_dir(spark)}/replay-{uuid.uuid4().hex}"
    shuffled = events.repartition(4, F.xxhash64("event_id")).sortWithinPartitions(F.xxhash64(F.lit(1), "event_id"))
    # small row groups, so that all cores read a file; state for all cores, as a key takes a few calls a batch
    shuffled.write.option("parquet.block.size", 8 << 20).parquet(f"{base}/in")
    settings = (newest.STATE_STORE, ("spark.sql.shuffle.partitions", str(max(4, spark.sparkContext.defaultParallelism))))
    before = {k: spark.conf.get(k, None) for k, _ in settings}
    try:
        for k, v in settings:
            spark.conf.set(k, v)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        writer = newest.newest_by_key(stream, "user_id", "ts", "36500 days").writeStream.outputMode("update")
        writer = writer.foreachBatch(lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{base}/out"))
        writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = spark.read.schema("user_id bigint, ts timestamp, event_id bigint, batch bigint").parquet(f"{base}/out")
    # since 1970 on the clock of the session, as the table has times without a zone
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    last = kb.latest_wins(found, ["user_id"], [F.col("batch")]).select("user_id", micros.alias("newest"))
    return last.join(events.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")
