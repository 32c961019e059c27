"""Neighbours, retrieval quality, contexts, prompts and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import schemas
from docspark.functions import paths, prompts, replies
from docspark.operators import context, evaluate, ivf, stats, vectors
from docspark.plans import flows
from docspark.session import stage
from docspark_checks import fixtures
from docspark_checks.fixtures import duck
from docspark_checks.registry import query, table

K = 10


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings")
    return (
        e.select(F.col("vec_id").alias("query_id"), "embedding"),
        e.select(F.col("vec_id").alias("id"), "embedding"),
    )


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of every vector among all others."""
    queries, corpus = _sides(spark, sf)
    return vectors.knn(queries, corpus, K, exclude_self=True)


HITS_SQL = f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
 d AS (SELECT q.vec_id AS query_id, c.vec_id AS id, pow(list_distance(q.v, c.v), 2) AS distance FROM e q JOIN e c ON q.vec_id <> c.vec_id),
 hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, distance FROM d
   QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= {K})"""


@query("knn_exact", HITS_SQL + " SELECT query_id, rank, id, round(distance, 6) AS distance FROM hits")
def knn_exact(spark: SparkSession, sf: str) -> DataFrame:
    return hits(spark, sf)


@query("knn_exact_l2", HITS_SQL + " SELECT query_id, rank, id, round(sqrt(distance), 6) AS distance FROM hits")
def knn_exact_l2(spark: SparkSession, sf: str) -> DataFrame:
    """The same through the grid of bounded groups instead of a broadcast."""
    queries, corpus = _sides(spark, sf)
    return vectors.knn(queries, corpus, K, metric="l2", exclude_self=True, broadcast_bytes=0)


TABLES, BITS, DIM = 16, 4, 64
_PLANE = "((x.i * x.i * 31 + x.i * 7919 + 12345) % 65537) / 32768.0::DOUBLE - 1.0"


QUERIES_LSH = (
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
 planes AS (SELECT p, list({_PLANE} ORDER BY x.i) AS w FROM (SELECT i, i // {DIM} AS p FROM range({TABLES * BITS * DIM}) t(i)) x GROUP BY p),
 sides AS (SELECT vec_id, p // {BITS} AS t, sum(CASE WHEN list_dot_product(v, w::DOUBLE[]) > 0 THEN 1 << (p % {BITS}) ELSE 0 END)::INT AS code FROM e, planes GROUP BY vec_id, p // {BITS}),
 pairs AS (SELECT DISTINCT a.vec_id AS query_id, b.vec_id AS id FROM sides a JOIN sides b ON a.t = b.t AND a.code = b.code AND a.vec_id <> b.vec_id),
 d AS (SELECT query_id, id, pow(list_distance(q.v, c.v), 2) AS distance FROM pairs JOIN e q ON q.vec_id = query_id JOIN e c ON c.vec_id = id)
 SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, round(distance, 6) AS distance FROM d
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= {K}"""
)


@query("knn_lsh", QUERIES_LSH)
def knn_lsh(spark: SparkSession, sf: str) -> DataFrame:
    queries, corpus = _sides(spark, sf)
    return vectors.knn_lsh(queries, corpus, K, TABLES, BITS, exclude_self=True)


@query(
    "similarity",
    "SELECT event_id, round(CASE WHEN event_id % 19 = 0 THEN NULL ELSE 1.0 / (1.0 + greatest(value - 5, 0.0)) END, 6) AS similarity FROM events",
)
def similarity(spark: SparkSession, sf: str) -> DataFrame:
    distance = F.expr("CASE WHEN event_id % 19 = 0 THEN NULL ELSE value - 5 END")
    return table(spark, sf, "events").select(
        "event_id", vectors.similarity(distance).alias("similarity")
    )


@query("knn_lsh_grid", QUERIES_LSH)
def knn_lsh_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The same cell by cell, for query sides too large to broadcast."""
    queries, corpus = _sides(spark, sf)
    return vectors.knn_lsh(
        queries, corpus, K, TABLES, BITS, exclude_self=True, broadcast_bytes=0
    )


@query(
    "lsh_recall",
    f"""SELECT count(l.id) AS hits, count(*) AS expected, round(count(l.id) / count(*), 6) AS recall
 FROM ({HITS_SQL} SELECT query_id, id FROM hits) x LEFT JOIN ({QUERIES_LSH}) l ON l.query_id = x.query_id AND l.id = x.id""",
)
def lsh_recall(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the exact hits the approximate search finds."""
    return vectors.recall(knn_lsh(spark, sf), hits(spark, sf))


# ---- vectors around forty of the table's own: searches that look at a part of the rows only

CLUSTERS, SPREAD = 40, 0.1
CLUSTERED_SQL = f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
 x AS (SELECT e.vec_id AS id, list_transform(range(1, len(e.v) + 1), lambda i: c.v[i] + {SPREAD}::DOUBLE * e.v[i]) AS v FROM e JOIN e c ON c.vec_id = e.vec_id % {CLUSTERS}),
 d AS (SELECT q.id AS query_id, x.id, pow(list_distance(q.v, x.v), 2) AS distance FROM x q JOIN x ON q.id <> x.id {{where}}),
 hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, distance FROM d
   QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= {K})"""
_CLUSTERED_HITS = CLUSTERED_SQL + " SELECT query_id, rank, id, round(distance, 6) AS distance FROM hits"


def _clustered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    centres = e.where(F.col("vec_id") < CLUSTERS).select(F.col("vec_id").alias("_c"), F.col("embedding").alias("_v"))
    near = F.zip_with("_v", "embedding", lambda c, x: c.cast("double") + F.lit(SPREAD) * x.cast("double"))
    # forty rows
    rows = e.join(F.broadcast(centres), F.col("vec_id") % CLUSTERS == F.col("_c")).select(F.col("vec_id").alias("id"), near.alias("embedding"))
    return rows.withColumnRenamed("id", "query_id"), rows


@query("knn_join", _CLUSTERED_HITS.format(where=""))
def knn_join(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of every vector, by a join over Voronoi cells."""
    return vectors.knn_join(*_clustered(spark, sf), K, exclude_self=True)


@query("knn_join_cost")
def knn_join_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that this join shuffles and distances that it takes, against all pairs."""
    return vectors.knn_join_cost(*_clustered(spark, sf), K, exclude_self=True)


_IVF = {"probes": 2, "rerank": 10}


def _ivf_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, ivf.Model]:
    queries, corpus = _clustered(spark, sf)
    model = ivf.train(corpus, lists=CLUSTERS)
    return queries.where(F.col("query_id") % 50 == 0), corpus, ivf.encode(corpus, model), model


@query("ivf_search", _CLUSTERED_HITS.format(where="WHERE q.id % 50 = 0"))
def ivf_search(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate neighbours; the clusters lie so far apart that two lists a query hold the exact ones."""
    return ivf.search(*_ivf_sides(spark, sf), K, **_IVF, exclude_self=True)


@query("ivf_recall")
def ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Exact hits that the inverted file finds, and the share of an exact search's distances that it takes."""
    queries, corpus, index, model = _ivf_sides(spark, sf)
    found = ivf.search(queries, corpus, index, model, K, **_IVF, exclude_self=True)
    recall = vectors.recall(found, vectors.knn(queries, corpus, K, exclude_self=True))
    cost = ivf.comparisons(queries, index, model, K, **_IVF)
    both = recall.unionByName(cost, True)  # a single row each
    return both.agg(*[F.max(c).alias(c) for c in ("hits", "expected", "recall", "comparisons", "exact_comparisons", "share")])


# ---- retrieval quality: a hit is relevant if it has the label of the query

VARIANTS = evaluate.variants(translation=False)
METRICS_SQL = (
    HITS_SQL
    + """,
 variants AS (SELECT * FROM (VALUES ('baseline', 4), ('topk_aumentado', 10)) t(variacao_retrieval, top_k)),
 m AS (SELECT q.vec_id AS id, q.label, variacao_retrieval, top_k, count(*) AS chunks_recuperados, min(rank) FILTER (c.label = q.label) AS retrieved_rank,
   count(*) FILTER (c.label = q.label) AS relevant_count, avg(1.0 / (1.0 + distance)) AS sim
   FROM e q, variants JOIN hits h ON h.query_id = q.vec_id AND h.rank <= top_k JOIN e c ON c.vec_id = h.id GROUP BY ALL),
 r AS (SELECT *, CASE WHEN retrieved_rank <= top_k THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate_at_k, CASE WHEN relevant_count > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_at_k,
   relevant_count / top_k::DOUBLE AS precision_at_k, coalesce(1.0::DOUBLE / retrieved_rank, 0.0::DOUBLE) AS mrr, sim::DOUBLE AS similaridade_media_chunks FROM m)"""
)


def metrics(spark: SparkSession, sf: str, with_json: bool = False) -> DataFrame:
    path = F.concat(F.lit("docs_markdown/class_"), F.col("label").cast("string"), F.lit(".md"))
    labelled = table(spark, sf, "embeddings").select("vec_id", path.alias("source_path"))
    gold = labelled.select(F.col("vec_id").alias("id"), "source_path")
    found = hits(spark, sf).join(labelled.withColumnRenamed("vec_id", "id"), "id").drop("id")
    return evaluate.retrieval_metrics(gold, found, VARIANTS, with_json)


@query(
    "retrieval_metrics",
    METRICS_SQL
    + """ SELECT id, variacao_retrieval, top_k, chunks_recuperados, coalesce(retrieved_rank, -1) AS retrieved_rank, relevant_count, hit_rate_at_k, recall_at_k, round(precision_at_k, 6) AS precision_at_k,
 round(mrr, 6) AS mrr, round(similaridade_media_chunks, 6) AS similaridade_media_chunks FROM r""",
)
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics(spark, sf).drop("variacao_descricao", "translate_query", "retrieval_hit")
    return found.withColumn("retrieved_rank", F.coalesce("retrieved_rank", F.lit(-1)))


def _summary_sql(metrics_names: tuple[str, ...], source: str, by: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {by}, '{m}' AS metric, round(coalesce(avg({m}), 0), 6) AS mean, "
        f"round(coalesce(avg({m}), 0) - coalesce(1.96 * stddev_samp({m}) / sqrt(count({m})), 0), 6) AS ci95_low, "
        f"round(coalesce(avg({m}), 0) + coalesce(1.96 * stddev_samp({m}) / sqrt(count({m})), 0), 6) AS ci95_high, "
        f"round(coalesce(stddev_samp({m}), 0), 6) AS std, count({m}) AS n FROM {source} GROUP BY {by}"
        for m in metrics_names
    )


@query(
    "retrieval_quality",
    METRICS_SQL
    + f", l AS (SELECT *, 'class ' || label AS modelo, 'retrieval' AS grupo FROM r) {_summary_sql(schemas.RETRIEVAL_METRICS, 'l', 'grupo, variacao_retrieval, modelo')}",
)
def retrieval_quality(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("class "), F.col("label").cast("string")).alias("modelo"),
    )
    scored = metrics(spark, sf).join(labels, "id")
    return stats.group_summary(scored, schemas.RETRIEVAL_METRICS, "retrieval")


# ---- contexts and prompts: the index holds every document, under the vector of its number

_BLOCK = (
    "'[Trecho ' || rank || ']' || chr(10) || 'Software: ' || source || chr(10) || 'Hierarquia: ' || lang || chr(10) || 'Título: N/A' || chr(10) "
    "|| 'Fonte: ' || source || '/' || doc_id || chr(10) || 'Distância: ' || round(distance, 6) || chr(10) || 'Conteúdo:' || chr(10) || trim(text)"
)
DOCUMENT_HITS_SQL = f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
 x AS (SELECT doc_id AS id, v FROM documents JOIN e ON vec_id = doc_id % (SELECT count(*) FROM embeddings)),
 d AS (SELECT q.vec_id AS query_id, x.id, pow(list_distance(q.v, x.v), 2) AS distance FROM e q CROSS JOIN x),
 hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, distance FROM d
   QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= {K})"""
CONTEXT_SQL = (
    DOCUMENT_HITS_SQL
    + f""",
 b AS (SELECT query_id, rank, '- ' || source || ' | ' || lang || ' | ' AS src, trim({_BLOCK}) AS block FROM hits JOIN documents ON doc_id = id),
 k AS (SELECT *, sum(len(block)) OVER w AS total, row_number() OVER w AS rn FROM b WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
 c AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) FILTER (rn = 1 OR total <= 6000)
   || CASE WHEN bool_or(rn > 1 AND total > 6000) THEN chr(10) || chr(10) || '{prompts.TRUNCATION_NOTICE}' ELSE '' END AS context,
   bool_or(rn > 1 AND total > 6000) AS context_truncated, count(*) FILTER (rn = 1 OR total <= 6000) AS blocks_kept, count(*) AS hits,
   trim(string_agg(src, chr(10) ORDER BY rank)) AS sources FROM k GROUP BY query_id)"""
)


def document_index(spark: SparkSession, sf: str) -> DataFrame:
    """(id, embedding) of every document: vectors are dealt round over the document numbers."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    number = e.agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(1))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("_k"))
    # one row
    dealt = docs.join(F.broadcast(number), "_k").withColumn("vec_id", F.col("id") % F.col("n"))
    return dealt.join(e, "vec_id").select("id", "embedding")


def document_hits(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.knn(_sides(spark, sf)[0], document_index(spark, sf), K)


def payload_hits(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("software"),
        F.col("lang").alias("hierarquia"),
        F.lit(None).cast("string").alias("titulo"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_path"),
        F.col("text").alias("document"),
    )
    found = document_hits(spark, sf).withColumn("distance", F.round("distance", 6))
    return found.join(docs, "id", "left")


@query(
    "hits_payload",
    DOCUMENT_HITS_SQL
    + """ SELECT query_id, rank, id, round(distance, 6) AS distance, source AS software, lang AS hierarquia, sha256(text) AS hash FROM hits LEFT JOIN documents ON doc_id = id""",
)
def hits_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Stored hits with the document and metadata of the index."""
    none = F.lit(None).cast("string")
    index = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("document"),
        F.struct(
            F.col("source").alias("software"), F.col("lang").alias("hierarquia"), none.alias("titulo"),
            none.alias("source_path"),
        ).alias("metadata"),
    )
    full = vectors.hits_with_payload(stage(document_hits(spark, sf)), index)
    return full.select(
        "query_id", "rank", "id", "distance", "software", "hierarquia", F.sha2("document", 256).alias("hash")
    )


# ---- the whole flow with an encoder that SQL can repeat: counts of letter pairs
_PAIRS = ("th", "er", "on", "an", "re", "ti")


def _pair_encoder():
    return lambda texts: [[float(t.count(p)) for p in _PAIRS] for t in texts]


_PAIR_VECTOR = "[" + ", ".join(f"((len({{0}}) - len(replace({{0}}, '{p}', ''))) // 2)::DOUBLE" for p in _PAIRS) + "]"


@query(
    "search_flow",
    f"""WITH q AS (SELECT item_id AS query_id, {_PAIR_VECTOR.format('text')} AS v FROM benchmark),
 c AS (SELECT doc_id AS id, source, lang, text, {_PAIR_VECTOR.format('text')} AS v FROM documents),
 d AS (SELECT query_id, id, source, lang, text, list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance FROM q CROSS JOIN c),
 h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 3),
 b AS (SELECT query_id, rank, trim('[Trecho ' || rank || ']' || chr(10) || 'Software: ' || source || chr(10) || 'Hierarquia: ' || lang || chr(10) || 'Título: T' || chr(10) || 'Fonte: ' || source || '/' || id
   || chr(10) || 'Distância: ' || printf('%.1f', distance) || chr(10) || 'Conteúdo:' || chr(10) || trim(text)) AS block FROM h),
 k AS (SELECT *, sum(len(block)) OVER w AS total, row_number() OVER w AS rn FROM b WINDOW w AS (PARTITION BY query_id ORDER BY rank))
 SELECT query_id, sha256(string_agg(block, chr(10) || chr(10) ORDER BY rank) FILTER (rn = 1 OR total <= 6000)
   || CASE WHEN bool_or(rn > 1 AND total > 6000) THEN chr(10) || chr(10) || '{prompts.TRUNCATION_NOTICE}' ELSE '' END) AS context_hash,
   bool_or(rn > 1 AND total > 6000) AS context_truncated, count(*) AS hits FROM k GROUP BY query_id""",
)
def search_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Encode, search, fetch the payload, bound the context."""
    encoder = flows.Encoder(_pair_encoder, len(_PAIRS), "letter-pairs")
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("document"),
        F.struct(
            F.col("source").alias("software"), F.col("lang").alias("hierarquia"), F.lit("T").alias("titulo"),
            F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_path"),
        ).alias("metadata"),
    )
    index = stage(vectors.embed(docs, "document", encoder.make, encoder.dim))
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    _, contexts = flows.search(questions, index, encoder, 3)
    return contexts.select("query_id", F.sha2("context", 256).alias("context_hash"), "context_truncated", "hits")


@query("context_budget", CONTEXT_SQL + " SELECT * FROM c")
def context_budget(spark: SparkSession, sf: str) -> DataFrame:
    return context.build_context(payload_hits(spark, sf))


@query(
    "answer_prompt",
    CONTEXT_SQL
    + f""" SELECT vec_id AS query_id, '{prompts.ANSWER_INTRO}' || chr(10) || chr(10) || 'Pergunta: What is near ' || vec_id || '?' || chr(10) || chr(10) || 'Contexto:' || chr(10) || context
 || chr(10) || chr(10) || 'Fontes recuperadas:' || chr(10) || sources || chr(10) || chr(10) || 'Resposta em português brasileiro:' AS prompt, context_truncated FROM e JOIN c ON query_id = vec_id""",
)
def answer_prompt(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.concat(F.lit("What is near "), F.col("vec_id").cast("string"), F.lit("?")).alias("question"),
    )
    return context.answer_prompts(asked, context.build_context(payload_hits(spark, sf)))


_REPLY = (
    "CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN text || ' <|eot_id|>' || role "
    "WHEN 2 THEN ' ' || text || '<|start_header_id|>a<|eot_id|>' ELSE '<|end_header_id|>' || text END"
)


@query(
    "stop_token_cut",
    """SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '' ELSE trim(text) END AS reply FROM conversations""",
)
def stop_token_cut(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", prompts.cut_stop_tokens(F.expr(_REPLY)).alias("reply")
    )


@query(
    "chat_template",
    f"""SELECT conv_id, turn, '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || '{prompts.ANSWER_SYSTEM}' || '<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) AS prompt FROM conversations""",
)
def chat_template(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", prompts.chat_template(F.col("text")).alias("prompt")
    )


# ---- paths, options and replies that are columns only


@query(
    "output_path",
    """SELECT doc_id, 'out/' || source || '/sub/doc_' || doc_id || '.md' AS path FROM documents""",
)
def output_path(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr("'/in/' || source || '/sub/doc_' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 3 = 0 THEN '.HTM' ELSE '.html' END")
    return table(spark, sf, "documents").select("doc_id", paths.output_path(raw, "/in", "out").alias("path"))


@query(
    "normalise_path",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || '/b/' || doc_id WHEN 1 THEN source || '/' || doc_id ELSE 'none' END AS path FROM documents""",
)
def normalise_path(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr(
        "CASE doc_id % 3 WHEN 0 THEN source || '\\\\b//' || CAST(doc_id AS STRING) WHEN 1 THEN './' || source || '/x/../' || CAST(doc_id AS STRING) ELSE '' END"
    )
    return table(spark, sf, "documents").select("doc_id", paths.normalise(raw, F.lit("none")).alias("path"))


@query("effective_top_k", "SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 4 = 0 THEN 7 ELSE event_id % 4 END AS k FROM events")
def effective_top_k(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 4 END")
    return table(spark, sf, "events").select("event_id", vectors.effective_top_k(asked, 7).alias("k"))


@query(
    "reply_text",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'a' || turn || ' ' || role || 'b' ELSE 'none' END AS reply FROM conversations""",
)
def reply_text(spark: SparkSession, sf: str) -> DataFrame:
    response = F.expr(
        "CASE WHEN turn % 2 = 0 THEN '{\"output\":{\"message\":{\"content\":[{\"text\":\" a' || turn || ' \"},{\"image\":1},{\"text\":\"' || role || 'b\"}]}}}' ELSE '{\"output\":{}}' END"
    )
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.coalesce(replies.reply_text(response), F.lit("none")).alias("reply")
    )


@query("format_tokens", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'entrada: ' || event_id + 1 || ' | saída: 7 | total: ' || event_id + 8 WHEN 1 THEN 'entrada: ' || event_id ELSE 'N/D' END AS tokens FROM events")
def format_tokens(spark: SparkSession, sf: str) -> DataFrame:
    usage = F.expr(
        "CASE event_id % 3 WHEN 0 THEN '{\"inputTokens\":' || (event_id + 1) || ',\"outputTokens\":7,\"totalTokens\":' || (event_id + 8) || '}' "
        "WHEN 1 THEN '{\"input_tokens\":' || event_id || '}' ELSE 'broken' END"
    )
    return table(spark, sf, "events").select("event_id", replies.format_tokens(usage).alias("tokens"))


@query(
    "query_translation",
    """SELECT conv_id, turn, turn % 4 < 3 AS enabled, turn % 4 = 0 AS applied, CASE WHEN turn % 4 < 3 THEN 'm' ELSE '' END AS model_id, CASE turn % 4 WHEN 0 THEN 'in ' || role ELSE text END AS translated FROM conversations""",
)
def query_translation(spark: SparkSession, sf: str) -> DataFrame:
    reply = F.expr("CASE turn % 4 WHEN 0 THEN '\"in ' || role || '\"' WHEN 1 THEN NULL ELSE 'unused' END")
    error = F.expr("CASE WHEN turn % 4 = 2 THEN 'timeout' END")
    found = replies.query_translation(F.col("text"), reply, F.expr("turn % 4 < 3"), F.lit("m"), error)
    rows = table(spark, sf, "conversations").select("conv_id", "turn", found.alias("t"))
    return rows.select(
        "conv_id", "turn", "t.enabled", "t.applied", F.coalesce("t.model_id", F.lit("")).alias("model_id"),
        F.col("t.translated_question").alias("translated"),
    )


# ---- replies as JSON, one per event
_E = "CAST(event_id AS STRING)"
_SCORES = (
    "'{\"groundedness\":{\"score\":' || CAST(1 + event_id % 5 AS STRING) || ',\"comment\":\"c' || "
    f"{_E} || '\"}},\"corretude\":{{\"score\":' || CAST(event_id % 5 AS STRING) || '.5}},\"clareza\":{{\"score\":\"4\",\"comment\":\"text\"}},\"completude\":3}}'"
)
_ESCAPED = f"replace({_SCORES}, '\"', '\\\\\"')"
_RESPONSE = (
    "CASE event_id % 4 "
    f"WHEN 0 THEN '{{\"output\":{{\"message\":{{\"content\":[{{\"text\":\"note\"}},{{\"toolUse\":{{\"name\":\"avaliar_resposta_rag\",\"input\":' || {_SCORES} || '}}}}]}}}}}}' "
    f"WHEN 1 THEN '{{\"output\":{{\"message\":{{\"content\":[{{\"text\":\"' || {_ESCAPED} || '\"}}]}}}}}}' "
    f"WHEN 2 THEN '{{\"output\":{{\"message\":{{\"content\":[{{\"toolUse\":{{\"name\":\"avaliar_resposta_rag\",\"input\":\"' || {_ESCAPED} || '\"}}}}]}}}}}}' "
    "ELSE '{\"output\":{\"message\":{\"content\":[{\"text\":\"no json ' || event_type || '\"}]}}}' END"
)


@query(
    "judge_payload",
    """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN 1 + event_id % 5 ELSE -1 END AS groundedness, CASE WHEN event_id % 4 < 3 THEN 'c' || event_id ELSE '' END AS groundedness_comment,
 (-1)::BIGINT AS corretude, (-1)::BIGINT AS clareza, CASE WHEN event_id % 4 < 3 THEN 'text' ELSE '' END AS clareza_comment, (-1)::BIGINT AS completude FROM events""",
)
def judge_payload(spark: SparkSession, sf: str) -> DataFrame:
    scored = table(spark, sf, "events").select(
        "event_id", replies.judge_scores(replies.judge_payload(F.expr(_RESPONSE))).alias("s")
    )
    return scored.select(
        "event_id",
        F.coalesce("s.groundedness.score", F.lit(-1)).alias("groundedness"),
        F.col("s.groundedness.comment").alias("groundedness_comment"),
        F.coalesce("s.corretude.score", F.lit(-1)).alias("corretude"),
        F.coalesce("s.clareza.score", F.lit(-1)).alias("clareza"),
        F.col("s.clareza.comment").alias("clareza_comment"),
        F.coalesce("s.completude.score", F.lit(-1)).alias("completude"),
    )


_USAGE = (
    "CASE event_id % 5 "
    f"WHEN 0 THEN '{{\"usage\":{{\"inputTokens\":' || {_E} || ',\"outputTokens\":7}}}}' "
    f"WHEN 1 THEN '{{\"usage\":{{\"input_tokens\":' || {_E} || '}}}}' "
    f"WHEN 2 THEN '{{\"prompt_token_count\":3,\"generation_token_count\":' || {_E} || '}}' "
    "WHEN 3 THEN '{\"usage\":{\"inputTokens\":\"many\"}}' ELSE 'broken' END"
)


@query(
    "token_usage",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN 3 ELSE -1 END AS input_tokens, CASE event_id % 5 WHEN 0 THEN 7 WHEN 2 THEN event_id ELSE -1 END AS output_tokens,
 CASE event_id % 5 WHEN 0 THEN event_id + 7 WHEN 1 THEN event_id WHEN 2 THEN event_id + 3 ELSE -1 END AS tokens FROM events""",
)
def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", replies.tokens(F.expr(_USAGE)).alias("t")
    ).select(
        "event_id",
        *[
            F.coalesce(f"t.{c}", F.lit(-1)).alias(c)
            for c in ("input_tokens", "output_tokens", "tokens")
        ],
    )


_RAW_PATH = (
    "CASE doc_id % 4 WHEN 0 THEN 'C:\\\\base\\\\Docs_Markdown\\\\' || source || '\\\\Doc_' || CAST(doc_id AS STRING) || '.MD' "
    "WHEN 1 THEN ' /srv/docs_markdown/' || lang || '/a.md ' WHEN 2 THEN 'other/' || source || '/File.md' ELSE '' END"
)


@query(
    "path_key",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'docs_markdown/' || lower(source) || '/doc_' || doc_id || '.md' WHEN 1 THEN 'docs_markdown/' || lang || '/a.md' WHEN 2 THEN 'file.md' ELSE '' END AS key FROM documents""",
)
def path_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", paths.path_key(F.expr(_RAW_PATH)).alias("key")
    )


@query(
    "format_duration",
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'N/D' WHEN value * 3 < 60 THEN printf('%.2fs', value * 3) ELSE printf('%dm %.1fs', floor(value * 3 / 60)::INT, value * 3 - floor(value * 3 / 60) * 60) END AS duration FROM events""",
)
def format_duration(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.expr("CASE WHEN event_id % 10 = 0 THEN NULL ELSE value * 3 END")
    return table(spark, sf, "events").select(
        "event_id", replies.format_duration(seconds).alias("duration")
    )


# ---- replies to questions: one per conversation turn
_QUOTED = "CASE turn % 3 WHEN 0 THEN '\"' || text || '\"' WHEN 1 THEN ' ' || text || '  ' ELSE 'x' END"


@query(
    "clean_question",
    """WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN 'x' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS q FROM conversations),
 f AS (SELECT *, CASE WHEN q LIKE '%?' THEN q WHEN q LIKE '%.' AND NOT contains(q, '?') THEN left(q, len(q) - 1) || '?' WHEN q LIKE '%.' THEN q ELSE q || '?' END AS question FROM t)
 SELECT conv_id, turn, CASE WHEN len(question) >= 12 THEN question ELSE 'none' END AS question FROM f""",
)
def clean_question(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.coalesce(replies.clean_question(F.expr(_QUOTED)), F.lit("none")).alias("question"),
    )


_TRANSLATED = (
    "CASE turn % 4 WHEN 0 THEN '```' || role || ' ' || turn || '```' WHEN 1 THEN '{\"translation\": \" in ' || role || ' \"}' "
    "WHEN 2 THEN '\"' || role || '\"' ELSE ' ' END"
)


@query(
    "clean_translation",
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN role || ' ' || turn WHEN 1 THEN 'in ' || role WHEN 2 THEN role ELSE text END AS query FROM conversations""",
)
def clean_translation(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        "conv_id", "turn",
        replies.clean_translation(F.expr(_TRANSLATED), F.col("text")).alias("query"),
    )


_JUDGE_HEAD, _JUDGE_TAIL = (
    t.replace("\n", "' || chr(10) || '") for t in (prompts.JUDGE_PROMPT_HEAD, prompts.JUDGE_PROMPT_TAIL)
)


@query(
    "judge_prompt",
    f"""SELECT conv_id, turn, '{_JUDGE_HEAD}Pergunta: ' || role || chr(10) || chr(10) || 'Resposta ideal:' || chr(10) || conv_id || chr(10) || chr(10) || 'Resposta gerada:' || chr(10) || text || chr(10) || chr(10) || '{_JUDGE_TAIL}' AS prompt FROM conversations""",
)
def judge_prompt(spark: SparkSession, sf: str) -> DataFrame:
    prompt = prompts.judge_prompt(F.col("role"), F.col("conv_id").cast("string"), F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", prompt.alias("prompt"))


@query(
    "reply_vector",
    """SELECT vec_id, len(embedding) AS n, round(embedding[1]::DOUBLE, 6) AS first, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""",
)
def reply_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors out of embedding replies, half of them flat and half in a list of one."""
    numbers = F.col("embedding").cast("array<double>")
    flat, nested = F.to_json(F.struct(numbers.alias("embedding"))), F.to_json(F.struct(F.array(numbers).alias("embeddings")))
    answered = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 2 == 0, flat).otherwise(nested).alias("reply"))
    found = answered.select("vec_id", replies.reply_vector(F.col("reply")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return found.select("vec_id", F.size("v").alias("n"), F.get("v", F.lit(0)).alias("first"), total.alias("total"))
