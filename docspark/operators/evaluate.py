"""Questions, variants and models: the experiment grid and retrieval metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import paths, replies
from docspark.functions import text as tx
from docspark.functions.fold import bind
from docspark.operators.vectors import similarity
from docspark.schemas import LOG_COLUMNS

VARIANT_TYPE = (
    "struct<variacao_retrieval:string,top_k:int,translate_query:boolean,variacao_descricao:string>"
)


@dataclass(frozen=True)
class Variant:
    name: str
    top_k: int
    translate_query: bool
    description: str = ""


def variants(
    top_k: int = 10, baseline_top_k: int = 4, compare: bool = True, translation: bool = True
) -> list[Variant]:
    """The retrieval variants under comparison, or the production one alone."""
    # Names and descriptions.
    if not compare:
        return [
            Variant("production", top_k, True, "Configuração principal definida pelo ambiente.")
        ]
    low = Variant(
        "baseline", baseline_top_k, False, "Linha de base sem tradução e com Top-K reduzido."
    )
    low_translated = Variant(
        "baseline_traduzido", baseline_top_k, True, "Linha de base com tradução de consulta."
    )
    high = Variant("topk_aumentado", top_k, False, "Top-K ampliado sem tradução.")
    high_translated = Variant(
        "topk_aumentado_traduzido", top_k, True, "Top-K ampliado com tradução de consulta."
    )
    return [low, low_translated, high, high_translated] if translation else [low, high]


def with_variants(df: DataFrame, chosen: Sequence[Variant]) -> DataFrame:
    """Every row once per variant. The list is a parameter, so this is an explode."""
    items = F.array(
        *[
            F.struct(
                F.lit(v.name).alias("variacao_retrieval"),
                F.lit(v.top_k).alias("top_k"),
                F.lit(v.translate_query).alias("translate_query"),
                F.lit(v.description).alias("variacao_descricao"),
            )
            for v in chosen
        ]
    )
    return df.select("*", F.inline(items))


def with_models(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every row once per model."""
    return df.select("*", F.explode(F.array(*[F.lit(m) for m in models])).alias("modelo"))


def grid(gold: DataFrame, chosen: Sequence[Variant], models: Sequence[str]) -> DataFrame:
    """Question x variant x model."""
    return with_models(with_variants(gold, chosen), models)


#: A missing value is written as null.
KEEP_NULLS = {"ignoreNullFields": "false"}


def retrieval_metrics(
    gold: DataFrame, hits: DataFrame, chosen: Sequence[Variant], with_json: bool = False
) -> DataFrame:
    """Relevance and ranking metrics per question and variant.

    `gold` holds ``(id, source_path)``; `hits` the ranked rows
    ``(query_id, rank, source_path, distance)`` of one search at the largest k,
    with ``translate_query`` if searches with and without translation differ. A
    hit is relevant if its path key equals that of the question.
    """
    asked = with_variants(
        gold.select("id", paths.path_key(F.col("source_path")).alias("gold_key")), chosen
    )
    on = [F.col("id") == F.col("query_id"), F.col("rank") <= F.col("top_k")]
    # only what is read, under names that the questions do not have
    shown = [c for c in ("titulo", "hierarquia", "document") if c in hits.columns]
    right = hits.select("query_id", "rank", "distance", F.col("source_path").alias("hit_path"), *shown)
    if "translate_query" in hits.columns:
        right = hits.select(
            "query_id", "rank", "distance", F.col("source_path").alias("hit_path"),
            F.col("translate_query").alias("hit_translated"), *shown,
        )
        on.append(F.col("translate_query") == F.col("hit_translated"))
    pairs = asked.join(right, on, "left")
    relevant = (F.col("gold_key") != "") & (paths.path_key(F.col("hit_path")) == F.col("gold_key"))
    aggregates = [
        F.count("rank").cast("int").alias("chunks_recuperados"),
        F.min(F.when(relevant, F.col("rank"))).alias("retrieved_rank"),
        F.count_if(F.col("rank").isNotNull() & relevant).alias("relevant_count"),
        F.avg(similarity(F.col("distance"))).alias("similaridade_media_chunks"),
    ]
    if with_json:
        # at most top_k hits per group
        present = F.col("rank").isNotNull()
        aggregates.append(
            F.sort_array(
                F.collect_list(
                    F.when(
                        present,
                        F.struct(
                            "rank",
                            F.col("hit_path").alias("source_path"),
                            "distance",
                            similarity(F.col("distance")).alias("similarity"),
                            *shown,
                        ),
                    )
                )
            ).alias("_chunks")
        )
    grouped = asked.columns
    scored = pairs.groupBy(*grouped).agg(*aggregates)
    rank = F.col("retrieved_rank")
    hit = F.coalesce(rank <= F.col("top_k"), F.lit(False))
    out = scored.select(
        "id", "variacao_retrieval", "variacao_descricao", "top_k", "translate_query",
        "chunks_recuperados", "retrieved_rank", "relevant_count",
        hit.alias("retrieval_hit"),
        hit.cast("double").alias("hit_rate_at_k"),
        (F.col("relevant_count") > 0).cast("double").alias("recall_at_k"),
        (F.col("relevant_count") / F.greatest(F.col("top_k"), F.lit(1))).alias("precision_at_k"),
        reciprocal_rank(rank).alias("mrr"),
        "similaridade_media_chunks",
        *(["_chunks"] if with_json else []),
    )
    if not with_json:
        return out
    return out.select(
        *[c for c in out.columns if c != "_chunks"],
        F.to_json("_chunks", KEEP_NULLS).alias("chunks_recuperados_json"),
        F.to_json(F.transform("_chunks", lambda c: c["source_path"]), KEEP_NULLS).alias("source_paths_chunks"),
        F.to_json(F.transform("_chunks", lambda c: c["similarity"]), KEEP_NULLS).alias("similaridades_chunks"),
    )


def reciprocal_rank(rank: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(1.0), rank), F.lit(0.0))


def hit_at(rank: Column, n: int) -> Column:
    return F.coalesce((rank <= n).cast("double"), F.lit(0.0))


def result_log(gold: DataFrame, retrieval: DataFrame, answers: DataFrame) -> DataFrame:
    """Result log of 36 columns.

    `retrieval` comes from `retrieval_metrics(..., with_json=True)`; `answers`
    holds ``(id, variacao_retrieval, modelo, resposta, tempo_resposta_s,
    generation_metadata, contexto, context_truncated)`` and may hold
    ``refraseamento`` and ``query_translation``.
    """
    facts = gold.select(
        "id", "pergunta", "resposta_ideal", F.col("source_path").alias("source_path_ground_truth"),
        "titulo_documento", "secao", "categoria", "dificuldade",
    )
    joined = answers.join(retrieval, ["id", "variacao_retrieval"]).join(facts, "id")
    for name, default in (("refraseamento", F.col("pergunta")), ("query_translation", F.lit("{}"))):
        value = F.coalesce(name, default) if name in answers.columns else default
        joined = joined.withColumn(name, value)
    used = replies.tokens(F.col("generation_metadata"))
    answer = F.coalesce("resposta", F.lit(""))
    full = (
        joined.withColumn("_t", used)
        .withColumn("input_tokens", F.col("_t.input_tokens"))
        .withColumn("output_tokens", F.col("_t.output_tokens"))
        .withColumn("tokens", F.col("_t.tokens"))
        .withColumn("resposta", answer)
        .withColumn("tempo_resposta_s", F.round("tempo_resposta_s", 6))
        .withColumn("context_truncated", F.coalesce("context_truncated", F.lit(False)))
        .withColumn("answer_length", F.length(answer))
        .withColumn("question_length", F.length("pergunta"))
    )
    return full.select(*LOG_COLUMNS)


def metrics_from_log(log: DataFrame, gold: DataFrame, cutoffs: Sequence[int] = (1, 3, 4)) -> DataFrame:
    """Recompute the retrieval metrics of a log from its JSON columns.

    The rank of a hit is its place in the list. Rows whose question is not in
    the gold table are dropped; the first gold row of an id counts.
    """
    truth = (
        gold.groupBy("id")
        .agg(F.min_by("source_path", "ordem" if "ordem" in gold.columns else "source_path").alias("_gold"))
        .select("id", paths.path_key(F.col("_gold")).alias("_gold_key"))
    )
    none = F.array().cast("array<variant>")

    def items(column: str) -> Column:
        """Items of a JSON list with their types; anything else counts as an empty list."""
        return F.coalesce(F.try_variant_get(F.try_parse_json(F.col(column)), "$", "array<variant>"), none)

    def keys(column: str) -> Column:
        return F.transform(
            items(column),
            lambda x: F.coalesce(
                paths.path_key(F.try_variant_get(x, "$.source_path", "string")), F.lit("")
            ),
        )

    relevant = bind(
        keys("chunks_recuperados_json"),
        lambda ks: F.filter(
            F.transform(
                ks,
                lambda key, i: F.when(
                    (F.col("_gold_key") != "") & (key == F.col("_gold_key")), i + 1
                ),
            ),
            lambda p: p.isNotNull(),
        ),
    )
    # numbers only: text that looks like one does not count
    numbers = F.filter(
        F.transform(
            F.filter(
                items("similaridades_chunks"),
                lambda s: F.schema_of_variant(s).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"),
            ),
            lambda s: F.try_variant_get(s, "$", "double"),
        ),
        lambda d: d.isNotNull(),
    )
    parsed = log.join(truth, "id").select(
        *log.columns,
        relevant.alias("_places"),
        F.size(items("chunks_recuperados_json")).alias("_n"),
        numbers.alias("_sims"),
    )
    top_k = F.greatest(
        F.coalesce(
            F.nullif(tx.to_number(F.col("top_k").cast("string")).cast("int"), F.lit(0)),
            F.nullif(F.col("_n"), F.lit(0)),
            F.lit(1),
        ),
        F.lit(1),
    )
    rank, count = F.get("_places", F.lit(0)), F.size("_places")
    logged = F.col("similaridade_media_chunks").cast("string")
    replaced = {
        "retrieval_hit", "retrieved_rank", "hit_rate_at_k", "recall_at_k", "precision_at_k", "mrr",
        "similaridade_media_chunks",
    }
    return parsed.select(
        *[c for c in log.columns if c not in replaced],
        rank.isNotNull().alias("retrieval_hit"),
        rank.alias("retrieved_rank"),
        F.coalesce((rank <= top_k).cast("double"), F.lit(0.0)).alias("hit_rate_at_k"),
        *[hit_at(rank, n).alias(f"hit_rate_at_{n}") for n in cutoffs],
        (count > 0).cast("double").alias("recall_at_k"),
        (count / top_k).alias("precision_at_k"),
        reciprocal_rank(rank).alias("mrr"),
        F.coalesce(
            F.try_divide(
                F.aggregate("_sims", F.lit(0.0), lambda a, x: a + x), F.size("_sims")
            ),
            tx.to_number(logged),
        ).alias("similaridade_media_chunks"),
    )


def compare_models(questions: DataFrame, outcomes: DataFrame, models: Sequence[str]) -> DataFrame:
    """Answers of several models side by side, in the order of `models`.

    `questions` holds ``(id, chunk_count)`` of the shared search, `outcomes`
    ``(id, modelo, answer, latency_seconds, results, error, generation_metadata)``.
    A model without an outcome gets an error row; hits of the shared search
    count where a model reports none.
    """
    asked = questions.select(
        "id",
        "chunk_count",
        F.posexplode(F.array(*[F.lit(m) for m in models])).alias("ordinal", "modelo"),
    )
    joined = asked.join(outcomes, ["id", "modelo"], "left")
    failed = F.when(F.col("latency_seconds").isNull(), F.lit("no answer"))
    error = F.coalesce("error", failed)
    ok = error.isNull()
    return joined.select(
        "id",
        (F.col("ordinal") + 1).alias("ordinal"),
        "modelo",
        F.when(ok, F.nullif(tx.strip("answer"), F.lit(""))).alias("answer"),
        "latency_seconds",
        F.when(ok, F.coalesce(F.nullif("results", F.lit(0)), F.col("chunk_count")))
        .otherwise(F.col("chunk_count"))
        .alias("chunk_count"),
        F.when(ok, F.get_json_object("generation_metadata", "$.usage")).alias("tokens"),
        F.when(ok, F.get_json_object("generation_metadata", "$.metrics")).alias("metrics"),
        error.alias("error"),
        replies.format_duration(F.col("latency_seconds")).alias("duration"),
    )
