"""Experiment grid, logs, scores, summaries, rankings and figure data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import schemas
from docspark.operators import evaluate, stats
from docspark.session import checkpoint_dir
from docspark.sources import store, tables
from docspark_checks import fixtures
from docspark_checks.fixtures import duck
from docspark_checks.registry import query, table, text_table
from docspark_checks.search_queries import METRICS_SQL, _summary_sql, metrics

RETRIEVAL, GENERATION = schemas.RETRIEVAL_METRICS, schemas.GENERATION_METRICS
BOTH = (*RETRIEVAL, *GENERATION)
NUMERIC = schemas.NUMERIC_METRICS
MODELS = ("view", "purchase", "signup", "click", "error", "missing")


def _mean_sql(parts: list[str]) -> str:
    return f"list_avg(list_filter([{', '.join(parts)}], lambda v: v IS NOT NULL))"


def _clamp_sql(names: tuple[str, ...]) -> str:
    return _mean_sql(
        [f"CASE WHEN {m} IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, {m})) END" for m in names]
    )


_GEN_SQL = _mean_sql([f"{m} / 5.0::DOUBLE" for m in GENERATION])
CONS_SQL = (
    "WITH "
    + fixtures.LOG_SQL
    + f""",
 sc0 AS (SELECT *, {_clamp_sql(RETRIEVAL)} AS retrieval_quality_score, {_GEN_SQL} AS generation_quality_score,
   {_clamp_sql(schemas.CUTOFF_METRICS)} AS overall_retrieval_score, {_GEN_SQL} AS overall_generation_score FROM log),
 sc AS (SELECT *, {_mean_sql(['retrieval_quality_score', 'generation_quality_score'])} AS composite_quality_score, {_mean_sql(['overall_retrieval_score', 'overall_generation_score'])} AS overall_score FROM sc0),
 cons AS (SELECT *, len(resposta) AS response_length_chars, len(string_split(trim(resposta), ' ')) AS response_length_words, len(string_split(trim(pergunta), ' ')) AS question_length_words,
   trim(contexto) <> '' AS has_context, chunks_recuperados = 0 OR trim(contexto) = '' AS no_context_recovered, NOT retrieval_hit AS retrieval_failure,
   coalesce(groundedness_score, 5) <= 2 OR coalesce(alucinacao_score, 5) <= 2 OR coalesce(corretude_score, 5) <= 2 AS potential_hallucination,
   NOT retrieval_hit AND coalesce(generation_quality_score, 0) >= 0.8 AS correct_with_weak_retrieval,
   len(string_split(trim(resposta), ' ')) / tokens AS response_words_per_token FROM sc)"""
)


def consolidated(spark: SparkSession, sf: str) -> DataFrame:
    scored = stats.quality_scores(fixtures.log(spark, sf))
    return stats.flags(stats.quality_scores(scored, cutoffs=True))


def _r(names: tuple[str, ...]) -> str:
    return ", ".join(f"round({m}, 6) AS {m}" for m in names)


SCORES = (
    "retrieval_quality_score", "generation_quality_score", "composite_quality_score",
    "overall_retrieval_score", "overall_generation_score", "overall_score",
)


@query("quality_scores", CONS_SQL + f" SELECT row_no, {_r(SCORES)} FROM cons")
def quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    return consolidated(spark, sf).select("row_no", *SCORES)


FLAGS = (
    "response_length_chars", "response_length_words", "question_length_words", "has_context",
    "no_context_recovered", "retrieval_failure", "potential_hallucination",
    "correct_with_weak_retrieval",
)


@query(
    "row_flags",
    CONS_SQL + f" SELECT row_no, {', '.join(FLAGS)}, round(response_words_per_token, 6) AS response_words_per_token FROM cons",
)
def row_flags(spark: SparkSession, sf: str) -> DataFrame:
    return consolidated(spark, sf).select("row_no", *FLAGS, "response_words_per_token")


@query(
    "consolidate",
    """WITH g AS (SELECT 'q' || c_custkey AS id FROM customer),
 j AS (SELECT event_id, 'q' || user_id AS id, event_type AS modelo, CASE WHEN event_id % 11 = 0 THEN -1 ELSE 1 + event_id % 5 END AS groundedness_score,
   CASE WHEN event_id % 11 = 0 THEN '' ELSE 'c' || event_id END AS groundedness_comment, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'judge' END AS judge_model_id FROM events)
 SELECT j.* FROM j WHERE id IN (SELECT id FROM g)""",
)
def consolidate(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    log = events.selectExpr(
        "event_id", "'q' || CAST(user_id AS STRING) AS id", "event_type AS modelo",
        "CASE WHEN event_id % 3 > 0 THEN 'v' || CAST(event_id AS STRING) END AS variacao_retrieval",
    )
    gold = table(spark, sf, "customer").selectExpr(
        "'q' || CAST(c_custkey AS STRING) AS id", "c_custkey AS ordem"
    )
    # each key once: rows without a variant get a label of their own
    log = log.withColumn(
        "variacao_retrieval",
        F.coalesce("variacao_retrieval", F.concat(F.lit("n"), F.col("event_id").cast("string"))),
    )
    topics = [
        F.struct(
            F.expr("CAST(1 + event_id % 5 AS INT)").alias("score"),
            F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("comment"),
        ).alias(t)
        for t in schemas.JUDGE_TOPICS
    ]
    judged = log.where("event_id % 11 <> 0").select(
        "id", "variacao_retrieval", "modelo", F.struct(*topics).alias("scores"),
        F.lit("judge").alias("judge_model_id"), F.lit("raw").alias("judge_raw_answer"),
    )
    return stats.consolidate(log, gold, judged).select(
        "event_id", "id", "modelo",
        F.coalesce("groundedness_score", F.lit(-1)).alias("groundedness_score"),
        "groundedness_comment", "judge_model_id",
    )


@query(
    "clean_numeric",
    """SELECT event_id, CASE WHEN event_id % 5 < 3 THEN value END AS value FROM events""",
)
def clean_numeric(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE event_id % 5 WHEN 3 THEN 'NaN' WHEN 4 THEN IF(event_id % 2 = 0, 'Infinity', 'n/a') "
        "ELSE CAST(value AS STRING) END AS value",
    )
    return stats.clean_numeric(raw, ["value"])


_BY = "grupo, variacao_retrieval, modelo"


@query(
    "group_summary_ci",
    CONS_SQL
    + f", l AS (SELECT *, 'retrieval' AS grupo FROM cons), dense AS (SELECT * FROM (SELECT DISTINCT variacao_retrieval FROM cons), (SELECT DISTINCT modelo FROM cons)), "
    f"s AS ({_summary_sql(BOTH, 'l', _BY)}), ms AS (SELECT DISTINCT metric FROM s) "
    "SELECT 'retrieval' AS grupo, d.variacao_retrieval, d.modelo, ms.metric, coalesce(mean, 0) AS mean, coalesce(ci95_low, 0) AS ci95_low, coalesce(ci95_high, 0) AS ci95_high, coalesce(std, 0) AS std, coalesce(n, 0) AS n "
    "FROM dense d CROSS JOIN ms LEFT JOIN s ON s.variacao_retrieval = d.variacao_retrieval AND s.modelo = d.modelo AND s.metric = ms.metric",
)
def group_summary_ci(spark: SparkSession, sf: str) -> DataFrame:
    return stats.group_summary(consolidated(spark, sf), BOTH, "retrieval")


def _wide_sql(names: tuple[str, ...]) -> str:
    return ", ".join(
        f"round(avg({m}), 6) AS {m}_mean, round(avg({m}) - 1.96 * stddev_samp({m}) / sqrt(count({m})), 6) AS {m}_ci95_low, "
        f"round(avg({m}) + 1.96 * stddev_samp({m}) / sqrt(count({m})), 6) AS {m}_ci95_high, round(stddev_samp({m}), 6) AS {m}_std, count({m}) AS {m}_n"
        for m in names
    )


@query(
    "variant_summary",
    CONS_SQL + f" SELECT 'retrieval' AS grupo, variacao_retrieval, {_wide_sql(RETRIEVAL)} FROM cons GROUP BY variacao_retrieval",
)
def variant_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.variant_summary(consolidated(spark, sf), RETRIEVAL, "retrieval")


_LONG_MEANS = " UNION ALL ".join(
    f"SELECT variacao_retrieval, '{m}' AS metric, avg({m}) AS mean FROM cons GROUP BY variacao_retrieval"
    for m in BOTH
)
_MEANS = ", ".join(f"avg({m})::DOUBLE AS {m}" for m in BOTH)


def _delta_sql(cons: str, chosen: str) -> str:
    """One grouped pass, then an unpivot; `chosen` says which variant is the baseline."""
    return (
        cons
        + f""", w AS (SELECT variacao_retrieval, min(row_no) AS first_row, {_MEANS} FROM cons GROUP BY variacao_retrieval),
 m AS (UNPIVOT w ON {', '.join(BOTH)} INTO NAME metric VALUE mean),
 b AS (SELECT metric, mean AS baseline FROM m WHERE {chosen})
 SELECT variacao_retrieval, metric, round(mean, 6) AS mean, round(baseline, 6) AS baseline, round(mean - baseline, 6) + 0.0 AS delta_absoluto,
 round(CASE WHEN baseline <> 0 THEN (mean - baseline) / baseline * 100 END, 6) + 0.0 AS ganho_percentual FROM m JOIN b USING (metric)"""
    )


@query("baseline_delta", _delta_sql(CONS_SQL, "variacao_retrieval = 'baseline'"))
def baseline_delta(spark: SparkSession, sf: str) -> DataFrame:
    summary = stats.variant_summary(consolidated(spark, sf), BOTH, "all")
    return stats.baseline_delta(summary, BOTH)


@query(
    "first_seen_delta",
    _delta_sql(CONS_SQL.replace("'baseline'", "'base'"), "first_row = (SELECT min(first_row) FROM w)"),
)
def first_seen_delta(spark: SparkSession, sf: str) -> DataFrame:
    renamed = consolidated(spark, sf).replace({"baseline": "base"}, subset=["variacao_retrieval"])
    summary = stats.variant_summary(renamed, BOTH, "all")
    return stats.baseline_delta(summary, BOTH, stats.first_variant(renamed, "row_no"))


@query("model_summary", CONS_SQL + " " + _summary_sql(RETRIEVAL, "cons", "modelo"))
def model_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.model_summary(consolidated(spark, sf), RETRIEVAL)


_QUALITY = ("composite_quality_score", "retrieval_quality_score", "generation_quality_score")


@query(
    "model_ranking",
    CONS_SQL
    + f""" SELECT modelo, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _QUALITY)},
 row_number() OVER (ORDER BY {', '.join(f'avg({m}) DESC NULLS LAST' for m in _QUALITY)}, modelo) AS rank FROM cons GROUP BY modelo""",
)
def model_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return stats.rank_models(consolidated(spark, sf))


@query(
    "best_variant",
    CONS_SQL
    + f""", m AS ({_LONG_MEANS}) SELECT metric, arg_max(variacao_retrieval, mean) AS best, round(max(mean), 6) AS mean, round(max(mean) - min(mean), 6) AS spread FROM m GROUP BY metric""",
)
def best_variant(spark: SparkSession, sf: str) -> DataFrame:
    return stats.best_variant(consolidated(spark, sf), BOTH)


_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in NUMERIC)


@query("model_matrix", CONS_SQL + f" SELECT modelo, {_MEANS} FROM cons GROUP BY modelo")
def model_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return stats.model_matrix(consolidated(spark, sf))


@query(
    "dense_ranking",
    CONS_SQL
    + f" SELECT modelo, {_MEANS}, dense_rank() OVER (ORDER BY avg(overall_score) DESC) AS rank FROM cons GROUP BY modelo",
)
def dense_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return stats.ranking(consolidated(spark, sf))


_RATES = (
    "no_context_recovered", "retrieval_failure", "potential_hallucination",
    "correct_with_weak_retrieval",
)
_PROFILE_MEANS = (
    *(f"round(avg({m}), 6) AS {m}" for m in (
        "similaridade_media_chunks", "overall_retrieval_score", "overall_generation_score",
        "overall_score", *GENERATION)),
    *(f"round(avg({m}::INT), 6) AS {m}" for m in _RATES),
)


@query(
    "model_profile",
    CONS_SQL
    + f""" SELECT modelo, count(id) AS n_respostas, count(DISTINCT id) AS n_questoes, round(avg(tempo_resposta_s), 6) AS tempo_medio_resposta_s,
 round(quantile_cont(tempo_resposta_s, 0.5), 6) AS tempo_mediano_resposta_s, round(avg(input_tokens), 6) AS input_tokens_medio, round(avg(output_tokens), 6) AS output_tokens_medio,
 round(avg(tokens), 6) AS tokens_medios, round(sum(tokens), 6) AS tokens_totais, round(avg(response_length_chars), 6) AS resposta_media_chars, round(avg(response_length_words), 6) AS resposta_media_words,
 round(avg(retrieval_hit::INT), 6) AS retrieval_hit_rate, {', '.join(_PROFILE_MEANS)} FROM cons GROUP BY modelo""",
)
def model_profile(spark: SparkSession, sf: str) -> DataFrame:
    return stats.model_profile(consolidated(spark, sf))


@query(
    "general_stats",
    CONS_SQL
    + """ SELECT count(DISTINCT id) AS numero_perguntas, count(DISTINCT modelo) AS numero_modelos_avaliados, count(*) AS numero_respostas, round(avg(tempo_resposta_s), 6) AS tempo_medio_global_s,
 round(sum(input_tokens), 6) AS tokens_entrada_total, round(sum(output_tokens), 6) AS tokens_saida_total, round(sum(tokens), 6) AS tokens_totais_total,
 round(avg(response_length_chars), 6) AS resposta_media_chars, round(avg(response_length_words), 6) AS resposta_media_words,
 (SELECT round(avg(t), 6) FROM (SELECT avg(tempo_resposta_s) AS t FROM cons GROUP BY modelo)) AS tempo_medio_por_modelo_s FROM cons""",
)
def general_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.general_stats(consolidated(spark, sf))


@query(
    "describe_metrics",
    CONS_SQL
    + " "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std, round(min({m})::DOUBLE, 6) AS min, round(max({m})::DOUBLE, 6) AS max FROM cons"
        for m in NUMERIC
    ),
)
def describe_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return stats.describe_metrics(consolidated(spark, sf))


def _case_sql(name: str, condition: str | None, keys: tuple[tuple[str, bool], ...]) -> str:
    order = ", ".join(f"{k} {'ASC' if up else 'DESC'} NULLS LAST" for k, up in keys)
    where = f"WHERE {condition}" if condition else ""
    return (
        f"(SELECT '{name}' AS case_type, row_number() OVER (ORDER BY {order}, id, modelo, variacao_retrieval, row_no) AS position, row_no, id, modelo, round(overall_score, 6) AS overall_score FROM cons {where} "
        f"ORDER BY {order}, id, modelo, variacao_retrieval, row_no LIMIT 5)"
    )


CASES_SQL = CONS_SQL + " " + " UNION ALL ".join(_case_sql(*c) for c in stats.CASES)


@query("interesting_cases", CASES_SQL)
def interesting_cases(spark: SparkSession, sf: str) -> DataFrame:
    return stats.interesting_cases(consolidated(spark, sf)).select(
        "case_type", "position", "row_no", "id", "modelo", "overall_score"
    )


@query(
    "case_counts",
    CONS_SQL
    + " "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS case_type, least(count(*), 5) AS n FROM cons {'WHERE ' + c if c else ''}"
        for name, c, _ in stats.CASES
    ),
)
def case_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.case_counts(stats.interesting_cases(consolidated(spark, sf)))


@query(
    "k_curves",
    CONS_SQL
    + """, ks AS (SELECT unnest(range(1, least(greatest(max(top_k), max(retrieved_rank), 5), 10) + 1)) AS k FROM cons)
 SELECT modelo, k, round(count(*) FILTER (retrieved_rank <= k) / count(retrieved_rank), 6) AS hit_rate, round(count(*) FILTER (retrieved_rank <= k) / count(retrieved_rank) / k, 6) AS precision,
 round(count(*) FILTER (retrieved_rank <= k) / count(retrieved_rank), 6) AS recall FROM cons, ks GROUP BY modelo, k""",
)
def k_curves(spark: SparkSession, sf: str) -> DataFrame:
    return stats.k_curves(consolidated(spark, sf))


@query(
    "corr_matrix",
    CONS_SQL
    + " "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS metric_x, '{b}' AS metric_y, round(CASE WHEN isnan(coalesce(corr({a}, {b}), 0)) THEN 0 ELSE coalesce(corr({a}, {b}), 0) END, 6) AS corr FROM cons"
        for a in NUMERIC
        for b in NUMERIC
    ),
)
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return stats.corr_matrix(consolidated(spark, sf))


@query(
    "histogram",
    CONS_SQL
    + """, b AS (SELECT min(tempo_resposta_s) AS lo, (max(tempo_resposta_s) - min(tempo_resposta_s)) / 20 AS w FROM cons),
 c AS (SELECT least(floor((tempo_resposta_s - lo) / w), 19)::INT AS bin, count(*) AS n FROM cons, b GROUP BY 1)
 SELECT i AS bin, round(lo + i * w, 6) AS bin_from, round(lo + (i + 1) * w, 6) AS bin_to, coalesce(n, 0) AS n FROM range(20) t(i) CROSS JOIN b LEFT JOIN c ON c.bin = i""",
)
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.histogram(consolidated(spark, sf), "tempo_resposta_s")


@query(
    "quartiles",
    CONS_SQL
    + """ SELECT modelo, round(min(tempo_resposta_s), 6) AS minimum, round(quantile_cont(tempo_resposta_s, 0.25), 6) AS q1, round(quantile_cont(tempo_resposta_s, 0.5), 6) AS median,
 round(quantile_cont(tempo_resposta_s, 0.75), 6) AS q3, round(max(tempo_resposta_s), 6) AS maximum FROM cons GROUP BY modelo""",
)
def quartiles(spark: SparkSession, sf: str) -> DataFrame:
    return stats.quartiles(consolidated(spark, sf), "tempo_resposta_s")


_RADAR = (
    ("retrieval", "overall_retrieval_score"), ("generation", "overall_generation_score"),
    ("hit_at_1", "hit_rate_at_1"), ("mrr", "mrr"), ("similarity", "similaridade_media_chunks"),
    ("overall", "overall_score"),
)


@query(
    "radar",
    CONS_SQL + f" SELECT modelo, {', '.join(f'round(coalesce(avg({c}), 0), 6) AS {n}' for n, c in _RADAR)} FROM cons GROUP BY modelo",
)
def radar(spark: SparkSession, sf: str) -> DataFrame:
    return stats.radar(consolidated(spark, sf))


@query(
    "scatter",
    CONS_SQL + " SELECT modelo, round(coalesce(tokens, 0), 6) AS x, round(coalesce(overall_score, 0), 6) AS y FROM cons",
)
def scatter(spark: SparkSession, sf: str) -> DataFrame:
    return stats.scatter(consolidated(spark, sf), "tokens", "overall_score")


@query(
    "hit_rate_by_model",
    CONS_SQL + " SELECT modelo, round(avg(retrieval_hit::INT), 6) AS retrieval_hit FROM cons GROUP BY modelo",
)
def hit_rate_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return stats.mean_by_model(consolidated(spark, sf), "retrieval_hit")


def _model_means(names: tuple[str, ...]) -> str:
    # the mean over the dense grid: a model without values counts as 0
    return " UNION ALL ".join(
        f"SELECT variacao_retrieval, '{m}' AS metric, modelo, coalesce(avg({m}), 0) AS mean FROM cons GROUP BY variacao_retrieval, modelo"
        for m in names
    )


@query(
    "metric_means",
    CONS_SQL
    + f", mm AS ({_model_means(RETRIEVAL)}) SELECT variacao_retrieval, metric, round(sum(mean) / (SELECT count(DISTINCT modelo) FROM cons), 6) AS mean FROM mm GROUP BY ALL",
)
def metric_means(spark: SparkSession, sf: str) -> DataFrame:
    summary = stats.group_summary(consolidated(spark, sf), RETRIEVAL, "retrieval")
    return stats.metric_means(summary)


_COMPOSITE_SQL = (
    CONS_SQL
    + f""", rm AS ({_model_means(RETRIEVAL)}), gm AS ({_model_means(GENERATION)}), n AS (SELECT count(DISTINCT modelo) AS n FROM cons),
 r AS (SELECT variacao_retrieval, sum(mean) / (max(n) * {len(RETRIEVAL)}) AS r FROM rm, n GROUP BY 1), g AS (SELECT variacao_retrieval, sum(mean) / (max(n) * {len(GENERATION)}) AS g FROM gm, n GROUP BY 1),
 comp AS (SELECT list_position(['baseline', 'baseline_traduzido', 'topk_aumentado', 'topk_aumentado_traduzido'], variacao_retrieval) AS ordem, variacao_retrieval, (r + g) / 2 AS score FROM r JOIN g USING (variacao_retrieval))"""
)


def _composite(spark: SparkSession, sf: str) -> DataFrame:
    rows = consolidated(spark, sf)
    return stats.variant_composite(
        stats.group_summary(rows, RETRIEVAL, "retrieval"),
        stats.group_summary(rows, GENERATION, "generation"),
    )


@query(
    "variant_composite",
    _COMPOSITE_SQL + " SELECT ordem, variacao_retrieval, round(score, 6) AS score_composto FROM comp",
)
def variant_composite(spark: SparkSession, sf: str) -> DataFrame:
    return _composite(spark, sf)


@query(
    "minmax",
    _COMPOSITE_SQL
    + " SELECT variacao_retrieval, round(score, 6) AS score_composto, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS score_normalizado FROM comp",
)
def minmax(spark: SparkSession, sf: str) -> DataFrame:
    return stats.minmax(_composite(spark, sf), "score_composto", "score_normalizado").drop("ordem")


@query(
    "model_composite",
    CONS_SQL
    + f" SELECT list_position({list(MODELS)}, modelo) AS ordem, modelo, round(avg(composite_quality_score), 6) AS composite_quality_score FROM cons WHERE modelo IN {MODELS} GROUP BY modelo",
)
def model_composite(spark: SparkSession, sf: str) -> DataFrame:
    return stats.model_composite(consolidated(spark, sf), MODELS)


# ---- grid, logs, comparison


@query(
    "experiment_grid",
    """SELECT item_id, variacao_retrieval, top_k, translate_query, modelo FROM benchmark,
 (VALUES ('baseline', 4, false), ('baseline_traduzido', 4, true), ('topk_aumentado', 10, false), ('topk_aumentado_traduzido', 10, true)) v(variacao_retrieval, top_k, translate_query),
 (VALUES ('a'), ('b'), ('c')) m(modelo)""",
)
def experiment_grid(spark: SparkSession, sf: str) -> DataFrame:
    gold = table(spark, sf, "benchmark").select("item_id")
    return evaluate.grid(gold, evaluate.variants(), ["a", "b", "c"]).drop("variacao_descricao")


_EV = "CAST(event_id % {0} AS STRING)"
_JSON = (
    "CASE WHEN event_id % 10 = 0 THEN 'not json' ELSE '[{\"rank\":1,\"source_path\":\"docs_markdown/class_' || "
    + _EV.format(7)
    + " || '.md\"},{\"source_path\":\"C:/x/Docs_Markdown/class_' || "
    + _EV.format(5)
    + " || '.md\"},\"bad\",{\"source_path\":\"docs_markdown/class_' || "
    + _EV.format(3)
    + " || '.md\"}]' END"
)


@query(
    "metrics_from_log",
    """WITH x AS (SELECT event_id, 'q' || user_id AS id, user_id % 7 AS g, event_id % 10 = 0 AS broken, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 2 END AS k, value FROM events WHERE user_id IN (SELECT c_custkey FROM customer)),
 p AS (SELECT *, CASE WHEN broken THEN []::INT[] ELSE list_filter([CASE WHEN event_id % 7 = g THEN 1 END, CASE WHEN event_id % 5 = g THEN 2 END, CASE WHEN event_id % 3 = g THEN 4 END], lambda v: v IS NOT NULL) END AS places,
   coalesce(k, CASE WHEN broken THEN 1 ELSE 4 END) AS kk FROM x)
 SELECT event_id, id, len(places) > 0 AS retrieval_hit, coalesce(places[1], -1) AS retrieved_rank, CASE WHEN places[1] <= kk THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate_at_k,
 CASE WHEN places[1] <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate_at_1, CASE WHEN places[1] <= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate_at_3, CASE WHEN places[1] <= 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate_at_4,
 CASE WHEN len(places) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_at_k, round(len(places) / kk, 6) AS precision_at_k, round(coalesce(1.0::DOUBLE / places[1], 0.0), 6) AS mrr,
 round(CASE WHEN event_id % 6 = 0 THEN value ELSE 0.375 END, 6) AS similaridade_media_chunks FROM p""",
)
def metrics_from_log(spark: SparkSession, sf: str) -> DataFrame:
    log = text_table(spark, sf, "events").select(
        "event_id",
        F.expr("'q' || CAST(user_id AS STRING)").alias("id"),
        F.expr(_JSON).alias("chunks_recuperados_json"),
        F.expr("CASE WHEN event_id % 6 = 0 THEN '[null]' ELSE '[0.5,null,0.25]' END").alias(
            "similaridades_chunks"
        ),
        F.expr("CASE WHEN event_id % 4 = 0 THEN NULL ELSE 2 END").alias("top_k"),
        F.col("value").alias("similaridade_media_chunks"),
    )
    gold = table(spark, sf, "customer").selectExpr(
        "'q' || CAST(c_custkey AS STRING) AS id",
        "'base/docs_markdown/Class_' || CAST(c_custkey % 7 AS STRING) || '.md' AS source_path",
        "c_custkey AS ordem",
    )
    out = evaluate.metrics_from_log(log, gold).drop(
        "chunks_recuperados_json", "similaridades_chunks", "top_k"
    )
    return out.withColumn("retrieved_rank", F.coalesce("retrieved_rank", F.lit(-1)))


_LOG_TOP = "CASE WHEN variacao_retrieval = 'baseline' THEN 4 ELSE 10 END"


@query(
    "result_log",
    METRICS_SQL
    + f""",
 c AS (SELECT q.vec_id AS id, variacao_retrieval, '[' || string_agg('"docs_markdown/class_' || c.label || '.md"', ',' ORDER BY rank) || ']' AS paths, round(sum(distance), 6) AS distances,
   round(sum(1.0 / (1.0 + distance)), 6) AS similarities FROM e q, variants JOIN hits h ON h.query_id = q.vec_id AND h.rank <= top_k JOIN e c ON c.vec_id = h.id GROUP BY ALL),
 x AS (SELECT event_id, event_id % (SELECT count(*) FROM embeddings) AS vec_id, CASE WHEN event_id // (SELECT count(*) FROM embeddings) % 2 = 0 THEN 'baseline' ELSE 'topk_aumentado' END AS variacao_retrieval, event_type, value, props FROM events)
 SELECT x.event_id, CAST(vec_id AS VARCHAR) AS id, 'Q ' || vec_id AS pergunta, 'Q ' || vec_id AS refraseamento, x.variacao_retrieval, CASE WHEN x.variacao_retrieval = 'baseline' THEN 'Linha de base sem tradução e com Top-K reduzido.' ELSE 'Top-K ampliado sem tradução.' END AS variacao_descricao,
 '{{}}' AS query_translation, 'ideal' AS resposta_ideal, 'docs_markdown/class_' || label || '.md' AS source_path_ground_truth, 't' AS titulo_documento, 's' AS secao, 'consulta' AS categoria, 'facil' AS dificuldade, event_type AS modelo, props AS resposta,
 round(value, 6) AS tempo_resposta_s, 10 AS input_tokens, event_id AS output_tokens, 10 + event_id AS tokens, CAST(top_k AS BIGINT) AS top_k, false AS translate_query, chunks_recuperados, top_k AS json_items, distances AS json_distance, paths AS source_paths_chunks,
 similarities AS json_similarity, round(similaridade_media_chunks, 6) AS similaridade_media_chunks, coalesce(retrieved_rank, -1) AS retrieved_rank, retrieved_rank IS NOT NULL AS retrieval_hit, hit_rate_at_k, recall_at_k, round(precision_at_k, 6) AS precision_at_k, round(mrr, 6) AS mrr,
 false AS context_truncated, 'event ' || event_id AS contexto, '{{"usage":{{"inputTokens":10,"outputTokens":' || event_id || '}}}}' AS generation_metadata, len(props) AS answer_length, len('Q ' || vec_id) AS question_length
 FROM x JOIN r ON r.id = vec_id AND r.variacao_retrieval = x.variacao_retrieval JOIN c ON c.id = vec_id AND c.variacao_retrieval = x.variacao_retrieval""",
)
def result_log(spark: SparkSession, sf: str) -> DataFrame:
    """All 36 columns for every event; JSON texts are compared by what they hold."""
    vec = table(spark, sf, "embeddings")
    gold = vec.selectExpr(
        "CAST(vec_id AS STRING) AS id", "'Q ' || vec_id AS pergunta", "'ideal' AS resposta_ideal",
        "'docs_markdown/class_' || label || '.md' AS source_path", "'t' AS titulo_documento",
        "'s' AS secao", "'consulta' AS categoria", "'facil' AS dificuldade",
    )
    retrieval = metrics(spark, sf, with_json=True).withColumn("id", F.col("id").cast("string"))
    # one row
    number = vec.agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(1))
    events = table(spark, sf, "events").withColumn("_k", F.lit(1)).join(F.broadcast(number), "_k")
    answers = events.selectExpr(
        "CAST(event_id % n AS STRING) AS id",
        "CASE WHEN event_id DIV n % 2 = 0 THEN 'baseline' ELSE 'topk_aumentado' END AS variacao_retrieval",
        "event_type AS modelo", "props AS resposta", "value AS tempo_resposta_s",
        "'{\"usage\":{\"inputTokens\":10,\"outputTokens\":' || event_id || '}}' AS generation_metadata",
        "'event ' || event_id AS contexto", "CAST(NULL AS BOOLEAN) AS context_truncated",
    )
    log = evaluate.result_log(gold, retrieval, answers)
    chunks = F.from_json("chunks_recuperados_json", "array<struct<distance:double>>")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    return log.select(
        F.substring("contexto", 7, 20).cast("bigint").alias("event_id"),
        *[c for c in log.columns if c not in ("chunks_recuperados_json", "similaridades_chunks", "retrieved_rank")],
        F.coalesce("retrieved_rank", F.lit(-1)).alias("retrieved_rank"),
        F.size(chunks).alias("json_items"), total(F.transform(chunks, lambda c: c["distance"])).alias("json_distance"),
        total(F.from_json("similaridades_chunks", "array<double>")).alias("json_similarity"),
    )


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_LOG_TEXT = "'line 1 \"' || event_type || '\"' || chr(10) || 'line, 2 ' || props"


@query(
    "log_round_trip",
    f"""SELECT 'q' || event_id AS id, {_LOG_TEXT} AS resposta, event_type AS modelo, CASE WHEN event_id % 2 = 0 THEN 'production' ELSE 'v' || user_id END AS variacao_retrieval,
 round(value, 6) AS tempo_resposta_s, CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id END AS tokens, event_id % 3 = 0 AS retrieval_hit FROM events""",
)
def log_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A quarter of the log is stored as a table, one as CSV, half as CSV in the older form without variants."""
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "'q' || event_id AS id", f"{_LOG_TEXT.replace('chr(10)', 'char(10)')} AS resposta", "event_type AS modelo",
        "'v' || user_id AS variacao_retrieval", "round(value, 6) AS tempo_resposta_s",
        "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id END AS tokens", "event_id % 3 = 0 AS retrieval_hit",
    )
    full = store.align_schema(rows.where("event_id % 2 = 1"), schemas.LOG)
    stored, new, old = _scratch(spark, "log"), _scratch(spark, "log"), _scratch(spark, "log")
    first = F.substring("id", 2, 20).cast("bigint") % 4 == 1
    tables.write_log(full.where(first), stored, "parquet")
    tables.write_log(full.where(~first), new, "csv")
    older = [c for c in schemas.LOG_COLUMNS if c != "variacao_retrieval"]
    tables.write_csv(store.align_schema(rows.where("event_id % 2 = 0"), schemas.LOG), old, older)
    all_ = tables.read_log(spark, stored, fmt="parquet")
    for path in (new, old):
        all_ = all_.unionByName(tables.read_log(spark, path, fmt="csv"))
    return all_.select(
        "id", "resposta", "modelo", "variacao_retrieval", "tempo_resposta_s",
        F.coalesce("tokens", F.lit(-1)).alias("tokens"), "retrieval_hit",
    )


@query(
    "gold_round_trip",
    """SELECT 'g' || doc_id AS id, text AS resposta_ideal, [source, lang] AS palavras_chave, doc_id AS ordem FROM documents""",
)
def gold_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").selectExpr(
        "'g' || doc_id AS id", "text AS resposta_ideal", "array(source, lang) AS palavras_chave", "CAST(doc_id AS INT) AS ordem"
    )
    path = _scratch(spark, "gold")
    tables.write_gold(store.align_schema(rows, schemas.GOLD), path)
    return tables.read_gold(spark, path).select("id", "resposta_ideal", "palavras_chave", "ordem")


@query(
    "report_round_trip",
    "SELECT o_orderpriority AS name, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1",
)
def report_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    report = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean")
    )
    folder = _scratch(spark, "reports")
    tables.write_report(report, folder, "r")
    options = {"header": "true", "quote": '"', "escape": '"'}
    return spark.read.options(**options).schema("name string, n bigint, mean double").csv(f"{folder}/r")


@query(
    "schema_round_trip",
    """SELECT 'd' || doc_id AS source_path, source AS nome_software, CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END AS nome_arquivo FROM documents""",
)
def schema_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A stored table whose older half lacks a column."""
    rows = table(spark, sf, "documents").selectExpr("doc_id", "'d' || doc_id AS source_path", "source AS nome_software", "lang AS nome_arquivo")
    path = _scratch(spark, "table")
    rows.where("doc_id % 2 = 0").drop("doc_id", "nome_arquivo").write.parquet(path)
    rows.where("doc_id % 2 = 1").drop("doc_id").write.mode("append").parquet(path)
    found = tables.read_table(spark, path, schemas.DOCUMENTS)
    return found.select("source_path", "nome_software", F.coalesce("nome_arquivo", F.lit("")).alias("nome_arquivo"))


@query(
    "compare_models",
    duck(f"""WITH o AS (SELECT 'u' || user_id AS id, event_type AS modelo, arg_max(value, event_id) AS latency, arg_max(props, event_id) AS answer, max(event_id) AS last FROM events GROUP BY ALL),
 q AS (SELECT DISTINCT 'u' || user_id AS id FROM events), m AS (SELECT unnest({list(MODELS)}) AS modelo, unnest(range(1, {len(MODELS)} + 1)) AS ordinal)
 SELECT q.id, ordinal, m.modelo, CASE WHEN last % 7 > 0 THEN answer ELSE '' END AS answer, round(latency, 6) AS latency_seconds, CASE WHEN last % 7 > 0 AND last % 3 > 0 THEN last % 3 ELSE 9 END AS chunk_count,
 CASE WHEN last IS NULL THEN 'no answer' WHEN last % 7 = 0 THEN 'timeout' ELSE '' END AS error FROM q CROSS JOIN m LEFT JOIN o ON o.id = q.id AND o.modelo = m.modelo"""),
)
def compare_models(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn(
        "id", F.concat(F.lit("u"), F.col("user_id").cast("string"))
    )
    questions = events.groupBy("id").agg(F.lit(9).cast("bigint").alias("chunk_count"))
    outcomes = (
        events.groupBy("id", F.col("event_type").alias("modelo"))
        .agg(
            F.max_by("value", "event_id").alias("latency_seconds"),
            F.max_by("props", "event_id").alias("answer"),
            F.max("event_id").alias("last"),
        )
        .withColumn("results", F.col("last") % 3)
        .withColumn("error", F.when(F.col("last") % 7 == 0, "timeout"))
        .withColumn("generation_metadata", F.lit("{}"))
    )
    return evaluate.compare_models(questions, outcomes, MODELS).select(
        "id", "ordinal", "modelo", F.coalesce("answer", F.lit("")).alias("answer"),
        "latency_seconds", "chunk_count", F.coalesce("error", F.lit("")).alias("error"),
    )
