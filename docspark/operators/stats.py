"""Consolidated results to summaries, deltas, rankings and figure data.

Everything groups by a handful of variants and models, so partial aggregation
does the work before the shuffle; windows without a partition run on rows that
are already aggregated. Medians and quartiles are exact without collecting the
values of a group (see `quantiles`).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as tx
from docspark.functions.fold import bind
from docspark.operators.evaluate import reciprocal_rank
from docspark.schemas import (
    CUTOFF_METRICS,
    GENERATION_METRICS,
    JUDGE_TOPICS,
    NUMERIC_METRICS,
    RETRIEVAL_METRICS,
)

# Interval factor, scale of the judge, thresholds and labels.
Z95 = 1.96
JUDGE_SCALE = 5.0
HALLUCINATION_AT_MOST = 2
STRONG_ANSWER = 0.8
BASELINE = "baseline"
PRODUCTION = "production"
VARIANT_ORDER = ("baseline", "baseline_traduzido", "topk_aumentado", "topk_aumentado_traduzido")
# case list: (rows it looks at, sort keys with True for ascending)
CASES = (
    ("melhores_respostas", None, (("overall_score", False),)),
    ("piores_respostas", None, (("overall_score", True),)),
    ("maiores_similaridades", None, (("similaridade_media_chunks", False),)),
    ("menores_similaridades", None, (("similaridade_media_chunks", True),)),
    (
        "potencial_alucinacao", "potential_hallucination",
        (("overall_score", True), ("groundedness_score", True)),
    ),
    ("retrieval_failure", "retrieval_failure", (("overall_score", True),)),
    (
        "correta_com_recuperacao_ruim", "correct_with_weak_retrieval",
        (("overall_generation_score", False), ("overall_score", False)),
    ),
)
CASE_COLUMNS = (
    "id", "modelo", "pergunta", "resposta", "resposta_ideal", "retrieved_rank", "retrieval_hit",
    "similaridade_media_chunks", "overall_score", "overall_retrieval_score",
    "overall_generation_score", *GENERATION_METRICS, "tempo_resposta_s", "tokens", "input_tokens",
    "output_tokens", "chunks_recuperados", "context_truncated", "no_context_recovered",
    "potential_hallucination",
)


# ------------------------------------------------------------ consolidation


def consolidate(log: DataFrame, gold: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Log rows whose question is in the gold table, with judge scores.

    `judged` holds ``(id, variacao_retrieval, modelo, judge_model_id,
    judge_raw_answer, scores)`` with `scores` from `replies.judge_scores`.
    Without it the scores are null and the comments empty.
    """
    first = gold.groupBy("id").agg(F.min("ordem").alias("_first"))
    base = log.withColumn(
        "variacao_retrieval", F.coalesce("variacao_retrieval", F.lit(PRODUCTION))
    ).join(first.select("id"), "id")
    if judged is None:
        scores = [F.lit(None).cast("int").alias(m) for m in GENERATION_METRICS]
        comments = [F.lit("").alias(f"{t}_comment") for t in JUDGE_TOPICS]
        return base.select(
            "*", *scores, *comments, F.lit("").alias("judge_model_id"),
            F.lit("").alias("judge_raw_answer"),
        )
    keys = ["id", "variacao_retrieval", "modelo"]
    joined = base.join(
        judged.select(*keys, "scores", "judge_model_id", "judge_raw_answer"), keys, "left"
    )
    return joined.select(
        *base.columns,
        *[F.col(f"scores.{t}.score").alias(f"{t}_score") for t in JUDGE_TOPICS],
        *[
            F.coalesce(F.col(f"scores.{t}.comment"), F.lit("")).alias(f"{t}_comment")
            for t in JUDGE_TOPICS
        ],
        F.coalesce("judge_model_id", F.lit("")).alias("judge_model_id"),
        F.coalesce("judge_raw_answer", F.lit("")).alias("judge_raw_answer"),
    )


def clean_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles; text that is no number, NaN and infinities as null."""
    return df.withColumns({c: tx.to_number(F.col(c)) for c in columns if c in df.columns})


def mean_present(values: Sequence[Column]) -> Column:
    """Mean of the values that are present, null if there is none."""
    return bind(
        F.filter(F.array(*values), lambda v: v.isNotNull()),
        lambda vs: F.try_divide(F.aggregate(vs, F.lit(0.0), lambda a, v: a + v), F.size(vs)),
    )


def _number(c: str) -> Column:
    return tx.to_number(F.col(c))


def retrieval_score(metrics: Sequence[str] = RETRIEVAL_METRICS) -> Column:
    return mean_present([_clamped(_number(m)) for m in metrics])


def _clamped(v: Column) -> Column:
    # greatest and least skip nulls, so a missing value must stay missing
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def generation_score() -> Column:
    return mean_present([_number(m) / JUDGE_SCALE for m in GENERATION_METRICS])


def quality_scores(df: DataFrame, cutoffs: bool = False) -> DataFrame:
    """Retrieval, generation and composite score of a row, each a mean of what is there.

    The default set has five retrieval metrics and `*_quality_score` names;
    with `cutoffs` it is the set of seven with `overall_*` names.
    """
    names = (
        ("overall_retrieval_score", "overall_generation_score", "overall_score")
        if cutoffs
        else ("retrieval_quality_score", "generation_quality_score", "composite_quality_score")
    )
    scored = df.withColumn(
        names[0], retrieval_score(CUTOFF_METRICS if cutoffs else RETRIEVAL_METRICS)
    ).withColumn(names[1], generation_score())
    return scored.withColumn(names[2], mean_present([F.col(names[0]), F.col(names[1])]))


def flags(df: DataFrame, generation: str = "generation_quality_score") -> DataFrame:
    """Lengths, and what went wrong or right in a row."""

    def text_of(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    def low(metric: str) -> Column:
        score = F.coalesce(F.col(metric).cast("double"), F.lit(JUDGE_SCALE))
        return score <= HALLUCINATION_AT_MOST

    has_context = ~tx.is_blank(text_of("contexto"))
    hit = F.coalesce(F.col("retrieval_hit"), F.lit(False))
    words = tx.word_count(F.col("resposta"))
    return df.select(
        "*",
        F.length(text_of("resposta")).alias("response_length_chars"),
        words.alias("response_length_words"),
        tx.word_count(F.col("pergunta")).alias("question_length_words"),
        has_context.alias("has_context"),
        (
            (F.coalesce(F.col("chunks_recuperados").cast("double"), F.lit(0.0)) == 0) | ~has_context
        ).alias("no_context_recovered"),
        (~hit).alias("retrieval_failure"),
        (low("groundedness_score") | low("alucinacao_score") | low("corretude_score")).alias(
            "potential_hallucination"
        ),
        (~hit & (F.coalesce(F.col(generation), F.lit(0.0)) >= STRONG_ANSWER)).alias(
            "correct_with_weak_retrieval"
        ),
        F.when(F.col("tokens") > 0, words / F.col("tokens")).alias("response_words_per_token"),
    )


# ------------------------------------------------------------ means and intervals


def mean_ci(value: Column) -> dict[str, Column]:
    """Mean, 95 % interval, standard deviation and number of the present values.

    No value gives zeros; a single value has no spread.
    """
    n = F.count(value)
    mean = F.coalesce(F.avg(value), F.lit(0.0))
    std = F.when(n >= 2, F.stddev_samp(value)).otherwise(F.lit(0.0))
    margin = F.when(n >= 2, F.lit(Z95) * std / F.sqrt(n)).otherwise(F.lit(0.0))
    return {
        "mean": mean, "ci95_low": mean - margin, "ci95_high": mean + margin, "std": std, "n": n,
    }


def _as_numbers(metrics: Sequence[str]) -> list[Column]:
    return [_number(m).alias(m) for m in metrics]


def _label(c: str, default: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(default)).alias(c)


#: Combinations of labels of a dense summary at most; a summary of more is an error.
MAX_COMBINATIONS = 1_000_000


def group_summary(
    df: DataFrame,
    metrics: Sequence[str],
    group: str,
    by: Sequence[str] = ("variacao_retrieval", "modelo"),
) -> DataFrame:
    """Long summary, dense: one row per combination of group values and metric.

    One aggregation row per group carries all metrics and is unpivoted after
    the shuffle, so input rows are not multiplied.
    """
    labelled = df.select(
        *[_label(c, PRODUCTION if c == "variacao_retrieval" else "") for c in by],
        *_as_numbers(metrics),
    )
    per_group = labelled.groupBy(*by).agg(
        *[F.struct(*[c.alias(k) for k, c in mean_ci(F.col(m)).items()]).alias(m) for m in metrics]
    )
    zero = F.struct(
        *[F.lit(0.0).alias(k) for k in ("mean", "ci95_low", "ci95_high", "std")],
        F.lit(0).cast("bigint").alias("n"),
    )
    # every combination of the labels, from one row that holds them
    labels = per_group.agg(*[F.collect_set(c).alias(c) for c in by])
    combinations = F.lit(1).cast("double")
    for c in by:
        combinations = combinations * F.size(c)
    too_many = F.raise_error(F.concat(F.lit(f"more than {MAX_COMBINATIONS} combinations of labels: "), combinations.cast("string")))
    every = labels.where(F.when(combinations <= MAX_COMBINATIONS, F.lit(True)).otherwise(too_many.cast("boolean")))
    for c in by:
        every = every.withColumn(c, F.explode(c))
    found = every.join(per_group, list(by), "left")
    dense = found.select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), zero).alias("s"))
                    for m in metrics
                ]
            )
        ).alias("x"),
    )
    return dense.select(F.lit(group).alias("grupo"), *by, "x.metric", "x.s.*")


def model_summary(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Long summary per model."""
    return group_summary(df, metrics, "", by=("modelo",)).drop("grupo")


def variant_summary(df: DataFrame, metrics: Sequence[str], group: str) -> DataFrame:
    """One row per variant, five columns per metric; a missing variant is a group."""
    aggregates = [
        c.alias(f"{m}_{k}") for m in metrics for k, c in mean_ci(F.col(m)).items()
    ]
    rows = df.select("variacao_retrieval", *_as_numbers(metrics)).groupBy("variacao_retrieval")
    return rows.agg(*aggregates).select(
        F.lit(group).alias("grupo"), "variacao_retrieval",
        *[f"{m}_{k}" for m in metrics for k in ("mean", "ci95_low", "ci95_high", "std", "n")],
    )


def baseline_delta(
    summary: DataFrame, metrics: Sequence[str], first_seen: DataFrame | None = None
) -> DataFrame:
    """Difference of every variant to the baseline, absolute and in percent.

    Baseline is the variant of that name; without it the one in `first_seen`
    (one row, see `first_variant`).
    """
    long = summary.select(
        F.coalesce("variacao_retrieval", F.lit("nan")).alias("variacao_retrieval"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("mean"))
                    for m in metrics
                ]
            )
        ).alias("x"),
    ).select("variacao_retrieval", "x.*")
    # a few aggregated rows from here on
    everything, metric = Window.partitionBy(F.lit(0)), Window.partitionBy("metric")
    is_named = F.col("variacao_retrieval") == BASELINE
    if first_seen is None:
        fallback = F.lit(None).cast("string")
    else:
        long = long.withColumn("_k", F.lit(1)).join(
            F.broadcast(first_seen.withColumn("_k", F.lit(1))), "_k"
        )
        fallback = F.col("first_variant")
    named = F.max(F.when(is_named, F.lit(BASELINE))).over(everything)
    based = long.withColumn("_base", F.coalesce(named, fallback)).withColumn(
        "baseline",
        F.max(F.when(F.col("variacao_retrieval") == F.col("_base"), F.col("mean"))).over(metric),
    )
    delta = F.col("mean") - F.col("baseline")
    return based.where("mean is not null and baseline is not null").select(
        "variacao_retrieval", "metric", "mean", "baseline", delta.alias("delta_absoluto"),
        F.when(F.col("baseline") != 0, delta / F.col("baseline") * 100.0).alias(
            "ganho_percentual"
        ),
    )


def first_variant(df: DataFrame, order: str) -> DataFrame:
    """One row: the variant of the first row by `order`."""
    return df.agg(F.min_by("variacao_retrieval", order).alias("first_variant"))


# ------------------------------------------------------------ rankings


def rank_models(df: DataFrame, top: int | None = None) -> DataFrame:
    """Models by mean composite, retrieval and generation score; ties by name."""
    scores = ("composite_quality_score", "retrieval_quality_score", "generation_quality_score")
    means = df.groupBy("modelo").agg(*[F.avg(s).alias(s) for s in scores])
    order = Window.orderBy(*[F.col(s).desc_nulls_last() for s in scores], "modelo")
    ranked = means.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def best_variant(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per metric the variant with the highest mean, and best minus worst."""
    means = df.groupBy("variacao_retrieval").agg(*[F.avg(_number(m)).alias(m) for m in metrics])
    long = means.select(
        "variacao_retrieval",
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("mean")) for m in metrics])
        ).alias("x"),
    ).select("variacao_retrieval", "x.*")
    order = Window.partitionBy("metric").orderBy(
        F.col("mean").desc_nulls_last(), "variacao_retrieval"
    )
    whole = Window.partitionBy("metric")
    return (
        long.withColumn("_n", F.row_number().over(order))
        .withColumn("spread", F.max("mean").over(whole) - F.min("mean").over(whole))
        .where("_n = 1")
        .select("metric", F.col("variacao_retrieval").alias("best"), "mean", "spread")
    )


def model_matrix(df: DataFrame, metrics: Sequence[str] = NUMERIC_METRICS) -> DataFrame:
    """Model x metric means, best overall score first."""
    present = [m for m in metrics if m in df.columns]
    means = df.groupBy("modelo").agg(*[F.avg(_number(m)).alias(m) for m in present])
    return means.orderBy(F.col("overall_score").desc_nulls_last(), "modelo")


def ranking(df: DataFrame, metrics: Sequence[str] = NUMERIC_METRICS) -> DataFrame:
    """Model matrix with the dense rank by overall score."""
    order = Window.orderBy(F.col("overall_score").desc_nulls_last())
    return (
        model_matrix(df, metrics)
        .withColumn("rank", F.dense_rank().over(order))
        .orderBy("rank", "modelo")
    )


# ------------------------------------------------------------ profiles


#: Parts in which the values of one group are counted.
PARTS = 16


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probabilities: Mapping[str, float],
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact quantiles per group with linear interpolation, one column each.

    An approximate pass brackets every quantile; only the values inside the
    bracket, counted per value, are ordered. A group of n rows sends about
    n / accuracy of them to one task, however large it is. Values meet their
    brackets and are counted in PARTS parts of a group, by the hash of the value.
    """
    names = list(probabilities)
    keys = list(by)
    rows = df.select(*keys, tx.to_number(F.col(value)).alias("_v")).where("_v is not null")
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_v"), F.lit(PARTS)).cast("int"))
    margin = 2.0 / accuracy
    bounds = [
        p
        for name in names
        for p in (
            max(0.0, probabilities[name] - margin), min(1.0, probabilities[name] + margin)
        )
    ]
    brackets = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", bounds, accuracy).alias("_q"),
    )
    items = []
    for i, name in enumerate(names):
        p = probabilities[name]
        # the margin is worth two ranks only beyond `accuracy` rows; fewer need no bracket
        few = F.col("_n") <= accuracy
        lo, hi = F.col("_min"), F.col("_max")
        if p > margin:
            lo = F.when(few, lo).otherwise(F.get("_q", F.lit(2 * i)))
        if p < 1 - margin:
            hi = F.when(few, hi).otherwise(F.get("_q", F.lit(2 * i + 1)))
        items.append(
            F.struct(
                F.lit(name).alias("name"), ((F.col("_n") - 1) * F.lit(p)).alias("at"),
                lo.alias("lo"), hi.alias("hi"),
            )
        )
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part")
    wanted = brackets.select(*keys, F.array(*items).alias("_items")).select("*", parts)
    # a value above a bracket cannot move its order statistics: dropped before counting
    counted = (
        rows.join(wanted, [*keys, "_part"])
        .select(*keys, "_part", "_v", F.inline("_items"))
        .where("_v <= hi")
        .withColumn("_v", F.when(F.col("_v") >= F.col("lo"), F.col("_v")))
        .groupBy(*keys, "_part", "name", "at", "_v")
        .agg(F.count("*").alias("_c"))
    )
    upto = (
        Window.partitionBy(*keys, "name")
        .orderBy(F.col("_v").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counted.withColumn("_last", F.sum("_c").over(upto) - 1)
    low, high = F.floor("at"), F.ceil("at")
    at_low = F.min(F.when(F.col("_v").isNotNull() & (F.col("_last") >= low), F.col("_v")))
    at_high = F.min(F.when(F.col("_v").isNotNull() & (F.col("_last") >= high), F.col("_v")))
    interpolated = ranked.groupBy(*keys, "name").agg(
        (at_low + (at_high - at_low) * (F.first("at") - F.floor(F.first("at")))).alias("_x")
    )
    return interpolated.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == n, F.col("_x"))).alias(n) for n in names]
    )


def model_profile(df: DataFrame) -> DataFrame:
    """25 figures per model: counts, times, tokens, lengths, scores and rates."""
    rates = (
        "no_context_recovered", "retrieval_failure", "potential_hallucination",
        "correct_with_weak_retrieval",
    )
    scores = (
        "overall_retrieval_score", "overall_generation_score", "overall_score", *GENERATION_METRICS,
    )
    means = df.groupBy("modelo").agg(
        F.count("id").alias("n_respostas"),
        F.count_distinct("id").alias("n_questoes"),
        F.avg("tempo_resposta_s").alias("tempo_medio_resposta_s"),
        F.avg("input_tokens").alias("input_tokens_medio"),
        F.avg("output_tokens").alias("output_tokens_medio"),
        F.avg("tokens").alias("tokens_medios"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens_totais"),
        F.avg("response_length_chars").alias("resposta_media_chars"),
        F.avg("response_length_words").alias("resposta_media_words"),
        F.avg("similaridade_media_chunks").alias("similaridade_media_chunks"),
        F.avg(F.col("retrieval_hit").cast("double")).alias("retrieval_hit_rate"),
        *[F.avg(s).alias(s) for s in scores],
        *[F.avg(F.col(r).cast("double")).alias(r) for r in rates],
    )
    medians = quantiles(
        df, ["modelo"], "tempo_resposta_s", {"tempo_mediano_resposta_s": 0.5}
    )
    return means.join(medians, "modelo", "left")


def general_stats(df: DataFrame) -> DataFrame:
    """Ten figures over all rows, among them the mean of the model means."""
    overall = df.agg(
        F.count_distinct("id").alias("numero_perguntas"),
        F.count_distinct("modelo").alias("numero_modelos_avaliados"),
        F.count("*").alias("numero_respostas"),
        F.avg("tempo_resposta_s").alias("tempo_medio_global_s"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("double").alias("tokens_entrada_total"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("double").alias("tokens_saida_total"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("tokens_totais_total"),
        F.avg("response_length_chars").alias("resposta_media_chars"),
        F.avg("response_length_words").alias("resposta_media_words"),
    ).withColumn("_k", F.lit(1))
    per_model = (
        df.groupBy("modelo")
        .agg(F.avg("tempo_resposta_s").alias("t"))
        .agg(F.avg("t").alias("tempo_medio_por_modelo_s"))
        .withColumn("_k", F.lit(1))
    )
    return overall.join(per_model, "_k").drop("_k")


def describe_metrics(df: DataFrame, metrics: Sequence[str] = NUMERIC_METRICS) -> DataFrame:
    """Mean, standard deviation, minimum and maximum per metric."""
    present = [m for m in metrics if m in df.columns]
    one = df.select(*_as_numbers(present)).agg(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.avg(m).alias("mean"),
                F.stddev_samp(m).alias("std"),
                F.min(m).alias("min"),
                F.max(m).alias("max"),
            ).alias(m)
            for m in present
        ]
    )
    return one.select(F.inline(F.array(*present)))


def interesting_cases(df: DataFrame, limit: int = 5) -> DataFrame:
    """Seven lists of extreme rows, `limit` each, ties by id, model and variant.

    One scan: a row goes to every list it may stand in, and each task keeps
    `limit` rows of a list before the shuffle; `position` counts within a list.
    """
    ties = [c for c in ("id", "modelo", "variacao_retrieval", "row_no") if c in df.columns]
    columns = [c for c in CASE_COLUMNS if c in df.columns]

    def entry(number: int) -> Column:
        _, condition, keys = CASES[number]
        sort = []
        for i in range(2):
            name, up = keys[i] if i < len(keys) else (None, True)
            value = F.lit(None).cast("double") if name is None else F.col(name).cast("double")
            # missing values last, the largest first where the order falls
            sort += [value.isNull().alias(f"_n{i}"), (value if up else -value).alias(f"_v{i}")]
        row = F.struct(F.lit(number).alias("_case"), *sort)
        return row if condition is None else F.when(F.col(condition), row)

    entries = F.filter(F.array(*[entry(i) for i in range(len(CASES))]), lambda e: e.isNotNull())
    rows = df.select(*dict.fromkeys([*columns, *ties]), F.inline(entries))
    order = Window.partitionBy("_case").orderBy("_n0", "_v0", "_n1", "_v1", *ties)
    top = rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    name = F.get(F.array(*[F.lit(c[0]) for c in CASES]), F.col("_case"))
    return top.select(
        name.alias("case_type"), "position", *dict.fromkeys([*columns, *ties]), name.alias("note")
    )


def case_counts(cases: DataFrame) -> DataFrame:
    """Number of rows per case list, 0 for an empty one."""
    totals = cases.agg(
        *[F.count_if(F.col("case_type") == name).alias(name) for name, _, _ in CASES]
    )
    names = [name for name, _, _ in CASES]
    return totals.select(
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("case_type"), F.col(n).alias("n")) for n in names])
        )
    )


# ------------------------------------------------------------ figure data


def k_curves(df: DataFrame, longest: int = 10) -> DataFrame:
    """Hit rate, recall and precision per model for k = 1 to the largest k, at most 10.

    Only rows with a rank count. Precision is the mean of 1/k over the hits.
    """
    ks = range(1, longest + 1)
    per_model = df.groupBy("modelo").agg(
        F.count("retrieved_rank").alias("ranked"),
        F.max("top_k").alias("_k"),
        F.max("retrieved_rank").alias("_r"),
        F.array(*[F.count_if(F.col("retrieved_rank") <= k) for k in ks]).alias("hits"),
    )
    everything = Window.partitionBy(F.lit(0))
    last = F.least(
        F.greatest(F.max("_k").over(everything), F.max("_r").over(everything), F.lit(5)),
        F.lit(longest),
    )
    curves = per_model.withColumn("_last", last).select(
        "modelo", "ranked", "_last", F.posexplode("hits").alias("p", "h")
    )
    k = F.col("p") + 1
    rate = F.coalesce(F.try_divide(F.col("h"), F.col("ranked")), F.lit(0.0))
    return curves.where(k <= F.col("_last")).select(
        "modelo", k.alias("k"), rate.alias("hit_rate"), (rate / k).alias("precision"),
        rate.alias("recall"),
    )


def corr_matrix(df: DataFrame, metrics: Sequence[str] = NUMERIC_METRICS) -> DataFrame:
    """Correlation of every pair of metrics over the rows that have both, null as 0.

    Tasks reduce their rows to counts, means and centred sums by matrix products
    around each batch's own means; only those are shuffled, one row per task and
    pair, and put together around the means of all rows. One pass, no early job.
    """
    present = [m for m in metrics if m in df.columns]
    numbers = df.select(*_as_numbers(present))
    k = len(present)

    def share(total: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.divide(total, count, out=np.zeros_like(total), where=count > 0)

    def moments(x: np.ndarray) -> np.ndarray:
        """Per pair: rows, both means, and the sums of squares and products around them."""
        m = (~np.isnan(x)).astype(np.float64)
        centre = share(np.nan_to_num(x).sum(axis=0), m.sum(axis=0))
        x = np.nan_to_num(x - centre)
        count, sx, sy, square = m.T @ m, x.T @ m, m.T @ x, x * x

        def around_mean(squares: np.ndarray, total: np.ndarray) -> np.ndarray:
            left = squares - share(total * total, count)
            return np.where(left > 1e-12 * squares, left, 0.0)  # what rounding leaves of equal values

        return np.stack(
            [
                count, centre[:, None] + share(sx, count), centre[None, :] + share(sy, count),
                around_mean(square.T @ m, sx), around_mean(m.T @ square, sy), x.T @ x - share(sx * sy, count),
            ]
        )

    def together(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        count = a[0] + b[0]
        dx, dy, weight = b[1] - a[1], b[2] - a[2], share(a[0] * b[0], count)
        part = share(b[0], count)
        return np.stack(
            [
                count, a[1] + dx * part, a[2] + dy * part, a[3] + b[3] + dx * dx * weight,
                a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight,
            ]
        )

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, k, k))
        for frame in batches:
            if len(frame):
                total = together(total, moments(frame.to_numpy(dtype=np.float64)))
        i, j = np.indices((k, k))
        named = zip(("n", "mx", "my", "sxx", "syy", "sxy"), total, strict=True)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), **{c: t.ravel() for c, t in named}})

    partial = numbers.mapInPandas(
        sums, "i int, j int, n double, mx double, my double, sxx double, syy double, sxy double"
    )
    # spread by pair first, so that the means of all rows need no second shuffle
    pair = Window.partitionBy("i", "j")

    def mean(c: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col("n") * F.col(c)).over(pair), F.sum("n").over(pair)), F.lit(0.0))

    n, dx, dy = F.col("n"), F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my")
    merged = partial.withColumns({"_mx": mean("mx"), "_my": mean("my")}).groupBy("i", "j").agg(
        F.sum(F.col("sxx") + n * dx * dx).alias("sxx"), F.sum(F.col("syy") + n * dy * dy).alias("syy"),
        F.sum(F.col("sxy") + n * dx * dy).alias("sxy"), F.sum("n").alias("n"),
        F.first("_mx").alias("mx"), F.first("_my").alias("my"),
    )

    def spread(square: str, middle: str) -> Column:
        # rounding may leave a trace of spread in a constant column
        least = F.greatest(F.col(middle) * F.col(middle) * F.col("n") * F.lit(1e-24), F.lit(1e-24))
        return F.when(F.col(square) > least, F.col(square))

    r = F.try_divide(F.col("sxy"), F.sqrt(spread("sxx", "mx")) * F.sqrt(spread("syy", "my")))
    names = F.array(*[F.lit(m) for m in present])
    return merged.select(
        F.get(names, F.col("i")).alias("metric_x"),
        F.get(names, F.col("j")).alias("metric_y"),
        F.coalesce(r, F.lit(0.0)).alias("corr"),
    )


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Counts in equal bins from minimum to maximum, the maximum in the last bin."""
    v = df.select(tx.to_number(F.col(value)).alias("v")).where("v is not null")
    # one row
    bounds = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo is not null")
    edges = bounds.select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        F.lit(1).alias("_k"),
    ).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    at = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    counted = (
        v.withColumn("_k", F.lit(1))
        .join(F.broadcast(edges), "_k")
        .groupBy(at.alias("bin"), "lo", "width")
        .agg(F.count("*").alias("n"))
    )
    # at most `bins` rows
    one = counted.groupBy("lo", "width").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_n")
    )
    dense = one.select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "width", "_n"
    )
    return dense.select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_from"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_to"),
        F.coalesce(F.try_element_at("_n", F.col("bin")), F.lit(0)).alias("n"),
    )


def quartiles(df: DataFrame, value: str, by: str = "modelo") -> DataFrame:
    """Minimum, quartiles and maximum per group."""
    return quantiles(
        df, [by], value, {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}
    )


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pairs of two metrics, missing values as 0."""
    return df.select(
        "modelo",
        F.coalesce(_number(x), F.lit(0.0)).alias("x"),
        F.coalesce(_number(y), F.lit(0.0)).alias("y"),
    )


def radar(df: DataFrame) -> DataFrame:
    """Six mean scores per model, missing ones as 0."""
    axes = (
        ("retrieval", "overall_retrieval_score"), ("generation", "overall_generation_score"),
        ("hit_at_1", "hit_rate_at_1"), ("mrr", "mrr"),
        ("similarity", "similaridade_media_chunks"), ("overall", "overall_score"),
    )
    return df.groupBy("modelo").agg(
        *[F.coalesce(F.avg(_number(c)), F.lit(0.0)).alias(name) for name, c in axes]
    )


def mean_by_model(df: DataFrame, metric: str) -> DataFrame:
    """Mean of one metric per model, missing as 0 (hit rate, MRR, precision, recall)."""
    value = F.col(metric).cast("double")
    return df.groupBy("modelo").agg(F.coalesce(F.avg(value), F.lit(0.0)).alias(metric))


def metric_means(summary: DataFrame) -> DataFrame:
    """Mean over the models of the means of a long summary."""
    return summary.groupBy("variacao_retrieval", "metric").agg(F.avg("mean").alias("mean"))


def variant_composite(
    retrieval: DataFrame, generation: DataFrame, order: Sequence[str] = VARIANT_ORDER
) -> DataFrame:
    """Per variant half the mean retrieval and half the mean generation metric.

    The two have different scales. Variants in the given order; one that lacks
    either side is left out.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        means = metric_means(df).groupBy("variacao_retrieval")
        return means.agg(F.avg("mean").alias(name))

    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col("variacao_retrieval"))
    joined = side(retrieval, "r").join(side(generation, "g"), "variacao_retrieval")
    return (
        joined.select(
            place.cast("int").alias("ordem"), "variacao_retrieval",
            ((F.col("r") + F.col("g")) / 2).alias("score_composto"),
        )
        .where("ordem > 0")
        .orderBy("ordem")
    )


def minmax(df: DataFrame, column: str, out: str) -> DataFrame:
    """A column of a few aggregated rows scaled to 0-1; a constant one to 0."""
    everything = Window.partitionBy(F.lit(0))
    lo, hi = F.min(column).over(everything), F.max(column).over(everything)
    return df.withColumn(
        out, F.when(hi > lo, (F.col(column) - lo) / (hi - lo)).otherwise(F.lit(0.0))
    )


def model_composite(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Mean composite score of the listed models, in that order."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("modelo")).cast("int")
    return (
        df.groupBy("modelo")
        .agg(F.avg("composite_quality_score").alias("composite_quality_score"))
        .select(place.alias("ordem"), "modelo", "composite_quality_score")
        .where("ordem > 0 and composite_quality_score is not null")
        .orderBy("ordem")
    )


def with_cutoffs(df: DataFrame, cutoffs: Sequence[int] = (1, 3, 4)) -> DataFrame:
    """Hit columns at fixed ranks and the reciprocal rank from `retrieved_rank`."""
    rank = F.col("retrieved_rank")
    hits = {
        f"hit_rate_at_{n}": F.coalesce((rank <= n).cast("double"), F.lit(0.0)) for n in cutoffs
    }
    return df.withColumns({**hits, "mrr": reciprocal_rank(rank)})
