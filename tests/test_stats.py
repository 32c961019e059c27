import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docspark import schemas
from docspark.operators import evaluate, stats
from docspark.plans import flows
from docspark.sources import store, tables


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 400
    rank = rng.integers(0, 6, n)
    f = pd.DataFrame(
        {
            "row_no": np.arange(n), "id": [f"q{i % 25}" for i in range(n)], "modelo": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]),
            "variacao_retrieval": rng.choice(["x", "baseline"], n), "pergunta": "one two", "resposta": "r  s t", "resposta_ideal": "i",
            "contexto": np.where(rng.random(n) < 0.1, " ", "ctx"), "tempo_resposta_s": rng.random(n) * 9, "input_tokens": rng.integers(0, 50, n).astype(float),
            "output_tokens": 1.0, "tokens": rng.integers(0, 3, n).astype(float), "top_k": 4, "chunks_recuperados": rng.integers(0, 3, n).astype(float),
            "retrieved_rank": np.where(rank == 0, np.nan, rank), "retrieval_hit": rank > 0, "recall_at_k": (rank > 0).astype(float),
            "hit_rate_at_k": ((rank > 0) & (rank <= 4)).astype(float), "precision_at_k": (rank > 0) / 4.0,
            "similaridade_media_chunks": np.where(rng.random(n) < 0.2, np.nan, rng.random(n) * 1.2),
            "answer_length": 6.0, "question_length": 7.0, "context_truncated": False,
        }
    )
    for m in schemas.GENERATION_METRICS:
        f[m] = np.where(rng.random(n) < 0.3, np.nan, rng.integers(1, 6, n))
    return f


@pytest.fixture(scope="module")
def rows(spark, frame):
    df = spark.createDataFrame(frame).replace(float("nan"), None)
    df = stats.with_cutoffs(df.withColumn("retrieved_rank", F.col("retrieved_rank").cast("int")))
    return stats.flags(stats.quality_scores(stats.quality_scores(df), cutoffs=True)).cache()


def test_scores_average_what_is_present(spark):
    rows = [(0.5, None, 2.0, -1.0, None, 5, None, None, None, None, None), (None,) * 11]
    ddl = ", ".join([f"{m} double" for m in schemas.RETRIEVAL_METRICS] + [f"{m} int" for m in schemas.GENERATION_METRICS])
    a, b = stats.quality_scores(spark.createDataFrame(rows, ddl)).collect()
    assert (a["retrieval_quality_score"], a["generation_quality_score"], a["composite_quality_score"]) == (0.5, 1.0, 0.75)
    assert (b["retrieval_quality_score"], b["generation_quality_score"], b["composite_quality_score"]) == (None,) * 3


def test_flags(rows, frame):
    got = rows.orderBy("row_no").toPandas()
    assert (got["response_length_words"] == 3).all() and (got["question_length_words"] == 2).all()
    assert (got["has_context"] == (frame["contexto"] != " ")).all()
    low = (frame[["groundedness_score", "alucinacao_score", "corretude_score"]].fillna(5) <= 2).any(axis=1)
    assert (got["potential_hallucination"] == low).all()
    assert got["response_words_per_token"].isna().equals(frame["tokens"] == 0)


def test_intervals(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", None)], "k string, v double")
    out = {r["k"]: r for r in df.groupBy("k").agg(*[c.alias(n) for n, c in stats.mean_ci(F.col("v")).items()]).collect()}
    assert (out["a"]["mean"], out["a"]["n"]) == (2.0, 2) and out["a"]["std"] == pytest.approx(2**0.5)
    assert out["a"]["ci95_high"] == pytest.approx(2.0 + 1.96)
    assert tuple(out["b"])[1:] == (5.0, 5.0, 5.0, 0.0, 1) and tuple(out["c"])[1:] == (0.0, 0.0, 0.0, 0.0, 0)


def test_summary_is_dense(rows, frame):
    got = stats.group_summary(rows.where("NOT (modelo = 'c' AND variacao_retrieval = 'x')"), ("mrr", "clareza_score"), "g").collect()
    assert len(got) == 2 * 3 * 2
    empty = [r for r in got if (r["modelo"], r["variacao_retrieval"]) == ("c", "x")]
    assert {(r["n"], r["mean"]) for r in empty} == {(0, 0.0)}
    want = frame[(frame.modelo == "a") & (frame.variacao_retrieval == "x")]["clareza_score"]
    (row,) = [r for r in got if (r["modelo"], r["variacao_retrieval"], r["metric"]) == ("a", "x", "clareza_score")]
    assert row["mean"] == pytest.approx(want.mean()) and row["std"] == pytest.approx(want.std()) and row["n"] == want.count()


def test_delta_without_a_named_baseline(rows):
    renamed = rows.replace({"baseline": "zz"}, subset=["variacao_retrieval"])
    summary = stats.variant_summary(renamed, ("mrr",), "g")
    assert stats.baseline_delta(summary, ("mrr",)).count() == 0
    first = renamed.orderBy("row_no").first()["variacao_retrieval"]
    out = {r["variacao_retrieval"]: r for r in stats.baseline_delta(summary, ("mrr",), stats.first_variant(renamed, "row_no")).collect()}
    assert out[first]["delta_absoluto"] == 0.0 and len(out) == 2


def test_delta_of_a_zero_baseline(spark):
    df = spark.createDataFrame([("baseline", 0.0), ("x", 1.0)], "variacao_retrieval string, m double")
    out = {r[0]: r for r in stats.baseline_delta(stats.variant_summary(df, ("m",), "g"), ("m",)).collect()}
    assert out["x"]["delta_absoluto"] == 1.0 and out["x"]["ganho_percentual"] is None


def test_correlations_equal_pandas(rows):
    names = [m for m in schemas.NUMERIC_METRICS if m in rows.columns]
    got = stats.corr_matrix(rows).toPandas().pivot(index="metric_x", columns="metric_y", values="corr")
    want = rows.select(*names).toPandas().astype(float).corr().fillna(0)
    assert np.allclose(got.loc[names, names], want.loc[names, names], atol=1e-9)


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_quantiles_equal_pandas(rows, frame, accuracy):
    ps = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = stats.quantiles(rows, ["modelo"], "similaridade_media_chunks", ps, accuracy).toPandas().set_index("modelo").sort_index()
    want = frame.groupby("modelo")["similaridade_media_chunks"].quantile(list(ps.values())).unstack()
    assert np.allclose(got[list(ps)].to_numpy(), want.to_numpy())


def test_histogram_holds_every_value(rows, frame):
    got = stats.histogram(rows, "tempo_resposta_s").orderBy("bin").toPandas()
    counts, edges = np.histogram(frame["tempo_resposta_s"], bins=20)
    assert (got["n"] == counts).all() and np.allclose(got["bin_from"], edges[:-1])


def test_histogram_of_a_constant(spark):
    got = stats.histogram(spark.range(5).selectExpr("2.0 AS v"), "v").orderBy("bin").toPandas()
    assert got["n"].sum() == 5 and len(got) == 20


def test_k_curves(rows, frame):
    got = stats.k_curves(rows).toPandas().set_index(["modelo", "k"])
    ranks = frame[(frame.modelo == "b")]["retrieved_rank"].dropna()
    assert got.loc[("b", 3), "hit_rate"] == pytest.approx((ranks <= 3).mean())
    assert got.loc[("b", 3), "precision"] == pytest.approx((ranks <= 3).mean() / 3)
    assert got.index.get_level_values("k").max() == 5


def test_rankings(rows):
    ranked = stats.rank_models(rows).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3]
    scores = [r["composite_quality_score"] for r in ranked]
    assert scores == sorted(scores, reverse=True)
    assert stats.rank_models(rows, top=2).count() == 2


def test_cases(rows):
    cases = stats.interesting_cases(rows)
    best = cases.where("case_type = 'melhores_respostas'").orderBy("position").collect()
    assert len(best) == 5 and best[0]["overall_score"] == rows.agg(F.max("overall_score")).first()[0]
    counts = {r["case_type"]: r["n"] for r in stats.case_counts(cases).collect()}
    assert len(counts) == 7 and max(counts.values()) == 5


def test_minmax(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    out = stats.minmax(stats.minmax(df, "a", "x"), "b", "y").orderBy("a").collect()
    assert [(r["x"], r["y"]) for r in out] == [(0.0, 0.0), (1.0, 0.0)]


def test_numbers_are_cleaned(spark):
    df = spark.createDataFrame([("1",), ("NaN",), ("inf",), ("x",), (None,)], "v string")
    assert [r["v"] for r in stats.clean_numeric(df, ["v", "w"]).collect()] == [1.0, None, None, None, None]


def test_consolidation_without_a_judge(spark):
    log = spark.createDataFrame([("q1", None, "m"), ("q9", "v", "m")], "id string, variacao_retrieval string, modelo string")
    gold = spark.createDataFrame([("q1", 1), ("q1", 2)], "id string, ordem int")
    (row,) = stats.consolidate(log, gold).collect()
    assert row["variacao_retrieval"] == "production" and row["clareza_score"] is None and row["clareza_comment"] == ""


def test_variants_and_grid(spark):
    assert [v.name for v in evaluate.variants()] == ["baseline", "baseline_traduzido", "topk_aumentado", "topk_aumentado_traduzido"]
    assert [v.top_k for v in evaluate.variants(translation=False)] == [4, 10]
    assert [v.name for v in evaluate.variants(compare=False)] == ["production"]
    gold = spark.createDataFrame([("a", "p")], "id string, pergunta string")
    grid = flows.experiment_grid(gold, evaluate.variants(), ["m1", "m2"])
    assert grid.count() == 8
    assert "Join" not in grid._jdf.queryExecution().executedPlan().toString()


def test_retrieval_per_variant_and_translation(spark):
    gold = spark.createDataFrame([("q", "x/docs_markdown/a.md"), ("none", "")], "id string, source_path string")
    rows = [("q", r, p, d, t) for t, hits in ((False, ["b", "a", "a"]), (True, ["a", "c", None])) for r, (p, d) in enumerate(zip([f"docs_markdown/{h}.md" if h else None for h in hits], [0.0, 1.0, None]), 1)]
    hits = spark.createDataFrame(rows, "query_id string, rank int, source_path string, distance double, translate_query boolean")
    chosen = [evaluate.Variant("low", 1, False), evaluate.Variant("high", 3, False), evaluate.Variant("translated", 3, True)]
    out = {(r["id"], r["variacao_retrieval"]): r for r in evaluate.retrieval_metrics(gold, hits, chosen, with_json=True).collect()}
    low, high, translated, none = out["q", "low"], out["q", "high"], out["q", "translated"], out["none", "high"]
    assert (low["retrieved_rank"], low["hit_rate_at_k"], low["mrr"], low["precision_at_k"]) == (None, 0.0, 0.0, 0.0)
    assert (high["retrieved_rank"], high["mrr"], high["recall_at_k"]) == (2, 0.5, 1.0) and high["precision_at_k"] == pytest.approx(2 / 3)
    assert high["similaridade_media_chunks"] == 0.75
    assert (translated["retrieved_rank"], translated["chunks_recuperados"]) == (1, 3)
    assert (none["chunks_recuperados"], none["recall_at_k"]) == (0, 0.0)
    assert [c["rank"] for c in json.loads(high["chunks_recuperados_json"])] == [1, 2, 3] and json.loads(none["chunks_recuperados_json"]) == []


def test_log_round_trip_and_reports(spark, tmp_path, rows):
    path = str(tmp_path / "log")
    log = spark.createDataFrame([("q", 'line "one"\nline two', "m", 1.5)], "id string, resposta string, modelo string, tempo_resposta_s double")
    tables.write_csv(log, path)
    back = tables.read_log(spark, path).first()
    assert back["resposta"] == 'line "one"\nline two' and back["variacao_retrieval"] == "production" and back["tempo_resposta_s"] == 1.5
    folder = str(tmp_path / "reports")
    reports = {**flows.report_tables(rows), **flows.analysis_tables(rows)}
    flows.write_reports(reports, folder)
    assert len(reports) == 16
    assert spark.read.option("header", True).csv(f"{folder}/ranking_composto").count() == 3


def test_result_log_has_its_columns_and_survives_storage(spark, tmp_path):
    gold = spark.createDataFrame(
        [("q1", "Pergunta?", "ideal", "docs_markdown/a.md", "T", "S", "consulta", "facil")],
        "id string, pergunta string, resposta_ideal string, source_path string, titulo_documento string, secao string, categoria string, dificuldade string",
    )
    hits = spark.createDataFrame([("q1", 1, "docs_markdown/b.md", 1.0), ("q1", 2, "x/docs_markdown/A.md", 0.0)], "query_id string, rank int, source_path string, distance double")
    retrieval = evaluate.retrieval_metrics(gold, hits, [evaluate.Variant("v", 2, False, "d")], with_json=True)
    answers = spark.createDataFrame(
        [("q1", "v", m, "a\nb", 0.456, '{"usage":{"inputTokens":10,"outputTokens":5}}', "ctx", None) for m in ("m1", "m2")],
        "id string, variacao_retrieval string, modelo string, resposta string, tempo_resposta_s double, generation_metadata string, contexto string, context_truncated boolean",
    )
    log = evaluate.result_log(gold, retrieval, answers)
    assert len(log.columns) == 36 and log.count() == 2
    path = str(tmp_path / "log")
    tables.write_log(log, path)
    back = tables.read_log(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, log.select(*back.columns).collect()))
    again = evaluate.metrics_from_log(back, gold).collect()
    assert {(r["tokens"], r["retrieved_rank"], r["mrr"], r["hit_rate_at_1"], r["precision_at_k"]) for r in again} == {(15, 2, 0.5, 0.0, 0.5)}
    assert {r["similaridade_media_chunks"] for r in again} == {0.75}


def test_a_log_as_a_table_is_split(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(f"q{i}", "a\nb", i) for i in range(40)], "id string, resposta string, tokens int").repartition(4)
    tables.write_log(store.align_schema(rows, schemas.LOG), path, "parquet")
    back = tables.read_log(spark, path, fmt="parquet")
    assert back.count() == 40 and back.first()["resposta"] == "a\nb" and back.rdd.getNumPartitions() > 1
    older = str(tmp_path / "older")
    rows.drop("tokens").write.parquet(older)
    assert {r["variacao_retrieval"] for r in tables.read_log(spark, older, fmt="parquet").collect()} == {"production"}


def test_a_dense_summary_has_a_bound(spark, monkeypatch):
    rows = spark.createDataFrame([(f"v{i}", f"m{i}", 1.0) for i in range(12)], "variacao_retrieval string, modelo string, x double")
    dense = stats.group_summary(rows, ["x"], "g")
    assert dense.count() == 144
    plan = dense._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    monkeypatch.setattr(stats, "MAX_COMBINATIONS", 100)
    with pytest.raises(Exception, match="more than 100 combinations"):
        stats.group_summary(rows, ["x"], "g").collect()
