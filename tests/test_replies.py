import json

from pyspark.sql import functions as F

from docspark.functions import prompts, replies
from docspark.operators import context

TOOL = prompts.JUDGE_TOOL
SCORES = {"groundedness": {"score": 5, "comment": "ok"}, "corretude": {"score": 5.5}, "clareza": {"score": "4"}, "completude": 3}


def response(*parts):
    return json.dumps({"output": {"message": {"content": list(parts)}}})


def test_questions(many):
    texts = ['"Como faço isso aqui."', "curta", "o que e  isso aqui", "Algo? com ponto final."]
    assert many(replies.clean_question, texts) == ["Como faço isso aqui?", None, "o que e isso aqui?", "Algo? com ponto final."]


def test_translations(many):
    texts = ["```hello```", '{"translation":" how to "}', '"quoted"', "", '{"query":5}', "'a'", None]
    assert many(lambda c: replies.clean_translation(c, F.lit("orig")), texts) == ["hello", "how to", "quoted", "orig", '{"query":5}', "a", "orig"]


def test_query_translation(spark):
    rows = [("q", "Q2", True, None), ("q", "q", True, None), ("q", "Q2", False, None), ("q", None, True, "down")]
    df = spark.createDataFrame(rows, "q string, r string, e boolean, x string")
    out = df.select(replies.query_translation(F.col("q"), F.col("r"), F.col("e"), F.lit("m"), F.col("x")).alias("t")).select("t.*").collect()
    assert [(r["applied"], r["translated_question"], r["model_id"], r["error"]) for r in out] == [
        (True, "Q2", "m", None), (False, "q", "m", None), (False, "q", None, None), (False, "q", "m", "down"),
    ]


def test_judge_payloads(many):
    ok = [
        response({"toolUse": {"name": TOOL, "input": SCORES}}), response({"toolUse": {"name": TOOL, "input": json.dumps(SCORES)}}),
        response({"text": json.dumps(SCORES)}),
    ]
    for row in many(lambda c: replies.judge_scores(replies.judge_payload(c)), ok):
        assert (row["groundedness"]["score"], row["groundedness"]["comment"]) == (5, "ok")
        assert row["corretude"]["score"] is None and row["clareza"]["score"] is None and row["completude"]["score"] is None
    assert many(replies.judge_payload, [response({"text": "no"}), "x", response({"toolUse": {"name": "other", "input": SCORES}})]) == [None] * 3


def test_reply_text_and_vector(many):
    assert many(replies.reply_text, [response({"text": " a"}, {"text": "b "}), response(), "x"]) == ["ab", None, None]
    assert many(replies.reply_vector, ['{"embedding":[1,2.5]}', '{"embeddings":[[1,2],[3,4]]}', "{}"]) == [[1.0, 2.5], [1.0, 2.0], None]


def test_tokens(many):
    texts = ['{"usage":{"inputTokens":10,"outputTokens":5}}', '{"prompt_token_count":3}', '{"usage":{"input_tokens":"x"}}', "bad", None]
    assert [tuple(t) if t else None for t in many(replies.tokens, texts)] == [(10, 5, 15), (3, None, 3), (None,) * 3, (None,) * 3, (None,) * 3]


def test_formats(many):
    assert many(replies.format_duration, [1.234, 0.125, 62.3, 65.25, 3600.0, None], "double") == ["1.23s", "0.12s", "1m 2.3s", "1m 5.2s", "60m 0.0s", "N/D"]
    assert many(replies.format_tokens, ['{"inputTokens":10,"outputTokens":5}', '{"total_tokens":3}', "{}", None]) == ["entrada: 10 | saída: 5", "total: 3", "N/D", "N/D"]


def test_stop_tokens(many):
    assert many(prompts.cut_stop_tokens, ["abc <|eot_id|> z", " plain ", "a<|x|>b <|end_header_id|>"]) == ["abc", "plain", "a<|x|>b"]


def hit(query, rank, document, software="S", distance=0.5):
    return (query, rank, software, "H", None, "p.md", distance, document)


SCHEMA = "query_id int, rank int, software string, hierarquia string, titulo string, source_path string, distance double, document string"


def test_contexts_stop_at_the_first_overflow(spark):
    rows = [hit(1, 1, "x" * 500), hit(1, 2, "y" * 500), hit(1, 3, "z"), hit(2, 1, " only ", None, None)]
    out = {r["query_id"]: r for r in context.build_context(spark.createDataFrame(rows, SCHEMA), 700).collect()}
    assert out[1]["context_truncated"] and out[1]["blocks_kept"] == 1 and out[1]["hits"] == 3
    assert out[1]["context"].endswith(prompts.TRUNCATION_NOTICE)
    assert out[2]["context"] == "[Trecho 1]\nSoftware: N/A\nHierarquia: H\nTítulo: N/A\nFonte: p.md\nDistância: N/A\nConteúdo:\nonly"
    assert out[2]["sources"] == "-  | H |"


def test_first_block_is_always_kept(spark):
    out = context.build_context(spark.createDataFrame([hit(1, 1, "x" * 900)], SCHEMA), 10).first()
    assert out["blocks_kept"] == 1 and not out["context_truncated"]


def test_context_uses_one_shuffle(spark):
    df = spark.createDataFrame([hit(1, 1, "x")], SCHEMA)
    plan = context.build_context(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_prompts_without_hits(spark):
    questions = spark.createDataFrame([(1, "a?"), (2, "b?")], "query_id int, question string")
    contexts = context.build_context(spark.createDataFrame([hit(1, 1, "x")], SCHEMA))
    out = {r["query_id"]: r["prompt"] for r in context.answer_prompts(questions, contexts).collect()}
    assert "Pergunta: a?" in out[1] and "[Trecho 1]" in out[1] and "- S | H |" in out[1]
    assert prompts.NO_CONTEXT in out[2] and prompts.NO_SOURCES in out[2]
