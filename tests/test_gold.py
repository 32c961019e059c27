import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docspark.functions import paths
from docspark.operators import gold
from docspark.sources import tables

MANUAL = (
    "# Manual\n\n## Instalacao\nComo instalar o produto. Siga os passos. Reinicie depois.\n\n"
    "## Configuracao\nThe settings page lists every option. Use the parameter table.\n"
)


def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "source_path string, text string")


def test_sections_and_paths(spark):
    text = "intro\n# A\n## B\nbody b\n#### D\nbody d\n## E\n\n# F\n"
    rows = gold.sections(docs(spark, {"x/m.md": text})).orderBy("section_no").collect()
    assert [(r["secao"], r["conteudo"]) for r in rows] == [("A", ""), ("A > B", "body b"), ("A > B > D", "body d"), ("F", "")]
    assert {r["titulo_documento"] for r in rows} == {"intro"}


def test_document_without_sections(spark):
    rows = gold.sections(docs(spark, {"x/m.md": "- item\nplain text\n", "e.md": "\n\n"})).collect()
    assert [tuple(r)[1:] for r in rows] == [("plain text", 1, 1, "plain text", "plain text", "- item\nplain text")]


def test_titles(many):
    build = lambda c: gold.document_title(c, F.lit("stem"))
    assert many(build, ["## B\n# A  x", "\n plain  title \n# A", "* a\n- b", "x" * 121 + "\n# T"]) == ["A x", "plain title", "stem", "T"]


def test_markdown_is_stripped(many):
    assert many(gold.strip_markdown, ["`a` **b** [c](d) > e | f_g # h"]) == ["a b c e f g h"]


def test_keywords_by_count_then_position(one):
    words = one(lambda: gold.keywords(F.lit("Zeta alpha"), F.lit("the doc"), F.lit("beta beta. alpha (gamma) beta zeta to de")))
    assert words == ["beta", "zeta", "alpha", "doc", "gamma"]
    assert one(lambda: gold.keywords(F.lit("a de"), F.lit("o"), F.lit(""))) == ["a", "de"]


def test_categories_match_substrings(many):
    texts = ["Como fazer", "an error", "the option", "on the top", "a list", "nothing", "address"]
    assert many(lambda c: gold.category(F.lit("t"), c), texts) == [
        "procedimento", "diagnostico", "configuracao", "conceito", "referencia", "consulta", "procedimento",
    ]


def test_difficulty(spark):
    rows = [("x", 1, "consulta"), ("x" * 901, 1, "consulta"), ("x" * 901, 3, "consulta"), ("x" * 1801 + "|", 3, "referencia")]
    df = spark.createDataFrame(rows, "b string, l int, k string")
    got = [r[0] for r in df.select(gold.difficulty(F.col("b"), F.col("l"), F.col("k"))).collect()]
    assert got == ["facil", "facil", "medio", "dificil"]


def test_focus(one):
    words = lambda: F.array(F.lit("a1"), F.lit("b2"), F.lit("c3"))
    assert one(lambda: gold.focus(F.lit("Overview"), words(), F.lit("D"))) == "a1 b2"
    assert one(lambda: gold.focus(F.lit("abc"), F.array().cast("array<string>"), F.lit("D"))) == "D"
    assert one(lambda: gold.focus(F.lit(" Long title "), words(), F.lit("D"))) == "Long title"


def test_answers_are_short(spark):
    answer = lambda b, k: gold.ideal_answer(F.lit(b), F.lit("T"), F.lit("D"), F.lit(k))
    row = spark.range(1).select(
        answer("One. Two. Three.", "consulta").alias("a"), answer("x" * 600, "consulta").alias("b"),
        answer("", "consulta").alias("c"), answer("One.", "procedimento").alias("d"),
    ).first()
    assert row["a"] == "One. Two." and len(row["b"]) == 550 and row["b"].endswith("x...")
    assert row["c"] == "A documentação de D trata de T."
    assert row["d"] == "A documentação descreve o seguinte sobre T: One."


@pytest.fixture(scope="module")
def hot(spark):
    """Candidates of which a third come from one source, half from one class."""
    return spark.range(600).selectExpr(
        "IF(id % 3 = 0, 'hot.md', 's' || (id % 97) || '.md') AS source_path", "'sec ' || id AS secao", "CAST(id AS INT) AS section_no",
        "CASE WHEN id % 2 = 0 THEN 'consulta' WHEN id % 4 = 1 THEN 'conceito' ELSE 'diagnostico' END AS categoria",
        "'question ' || (id % 450) AS pergunta", "'text ' || id AS conteudo",
    )


def test_pick_is_balanced_and_unique(hot):
    rows = gold.stratified_pick(hot, 60).orderBy("ordem").collect()
    assert [r["ordem"] for r in rows] == list(range(1, 61))
    assert len({r["pergunta"] for r in rows}) == 60
    assert max(Counter(r["source_path"] for r in rows).values()) <= 2
    assert sorted(Counter(r["categoria"] for r in rows).values()) == [20, 20, 20]
    again = gold.stratified_pick(hot.repartition(7), 60).orderBy("ordem").collect()
    assert rows == again
    assert gold.stratified_pick(hot, 60, seed=1).orderBy("ordem").collect() != rows


def test_pick_goes_on_when_sources_run_out(spark):
    one_source = spark.range(30).selectExpr(
        "'only.md' AS source_path", "'s' || id AS secao", "CAST(id AS INT) AS section_no", "'consulta' AS categoria", "'q' || id AS pergunta",
    )
    assert gold.stratified_pick(one_source, 10).count() == 10
    assert gold.stratified_pick(one_source, 50).count() == 30
    with pytest.raises(ValueError):
        gold.stratified_pick(one_source, 0)


def test_gold_rows_and_written_questions(spark, tmp_path):
    corpus = docs(spark, {f"docs_markdown/m{i}.md": MANUAL.replace("Manual", f"Manual {i}") for i in range(3)})
    rows = gold.build_gold(corpus, 4)
    found = rows.collect()
    assert len(found) == 4 and all(r["id"].startswith("q_") and len(r["id"]) == 18 for r in found)
    written = spark.createDataFrame([(found[0]["id"], "Como eu instalo isto"), (found[1]["id"], "curta")], "id string, reply string")
    asked = {r["ordem"]: r for r in gold.with_written_questions(rows, written).collect()}
    assert asked[found[0]["ordem"]]["pergunta"] == "Como eu instalo isto?" and asked[found[0]["ordem"]]["id"] != found[0]["id"]
    assert asked[found[1]["ordem"]]["pergunta"] == found[1]["pergunta"]
    path = str(tmp_path / "gold")
    tables.write_gold(rows, path)
    assert sorted(map(str, tables.read_gold(spark, path).collect())) == sorted(map(str, found))
    (tmp_path / "array.json").write_text(json.dumps([{"id": "q_1", "pergunta": "é?"}, {"id": "q_2"}], indent=2), encoding="utf-8")
    read = {r["id"]: r["pergunta"] for r in tables.read_gold(spark, str(tmp_path / "array.json")).collect()}
    assert read == {"q_1": "é?", "q_2": None}
    (tmp_path / "bad.json").write_text('[{"pergunta": "x"}]')
    with pytest.raises(ValueError):
        tables.read_gold(spark, str(tmp_path / "bad.json"))


def test_sections_need_no_shuffle(spark):
    plan = gold.candidates(docs(spark, {"a.md": MANUAL}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert paths is not None


@pytest.mark.parametrize("target,per_source", [(1, 2), (7, 1), (25, 2), (60, 2), (500, 3)])
def test_choice_in_turns_equals_a_greedy_over_all_rows(spark, target, per_source):
    rng = random.Random(target)
    kinds = ["k1"] * 6 + ["k2"] * 3 + ["k3"]
    rows = [(f"p{min(rng.randrange(12), 9) if rng.random() < 0.7 else 0}", i, f"s{i}", rng.choice(kinds), f"q{rng.randrange(150)}") for i in range(220)]
    found = spark.createDataFrame(rows, "source_path string, section_no int, secao string, categoria string, pergunta string")
    drawn = {r["section_no"]: r["d"] for r in found.select("section_no", gold._draw(5).alias("d")).collect()}
    first = {}
    for r in sorted(rows, key=lambda r: drawn[r[1]]):
        first.setdefault(r[4], r)
    groups = {}
    for r in sorted(first.values(), key=lambda r: drawn[r[1]]):
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda k: (-len(groups[k]), k))
    want, used = [], {}
    while len(want) < target and any(groups.values()):
        for k in order:
            if groups[k] and len(want) < target:
                at = next((i for i, r in enumerate(groups[k]) if used.get(r[0], 0) < per_source), 0)
                r = groups[k].pop(at)
                used[r[0]] = used.get(r[0], 0) + 1
                want.append(r[1])
    got = gold.choose_in_turns(found, target, 5, per_source).orderBy("ordem").collect()
    assert [r["section_no"] for r in got] == want and [r["ordem"] for r in got] == list(range(1, len(want) + 1))


def test_choice_in_turns_of_nothing(spark):
    empty = spark.createDataFrame([], "source_path string, section_no int, secao string, categoria string, pergunta string")
    assert gold.choose_in_turns(empty, 5).count() == 0
    with pytest.raises(ValueError):
        gold.choose_in_turns(empty, 0)
