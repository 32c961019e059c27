"""Gold questions on the Markdown documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import prompts
from docspark.operators import gold
from docspark_checks import fixtures
from docspark_checks.chunk_queries import sentences_sql
from docspark_checks.registry import query

TARGET, SEED = 50, 42

_H = "regexp_extract(trim(line), '^(#{{1,6}})\\s+(.+)$', {0})"
SECTIONS_SQL = (
    "WITH "
    + fixtures.MARKDOWN_SQL
    + f""",
 ls AS (SELECT doc_id, source_path, CASE WHEN text LIKE '%' || chr(10) THEN left(text, len(text) - 1) ELSE text END AS text FROM md),
 ln AS (SELECT doc_id, source_path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM ls),
 h AS (SELECT *, nullif(len({_H.format(1)}), 0) AS lv, {_H.format(2)} AS title FROM ln),
 dt AS (SELECT doc_id, arg_min(CASE WHEN lv = 1 THEN title ELSE trim(line) END, n) AS doc_title FROM h
   WHERE trim(line) <> '' AND (lv = 1 OR (NOT regexp_matches(trim(line), '^[#\\-*|]') AND len(trim(line)) <= 120)) GROUP BY doc_id),
 w AS (SELECT *, count(lv) OVER o AS sno, max(CASE WHEN lv = 1 THEN n END) OVER o AS l1, max(CASE WHEN lv = 2 THEN n END) OVER o AS l2, max(CASE WHEN lv = 3 THEN n END) OVER o AS l3
   FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
 hd AS (SELECT * FROM w WHERE lv IS NOT NULL),
 bodies AS (SELECT doc_id, sno, string_agg(line, chr(10) ORDER BY n) AS body FROM w WHERE lv IS NULL AND sno > 0 GROUP BY doc_id, sno),
 s1 AS (SELECT a.doc_id, a.source_path, a.sno AS section_no, a.lv AS nivel, a.title AS titulo_secao,
   concat_ws(' > ', CASE WHEN a.lv > 1 THEN h1.title END, CASE WHEN a.lv > 2 AND (a.l1 IS NULL OR a.l2 > a.l1) THEN h2.title END,
     CASE WHEN a.lv > 3 AND a.l3 > greatest(coalesce(a.l1, 0), coalesce(a.l2, 0)) THEN h3.title END, a.title) AS secao,
   trim(coalesce(body, ''), chr(10) || ' ') AS conteudo
   FROM hd a LEFT JOIN bodies USING (doc_id, sno)
   LEFT JOIN hd h1 ON h1.doc_id = a.doc_id AND h1.n = a.l1 LEFT JOIN hd h2 ON h2.doc_id = a.doc_id AND h2.n = a.l2 LEFT JOIN hd h3 ON h3.doc_id = a.doc_id AND h3.n = a.l3),
 s2 AS (SELECT * FROM s1 WHERE conteudo <> '' OR nivel = 1),
 titled AS (SELECT md.doc_id, md.source_path, coalesce(doc_title, 'doc_' || md.doc_id) AS titulo_documento, md.text FROM md LEFT JOIN dt ON dt.doc_id = md.doc_id),
 sec AS (SELECT t.doc_id, t.source_path, t.titulo_documento, section_no, nivel, titulo_secao, secao, conteudo FROM s2 JOIN titled t ON t.doc_id = s2.doc_id
   UNION ALL SELECT doc_id, source_path, titulo_documento, 1, 1, titulo_documento, titulo_documento, trim(text, chr(10) || ' ') FROM titled WHERE doc_id NOT IN (SELECT doc_id FROM s2))"""
)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.markdown(spark, sf).select("source_path", "text")


@query(
    "gold_sections",
    SECTIONS_SQL
    + " SELECT source_path, titulo_documento, section_no, nivel, titulo_secao, secao, conteudo FROM sec",
)
def gold_sections(spark: SparkSession, sf: str) -> DataFrame:
    return gold.sections(_docs(spark, sf))


_STOP = ", ".join(f"'{w}'" for w in gold.STOP_WORDS)
KEYWORDS_SQL = (
    SECTIONS_SQL
    + f""",
 tok AS (SELECT source_path, section_no, unnest(ws) AS raw, generate_subscripts(ws, 1) AS at FROM
   (SELECT source_path, section_no, regexp_extract_all(titulo_secao || ' ' || titulo_documento || ' ' || conteudo, '{gold.WORD}') AS ws FROM sec)),
 kept AS (SELECT source_path, section_no, trim(lower(raw), '{gold.WORD_EDGES}') AS w, at AS pos FROM tok),
 cnt AS (SELECT source_path, section_no, w, count(*) AS n, min(pos) AS first FROM kept WHERE len(w) >= 3 AND w NOT IN ({_STOP}) GROUP BY ALL),
 top AS (SELECT * FROM cnt QUALIFY row_number() OVER (PARTITION BY source_path, section_no ORDER BY n DESC, first) <= 5),
 kw AS (SELECT source_path, section_no, list(w ORDER BY n DESC, first) AS ks FROM top GROUP BY ALL)"""
).replace("AS at FROM\n", "AS pos0 FROM\n").replace("at AS pos", "pos0 AS pos")


@query(
    "keywords_topk",
    KEYWORDS_SQL + " SELECT source_path, section_no, array_to_string(ks, ',') AS palavras_chave FROM kw",
)
def keywords_topk(spark: SparkSession, sf: str) -> DataFrame:
    words = gold._section_keywords("titulo_secao", "titulo_documento", "conteudo")
    return gold.sections(_docs(spark, sf)).select(
        "source_path", "section_no", F.array_join(words, ",").alias("palavras_chave")
    )


_TEXT = "lower(titulo_secao || ' ' || conteudo)"
_CATEGORY = (
    "CASE "
    + " ".join(
        f"WHEN regexp_matches({_TEXT}, '{'|'.join(terms)}') THEN '{name}'"
        for name, terms in gold.CATEGORY_TERMS
    )
    + f" ELSE '{gold.DEFAULT_CATEGORY}' END"
)


@query("categorise", SECTIONS_SQL + f" SELECT source_path, section_no, {_CATEGORY} AS categoria FROM sec")
def categorise(spark: SparkSession, sf: str) -> DataFrame:
    return gold.sections(_docs(spark, sf)).select(
        "source_path",
        "section_no",
        gold.category(F.col("titulo_secao"), F.col("conteudo")).alias("categoria"),
    )


_GENERIC = ", ".join(f"'{t}'" for t in gold.GENERIC_TITLES)


def _template(text: str) -> str:
    parts = text.replace("{", "\0{").replace("}", "}\0").split("\0")
    names = {"{document}": "titulo_documento", "{focus}": "focus"}
    return " || ".join(names.get(p, f"'{p}'") for p in parts if p)


_QUESTION = (
    "CASE categoria "
    + " ".join(
        f"WHEN '{name}' THEN CASE WHEN odd THEN {_template(b)} ELSE {_template(a)} END"
        for name, (a, b) in gold.QUESTION_TEMPLATES.items()
    )
    + " END"
)
CANDIDATES_SQL = (
    KEYWORDS_SQL
    + f""",
 c0 AS (SELECT sec.*, ks, {_CATEGORY} AS categoria, regexp_matches(sha256(sec.source_path || '|' || secao), '[13579bdf]$') AS odd FROM sec LEFT JOIN kw USING (source_path, section_no)),
 c1 AS (SELECT *, (len(conteudo) > 900)::INT + (len(conteudo) > 1800)::INT + (nivel >= 3)::INT + (categoria IN ('diagnostico', 'referencia'))::INT + (contains(conteudo, '```') OR contains(conteudo, '|'))::INT AS points,
   CASE WHEN lower(trim(titulo_secao)) IN ({_GENERIC}) OR len(trim(titulo_secao)) < 4 THEN array_to_string(ks[1:2], ' ') ELSE trim(titulo_secao) END AS focus FROM c0),
 cand AS (SELECT *, CASE WHEN points <= 1 THEN 'facil' WHEN points <= 3 THEN 'medio' ELSE 'dificil' END AS dificuldade, {_QUESTION} AS pergunta FROM c1)"""
)


@query("difficulty", CANDIDATES_SQL + " SELECT source_path, section_no, dificuldade FROM cand")
def difficulty(spark: SparkSession, sf: str) -> DataFrame:
    return gold.candidates(_docs(spark, sf)).select("source_path", "section_no", "dificuldade")


@query("template_question", CANDIDATES_SQL + " SELECT source_path, section_no, pergunta FROM cand")
def template_question(spark: SparkSession, sf: str) -> DataFrame:
    return gold.candidates(_docs(spark, sf)).select("source_path", "section_no", "pergunta")


_STRIPPED = "conteudo"
for _pattern, _into in (
    ("`([^`]+)`", "'\\1'"), ("\\[([^\\]]+)\\]\\(([^)]+)\\)", "'\\1'"), ("[*_>#-]+", "' '"),
):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '{_pattern}', {_into}, 'g')"
_STRIPPED = f"replace({_STRIPPED}, '|', ' ')"
ANSWERS_SQL = (
    CANDIDATES_SQL
    + f""",
 a0 AS (SELECT *, array_to_string(({sentences_sql(_STRIPPED)})[1:2], ' ') AS e FROM cand),
 a1 AS (SELECT *, CASE WHEN len(e) > 550 THEN rtrim(substr(e, 1, 547)) || '...' ELSE e END AS cut FROM a0),
 ans AS (SELECT *, CASE WHEN cut = '' THEN 'A documentação de ' || titulo_documento || ' trata de ' || titulo_secao || '.'
   WHEN categoria = 'procedimento' THEN '{gold.ANSWER_PREFIX}' || titulo_secao || ': ' || cut ELSE cut END AS resposta_ideal FROM a1)"""
)


@query("ideal_answer", ANSWERS_SQL + " SELECT source_path, section_no, resposta_ideal FROM ans")
def ideal_answer(spark: SparkSession, sf: str) -> DataFrame:
    found = gold.candidates(_docs(spark, sf))
    answer = gold.ideal_answer(
        *[F.col(c) for c in ("conteudo", "titulo_secao", "titulo_documento", "categoria")]
    )
    return found.select("source_path", "section_no", answer.alias("resposta_ideal"))


PICK_SQL = (
    ANSWERS_SQL
    + f""",
 dr AS (SELECT *, sha256('{SEED}|' || source_path || '|' || secao || '|' || section_no) AS draw FROM ans),
 uq AS (SELECT * FROM dr QUALIFY row_number() OVER (PARTITION BY pergunta ORDER BY draw) = 1),
 tiers AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source_path ORDER BY draw) <= 2 THEN 0 ELSE 1 END AS tier, count(*) OVER (PARTITION BY categoria) AS size FROM uq),
 turns AS (SELECT *, row_number() OVER (PARTITION BY categoria ORDER BY tier, draw) AS turn FROM tiers),
 picked AS (SELECT *, row_number() OVER (ORDER BY turn, size DESC, categoria) AS ordem FROM turns QUALIFY row_number() OVER (ORDER BY turn, size DESC, categoria) <= {TARGET})"""
)


@query(
    "stratified_pick",
    PICK_SQL + " SELECT source_path, section_no, secao, categoria, pergunta, ordem FROM picked",
)
def stratified_pick(spark: SparkSession, sf: str) -> DataFrame:
    return gold.choose(gold.candidates(_docs(spark, sf)), TARGET, SEED).drop("draw")


@query(
    "gold_rows",
    PICK_SQL
    + """ SELECT 'q_' || left(sha256(source_path || '|' || secao || '|' || pergunta), 16) AS id, pergunta, resposta_ideal, source_path, titulo_documento, secao,
 array_to_string(ks, ',') AS palavras_chave, categoria, dificuldade, ordem FROM picked""",
)
def gold_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = gold.build_gold(_docs(spark, sf), TARGET, SEED)
    return rows.withColumn("palavras_chave", F.array_join("palavras_chave", ","))


_PROMPT_HEAD = prompts.QUESTION_PROMPT_HEAD.replace("\n", "' || chr(10) || '")


@query(
    "question_prompt",
    CANDIDATES_SQL
    + f""" SELECT source_path, section_no, sha256('{_PROMPT_HEAD}Documento: ' || titulo_documento || chr(10) || 'Seção: ' || secao || chr(10) || 'Título da seção: ' || titulo_secao || chr(10)
 || 'Palavras-chave sugeridas: ' || coalesce(array_to_string(ks, ', '), 'nenhuma') || chr(10) || 'Categoria: ' || categoria || chr(10) || 'Dificuldade: ' || dificuldade || chr(10) || chr(10)
 || 'Trecho de referência:' || chr(10) || conteudo || chr(10) || chr(10) || '{prompts.QUESTION_PROMPT_TAIL}') AS hash FROM cand""",
)
def question_prompt(spark: SparkSession, sf: str) -> DataFrame:
    columns = (
        "titulo_documento", "secao", "titulo_secao", "palavras_chave", "categoria", "dificuldade",
        "conteudo",
    )
    prompt = prompts.question_prompt(*[F.col(c) for c in columns])
    return gold.candidates(_docs(spark, sf)).select(
        "source_path", "section_no", F.sha2(prompt, 256).alias("hash")
    )


@query(
    "written_questions",
    PICK_SQL
    + """, asked AS (SELECT *, CASE WHEN ordem % 3 = 0 THEN 'How does number ' || ordem || ' work?' ELSE pergunta END AS q FROM picked)
 SELECT 'q_' || left(sha256(source_path || '|' || secao || '|' || q), 16) AS id, q AS pergunta, source_path, secao, ordem FROM asked""",
)
def written_questions(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the questions gets a valid reply, a third one that is too short, the rest none."""
    rows = gold.build_gold(_docs(spark, sf), TARGET, SEED)
    reply = F.when(F.col("ordem") % 3 == 0, F.concat(F.lit('"How does number  '), F.col("ordem").cast("string"), F.lit(' work"'))).otherwise("Why?")
    written = rows.where("ordem % 3 < 2").select("id", reply.alias("reply"))
    return gold.with_written_questions(rows, written).select("id", "pergunta", "source_path", "secao", "ordem")


@query("pick_in_turns")
def pick_in_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The choice turn by turn, in which a source that one class uses up is passed over by the others."""
    return gold.choose_in_turns(gold.candidates(_docs(spark, sf)), TARGET, SEED).drop("draw")
