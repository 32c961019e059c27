"""Tables derived row by row from the driver tables.

The expressions are SQL both engines read, so Spark and the SQL twin start from
the same rows. All rows of the source tables are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark_checks.registry import text_table

# ---- Markdown documents, one per row of `documents`, in six layouts.
MARKDOWN_PATH = "'docs_markdown/' || source || '/doc_' || CAST(doc_id AS STRING) || '.md'"
_ID = "CAST(doc_id AS STRING)"
MARKDOWN_TEXT = f"""CASE doc_id % 6
 WHEN 0 THEN '# ' || source || '\\nIntro ' || lang || '\\n\\n## ' || lang || ' part\\n### Topic ' || {_ID}
   || '\\n' || text || '\\n#### Deep ' || {_ID} || '\\nDeep body.\\n### Notes\\nSee also the manual.\\n## Tables\\nTail line\\n'
 WHEN 1 THEN '1. Manual ' || source || '\\n\\n1.1. Area ' || lang || '\\n\\n1.1.1. Question ' || {_ID}
   || '?\\n    ' || text || '\\n'
 WHEN 2 THEN 'Manual ' || source || '\\n\\n' || text
 WHEN 3 THEN text
 WHEN 4 THEN '## ' || lang || '\\n' || text || '\\n## Second ' || {_ID} || '\\nBody two.\\n'
 ELSE '# ' || source || '\\n## Data\\n| Key | Value |\\n| --- | --- |\\n| id | ' || {_ID} || ' |\\n| lang | '
   || lang || ' |\\n\\n~~~\\ncode ' || {_ID} || '\\n```\\n~~~\\n' || text || '\\n# Second ' || source || '\\nEnd.\\n'
END"""

# ---- HTML pages, one per row of `part`.
_KEY = "CAST(p_partkey AS STRING)"
_SIZE = "CAST(p_size AS STRING)"
PAGE_HTML = f"""'<!doctype html><html><head><title>Part ' || {_KEY} || ' &amp; more</title><style>p {{}}</style></head><body>'
 || '<nav><ul><li>Home</li></ul></nav><div class="top breadcrumb"><div>Catalog</div>' || p_brand || '</div>'
 || '<aside><aside>inner</aside>outer</aside><div id="main-menu">menu</div><div role="navigation">go</div>'
 || '<h1>Part ' || {_KEY} || '</h1><!-- note --><p>Made by <a class="x" href="/brand/' || p_brand || '">' || p_brand
 || '</a> as <b>' || p_type || '</b>,\\n   size <em>' || {_SIZE} || '</em>.<br>Next line &lt;ok&gt; &#233;</p>'
 || '<img src="p' || {_KEY} || '.png" alt="Photo ' || {_KEY} || '"/><script>var a = "<p>";</script>'
 || '<ul><li>Brand ' || p_brand || '</li><li>Sizes<ul><li>Size ' || {_SIZE} || '</li></ul></li></ul>'
 || '<ol><li>first</li><li>second</li></ol><h2>Code</h2><pre>\\nline 1 &lt; ' || {_SIZE} || '\\n  line 2\\n</pre><pre>  </pre>'
 || '<h3>Tables</h3><table><tr><th>Category</th><th>Name</th><th>Value</th></tr><tr><td rowspan="2">' || p_brand
 || '</td><td>type</td><td>' || p_type || '</td></tr><tr><td>size</td><td>' || {_SIZE} || '</td></tr><tr><td colspan="2">name <i>of</i></td><td>'
 || p_name || '</td></tr></table><p>between</p><table><tr><td>Part ' || {_KEY} || '</td><td>' || p_name || '</td><td></td></tr><tr><td>size</td><td>'
 || {_SIZE} || '</td></tr><tr><td>empty</td><td> </td></tr></table><footer>end</footer></body></html>'"""

# ---- Untidy pages, one per row of `part`.
MESSY_HTML = f"""'<body><nav-bar>bar ' || {_KEY} || '</nav-bar><div><nav>menu ' || p_type || '</div><p>Keep <a href=/p/' || {_KEY}
 || '>link ' || {_KEY} || '</a> and <i-icon>x</i-icon> <i>it</i> by ' || p_brand || '.</p><NAV class=low>y</NAV><title-card>card</title-card> '
 || '<pre-view>not code</pre-view><section><aside>gone<ul><li>gone too</ul></section><p>end</p></body>'"""

# ---- Result log, one row per event.
_J = "CAST(1 + CAST(FLOOR(event_id / {j}) AS BIGINT) % 5 AS DOUBLE)"
_SCORES = {
    "groundedness": 1, "corretude": 2, "completude": 3, "clareza": 4, "precisao_tecnica": 5,
    "alucinacao": 6,
}
_TOP_K = "CASE WHEN user_id % 4 < 2 THEN 4 ELSE 10 END"
_RANK = f"NULLIF(event_id % (({_TOP_K}) + 1), 0)"
_HIT = f"CASE WHEN ({_RANK}) IS NULL THEN 0.0 ELSE 1.0 END"
LOG: dict[str, str] = {
    "row_no": "event_id",
    "id": "'q' || CAST(user_id AS STRING)",
    "pergunta": "'Question number ' || CAST(user_id AS STRING)",
    "resposta_ideal": "'ideal ' || event_type",
    "variacao_retrieval": (
        "CASE user_id % 4 WHEN 0 THEN 'baseline' WHEN 1 THEN 'baseline_traduzido' "
        "WHEN 2 THEN 'topk_aumentado' ELSE 'topk_aumentado_traduzido' END"
    ),
    "modelo": "event_type",
    "resposta": "event_type || ' answer ' || props",
    "contexto": "CASE WHEN event_id % 13 = 0 THEN ' ' ELSE props END",
    "tempo_resposta_s": "value",
    "input_tokens": "CAST(10 + event_id % 90 AS DOUBLE)",
    "output_tokens": "CAST(event_id % 40 AS DOUBLE)",
    "tokens": "CAST(10 + event_id % 90 + event_id % 40 AS DOUBLE)",
    "answer_length": "CAST(LENGTH(event_type || ' answer ' || props) AS DOUBLE)",
    "question_length": "CAST(LENGTH('Question number ' || CAST(user_id AS STRING)) AS DOUBLE)",
    "top_k": f"CAST({_TOP_K} AS BIGINT)",
    "chunks_recuperados": "CAST(event_id % 5 AS DOUBLE)",
    "retrieved_rank": f"CAST({_RANK} AS BIGINT)",
    "retrieval_hit": f"({_RANK}) IS NOT NULL",
    "hit_rate_at_k": f"CAST({_HIT} AS DOUBLE)",
    "hit_rate_at_1": f"CAST(CASE WHEN ({_RANK}) <= 1 THEN 1.0 ELSE 0.0 END AS DOUBLE)",
    "hit_rate_at_3": f"CAST(CASE WHEN ({_RANK}) <= 3 THEN 1.0 ELSE 0.0 END AS DOUBLE)",
    "hit_rate_at_4": f"CAST(CASE WHEN ({_RANK}) <= 4 THEN 1.0 ELSE 0.0 END AS DOUBLE)",
    "recall_at_k": f"CAST({_HIT} AS DOUBLE)",
    "precision_at_k": f"CAST({_HIT} AS DOUBLE) / CAST({_TOP_K} AS DOUBLE)",
    "mrr": f"COALESCE(CAST(1.0 AS DOUBLE) / CAST({_RANK} AS DOUBLE), CAST(0.0 AS DOUBLE))",
    "similaridade_media_chunks": (
        "CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(1.0 AS DOUBLE) / (1 + ABS(value)) END"
    ),
    "context_truncated": "event_id % 3 = 0",
    **{
        f"{topic}_score": f"CASE WHEN event_id % 11 = 0 THEN NULL ELSE {_J.format(j=j)} END"
        for topic, j in _SCORES.items()
    },
}


def select_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in columns.items())


def duck(expression: str) -> str:
    """SQL text for the twin: the one type name that differs, and line breaks."""
    return expression.replace("AS STRING", "AS VARCHAR").replace("\\n", "' || chr(10) || '")


# WITH parts of the twins
MARKDOWN_SQL = duck(
    f"md AS (SELECT doc_id, source, lang, text AS body, {MARKDOWN_PATH} AS source_path, "
    f"{MARKDOWN_TEXT} AS text FROM documents)"
)
PAGE_SQL = duck(f"pg AS (SELECT p_partkey, {PAGE_HTML} AS html FROM part)")
LOG_SQL = duck(f"log AS (SELECT {select_list(LOG)} FROM events)")


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    return text_table(spark, sf, "documents").selectExpr(
        "doc_id", f"{MARKDOWN_PATH} AS source_path", f"{MARKDOWN_TEXT} AS text"
    )


def part_pages(spark: SparkSession, sf: str) -> DataFrame:
    return text_table(spark, sf, "part").selectExpr("p_partkey", f"{PAGE_HTML} AS html")


def messy_pages(spark: SparkSession, sf: str) -> DataFrame:
    return text_table(spark, sf, "part").selectExpr("p_partkey", f"{MESSY_HTML} AS html")


def log(spark: SparkSession, sf: str) -> DataFrame:
    return text_table(spark, sf, "events").selectExpr(*[f"{e} AS {n}" for n, e in LOG.items()])
