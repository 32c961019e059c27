"""Sentences, packing, headers and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import markdown as md
from docspark.functions import text as tx
from docspark.functions.fold import bind
from docspark.operators import chunking, long_documents
from docspark_checks import fixtures
from docspark_checks.registry import query, text_table

LIMIT = 1200
# without the text around chunks, as the layouts of the twins have it; `section_chunks_full` keeps it
CONFIG = chunking.ChunkConfig(LIMIT, 1, keep_text=False)
STAMP = "2026-01-01 00:00:00"

# ---- SQL building blocks of the twins
COLLAPSED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def sentences_sql(text: str) -> str:
    cut = f"regexp_replace({COLLAPSED.format(text)}, '([.!?]) ', '\\1' || chr(1), 'g')"
    return f"list_filter(string_split({cut}, chr(1)), lambda s: s <> '')"


def runs_sql(lens: str, joins: str, glue: int) -> str:
    """Run number of every item: greedy by total length.

    `lens` is a list of struct(len, may, force, closes); `joins` a condition on
    total a.tot, item x.
    """
    state = (
        f"list_transform({lens}, lambda it: {{'tot': it.len::BIGINT, 'may': it.may, "
        "'force': it.force, 'closes': it.closes, 'g': 1::BIGINT, 'gs': [1::BIGINT]})"
    )
    together = f"(x.may AND NOT a.closes AND ({joins}))"
    return (
        f"list_reduce({state}, lambda a, x: {{"
        f"'tot': CASE WHEN {together} THEN a.tot + {glue} + x.tot ELSE x.tot END, "
        "'may': x.may, 'force': x.force, 'closes': x.closes, "
        f"'g': CASE WHEN {together} THEN a.g ELSE a.g + 1 END, "
        f"'gs': list_append(a.gs, CASE WHEN {together} THEN a.g ELSE a.g + 1 END)}}).gs"
    )


def long_words_sql(text: str, limit: int) -> str:
    """Pieces of a text with more than one word and no word above the limit."""
    words = f"string_split({COLLAPSED.format(text)}, ' ')"
    items = (
        f"list_transform({words}, lambda w: {{'len': len(w), 'may': true, 'force': false, "
        "'closes': false})"
    )
    runs = runs_sql(items, f"a.tot + 1 + x.tot <= {limit}", 1)
    return (
        f"(SELECT list(piece ORDER BY g) FROM (SELECT g, string_agg(w, ' ' ORDER BY i) AS piece FROM "
        f"(SELECT unnest({words}) AS w, unnest({runs}) AS g, generate_subscripts({words}, 1) AS i) "
        "GROUP BY g))"
    )


def units_sql(source: str, key: str, text: str) -> str:
    """CTE body: sentences of `text` per key, long ones cut at words, as `us`."""
    return f"""
 s0 AS (SELECT {key}, unnest({sentences_sql(text)}) AS s, generate_subscripts({sentences_sql(text)}, 1) AS i FROM {source}),
 w0 AS (SELECT {key}, i, string_split(s, ' ') AS ws, len(s) > {LIMIT} AS big, s FROM s0),
 w1 AS (SELECT *, CASE WHEN big THEN {runs_sql("list_transform(ws, lambda w: {'len': len(w), 'may': true, 'force': false, 'closes': false})", f"a.tot + 1 + x.tot <= {LIMIT}", 1)} END AS gs FROM w0),
 w2 AS (SELECT {key}, i, 1::BIGINT AS g, s AS t FROM w1 WHERE NOT big
   UNION ALL SELECT {key}, i, g, string_agg(w, ' ' ORDER BY j) FROM (SELECT {key}, i, unnest(ws) AS w, unnest(gs) AS g, generate_subscripts(ws, 1) AS j FROM w1 WHERE big) GROUP BY {key}, i, g),
 us AS (SELECT {key}, list({{'k': 'text', 't': t}} ORDER BY i, g) AS us FROM w2 GROUP BY {key})"""


def packed_sql(key: str) -> str:
    """CTEs from `us` to packed, merged and overlapped pieces."""
    fragment = (
        "len(t) < 80 AND NOT regexp_matches(t, '[.!?:;]$') AND NOT contains(t, '```') "
        "AND NOT contains(t, '~~~')"
    )
    return f"""
 p0 AS (SELECT {key}, us, {runs_sql("list_transform(us, lambda u: {'len': len(u.t), 'may': u.k = 'text', 'force': false, 'closes': u.k <> 'text'})", f"a.tot + 2 + x.tot <= {LIMIT}", 2)} AS gs FROM us),
 p1 AS (SELECT {key}, unnest(us) AS u, unnest(gs) AS g, generate_subscripts(us, 1) AS i FROM p0),
 packed AS (SELECT {key}, g, string_agg(u.t, chr(10) || chr(10) ORDER BY i) AS t, max(i) AS last_i FROM p1 GROUP BY {key}, g),
 m0 AS (SELECT {key}, list(g ORDER BY g) AS packs, list({{'len': len(t), 'may': {fragment}, 'force': len(t) < 40, 'closes': false}} ORDER BY g) AS its FROM packed GROUP BY {key}),
 m1 AS (SELECT {key}, packs, {runs_sql("its", f"x.force OR a.tot + 2 + x.tot <= {LIMIT}", 2)} AS ms FROM m0),
 m2 AS (SELECT {key}, unnest(packs) AS g, unnest(ms) AS m FROM m1),
 merged AS (SELECT {key}, m, string_agg(t, chr(10) || chr(10) ORDER BY g) AS t FROM packed JOIN m2 USING ({key}, g) GROUP BY {key}, m),
 lastu AS (SELECT {key}, m, arg_max(u.t, i) FILTER (u.k = 'text') AS u FROM p1 JOIN m2 USING ({key}, g) GROUP BY {key}, m),
 overlapped AS (SELECT a.{key}, a.m, CASE WHEN l.u IS NOT NULL AND len(l.u) + 2 + len(a.t) <= {LIMIT} THEN l.u || chr(10) || chr(10) || a.t ELSE a.t END AS t
   FROM merged a LEFT JOIN lastu l ON l.{key} = a.{key} AND l.m = a.m - 1)"""


DOC_UNITS = "WITH " + units_sql("documents", "doc_id", "text")


def _pieces(df: DataFrame, pieces) -> DataFrame:
    return df.select("doc_id", F.posexplode(pieces).alias("p", "piece")).select(
        "doc_id", (F.col("p") + 1).alias("piece_no"), "piece"
    )


def _units(spark: SparkSession, sf: str):
    docs = text_table(spark, sf, "documents")
    return docs, md.units(tx.text_lines(F.col("text")), LIMIT)


@query(
    "sentence_split",
    f"""SELECT doc_id, unnest(range(1, len(ss) + 1)) AS sentence_no, unnest(ss) AS sentence
 FROM (SELECT doc_id, {sentences_sql('text')} AS ss FROM documents)""",
)
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = text_table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("p", "sentence")).select(
        "doc_id", (F.col("p") + 1).alias("sentence_no"), "sentence"
    )


@query(
    "split_long_fragments",
    f"""WITH w AS (SELECT doc_id, len(trim(text)) <= 200 AS fits, trim(text) AS whole, string_split({COLLAPSED.format('text')}, ' ') AS ws FROM documents),
 r AS (SELECT *, {runs_sql("list_transform(ws, lambda w: {'len': len(w), 'may': true, 'force': false, 'closes': false})", "a.tot + 1 + x.tot <= 200", 1)} AS gs FROM w)
 SELECT doc_id, 1 AS piece_no, whole AS piece FROM r WHERE fits
 UNION ALL SELECT doc_id, g, string_agg(w, ' ' ORDER BY i) FROM (SELECT doc_id, unnest(ws) AS w, unnest(gs) AS g, generate_subscripts(ws, 1) AS i FROM r WHERE NOT fits) GROUP BY doc_id, g""",
)
def split_long_fragments(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(text_table(spark, sf, "documents"), tx.split_long(F.col("text"), 200))


_LETTERS = "regexp_replace(text, '[^A-Za-z]', '', 'g')"


@query(
    "split_long_words",
    f"""WITH w AS (SELECT doc_id, {_LETTERS} AS t FROM documents)
 SELECT doc_id, unnest(range(1, (len(t) - 1) // 200 + 2)) AS piece_no, unnest(list_transform(range(0, (len(t) - 1) // 200 + 1), lambda i: substr(t, i * 200 + 1, 200))) AS piece FROM w WHERE t <> ''""",
)
def split_long_words(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as one long word: all of its slices are kept."""
    docs = text_table(spark, sf, "documents").withColumn("text", F.regexp_replace("text", "[^A-Za-z]", ""))
    return _pieces(docs, tx.split_long(F.col("text"), 200))


@query(
    "pack_chunks",
    DOC_UNITS + "," + packed_sql("doc_id") + " SELECT doc_id, g AS piece_no, t AS piece FROM packed",
)
def pack_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs, us = _units(spark, sf)
    packed = F.transform(md.pack_units(us, LIMIT), md.render)
    return _pieces(docs, packed)


@query(
    "merge_fragments",
    DOC_UNITS + "," + packed_sql("doc_id") + " SELECT doc_id, m AS piece_no, t AS piece FROM merged",
)
def merge_fragments(spark: SparkSession, sf: str) -> DataFrame:
    docs, us = _units(spark, sf)
    merged = md.merge_fragments(md.pack_units(us, LIMIT), LIMIT)
    return _pieces(docs, F.transform(merged, md.render))


@query(
    "chunk_overlap",
    DOC_UNITS + "," + packed_sql("doc_id")
    + f""" SELECT doc_id, 1 AS piece_no, 1 AS pieces, trim(text) AS piece FROM documents WHERE len(trim(text)) <= {LIMIT}
 UNION ALL SELECT o.doc_id, m, count(*) OVER (PARTITION BY o.doc_id), t FROM overlapped o JOIN documents d ON d.doc_id = o.doc_id WHERE len(trim(text)) > {LIMIT}""",
)
def chunk_overlap(spark: SparkSession, sf: str) -> DataFrame:
    docs = text_table(spark, sf, "documents").select("doc_id", "text")
    return chunking.cap_texts(docs, "text", CONFIG).select(
        "doc_id",
        F.col("subchunk_ordem").alias("piece_no"),
        F.col("subchunk_total").alias("pieces"),
        F.col("texto").alias("piece"),
    )


_ROWS = "list_transform(string_split(text, chr(10)), lambda l, i: '| ' || i || ' | ' || l || ' |')"
_HEAD = "| No | Text |\n| --- | --- |"


@query(
    "table_units_split",
    f"""WITH r AS (SELECT doc_id, {_ROWS} AS rs FROM documents),
 g AS (SELECT doc_id, rs, {runs_sql("list_transform(rs, lambda r: {'len': len(r), 'may': true, 'force': false, 'closes': false})", f"a.tot + 1 + x.tot <= 600 - {len(_HEAD) + 1}", 1)} AS gs FROM r)
 SELECT doc_id, g AS piece_no, '| No | Text |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(r, chr(10) ORDER BY i) AS piece
 FROM (SELECT doc_id, unnest(rs) AS r, unnest(gs) AS g, generate_subscripts(rs, 1) AS i FROM g) GROUP BY doc_id, g""",
)
def table_units_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = text_table(spark, sf, "documents")
    rows = F.transform(
        F.split("text", "\n", -1),
        lambda line, i: F.concat(
            F.lit("| "), (i + 1).cast("string"), F.lit(" | "), line, F.lit(" |")
        ),
    )
    head = F.array(F.lit("| No | Text |"), F.lit("| --- | --- |"))
    return _pieces(docs, md.split_table(F.concat(head, rows), 600))


@query(
    "chunk_hash",
    """SELECT doc_id, sha256(text) AS doc_hash, sha256(trim(text)) AS text_hash FROM documents""",
)
def chunk_hash(spark: SparkSession, sf: str) -> DataFrame:
    docs = text_table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        chunking.doc_hash(F.col("text")).alias("doc_hash"),
        F.sha2(tx.strip(F.col("text")), 256).alias("text_hash"),
    )


# ---- headers and sections on the Markdown documents

LINES_SQL = (
    "WITH "
    + fixtures.MARKDOWN_SQL
    + """,
 ls AS (SELECT doc_id, source_path, CASE WHEN text LIKE '%' || chr(10) THEN left(text, len(text) - 1) ELSE text END AS text FROM md),
 ln AS (SELECT doc_id, source_path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM ls),
 hd AS (SELECT *, regexp_extract(trim(line), '^(#{1,6})\\s+(.+)$', 1) AS marks, regexp_extract(line, '^((?:\\d+\\.)+)\\s+(\\S.*)$', 1) AS num FROM ln),
 h AS (SELECT doc_id, source_path, line_no, line,
   CASE WHEN marks <> '' THEN len(marks) WHEN num <> '' AND trim(line) = line THEN len(num) - len(replace(num, '.', '')) END AS level,
   CASE WHEN marks <> '' THEN NULL WHEN num <> '' AND trim(line) = line THEN left(num, len(num) - 1) END AS number,
   CASE WHEN marks <> '' THEN trim(regexp_extract(trim(line), '^(#{1,6})\\s+(.+)$', 2)) WHEN num <> '' AND trim(line) = line THEN trim(regexp_extract(line, '^((?:\\d+\\.)+)\\s+(\\S.*)$', 2)) END AS title FROM hd)"""
)


@query(
    "header_parse",
    LINES_SQL + " SELECT doc_id, line_no, level, coalesce(number, '') AS number, title FROM h WHERE level IS NOT NULL",
)
def header_parse(spark: SparkSession, sf: str) -> DataFrame:
    docs = fixtures.markdown(spark, sf).select("doc_id", "text")
    return chunking.header_rows(docs).withColumn("number", F.coalesce("number", F.lit("")))


@query(
    "chunk_level",
    LINES_SQL
    + " SELECT doc_id, coalesce(max(level) FILTER (level <= 3), max(level), 1) AS chunk_level FROM h GROUP BY doc_id",
)
def chunk_level(spark: SparkSession, sf: str) -> DataFrame:
    docs = fixtures.markdown(spark, sf)
    return docs.select("doc_id", chunking.chunk_level(F.col("text")).alias("chunk_level"))


SECTION_SQL = (
    LINES_SQL
    + """,
 cl AS (SELECT doc_id, coalesce(max(level) FILTER (level <= 3), max(level), 1) AS cl FROM h GROUP BY doc_id),
 x AS (SELECT h.*, cl, row_number() OVER (PARTITION BY h.doc_id ORDER BY line_no) AS rn FROM h JOIN cl USING (doc_id)),
 b AS (SELECT *, sum(CASE WHEN level <= cl THEN 1 ELSE 0 END) OVER w AS brk,
   max(CASE WHEN level = 1 THEN line_no END) OVER w AS l1, max(CASE WHEN level = 2 THEN line_no END) OVER w AS l2
   FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
 top AS (SELECT doc_id, brk, line_no AS pos, l1, l2, title, number FROM b WHERE level = cl),
 body AS (SELECT t.doc_id, t.pos, string_agg(b.line, chr(10) ORDER BY b.line_no) AS content
   FROM top t JOIN b ON b.doc_id = t.doc_id AND b.brk = t.brk AND (b.line_no = t.pos OR (b.level IS NULL AND trim(b.line) <> '')) GROUP BY t.doc_id, t.pos),
 named AS (SELECT t.*, body.content, h1.title AS t1, h1.number AS n1, h2.title AS t2, h2.number AS n2
   FROM top t JOIN body USING (doc_id, pos)
   LEFT JOIN h h1 ON h1.doc_id = t.doc_id AND h1.line_no = t.l1
   LEFT JOIN h h2 ON h2.doc_id = t.doc_id AND h2.line_no = t.l2 AND (t.l1 IS NULL OR t.l2 > t.l1))"""
)


@query(
    "section_chunks",
    SECTION_SQL
    + """ SELECT md.source_path, row_number() OVER (PARTITION BY named.doc_id, l1 ORDER BY pos) AS chunk_ordem,
   coalesce(t1, 'doc_' || md.doc_id) AS nome_software, title AS titulo, trim(content) AS content FROM named JOIN md ON md.doc_id = named.doc_id""",
)
def section_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = fixtures.markdown(spark, sf).select("source_path", "text")
    return chunking.raw_chunks(docs, keep_text=False).select(
        "source_path", "chunk_ordem", "nome_software", "titulo", "content"
    )


_TAIL_MARK = "chr(10) || '## Tables' || chr(10) || 'Tail line'"
_SHOWN = "array_to_string(list_filter(string_split({0}, chr(10)), lambda l: trim(l) <> ''), chr(10))"


@query(
    "section_chunks_full",
    "WITH "
    + fixtures.MARKDOWN_SQL
    + f""", x AS (
 SELECT source_path, 1 AS chunk_ordem, '# ' || source || chr(10) || 'Intro ' || lang || chr(10) || '## ' || lang || ' part' || chr(10) || '### Topic ' || doc_id || chr(10)
   || body || chr(10) || '#### Deep ' || doc_id || chr(10) || 'Deep body.' AS content FROM md WHERE doc_id % 6 = 0
 UNION ALL SELECT source_path, 2, '### Notes' || chr(10) || 'See also the manual.' || {_TAIL_MARK} FROM md WHERE doc_id % 6 = 0
 UNION ALL SELECT source_path, 1, '1. Manual ' || source || chr(10) || '1.1. Area ' || lang || chr(10) || '1.1.1. Question ' || doc_id || '?' || chr(10) || '    ' || body FROM md WHERE doc_id % 6 = 1
 UNION ALL SELECT source_path, 1, '## ' || lang || chr(10) || body FROM md WHERE doc_id % 6 = 4
 UNION ALL SELECT source_path, 2, '## Second ' || doc_id || chr(10) || 'Body two.' FROM md WHERE doc_id % 6 = 4
 UNION ALL SELECT source_path, 1, '# ' || source || chr(10) || '## Data' || chr(10) || '| Key | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| id | ' || doc_id || ' |' || chr(10) || '| lang | '
   || lang || ' |' || chr(10) || '~~~' || chr(10) || 'code ' || doc_id || chr(10) || '```' || chr(10) || '~~~' || chr(10) || body FROM md WHERE doc_id % 6 = 5)
 SELECT source_path, chunk_ordem, trim({_SHOWN.format('content')}) AS content FROM x""",
)
def section_chunks_full(spark: SparkSession, sf: str) -> DataFrame:
    """The same documents with every line that shows something kept."""
    docs = fixtures.markdown(spark, sf).select("source_path", "text")
    return chunking.raw_chunks(docs).select("source_path", "chunk_ordem", "content")


_LABEL = "CASE WHEN {n} IS NOT NULL THEN {n} || ' - ' || {t} ELSE {t} END"


@query(
    "header_hierarchy",
    SECTION_SQL
    + f""" SELECT source_path, line_of, CASE WHEN number IS NOT NULL THEN concat_ws(' - ', number, t2)
   ELSE concat_ws(' > ', {_LABEL.format(n='n1', t='t1')}, {_LABEL.format(n='n2', t='t2')}, title) END AS hierarquia
   FROM (SELECT md.source_path, row_number() OVER (PARTITION BY named.doc_id ORDER BY pos) AS line_of, number, title, t1, n1, t2, n2 FROM named JOIN md ON md.doc_id = named.doc_id)""",
)
def header_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    docs = fixtures.markdown(spark, sf).select("source_path", "text")
    found = bind(
        chunking._marked_lines(F.col("text")),
        lambda ms: F.filter(
            chunking._regions(ms, F.lit("")), lambda r: r["kind"] == "chunk"
        ),
    )
    rows = docs.select("source_path", F.posexplode(found).alias("p", "r"))
    _, hierarquia = chunking.chunk_metadata(F.lit(""), F.col("r.h1"), F.col("r.h2"), F.col("r.hc"))
    return rows.select(
        "source_path", (F.col("p") + 1).alias("line_of"), hierarquia.alias("hierarquia")
    )


# Expected records per layout, straight from the layout.
_STEM = "'doc_' || doc_id"
_TITLE_AT = (
    "list_position(list_transform(string_split(body, chr(10)), lambda l: trim(l) <> '' AND len(trim(l)) <= 80 "
    "AND NOT regexp_matches(trim(l), '[.:;!?]$') AND regexp_matches(l, '\\p{L}') "
    "AND len(trim(l)) - len(replace(trim(l), ' ', '')) <= 10), true)"
)
_NO_UNITS = "[]::STRUCT(k VARCHAR, t VARCHAR)[]"
RECORDS_SQL = (
    "WITH "
    + fixtures.MARKDOWN_SQL
    + f""",
 lay AS (SELECT *, doc_id % 6 AS lay, {_TITLE_AT} AS title_at, string_split(body, chr(10)) AS bl FROM md),
 tab AS (SELECT *, '| Key | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| id | ' || doc_id || ' |' || chr(10) || '| lang | ' || lang || ' |' AS tbl,
   '~~~' || chr(10) || 'code ' || doc_id || chr(10) || '```' || chr(10) || '~~~' AS code FROM lay),
 reg AS (
  SELECT doc_id, 1 AS block_no, 'chunk' AS kind, 1 AS ordem, source AS soft, 'Topic ' || doc_id AS titulo, source || ' > ' || lang || ' part > Topic ' || doc_id AS hier,
    '### Topic ' || doc_id || chr(10) || body || chr(10) || 'Deep body.' AS content, {_NO_UNITS} AS pre, NULL AS rest FROM tab WHERE lay = 0
  UNION ALL SELECT doc_id, 1, 'chunk', 2, source, 'Notes', source || ' > ' || lang || ' part > Notes', '### Notes' || chr(10) || 'See also the manual.', {_NO_UNITS}, NULL FROM tab WHERE lay = 0
  UNION ALL SELECT doc_id, 1, 'chunk', 1, 'Manual ' || source, 'Question ' || doc_id || '?', '1.1.1 - Area ' || lang, '1.1.1. Question ' || doc_id || '?' || chr(10) || '    ' || body, {_NO_UNITS}, NULL FROM tab WHERE lay = 1
  UNION ALL SELECT doc_id, 1, 'block', 0, 'Manual ' || source, 'Manual ' || source, '', body, {_NO_UNITS}, NULL FROM tab WHERE lay = 2
  UNION ALL SELECT doc_id, 1, 'block', 0, trim(bl[title_at]), trim(bl[title_at]), '', array_to_string(bl[title_at + 1:], chr(10)), {_NO_UNITS}, NULL FROM tab WHERE lay = 3 AND title_at > 0
  UNION ALL SELECT doc_id, 0, 'whole', 1, {_STEM}, 'Conteúdo do Dataset', '', trim(body), {_NO_UNITS}, NULL FROM tab WHERE lay = 3 AND coalesce(title_at, 0) = 0
  UNION ALL SELECT doc_id, 1, 'chunk', 1, {_STEM}, lang, lang || ' > ' || lang, '## ' || lang || chr(10) || body, {_NO_UNITS}, NULL FROM tab WHERE lay = 4
  UNION ALL SELECT doc_id, 1, 'chunk', 2, {_STEM}, 'Second ' || doc_id, 'Second ' || doc_id || ' > Second ' || doc_id, '## Second ' || doc_id || chr(10) || 'Body two.', {_NO_UNITS}, NULL FROM tab WHERE lay = 4
  UNION ALL SELECT doc_id, 1, 'chunk', 1, source, 'Data', source || ' > Data > Data', '## Data' || chr(10) || tbl || chr(10) || code || chr(10) || body,
    [{{'k': 'text', 't': '## Data'}}, {{'k': 'table', 't': tbl}}, {{'k': 'code', 't': code}}], body FROM tab WHERE lay = 5
  UNION ALL SELECT doc_id, 2, 'block', 0, 'Second ' || source, 'Second ' || source, '', '# Second ' || source || chr(10) || 'End.', {_NO_UNITS}, NULL FROM tab WHERE lay = 5),
 regs AS (SELECT *, doc_id * 10 + block_no * 3 + ordem AS rid, kind = 'block' OR (kind = 'chunk' AND len(trim(content)) > {LIMIT}) AS cut FROM reg),
 cutr AS (SELECT rid, coalesce(rest, content) AS text FROM regs WHERE cut),"""
    + units_sql("cutr", "rid", "text").replace(" us AS (SELECT", " us0 AS (SELECT")
    + """,
 us AS (SELECT rid, list_concat(regs.pre, us0.us) AS us FROM us0 JOIN regs USING (rid)),"""
    + packed_sql("rid")
    + """,
 recs AS (SELECT r.*, m::BIGINT AS sub, count(*) OVER (PARTITION BY r.rid) AS total, t FROM regs r JOIN overlapped o ON o.rid = r.rid WHERE cut
  UNION ALL SELECT r.*, 1, 1, trim(content) FROM regs r WHERE NOT cut),
 topics AS (SELECT md.source_path, block_no, soft AS nome_software,
   CASE WHEN kind = 'block' THEN ordem + sub ELSE ordem END AS chunk_ordem,
   CASE WHEN kind = 'chunk' THEN sub ELSE 1 END AS subchunk_ordem, CASE WHEN kind = 'chunk' THEN total ELSE 1 END AS subchunk_total,
   CASE WHEN kind = 'chunk' AND total > 1 THEN hier || ' | Parte ' || sub || '/' || total WHEN kind = 'chunk' THEN hier ELSE 'Chunk ' || sub END AS hierarquia,
   titulo, t AS texto, kind FROM recs JOIN md ON md.doc_id = recs.doc_id)"""
)
_RECORD_COLUMNS = (
    "source_path, block_no, nome_software, chunk_ordem, subchunk_ordem, subchunk_total, hierarquia, "
    "titulo, texto"
)


def records(spark: SparkSession, sf: str) -> DataFrame:
    docs = fixtures.markdown(spark, sf).select("source_path", "text")
    return chunking.topic_records(docs, CONFIG, F.lit(STAMP).cast("timestamp"))


@query(
    "subchunk_numbering",
    RECORDS_SQL
    + f" SELECT {_RECORD_COLUMNS}, sha256(texto) AS conteudo_hash, '2026-01-01T00:00:00Z' AS ingestao_em FROM topics",
)
def subchunk_numbering(spark: SparkSession, sf: str) -> DataFrame:
    names = [c.strip() for c in _RECORD_COLUMNS.split(",")]
    return records(spark, sf).select(*names, "conteudo_hash", "ingestao_em")


@query(
    "fallback_chunks",
    RECORDS_SQL + f" SELECT {_RECORD_COLUMNS} FROM topics WHERE kind <> 'chunk'",
)
def fallback_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = fixtures.markdown(spark, sf).select("source_path", "text")
    names = [c.strip() for c in _RECORD_COLUMNS.split(",")]
    stamp = F.lit(STAMP).cast("timestamp")
    return chunking.fallback_chunks(docs, CONFIG, stamp).select(*names)


@query(
    "software_blocks",
    RECORDS_SQL
    + """ SELECT DISTINCT md.source_path, block_no, soft AS nome_software, kind = 'chunk' AS has_chunks FROM reg JOIN md USING (doc_id) WHERE kind <> 'whole'""",
)
def software_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.software_blocks(fixtures.markdown(spark, sf).select("source_path", "text"))


@query(
    "whole_documents",
    RECORDS_SQL + f" SELECT {_RECORD_COLUMNS} FROM topics WHERE kind = 'whole'",
)
def whole_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = fixtures.markdown(spark, sf).select("source_path", "text")
    names = [c.strip() for c in _RECORD_COLUMNS.split(",")]
    stamp = F.lit(STAMP).cast("timestamp")
    return chunking.whole_documents(docs, CONFIG, stamp).select(*names)


@query(
    "long_document_records",
    RECORDS_SQL
    + f" SELECT {_RECORD_COLUMNS}, sha256(texto) AS conteudo_hash, '2026-01-01T00:00:00Z' AS ingestao_em FROM topics",
)
def long_document_records(spark: SparkSession, sf: str) -> DataFrame:
    """The records of documents given as tables of lines, in segments of 16 lines."""
    lines = chunking.lines(fixtures.markdown(spark, sf).select("source_path", "text"))
    names = [c.strip() for c in _RECORD_COLUMNS.split(",")]
    found = long_documents.topic_records(lines, CONFIG, F.lit(STAMP).cast("timestamp"), segment_lines=16)
    return found.select(*names, "conteudo_hash", "ingestao_em")
