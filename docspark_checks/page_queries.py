"""HTML pages: title, noise, links, lists, tables, Markdown."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import html as h
from docspark.operators import extract
from docspark.session import checkpoint_dir
from docspark.sources import files
from docspark_checks import fixtures
from docspark_checks.fixtures import duck
from docspark_checks.registry import query, table, text_table

_DECODE = (
    "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
)
_NOISE = "html"
for _tag in h.NOISE_TAGS:
    _NOISE = f"regexp_replace({_NOISE}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"
_CLEAN = f"regexp_replace({_NOISE}, '(?s)<!--.*?-->', '', 'g')"


@query(
    "html_title",
    f"""SELECT page_id, trim(regexp_replace({_DECODE.format("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')) AS title FROM pages""",
)
def html_title(spark: SparkSession, sf: str) -> DataFrame:
    pages = text_table(spark, sf, "pages").select("page_id", "html")
    return extract.titles(pages)


@query("html_noise_strip", f"SELECT page_id, sha256({_CLEAN}) AS hash, len({_CLEAN}) AS n FROM pages")
def html_noise_strip(spark: SparkSession, sf: str) -> DataFrame:
    clean = text_table(spark, sf, "pages").select(
        "page_id", h.strip_noise(F.col("html")).alias("clean")
    )
    return clean.select("page_id", F.sha2("clean", 256).alias("hash"), F.length("clean").alias("n"))


@query(
    "html_links",
    "SELECT p_partkey, 1 AS link_no, p_brand AS text, '/brand/' || p_brand AS href FROM part",
)
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    return extract.links(fixtures.part_pages(spark, sf))


_ANCHOR = "regexp_extract_all({0}, '(?is)<a [^>]*href=\"[^\"]*\"[^>]*>.*?</a>')"


@query(
    "page_links",
    f"""WITH c AS (SELECT page_id, {_ANCHOR.format('html')} AS found FROM pages),
 a AS (SELECT page_id, unnest(found) AS tag, generate_subscripts(found, 1) AS link_no FROM c)
 SELECT page_id, link_no, trim(regexp_replace({_DECODE.format("regexp_replace(tag, '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS text, regexp_extract(tag, 'href="([^"]*)"', 1) AS href FROM a""",
)
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of the raw pages, which stand in their navigation."""
    return extract.links(text_table(spark, sf, "pages").select("page_id", "html"), furniture=True)


@query(
    "menu_items",
    f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS ls FROM pages),
 i AS (SELECT page_id, unnest(ls) AS li, generate_subscripts(ls, 1) AS item_no FROM l)
 SELECT page_id, item_no, '  - [' || {_DECODE.format("regexp_extract(li, '>(.*)</a>', 1)")} || '](' || regexp_extract(li, 'href="([^"]*)"', 1) || ')' AS item FROM i""",
)
def menu_items(spark: SparkSession, sf: str) -> DataFrame:
    """The lists of the raw pages, which stand in their navigation."""
    lists = F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<ul>.*?</ul>"), 0), "")
    items = F.filter(F.split(h.html_blocks(lists), "\n"), lambda s: s.rlike(r"^ +(-|\d+\.) "))
    rows = text_table(spark, sf, "pages").select("page_id", F.posexplode(items).alias("p", "item"))
    return rows.select("page_id", (F.col("p") + 1).alias("item_no"), "item")


_MESSY_MARKDOWN = (
    "'bar ' || CAST(p_partkey AS VARCHAR) || chr(10) || 'Keep [link ' || CAST(p_partkey AS VARCHAR) || '](/p/' || CAST(p_partkey AS VARCHAR) "
    "|| ') and x *it* by ' || p_brand || '.' || chr(10) || 'card not code' || chr(10) || 'end' || chr(10)"
)


@query("html_messy", f"SELECT p_partkey, {_MESSY_MARKDOWN} AS markdown FROM part")
def html_messy(spark: SparkSession, sf: str) -> DataFrame:
    """Custom elements, elements without an end, attributes without quotes."""
    return extract.to_markdown(fixtures.messy_pages(spark, sf))


# Expected Markdown of a part page, written from its layout.
_KEY, _SIZE = "CAST(p_partkey AS VARCHAR)", "CAST(p_size AS VARCHAR)"
EXPECTED_LIST = (
    f"'  - Brand ' || p_brand || '\\n  - Sizes\\n    - Size ' || {_SIZE} || '\\n  1. first\\n  2. second'"
)
EXPECTED_GRID = (
    f"'| Category | Name | Value |\\n| --- | --- | --- |\\n| ' || p_brand || ' | type | ' || p_type || ' |\\n| ' || p_brand "
    f"|| ' | size | ' || {_SIZE} || ' |\\n| name of |   | ' || p_name || ' |'"
)
EXPECTED_PAIRS = f"'- Part ' || {_KEY} || ': ' || p_name || '\\n- size: ' || {_SIZE} || '\\n- empty: '"
EXPECTED = (
    f"'# Part ' || {_KEY} || '\\nMade by [' || p_brand || '](/brand/' || p_brand || ') as **' || p_type || '**, size *' || {_SIZE} "
    f"|| '*.\\nNext line <ok> é\\n![Photo ' || {_KEY} || '](p' || {_KEY} || '.png)\\n' || {EXPECTED_LIST} "
    f"|| '\\n## Code\\n\\n```\\nline 1 < ' || {_SIZE} || '\\n  line 2\\n```\\n\\n### Tables\\n\\n' || {EXPECTED_GRID} "
    f"|| '\\n\\nbetween\\n\\n' || rtrim({EXPECTED_PAIRS}) || '\\n'"
)


@query("html_to_markdown", duck(f"SELECT p_partkey, {EXPECTED} AS markdown FROM part"))
def html_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return extract.to_markdown(fixtures.part_pages(spark, sf))


@query(
    "html_list_items",
    duck(f"""WITH t AS (SELECT p_partkey, string_split({EXPECTED_LIST}, '\\n') AS ls FROM part)
 SELECT p_partkey, unnest(range(1, 6)) AS item_no, unnest(ls) AS item FROM t"""),
)
def html_list_items(spark: SparkSession, sf: str) -> DataFrame:
    flow = h.html_blocks(h.flow_text(h.segments(h.strip_noise(F.col("html")), "pre", "table")))
    items = F.filter(F.split(flow, "\n"), lambda s: s.rlike(r"^ +(-|\d+\.) "))
    rows = fixtures.part_pages(spark, sf).select("p_partkey", F.posexplode(items).alias("p", "item"))
    return rows.select("p_partkey", (F.col("p") + 1).alias("item_no"), "item")


@query(
    "html_table_grid",
    f"""WITH g AS (SELECT p_partkey, 1 AS table_no, [['Category', 'Name', 'Value'], [p_brand, 'type', p_type], [p_brand, 'size', {_SIZE}], ['name of', '', p_name]] AS rs FROM part
  UNION ALL SELECT p_partkey, 2, [['Part ' || {_KEY}, p_name, ''], ['size', {_SIZE}, ''], ['empty', '', '']] FROM part),
 r AS (SELECT p_partkey, table_no, unnest(rs) AS cs, generate_subscripts(rs, 1) AS row_no FROM g)
 SELECT p_partkey, table_no, row_no, generate_subscripts(cs, 1) AS col_no, unnest(cs) AS text FROM r""",
)
def html_table_grid(spark: SparkSession, sf: str) -> DataFrame:
    return extract.page_table_cells(fixtures.part_pages(spark, sf))


@query(
    "html_table_render",
    duck(f"""SELECT p_partkey, 1 AS table_no, {EXPECTED_GRID} AS markdown FROM part
 UNION ALL SELECT p_partkey, 2, {EXPECTED_PAIRS} || ' ' FROM part"""),
)
def html_table_render(spark: SparkSession, sf: str) -> DataFrame:
    return extract.rendered_tables(fixtures.part_pages(spark, sf))


_FLOW = f"regexp_replace({_CLEAN}, '(?is)<head\\b.*?</head>|<![^>]*>', '', 'g')"
_STEPS = (
    ("\\s+", "' '"), ("(?i) ?<br\\b[^>]*> ?", "chr(10)"), ("(?i)<h1\\b[^>]*> ?", "chr(10) || '# '"),
    ("(?i)<h2\\b[^>]*> ?", "chr(10) || '## '"), ("(?i)</h[1-6]\\s*>", "chr(10)"),
    ("(?i)</?b\\b[^>]*>", "'**'"), ("(?i)</?(?:article|body|div|html|p)\\b[^>]*>", "chr(10)"),
    ("<[/a-zA-Z][^>]*>", "''"),
)
for _pattern, _into in _STEPS:
    _FLOW = f"regexp_replace({_FLOW}, '{_pattern}', {_into}, 'g')"
_TIDY = f"trim(regexp_replace(regexp_replace({_DECODE.format(_FLOW)}, ' {{2,}}', ' ', 'g'), ' *\\n[ \\n]*', chr(10), 'g'), chr(10) || ' ')"


@query(
    "page_markdown",
    f"""WITH t AS (SELECT page_id, {_TIDY} AS body, trim(regexp_replace({_DECODE.format("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')) AS title FROM pages)
 SELECT page_id, CASE WHEN title <> '' AND NOT starts_with(body, '# ') THEN trim('# ' || title || chr(10) || chr(10) || body) ELSE body END || chr(10) AS markdown FROM t""",
)
def page_markdown(spark: SparkSession, sf: str) -> DataFrame:
    pages = text_table(spark, sf, "pages").select("page_id", "html")
    return extract.to_markdown(pages)


def page_folder(spark: SparkSession, sf: str) -> str:
    """The pages as files of their own below a folder."""
    path = f"{checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    files.write_texts(table(spark, sf, "pages").select("html", "page_id"), path, "page_id", "html")
    return path


@query("read_files", "SELECT page_id, sha256(html || chr(10)) AS hash FROM pages")
def read_files(spark: SparkSession, sf: str) -> DataFrame:
    """Pages found again as files of a tree, read whole; files of other kinds and empty ones lie beside them."""
    raw = files.read_raw(spark, page_folder(spark, sf))
    page = F.regexp_extract("source_path", r"page_id=(\d+)/", 1).cast("bigint")
    return raw.select(page.alias("page_id"), F.sha2("raw", 256).alias("hash"))
