from pyspark.sql import functions as F

from docspark.functions import html as h
from docspark.operators import extract

RYE = """<html lang=en><head><title>Rye bread &ndash; a week with the starter</title><style>b {}</style></head>
<body class=recipe><header><a href=/start>start</a></header><section><h2>Monday</h2><p>Stir <b>50&nbsp;g</b> of
<a title="the mill" href='flour?kind=rye'>flour</a> into water.<br>Wait.</p><ol><li>cover</li><li>rest<ul><li>warm</li></ul></li></ol></section>
<section><h2>Sunday</h2><figure><img alt='a loaf' src=loaf.jpg></figure><pre>220 C
  40 min</pre></section><aside class=x>Other recipes</aside></body></html>"""


def test_a_page_keeps_its_structure_and_order(one):
    assert one(h.markdown, RYE) == (
        "# Rye bread - a week with the starter\n\n## Monday\nStir **50 g** of [flour](flour?kind=rye) into water.\nWait.\n"
        "  1. cover\n  2. rest\n    - warm\n## Sunday\n![a loaf](loaf.jpg)\n\n```\n220 C\n  40 min\n```\n"
    )


def test_cells_over_rows_repeat_and_over_columns_leave_blanks(one):
    tides = (
        "<table><tr><td>Harbour</td><td colspan=2>High water</td></tr><tr><td rowspan=3>North pier</td><td>02:10</td><td>4.1</td></tr>"
        "<tr><td>14:35</td><td>4.4</td></tr><tr><td>closed</td></tr></table>"
    )
    grid = one(lambda c: h.table_grid(h.table_rows(c)), tides)
    assert grid == [
        ["Harbour", "High water", ""], ["North pier", "02:10", "4.1"], ["North pier", "14:35", "4.4"], ["North pier", "closed", ""],
    ]


def test_names_of_elements_end_where_they_end(one, many):
    page = "<p>a</p><nav-bar>x</nav-bar><p>KEEP</p><nav>y</nav><p>b</p>"
    assert one(h.strip_noise, page) == "<p>a</p><nav-bar>x</nav-bar><p>KEEP</p><p>b</p>"
    pages = ["<i-icon>z</i-icon> <i>t</i>", "<pre-view>no code</pre-view>", "<title-bar>no title</title-bar><p>x</p>", "<br-x>a<br>b"]
    assert many(h.markdown, pages) == ["z *t*\n", "no code\n", "no title\nx\n", "a\nb\n"]


def test_an_element_without_end_stops_with_its_parent(many):
    pages = [
        "<div><nav>menu</div><p>KEEP</p>", "<div><nav>menu</div><p>KEEP</p><nav>y</nav>", "<section><aside>x<ul><li>y</ul></section><p>KEEP</p>",
        "<p>KEEP</p><form>rest", "<div><nav><div>in</div><b>x</b></div><p>KEEP</p>",
    ]
    assert many(h.strip_noise, pages) == ["<div></div><p>KEEP</p>"] * 2 + ["<section></section><p>KEEP</p>", "<p>KEEP</p>", "<div></div><p>KEEP</p>"]


def test_links_with_and_without_quotes(one, spark):
    page = "<a href=/x>one</a> <a class=b href='/y'>two</a> <a href=\"/z\">three</a> <a name=q>none</a>"
    assert one(h.html_blocks, page) == "[one](/x) [two](/y) [three](/z) none"
    found = extract.links(spark.createDataFrame([(1, page)], "id int, html string")).collect()
    assert [(r["link_no"], r["text"], r["href"]) for r in found] == [(1, "one", "/x"), (2, "two", "/y"), (3, "three", "/z")]


def test_spans_in_several_columns_run_down(one):
    table = (
        "<table><tr><td rowspan=3>a</td><td>b</td><td rowspan=2 colspan=2>c</td></tr>"
        "<tr><td>d</td></tr><tr><td>e</td><td>f</td><td>g</td></tr></table>"
    )
    grid = one(lambda c: h.table_grid(h.table_rows(c)), table)
    assert grid == [["a", "b", "c", ""], ["a", "d", "c", ""], ["a", "e", "f", "g"]]


def test_rows_without_header_become_pairs(one):
    table = "<table><tr><td>Key 1</td><td>v</td><td>w</td></tr><tr><td>k2</td><td></td></tr></table>"
    assert one(lambda c: h.render_table(h.table_rows(c)), table) == "- Key 1: v w\n- k2:  "


def test_header_rows(many):
    rows = [["Item", "Qty."], ["a", "b"], ["a", "a"], ["a 1", "b"], ["", "b"], ["one"], ["value", "value"]]
    assert many(h.is_header_row, rows, "array<string>") == [True, True, False, False, False, False, True]


def test_noise_nested_in_its_own_kind(many):
    pages = [
        "<aside><aside>x</aside>y</aside>keep", '<div class="a breadcrumb"><div>x</div>y</div>keep',
        '<p role="navigation">x</p>keep', "<form>x<button>y</button></form>keep<script>if (a<b) {}</script>",
        '<span id="mainmenu">x</span>keep', "keep<!-- <p>x</p> -->", '<nav class="a">x</nav>keep',
    ]
    assert many(h.strip_noise, pages) == ["keep"] * len(pages)


def test_titles(many):
    pages = [
        "<title> A &amp; B </title><h1>C</h1>", "<h2>Second <b>x</b></h2><h1>First</h1>", "<title></title><h1>H</h1>",
        "<title>  </title><h1>H</h1>", "<p>none</p>", "<table><tr><td><h1>in table</h1></td></tr></table><h2>out</h2>",
    ]
    titles = many(lambda c: h.page_title(h.flow_text(h.segments(c, "pre", "table"))), pages)
    assert titles == ["A & B", "Second x", "H", "", "", "out"]


def test_preformatted_blocks_are_fenced(many):
    pages = ["<p>a</p><pre>\n x &lt; 1\n\ty\n</pre><p>b</p>", "<pre>  </pre><p>b</p>"]
    assert many(h.markdown, pages) == ["a\n\n```\n x < 1\n\ty\n```\n\nb\n", "b\n"]


def test_lists_indent_and_count(one):
    page = "<ul><li>a<ol><li>x</li><li>y</li></ol></li><li>b</li></ul>"
    assert one(h.markdown, page) == "- a\n    1. x\n    2. y\n  - b\n"


def test_title_goes_first_unless_there_is_one(many):
    pages = ["<head><title>T</title></head><p>x</p>", "<head><title>T</title></head>", "<h1>H</h1><p>x</p>", "<h2>S</h2>"]
    assert many(h.markdown, pages) == ["# T\n\nx\n", "# T\n", "# H\nx\n", "# S\n\n## S\n"]


def test_entities(many):
    assert many(h.decode_entities, ["&#233;&#xE9;&lt;&amp;lt;&#x1F600;&bad;&#;", "a & b"]) == ["éé<&lt;😀&bad;&#;", "a & b"]


def test_ten_and_more_tables_do_not_mix(one):
    page = "".join(f"<p>p{i}</p><table><tr><td>key {i}</td><td>v{i}</td></tr></table>" for i in range(12))
    md = one(h.markdown, page)
    assert [f"- key {i}: v{i}" in md for i in range(12)] == [True] * 12


def test_conversion_mirrors_paths(spark):
    raw = spark.createDataFrame([("/docs/A/b/about.htm", "<h1>Título</h1><p>Texto</p>")], "source_path string, raw string")
    row = extract.convert(raw, "/docs", "/out").first()
    assert row["output_path"] == "/out/A/b/about.md" and row["markdown"].startswith("# Título")
    assert "Exchange" not in extract.convert(raw, "/docs", "/out")._jdf.queryExecution().executedPlan().toString()
