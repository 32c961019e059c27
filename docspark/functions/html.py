"""HTML as column expressions: noise, title, tables, Markdown text.

A page is one row. Its tags are found by one regular expression; ranges of
nested elements come from a fold over the tags only. Nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions import text as tx
from docspark.functions.fold import bind, empty, fold_emit

# Elements and attributes that mark page furniture.
NOISE_TAGS = (
    "nav", "header", "footer", "aside", "script", "style", "noscript", "form", "button", "iframe",
)
NOISE_CLASS_PARTS = ("breadcrumb", "related-links")
NOISE_ID_PARTS = ("breadcrumb", "nav", "menu")
# Words that mark a header row of a table.
HEADER_WORDS = (
    "item", "item no.", "qty.", "quantity", "part number", "description",
    "symbol", "example", "value", "valor", "categoria", "category",
)
# Elements without content.
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track",
    "wbr",
)
# Elements whose end tag is often left out.
OPTIONAL_END = (
    "p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "option", "optgroup",
    "colgroup", "rt", "rp",
)
# Elements that start and end a line of their own.
BLOCK_TAGS = (
    "address|article|body|center|dd|details|div|dl|dt|fieldset|figcaption|figure|head|html|legend|"
    "main|ol|p|section|summary|tbody|td|tfoot|th|thead|title|tr|ul"
)
# Named characters beside the numeric ones.
ENTITIES = (
    ("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("copy", "(C)"),
    ("mdash", "--"), ("ndash", "-"), ("hellip", "..."), ("rsquo", "'"), ("lsquo", "'"),
    ("rdquo", '"'), ("ldquo", '"'), ("amp", "&"),
)

_NOISE_WORDS = "(?i)breadcrumb|related-links|nav|menu"
# what may follow the name of an element in its tag
_END = r"(?=[\s/>])"
_NOISE_OPEN = r"(?i)^<(?:" + "|".join(NOISE_TAGS) + ")" + _END
# decimal digits, and the super-, subscript and circled ones
DIGIT = r"[\p{Nd}\u00b2\u00b3\u00b9\u2070-\u2079\u2080-\u2089\u2460-\u2468]"
TOKEN = r"(?s)<!--.*?-->|<[!?/a-zA-Z][^>]*>|[^<]+|<"
RANGE_TYPE = "struct<start:int,stop:int,tag:string>"
_INDENT, _HEADING = "\x01", "\x02"


def tokens(html: Column) -> Column:
    """Tags, comments and text runs of a page, in order."""
    return F.regexp_extract_all(html, F.lit(TOKEN), 0)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in an open tag; null if it is not there."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    parts = [F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]
    return F.when(tag.rlike(pattern), F.concat(*parts))


def _tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1))


def _is_noise(token: Column, name: Column) -> Column:
    def holds(attr: str, parts: tuple[str, ...]) -> Column:
        return F.coalesce(attribute(token, attr).rlike("|".join(parts)), F.lit(False))

    return name.isin(*NOISE_TAGS) | (
        token.contains("=")
        & token.rlike(_NOISE_WORDS)
        & (
            F.coalesce(attribute(token, "role") == "navigation", F.lit(False))
            | holds("class", NOISE_CLASS_PARTS)
            | holds("id", NOISE_ID_PARTS)
        )
    )


def element_ranges(toks: Column, opens: Column | None = None, tags: tuple[str, ...] = ()) -> Column:
    """Token ranges of the outermost matching elements, nesting respected.

    Matching are the given `tags`, or noise elements if none are given. An
    element that is never closed ends before the end tag of the element around
    it, or at the end of the page. Ranges are 1-based and include both tags.
    """

    def numbers(ts: Column) -> Column:
        return F.when(F.size(ts) > 0, F.sequence(F.lit(1), F.size(ts))).otherwise(empty("int"))

    def token(ts: Column, i: Column) -> Column:
        return F.get(ts, i - 1)

    def named(ts: Column) -> Column:
        """Element names that can open a range; a page has few of them."""
        if tags:
            return F.array(*[F.lit(t) for t in tags])
        opening = F.filter(
            ts,
            lambda t: t.startswith("<")
            & (t.rlike(_NOISE_OPEN) | (t.contains("=") & t.rlike(_NOISE_WORDS)))
            & ~t.startswith("</"),
        )
        hits = F.filter(opening, lambda t: _is_noise(t, _tag_name(t)))
        return F.array_distinct(F.transform(hits, _tag_name))

    def marks(ts: Column) -> Column:
        """The tags that can open, nest in or close a range; all tags if some of them lack their end."""

        def mark(t: Column, i: Column) -> Column:
            return bind(
                _tag_name(t),
                lambda name: F.struct(
                    i.alias("i"),
                    name.alias("name"),
                    t.startswith("</").alias("close"),
                    (~t.startswith("</") & (F.lit(True) if tags else _is_noise(t, name))).alias(
                        "hit"
                    ),
                    (t.endswith("/>") | name.isin(*VOID_TAGS)).alias("void"),
                ),
            )

        def chosen(own: Column) -> Column:
            ends = F.size(F.filter(own, lambda i: token(ts, i).startswith("</")))
            alone = F.size(F.filter(own, lambda i: token(ts, i).endswith("/>")))
            every = F.filter(numbers(ts), lambda i: token(ts, i).rlike("^</?[a-zA-Z]"))
            return F.when(2 * ends + alone == F.size(own), own).otherwise(every)

        return bind(
            named(ts),
            lambda names: F.transform(
                bind(
                    F.when(
                        F.size(names) > 0,
                        F.filter(
                            numbers(ts),
                            lambda i: token(ts, i).startswith("<")
                            & F.array_contains(names, _tag_name(token(ts, i))),
                        ),
                    ).otherwise(empty("int")),
                    chosen,
                ),
                lambda i: mark(token(ts, i), i),
            ),
        )

    def st(tag: Column, depth: Column, start: Column, inner: Column | None = None) -> Column:
        return F.struct(
            tag.cast("string").alias("tag"),
            depth.cast("int").alias("depth"),
            start.cast("int").alias("start"),
            (F.lit(0) if inner is None else inner).cast("int").alias("inner"),
        )

    def span(s: Column, stop: Column) -> Column:
        return F.array(
            F.struct(
                s["start"].alias("start"), stop.cast("int").alias("stop"), s["tag"].alias("tag")
            )
        )

    nothing = empty(RANGE_TYPE)

    def step(s: Column, k: Column) -> tuple[Column, Column]:
        outside = s["depth"] == 0
        same = ~outside & (k["name"] == s["tag"])
        ends = same & k["close"] & (s["depth"] == 1)
        alone = outside & k["hit"] & k["void"]
        nxt = (
            F.when(outside & k["hit"] & ~k["void"], st(k["name"], F.lit(1), k["i"]))
            .when(same & k["close"], st(s["tag"], s["depth"] - 1, s["start"]))
            .when(same & ~k["void"], st(s["tag"], s["depth"] + 1, s["start"]))
            .otherwise(s)
        )
        out = (
            F.when(ends, span(s, k["i"]))
            .when(alone, span(st(k["name"], F.lit(0), k["i"]), k["i"]))
            .otherwise(nothing)
        )
        return nxt, out

    def within(s: Column, k: Column) -> tuple[Column, Column]:
        """As `step`, with the elements inside a range counted: one more end tag is that of a parent."""
        inside, other = s["depth"] > 0, k["name"] != s["tag"]
        counts = inside & other & ~k["void"] & ~k["name"].isin(*OPTIONAL_END)
        parent = counts & k["close"] & (s["inner"] == 0)
        plain, out = step(s, k)
        change = F.when(k["close"], -1).otherwise(1)
        nxt = (
            F.when(parent, st(F.lit(""), F.lit(0), F.lit(0)))
            .when(counts, st(s["tag"], s["depth"], s["start"], s["inner"] + change))
            .otherwise(plain)
        )
        return nxt, F.when(parent, span(s, k["i"] - 1)).otherwise(out)

    return bind(
        toks,
        lambda ts: fold_emit(
            marks(ts),
            st(F.lit(""), F.lit(0), F.lit(0)),
            RANGE_TYPE,
            within,
            lambda s: F.when(s["depth"] > 0, span(s, F.size(ts))).otherwise(nothing),
        ),
    )


def _gaps(ranges: Column, n: Column) -> Column:
    """Token ranges between the given ones, as ``struct<start, n>``."""
    return bind(
        ranges,
        lambda rs: F.transform(
            F.sequence(F.lit(0), F.size(rs)),
            lambda j: bind(
                F.when(j == 0, F.lit(1)).otherwise(F.get(rs, j - 1)["stop"] + 1),
                lambda a: F.struct(
                    a.alias("start"),
                    (F.coalesce(F.get(rs, j)["start"], n + 1) - a).alias("n"),
                ),
            ),
        ),
    )


_SIMPLE_NOISE = (
    r"(?is)<!--.*?-->|<(" + "|".join(NOISE_TAGS) + ")" + _END + r"[^>]*(?<!/)>.*?</\1\s*>"
)
_OPENED = r"(?i)<(?:" + "|".join(NOISE_TAGS) + ")" + _END
_CLOSED = r"(?i)</(?:" + "|".join(NOISE_TAGS) + ")" + _END
_NOISE_LEFT = (
    r"(?is)</?(?:" + "|".join(NOISE_TAGS) + ")" + _END + r"|<[^>]+\s(?:role\s*=\s*[\"']?navigation"
    r"|(?:class|id)\s*=\s*(?:\"[^\"]*|'[^']*|[^\s>]*)(?:breadcrumb|related-links|nav|menu))"
)


def strip_noise(html: Column) -> Column:
    """Page without scripts, navigation, forms and other furniture.

    A regular expression removes elements that do not nest; pages where an
    element nests in its own kind or lacks its end, or where an attribute marks
    noise, go through the token ranges.
    """

    def by_ranges(page: Column) -> Column:
        return bind(
            tokens(page),
            lambda ts: F.array_join(
                F.flatten(
                    F.transform(
                        _gaps(element_ranges(ts), F.size(ts)),
                        lambda g: F.slice(ts, g["start"], g["n"]),
                    )
                ),
                "",
            ),
        )

    return bind(
        F.struct(html.alias("raw"), F.regexp_replace(html, _SIMPLE_NOISE, "").alias("cut")),
        lambda p: F.when(
            p["cut"].rlike(_NOISE_LEFT)
            | (
                F.regexp_count(p["raw"], F.lit(_OPENED)) != F.regexp_count(p["raw"], F.lit(_CLOSED))
            ),
            by_ranges(F.regexp_replace(p["raw"], "(?s)<!--.*?-->", "")),
        ).otherwise(p["cut"]),
    )


def decode_entities(c: Column) -> Column:
    """Character references to characters, ``&amp;`` last."""

    def code_points(t: Column) -> Column:
        parts = F.split(t, "&#", -1)

        def one(p: Column) -> Column:
            digits = F.regexp_extract(p, r"^(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));", 0)
            hexa = F.regexp_extract(digits, r"^[xX]([0-9a-fA-F]+);", 1)
            point = F.coalesce(
                F.when(hexa != "", F.conv(hexa, 16, 10).try_cast("int")),
                F.regexp_extract(digits, r"^([0-9]+);", 1).try_cast("int"),
            )
            return F.when(
                (digits != "") & (point > 0) & (point < 1114112),
                F.concat(
                    F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"),
                    F.substring(p, F.length(digits) + 1, F.length(p)),
                ),
            ).otherwise(F.concat(F.lit("&#"), p))

        return bind(
            parts,
            lambda ps: F.array_join(
                F.transform(ps, lambda p, i: F.when(i == 0, p).otherwise(one(p))), ""
            ),
        )

    def named(t: Column) -> Column:
        for name, char in ENTITIES:
            t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
        return t

    return bind(
        c,
        lambda t: F.when(
            t.contains("&"), named(F.when(t.contains("&#"), code_points(t)).otherwise(t))
        ).otherwise(t),
    )


def inner_text(html: Column, glue: str = " ") -> Column:
    """Text of a fragment, tags replaced by `glue`, white space collapsed."""
    return tx.collapse(decode_entities(F.regexp_replace(html, r"(?s)<!--.*?-->|<[^>]*>", glue)))


def segments(html: Column, *tags: str) -> Column:
    """Page cut at its outermost `tags`: ``array<struct<tag, html>>``.

    Text between them carries the tag ''. Pages without any of the tags stay
    in one piece. Elements that hold none of the tags and have their end are cut by one regular expression; only
    pages with others, with comments or with a bracket inside a tag are tokenised.
    """
    names = "|".join(tags)
    element = rf"(?is)<({names})(?=[\s/>])[^>]*(?<!/)>.*?</\1\s*>"
    either = rf"(?i)</?(?:{names})(?=[\s/>])"

    def by_expression(page: Column) -> Column:
        def piece(tag: Column, part: Column) -> Column:
            return F.struct(tag.alias("tag"), part.alias("html"))

        def interleaved(d: Column) -> Column:
            parts = F.transform(
                d["gaps"],
                lambda g, j: F.when(
                    j < F.size(d["found"]),
                    F.array(piece(F.lit(""), g), bind(F.get(d["found"], j), lambda f: piece(F.lower(F.regexp_extract(f, "^<([a-zA-Z]+)", 1)), f))),
                ).otherwise(F.array(piece(F.lit(""), g))),
            )
            plain = ~page.contains("<!--") & ~page.rlike("<[!?/a-zA-Z][^<>]*<")
            plain = plain & F.forall(d["gaps"], lambda g: ~g.rlike(either)) & F.forall(d["found"], lambda f: F.regexp_count(f, F.lit(either)) == 2)
            return F.when(plain, F.flatten(parts)).otherwise(cut(page))

        return bind(F.struct(F.regexp_extract_all(page, F.lit(element), 0).alias("found"), F.split(page, element, -1).alias("gaps")), interleaved)

    def cut(page: Column) -> Column:
        def parts(d: Column) -> Column:
            gaps = _gaps(d["rs"], F.size(d["ts"]))
            return bind(
                gaps,
                lambda gs: F.flatten(
                    F.transform(
                        gs,
                        lambda g, j: F.concat(
                            F.array(
                                F.struct(
                                    F.lit("").alias("tag"),
                                    F.array_join(
                                        F.slice(d["ts"], g["start"], g["n"]), ""
                                    ).alias("html"),
                                )
                            ),
                            F.when(
                                j < F.size(d["rs"]),
                                F.array(
                                    bind(
                                        F.get(d["rs"], j),
                                        lambda r: F.struct(
                                            r["tag"].alias("tag"),
                                            F.array_join(
                                                F.slice(
                                                    d["ts"],
                                                    r["start"],
                                                    r["stop"] - r["start"] + 1,
                                                ),
                                                "",
                                            ).alias("html"),
                                        ),
                                    )
                                ),
                            ).otherwise(empty("struct<tag:string,html:string>")),
                        ),
                    )
                ),
            )

        return bind(
            tokens(page),
            lambda ts: bind(
                F.struct(ts.alias("ts"), element_ranges(ts, tags=tags).alias("rs")), parts
            ),
        )

    return bind(
        html,
        lambda page: F.when(
            ~page.rlike(rf"(?i)<(?:{names})(?=[\s/>])"), F.array(F.struct(F.lit("").alias("tag"), page.alias("html")))
        ).otherwise(by_expression(page)),
    )


def flow_text(parts: Column) -> Column:
    """The page outside tables and preformatted blocks."""
    return F.array_join(
        F.transform(F.filter(parts, lambda s: s["tag"] == ""), lambda s: s["html"]), "\n"
    )


def page_title(flow: Column) -> Column:
    """`<title>` text, else the first `h1`/`h2` text, else ''."""
    title = F.regexp_extract(flow, r"(?is)<title(?=[\s/>])[^>]*>(.*?)</title", 1)
    heading = F.regexp_extract(flow, r"(?is)<(h[12])(?=[\s/>])[^>]*>(.*?)</\1", 2)
    return bind(
        F.when(title.contains("<"), F.lit("")).otherwise(title),
        lambda t: F.when(t != "", tx.strip(decode_entities(t))).otherwise(inner_text(heading)),
    )


# ---------------------------------------------------------------- tables

CELL_TYPE = "struct<text:string,colspan:int,rowspan:int>"
ACTIVE_TYPE = "struct<col:int,text:string,remaining:int>"


def table_rows(table: Column) -> Column:
    """Rows of a table element as ``array<array<struct<text, colspan, rowspan>>>``."""

    def span(tag: Column, name: str) -> Column:
        return F.coalesce(attribute(tag, name).try_cast("int"), F.lit(1))

    def cells(row: Column) -> Column:
        opened = F.regexp_extract_all(row, F.lit(r"(?i)<t[hd](?=[\s/>])[^>]*>"), 0)
        bodies = F.split(row, r"(?i)<t[hd](?=[\s/>])[^>]*>", -1)
        return bind(
            F.struct(opened.alias("o"), bodies.alias("b")),
            lambda d: F.transform(
                d["o"],
                lambda tag, i: F.struct(
                    inner_text(
                        F.regexp_replace(F.get(d["b"], i + 1), r"(?is)</t[hd]\s*>.*", "")
                    ).alias("text"),
                    span(tag, "colspan").alias("colspan"),
                    span(tag, "rowspan").alias("rowspan"),
                ),
            ),
        )

    rows = F.split(table, r"(?i)<tr(?=[\s/>])[^>]*>", -1)
    return F.transform(F.slice(rows, 2, F.size(rows)), cells)


def table_grid(rows: Column) -> Column:
    """Place cells on a grid: spans down repeat their text, spans right leave ''.

    A row is swept left to right; a column still covered from above takes that
    text, else the next cell goes there. Returns ``array<array<string>>`` with
    short rows filled up to the widest.
    """
    none = empty(ACTIVE_TYPE)

    def covered(acc: Column) -> Column:
        """Consume the active spans that sit at the next free column."""
        run = F.aggregate(
            acc["active"],
            F.struct(acc["cells"].alias("cells"), none.alias("kept")),
            lambda a, s: F.when(
                s["col"] == F.size(a["cells"]),
                F.struct(
                    F.concat(a["cells"], F.array(s["text"])).alias("cells"), a["kept"].alias("kept")
                ),
            ).otherwise(
                F.struct(a["cells"].alias("cells"), F.concat(a["kept"], F.array(s)).alias("kept"))
            ),
        )
        return run

    def place(acc: Column, cell: Column) -> Column:
        def put(c: Column) -> Column:
            col = F.size(c["cells"])
            width = F.greatest(cell["colspan"], F.lit(0))
            texts = F.transform(
                F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))),
                lambda o: F.when(o == 0, cell["text"]).otherwise(""),
            )
            return bind(
                F.when(width == 0, empty("string")).otherwise(texts),
                lambda ts: F.struct(
                    F.concat(c["cells"], ts).alias("cells"),
                    F.filter(
                        c["kept"], lambda s: (cell["rowspan"] <= 1) | (s["col"] < col)
                        | (s["col"] >= col + width)
                    ).alias("active"),
                    F.concat(
                        acc["next"],
                        F.when(
                            cell["rowspan"] > 1,
                            F.transform(
                                ts,
                                lambda t, o: F.struct(
                                    (col + o).alias("col"),
                                    t.alias("text"),
                                    (cell["rowspan"] - 1).alias("remaining"),
                                ),
                            ),
                        ).otherwise(none),
                    ).alias("next"),
                ),
            )

        return bind(covered(acc), put)

    def sweep(active: Column, row: Column) -> Column:
        """One row: its texts and the spans it leaves for the rows below."""
        start = F.struct(
            empty("string").alias("cells"), active.alias("active"), none.alias("next")
        )

        def finish(acc: Column) -> Column:
            return bind(
                covered(acc),
                lambda c: F.struct(
                    c["cells"].alias("cells"),
                    F.array_sort(
                        F.concat(
                            acc["next"],
                            F.filter(
                                F.transform(
                                    active,
                                    lambda s: F.struct(
                                        s["col"].alias("col"),
                                        s["text"].alias("text"),
                                        # a span that was passed over stays as it is
                                        F.when(
                                            F.exists(
                                                c["kept"], lambda k: k["col"] == s["col"]
                                            ),
                                            s["remaining"],
                                        )
                                        .otherwise(s["remaining"] - 1)
                                        .alias("remaining"),
                                    ),
                                ),
                                lambda s: (s["remaining"] > 0)
                                & ~F.exists(acc["next"], lambda n: n["col"] == s["col"]),
                            ),
                        )
                    ).alias("active"),
                ),
            )

        return F.aggregate(row, start, place, finish)

    def step(st: Column, row: Column) -> tuple[Column, Column]:
        swept = sweep(st["active"], row)
        return (
            F.struct(swept["active"].alias("active")),
            F.array(swept["cells"]),
        )

    def placed(rs: Column) -> Column:
        plain = F.forall(
            rs, lambda r: F.forall(r, lambda c: (c["colspan"] == 1) & (c["rowspan"] == 1))
        )
        return F.when(
            plain, F.transform(rs, lambda r: F.transform(r, lambda c: c["text"]))
        ).otherwise(fold_emit(rs, F.struct(none.alias("active")), "array<string>", step))

    return bind(
        F.filter(bind(rows, placed), lambda r: F.size(r) > 0),
        lambda rs: bind(
            F.coalesce(F.array_max(F.transform(rs, lambda r: F.size(r))), F.lit(0)),
            lambda w: F.transform(
                rs, lambda r: F.concat(r, F.array_repeat(F.lit(""), w - F.size(r)))
            ),
        ),
    )


def is_header_row(texts: Column) -> Column:
    """Two or more cells, none empty, no digits, and a header word or all distinct."""

    def check(ts: Column) -> Column:
        return (
            (F.size(ts) >= 2)
            & F.forall(ts, lambda t: (t != "") & ~t.rlike(DIGIT))
            & (
                F.arrays_overlap(ts, F.array(*[F.lit(w) for w in HEADER_WORDS]))
                | (F.size(F.array_distinct(ts)) == F.size(ts))
            )
        )

    return bind(F.transform(texts, lambda t: F.lower(tx.strip(t))), check)


def render_table(rows: Column) -> Column:
    """A table with a header row as a pipe table, any other as key-value lines."""

    def line(cells: Column) -> Column:
        return F.concat(
            F.lit("| "),
            F.array_join(
                F.transform(cells, lambda c: F.when(tx.is_blank(c), " ").otherwise(tx.strip(c))),
                " | ",
            ),
            F.lit(" |"),
        )

    def pipe(grid: Column) -> Column:
        rule = F.transform(F.get(grid, F.lit(0)), lambda _: F.lit("---"))
        return F.when(F.size(grid) == 0, F.lit("")).otherwise(
            F.array_join(
                F.concat(
                    F.array(line(F.get(grid, F.lit(0))), line(rule)),
                    F.transform(F.slice(grid, 2, F.size(grid)), line),
                ),
                "\n",
            )
        )

    def key_values(rs: Column) -> Column:
        def entry(row: Column) -> Column:
            rest = F.array_join(
                F.filter(
                    F.transform(F.slice(row, 2, F.size(row)), lambda c: tx.strip(c["text"])),
                    lambda t: t != "",
                ),
                " ",
            )
            key = tx.strip(F.get(row, F.lit(0))["text"])
            return F.concat(
                F.lit("- "),
                F.when(key == "", " ").otherwise(key),
                F.lit(": "),
                F.when(rest == "", " ").otherwise(rest),
            )

        return F.array_join(
            F.transform(F.filter(rs, lambda r: F.size(r) > 0), entry), "\n"
        )

    return bind(
        rows,
        lambda rs: F.when(
            (F.size(rs) > 0)
            & ~is_header_row(F.transform(F.get(rs, F.lit(0)), lambda c: c["text"])),
            key_values(rs),
        ).otherwise(bind(table_grid(rs), pipe)),
    )


# ---------------------------------------------------------------- Markdown


def _list_marks(flow: Column) -> Column:
    """Replace every list item tag by its mark: indented by depth, counted in `ol`."""

    def run(pieces: Column) -> Column:
        # stack of open lists: -1 for a plain one, else the last number given
        def after(stack: Column, piece: Column) -> Column:
            return F.aggregate(
                F.regexp_extract_all(piece, F.lit(r"(?i)</?(?:ul|ol)(?=[\s/>])"), 0),
                stack,
                lambda s, t: F.when(
                    t.startswith("</"), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))
                )
                .when(F.lower(t) == "<ol", F.concat(s, F.array(F.lit(0))))
                .otherwise(F.concat(s, F.array(F.lit(-1)))),
            )

        def step(st: Column, piece: Column) -> tuple[Column, Column]:
            def mark(s: Column) -> Column:
                last = F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(-1))
                lead = F.repeat(F.lit(_INDENT * 2), F.size(s))
                return F.when(last < 0, F.concat(lead, F.lit("- "))).otherwise(
                    F.concat(lead, (last + 1).cast("string"), F.lit(". "))
                )

            def bumped(s: Column) -> Column:
                last = F.try_element_at(s, F.lit(-1))
                return F.when(
                    F.coalesce(last, F.lit(-1)) >= 0,
                    F.concat(F.slice(s, 1, F.size(s) - 1), F.array(last + 1)),
                ).otherwise(s)

            def both(s: Column) -> Column:
                return F.struct(bumped(s).alias("stack"), mark(s).alias("mark"))

            r = bind(after(st["stack"], piece), both)
            return F.struct(r["stack"].alias("stack")), F.array(r["mark"])

        marks = fold_emit(
            F.slice(pieces, 1, F.size(pieces) - 1),
            F.struct(empty("int").alias("stack")),
            "string",
            step,
        )
        return bind(
            marks,
            lambda m: F.array_join(
                F.transform(
                    pieces,
                    lambda p, i: F.when(i == 0, p).otherwise(
                        F.concat(F.lit("\n"), F.get(m, i - 1), F.ltrim(p))
                    ),
                ),
                "",
            ),
        )

    return bind(
        flow,
        lambda f: F.when(
            f.rlike(r"(?i)<li(?=[\s/>])"), bind(F.split(f, r"(?i)<li(?=[\s/>])[^>]*>", -1), run)
        ).otherwise(f),
    )


_RARE = r"(?i)<(?:hr|img|code|tt|kbd|del|s|strike|blockquote)(?=[\s/>])"


def _rare_marks(t: Column) -> Column:
    t = F.regexp_replace(t, r"(?i)<hr(?=[\s/>])[^>]*>", "\n* * *\n")
    t = F.regexp_replace(
        t,
        r"""(?i)<img(?=[\s/>])(?=[^>]*?\ssrc\s*=\s*["']?([^"'\s>]+))(?:(?=[^>]*?\salt\s*=\s*(?:"([^"]*)"|'([^']*)')))?[^>]*>""",
        "![$2$3]($1)",
    )
    t = F.regexp_replace(t, r"(?i)</?(?:code|tt|kbd)(?=[\s/>])[^>]*>", "`")
    t = F.regexp_replace(t, r"(?i)</?(?:del|s|strike)(?=[\s/>])[^>]*>", "~~")
    return F.regexp_replace(t, r"(?i)<blockquote(?=[\s/>])[^>]*>", "\n> ")


def html_blocks(flow: Column) -> Column:
    """Markdown of a fragment without tables and preformatted blocks."""
    t = F.regexp_replace(flow, r"(?is)<head(?=[\s/>])[^>]*>.*?</head\s*>|<!--.*?-->|<![^>]*>", "")
    t = F.regexp_replace(t, tx.WS + "+", " ")
    t = F.regexp_replace(t, r"(?i) ?<br(?=[\s/>])[^>]*> ?", "\n")
    t = F.regexp_replace(t, r"(?i)<h([1-6])(?=[\s/>])[^>]*> ?", f"\n{_HEADING}$1 ")
    t = F.regexp_replace(t, r"(?i)</h[1-6]\s*>", "\n")
    for n in range(1, 7):
        t = F.replace(t, F.lit(f"{_HEADING}{n}"), F.lit("#" * n))
    t = F.regexp_replace(
        t, r"""(?is)<a(?=[\s/>])[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))[^>]*> ?(.*?) ?</a\s*>""",
        r"[$4]($1$2$3)",
    )
    t = F.regexp_replace(t, r"(?i)</?(?:b|strong)(?=[\s/>])[^>]*>", "**")
    t = F.regexp_replace(t, r"(?i)</?(?:em|i|u)(?=[\s/>])[^>]*>", "*")
    t = bind(t, lambda x: F.when(x.rlike(_RARE), _rare_marks(x)).otherwise(x))
    t = _list_marks(t)
    t = F.regexp_replace(t, r"(?i)</?(?:li|blockquote|" + BLOCK_TAGS + r")(?=[\s/>])[^>]*>", "\n")
    t = decode_entities(F.regexp_replace(t, r"(?s)<[/a-zA-Z][^>]*>", ""))
    t = F.regexp_replace(t, r" {2,}", " ")
    t = tx.strip(F.regexp_replace(t, r" *\n[ \n]*", "\n"))
    return F.replace(t, F.lit(_INDENT), F.lit(" "))


def preformatted(html: Column) -> Column:
    """A fenced block of a `<pre>` element; '' if it is blank."""
    body = decode_entities(F.regexp_replace(html, r"(?s)<[^>]*>", ""))
    return bind(
        body,
        lambda b: F.when(tx.is_blank(b), F.lit("")).otherwise(
            F.concat(F.lit("```\n"), F.btrim(b, F.lit("\n")), F.lit("\n```"))
        ),
    )


def markdown(html: Column) -> Column:
    """A page as Markdown: clean text, tables and code in reading order."""

    def convert(parts: Column) -> Column:
        body = F.array_join(
            F.filter(
                F.transform(
                    parts,
                    lambda s: F.when(s["tag"] == "pre", preformatted(s["html"]))
                    .when(s["tag"] == "table", render_table(table_rows(s["html"])))
                    .otherwise(html_blocks(s["html"])),
                ),
                lambda t: t != "",
            ),
            "\n\n",
        )
        clean = tx.strip(F.regexp_replace(body, r"(?m)[^\S\n]+$", ""))
        return bind(
            F.struct(clean.alias("body"), page_title(flow_text(parts)).alias("title")),
            lambda d: F.concat(
                F.when(
                    (d["title"] != "") & ~d["body"].startswith("# "),
                    tx.strip(F.concat(F.lit("# "), d["title"], F.lit("\n\n"), d["body"])),
                ).otherwise(d["body"]),
                F.lit("\n"),
            ),
        )

    return bind(segments(strip_noise(html), "pre", "table"), convert)
