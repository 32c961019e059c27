"""Markdown structure as column expressions: headers, blocks, tables, packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions import text as tx
from docspark.functions.fold import bind, empty, fold_emit, join_ranges

# Header lines, fences and table separators.
MARKDOWN_HEADER = f"(?s)^{tx.WS}*(#{{1,6}}){tx.WS}+({tx.NOT_WS}.*)$"
NUMERIC_HEADER = (
    rf"(?s)^((?:\p{{Nd}}+\.)+){tx.WS}+({tx.NOT_WS}(?:.*{tx.NOT_WS})?)$"
)
FENCE = f"^{tx.WS}*(```|~~~)"
TABLE_RULE = r"^:?-{3,}:?$"
# Shortest piece that may stand alone, longest title line.
MIN_FRAGMENT_CHARS = 80
MAX_TITLE_CHARS = 80
MAX_TITLE_SPACES = 10

HEADER_TYPE = "struct<level:int,number:string,title:string>"
UNIT_TYPE = "struct<kind:string,text:string>"
BLOCK_TYPE = "struct<kind:string,start:int,n:int>"


def header(line: Column) -> Column:
    """Header of a line as ``struct<level, number, title>``, null if it is none.

    ``## Title`` may be indented; a numbered header ``1.2. Title`` may not, and
    its level is the number of its segments.
    """
    marks = F.regexp_extract(line, MARKDOWN_HEADER, 1)
    number = F.regexp_extract(line, NUMERIC_HEADER, 1)
    return (
        F.when(
            line.contains("#") & (marks != ""),
            F.struct(
                F.length(marks).alias("level"),
                F.lit(None).cast("string").alias("number"),
                tx.rstrip(F.regexp_extract(line, MARKDOWN_HEADER, 2)).alias("title"),
            ),
        )
        .when(
            line.rlike(r"^\p{Nd}") & (number != ""),
            F.struct(
                F.length(F.regexp_replace(number, r"[^.]", "")).alias("level"),
                F.rtrim(number, F.lit(".")).alias("number"),
                F.regexp_extract(line, NUMERIC_HEADER, 2).alias("title"),
            ),
        )
        .otherwise(F.lit(None).cast(HEADER_TYPE))
    )


def looks_like_title(c: Column) -> Column:
    """A short line with a letter, few spaces and no closing punctuation."""
    t = tx.strip(c)
    return (
        (t != "")
        & (F.length(t) <= MAX_TITLE_CHARS)
        & ~tx.ends_with_any(t, ".:;!?")
        & t.rlike(r"\p{L}")
        & (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) <= MAX_TITLE_SPACES)
    )


def header_label(h: Column) -> Column:
    """``number - title`` of a header, or what there is of it; '' for none."""
    return F.when(h.isNull(), F.lit("")).otherwise(
        F.concat_ws(" - ", h["number"], F.nullif(h["title"], F.lit("")))
    )


def chunk_level(heads: Column) -> Column:
    """Deepest header level up to 3, else the deepest of all, else 1."""
    levels = F.transform(heads, lambda h: h["level"])
    return F.coalesce(
        F.array_max(F.filter(levels, lambda v: v <= 3)), F.array_max(levels), F.lit(1)
    )


def fence_marker(line: Column) -> Column:
    """Fence mark a line starts with, '' for none."""
    return F.regexp_extract(line, FENCE, 1)


def is_table_rule(line: Column) -> Column:
    """``| --- | :-: |``: every non-empty cell is a run of dashes."""

    def check(plain: Column) -> Column:
        cells = F.filter(
            F.transform(F.split(F.btrim(plain, F.lit("|")), r"\|", -1), lambda p: tx.strip(p)),
            lambda p: p != "",
        )
        return bind(
            cells, lambda cs: (F.size(cs) > 0) & F.forall(cs, lambda p: p.rlike(TABLE_RULE))
        )

    return F.when(line.contains("---"), bind(tx.strip(line), check)).otherwise(False)


def blocks(lines: Column) -> Column:
    """Code, table and paragraph blocks of a list of lines, as line ranges.

    A fence runs to the next line starting with the same marker, or to the
    end. A table is a line with ``|`` above a rule line and goes on while lines
    are not blank and hold ``|``. Everything else between blanks is text.
    """

    def marks(ls: Column) -> Column:
        return F.transform(
            ls,
            lambda x, i: F.struct(
                i.alias("i"),
                tx.is_blank(x).alias("blank"),
                fence_marker(x).alias("fence"),
                x.contains("|").alias("pipe"),
                (
                    x.contains("|") & F.coalesce(is_table_rule(F.get(ls, i + 1)), F.lit(False))
                ).alias("opens_table"),
            ),
        )

    def state(kind: Column, fence: Column, start: Column) -> Column:
        return F.struct(
            kind.cast("string").alias("kind"),
            fence.cast("string").alias("fence"),
            start.cast("int").alias("start"),
        )

    none, nothing = F.lit(""), empty(BLOCK_TYPE)

    def emit(st: Column, stop: Column) -> Column:
        return F.array(
            F.struct(
                st["kind"].alias("kind"),
                (st["start"] + 1).alias("start"),
                (stop - st["start"]).cast("int").alias("n"),
            )
        )

    def step(st: Column, ln: Column) -> tuple[Column, Column]:
        fence = ln["fence"]
        in_code, in_table, in_text = (st["kind"] == k for k in ("code", "table", "text"))
        code_ends = in_code & (fence == st["fence"])
        goes_on = (
            (in_code & ~code_ends)
            | (in_table & ((ln["i"] == st["start"] + 1) | (~ln["blank"] & ln["pipe"])))
            | (in_text & ~ln["blank"] & (fence == "") & ~ln["opens_table"])
        )
        opened = (
            F.when(ln["blank"], state(none, none, ln["i"]))
            .when(fence != "", state(F.lit("code"), fence, ln["i"]))
            .when(ln["opens_table"], state(F.lit("table"), none, ln["i"]))
            .otherwise(state(F.lit("text"), none, ln["i"]))
        )
        nxt = (
            F.when(code_ends, state(none, none, ln["i"])).when(goes_on, st).otherwise(opened)
        )
        out = (
            F.when(code_ends, emit(st, ln["i"] + 1))
            .when(goes_on | (st["kind"] == ""), nothing)
            .otherwise(emit(st, ln["i"]))
        )
        return nxt, out

    def run(ls: Column) -> Column:
        return fold_emit(
            marks(ls),
            state(none, none, F.lit(0)),
            BLOCK_TYPE,
            step,
            lambda st: F.when(st["kind"] == "", nothing).otherwise(emit(st, F.size(ls))),
        )

    return bind(lines, run)


def split_table(rows: Column, limit: int) -> Column:
    """Cut a table at rows, repeating its header and rule line in every piece."""

    def cut(rs: Column) -> Column:
        head = F.concat(tx.rstrip(F.get(rs, F.lit(0))), F.lit("\n"), tx.rstrip(F.get(rs, F.lit(1))))
        body = F.filter(
            F.transform(F.slice(rs, 3, F.size(rs)), lambda r: tx.rstrip(r)), lambda r: r != ""
        )
        return bind(
            F.struct(tx.strip(head).alias("head"), body.alias("body")),
            lambda t: F.transform(
                join_ranges(
                    F.transform(
                        t["body"],
                        lambda r: F.struct(
                            F.length(r).alias("len"),
                            F.lit(True).alias("may_join"),
                            F.lit(False).alias("force"),
                            F.lit(False).alias("closes"),
                        ),
                    ),
                    F.lit(limit) - F.length(t["head"]) - 1,
                    1,
                ),
                lambda r: F.concat_ws(
                    "\n", t["head"], F.array_join(F.slice(t["body"], r["start"], r["n"]), "\n")
                ),
            ),
        )

    return bind(
        rows,
        lambda rs: F.when(
            F.size(rs) <= 2, F.array(tx.strip(F.array_join(rs, "\n")))
        ).otherwise(cut(rs)),
    )


def sentence_units(c: Column, limit: int) -> Column:
    """Sentences of a paragraph; one above the limit is cut at words."""
    return bind(
        tx.sentences(c),
        lambda ss: F.when(F.forall(ss, lambda s: F.length(s) <= limit), ss).otherwise(
            F.flatten(F.transform(ss, lambda s: tx.split_long(s, limit)))
        ),
    )


def units(lines: Column, limit: int) -> Column:
    """Typed units of a list of lines: sentences, table pieces, code blocks."""

    def typed(kind: str, texts: Column) -> Column:
        return F.transform(texts, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("text")))

    def of_block(ls: Column, b: Column) -> Column:
        part = F.slice(ls, b["start"], b["n"])
        # sentences collapse white space, so lines need no trimming here
        paragraph = F.array_join(part, " ")
        return (
            F.when(b["kind"] == "code", typed("code", F.array(tx.strip(F.array_join(part, "\n")))))
            .when(b["kind"] == "table", typed("table", split_table(part, limit)))
            .otherwise(typed("text", sentence_units(paragraph, limit)))
        )

    return bind(
        lines,
        lambda ls: F.filter(
            F.flatten(F.transform(blocks(ls), lambda b: of_block(ls, b))),
            lambda u: u["text"] != "",
        ),
    )


def render(us: Column) -> Column:
    """Units as text, a blank line between them."""
    return F.array_join(F.transform(us, lambda u: u["text"]), "\n\n")


def _pieces(us: Column, ranges: Column) -> Column:
    return F.transform(ranges, lambda r: F.slice(us, r["start"], r["n"]))


def pack_units(us: Column, limit: int) -> Column:
    """Neighbouring text units into pieces of at most `limit`; table and code alone."""

    def pack(u: Column) -> Column:
        items = F.transform(
            u,
            lambda x: F.struct(
                F.length(x["text"]).alias("len"),
                (x["kind"] == "text").alias("may_join"),
                F.lit(False).alias("force"),
                (x["kind"] != "text").alias("closes"),
            ),
        )
        return _pieces(u, join_ranges(items, limit, 2))

    return bind(us, pack)


def is_fragment(c: Column) -> Column:
    """A short piece (already trimmed) that does not end like a sentence."""
    return (c != "") & (F.length(c) < MIN_FRAGMENT_CHARS) & ~tx.ends_with_any(c, ".!?:;")


def merge_fragments(pieces: Column, limit: int) -> Column:
    """Join a fragment to the piece before it if it is tiny or the sum fits."""

    def merge(ps: Column) -> Column:
        items = F.transform(
            ps,
            lambda p: bind(
                render(p),
                lambda t: F.struct(
                    F.length(t).alias("len"),
                    (is_fragment(t) & ~t.contains("```") & ~t.contains("~~~")).alias("may_join"),
                    (F.length(t) < MIN_FRAGMENT_CHARS // 2).alias("force"),
                    F.lit(False).alias("closes"),
                ),
            ),
        )
        return F.transform(
            join_ranges(items, limit, 2), lambda r: F.flatten(F.slice(ps, r["start"], r["n"]))
        )

    return bind(pieces, merge)


def add_overlap(pieces: Column, n: int, limit: int) -> Column:
    """Prefix each piece with the last text units of the piece before it.

    The longest suffix of at most `n` units that keeps the piece within
    `limit` is taken; the piece before counts without its own prefix.
    """
    if n < 0:
        raise ValueError("overlap must be zero or more")
    if n == 0:
        return pieces

    def prefixed(own: Column, tail: Column) -> Column:
        room = F.lit(limit) - F.length(render(own))
        fitting = bind(
            room,
            lambda left: F.size(
                F.filter(
                    F.sequence(F.lit(1), F.size(tail)),
                    lambda s: F.aggregate(
                        F.slice(tail, F.size(tail) - s + 1, s),
                        F.lit(0),
                        lambda a, u: a + F.length(u["text"]) + 2,
                    )
                    <= left,
                )
            ),
        )
        return F.when(F.size(tail) == 0, own).otherwise(
            bind(
                fitting,
                lambda s: F.when(s == 0, own).otherwise(
                    F.concat(F.slice(tail, F.size(tail) - s + 1, s), own)
                ),
            )
        )

    def run(ps: Column) -> Column:
        return F.transform(
            ps,
            lambda p, i: F.when(i == 0, p).otherwise(
                bind(
                    F.filter(F.get(ps, i - 1), lambda u: u["kind"] == "text"),
                    lambda t: prefixed(
                        p, F.slice(t, F.greatest(F.size(t) - n, F.lit(0)) + 1, F.lit(n))
                    ),
                )
            ),
        )

    return bind(pieces, run)


def pack_lines(lines: Column, limit: int, overlap: int) -> Column:
    """Lines to rendered pieces: units, packing, fragment merge, overlap."""
    return F.transform(
        add_overlap(merge_fragments(pack_units(units(lines, limit), limit), limit), overlap, limit),
        lambda p: render(p),
    )


def cap(c: Column, limit: int, overlap: int) -> Column:
    """A text as pieces: itself if it fits, else packed by structure."""

    def cut(t: Column) -> Column:
        packed = pack_lines(tx.text_lines(t), limit, overlap)
        return (
            F.when(t == "", empty("string"))
            .when(F.length(t) <= limit, F.array(t))
            .otherwise(
                bind(packed, lambda p: F.when(F.size(p) > 0, p).otherwise(tx.split_long(t, limit)))
            )
        )

    return bind(tx.strip(c), cut)
