"""String expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.fold import bind, empty, join_ranges

# The white space of Unicode text, as a regex class and as a set.
WS = r"[\t-\r\x1c-\x1f \x85\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x1f \x85\p{Z}]"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Fixed value: where a sentence ends.
SENTENCE_END = r"(?<=[.!?])" + WS + "+"
# Line ends of a file, and of a text value.
FILE_LINE_END = r"\r\n|\n|\r"
TEXT_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# What counts as "yes" in a text option.
TRUTHY = ("1", "true", "yes", "on", "sim")


def strip(c: Column, chars: str = WS_CHARS) -> Column:
    return F.btrim(c, F.lit(chars))


def rstrip(c: Column, chars: str = WS_CHARS) -> Column:
    return F.rtrim(c, F.lit(chars))


def collapse(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def is_blank(c: Column) -> Column:
    # stops at the first visible character; trimming a set of characters reads the whole text
    return ~c.rlike(NOT_WS)


def _lines(c: Column, pattern: str) -> Column:
    parts = F.split(c, pattern, -1)
    return bind(
        parts,
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p),
    )


def file_lines(c: Column) -> Column:
    """Lines of a file's text; blanks kept, a final line end adds no line."""
    return _lines(c, FILE_LINE_END)


def text_lines(c: Column) -> Column:
    """Lines of a text value, cut at every Unicode line end."""
    return _lines(c, TEXT_LINE_END)


def words(c: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.filter(F.split(strip(c), WS + "+", -1), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(F.coalesce(c, F.lit(""))))


def sentences(c: Column) -> Column:
    """Sentences of a text after white space is collapsed."""
    return F.filter(F.split(collapse(c), SENTENCE_END, -1), lambda s: s != "")


def ends_with_any(c: Column, marks: str) -> Column:
    """True if the last character is one of `marks`."""
    return F.length(c).cast("boolean") & F.lit(marks).contains(F.right(c, F.lit(1)))


def slices(c: Column, size: int) -> Column:
    """Cut a text every `size` characters."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.length(c), F.lit(1)) - 1) / size).cast("int")),
        lambda i: F.substring(c, i * size + 1, F.lit(size)),
    )


def split_long(c: Column, limit: int) -> Column:
    """Cut a text at words so that every piece has at most `limit` characters.

    A longer word is cut into slices.
    """

    def pack(ws: Column) -> Column:
        items = F.transform(
            ws,
            lambda w: bind(
                F.length(w),
                lambda n: F.struct(
                    n.alias("len"),
                    (n <= limit).alias("may_join"),
                    F.lit(False).alias("force"),
                    (n > limit).alias("closes"),
                ),
            ),
        )
        return F.flatten(
            F.transform(
                join_ranges(items, limit, 1),
                lambda r: F.when(
                    (r["n"] == 1) & (F.length(F.get(ws, r["start"] - 1)) > limit),
                    slices(F.get(ws, r["start"] - 1), limit),
                ).otherwise(F.array(F.array_join(F.slice(ws, r["start"], r["n"]), " "))),
            )
        )

    def cut(t: Column) -> Column:
        return (
            F.when(t == "", empty("string"))
            .when(F.length(t) <= limit, F.array(t))
            .otherwise(bind(words(t), pack))
        )

    return bind(strip(c), cut)


def truthy(c: Column) -> Column:
    return F.lower(strip(c)).isin(*TRUTHY)


def utc_stamp(ts: Column) -> Column:
    """ISO-8601 text in UTC, cut to seconds (session time zone must be UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def to_number(c: Column) -> Column:
    """Double, or null for text that is no number, NaN and infinities."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)
