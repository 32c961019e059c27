"""Raw pages to Markdown documents and table cells. Narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import html as h
from docspark.functions import paths
from docspark.functions.fold import bind, once


@once
def _markdown(html: str) -> Column:
    return h.markdown(F.col(html))


@once
def _tables(html: str) -> Column:
    return bind(
        h.segments(h.strip_noise(F.col(html)), "pre", "table"),
        lambda parts: F.transform(
            F.filter(parts, lambda s: s["tag"] == "table"), lambda s: h.table_rows(s["html"])
        ),
    )


@once
def _grid(rows: str) -> Column:
    return h.table_grid(F.col(rows))


@once
def _rendered(rows: str) -> Column:
    return h.render_table(F.col(rows))


@once
def _title(html: str) -> Column:
    parts = h.segments(h.strip_noise(F.col(html)), "pre", "table")
    return bind(parts, lambda p: h.page_title(h.flow_text(p)))


def to_markdown(pages: DataFrame, html: str = "html", out: str = "markdown") -> DataFrame:
    """Replace the page source by its Markdown."""
    return pages.select(
        *[c for c in pages.columns if c != html], _markdown(html).alias(out)
    )


def convert(raw: DataFrame, source_root: str, output_root: str) -> DataFrame:
    """Raw documents ``(source_path, raw)`` to ``(source_path, output_path, markdown)``."""
    return raw.select(
        "source_path",
        paths.output_path(F.col("source_path"), source_root, output_root).alias("output_path"),
        _markdown("raw").alias("markdown"),
    )


def page_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per table of a page: `table_no` from 1 and its rows of cells."""
    keys = [c for c in pages.columns if c != html]
    return pages.select(*keys, F.posexplode(_tables(html)).alias("pos", "rows")).select(
        *keys, (F.col("pos") + 1).alias("table_no"), "rows"
    )


def page_table_cells(pages: DataFrame, html: str = "html") -> DataFrame:
    """Cells of every table on the grid its spans describe, one row per cell."""
    keys = [c for c in pages.columns if c != html]
    rows = page_tables(pages, html).select(
        *keys, "table_no", F.posexplode(_grid("rows")).alias("r", "cells")
    )
    cells = rows.select(*keys, "table_no", "r", F.posexplode("cells").alias("c", "text"))
    return cells.select(
        *keys,
        "table_no",
        (F.col("r") + 1).alias("row_no"),
        (F.col("c") + 1).alias("col_no"),
        "text",
    )


def rendered_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """Markdown of every table that is not empty."""
    keys = [c for c in pages.columns if c != html]
    return (
        page_tables(pages, html)
        .select(*keys, "table_no", _rendered("rows").alias("markdown"))
        .where("markdown <> ''")
    )


def links(pages: DataFrame, html: str = "html", furniture: bool = False) -> DataFrame:
    """Links of the page: position, text and target; those of its furniture only if asked for."""
    keys = [c for c in pages.columns if c != html]
    pattern = r"""(?is)<a(?=[\s/>])[^>]*?\shref\s*=\s*[^\s>][^>]*>.*?</a\s*>"""
    found = F.regexp_extract_all(F.col(html) if furniture else h.strip_noise(F.col(html)), F.lit(pattern), 0)
    return pages.select(*keys, F.posexplode(found).alias("pos", "a")).select(
        *keys,
        (F.col("pos") + 1).alias("link_no"),
        h.inner_text(F.col("a")).alias("text"),
        h.attribute(F.regexp_extract("a", "(?s)^<[^>]*>", 0), "href").alias("href"),
    )


def titles(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title of every page."""
    return pages.select(
        *[c for c in pages.columns if c != html], _title(html).alias("title")
    )
