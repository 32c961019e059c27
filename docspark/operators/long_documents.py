"""Sections of documents that are too long for one row, by scans over segments of lines.

`chunking` keeps a document in one row. Here it is a table of lines. What a line's section depends on (the last
headers above, the number of blocks and chunks so far, the next header below) is associative, so it is found in two
steps: inside segments of SEGMENT_LINES lines, and over one row per segment, whose result every segment then starts
from. A task holds a segment, or one section; only rows per segment of a document meet in one window.

The sections, their texts and records are those of `chunking`, but for the hash of the whole document, which has
no such form and stays null. A document without lines is in no table of lines. A section, and the rest of a
document without headers, is one row, as it is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import markdown as md
from docspark.functions import paths
from docspark.functions import text as tx
from docspark.operators import chunking
from docspark.session import stage

SEGMENT_LINES = 4096
_DOC, _SEGMENT = "source_path", "_segment"


def _carried(
    rows: DataFrame, order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, nexts: dict[str, Column] | None = None,
    holders: DataFrame | None = None,
) -> DataFrame:
    """Add running sums up to each row, last values up to it and next values behind it, over whole documents.

    `holders` may give the rows that hold values, and one more of every segment, where these are far fewer.
    """
    sums, lasts, nexts = sums or {}, lasts or {}, nexts or {}
    inside = Window.partitionBy(_DOC, _SEGMENT).orderBy(*order)
    upto, behind = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(1, Window.unboundedFollowing)
    found = rows.withColumns(
        {f"_{n}": F.sum(e).over(upto) for n, e in sums.items()}
        | {f"_{n}": F.last(e, ignorenulls=True).over(upto) for n, e in lasts.items()}
        | {f"_{n}": F.first(e, ignorenulls=True).over(behind) for n, e in nexts.items()}
    )
    place = F.struct(*order)
    whole = (rows if holders is None else holders).groupBy(_DOC, _SEGMENT).agg(
        *[F.sum(e).alias(n) for n, e in sums.items()],
        *[F.max_by(e, F.when(e.isNotNull(), place)).alias(n) for n, e in lasts.items()],
        *[F.min_by(e, F.when(e.isNotNull(), place)).alias(n) for n, e in nexts.items()],
    )
    over = Window.partitionBy(_DOC).orderBy(_SEGMENT)
    before, after = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing)
    entry = whole.select(
        F.col(_DOC).alias("_d"), F.col(_SEGMENT).alias("_s"),
        *[F.sum(n).over(before).alias(f"_in_{n}") for n in sums],
        *[F.last(n, ignorenulls=True).over(before).alias(f"_in_{n}") for n in lasts],
        *[F.first(n, ignorenulls=True).over(after).alias(f"_in_{n}") for n in nexts],
    )
    joined = found.join(entry, F.col(_DOC).eqNullSafe(F.col("_d")) & (F.col(_SEGMENT) == F.col("_s")))
    values = [(F.coalesce(f"_{n}", F.lit(0)) + F.coalesce(f"_in_{n}", F.lit(0))).alias(n) for n in sums]
    values += [F.coalesce(f"_{n}", f"_in_{n}").alias(n) for n in (*lasts, *nexts)]
    return joined.select(*rows.columns, *values)


def _facts(marked: DataFrame) -> DataFrame:
    """One row per document: its number of lines, chunk level, first header and the line that names it."""
    level = F.col("h.level")
    titled = F.when(F.col("h").isNull() & ~F.col("blank") & md.looks_like_title(F.col("line")), F.struct("line_no", "line"))
    facts = marked.groupBy(_DOC).agg(
        (F.max("line_no") + 1).alias("n_lines"),
        F.coalesce(F.max(F.when(level <= 3, level)), F.max(level), F.lit(1)).alias("cut"),
        F.min(F.when(F.col("h").isNotNull(), F.col("line_no"))).alias("first_head"),
        F.min(titled).alias("title"),
    )
    before = F.col("title.line_no") < F.coalesce("first_head", "n_lines")
    return facts.withColumn("title", F.when(before, F.col("title")))


def regions(lines: DataFrame, keep_text: bool = True, segment_lines: int = SEGMENT_LINES) -> DataFrame:
    """`chunking.regions` of rows (source_path, line_no, line), numbered from 0 without gaps."""
    if segment_lines <= 0:
        raise ValueError("segment_lines must be above zero")
    segment = F.floor(F.col("line_no") / segment_lines).cast("long")
    lines = lines.select(_DOC, F.col("line_no").cast("long").alias("line_no"), "line").withColumn(_SEGMENT, segment)
    marked = lines.withColumns({"h": md.header(F.col("line")), "blank": tx.is_blank(F.col("line"))})
    facts = stage(_facts(marked))  # a row per document
    heads = marked.where("h is not null").select(_DOC, _SEGMENT, "line_no", "h")
    of = facts.withColumnRenamed(_DOC, "_of")
    heads = heads.join(of, F.col(_DOC).eqNullSafe(F.col("_of"))).drop("_of")

    one, cuts = F.col("h.level") == 1, F.col("h.level") == F.col("cut")
    # a first header below level 1 opens a block unless a title has done so
    opens_block = one | ((F.col("line_no") == F.col("first_head")) & F.col("title").isNull())
    heads = _carried(heads, ["line_no"], sums={"blocks": opens_block.cast("long"), "cuts": cuts.cast("long")})
    here = F.struct("line_no", "h", (F.col("cuts") - cuts.cast("long")).alias("cuts"))
    heads = _carried(
        heads, ["line_no"],
        lasts={"block": F.when(opens_block, here), "one": F.when(one, F.struct("line_no", "h")), "two": F.when(F.col("h.level") == 2, F.struct("line_no", "h"))},
        nexts={"closing": F.when(F.col("h.level") <= F.col("cut"), F.col("line_no")), "next_block": F.when(opens_block, here)},
    )
    heads = stage(heads)
    titled = F.when(F.col("title").isNotNull(), 1).otherwise(0)
    stem = paths.stem(F.col(_DOC))
    first_name = F.coalesce(tx.strip(F.col("title.line")), stem)
    end = F.col("n_lines")
    none = F.lit(None).cast(md.HEADER_TYPE)
    block_start = F.coalesce("block.line_no", F.col("title.line_no") + 1)
    # the second header counts only behind the first
    second = F.when(F.coalesce(F.col("two.line_no") > F.coalesce(F.col("one.line_no"), F.lit(-1)), F.lit(False)), F.col("two.h"))
    chunks = heads.where(cuts).select(
        _DOC, F.lit("chunk").alias("kind"), (F.col("blocks") + titled).alias("block_no"), block_start.alias("block_start"),
        F.coalesce(F.when(F.col("one").isNotNull(), F.col("one.h.title")), first_name).alias("nome_software"),
        (F.col("cuts") - F.coalesce("block.cuts", F.lit(0))).alias("chunk_ordem"), F.col("line_no").alias("start"),
        F.coalesce("closing", end).alias("stop"), F.col("one.h").alias("h1"), second.alias("h2"), F.col("h").alias("hc"), "n_lines",
    )
    # blocks without a header of the chunk level: opened by a header, or by the title
    empty = F.coalesce("next_block.cuts", F.col("total")) == F.col("block.cuts")
    total = heads.groupBy(F.col(_DOC).alias("_of")).agg(F.max("cuts").alias("total"))
    openers = heads.where(opens_block).join(total, F.col(_DOC).eqNullSafe(F.col("_of"))).where(empty)
    bare = openers.select(
        _DOC, F.lit("block").alias("kind"), (F.col("blocks") + titled).alias("block_no"), F.col("line_no").alias("block_start"),
        F.when(one, F.col("h.title")).otherwise(first_name).alias("nome_software"), F.lit(0).alias("chunk_ordem"), F.col("line_no").alias("start"),
        F.coalesce("next_block.line_no", end).alias("stop"), none.alias("h1"), none.alias("h2"), none.alias("hc"), "n_lines",
    )
    # the block that the title opens ends at the first header that opens one; it has chunks if any header of the level stands before
    first_block = heads.where(opens_block).groupBy(F.col(_DOC).alias("_of")).agg(F.min(here).alias("first"))
    titles = facts.join(first_block, F.col(_DOC).eqNullSafe(F.col("_of")), "left").drop("_of")
    titles = titles.join(total, F.col(_DOC).eqNullSafe(F.col("_of")), "left").drop("_of")
    by_title = titles.where(F.col("title").isNotNull() & (F.coalesce("first.cuts", "total", F.lit(0)) == 0)).select(
        _DOC, F.lit("block").alias("kind"), F.lit(1).alias("block_no"), (F.col("title.line_no") + 1).alias("block_start"), first_name.alias("nome_software"),
        F.lit(0).alias("chunk_ordem"), (F.col("title.line_no") + 1).alias("start"), F.coalesce("first.line_no", end).alias("stop"),
        none.alias("h1"), none.alias("h2"), none.alias("hc"), "n_lines",
    )
    whole = facts.where("title is null and first_head is null").select(
        _DOC, F.lit("whole").alias("kind"), F.lit(0).alias("block_no"), F.lit(0).alias("block_start"), first_name.alias("nome_software"), F.lit(1).alias("chunk_ordem"),
        F.lit(0).alias("start"), end.alias("stop"), none.alias("h1"), none.alias("h2"), none.alias("hc"), "n_lines",
    )
    found = chunks.unionByName(bare).unionByName(by_title).unionByName(whole)
    found = found.withColumn(_SEGMENT, F.floor(F.col("start") / segment_lines).cast("long"))
    return _with_texts(marked, facts, stage(_with_heads(found, keep_text)), keep_text, segment_lines)


def _with_heads(found: DataFrame, keep_text: bool) -> DataFrame:
    """Add `head`, the first line that goes with a region: the end of the one before in its block, or the block's start.

    Without `keep_text` it is the region's own first line.
    """
    here = F.struct("block_no", "stop")
    # the block of a title may end where it begins
    inside = Window.partitionBy(_DOC, _SEGMENT).orderBy("start", "block_no")
    found = found.withColumn("_prev", F.lag(here).over(inside))
    ends = found.groupBy(_DOC, _SEGMENT).agg(F.max_by(here, F.struct("start", "block_no")).alias("e"), F.max("block_no").alias("_b"))
    over = Window.partitionBy(_DOC).orderBy(_SEGMENT)
    entry = ends.select(
        F.col(_DOC).alias("_d"), F.col(_SEGMENT).alias("_s"), F.lag("e").over(over).alias("_entry"),
        F.max("_b").over(Window.partitionBy(_DOC)).alias("last_block"),
    )
    joined = found.join(entry, F.col(_DOC).eqNullSafe(F.col("_d")) & (F.col(_SEGMENT) == F.col("_s")))
    before = F.coalesce("_prev", "_entry")
    head = F.when(before.isNull(), 0).when(before["block_no"] == F.col("block_no"), before["stop"]).otherwise(F.col("block_start"))
    head = head if keep_text else F.col("start")
    return joined.withColumn("head", head.cast("long")).drop("_prev", "_entry", "_d", "_s")


def _with_texts(marked: DataFrame, facts: DataFrame, found: DataFrame, keep_text: bool, segment_lines: int) -> DataFrame:
    """The regions with their texts: every line goes to the last region whose head it does not precede."""
    region = F.struct("start", "block_no", "kind", "block_start", "nome_software", "stop")
    rows = marked.select(_DOC, _SEGMENT, "line_no", F.lit(1).alias("_is"), "line", "blank", F.col("h").isNotNull().alias("is_head"), F.lit(None).cast(found.select(region.alias("r")).schema["r"].dataType).alias("r"))
    heads = found.select(
        _DOC, F.floor(F.col("head") / segment_lines).cast("long").alias(_SEGMENT), F.col("head").alias("line_no"), F.lit(0).alias("_is"),
        F.lit(None).cast("string").alias("line"), F.lit(False).alias("blank"), F.lit(False).alias("is_head"), region.alias("r"),
    )
    heads = heads.withColumn("_at", F.col("r.block_no"))
    rows = rows.withColumn("_at", F.lit(0).cast(heads.schema["_at"].dataType))
    every = facts.select(_DOC, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_lines") - 1) / segment_lines).cast("long"))).alias(_SEGMENT))
    holders = heads.unionByName(every, allowMissingColumns=True)
    dealt = _carried(rows.unionByName(heads), ["line_no", "_is", "_at"], lasts={"own": F.col("r")}, holders=holders).where("_is = 1 and own is not null")
    names = (F.col("line_no") == F.col("own.block_start") - 1) & (tx.strip(F.col("line")) == F.col("own.nome_software"))
    other = F.col("own.kind") != "chunk"
    if keep_text:
        kept = dealt.where((other | ~F.col("blank")) & ~names)
    else:
        plain = (F.col("line_no") == F.col("own.start")) | ~(F.col("is_head") | F.col("blank"))
        kept = dealt.where((F.col("line_no") < F.col("own.stop")) & (other | plain))
    texts = kept.groupBy(_DOC, F.col("own.start").alias("_start"), F.col("own.block_no").alias("_block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("joined")
    )
    texts = texts.withColumnRenamed(_DOC, "_d")
    same = F.col(_DOC).eqNullSafe(F.col("_d")) & (F.col("start") == F.col("_start")) & (F.col("block_no") == F.col("_block"))
    rows = found.join(texts, same, "left")
    joined = F.coalesce("joined", F.lit(""))
    stem = paths.stem(F.col(_DOC))
    titulo, hierarquia = chunking.chunk_metadata(stem, F.col("h1"), F.col("h2"), F.col("hc"))
    return rows.select(
        _DOC, paths.basename(F.col(_DOC)).alias("nome_arquivo"), F.lit(None).cast("string").alias("arquivo_hash"), "kind",
        F.col("block_no").cast("int").alias("block_no"), F.col("last_block").cast("int").alias("last_block"), "nome_software",
        F.col("chunk_ordem").cast("int").alias("chunk_ordem"), titulo.alias("titulo"), hierarquia.alias("hierarquia"),
        F.when(F.col("kind") == "block", joined).otherwise(tx.strip(joined)).alias("content"),
    )


def topic_records(
    lines: DataFrame, config: chunking.ChunkConfig, ingested_at: Column, empty_blocks: bool = False, segment_lines: int = SEGMENT_LINES
) -> DataFrame:
    """Chunk records of documents given as lines; see `chunking.topic_records`."""
    return chunking.records_of_regions(regions(lines, config.keep_text, segment_lines), config, ingested_at, empty_blocks)
