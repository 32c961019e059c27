"""Documents to section-aware, size-bounded chunks.

Everything here is narrow: a document is one row, its lines and headers are
arrays inside that row, and chunks leave through one ``explode``. No shuffle is
needed, so the work scales with the number of input splits whatever the keys.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import markdown as md
from docspark.functions import paths
from docspark.functions import text as tx
from docspark.functions.fold import bind, empty, fold_emit, once

# Defaults, option names and record texts.
DEFAULT_MAX_CHARS = 1200
DEFAULT_OVERLAP = 1
MAX_CHARS_OPTION = "RAG_MAX_CHUNK_CHARS"
OVERLAP_OPTION = "RAG_CHUNK_OVERLAP_SENTENCES"
WHOLE_DOCUMENT_TITLE = "Conteúdo do Dataset"

REGION_TYPE = (
    "struct<kind:string,block_no:int,block_start:int,nome_software:string,chunk_ordem:int,"
    "start:int,stop:int,"
    f"h1:{md.HEADER_TYPE},h2:{md.HEADER_TYPE},hc:{md.HEADER_TYPE}>"
)


@dataclass(frozen=True)
class ChunkConfig:
    """Size limit of a chunk in characters, overlap in sentences, and what chunks keep.

    With `keep_text` every line that shows something is in a chunk. Without it a
    chunk has its header and plain lines only: deeper headers, and what stands
    before the first chunk of a block or behind the last, are left out.
    """

    max_chars: int = DEFAULT_MAX_CHARS
    overlap: int = DEFAULT_OVERLAP
    keep_text: bool = True

    def __post_init__(self) -> None:
        if self.max_chars <= 0:
            raise ValueError("max_chars must be above zero")
        if self.overlap < 0:
            raise ValueError("overlap must be zero or more")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> ChunkConfig:
        env = os.environ if env is None else env

        def number(name: str, default: int) -> int:
            try:
                return int(env.get(name, default))
            except ValueError as exc:
                raise ValueError(f"{name} must be a whole number") from exc

        return cls(
            number(MAX_CHARS_OPTION, DEFAULT_MAX_CHARS), number(OVERLAP_OPTION, DEFAULT_OVERLAP)
        )


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, blank lines kept, with its 0-based `line_no`."""
    return docs.select(
        *[c for c in docs.columns if c != text],
        F.posexplode(tx.file_lines(F.col(text))).alias("line_no", "line"),
    )


def header_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per header line with its level, number and title."""
    return (
        lines(docs, text)
        .withColumn("header", md.header(F.col("line")))
        .where("header is not null")
        .select(
            *[c for c in docs.columns if c != text], "line_no", "header.level", "header.number",
            "header.title",
        )
    )


def doc_hash(text: Column) -> Column:
    """SHA-256 over the lines, joined by one line feed."""
    return F.sha2(F.array_join(tx.file_lines(text), "\n"), 256)


def _marked_lines(text: Column) -> Column:
    return F.transform(
        tx.file_lines(text),
        lambda line, i: F.struct(
            i.alias("i"), line.alias("line"), tx.is_blank(line).alias("blank"),
            md.header(line).alias("h"),
        ),
    )


def _heads(marked: Column) -> Column:
    return F.filter(marked, lambda m: m["h"].isNotNull())


def chunk_level(text: Column) -> Column:
    """Header level at which a document is cut."""
    return bind(
        _heads(_marked_lines(text)),
        lambda hs: md.chunk_level(F.transform(hs, lambda m: m["h"])),
    )


def _regions(marked: Column, stem: Column) -> Column:
    """Chunks of a document, blocks without a chunk, or the whole of it.

    A block starts at a level-1 header, at the first deeper header, or after a
    first line that looks like a title. A chunk runs from a header of the chunk
    level to the next header of that level or above.
    """
    null_header = F.lit(None).cast(md.HEADER_TYPE)

    def region(kind: str, st: Column, ordem: Column, start: Column, stop: Column) -> Column:
        return F.array(
            F.struct(
                F.lit(kind).alias("kind"),
                st["block_no"].alias("block_no"),
                st["block_start"].alias("block_start"),
                st["name"].alias("nome_software"),
                ordem.alias("chunk_ordem"),
                start.alias("start"),
                stop.cast("int").alias("stop"),
                st["oh1"].alias("h1"),
                st["oh2"].alias("h2"),
                st["ohc"].alias("hc"),
            )
        )

    def walk(ms: Column, heads: Column, level: Column, title: Column) -> Column:
        titled = title.isNotNull()
        start = F.struct(
            F.when(titled, 1).otherwise(0).alias("block_no"),
            F.coalesce(title["i"] + 1, F.lit(0)).cast("int").alias("block_start"),
            F.lit(False).alias("has_chunk"),
            F.coalesce(tx.strip(title["line"]), stem).alias("name"),
            F.lit(0).alias("ordem"),
            null_header.alias("h1"),
            null_header.alias("h2"),
            F.lit(-1).alias("open"),
            null_header.alias("oh1"),
            null_header.alias("oh2"),
            null_header.alias("ohc"),
        )

        def step(st: Column, m: Column) -> tuple[Column, Column]:
            h, lv = m["h"], m["h"]["level"]
            closes = (st["open"] >= 0) & (lv <= level)
            bare = (lv == 1) & (st["block_no"] > 0) & ~st["has_chunk"] & ~closes
            out = (
                F.when(closes, region("chunk", st, st["ordem"] + 1, st["open"], m["i"]))
                .when(bare, region("block", st, st["ordem"], st["block_start"], m["i"]))
                .otherwise(empty(REGION_TYPE))
            )
            fresh = (lv == 1) | (st["block_no"] == 0)
            opens = lv == level
            h1 = F.when(lv == 1, h).otherwise(st["h1"])
            h2 = F.when(lv == 1, null_header).when(lv == 2, h).otherwise(st["h2"])
            nxt = F.struct(
                F.when(fresh, st["block_no"] + 1).otherwise(st["block_no"]).alias("block_no"),
                F.when(fresh, m["i"]).otherwise(st["block_start"]).alias("block_start"),
                (opens | (~fresh & st["has_chunk"])).alias("has_chunk"),
                F.when(lv == 1, h["title"]).otherwise(st["name"]).alias("name"),
                F.when(fresh, 0)
                .when(closes, st["ordem"] + 1)
                .otherwise(st["ordem"])
                .alias("ordem"),
                h1.alias("h1"),
                h2.alias("h2"),
                F.when(opens, m["i"]).when(closes, -1).otherwise(st["open"]).alias("open"),
                F.when(opens, h1).otherwise(st["oh1"]).alias("oh1"),
                F.when(opens, h2).otherwise(st["oh2"]).alias("oh2"),
                F.when(opens, h).otherwise(st["ohc"]).alias("ohc"),
            )
            return nxt, out

        def finish(st: Column) -> Column:
            end = F.size(ms)
            return (
                F.when(st["open"] >= 0, region("chunk", st, st["ordem"] + 1, st["open"], end))
                .when(st["block_no"] == 0, region("whole", st, F.lit(1), F.lit(0), end))
                .when(~st["has_chunk"], region("block", st, st["ordem"], st["block_start"], end))
                .otherwise(empty(REGION_TYPE))
            )

        return fold_emit(heads, start, REGION_TYPE, step, finish)

    def first_title(ms: Column, heads: Column) -> Column:
        before = F.slice(ms, 1, F.coalesce(F.get(heads, F.lit(0))["i"], F.size(ms)))
        return F.get(
            F.filter(before, lambda m: ~m["blank"] & md.looks_like_title(m["line"])), F.lit(0)
        )

    return bind(
        F.struct(marked.alias("ms"), stem.alias("stem")),
        lambda d: bind(
            _heads(d["ms"]),
            lambda hs: bind(
                F.struct(
                    md.chunk_level(F.transform(hs, lambda m: m["h"])).alias("level"),
                    first_title(d["ms"], hs).alias("title"),
                ),
                lambda p: walk(d["ms"], hs, p["level"], p["title"]),
            ),
        ),
    )


def _whole_content(ms: Column, rs: Column, r: Column, i: Column) -> Column:
    """Text of a region with the lines around it that belong to no other one.

    What stands before a chunk goes with it, down from the chunk before in the
    same block or the start of the block; a block's rest goes with its last chunk.
    """

    def around(before: Column, after: Column) -> Column:
        head = (
            F.when(i == 0, 0)
            .when(before["block_no"] == r["block_no"], before["stop"])
            .otherwise(r["block_start"])
        )
        tail = (
            F.when(after.isNull(), F.size(ms))
            .when(after["block_no"] == r["block_no"], r["stop"])
            .otherwise(after["block_start"])
        )
        part = F.slice(ms, head + 1, tail - head)
        # the line that names a block is its name, not its text
        names = lambda m: (m["i"] == r["block_start"] - 1) & (tx.strip(m["line"]) == r["nome_software"])
        kept = F.filter(part, lambda m: ((r["kind"] != "chunk") | ~m["blank"]) & ~names(m))
        joined = F.array_join(F.transform(kept, lambda m: m["line"]), "\n")
        return F.when(r["kind"] == "block", joined).otherwise(tx.strip(joined))

    return bind(F.get(rs, i - 1), lambda b: bind(F.get(rs, i + 1), lambda a: around(b, a)))


def _content(ms: Column, r: Column) -> Column:
    """Text of a region: a chunk keeps its header and its plain lines."""
    part = F.slice(ms, r["start"] + 1, r["stop"] - r["start"])
    kept = F.filter(
        part,
        lambda m: (r["kind"] != "chunk")
        | (m["i"] == r["start"])
        | (m["h"].isNull() & ~m["blank"]),
    )
    joined = F.array_join(F.transform(kept, lambda m: m["line"]), "\n")
    return F.when(r["kind"] == "block", joined).otherwise(tx.strip(joined))


def chunk_metadata(software: Column, level1: Column, h2: Column, hc: Column) -> tuple[Column, Column]:
    """Title and hierarchy of a chunk from its headers."""
    titulo = F.coalesce(
        F.nullif(hc["title"], F.lit("")),
        F.when(h2.isNotNull(), md.header_label(h2)),
        F.coalesce(level1["title"], software),
    )
    numbered = F.concat_ws(" - ", hc["number"], F.nullif(h2["title"], F.lit("")))
    labels = F.filter(
        F.array(md.header_label(level1), md.header_label(h2), md.header_label(hc)),
        lambda x: x != "",
    )
    hierarquia = F.when(hc["number"].isNotNull(), numbered).otherwise(F.array_join(labels, " > "))
    return titulo, hierarquia


@once
def _region_rows(text: str, source_path: str, keep_text: bool) -> Column:
    stem = paths.stem(F.col(source_path))
    return bind(
        _marked_lines(F.col(text)),
        lambda ms: bind(
            _regions(ms, stem),
            lambda rs: F.transform(
                rs,
                lambda r, i: F.struct(
                    r.alias("r"),
                    F.element_at(rs, -1)["block_no"].alias("last_block"),
                    (_whole_content(ms, rs, r, i) if keep_text else _content(ms, r)).alias("content"),
                ),
            ),
        ),
    )


@once
def _region_pieces(kind: str, content: str, limit: int, overlap: int) -> Column:
    """Numbered pieces of a region: ``array<struct<t, n>>``."""
    pieces = (
        F.when(F.col(kind) == "chunk", md.cap(F.col(content), limit, overlap))
        .when(F.col(kind) == "block", md.pack_lines(F.split(content, "\n", -1), limit, overlap))
        .otherwise(F.array(content))
    )
    return _counted(pieces)


@once
def _text_pieces(text: str, limit: int, overlap: int) -> Column:
    return _counted(md.cap(F.col(text), limit, overlap))


def _counted(pieces: Column) -> Column:
    return bind(
        pieces, lambda p: F.transform(p, lambda t: F.struct(t.alias("t"), F.size(p).alias("n")))
    )


def regions(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """One row per chunk, chunkless block or headerless document, with its text.

    `docs` holds ``source_path`` and ``text``; for `keep_text` see `ChunkConfig`.
    """
    rows = docs.select(
        "source_path",
        doc_hash(F.col("text")).alias("arquivo_hash"),
        F.explode(_region_rows("text", "source_path", keep_text)).alias("x"),
    )
    stem = paths.stem(F.col("source_path"))
    titulo, hierarquia = chunk_metadata(stem, F.col("x.r.h1"), F.col("x.r.h2"), F.col("x.r.hc"))
    return rows.select(
        "source_path",
        paths.basename(F.col("source_path")).alias("nome_arquivo"),
        "arquivo_hash",
        "x.r.kind",
        "x.r.block_no",
        "x.last_block",
        "x.r.nome_software",
        "x.r.chunk_ordem",
        titulo.alias("titulo"),
        hierarquia.alias("hierarquia"),
        F.col("x.content").alias("content"),
    )


def raw_chunks(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Chunks before the size limit, with their title and hierarchy."""
    return regions(docs, keep_text).where("kind = 'chunk'").drop("kind")


def software_blocks(docs: DataFrame) -> DataFrame:
    """One row per block of a document: its number, name and whether it holds chunks."""
    first = (F.col("kind") == "block") | ((F.col("kind") == "chunk") & (F.col("chunk_ordem") == 1))
    return regions(docs).where(first).select(
        "source_path", "block_no", "nome_software", (F.col("kind") == "chunk").alias("has_chunks")
    )


def documents(docs: DataFrame, ingested_at: Column) -> DataFrame:
    """One row per block of a document, as its records name it; no chunk is cut."""
    first = F.col("kind").isin("block", "whole") | ((F.col("kind") == "chunk") & (F.col("chunk_ordem") == 1))
    return regions(docs).where(first).select(
        "source_path", "nome_software", "nome_arquivo", "arquivo_hash",
        tx.utc_stamp(ingested_at).alias("ingestao_em"), "block_no",
    )


def topic_records(
    docs: DataFrame, config: ChunkConfig, ingested_at: Column, empty_blocks: bool = False
) -> DataFrame:
    """Chunk records of whole documents: cut, numbered and hashed.

    A chunk above the limit becomes numbered parts; a block without chunks is
    packed as a whole; a document without blocks is one record. A block without
    any text gives no record, or with `empty_blocks` one whose text is null, so
    that its document is not lost.
    """
    return records_of_regions(regions(docs, config.keep_text), config, ingested_at, empty_blocks)


def records_of_regions(r: DataFrame, config: ChunkConfig, ingested_at: Column, empty_blocks: bool = False) -> DataFrame:
    """Chunk records of the regions of documents."""
    explode = F.posexplode_outer if empty_blocks else F.posexplode
    numbered = explode(
        _region_pieces("kind", "content", config.max_chars, config.overlap)
    ).alias("pos", "p")
    rows = r.select(*[c for c in r.columns if c != "content"], numbered)
    ordinal, total = F.col("pos") + 1, F.col("p.n")
    is_chunk, is_block = F.col("kind") == "chunk", F.col("kind") == "block"
    part = F.format_string("Parte %d/%d", ordinal, total)
    return rows.select(
        "source_path",
        "nome_arquivo",
        "arquivo_hash",
        "block_no",
        "last_block",
        "nome_software",
        F.when(is_block, F.col("chunk_ordem") + ordinal)
        .otherwise(F.col("chunk_ordem"))
        .cast("int")
        .alias("chunk_ordem"),
        F.when(is_chunk, ordinal).otherwise(1).cast("int").alias("subchunk_ordem"),
        F.when(is_chunk, total).otherwise(1).cast("int").alias("subchunk_total"),
        F.when(
            is_chunk & (total > 1), F.concat_ws(" | ", F.nullif("hierarquia", F.lit("")), part)
        )
        .when(is_chunk, F.col("hierarquia"))
        .otherwise(F.format_string("Chunk %d", ordinal))
        .alias("hierarquia"),
        F.when(is_chunk, F.col("titulo"))
        .when(is_block, F.col("nome_software"))
        .otherwise(F.lit(WHOLE_DOCUMENT_TITLE))
        .alias("titulo"),
        F.col("p.t").alias("texto"),
        F.sha2("p.t", 256).alias("conteudo_hash"),
        tx.utc_stamp(ingested_at).alias("ingestao_em"),
    )


def whole_documents(docs: DataFrame, config: ChunkConfig, ingested_at: Column) -> DataFrame:
    """Only the records of documents without any block."""
    return topic_records(docs, config, ingested_at).where("block_no = 0")


def fallback_chunks(docs: DataFrame, config: ChunkConfig, ingested_at: Column) -> DataFrame:
    """Only the records of blocks that hold no chunk."""
    return topic_records(docs, config, ingested_at).where(F.col("hierarquia").rlike("^Chunk [0-9]+$"))


def cap_texts(df: DataFrame, text: str, config: ChunkConfig) -> DataFrame:
    """Size-bounded pieces of a text column, numbered, without sections."""
    keys = [c for c in df.columns if c != text]
    pieces = _text_pieces(text, config.max_chars, config.overlap)
    return df.select(*keys, F.posexplode(pieces).alias("pos", "p")).select(
        *keys,
        (F.col("pos") + 1).alias("subchunk_ordem"),
        F.col("p.n").alias("subchunk_total"),
        F.col("p.t").alias("texto"),
    )
