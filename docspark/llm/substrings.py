"""Substring deduplication on content-defined chunks.

A gear rolling hash of the last 16 bytes decides at every word end whether a chunk ends there, so the cuts
depend on the text around them only: after an insertion or in another document the same passage falls
into the same chunks. Chunks have a minimum of words; where no word end cuts, as in one word again and again,
they are dealt into parts of a fixed number of words. A part is a later copy if a row before holds it, or if the
same row holds its whole chunk before: such a run stays in the first one. Rows are ordered by id, those without id
last, and under one id by the hash of id and text. Runs of neighbouring later copies with enough words are cut
out; shorter ones, which chance makes, stay. What remains begins and ends at words.

Each row's distinct chunk digests are grouped for the first row that holds them (with partial sums before the
shuffle, so that a passage of many documents costs little), and only digests of two rows or more are joined
back, to their row by the hash of id and text: a hot id, or none, gathers nothing. Texts that a filter of fixed size
clears of copies stay where they are.

Defined cases: a null text stays null and an empty one empty; a text without blanks is one word and one
chunk, a very long one must fit a task; rows alike in id and text count as one and are all kept; different texts under
one id, or without id, are deduplicated like others; an empty table gives an empty result; other columns are
kept as they are, those with the names used inside included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import Texts, block_of, bloom, mask_of, mix, slices

#: One word end in four ends a chunk.
CUT_BITS = 2
MIN_CHUNK_WORDS = 3
#: Words of a part; a prime, so that the parts of a periodic run begin at every place of the period.
PART_WORDS = 31
MIN_RUN_WORDS = 20
_WINDOW = 16
_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash of the last 16 bytes at every byte: h = 2 h + gear[byte], older bytes left out."""
    h = _GEAR[data]
    step = 1
    while step < _WINDOW:
        older = h[:-step] << np.uint64(step)
        h[step:] += older
        step *= 2
    return h


class Chunks:
    """The chunks of some texts, in parts: first and end word, owner, digest and byte range of each, and its chunk."""

    def __init__(self, column: pa.Array):
        self.texts = texts = Texts(column)
        starts, ends, owner = texts.words()
        n = len(column)
        word_counts = np.bincount(owner, minlength=n)
        word_first = np.r_[0, np.cumsum(word_counts)]
        far = ends - texts.offsets[owner] >= _WINDOW
        ending = np.flatnonzero(far & (gear(texts.data)[ends - 1] >> np.uint64(64 - CUT_BITS) == 0)) if len(ends) else np.zeros(0, np.int64)
        cuts, last, current = [], -1, -1
        first_of = word_first.tolist()
        for word, text in zip(ending.tolist(), owner[ending].tolist(), strict=True):
            if text != current:
                current, last = text, first_of[text] - 1
            if word - last >= MIN_CHUNK_WORDS:
                cuts.append(word + 1)
                last = word
        has = np.flatnonzero(word_counts)
        # a cut behind a text's last word begins no chunk
        first = np.unique(np.r_[word_first[:-1][has], np.array(cuts, np.int64)])
        first = first[first < len(starts)]
        end = np.r_[first[1:], len(starts)][: len(first)]
        parts = -(-(end - first) // PART_WORDS)
        self.chunk = np.repeat(np.arange(len(first)), parts)
        self.first = first[self.chunk] + PART_WORDS * (np.arange(len(self.chunk)) - np.repeat(np.cumsum(parts) - parts, parts))
        self.end = np.minimum(self.first + PART_WORDS, end[self.chunk])
        self.owner = owner[self.first]
        self.begin_byte = starts[self.first]
        none = np.zeros(0, np.uint64)
        self.digests = texts.hashes(self.begin_byte, ends[self.end - 1]) if len(first) else none
        self._whole = mix((texts.hashes(starts[first], ends[end - 1]) if len(first) else none) ^ self._of(owner[first]))

    @staticmethod
    def _of(owner: np.ndarray) -> np.ndarray:
        return mix(owner.astype(np.uint64) + np.uint64(1))

    def keys(self) -> np.ndarray:
        return mix(self.digests ^ self._of(self.owner))

    def again(self) -> np.ndarray:
        """Parts of chunks that their text holds before."""
        _, firsts = np.unique(self._whole, return_index=True)
        later = np.ones(len(self._whole), bool)
        later[firsts] = False
        return later[self.chunk]

    def spans(self, copied: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte ranges and owners of runs of copied chunks with enough words."""
        count = len(copied)
        if not copied.any():
            none = np.zeros(0, np.int64)
            return none, none, none
        new = np.r_[True, self.owner[1:] != self.owner[:-1]]
        before = np.r_[False, copied[:-1]] & ~new
        opens = np.flatnonzero(copied & ~before)
        after = np.r_[copied[1:] & ~new[1:], False]
        closes = np.flatnonzero(copied & ~after)
        enough = self.end[closes] - self.first[opens] >= MIN_RUN_WORDS
        opens, closes = opens[enough], closes[enough]
        owners = self.owner[opens]
        nexts = np.minimum(closes + 1, count - 1)
        inner = (closes + 1 < count) & (self.owner[nexts] == owners)
        stops = np.where(inner, self.begin_byte[nexts], self.texts.offsets[owners + 1])
        return self.begin_byte[opens], stops, owners


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


#: Blocks of 8 bytes of the filter that keeps texts without copies where they are.
FILTER_BLOCKS = 1 << 18


def row_key(docs: DataFrame) -> Column:
    """The hash that only rows alike in id and text share."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, key, digests) with the distinct chunk digests of every row; without id the largest id stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            chunks = Chunks(batch.column("text"))
            _, once = np.unique(chunks.keys(), return_index=True)
            once.sort()
            counts = np.bincount(chunks.owner[once], minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), _signed(chunks.digests[once]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), lists], names=["doc_id", "key", "digests"])

    last = F.lit((1 << 63) - 1)
    source = docs.select(F.coalesce(docs["doc_id"].cast("long"), last).alias("doc_id"), row_key(docs).alias("key"), docs["text"].alias("text"))
    return source.mapInArrow(run, "doc_id long, key long, digests array<long>")


def copied_digests(docs: DataFrame, stored) -> DataFrame:
    """(key, copied): for every row, by its key, the digests of its chunks that a row before holds."""
    each = stored(digests(docs)).select(F.struct("doc_id", "key").alias("row"), F.explode("digests").alias("digest"))
    held = each.groupBy("digest").agg(F.min("row").alias("first"), F.max("row").alias("last"))
    shared = stored(held.where("first < last").select("digest", "first"))
    later = each.join(shared, "digest").where("row > first")
    return later.groupBy(F.col("row.key").alias("_key")).agg(F.collect_set("digest").alias("copied"))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))


def deduplicate(docs: DataFrame, stored, spans: bool = False) -> DataFrame:
    """The documents with later copies cut out of their texts, all columns kept.

    With `spans`, columns `_spans` (what was cut, in characters of the old text), `_words` and
    `_removed_words` follow.
    """
    copied = stored(copied_digests(docs, stored))
    sieve = F.broadcast(bloom(copied, F.col("_key"), FILTER_BLOCKS))
    packed = docs.select(row_key(docs).alias("key"), docs["text"].alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    marked = packed.join(sieve, block_of(F.col("key"), FILTER_BLOCKS) == F.col("_block"), "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(mask_of(F.col("key"))) == mask_of(F.col("key")), F.lit(False))
    none = F.lit(None).cast("array<long>").alias("copied")
    holding = marked.where(maybe).join(copied, F.col("key") == F.col("_key"), "left").select("text", "row", "copied")
    joined = marked.where(~maybe).select("text", "row", none).unionByName(holding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            column = batch.column("text")
            chunks = Chunks(column)
            lists = batch.column("copied")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(column)), lengths)
            keys = chunks.keys()
            mark = np.isin(keys, mix(flat ^ mix(owner.astype(np.uint64) + np.uint64(1))))
            starts, stops, owners = chunks.spans(mark | chunks.again())
            data, offsets = chunks.texts.data, chunks.texts.offsets
            codepoints = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=codepoints[1:])
            words = np.bincount(chunks.owner, weights=chunks.end - chunks.first, minlength=len(column)).astype(np.int64)
            texts = column.to_pylist()
            cut: list[list[dict]] = [[] for _ in texts]
            lost = [0] * len(texts)
            kept: dict[int, list[bytes]] = {}
            at: dict[int, int] = {}
            for a, b, i in zip(starts.tolist(), stops.tolist(), owners.tolist(), strict=True):
                base = int(codepoints[offsets[i]])
                cut[i].append({"start": int(codepoints[a]) - base, "length": int(codepoints[b] - codepoints[a])})
                kept.setdefault(i, []).append(data[at.get(i, int(offsets[i])) : a].tobytes())
                lost[i] += len(data[a:b].tobytes().split())
                at[i] = b
            for i, parts in kept.items():
                texts[i] = (b"".join(parts) + data[at[i] : offsets[i + 1]].tobytes()).decode()
            arrays = [pa.array(texts, pa.string()), batch.column("row")]
            names = ["text", "row"]
            if spans:
                arrays += [
                    pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                    pa.array(words, pa.int64()), pa.array(lost, pa.int64()),
                ]
                names += ["_spans", "_words", "_removed_words"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    row = T.StructType([T.StructField("text", T.StringType()), T.StructField("row", T.StructType(docs.schema.fields))])
    if spans:
        row = row.add("_spans", _SPANS).add("_words", T.LongType()).add("_removed_words", T.LongType())
    cleaned = joined.mapInArrow(run, row)
    out = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return cleaned.select(*out, *([F.col("_spans"), F.col("_words"), F.col("_removed_words")] if spans else []))
