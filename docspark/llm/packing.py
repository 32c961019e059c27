"""Packing of token sequences: exact complements from an index of sums, then best fit.

Documents become pieces of at most the capacity, and only the numbers of pieces per length decide how
they are packed: a table no longer than the capacity. An index holds the sums of one, two and three
lengths. The plan takes lengths in falling order, looks their gap up in the index and uses a combination as
often as its scarcest length allows; entries whose lengths have run out are passed for good. What no combination
completes goes by best fit, length by length, into the open sequences with the smallest sufficient gap.
Both steps work on batches of equal sequences, so the plan is as long for 10^10 pieces as for 10^5.
Pieces then get a number inside their length, without gathering a length, and the plan maps numbers to
sequences and offsets.

Tokens are those of a tokenizer file, with an end token behind each document. A text is cut at single
spaces and line breaks between visible characters, where the tokenizer's own splitting always cuts, and
the tokens of words are remembered in dictionaries of bounded size.

Defined cases: a null or empty text is one piece, the end token alone; a long text without spaces is
tokenized whole; repeated rows are packed each; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import numbered, slices

CAPACITY = 2048
END_ID = 0
#: Remembered words, of either kind, while a task runs.
REMEMBERED = 200_000


def plain(text: str) -> bool:
    """Whether a text is words between single spaces and single line breaks, without other white space."""
    return " ".join(text.split()) == text.replace("\n", " ")


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, for a byte-level BPE file of the tokenizers library.

    The file's merges are ordered as its ids, so its vocabulary serves as ranks for the faster `tiktoken`.
    New words of a batch are encoded in one text, on lines of their own; a line break between visible
    characters is always a token by itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        as_byte = byte_characters()
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        ranks = {bytes(as_byte[c] for c in t): i for t, i in content["model"]["vocab"].items() if t not in special}
        self._encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._break = ranks[b"\n"]
        self._first: dict[str, bytes] = {}
        self._spaced: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self._encoding.encode(text, allowed_special="all"), "<u4")

    def _learn(self, known: dict[str, bytes], words: set[str], prefix: str) -> None:
        new = [w for w in words if w not in known]
        if not new:
            return
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(words)
        ids = self._whole("\n".join([prefix + w for w in new]))
        ends = np.r_[np.flatnonzero(ids == self._break), len(ids)]
        data, start = ids.tobytes(), 0
        for word, end in zip(new, (4 * ends).tolist(), strict=True):
            known[word] = data[start:end]
            start = end + 4

    def forget(self) -> None:
        """Free the remembered words; the worker goes on to other work."""
        self._first.clear()
        self._spaced.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [[line.split(" ") for line in t.split("\n")] if t and plain(t) else None for t in texts]
        self._learn(self._first, {line[0] for lines in cut if lines for line in lines}, "")
        spaced: set[str] = set()
        for lines in cut:
            for line in lines or ():
                spaced.update(line[1:])
        self._learn(self._spaced, spaced, " ")
        line_break = np.array([self._break], "<u4").tobytes()
        first, later = self._first, self._spaced.__getitem__
        return [
            self._whole(text).tobytes() if lines is None
            else line_break.join([first[line[0]] + b"".join(map(later, line[1:])) for line in lines])
            for text, lines in zip(texts, cut, strict=True)
        ]


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: (doc_id, piece, start, length, ids_crc32[, ids]).

    A document longer than the capacity is cut into pieces of full length, but for a shorter first one.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                total = len(ids) // 4
                first = total % capacity or capacity
                edges = [0, *range(first, total + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc_id, k, a, b - a, zlib.crc32(part), np.frombuffer(part, "<u4").tolist() if keep_ids else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(columns[5], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        encoder.forget()

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return source.mapInArrow(cut, _SCHEMA + (", ids array<long>" if keep_ids else ""))


class Sums:
    """Index of what one, two or three available lengths add up to: `left` counts the pieces of each length.

    Pairs lie by their sum, the larger length first; triples by their sum, as a length and a sum of a pair. Counts
    only fall, so an entry that has run out is passed for good: `_start` tells where the live ones of a sum begin.
    """

    def __init__(self, left: Counter[int], capacity: int):
        self.left, self.capacity = left, capacity
        lengths = np.array(sorted(left), np.int32)
        first, second = np.meshgrid(lengths, lengths, indexing="ij")
        self._pairs = self._by_sum((first + second)[first >= second], first[first >= second])
        sums = np.flatnonzero(np.diff(self._pairs[1])).astype(np.int32)  # those that some pair has
        first, second = np.meshgrid(lengths, sums, indexing="ij")
        total = first + second
        self._triples = self._by_sum(total[3 * first >= total], first[3 * first >= total])  # from the largest length

    def _by_sum(self, sums: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Lengths by sum and falling inside it, where each sum begins, and where its live ones do."""
        below = sums < self.capacity
        sums, first = sums[below], first[below]
        order = np.lexsort((-first, sums))
        edges = np.searchsorted(sums[order], np.arange(self.capacity + 1))
        return first[order], edges, edges.tolist()

    def _free(self, length: int, held: tuple[int, ...]) -> int:
        return self.left[length] - held.count(length)

    def _pair(self, total: int, held: tuple[int, ...]) -> tuple[int, int] | None:
        lengths, edges, start = self._pairs
        passing = True
        for i in range(start[total], int(edges[total + 1])):
            a = int(lengths[i])
            b = total - a
            if self.left[b] > (a == b) and self.left[a]:
                passing = False
                if self._free(a, held) > (a == b) and self._free(b, held) > (a == b):
                    return a, b
            elif passing:
                start[total] = i + 1
        return None

    def find(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap, beside those held; the fewest, the largest first."""
        if not 0 < gap < self.capacity:
            return None
        if self._free(gap, held) > 0:
            return (gap,)
        if found := self._pair(gap, held):
            return found
        lengths, edges, start = self._triples
        passing = True
        for i in range(start[gap], int(edges[gap + 1])):
            a = int(lengths[i])
            pair_start, pair_edges = self._pairs[2], self._pairs[1]
            if self.left[a] and pair_start[gap - a] < pair_edges[gap - a + 1]:
                passing = False
                if self._free(a, held) > 0 and (found := self._pair(gap - a, (*held, a))):
                    return (a, *found)
            elif passing:
                start[gap] = i + 1
        return None


class Plan:
    """Sequences as batches: `times` equal sequences of the same lengths.

    Lengths from the largest are completed by what the index of sums holds for their gap, as long as it holds any;
    the rest goes best fit.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = Counter({n: c for n, c in counts.items() if c > 0})
        self.batches: list[tuple[tuple[int, ...], int]] = []
        self._lengths = sorted(self.left)
        self._complete()
        self._best_fit()

    def _use(self, lengths: tuple[int, ...]) -> None:
        need = Counter(lengths)
        times = min(self.left[n] // k for n, k in need.items())
        for n, k in need.items():
            self.left[n] -= k * times
        self.batches.append((lengths, times))

    def _complete(self) -> None:
        sums = Sums(self.left, self.capacity)
        for n in reversed(self._lengths):
            if n == self.capacity:
                self.batches.append(((n,), self.left[n]))
                self.left[n] = 0
            while self.left[n] and (found := sums.find(self.capacity - n, (n,))):
                self._use((n, *found))

    def _best_fit(self) -> None:
        """Open sequences by gap; each length in falling order goes where the least space is left."""
        gaps: list[int] = []
        open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

        def put(lengths: tuple[int, ...], times: int) -> None:
            gap = self.capacity - sum(lengths)
            if gap not in open_:
                open_[gap] = []
                bisect.insort(gaps, gap)
            open_[gap].append((lengths, times))

        for n in reversed(self._lengths):
            count = self.left.get(n, 0)
            while count:
                i = bisect.bisect_left(gaps, n)
                if i == len(gaps):
                    per = self.capacity // n
                    if count >= per:
                        put((n,) * per, count // per)
                    if count % per:
                        put((n,) * (count % per), 1)
                    break
                gap = gaps[i]
                lengths, times = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    del gaps[i]
                fit = gap // n
                if count >= fit * times:
                    put(lengths + (n,) * fit, times)
                    count -= fit * times
                elif count >= fit:
                    put(lengths, times - count // fit)
                    put(lengths + (n,) * fit, count // fit)
                    count %= fit
                else:
                    if times > 1:
                        put(lengths, times - 1)
                    put(lengths + (n,) * count, 1)
                    count = 0
        self.batches += [batch for same in open_.values() for batch in same]

    def intervals(self) -> list[tuple[int, int, int, int, int]]:
        """(length, first number, end number, first sequence, offset) for pieces numbered inside their length."""
        used: Counter[int] = Counter()
        rows, sequence = [], 0
        for lengths, times in self.batches:
            offset = 0
            for n in lengths:
                rows.append((n, used[n], used[n] + times, sequence, offset))
                used[n] += times
                offset += n
            sequence += times
        return rows


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add `sequence_id` and `offset` to stored pieces.

    The numbers of pieces per length, `capacity` rows at most, are the only rows that go to the driver.
    """
    spark = cut.sparkSession
    counts = cut.groupBy("length").count().collect()
    plan = Plan({r["length"]: r["count"] for r in counts}, capacity)
    table = spark.createDataFrame(plan.intervals(), "_length long, _first long, _end long, _sequence long, offset long")
    ranked = numbered(cut, ["length"], F.xxhash64("doc_id", "piece", "ids_crc32"), ["doc_id", "piece", "ids_crc32", "start"], "_number")
    fits = (F.col("length") == F.col("_length")) & (F.col("_number") >= F.col("_first")) & (F.col("_number") < F.col("_end"))
    placed = ranked.join(F.broadcast(table), fits)
    placed = placed.withColumn("sequence_id", F.col("_sequence") + F.col("_number") - F.col("_first"))
    return placed.drop("_number", "_length", "_first", "_end", "_sequence")
