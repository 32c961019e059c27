"""Token counts by byte-pair merging with a heap over a linked list.

A part of a text starts as a list of its characters. A heap holds the neighbouring pairs whose join is a
piece; the pair of lowest rank, leftmost among equals, is popped and merged, and the two new pairs around
it are pushed. The count is that of the initial symbols minus the merges, a character outside the
vocabulary being as many symbols as it has bytes. No identifiers are made.

The model's pieces hold blanks at their front only, and no line break, so a text is cut before a blank that
follows another character and at line breaks. Counts of parts are remembered in a dictionary of bounded
size. Each row is counted where it lies; there is no shuffle.

Defined cases: a null or empty text has no bytes and no tokens; a text without blanks is one part, merged
in n log n steps; repeated rows are counted each; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from docspark.llm.common import slices

LIMIT = 4096
#: Remembered parts per Python worker.
REMEMBERED = 600_000
#: Longer parts are not remembered.
REMEMBERED_CHARS = 64

_BLANK = "▁"
_PART = re.compile(f"{_BLANK}+[^{_BLANK}]*|[^{_BLANK}]+")


class Merger:
    """Counts of parts under a vocabulary piece -> rank, low ranks merging first."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks

    def __call__(self, part: str) -> int:
        if len(part) == 1 or part in self.ranks and len(part) == 2:
            return 1 if part in self.ranks else len(part.encode())
        ranks = self.ranks
        symbols = list(part)
        n = len(symbols)
        before = list(range(-1, n - 1))
        after = [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if (rank := ranks.get(pair)) is not None:
                heap.append((rank, i, len(pair)))
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if symbols[i] else -1
            if j < 0 or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of the two was merged meanwhile
            symbols[i] += symbols[j]
            symbols[j] = ""
            count -= 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                pair = symbols[i] + symbols[k]
                if (rank := ranks.get(pair)) is not None:
                    heapq.heappush(heap, (rank, i, len(pair)))
            if (h := before[i]) >= 0:
                pair = symbols[h] + symbols[i]
                if (rank := ranks.get(pair)) is not None:
                    heapq.heappush(heap, (rank, h, len(pair)))
        # what stayed a single unknown character stands for its bytes
        return count + sum(len(s.encode()) - 1 for s in symbols if len(s) == 1 and s not in ranks)


class _Remembered(dict):
    """Counts by part, filled on demand; the key lacks the prefix."""

    def __init__(self, merge: Merger, prefix: str):
        super().__init__()
        self.merge, self.prefix = merge, prefix

    def __missing__(self, part: str) -> int:
        count = self.merge(self.prefix + part) if self.prefix or part else 0
        if len(part) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = count
        return count


class Counter:
    """Token counts of whole texts for a sentence-piece model file with merges."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranks: dict[str, tuple[float, str]] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
                ranks[model.id_to_piece(i)] = -model.get_score(i)
        if any("\n" in p or _BLANK in p.lstrip(_BLANK) for p in ranks):
            raise ValueError("pieces with a line break or an inner blank are not supported")
        merge = Merger(ranks)
        self.plain, self.spaced = _Remembered(merge, ""), _Remembered(merge, _BLANK)

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(_BLANK, " ")  # the model does not tell them apart
        lines = text.split("\n")
        lines[0] = " " + lines[0]
        total = len(lines) - 1
        plain, spaced = self.plain, self.spaced
        for line in lines:
            if "  " in line:
                total += sum(map(plain.__getitem__, _PART.findall(line.replace(" ", _BLANK))))
            elif line:
                head, *words = line.split(" ")
                total += plain[head] + sum(map(spaced.__getitem__, words))
        return total


@cache
def _counter(path: str) -> Counter:
    return Counter(path)


def counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(model).count
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tokens = [count(t) for t in texts]
            arrays = [
                batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
