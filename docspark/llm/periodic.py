"""Periodic runs: maximal stretches of words that repeat with a period, by minimizers of several scales.

A run is a stretch with smallest period q (words q apart are equal) of at least max(LEAST, 2 q) words that
no neighbouring word extends. All texts of a batch are searched together, as one array of word hashes that
differ between texts, so nothing leaves a task: no shuffle, no hot key.

* Periods below SHORT are scanned directly. A run of lag q holds a stretch of q equal pairs or more, so
  that comparing every q-th word with the one q later meets it.
* At scale W (SHORT, doubling) periods from W to 2 W - 1 are found by minimizers. Windows of W / 2 + 1
  places are one period apart alike, so the least hash of W / 2 words in them stands q apart twice: equal
  minimizers at such a distance seed a run, which is extended by comparing words.
* Places whose W / 2 words have a period of W / 4 or less lie in a run already known and are left out of the
  minima, so that equal minimizers stand more than W / 4 apart and each has a handful of partners. A run
  without any other place has its first period in one known run and its second in the next of the same
  period, which touches it; there the lags follow from the ends and the phase of both.

A stretch found for several lags has the smallest as period: lags beyond it are its multiples.

Defined cases: a null or empty text has no word and no run, and collapses to an empty text; a very long
text is a batch of its own and must fit a task; repeated rows are searched each; a null id is kept; an empty
table gives an empty result; other columns are not read. Words are equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docspark.llm.common import Rolling, Texts, mix, slices

#: Shortest run in words.
LEAST = 12
#: Periods below it are scanned directly, those from it on are seeded by minimizers. A power of 2.
SHORT = 32

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """`least` (np.minimum or np.maximum) of every window, by doubling."""
    span = 1
    while 2 * span <= width:
        values, span = least(values[:-span], values[span:]), 2 * span
    return least(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the least hash of some window of `width` places; _NONE is never chosen."""
    lows = _sliding(hashes, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero((_sliding(np.concatenate([edge, lows, edge]), width, np.maximum) == hashes) & (hashes != _NONE))


class _Search:
    """Runs of a sequence of word hashes: `found` has the period by (start, end)."""

    def __init__(self, words: np.ndarray, least: int):
        self.words, self.least = words, least
        self.found: dict[tuple[int, int], int] = {}

    def stretch(self, at: int, lag: int) -> tuple[int, int]:
        """The range around `at` whose words equal the ones `lag` later."""
        a, b = self.words[: len(self.words) - lag], self.words[lag:]
        low, high, step = at, at + 1, 64
        while high < len(a):
            differ = a[high : high + step] != b[high : high + step]
            first = int(differ.argmax())
            if differ[first]:
                high += first
                break
            high, step = high + len(differ), min(4 * step, 1 << 16)
        step = 64
        while low > 0:
            differ = (a[max(0, low - step) : low] != b[max(0, low - step) : low])[::-1]
            first = int(differ.argmax())
            if differ[first]:
                low -= first
                break
            low, step = low - len(differ), min(4 * step, 1 << 16)
        return low, high

    def extend(self, seeds: np.ndarray, lag: int) -> None:
        """Take the runs of this lag around the seeds, which ascend."""
        done = 0
        for at in seeds.tolist():
            if at < done or self.words[at] != self.words[at + lag]:
                continue
            low, done = self.stretch(at, lag)
            if done - low >= max(lag, self.least - lag):
                run = (low, done + lag)
                self.found[run] = min(lag, self.found.get(run, lag))

    def scan(self, lag: int) -> None:
        """All runs of a short lag: a run holds one of the places compared."""
        need = max(lag, self.least - lag)
        a, b = self.words[: len(self.words) - lag], self.words[lag:]
        hits = np.flatnonzero(a[::need] == b[::need]) * need
        if not len(hits):
            return
        reach = np.ones(len(hits), np.int64)  # equal words around each, six at most looked at
        for step in (1, -1):
            on = np.ones(len(hits), bool)
            for k in range(1, min(need, 6)):
                at = hits + step * k
                on &= (at >= 0) & (at < len(a))
                at = np.where(on, at, 0)
                on &= a[at] == b[at]
                reach += on
        self.extend(hits[reach >= min(need, 6)], lag)

    def known(self, low: int, high: int) -> np.ndarray:
        """Rows (start, end, period) of the runs found with periods from low to high."""
        rows = [(s, e, q) for (s, e), q in self.found.items() if low <= q <= high]
        return np.array(sorted(rows, key=lambda r: (r[2], r[0])), np.int64).reshape(-1, 3)

    def minima(self, scale: int, places: np.ndarray, owner: np.ndarray) -> None:
        """Runs of periods from scale to 2 * scale - 1 that equal minimizers seed; `places` are the words looked at."""
        size = scale // 2
        hashes = Rolling(self.words[places]).windows(size)
        count = len(hashes)
        inside = np.zeros(len(self.words) + 1, np.int64)
        periodic = self.known(1, size // 2)
        periodic = periodic[periodic[:, 1] - periodic[:, 0] >= size]
        np.add.at(inside, periodic[:, 0], 1)
        np.add.at(inside, periodic[:, 1] - size + 1, -1)
        left_out = (np.cumsum(inside)[places[:count]] > 0) | (owner[places[:count]] != owner[places[size - 1 :]])
        chosen = minimizers(np.where(left_out, _NONE, hashes), size + 1)
        chosen = chosen[np.argsort(hashes[chosen], kind="stable")]
        values, at = hashes[chosen], places[chosen]
        seeds, step = [], 1
        while step < len(at):
            lag = at[step:] - at[:-step]
            near = (values[step:] == values[:-step]) & (lag < 2 * scale)
            if not near.any():
                break
            near &= lag >= scale
            seeds.append(np.stack([lag[near], at[:-step][near]]))
            step += 1
        if seeds:
            lags, at = np.concatenate(seeds, axis=1)
            order = np.lexsort((at, lags))
            lags, at = lags[order], at[order]
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(lags)) + 1):
                if len(part):
                    self.extend(at[part], int(lags[part[0]]))

    def touching(self, scale: int, low: int, high: int) -> None:
        """Runs of lags from `scale` on whose first periods lie in one run with a period from low to high, the others in the next."""
        rows = self.known(low, high).tolist()
        for (a, b, q), (a2, b2, q2) in zip(rows, rows[1:], strict=False):
            if q != q2 or a2 > b:
                continue
            root, wanted, phase = self.words[a : a + 2 * q].tobytes(), self.words[a2 : a2 + q].tobytes(), 0
            while phase >= 0 and (phase := root.find(wanted, phase)) % 8:
                phase = -1 if phase < 0 else phase + 1
            if phase < 0:
                continue
            shift = a2 - a - phase // 8
            lags = np.arange(scale + (shift - scale) % q, min(b - a, b2 - a2) + 1, q)
            start = np.maximum(a, a2 - lags)
            fits = np.minimum(b, b2 - lags) - start >= lags
            for lag, at in zip(lags[fits].tolist(), start[fits], strict=True):
                self.extend(np.array([at]), lag)


def find_runs(words: np.ndarray, owner: np.ndarray, least: int = LEAST, short: int = SHORT) -> np.ndarray:
    """Rows (start, end, period) of all runs by start and period; equal words have equal hashes, those of two texts never."""
    search = _Search(words, min(least, short // 2))
    sizes = np.bincount(owner)[owner] if len(owner) else owner
    for lag in range(1, min(short, len(words))):
        search.scan(lag)
    scale, low = short, 1
    while len(places := np.flatnonzero(sizes >= 2 * scale)):
        search.minima(scale, places, owner)
        search.touching(scale, low, scale // 4)
        scale, low = 2 * scale, scale // 4 + 1
    runs = search.known(1, len(words))
    runs = runs[runs[:, 1] - runs[:, 0] >= least]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _search(column: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of every text."""
    texts = Texts(column)
    n = len(column)
    starts, ends, owner = texts.words()
    words = mix(texts.hashes(starts, ends) ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    runs = find_runs(words, owner)
    first = np.searchsorted(owner, np.arange(n + 1))  # first word of each text
    of = owner[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    keep = np.cumsum(change[:-1]) == 0
    data, has = texts.data.tobytes(), np.bincount(of, minlength=n) > 0
    collapsed = []
    for i, (a, b) in enumerate(zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True)):
        parts = data[a:b].split()  # bytes split at the same six bytes as words()
        if has[i]:
            parts = [w for w, k in zip(parts, keep[first[i] : first[i + 1]].tolist(), strict=True) if k]
        collapsed.append(b" ".join(parts))
    rows = pa.StructArray.from_arrays([pa.array(x) for x in (runs[:, 0] - first[of], runs[:, 1] - runs[:, 0], runs[:, 2])], fields=list(_RUNS.value_type))
    listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), rows)
    return np.diff(first), listed, pa.array(collapsed, pa.binary()).cast(pa.string())


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document.

    `runs` has (start, length, period) in words by start, then period. `collapsed` is the text without the
    words that some run holds after its first period, joined by single spaces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n_words, runs, collapsed = _search(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), runs, collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, schema)
