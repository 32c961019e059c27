"""Quality rules on repetition: characters inside duplicated n-grams and lines, by rolling hashes in numpy.

Texts of a batch lie in one byte array. Words and lines get 64-bit hashes from one running sum of bytes times
powers, windows of words of every length from one running sum of word hashes times powers: two entries of it give
a window's hash, whatever its length. Mixed with the number of their text, one sort per length finds what occurs
again. No row leaves its task, so there is no shuffle and no hot key.

Base rules fail a text with fewer than MIN_WORDS words, or with over half its words in three-word windows
that occur twice. The method's rules reject a text if windows of n words that occurred before hold more
than a share of its word characters, for each n of COVERAGE, or if lines that occurred before are too
many or hold too much.

Defined cases: a null or empty text has no words and fails the base rules; a very long text is a batch of
its own; repeated rows are judged each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docspark.llm.common import Rolling, Texts, mix, per_text, slices

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Highest percentage of word characters in later copies of windows, by number of words.
COVERAGE = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
MAX_LINE_PERCENT = 30
MAX_LINE_CHAR_PERCENT = 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def copies(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries occur twice or more in their text, and which of these are not the first."""
    twice, later = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    keys = mix(hashes ^ mix(owner.astype(np.uint64)))
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return twice, later
    member = np.zeros(len(keys), bool)
    member[1:] |= same
    member[:-1] |= same
    at, keys = order[member], ordered[member]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    firsts = np.repeat(np.minimum.reduceat(at, heads), np.diff(np.r_[heads, len(at)]))
    twice[at] = True
    later[at] = at != firsts
    return twice, later


def covered(first: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in one of the windows of n words that begin at `first`."""
    change = np.zeros(words + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + n, -1)
    return np.cumsum(change[:-1]) > 0


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """All counts of each text."""
    texts = Texts(column)
    n = len(column)
    starts, ends, owner = texts.words()
    codepoints = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=codepoints[1:])
    chars = codepoints[ends] - codepoints[starts]
    out = {"n_words": np.bincount(owner, minlength=n), "word_chars": per_text(chars, owner, n)}
    symbols = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(_SYMBOL[texts.data], out=symbols[1:])
    out["n_symbols"] = np.diff(symbols[texts.offsets])

    breaks = np.flatnonzero(texts.data == 0x0A)
    per = np.bincount(texts.text_of(breaks), minlength=n) + 1
    line_starts = np.sort(np.r_[texts.offsets[:-1], breaks + 1])
    line_ends = np.sort(np.r_[texts.offsets[1:], breaks])
    line_owner = np.repeat(np.arange(n), per)
    upto = np.zeros(len(texts.data) + 1, np.int64)  # word characters before each byte
    np.add.at(upto, ends, chars)
    upto = np.cumsum(upto)
    line_chars = upto[line_ends] - upto[line_starts]
    worded = line_chars > 0
    line_starts, line_ends, line_owner, line_chars = (x[worded] for x in (line_starts, line_ends, line_owner, line_chars))
    _, again = copies(texts.hashes(line_starts, line_ends), line_owner)
    out["n_lines"] = np.bincount(line_owner, minlength=n)
    out["n_dup_lines"] = np.bincount(line_owner[again], minlength=n)
    out["dup_line_chars"] = per_text(line_chars[again], line_owner[again], n)

    rolling = Rolling(texts.hashes(starts, ends))

    def window_hashes(k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of k words that lie in one text, and their first words."""
        hashes = rolling.windows(k)
        first = np.flatnonzero(owner[: len(hashes)] == owner[k - 1 : k - 1 + len(hashes)])
        return hashes[first], first

    windows, first = window_hashes(3)
    twice, _ = copies(windows, owner[first])
    out["n_repeat_words"] = np.bincount(owner[covered(first[twice], 3, len(owner))], minlength=n)
    for k in COVERAGE:
        windows, first = window_hashes(k)
        _, later = copies(windows, owner[first])
        inside = covered(first[later], k, len(owner))
        out[f"dup_chars_{k}"] = per_text(chars[inside], owner[inside], n)
    return out


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether the base rules fail, and whether the text is kept."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    rejected = 100 * m["n_dup_lines"] > MAX_LINE_PERCENT * m["n_lines"]
    rejected |= 100 * m["dup_line_chars"] > MAX_LINE_CHAR_PERCENT * m["word_chars"]
    for k, percent in COVERAGE.items():
        rejected |= 100 * m[f"dup_chars_{k}"] > percent * m["word_chars"]
    return failed, ~failed & ~rejected


_COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars",
    *[f"dup_chars_{k}" for k in COVERAGE],
]


def judge(docs: DataFrame) -> DataFrame:
    """Counts and verdicts of every document: doc_id, the counts as longs, base_failed, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            m = measure(batch.column("text"))
            failed, kept = verdicts(m)
            arrays = [batch.column("doc_id"), *[pa.array(m[c].astype(np.int64)) for c in _COUNTS], pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *_COUNTS, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, kept boolean"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, schema)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns; whole rows pass through the tasks once."""
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, kept = verdicts(measure(batch.column("text")))
            yield batch.filter(pa.array(kept))

    return docs.select(*names).mapInArrow(run, schema)
