"""Term search by a trigram index: posting lists of three letters, gaps coded, candidates checked by the real LIKE.

`number` deals rows into parts of bounded size and numbers them inside. `build` lists for every trigram of a title or
text, case folded for ASCII letters as in `kb.contains_term`, the rows of each part that hold it: differences of
ascending numbers in a variable number of bytes. Stored by `store`, sorted by trigram, a search reads the lists of the
trigrams of its term only. They are intersected part by part, the shortest list first; what is left is checked by
the LIKE of the plain search, so the result is the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.operators import kb
from docspark.session import stage, unstage

#: Rows of a part, on average.
PART_ROWS = 1 << 14
GRAM = 3
#: Letters of a part that are looked at at once.
BLOCK_LETTERS = 1 << 20


def fold(text: str | None) -> str:
    """Letters as the search compares them."""
    return (text or "").translate(str.maketrans(kb.ASCII_UPPER, kb.ASCII_LOWER))


def grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def term_grams(term: str) -> list[str]:
    """Trigrams that every match holds: those between the wildcards % and _ of the term. None if all are shorter."""
    return sorted(set().union(*[grams(piece) for piece in re.split("[%_]", fold(term))]))


def _coded(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in seven bits a byte, the last byte of each below 128, and the bytes that each takes."""
    out: list[np.ndarray] = []
    at = np.arange(len(left))
    sizes = np.zeros(len(left), np.int64)
    places = []
    step = 0
    while len(at):
        more = left >= 128
        out.append(((left & 127) | (more << 7)).astype(np.uint8))
        places.append(at * 10 + step)  # a number takes ten bytes at most
        sizes[at] += 1
        left, at, step = left[more] >> 7, at[more], step + 1
    if step < 2:
        return out[0] if out else np.zeros(0, np.uint8), sizes
    return np.concatenate(out)[np.argsort(np.concatenate(places), kind="stable")], sizes


def gaps(numbers: np.ndarray) -> bytes:
    """Ascending numbers as differences, seven bits a byte, the last byte of each below 128."""
    return _coded(np.diff(numbers, prepend=-1).astype(np.int64))[0].tobytes()


def numbers(coded: bytes) -> np.ndarray:
    """What `gaps` has coded."""
    data = np.frombuffer(coded, np.uint8).astype(np.int64)
    ends = np.flatnonzero(data < 128)
    first = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    place = np.arange(len(data)) - np.repeat(first, ends - first + 1)
    values = np.add.reduceat((data & 127) << (7 * place), first) if len(ends) else ends
    return np.cumsum(values) - 1


def number(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Add `part` and `no`, a number inside it, to rows with an `id`."""
    if part_rows <= 0:
        raise ValueError("part_rows must be above zero")
    parts = max(1, -(-rows.count() // part_rows))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int"))
    return dealt.withColumn("no", F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1)


def _blocks(table: pa.Table, columns: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Folded letters as code points and the row of each text, (row, column) after (row, column); a text's end is -1.

    A block holds whole rows of some BLOCK_LETTERS letters.
    """
    texts: list[str] = []
    rows: list[int] = []
    held = 0

    def block() -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(t) for t in texts]) + 1
        letters = np.full(sizes.sum(), -1, np.int32)
        inside = np.ones(len(letters), bool)
        inside[np.cumsum(sizes) - 1] = False
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
        letters[inside] = np.where((points >= ord("A")) & (points <= ord("Z")), points + (ord("a") - ord("A")), points)
        return letters, np.repeat(np.array(rows, np.int64), sizes)

    for i, found in enumerate(zip(*[table[c].to_pylist() for c in columns], strict=True)):
        for text in found:
            if text and len(text) >= GRAM:
                texts.append(text)
                rows.append(i)
                held += len(text)
        if held > BLOCK_LETTERS:
            yield block()
            texts, rows, held = [], [], 0
    if texts:
        yield block()


def _distinct(values: np.ndarray) -> np.ndarray:
    """Ascending values, each once."""
    values.sort()
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def _lists(table: pa.Table, columns: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Trigrams, the first place of each one's rows, and the rows (places in the table) of one after the other."""
    used = np.zeros(0x110000, bool)
    for letters, _ in _blocks(table, columns):
        used[letters[letters >= 0]] = True
    alphabet = np.flatnonzero(used)
    size, count = len(alphabet), max(1, table.num_rows)
    known = np.zeros(0, np.int64)
    place = np.zeros(0x110000, np.int64)
    place[alphabet] = np.arange(size)

    def keyed(letters: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = (letters[:-2] >= 0) & (letters[1:-1] >= 0) & (letters[2:] >= 0)
        a = place[letters]
        return ((a[:-2] * size + a[1:-1]) * size + a[2:])[whole], rows[:-2][whole]

    dense = size**3 * count < 1 << 63
    if not dense:  # a large alphabet: numbers of the trigrams that occur
        for block in _blocks(table, columns):
            known = np.union1d(known, keyed(*block)[0])
    pairs = []
    for block in _blocks(table, columns):
        key, rows = keyed(*block)
        pairs.append(_distinct((key if dense else np.searchsorted(known, key)) * count + rows))
    # a row is in one block, so no pair comes twice
    found = np.concatenate(pairs) if pairs else known
    found.sort()
    key, rows = np.divmod(found, count)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
    key = key[first] if dense else known[key[first]]
    letters = np.stack([alphabet[key // size**2], alphabet[key // size % size], alphabet[key % size]], axis=1) if size else key
    text = letters.astype(np.int32).tobytes().decode("utf-32-le")
    return [text[i : i + GRAM] for i in range(0, len(text), GRAM)], first, rows


def build(numbered: DataFrame, columns: Sequence[str] = ("titulo", "conteudo_texto")) -> DataFrame:
    """(gram, part, n, rows): the coded numbers of the rows of a part that hold a trigram, and how many."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch] | pa.Table) -> pa.Table:
        table = batches.sort_by("no")
        found, first, rows = _lists(table, columns)
        numbers = table["no"].to_numpy().astype(np.int64)[rows]
        left = np.diff(numbers, prepend=-1)
        left[first] = numbers[first] + 1  # as the difference to -1
        data, sizes = _coded(left)
        ends = np.r_[0, np.cumsum(sizes)]
        starts = ends[np.r_[first, len(numbers)].astype(np.int64)]
        coded = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)])
        return pa.table(
            {
                "gram": pa.array(found, pa.string()), "part": pa.array([key[0].as_py()] * len(found), pa.int32()),
                "n": pa.array(np.diff(np.r_[first, len(numbers)]).astype(np.int32)), "rows": coded,
            }
        )

    chosen = numbered.select("part", F.col("no").cast("int").alias("no"), *columns)
    return chosen.groupBy("part").applyInArrow(run, "gram string, part int, n int, rows binary")


def store(numbered: DataFrame, path: str, columns: Sequence[str] = ("titulo", "conteudo_texto")) -> None:
    """Write numbered rows and their lists; each sorted by what a search asks for."""
    numbered.repartition("part").sortWithinPartitions("part", "no").write.mode("overwrite").parquet(f"{path}/rows")
    rows = numbered.sparkSession.read.parquet(f"{path}/rows")
    lists = stage(build(rows, columns))  # the ranges are found by a pass of their own
    lists.repartitionByRange("gram").sortWithinPartitions("gram", "part").write.mode("overwrite").parquet(f"{path}/lists")
    unstage(lists)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Numbered rows and lists."""
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/lists")


def candidates(lists: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(part, no) of the rows that hold all the trigrams."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        left = np.zeros(0, np.int64)
        if table.num_rows == len(wanted):  # every trigram occurs in this part
            for i, coded in enumerate(table.sort_by("n")["rows"].to_pylist()):
                found = numbers(coded)
                left = found if i == 0 else left[np.isin(left, found, assume_unique=True)]
                if not len(left):
                    break
        return pa.table({"part": pa.array([key[0].as_py()] * len(left), pa.int32()), "no": pa.array(left.astype(np.int32))})

    touched = lists.where(F.col("gram").isin(*wanted)).select("part", "n", "rows")
    return touched.groupBy("part").applyInArrow(run, "part int, no int")


def search_term(
    rows: DataFrame, lists: DataFrame, term: str, limit: int = 10, order: Sequence[str] = kb.READING_ORDER
) -> DataFrame:
    """`kb.search_term` over numbered rows by their lists; a term without three letters in a row looks at all rows."""
    wanted = term_grams(term)
    if wanted:
        found = candidates(lists, wanted).select(F.col("part").alias("_part"), F.col("no").alias("_no"))
        rows = rows.join(found, (F.col("part") == F.col("_part")) & (F.col("no") == F.col("_no")), "left_semi")
    return kb.search_term(rows.drop("part", "no"), term, limit, order)
