"""N-gram Jaccard join: documents whose sets of word shingles are alike, by T-occurrence search.

A document's set holds its distinct shingles of five words, lower-cased; two documents link when
`100 * intersection >= 80 * union`. For sets of x and y shingles that is an overlap of at least
T = ceil(80 (x + y) / 180). The T-occurrence search finds, for a query set, the sets that occur T times or
more in the inverted lists of its shingles. DivideSkip leaves out the longest lists, merges the others by
a heap that skips what cannot occur often enough, and looks the candidates up in the long lists by binary
search.

The search works on cells, groups of documents outside of which no document has a partner, found so:

1. One row per document: its set's size and a 64-bit class of equal sets, and per batch the shingles that
   several documents hold. The most frequent shingles, a list of fixed length, are the long lists.
2. Ordered by (frequent last, hash), linked sets share a shingle among their first
   `n - ceil(0.8 n) + 1`. These go out as rows (shingle, class, size, sketch), grouped by shingle. Which order
   is used changes the work, not the result.
3. In the list of one shingle, classes with fitting sizes and agreeing sketches become neighbours: a
   spanning forest of them, never all pairs. A list beyond LIST_CLASSES is dealt into parts, and a task then holds
   two of them. The sketch is a min-hash of 64 x 2 bits that linked sets fail to agree on with a probability
   below 1e-12, which is that of the hashes themselves; with `agree=0` it is left out, and cells are larger.
4. Connected neighbours are a cell. One document per class goes to its cell's task; a cell beyond
   CELL_SHINGLES is dealt into blocks, and a task then holds two of them.
5. The task runs the search over whole sets and returns a spanning forest of exact links.

A row is known by its key, a 64-bit hash of id and text, so rows under one id, or without id, are told apart.
Copies are one class, so they cost a row each and no more; chains of near copies are one cell.

Defined cases: a document without words (or null) has no shingles and links with nothing; one with fewer
than five words has one shingle, the whole sequence; repeated rows are copies; a null id takes part, and
a component is named by its smallest id (null if it has none); the set of a very long text must fit a task;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import Texts, block_of, bloom, mask_of, mix, slices, window_hashes
from docspark.llm.graph import components

WORDS = 5
PERCENT = 80
#: Length of the list of frequent shingles that is broadcast, 8 bytes each.
FREQUENT = 1 << 17
#: Blocks of 8 bytes of the filter that keeps texts without a cell where they are.
FILTER_BLOCKS = 1 << 17
#: Shingles of the sets that one task holds at once, or of each of two blocks.
CELL_SHINGLES = 1 << 20
#: Rows of one shingle's list that a task holds at once, or of each of two parts.
LIST_CLASSES = 1 << 15
#: Sets of fitting size beyond which a set is first compared with its neighbours in a cell.
CROWD = 64
_SKETCH = 64
_AGREE = 30  # of 64; linked sets agree on 54 in the mean, unrelated ones on 16

_FACTORS = mix(np.arange(1, _SKETCH + 1, dtype=np.uint64)) | np.uint64(1)


def need(x: int, y: int) -> int:
    """Overlap that links sets of these sizes."""
    return -(-PERCENT * (x + y) // (100 + PERCENT))


def shingle_sets(column: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted, and their owners in order."""
    texts = Texts(column, lower=True)
    starts, ends, owner = texts.words()
    hashes = texts.hashes(starts, ends)
    found, first = window_hashes(hashes, owner, n)
    parts, owners = [found], [owner[first]]
    counts = np.bincount(owner, minlength=len(column))
    begin = np.cumsum(counts) - counts
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            whole, at = window_hashes(hashes[(begin[short][:, None] + np.arange(k)).ravel()], np.repeat(short, k), k)
            parts.append(whole)
            owners.append(np.repeat(short, k)[at])
    values, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.r_[True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])][: len(values)]
    return values[keep], owner[keep]


def classes(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and class of every set; equal sets have equal classes."""
    sizes = np.bincount(owner, minlength=n)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64, out=sums[1:])
    ends = np.cumsum(sizes)
    return sizes, mix((sums[ends] - sums[ends - sizes]) ^ mix(sizes.astype(np.uint64)))


def sketches(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the min-hash under each of 64 factors, for the sets that are not empty."""
    filled = sizes[sizes > 0]
    heads = np.cumsum(filled) - filled
    words = np.zeros((2, len(filled)), np.uint64)
    for k, factor in enumerate(_FACTORS):
        if len(heads):
            least = np.minimum.reduceat(mix_fast(values * factor), heads)
            words[k // 32] |= (least >> np.uint64(9) & np.uint64(3)) << np.uint64(2 * (k % 32))
    return words[0], words[1]


def mix_fast(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> np.uint64(32))


def agreement(a0, a1, b0, b1) -> np.ndarray:
    """On how many of the 64 places two sketches agree."""
    low = np.uint64(0x5555555555555555)
    total = np.zeros(np.broadcast(a0, b0).shape, np.uint8)
    for a, b in ((a0, b0), (a1, b1)):
        x = a ^ b
        total += np.uint8(32) - np.bitwise_count((x | (x >> np.uint64(1))) & low).astype(np.uint8)
    return total


def divide_skip(lists: list[list[int]], t: int, mu: float = 0.0085) -> tuple[dict[int, int], int]:
    """Ids that may occur t times in the lists, with their occurrences in the short ones, and how many are short.

    The longest lists are put aside, at most t - 1. The others are merged by a heap: ids that occur too
    seldom there are dropped, and all lists that hold them skip to the next id that may suffice. `lists`
    comes back ordered by length.
    """
    lists.sort(key=len)
    longest = len(lists[-1]) if lists else 1
    aside = min(t - 1, int(t / (mu * max(1, longest).bit_length() + 1)), len(lists))
    short = len(lists) - aside
    least = t - aside
    found: dict[int, int] = {}
    if least == 1:
        for one in lists[:short]:
            for i in one:
                found[i] = found.get(i, 0) + 1
        return found, short
    heap = [(one[0], k, 0) for k, one in enumerate(lists[:short]) if one]
    heapq.heapify(heap)
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            found[top] = len(popped)
            for _, k, at in popped:
                if at + 1 < len(lists[k]):
                    heapq.heappush(heap, (lists[k][at + 1], k, at + 1))
            continue
        while heap and len(popped) < least - 1:
            popped.append(heapq.heappop(heap))
        if not heap:
            break
        bound = heap[0][0]
        for _, k, at in popped:
            at = bisect_left(lists[k], bound, at)
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k, at))
    return found, short


def search(sets: list[np.ndarray], sides: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sorted sets; with sides, of those between different sides.

    Sets are queries in order of size and are searched among the smaller ones.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = [len(sets[i]) for i in order]
    _, dense = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    tokens = np.split(dense, np.cumsum(sizes)[:-1])
    tokens = [np.sort(t) for t in tokens]
    lists: list[list[int]] = [[] for _ in range(int(dense.max()) + 1)]
    forest, links = Parts(len(order)), []

    def overlap(x: int, y: int) -> int:
        at = np.searchsorted(tokens[y], tokens[x])
        at[at == len(tokens[y])] = 0
        return int(np.count_nonzero(tokens[y][at] == tokens[x]))

    for x, mine in enumerate(tokens):
        size = sizes[x]
        smallest = -(-PERCENT * size // 100)
        low = bisect_left(sizes, smallest)
        # among many near copies a set links to those just before, and few that could fit are then in other components:
        # these are compared by themselves, as a merge of all lists would find all copies again
        if sides is None and x - low > CROWD:
            for y in range(x - 3, x):
                if forest.of[x] != forest.of[y] and overlap(x, y) >= need(size, sizes[y]) and forest.join(x, y):
                    links.append((order[x], order[y]))
            others = np.flatnonzero(forest.of[low:x] != forest.of[x]) + low
            if len(others) <= CROWD:
                for y in others.tolist():
                    if overlap(x, y) >= need(size, sizes[y]) and forest.join(x, y):
                        links.append((order[x], order[y]))
                for token in mine.tolist():
                    lists[token].append(x)
                continue
        t = need(size, smallest)
        active, kept = [], []
        for token in mine.tolist():
            one = lists[token]
            if one and one[-1] >= low:
                active.append(one if one[0] >= low else one[bisect_left(one, low) :])
                kept.append(token)
        if len(active) >= t:
            by_length = sorted(range(len(active)), key=lambda k: len(active[k]))
            found, short = divide_skip(active, t)
            aside = np.sort(np.array([kept[k] for k in by_length[short:]], np.int64))
            for y in sorted(found, key=found.get, reverse=True):
                if sides is not None and sides[order[x]] == sides[order[y]] or forest.of[x] == forest.of[y]:
                    continue
                required = need(size, sizes[y]) - found[y]
                if required > len(aside):
                    continue
                if required > 0:
                    at = np.searchsorted(tokens[y], aside)
                    at[at == len(tokens[y])] = 0
                    required -= int(np.count_nonzero(tokens[y][at] == aside))
                if required <= 0 and forest.join(x, y):
                    links.append((order[x], order[y]))
        for token in mine.tolist():
            lists[token].append(x)
    return links


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def row_key(docs: DataFrame) -> Column:
    """The hash that only rows alike in id and text share."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def describe(docs: DataFrame) -> DataFrame:
    """Rows (kind, a, b, n, key): kind 0 is a document (id, class, size, key), kind 1 a shingle (hash, null, documents of a batch, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "a", "b", "n", "key"]
        for batch in slices(batches, "text"):
            values, owner = shingle_sets(batch.column("text"))
            sizes, ids = classes(values, owner, batch.num_rows)
            kind = pa.array(np.zeros(batch.num_rows, np.int32))
            yield pa.RecordBatch.from_arrays(
                [kind, batch.column("doc_id"), _long(ids), pa.array(sizes.astype(np.int64)), batch.column("key")], names=names
            )
            tokens, counts = np.unique(values, return_counts=True)
            tokens, counts = tokens[counts > 1], counts[counts > 1]
            kind = pa.array(np.ones(len(tokens), np.int32))
            none = pa.nulls(len(tokens), pa.int64())
            yield pa.RecordBatch.from_arrays([kind, _long(tokens), none, pa.array(counts.astype(np.int64)), none], names=names)

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs).alias("key"), docs["text"].alias("text"))
    return source.mapInArrow(run, "kind int, a long, b long, n long, key long")


def prefixes(docs: DataFrame, frequent) -> DataFrame:
    """Rows (token, class, n, s0, s1) for the first shingles of every set, once per class and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = frequent.value
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            values, owner = shingle_sets(batch.column("text"))
            sizes, ids = classes(values, owner, batch.num_rows)
            s0, s1 = sketches(values, sizes)
            filled = np.flatnonzero(sizes)
            if not len(filled):
                continue
            at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
            late = np.where(known[at] == values, rank[at], 0) if len(known) else np.zeros(len(values), np.int64)
            order = np.lexsort((values, late, owner))
            n = sizes[filled]
            take = n - (PERCENT * n + 99) // 100 + 1
            new = np.array([not (i in seen or seen.add(i)) for i in ids[filled].tolist()])
            place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
            chosen = order[(place < np.repeat(take, n)) & np.repeat(new, n)]
            row = np.searchsorted(filled, owner[chosen])
            arrays = [_long(values[chosen]), _long(ids[filled][row]), pa.array(n[row].astype(np.int32)), _long(s0[row]), _long(s1[row])]
            yield pa.RecordBatch.from_arrays(arrays, names=["token", "class", "n", "s0", "s1"])

    source = docs.select(docs["text"].alias("text"))
    return source.mapInArrow(run, "token long, class long, n int, s0 long, s1 long")


class Parts:
    """Components of small integers that tell a whole range at once; the smaller of two takes the other's number."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self._members: dict[int, list[np.ndarray]] = {}

    def join(self, i: int, j: int) -> bool:
        a, b = int(self.of[i]), int(self.of[j])
        if a == b:
            return False
        sides = [self._members.pop(x, [np.array([x])]) for x in (a, b)]
        if sum(map(len, sides[0])) > sum(map(len, sides[1])):
            a, b, sides = b, a, sides[::-1]
        small = np.concatenate(sides[0])
        self.of[small] = b
        self._members[b] = [np.concatenate([*sides[1], small])] if len(sides[1]) > 32 else [*sides[1], small]
        return True


def _forest_of(ids: np.ndarray, n: np.ndarray, s0: np.ndarray, s1: np.ndarray, agree: int = _AGREE) -> list[tuple[int, int]]:
    """A spanning forest of the classes of one list that fit in size and sketch.

    In order of size, a class is compared with the classes of fitting sizes before it: with the nearest first, and
    then with those of other components only, so that a list of near copies takes time in proportion to its length.
    """
    order = np.argsort(n, kind="stable")
    ids, n, s0, s1 = (x[order] for x in (ids, n, s0, s1))
    least = np.searchsorted(n, -(-PERCENT * n // 100))
    parts, out = Parts(len(ids)), []

    def compare(i: int, with_: np.ndarray) -> None:
        fits = with_[agreement(s0[i], s1[i], s0[with_], s1[with_]) >= agree]
        if len(fits):
            _, first = np.unique(parts.of[fits], return_index=True)
            for j in fits[first].tolist():
                if parts.join(i, j):
                    out.append((int(ids[i]), int(ids[j])))

    for i in range(1, len(ids)):
        low = int(least[i])
        compare(i, np.arange(max(low, i - 64), i))
        if i - 64 > low:
            apart = np.flatnonzero(parts.of[low : i - 64] != parts.of[i]) + low
            if len(apart):
                compare(i, apart)
    return out


_FOUND = "kind int, a long, b long, n int, s0 long, s1 long"
_LIST = ["token", "class", "n", "s0", "s1"]


def _forests(table: pa.Table, keys: list[str], agree: int) -> set[tuple[int, int]]:
    """Links of all lists of a table, which the keys tell apart."""
    group = np.unique(np.stack([table[c].to_numpy() for c in keys], axis=1), axis=0, return_inverse=True)[1].ravel()
    ids, n = table["class"].to_numpy(), table["n"].to_numpy().astype(np.int64)
    s0, s1 = (table[c].to_numpy().view(np.uint64) for c in ("s0", "s1"))
    order = np.lexsort((ids, group))
    new = np.r_[True, (group[order][1:] != group[order][:-1]) | (ids[order][1:] != ids[order][:-1])]
    order = order[new]  # tasks have sent the same class
    group, ids, n, s0, s1 = (x[order] for x in (group, ids, n, s0, s1))
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    counts = np.diff(np.r_[heads, len(group)])
    found: set[tuple[int, int]] = set()
    two = heads[counts == 2]
    fits = 100 * np.minimum(n[two], n[two + 1]) >= PERCENT * np.maximum(n[two], n[two + 1])
    fits &= agreement(s0[two], s1[two], s0[two + 1], s1[two + 1]) >= agree
    found.update(zip(ids[two[fits]].tolist(), ids[two[fits] + 1].tolist(), strict=True))
    for head, count in zip(heads[counts > 2].tolist(), counts[counts > 2].tolist(), strict=True):
        part = slice(head, head + count)
        found.update(_forest_of(ids[part], n[part], s0[part], s1[part], agree))
    return found


def _list_function(keys: list[str], longest: int | None, agree: int):
    """Links of the lists in sorted rows; rows of a list longer than `longest` are handed on, kind 1, without being held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        too_long: tuple | None = None
        sent: set[tuple[int, int]] = set()

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            fresh = list(_forests(table, keys, agree) - sent) if table.num_rows else []
            if len(sent) < 1 << 18:
                sent.update(fresh)
            if fresh:
                ends = [pa.array(x, pa.int64()) for x in zip(*fresh, strict=True)]
                none = [pa.nulls(len(fresh), t) for t in (pa.int32(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(fresh), np.int32)), *ends, *none], names=["kind", "a", "b", "n", "s0", "s1"])

        def hand_on(table: pa.Table) -> Iterator[pa.RecordBatch]:
            kind = pa.chunked_array([pa.array(np.ones(table.num_rows, np.int32))])
            yield from pa.table([kind, *[table[c] for c in _LIST]], names=["kind", "a", "b", "n", "s0", "s1"]).to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            columns = [table[c].to_numpy() for c in keys]
            if too_long is not None:  # its rows go on
                other = np.flatnonzero(np.any([c != k for c, k in zip(columns, too_long, strict=True)], axis=0))
                end = int(other[0]) if len(other) else table.num_rows
                yield from hand_on(table.slice(0, end))
                if end == table.num_rows:
                    continue
                table, too_long = table.slice(end), None
            table = pa.concat_tables([rest, table]) if rest is not None else table
            columns = [table[c].to_numpy() for c in keys]
            last = np.all([c == c[-1] for c in columns], axis=0)
            whole = int(np.argmax(last))  # the last list may go on
            rest = table.slice(whole)
            yield from out(table.slice(0, whole))
            if longest is not None and rest.num_rows > longest:
                too_long = tuple(c[-1] for c in columns)
                yield from hand_on(rest)
                rest = None
        if rest is not None:
            yield from out(rest)

    return run


def neighbours(rows: DataFrame, stored, list_classes: int = LIST_CLASSES, agree: int = _AGREE) -> DataFrame:
    """(a, b) of classes that share a list, fit in size and agree in sketch: a spanning forest of each list.

    A task holds `list_classes` rows of one list at most. Longer lists go through a second round, dealt by class
    into parts of that length; each pair of parts is a list of its own.
    """
    dealt = rows.repartition("token").sortWithinPartitions("token")
    found = stored(dealt.mapInArrow(_list_function(["token"], list_classes, agree), _FOUND))
    long_lists = found.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("class"), "n", "s0", "s1").distinct()
    # a row for each list above list_classes rows: at most one for so many rows
    sizes = F.broadcast(long_lists.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / list_classes).cast("int").alias("parts")))
    rows = long_lists.join(sizes, "token").withColumn("side", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = rows.select(*_LIST, F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    keys = ["token", "i", "j"]
    second = pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_list_function(keys, None, agree), _FOUND)
    return found.where("kind = 0").select("a", "b").unionByName(second.select("a", "b"))


def links(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """(a, b), a spanning forest of the exact links of every cell.

    `cells` (key, class, cell, i, j, side) has one document of each class, in each of its pairs of blocks.
    """
    texts = docs.select(row_key(docs).alias("_key"), docs["text"].alias("text"))
    # most texts are in no cell and stay where they are; the filter's size is fixed
    sieve = F.broadcast(bloom(cells, F.col("key"), FILTER_BLOCKS))
    hash_ = F.col("_key")
    maybe = F.col("_bits").bitwiseAND(mask_of(hash_)) == mask_of(hash_)
    texts = texts.join(sieve, (block_of(hash_, FILTER_BLOCKS) == F.col("_block")) & maybe).select("_key", "text")
    joined = cells.join(texts, F.col("key") == F.col("_key")).select("cell", "i", "j", "side", "class", "text")
    dealt = joined.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        sets: dict[int, tuple[np.ndarray, int]] = {}

        def found() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                ids = list(sets)
                pair = key[1] != key[2]
                got = search([sets[c][0] for c in ids], [sets[c][1] for c in ids] if pair else None)
                if got:
                    ends = [pa.array([ids[link[e]] for link in got], pa.int64()) for e in (0, 1)]
                    yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

        for batch in slices(batches, "text"):
            values, owner = shingle_sets(batch.column("text"))
            sizes, ids = classes(values, owner, batch.num_rows)
            parts = np.split(values, np.cumsum(sizes)[:-1])
            keys = zip(*(batch.column(c).to_pylist() for c in ("cell", "i", "j")), strict=True)
            wanted = batch.column("class").to_pylist()
            for k, this in enumerate(keys):
                if this != key:
                    yield from found()
                    key, sets = this, {}
                # another text may have the same key
                if int(ids[k : k + 1].view(np.int64)[0]) == wanted[k]:
                    sets[wanted[k]] = parts[k], batch.column("side")[k].as_py()
        yield from found()

    return dealt.mapInArrow(run, "a long, b long")


def cell_blocks(members: DataFrame, limit: int = CELL_SHINGLES) -> DataFrame:
    """Deal the classes of large cells (key, class, n, cell) into pairs of blocks: (key, class, cell, i, j, side)."""
    totals = members.groupBy("cell").agg(F.ceil(F.sum("n") / limit).cast("int").alias("blocks"))
    rows = members.join(totals, "cell").withColumn("side", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", "class", "cell", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side")


def join(
    docs: DataFrame, stored, frequent: int = FREQUENT, cell_shingles: int = CELL_SHINGLES, list_classes: int = LIST_CLASSES, agree: int = _AGREE
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    found = _components_of(docs, stored, frequent, cell_shingles, list_classes, agree)
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _components_of(
    docs: DataFrame, stored, frequent: int = FREQUENT, cell_shingles: int = CELL_SHINGLES, list_classes: int = LIST_CLASSES, agree: int = _AGREE
) -> DataFrame:
    """(doc_id, key, n, least, first) of every row, with the smallest id of its component and the key of the first row.

    Rows without id come last; rows under one id are ordered by key. Where n is 0, neither holds. `stored` writes a table and reads it back. The frequent shingles, at most `frequent` of them, are the
    only rows that go to the driver.
    """
    spark = docs.sparkSession
    rows = stored(describe(docs))
    counts = rows.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(frequent).collect()
    tokens = np.array([r["a"] for r in counts], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    rank = (len(tokens) - np.arange(len(tokens)))[order]  # the most frequent comes last
    sent = spark.sparkContext.broadcast((tokens[order], rank))

    described = rows.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("class"), F.col("n").cast("long").alias("n"), "key")
    near = components(neighbours(prefixes(docs, sent), stored, list_classes, agree), stored)
    front = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")
    heads = described.groupBy("class").agg(F.min(front).alias("head"), F.first("n").alias("n"))
    members = near.join(heads, F.col("node") == F.col("class")).select("head.key", "class", "n", F.col("root").alias("cell"))
    cells = stored(cell_blocks(stored(members), cell_shingles))
    linked = components(links(docs, cells), stored)

    # one row per class; joined to the documents by plain shuffles, in which Spark splits a class of many copies
    homes = heads.join(linked, F.col("class") == F.col("node"), "left").withColumn("home", F.coalesce("root", "class"))
    least = homes.groupBy(F.col("home").alias("_home")).agg(F.min("head").alias("front"))
    names = homes.join(least, F.col("home") == F.col("_home")).select(
        F.col("class").alias("_class"), F.col("front.doc_id").alias("least"), F.col("front.key").alias("first")
    )
    return described.join(stored(names), F.col("class") == F.col("_class")).select("doc_id", "key", "n", "least", "first")


def representatives(docs: DataFrame, stored) -> DataFrame:
    """One row of each component, that with the smallest id, with all columns.

    Each row is decided by itself: rows without id, or different texts under one id, go only if another row
    stands for their component. Without ids, or under one id, the smallest key stands. Of rows alike in id and
    text one stays. Only rows that may have to go are shuffled: a filter of fixed size, of the keys that are
    dropped or repeated, lets the others through where they lie.
    """
    found = stored(_components_of(docs, stored))
    stays = (F.col("n") == 0) | (F.col("key") == F.col("first"))
    named = found.groupBy(F.col("key").alias("_key")).agg(F.min(stays).alias("_stays"), F.count(F.lit(1)).alias("_rows"))
    special = stored(named.where("not _stays or _rows > 1").select("_key", "_stays"))
    sieve = F.broadcast(bloom(special, F.col("_key"), FILTER_BLOCKS))
    packed = docs.select(row_key(docs).alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    hash_ = F.col("key")
    marked = packed.join(sieve, block_of(hash_, FILTER_BLOCKS) == F.col("_block"), "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(mask_of(hash_)) == mask_of(hash_), F.lit(False))
    sure = marked.where(~maybe).select("key", "row")
    # repeated rows go before the shuffle, so that many of them under one key do not meet
    open_ = marked.where(maybe).select("key", "row").dropDuplicates(["key"]).join(special, F.col("key") == F.col("_key"), "left")
    kept = open_.where("_stays is null or _stays").select("key", "row")
    return sure.unionByName(kept).select("row.*")
