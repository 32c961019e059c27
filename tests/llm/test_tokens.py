import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docspark.llm import packing, tokencount
from docspark.session import stage
from tests.llm.texts import corpus

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
COUNTER = tokencount.Counter(MODEL)
ENCODER = packing.Encoder(BYTES)
TOKENIZER = Tokenizer.from_file(BYTES)
ODD = [
    "", " ", "  ", "a  b", "a\tb\nc  ", "<s> </s> <unk> x", "▁a ▁▁", "日本𝔘", "\n\n a\n", "a  \n  b", "<0x0A>", " " * 40 + "x",
    "<|endoftext|>", "a <|endoftext|> b", "a\u00a0b c", "a \u3000 b", "it's we'll 'S", "x\r\n y", " a", "a ", "\x1c a\x85 b",
]


def test_counts_equal_the_library_on_odd_texts():
    assert [COUNTER.count(t) for t in ODD] == [len(LIBRARY.encode(t)) for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t▁abcdethe<s>é日𝔘.,01", max_size=60))
def test_counts_equal_the_library(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\r\u00a0\u3000'sabcthe<|endoftext|>é日.,01", max_size=60))
def test_ids_equal_the_library(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library_on_odd_texts():
    got = [np.frombuffer(b, "<u4").tolist() for b in ENCODER.encode(ODD)]
    assert got == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in ODD]


def test_counts_of_a_table(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: tuple(r)[1:] for r in tokencount.counts(docs, MODEL, limit=200).collect()}
    want = {i: (len((t or "").encode()), n := len(LIBRARY.encode(t or "")), n > 200) for i, t in texts.items()}
    assert got == want
    assert tokencount.counts(docs.limit(0), MODEL).count() == 0


def check_packing(rows, texts, capacity):
    """Every token in one piece, every sequence gapless and within the capacity; returns sequences and tokens."""
    ids = {i: [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    placed, per_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
        per_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for i, parts in per_doc.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts)))
        assert all(n == capacity for _, _, n in parts[1:]) and sum(n for _, _, n in parts) == len(ids[i])
        assert len(parts) == -(-len(ids[i]) // capacity)
    assert set(per_doc) == set(texts)
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(placed), sum(map(len, ids.values()))


def test_packing_of_a_table(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, length int")
    cut = stage(packing.pieces(docs, BYTES, 512))
    sequences, tokens = check_packing(packing.pack(cut, 512).collect(), texts, 512)
    assert sequences <= tokens // 512 + 6
    assert packing.pack(cut.limit(0), 512).count() == 0


def test_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(7, "some words here")] * 5 + [(None, None)] * 2, "doc_id long, text string")
    rows = packing.pack(stage(packing.pieces(docs, BYTES, 16)), 16).collect()
    assert len(rows) == 7 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 7


def test_pieces_with_ids(spark):
    docs = spark.createDataFrame([(1, "some words here, and more of them")], "doc_id long, text string")
    rows = sorted(packing.pieces(docs, BYTES, 4, keep_ids=True).collect(), key=lambda r: r["piece"])
    assert [i for r in rows for i in r["ids"]] == [*TOKENIZER.encode("some words here, and more of them").ids, 0]


def test_plan_uses_every_piece_once():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice((8, 50, 300))
        counts = Counter({rng.randrange(1, capacity + 1): rng.choice((1, 2, 5, 1000)) for _ in range(rng.randrange(0, 40))})
        plan = packing.Plan(counts, capacity)
        used = Counter()
        for lengths, times in plan.batches:
            assert sum(lengths) <= capacity and times > 0
            for n in lengths:
                used[n] += times
        assert used == counts
        edges = defaultdict(list)
        for n, first, end, _, _ in plan.intervals():
            edges[n].append((first, end))
        for n, spans in edges.items():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] == counts[n]
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_exact_complements_fill_sequences():
    plan = packing.Plan({60: 10, 40: 4, 25: 6, 15: 6, 10: 6, 20: 3}, 100)
    assert sum(times for _, times in plan.batches) == 12  # ten 60s filled by one or two others, and the rest
    assert ((60, 40), 4) in plan.batches


def test_plan_does_not_grow_with_the_data():
    counts = {n: 1 + (n * 7919) % 50 for n in range(1, 2049)}
    small = packing.Plan(counts, 2048)
    large = packing.Plan({n: c * 10**6 for n, c in counts.items()}, 2048)
    assert len(large.batches) < 3 * len(small.batches) + 100


def test_index_of_sums_finds_every_exact_fill():
    """Against all combinations of up to three lengths, while counts fall."""
    rng = random.Random(11)
    for _ in range(30):
        capacity = rng.randrange(8, 30)
        left = Counter({n: rng.randrange(1, 4) for n in rng.sample(range(1, capacity), rng.randrange(1, 7))})
        sums = packing.Sums(left, capacity)
        while any(left.values()):
            for gap in range(1, capacity):
                for held in ((), (rng.choice([n for n in left if left[n]]),)):
                    free = left - Counter(held)
                    fills = [c for k in (1, 2, 3) for c in combinations_with_replacement(sorted(free), k) if sum(c) == gap and Counter(c) <= free]
                    found = sums.find(gap, held)
                    assert bool(found) == bool(fills)
                    if found:
                        assert sum(found) == gap and Counter(found) <= free and len(found) == len(fills[0])
            left[rng.choice([n for n in left if left[n]])] -= 1


def fewest(pieces, capacity):
    """The least number of sequences, by trying all partitions."""
    best = [len(pieces)]

    def place(i, loads):
        if len(loads) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(loads)
            return
        for j in range(len(loads)):
            if loads[j] + pieces[i] <= capacity and loads[j] not in loads[:j]:
                place(i + 1, [*loads[:j], loads[j] + pieces[i], *loads[j + 1 :]])
        place(i + 1, [*loads, pieces[i]])

    place(0, [])
    return best[0]


def test_plan_against_all_partitions():
    rng = random.Random(12)
    exact = 0
    for _ in range(60):
        capacity = rng.randrange(6, 25)
        pieces = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))), reverse=True)
        plan = packing.Plan(Counter(pieces), capacity)
        used = [x for lengths, times in plan.batches for _ in range(times) for x in lengths]
        assert sorted(used, reverse=True) == pieces and all(sum(lengths) <= capacity for lengths, _ in plan.batches)
        sequences = sum(times for _, times in plan.batches)
        assert sequences <= fewest(pieces, capacity) + 1
        exact += sequences == fewest(pieces, capacity)
    assert exact >= 55


def test_words_between_single_blanks_are_told_without_looking_at_every_place():
    for text in ("a", "a b\nc", "é 漢字"):
        assert packing.plain(text)
    for text in (" ", " a", "a\n", "a  b", "a \nb", "a\tb", "a\x1cb", " a", "a b", "a\r\nb", "\x85"):
        assert not packing.plain(text)
