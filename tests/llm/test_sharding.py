import heapq
import random
import zlib
from collections import Counter, defaultdict

from docspark.llm import sharding
from docspark.session import stage
from tests.llm.texts import corpus


def lpt(sizes, shards):
    heap = [(0, i) for i in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, i = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, i))
    return sorted(load for load, _ in heap)


def test_schedule_equals_plain_lpt():
    rng = random.Random(3)
    for _ in range(100):
        sizes = [rng.randrange(1, 50) for _ in range(rng.randrange(0, 400))]
        classes = [(s, n, float(s)) for s, n in Counter(sizes).items()]
        loads = defaultdict(float)
        seen = Counter()
        for label, shard, first, end in sharding.schedule(classes, 5):
            assert seen[label] == first
            seen[label] = end
            loads[shard] += label * (end - first)
        assert seen == Counter(sizes)
        got = sorted([*loads.values(), *[0] * (5 - len(loads))])
        assert got[-1] - got[0] <= max(sizes, default=0) and got[-1] <= lpt(sizes, 5)[-1] + max(sizes, default=0)


def test_schedule_of_very_many_groups_is_short():
    quotas = sharding.schedule([(100, 10**9, 100.0), (7, 10**10, 7.0), (5000, 3, 5000.0)], 24)
    loads = defaultdict(float)
    for label, shard, first, end in quotas:
        loads[shard] += label * (end - first)
    assert len(quotas) <= 72 and max(loads.values()) - min(loads.values()) <= 100


def test_shards_of_a_table(spark):
    texts = corpus(n=300)
    rows = [(i, t, "x", 1) for i, t in texts.items()] + [(3, texts[3], "x", 1)] * 7 + [(None, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, shard int")
    got = sharding.shard(docs, stage, shards=4).collect()
    assert len(got) == len(rows)
    slots, homes, loads = defaultdict(list), defaultdict(set), Counter()
    known = texts | {None: None}
    for r in got:
        text = known[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"]) == (len(text.encode()) + 8, zlib.crc32(text.encode()))
        slots[r["shard"]].append(r["slot"])
        homes[text].add(r["shard"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    assert max(loads.values()) - min(loads.values()) < 200
    assert sorted(map(str, sharding.shard(docs, stage, shards=4).collect())) == sorted(map(str, got))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(docs, stage).count() == 0
