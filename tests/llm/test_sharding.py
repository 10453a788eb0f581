import random
import zlib
from collections import defaultdict

from evidentia.llm import sharding
from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1000), max_size=60), st.integers(1, 8))
def test_schedule_is_longest_first(sizes, shards):
    placed = sharding.schedule(list(enumerate(sizes)), shards)
    loads = [0] * shards
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        assert loads[placed[i]] == min(loads)
        loads[placed[i]] += sizes[i]


def rows_of(seed=1, n=3000):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice("abcü ") for _ in range(int(r.expovariate(1 / 80))))) for i in range(n)]
    for i in range(0, n, 3):
        rows[i] = (i, rows[i % 300][1])
    return rows + [(n, None), (n + 1, ""), (None, "no id"), (5, rows[5][1]), (n + 2, "long " * 4000), (n + 3, "hot")] + [(n + 4 + i, "hot") for i in range(500)]


def check(rows, got, shards):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows
    )
    homes, loads, slots = defaultdict(set), [0] * shards, defaultdict(list)
    for r in got:
        homes[r.group_id].add(r.shard)
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(x) == 1 for x in homes.values())
    for x in slots.values():
        assert sorted(x) == list(range(len(x)))
    return loads, homes


def test_shards_are_even_and_groups_stay_together(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, size int, shard string")
    got = sharding.shard(docs, 5).collect()
    loads, homes = check(rows, got, 5)
    assert len(homes) == len({t or "" for _, t in rows})
    assert max(loads) - min(loads) <= 0.002 * sum(loads)
    coarse, _ = check(rows, sharding.shard(docs, 5, fineness=10).collect(), 5)
    assert max(coarse) - min(coarse) <= sum(coarse) / 5 / 10 * 2
    assert sharding.shard(docs.limit(0)).collect() == []


def test_imbalance_against_exact_longest_first(spark):
    """Bundles of small groups cost at most one bundle of balance against one group at a time."""
    import heapq

    rows = rows_of(4, 4000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    loads, _ = check(rows, sharding.shard(docs, 6).collect(), 6)
    groups = defaultdict(int)
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 8
    heap = [0] * 6
    for size in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    assert max(loads) <= max(heap) + sum(loads) / 6 / sharding.FINENESS
