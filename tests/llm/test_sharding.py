import random
import zlib
from collections import defaultdict

import numpy as np

from isoreach.llm import sharding
from isoreach.llm.queries import op6_karmarkar_karp


def test_differencing_beats_greedy_dealing():
    rng = random.Random(1)
    for ways in (2, 3, 24):
        sizes = [rng.randint(1, 10**6) for _ in range(400)]
        sums = np.bincount(sharding.karmarkar_karp(sizes, ways), sizes, ways)
        greedy = [0] * ways
        for s in sorted(sizes, reverse=True):
            greedy[greedy.index(min(greedy))] += s
        assert sums.sum() == sum(sizes) and np.ptp(sums) <= max(greedy) - min(greedy)


def test_small_cases():
    assert sharding.karmarkar_karp([], 3).tolist() == []
    assert sorted(np.bincount(sharding.karmarkar_karp([8, 7, 6, 5, 4], 2), [8, 7, 6, 5, 4], 2)) == [14, 16]  # the known outcome of differencing
    assert len(set(sharding.karmarkar_karp([5, 5, 5], 3).tolist())) == 3


def differencing_by_force(sizes, ways):
    """The sums that differencing leaves, with plain lists and a full search for the largest spreads."""
    held = [([s] + [0] * (ways - 1), i) for i, s in enumerate(sizes)]
    serial = len(held)
    while len(held) > 1:
        held.sort(key=lambda v: (-(v[0][0] - v[0][-1]), v[1]))
        (a, _), (b, _) = held[:2]
        held = [*held[2:], (sorted((x + y for x, y in zip(a, reversed(b))), reverse=True), serial)]
        serial += 1
    return held[0][0]


def test_differencing_by_force():
    rng = random.Random(6)
    for _ in range(200):
        ways, sizes = rng.randint(2, 6), [rng.randint(0, 50) for _ in range(rng.randint(1, 25))]
        sums = np.bincount(sharding.karmarkar_karp(sizes, ways), sizes, ways)
        assert sorted(sums.tolist(), reverse=True) == differencing_by_force(sizes, ways)


def check(rows, texts, shards):
    by_text, slots, sums = {}, defaultdict(list), [0] * shards
    for r in rows:
        text = texts[r.doc_id]
        assert r.size == len((text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text or "").encode())
        assert by_text.setdefault(text, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sums


def test_groups_stay_together_and_bytes_are_even(spark, monkeypatch):
    rng = random.Random(2)
    texts = {i: "x" * rng.randint(0, 3000) + str(i % 700) for i in range(1500)} | {1500 + i: "the same text " * 400 for i in range(40)} | {1600: None, 1601: "", 1602: None}
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in texts.items()], "doc_id long, text string, size int, key string")
    plain = check(sharding.balanced_shards(docs, shards=5).collect(), texts, 5)
    monkeypatch.setattr(sharding, "LAST_HEAP", 200)
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 40)
    monkeypatch.setattr(sharding, "CELL_ROWS", 50)
    levels = check(sharding.balanced_shards(docs, shards=5).collect(), texts, 5)
    for sums in (plain, levels):
        assert max(sums) - min(sums) < 0.01 * sum(sums) / 5
    assert sharding.balanced_shards(docs.limit(0), shards=5).collect() == []


def test_a_group_larger_than_a_shard_stands_alone(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LAST_HEAP", 100)
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 100)
    docs = spark.createDataFrame([(i, "hot" * 1000) for i in range(200)] + [(200 + i, f"{i:0300d}") for i in range(1000)], "doc_id long, text string")
    rows = sharding.balanced_shards(docs, shards=4).collect()
    hot = {r.shard for r in rows if r.doc_id < 200}
    assert len(hot) == 1 and all(r.shard not in hot for r in rows if r.doc_id >= 200)


def test_op6_contract(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op6_karmarkar_karp(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs) and {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)
    check(rows, docs, 24)
