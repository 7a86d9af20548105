import zlib
from collections import Counter, defaultdict

import numpy as np

from headwise.llm import sharding
from headwise.llm.queries import QUERIES


def checked(rows, texts, shards):
    counts, slots = Counter(r.shard for r in rows), defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    full = [counts.get(s, 0) for s in range(shards)]
    assert max(full) - min(full) <= 1 and sum(full) == len(texts)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)


def test_matrix_sums_and_law():
    m = sharding.communication_matrix([5, 0, 7], [4, 4, 4], 1)
    assert m.sum(1).tolist() == [5, 0, 7] and m.sum(0).tolist() == [4, 4, 4]
    mean = np.mean([sharding.communication_matrix([6, 6], [3, 9], s)[0] for s in range(400)], axis=0)
    assert np.allclose(mean, [1.5, 4.5], atol=0.15)


def test_counts_above_the_library_follow_the_same_law(monkeypatch):
    m = sharding.communication_matrix([3 * 10**9, 5 * 10**9, 7], [2 * 10**9 + 7, 6 * 10**9], 1)
    assert m.sum(1).tolist() == [3 * 10**9, 5 * 10**9, 7] and m.sum(0).tolist() == [2 * 10**9 + 7, 6 * 10**9] and (m >= 0).all()
    spread = (3e9 * 5e9 / 8e9 * 0.25 * 0.75) ** 0.5
    assert abs(int(m[0, 0]) - 3e9 * 0.25) < 6 * spread
    draw = np.random.default_rng(2)
    want = [int(draw.hypergeometric(700, 500, 400)) for _ in range(20_000)]
    monkeypatch.setattr(sharding, "LIBRARY", 50)
    got = [sharding.hypergeometric(draw, 700, 500, 400) for _ in range(20_000)]
    assert abs(np.mean(got) - np.mean(want)) < 0.4 and abs(np.std(got) - np.std(want)) < 0.3
    colors = np.array([60, 0, 30, 10])
    many = np.array([sharding.multivariate(draw, colors, 20) for _ in range(5_000)])
    assert (many.sum(1) == 20).all() and (many <= colors).all() and np.allclose(many.mean(0), colors / 5, atol=0.15)


def test_small_bins_nulls_and_repeats(spark):
    rows = [(i % 7 if i % 5 else None, "same" if i % 3 else None, i) for i in range(203)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(9)
    checked(sharding.shard(df, shards=4, rows_per_bin=10).collect(), [(a, b) for a, b, _ in rows], 4)
    assert sharding.shard(df.limit(0), shards=4).count() == 0
    two = spark.createDataFrame(rows[:2], df.schema)
    checked(sharding.shard(two, shards=4).collect(), [(a, b) for a, b, _ in rows[:2]], 4)


def test_uniform(spark):
    df = spark.range(40).selectExpr("id as doc_id", "cast(null as string) as text").repartition(3)
    seen = Counter(r.shard for s in range(30) for r in sharding.shard(df, shards=2, seed=s * 7).where("doc_id = 3").collect())
    assert 5 <= seen[0] <= 25


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    checked(QUERIES["op8_exact_shards"](spark, small).collect(), [(r.doc_id, r.text) for r in docs], 40)
