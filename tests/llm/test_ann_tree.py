from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from headwise.llm import ann_tree
from headwise.llm.queries import QUERIES


def exact(vectors, queries, k):
    ids = np.array(sorted(vectors))
    m = np.array([vectors[i] for i in ids], dtype=np.float64)
    out = {}
    for q in queries:
        s = m @ np.array(vectors[q], dtype=np.float64)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_query_recall_against_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    vectors = {r.vec_id: r.embedding for r in rows}
    want = exact(vectors, [i for i in vectors if i % 20 == 0], 20)
    got = defaultdict(list)
    for r in sorted(QUERIES["op6_nearest_neighbours"](spark, small).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({f[1] for f in found} & {w[0] for w in want[q]})
        for _, i, s in found:
            assert abs(s - np.dot(np.array(vectors[q], float), np.array(vectors[i], float))) < 1e-12
    assert hits / (20 * len(want)) >= 0.9


def test_hot_vector_ties_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(300)] + [(i, rng.normal(size=3).tolist()) for i in range(300, 500)]
    bad = [(1000, None), (1001, [0.0, 0.0, 0.0]), (1002, [1.0, None, 2.0]), (1003, [float("nan"), 1.0, 1.0]), (1004, [float("inf"), 1.0, 0.0]), (1005, [9.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<double>, leaf int")
    got = ann_tree.search(df, F.col("vec_id") % 50 == 0, k=5, rows_per_key=16, target=1.0)
    want = exact(dict(rows), [i for i, _ in rows if i % 50 == 0], 5)
    found = defaultdict(list)
    for r in got.orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    assert found == {q: [i for i, _ in w] for q, w in want.items()}


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann_tree.search(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2.0)]
    assert ann_tree.search(df.limit(0), F.lit(True)).count() == 0


def clustered(n, d, centres, seed):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(centres, d))[rng.integers(centres, size=n)] + 0.3 * rng.normal(size=(n, d))
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def test_recall_holds_on_all_rows_and_clusters_are_pruned():
    sample = clustered(4000, 16, 50, 2)
    tree, visits = ann_tree.choose(sample, 4000, 10, 0.95, 10, leaves=64)
    asked = sample[:0:-7]
    hits = wanted = 0
    of = tree.assign(sample)
    for q in asked:
        score = sample @ q
        best = np.argsort(-score)[1:11]
        hits += np.isin(of[best], tree.ordered_leaves(q, visits)).sum()
        wanted += len(best)
    assert hits / wanted >= 0.93
    assert visits < tree.leaves / 2  # the tree prunes where vectors form clusters


def test_leaves_follow_the_rows():
    sample = clustered(4000, 16, 50, 3)
    small, _ = ann_tree.choose(sample, 4000, 10, 0.95, 200)
    large, _ = ann_tree.choose(sample, 4_000_000_000, 10, 0.95, 200)
    assert small.leaves < large.leaves <= len(sample) // 8


def test_calibrated_visits_are_the_fewest_that_reach_the_target():
    sample = clustered(1000, 8, 20, 4)
    tree = ann_tree.fit(sample[200:], 32)
    held = np.arange(200)

    def recall(visits):
        of, hits = tree.assign(sample), 0
        for q in held:
            score = sample @ sample[q]
            score[q] = -np.inf
            hits += np.isin(of[np.argsort(-score)[:10]], tree.ordered_leaves(sample[q], visits)).sum()
        return hits / (10 * len(held))

    visits = ann_tree.calibrate(tree, sample, held, 10, 0.9)
    assert recall(visits) >= 0.9 and (visits == 1 or recall(visits - 1) < 0.9)


def test_recall_on_clusters_against_brute_force(spark):
    vectors = dict(enumerate(clustered(3000, 16, 40, 5).tolist()))
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    want = exact(vectors, [i for i in vectors if i % 20 == 0], 20)
    found = defaultdict(set)
    for r in ann_tree.search(df, F.col("vec_id") % 20 == 0, sample_rows=1500, visit_cost=5).collect():
        found[r.query_id].add(r.vec_id)
    assert sum(len(found[q] & {i for i, _ in w}) for q, w in want.items()) / (20 * len(want)) >= 0.9
