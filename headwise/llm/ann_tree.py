"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample that is fixed by a hash (``sample_rows``); every vector is indexed. A query walks
the tree with a priority queue of nodes, the largest inner product with a node's centre first, and visits leaves until
the calibrated number: the smallest for which queries of the sample that the tree was not fitted on find ``target`` of
their neighbours in it. The number of leaves is the one that costs a query least (``choose``), so it follows the rows.
Vectors of a visited leaf are scored exactly, in double precision. A leaf of many vectors is dealt over keys of at most
``rows_per_key``; a key's queries are streamed, so neither is bounded by a task's memory.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors of another
length than most; equal scores go to the smaller id; repeated ids are candidates each for itself, and only rows of the
query's own id are left out; fewer candidates than k give all of them; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwise.llm.common import written


@dataclass
class Tree:
    """Centres of all nodes; a node's children are a run of nodes, a leaf has none and a number."""

    centres: np.ndarray
    children: list[tuple[int, int]]
    leaf: list[int]
    leaves: int

    def ordered_leaves(self, query: np.ndarray, limit: int) -> list[int]:
        """Leaves in best-bin-first order."""
        near = self.centres @ query
        queue, out = [(-near[0], 0)], []
        while queue and len(out) < limit:
            _, node = heapq.heappop(queue)
            first, last = self.children[node]
            if first == last:
                out.append(self.leaf[node])
            for child in range(first, last):
                heapq.heappush(queue, (-near[child], child))
        return out

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest centre at each level."""
        node = np.zeros(len(rows), dtype=np.int64)
        for at in range(len(self.children)):
            first, last = self.children[at]
            here = np.nonzero(node == at)[0] if first < last else ()
            if len(here):
                c = self.centres[first:last]
                node[here] = first + np.argmax(rows[here] @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
        return np.array(self.leaf)[node]


def k_means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the centre of each row; centres without rows are dropped."""
    centres = rows[rng.choice(len(rows), size=min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        of = np.argmax(rows @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)
        used, of = np.unique(of, return_inverse=True)
        sums = np.zeros((len(used), rows.shape[1]))
        np.add.at(sums, of, rows)
        centres = sums / np.bincount(of)[:, None]
    of = np.argmax(rows @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)
    return centres, of


def fit(sample: np.ndarray, leaves: int, seed: int = 6) -> Tree:
    """A tree of two levels of k-means with about this many leaves."""
    rng = np.random.default_rng(seed)
    branches = max(1, round(leaves**0.5))
    top, of = k_means(sample, branches, rng)
    centres, children, level = [sample.mean(axis=0)[None, :], top], [(1, 1 + len(top))], []
    at = 1 + len(top)
    for i in range(len(top)):
        own = sample[of == i]
        share = max(1, round(leaves * len(own) / len(sample)))
        below, _ = k_means(own, share, rng) if len(own) else (top[i : i + 1], None)
        centres.append(below)
        level.append((at, at + len(below)))
        at += len(below)
    children += level + [(0, 0)] * (at - 1 - len(top))
    first_leaf = 1 + len(top)
    return Tree(np.concatenate(centres), children, [max(0, n - first_leaf) for n in range(at)], at - first_leaf)


def calibrate(tree: Tree, sample: np.ndarray, queries: np.ndarray, k: int, target: float) -> int:
    """Leaves to visit, widened until these rows of the sample find this share of their exact neighbours in it.

    ``queries`` holds row numbers; the tree should not have been fitted on them, else the share found comes out too high.
    """
    n = len(sample)
    if n <= 1 or not len(queries):
        return tree.leaves
    of, found = tree.assign(sample), np.zeros(tree.leaves)
    for q in queries:
        score = sample @ sample[q]
        score[q] = -np.inf
        best = np.argpartition(-score, min(k, n - 1) - 1)[: min(k, n - 1)]
        rank = np.empty(tree.leaves, dtype=np.int64)
        rank[tree.ordered_leaves(sample[q], tree.leaves)] = np.arange(tree.leaves)
        found += np.bincount(rank[of[best]], minlength=tree.leaves)
    share = found.cumsum() / found.sum()
    return min(tree.leaves, int(np.searchsorted(share, target)) + 1)


def choose(sample: np.ndarray, rows: int, k: int, target: float, visit_cost: int, leaves: int | None = None, held_out: int = 300) -> tuple[Tree, int]:
    """The tree and the leaves to visit that cost a query of this table least, as measured on held-out queries.

    A query costs one for each row of the leaves it visits and ``visit_cost`` for each visit, which ships the query to a
    leaf. Few leaves mean few visits of many rows, so larger tables get more leaves; a tree has at most one leaf for
    eight sampled rows. ``leaves`` fixes their number.
    """
    held = np.arange(min(held_out, len(sample) // 4))
    fitted = sample[len(held) :]
    most = max(1, len(fitted) // 8)
    wanted = [min(leaves, most)] if leaves else sorted({min(16 * 4**i, most) for i in range(12)})
    best = None
    for number in wanted:
        tree = fit(fitted, number)
        visits = calibrate(tree, sample, held, k, target)
        cost = visits * (rows / tree.leaves + visit_cost)
        if best is None or cost < best[0]:
            best = (cost, tree, visits)
        elif cost > 2 * best[0]:
            break
    return best[1], best[2]


def _usable(vector: Column) -> Column:
    """Not null, not zero, all components present and finite."""
    finite = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0.0), F.lit(False))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dimension)


def search(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = 20_000,
    leaves: int | None = None,
    rows_per_key: int = 4096,
    target: float = 0.96,
    visit_cost: int = 200,
) -> DataFrame:
    """The k nearest found for each row that ``is_query`` selects: query_id, rank, vec_id, score.

    A query's best of each visited leaf are ranked together, so the rows ranked grow with the queries alone.
    """
    spark = df.sparkSession
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    usable = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    usable = usable.where(_usable(F.col("vector")) & F.col("vec_id").isNotNull())
    lengths = usable.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], empty)
    dimension = int(lengths["d"])
    usable = usable.where(F.size("vector") == dimension)
    drawn = usable.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(sample_rows).select("vector").collect()
    sample = np.array([r.vector for r in drawn], dtype=np.float64)
    tree, visits = choose(sample, int(lengths["count"]), k, target, visit_cost, leaves)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            rows = np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), dimension)
            raw = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tree.assign(rows), pa.int32()), raw], names=["vec_id", "asks", "leaf", "raw"])

    indexed = written(usable.mapInArrow(index, "vec_id long, asks boolean, leaf int, raw binary"), "ann-index")
    sizes = {r.leaf: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # one row for each leaf
    first_key, keys = {}, 0
    for leaf in range(tree.leaves):
        parts = -(-sizes.get(leaf, 0) // rows_per_key)
        first_key[leaf] = (keys, parts)
        keys += parts

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, ids = np.asarray(batch.column(2)), np.asarray(batch.column(0))
            first = np.array([first_key[x][0] for x in leaf.tolist()], dtype=np.int64)
            parts = np.array([first_key[x][1] for x in leaf.tolist()], dtype=np.int64)
            dealt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts
            none = pa.array(np.zeros(len(ids), dtype=np.int8))
            yield pa.RecordBatch.from_arrays([pa.array(first + dealt, pa.int32()), none, batch.column(0), batch.column(3)], names=["key", "kind", "id", "raw"])
            asks = batch.filter(batch.column(1))
            for one_id, raw in zip(asks.column(0).to_pylist(), asks.column(3).to_pylist(), strict=True):
                visited = tree.ordered_leaves(np.frombuffer(raw, "<f8"), visits)
                to = [key for x in visited for key in range(first_key[x][0], sum(first_key[x]))]
                m = len(to)
                if m:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to, pa.int32()), pa.array(np.ones(m, dtype=np.int8)), pa.array([one_id] * m, pa.int64()), pa.array([raw] * m, pa.binary())],
                        names=["key", "kind", "id", "raw"],
                    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key, a key's vectors before its queries: the vectors are held, the queries stream by."""
        key, parts = None, []
        vectors, ids = np.empty((0, dimension)), np.empty(0, dtype=np.int64)
        for batch in batches:
            at, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.nonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1]))[0] + 1 if len(at) else []
            for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
                run = batch.slice(a, b - a)
                if a == b:
                    continue
                if kind[a] == 0:
                    if at[a] != key:
                        key, parts = at[a], []
                    parts.append(run)
                    continue
                if at[a] != key:
                    continue
                if parts:
                    vectors = np.concatenate([_matrix(p.column(3), dimension) for p in parts])
                    ids = np.concatenate([np.asarray(p.column(2)) for p in parts])
                    order = np.argsort(ids, kind="stable")
                    vectors, ids, parts = vectors[order], ids[order], []
                yield from _best(run, vectors, ids, k)

    dealt = indexed.mapInArrow(locate, "key int, kind byte, id long, raw binary")
    together = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "kind")
    scored = together.mapInArrow(score, "query_id long, vec_id long, score double")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(asked: pa.RecordBatch, vectors: np.ndarray, ids: np.ndarray, k: int, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The k best of these vectors for each query; ids ascend, so a stable sort gives ties to the smaller."""
    for a in range(0, asked.num_rows, rows):
        some = asked.slice(a, rows)
        q, qid = _matrix(some.column(3), vectors.shape[1]), np.asarray(some.column(2))
        s = np.einsum("qd,vd->qv", q, vectors)  # each pair is summed alike, so equal vectors score equally
        s[qid[:, None] == ids[None, :]] = -np.inf
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(s, top, axis=1)
        row, column = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(ids[top[row, column]]), pa.array(best[row, column])], names=["query_id", "vec_id", "score"])
