import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from headwise.llm import vector_codes
from headwise.llm.queries import QUERIES


def plain(rows, parts=4, entries=256, rounds=4):
    """The codes by plain integer distances: vec_id, code, error, label error, and the digest."""
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    length = -(-max((len(v) for _, _, v in kept), default=0) // parts)
    cut = [[(v + [0] * parts * length)[p * length : (p + 1) * length] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign(p):
        out = []
        for c in cut:
            far = [sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)) for e in books[p]]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c, (e, _) in zip(cut, assign(p), strict=True):
                members.setdefault(e, []).append(c[p])
            for e, of in members.items():
                books[p][e] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    final = [assign(p) for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(final[p][i][1] for p in range(parts)) for i in range(len(kept))]
    by_label = {}
    for (_, lab, _), e in zip(kept, errors, strict=True):
        by_label[lab] = by_label.get(lab, 0) + e
    return [(i, "".join(f"{final[p][k][0]:02x}" for p in range(parts)), errors[k], by_label[lab], digest) for k, (i, lab, _) in enumerate(kept)]


def rows_of(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


def test_transform_keeps_distances_in_sequency_order():
    eye = vector_codes.transform(np.eye(16, dtype=np.int64))
    assert [int((np.diff(row) != 0).sum()) for row in eye.T] == list(range(16))
    rng = np.random.default_rng(3)
    a, b = rng.integers(-900, 900, (2, 40, 11))
    apart = vector_codes.transform(a) - vector_codes.transform(b)
    assert ((apart * apart).sum(1) == 16 * ((a - b) ** 2).sum(1)).all()


def test_nearest_equals_all_distances_with_ties():
    rng = np.random.default_rng(4)
    for m in (1, 3, 16, 20):
        a, b = rng.integers(-3, 4, (200, m)), rng.integers(-3, 4, (60, m))
        far = ((a[:, None] - b[None]) ** 2).sum(2)
        index, error = vector_codes.nearest(vector_codes.transform(a), vector_codes.transform(b))
        assert (index == far.argmin(1)).all() and (error == far.min(1)).all()


def test_nulls_ties_lengths_and_clashing_columns(spark):
    random_ = random.Random(5)
    rows = [(i, [random_.choice([-0.5, 0.25, 0.1]) for _ in range(10)], random_.choice([1, 2, None])) for i in range(400)]
    rows += rows[:150]  # repeated rows
    rows += [(None, [0.5] * 10, 1), (7, [0.3] * 10, 2), (1000, [0.5, 0.5], 3), (1001, [], 3)]
    rows += [(500, None, 1), (501, [0.1, None], 1), (502, [float("nan")] * 10, 1), (503, [float("-inf")] * 10, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, slot long").repartition(5)
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert rows_of(vector_codes.compress(df, entries=16)) == sorted(plain(as_float, entries=16), key=repr)
    few = df.where("vec_id < 3")
    assert rows_of(vector_codes.compress(few)) == sorted(plain([r for r in as_float if r[0] is not None and r[0] < 3]), key=repr)
    assert vector_codes.compress(df.limit(0)).count() == 0
    assert vector_codes.compress(df.where("vec_id in (500, 501)")).count() == 0
    huge = spark.createDataFrame([(1, [1e30], 1), (2, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [(r.vec_id, r.error) for r in vector_codes.compress(huge).collect()] == [(2, 0)]


def test_long_vectors_and_one_hot_vector(spark):
    df = spark.range(700).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(900)), lambda i: F.when(F.col("id") < 300, 0.5).otherwise(F.sin(i * F.col("id")))).alias("embedding"))
    rows = [(r.vec_id, list(r.embedding), None) for r in df.collect()]
    assert rows_of(vector_codes.compress(df, entries=4, rounds=2, label_col=None)) == sorted(plain(rows, entries=4, rounds=2), key=repr)


def test_query(spark, small):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert rows_of(QUERIES["op13_vector_codes"](spark, small)) == sorted(plain(rows), key=repr)
