import hashlib
import random

from headwise.llm import merkle
from headwise.llm.queries import QUERIES


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), merkle.fingerprint(text), merkle.fingerprint(changed)))
    return out


def test_likeness_and_location():
    random_ = random.Random(1)
    lines = ["".join(random_.choice("abcdef ,é") for _ in range(60)) + ". end." for _ in range(80)]
    text = "\n".join(lines)
    mark = merkle.fingerprint(text)
    assert merkle.likeness(mark, mark) == 1.0 and merkle.changed(mark, mark) == []
    one = list(lines)
    one[40] = "something else."
    other = merkle.fingerprint("\n".join(one))
    assert 0.93 < merkle.likeness(mark, other) < 1.0
    assert merkle.likeness(mark, other) == merkle.likeness(other, mark)
    start = len("\n".join(lines[:40]).encode()) + 1
    (a, b), *more = merkle.changed(mark, other)
    assert a <= start + 1 and b >= start + len(lines[40].encode()) - 1 and b - a < 600 and not more
    half = merkle.fingerprint(merkle.edited(text, "z" * 10_000))
    assert 0.4 < merkle.likeness(mark, half) < 0.6
    assert merkle.likeness(mark, merkle.fingerprint("")) == 0.0 and merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("")) == 1.0
    assert sum(n for _, leaves in merkle.tree("é" * 5000)[1] for _, n in leaves) == 10_000


def test_edge_rows(spark):
    rows = [(5, "five. six."), (None, "none."), (1, None), (2, "two"), (2, "two"), (2, "another two"), (9, "word " * 20_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, range int").repartition(3)
    got = [tuple(r)[:5] for r in merkle.compare_with_next(df).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)
    one = merkle.compare_with_next(spark.createDataFrame([(7, "alone here")], "doc_id long, text string")).collect()
    assert [tuple(r)[:5] for r in one] == expected([(7, "alone here")]) and one[0].near_next == 1.0
    assert merkle.compare_with_next(df.limit(0)).count() == 0


def test_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = QUERIES["op5_merkle_fingerprints"](spark, small).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(expected(docs))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
