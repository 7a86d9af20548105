import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from headwise.llm import line_index
from headwise.llm.line_index import Cuckoo, LineIndex
from headwise.llm.queries import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def key_of(line):
    key = line.strip(" \t\n\v\f\r").translate(LOWER)
    return key if len(key) >= 20 else None


def plain(docs, common=3):
    """The contract: doc_id, lines, dropped lines and digest of each row."""
    of = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            of[key_of(line)].add((doc_id is not None, doc_id or 0))
    largest = {k: max(d) for k, d in of.items() if k and len(d) >= common}
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if largest.get(key_of(x), (doc_id is not None, doc_id or 0)) == (doc_id is not None, doc_id or 0)]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    found = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in df.collect()]
    return sorted(found, key=repr)


def state(index):
    """Counts, references, documents, and what the filters answer for every key."""
    counts = {(r.k1, r.k2): (r.n, r.largest) for r in index.counts.collect()}
    fill = {r.shard: int((np.frombuffer(r.data, "<u2") != 0).sum()) for r in index.filters.collect()}
    return counts, sorted(map(tuple, index.refs.select("doc", "k1", "k2").collect())), sorted(r.doc for r in index.docs.collect()), {s: n for s, n in fill.items() if n}


def test_filter_adds_finds_and_removes():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64)
    f = Cuckoo(keys=2000)  # three quarters of its 4,096 places
    f.add(keys)
    assert f.has(keys).all() and (f.table != 0).sum() == 3000
    others = rng.integers(-(1 << 63), 1 << 63, 20_000, dtype=np.int64)
    assert f.has(others).mean() < 0.005
    f = Cuckoo(f.data())
    f.remove(keys[:1500])
    assert f.has(keys[1500:]).all() and f.has(keys[:1500]).mean() < 0.005
    f.remove(keys[1500:])
    assert not f.table.any()
    same = np.repeat(keys[:1], 2 * line_index.SLOTS)  # as many equal fingerprints as two buckets hold
    f.add(same)
    f.remove(same[:3])
    assert f.has(same[:1]).all() and (f.table != 0).sum() == 5
    with pytest.raises(KeyError):
        f.remove(same)
    with pytest.raises(OverflowError):
        Cuckoo(keys=16).add(keys[:80])


def corpus():
    random_ = random.Random(3)
    common = [f"  Line number {i} that many documents HOLD é\t" for i in range(12)]
    docs = []
    for i in range(160):
        lines = [random_.choice(common) for _ in range(random_.randint(0, 5))] + [f"only in document {i} and in no other", "short", ""]
        random_.shuffle(lines)
        docs.append((i, "\n".join(([common[0].upper().replace("É", "é")] if i % 3 == 0 else []) + lines)))
    return docs


def test_insertions_and_deletions_are_reversible(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    empty = LineIndex.empty(spark, capacity=64)
    first = empty.insert(line_index.holders(df.where("doc_id < 90")))
    both = first.insert(line_index.holders(df.where("doc_id >= 70")))  # 20 documents it has already
    whole = empty.insert(line_index.holders(df))
    assert state(both)[:3] == state(whole)[:3] and both.shards >= 2 and first.shards < both.shards
    back = both.delete(df.where("doc_id >= 90").select("doc_id"))
    again = LineIndex.empty(spark, capacity=64).insert(line_index.holders(df.where("doc_id < 90")))
    assert state(back)[:3] == state(again)[:3]
    counts = state(back)[0]
    assert sum(state(back)[3].values()) == len(counts)  # one fingerprint for each key that is left
    assert state(back.delete(df.select("doc_id"))) == ({}, [], [], {})
    left = spark.createDataFrame([d for d in docs if d[0] % 7], "doc_id long, text string")
    shown = line_index.without_dropped(left, both.delete(df.where("doc_id % 7 = 0")).dropped())
    assert rows_of(shown) == plain([d for d in docs if d[0] % 7])


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    docs = corpus() + [(None, None), (None, "Line number 3 that many documents HOLD é"), (500, ""), (3, "another row of document three\nline number 4 that many documents hold é")]
    docs += [(4, corpus()[4][1]), (-5, "line number 5 that many documents hold é"), (600, "a very long line " * 9000 + "\n" * 5000), (601, "\r\n" * 3)]
    docs += [(700 + i, "ünïcödé çhàrs nïnétéé" if i % 2 else "ünïcödé çhàrs nïnét") for i in range(6)]
    df = spark.createDataFrame([(a, b, 1, "x", 2) for a, b in docs], "doc_id long, text string, doc long, k1 string, n_lines int").repartition(6)
    got = line_index.dedup(df)
    assert got.columns == ["doc_id", "text", "doc", "k1", "n_lines", "n_dropped"]
    assert rows_of(got) == plain(docs)
    assert rows_of(line_index.dedup(df, batches=3, common=2)) == plain(docs, 2)
    assert line_index.dedup(df.limit(0)).count() == 0


def test_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op12_line_dedup"](spark, small).collect()]
    assert sorted(got, key=repr) == plain(docs) and sum(r[2] for r in got) > 0
