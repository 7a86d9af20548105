import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from headwise.llm import ngram_join
from headwise.llm.queries import QUERIES


def runs(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    sets = [runs(t) for _, t in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_word = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by_word[x].append(i)
    pairs = {(i, j) for ids in by_word.values() for i in ids for j in ids if i < j}
    empty = [i for i, s in enumerate(sets) if not s]
    pairs |= {(i, j) for i in empty for j in empty if i < j and (rows[i][1] or "") == (rows[j][1] or "")}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if (rows[i][1] or "") == (rows[j][1] or "") or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            links[i] += 1
            links[j] += 1
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)].append(doc_id)
    return sorted(((d, min(ids[find(i)]) if ids[find(i)] else None, links[i]) for i, (d, _) in enumerate(rows)), key=str)


def test_bands_reach_the_recall():
    b, r = ngram_join.bands_and_rows(0.8, 0.995, 256)
    assert b * r <= 256 and 1 - (1 - 0.8**r) ** b >= 0.995


def near_copies(n, seed, words=60):
    random_ = random.Random(seed)
    base = ["".join(random_.choice("abcdefgh") for _ in range(5)) for _ in range(words)]
    out = []
    for _ in range(n):
        one = list(base)
        for _ in range(random_.randint(0, 2)):
            one[random_.randrange(words)] = f"w{random_.randint(0, 99)}"
        out.append(" ".join(one))
    return out


def test_hot_group_by_tiles_equals_brute_force(spark):
    texts = near_copies(130, 1) + near_copies(3, 2) + ["the same text of five words"] * 40 + ["", None, " ", "one two", "one two", "one two three"]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3]), (4, "another text with id four here now")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, k int").repartition(4)
    want = expected(rows)
    for block in (1024, 16):
        got = sorted((tuple(r) for r in ngram_join.join(df, block=block).collect()), key=str)
        same = np.mean([a == b for a, b in zip(got, want, strict=True)])
        assert [g[:2] for g in got] == [w[:2] for w in want] and same > 0.95, same  # a pair at the threshold can miss all bands
    assert ngram_join.join(df.limit(0)).count() == 0


def test_texts_that_share_a_hash_are_not_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "text_key", lambda text: F.xxhash64(text) % 5)
    texts = near_copies(40, 4) + near_copies(30, 5) + ["alone with these few words", "", None] * 2
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in ngram_join.join(df).collect()), key=str) == expected(rows)
    kept = {r.doc_id for r in ngram_join.one_of_each_class(df).collect()}
    assert kept == {c for _, c, _ in expected(rows)}


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op4_ngram_jaccard_join"](spark, small).collect()), key=str)
    assert got == expected(rows)
