import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from headwise.llm import resampling
from headwise.llm.common import by_bytes
from headwise.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, buckets=10_000):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(f.encode()) % buckets for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]


def plain(docs, target, min_words=20, percent=25):
    """The contract, document by document: doc_id, features, weight, score, rank; docs in the order of their rows."""
    s, t = (Counter(f for x in texts for f in features(x)[1]) for texts in ([d[1] for d in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows, may = [], []
    for i, (doc_id, text) in enumerate(docs):
        words, found = features(text)
        weight = sum(gain[f] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None])
        if len(words) >= min_words:
            may.append((-score, doc_id is None, doc_id or 0, i))
    for rank, (*_, i) in enumerate(sorted(may)[: percent * len(may) // 100]):
        rows[i][4] = rank + 1
    return sorted(map(tuple, rows), key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_words_and_checksums_of_a_batch():
    texts = ["", "A-b Zü9 x", "né" * 90 + " tail", " ", "ab", "cd"]
    words = resampling.Words.of(pa.array(["skipped", *texts]).slice(1))
    want = [w for t in texts for w in features(t)[0]]
    assert [words.data[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends, strict=True)] == want
    states = words.first_states()
    assert (states ^ np.uint32(0xFFFFFFFF)).tolist() == [zlib.crc32(w.encode()) for w in want]
    first = words.paired()
    pairs = [f"{a} {b}" for t in texts for a, b in zip(features(t)[0], features(t)[0][1:])]
    assert (words.pair_states(first, states[first]) ^ np.uint32(0xFFFFFFFF)).tolist() == [zlib.crc32(p.encode()) for p in pairs]
    assert resampling.Words.of(pa.array([], pa.string())).paired().tolist() == []


def test_runs_of_bytes_hold_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (0, 5, 30, 0, 0, 9, 1, 0)]})
    runs = list(by_bytes([batch, batch.slice(0, 0)], "text", 10))
    assert [len(t) for r in runs for t in r.column("text").to_pylist()] == [0, 5, 30, 0, 0, 9, 1, 0]
    assert all(r.num_rows == 1 or sum(map(len, r.column("text").to_pylist())) <= 10 for r in runs)


def test_hot_lines_nulls_and_repeats(spark):
    random_ = random.Random(11)
    vocabulary = ["Eau", "été", "the", "of", "9x", "ROOT", "ñ", "a" * 70]
    hot = " ".join(random_.choice(vocabulary) for _ in range(12))
    docs = []
    for i in range(240):
        lines = [" ".join(random_.choice(vocabulary) for _ in range(random_.randint(0, 8))) for _ in range(random_.randint(0, 6))]
        docs.append((i, "\n".join([hot] * (i % 3 == 0) + lines + ["", " - "] * (i % 5 == 0))))
    docs += [(7, docs[7][1]), (300, None), (301, ""), (302, "\n\n"), (None, hot + "\n" + hot), (303, "word " * 20_000 + "\n" + "line\n" * 3_000)]
    target = [hot, None, "the of the été\nROOT root", ""]
    df = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in docs], "doc_id long, text string, row int, line string, weight int").repartition(7)
    to = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    assert rows_of(resampling.resample(df, to)) == plain(docs, target)
    assert rows_of(resampling.resample(df, to.limit(0))) == plain(docs, [])
    assert resampling.resample(df.limit(0), to).count() == 0
    same = spark.createDataFrame([(1, hot + hot)] * 40, "doc_id long, text string")
    assert rows_of(resampling.resample(same, to)) == plain([(1, hot + hot)] * 40, target)


def test_wide_buckets(spark):
    df = spark.createDataFrame([(i, f"w{i % 7} of line\nw{i % 3} next") for i in range(50)], "doc_id long, text string")
    wide = resampling.segment(df, 1 << 18)
    want = Counter(f for r in df.collect() for f in features(r.text, 1 << 18)[1])
    got = wide.histogram()
    assert {int(b): int(got[b]) for b in np.nonzero(got)[0]} == want
    assert wide.lines.count() < df.select(F.explode(F.split("text", "\n"))).count()


def test_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert rows_of(QUERIES["op11_importance_resampling"](spark, small)) == plain(docs, target)
