import random

import numpy as np

from headwise.llm import quality
from headwise.llm.queries import QUERIES


def texts(n, seed):
    random_ = random.Random(seed)
    out = []
    for _ in range(n):
        words = ["".join(random_.choice("abcdeilnorst") for _ in range(random_.randint(2, 9))) for _ in range(random_.randint(5, 80))]
        good = random_.random() < 0.8
        out.append((" ".join(words) if good else " ".join(w.upper() + "!!" for w in words), int(good)))
    return out


def test_classifier():
    learned, other = texts(400, 1), texts(200, 2)
    model = quality.train(np.stack([quality.features(t) for t, _ in learned]), np.array([g for _, g in learned]))
    odds = model.evidence([t for t, _ in other])
    assert np.mean((odds > 0) == np.array([g for _, g in other])) > 0.98
    assert model.evidence([""])[0] == 0.0


def test_sparse_sites_shrink_to_their_host(spark):
    rows, labels = [], []
    for i in range(600):
        host = i % 3
        rows.append((i, None, f"h{host}", "a", 1.0))
        labels.append((i, int((i // 3) % 10 < (9, 5, 1)[host])))
    rows += [(1000, None, "h0", "rare", 1.0), (1001, None, "new", "x", 1.0), (None, "", None, None, 1.0), (1002, "t", "h2", "rare", 1.0), (1002, "t", "h2", "rare", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, quality double")
    known = spark.createDataFrame([*labels, (5000, None), (None, 1)], "doc_id long, quality int")
    none = quality.Classifier(None, np.zeros(quality.FEATURES), np.ones(quality.FEATURES), 0.0, 0.5)
    got = quality.posterior(docs, known, classifier=none).collect()
    assert len(got) == len(rows) and docs.columns[:4] == list(got[0].asDict())[:4]
    rate = {(r.source, r.lang): r.site_rate for r in got}
    assert rate["h0", "a"] > 0.75 and rate["h2", "a"] < 0.25 and abs(rate["h1", "a"] - 0.5) < 0.1
    assert rate["h0", "rare"] > 0.6 and rate["h2", "rare"] < 0.4 and abs(rate["new", "x"] - 0.5) < 0.1 and abs(rate[None, None] - 0.5) < 0.1
    assert all(abs(r.quality - r.site_rate) < 1e-9 for r in got)
    assert quality.posterior(docs.limit(0), known).count() == 0
    assert quality.posterior(docs, known.limit(0)).count() == len(rows)


def test_query(spark):
    root = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op7_site_quality"](spark, root).collect()}
    assert len(got) == spark.read.parquet(f"{root}/documents.parquet").count()
    labels = [r for r in spark.read.parquet(f"{root}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].keep == r.quality for r in labels]) > 0.93
