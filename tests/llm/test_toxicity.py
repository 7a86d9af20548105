import copy
import random
import zlib

import numpy as np

from headwise.llm import toxicity
from headwise.llm.queries import QUERIES


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh()
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, y = rng.normal(size=(5, 7, toxicity.INPUTS)), np.array([0, 1, 1, 0, 1.0])

    def loss(n):
        p = n.score(x)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    slopes = net.gradients(x, y, np.ones(5))
    for k, w in net.weights.items():
        at = tuple(rng.integers(s) for s in w.shape)
        up, down = copy.deepcopy(net), copy.deepcopy(net)
        up.weights[k][at] += 1e-3
        down.weights[k][at] -= 1e-3
        assert abs(slopes[k][at] - (loss(up) - loss(down)) / 2e-3) < 1e-4


def invented(n, seed):
    random_ = random.Random(seed)
    words = ["".join(random_.choice("abcdeilnorst") for _ in range(random_.randint(2, 9))) for _ in range(400)]
    texts, labels = [], []
    for _ in range(n):
        text = [random_.choice(words) for _ in range(random_.randint(1, 400))]
        toxic = random_.random() < 0.2
        for _ in range(3 * toxic):
            text.insert(random_.randint(0, len(text)), "vilex" + random_.choice(["", "or", "ima", "ent", "ust"]))
        texts.append(" ".join(text))
        labels.append(int(toxic))
    return texts, labels


def test_learns_forms_it_has_not_seen():
    model = toxicity.train(*invented(1200, 1))
    texts, labels = invented(300, 2)
    texts += ["a b c " * 3000 + " vilexism vilexes " + "d e " * 3000]
    labels += [1]
    score = toxicity.Scorer(model).score(texts)
    assert np.mean((score >= 0.3) == np.array(labels)) > 0.97 and score[-1] >= 0.3


def test_windows_cover_every_word():
    scorer = toxicity.Scorer(toxicity.Model())
    sizes = [0, 1, 7, 8, 31, 32, 33, 56, 57, 500]
    inputs = [np.full((n, toxicity.INPUTS), i + 1, np.float32) * np.arange(1, n + 1)[:, None] for i, n in enumerate(sizes)]
    windows, firsts = scorer.windows(inputs)
    ends = [*firsts[1:], len(windows)]
    for x, a, b in zip(inputs, firsts, ends, strict=True):
        assert b > a and {*x[:, 0].tolist()} <= {*windows[a:b, :, 0].ravel().tolist()}
        assert {*windows[a:b, :, 0].ravel().tolist()} <= {0.0, *x[:, 0].tolist()}


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "x y", 0.5), (2, "", 0.5)], "doc_id long, text string, label_is double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.network is None
    got = toxicity.score(docs, model).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1
    model = toxicity.train(*invented(300, 3))
    assert toxicity.score(docs, model).count() == 4 and toxicity.score(docs.limit(0), model).count() == 0


def test_query_on_held_out_rows(spark):
    root = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, root).collect()}
    assert len(got) == spark.read.parquet(f"{root}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    labels = [r for r in spark.read.parquet(f"{root}/labels.parquet").collect() if got[r.doc_id].held_out]
    right = np.mean([got[r.doc_id].predicted == r.toxic for r in labels])
    toxic = np.mean([not r.toxic for r in labels])
    assert right >= toxic  # few labels here: at least as good as calling nothing toxic
