"""Toxicity: a bidirectional gated recurrent network with attention pooling, over word and character inputs.

A text is cut at white space into words. A word's inputs are its own evidence (how much surely texts
that hold it are toxic oftener) and that of its character 4-grams, the largest and the mean, so that unseen
forms of a word are known by their letters. Windows of 32 words overlap by 8 and cover the whole text; each is read in both directions by gated recurrent units, attention weighs the states, and the pooled state gives the
window's probability. A text's score is that of its most toxic window.

The network is trained in numpy on a bounded sample of labelled rows (``sample_docs`` texts of at most
``longest_training_text`` characters, fixed by a hash): evidence is counted on one half of the sample and the network
trained on the other, each toxic text by the window the network finds most toxic so far.

Edge cases: a null or empty text has one window of no words and gets its score; without labels of both classes every
score is the share of toxic labels, or 0.5 without any; a repeated label counts once, toxic if any says so; rows
without an id are scored and never held out; repeated rows score alike; an empty table gives an empty result; other
columns pass through, and one that has the result's name is replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import chain
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise.llm.common import at_most, give_back, sole_memory, text_of, text_runs

#: Words of a block, blocks of a window, and blocks from one window to the next.
BLOCK, BLOCKS, STEP = 8, 4, 3
HIDDEN = 6
INPUTS = 3
#: Entries kept of each evidence table, the strongest first.
TABLE = 20_000
#: Distinct words that a worker remembers; it does not change a result.
REMEMBERED = 200_000
AT_ONCE = 1 << 20
#: Texts of at least this score are rejected.
REJECT = 0.3


def grams(word: str, n: int = 4) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(max(1, len(marked) - n + 1))]


def evidence(toxic: list[str], clean: list[str], units) -> dict[str, float]:
    """How surely texts that hold a unit are toxic oftener: the root of the likelihood ratio, clipped and scaled."""
    seen = [Counter(), Counter()]
    for counter, texts in zip(seen, (clean, toxic), strict=True):
        for text in texts:
            counter.update(set(chain.from_iterable(map(units, set(text.lower().split())))))
    n0, n1 = len(clean), len(toxic)
    out = {}
    for unit, b in seen[1].items():
        a = seen[0][unit]
        if b * (n0 + n1) <= n1 * (a + b) or a + b < 3:
            continue
        ratio = 0.0
        for inside, size in ((a, n0), (b, n1)):
            for seen_, share in ((inside, (a + b) / (n0 + n1)), (size - inside, 1 - (a + b) / (n0 + n1))):
                if seen_:
                    ratio += 2 * seen_ * log(seen_ / (size * share))
        out[unit] = min(2.0, sqrt(max(0.0, ratio)) / 8)
    kept = sorted(out, key=lambda u: (-out[u], u))[:TABLE]
    return {u: out[u] for u in kept}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """Weights; windows are arrays of (window, word, input)."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 9) -> Network:
        rng = np.random.default_rng(seed)

        def small(*shape: int) -> np.ndarray:
            return rng.normal(0, 0.4, shape).astype(np.float32)

        weights = {}
        for d in "fb":
            weights |= {f"W{d}": small(INPUTS, 3 * HIDDEN), f"U{d}": small(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        weights |= {"a": small(2 * HIDDEN), "o": small(2 * HIDDEN), "z": np.array([-1.0], np.float32)}
        return cls(weights)

    def _read(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        w, u, c = (self.weights[k + d] for k in "WUc")
        m, t, _ = x.shape
        given = (x.transpose(1, 0, 2).reshape(t * m, -1) @ w + c).reshape(t, m, -1)
        h = np.zeros((m, HIDDEN), x.dtype)
        states = np.empty((t, m, HIDDEN), x.dtype)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            own = h @ u
            gates = _sigmoid(given[i, :, : 2 * HIDDEN] + own[:, : 2 * HIDDEN])
            update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(given[i, :, 2 * HIDDEN :] + reset * own[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((i, h, own, update, reset, new))
            h = new + update * (h - new)
            states[i] = h
        return states.transpose(1, 0, 2)

    def _pool(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        focus = states @ self.weights["a"]
        focus = np.exp(focus - focus.max(axis=1, keepdims=True))
        focus /= focus.sum(axis=1, keepdims=True)
        return focus, np.einsum("mt,mth->mh", focus, states)

    def score(self, x: np.ndarray) -> np.ndarray:
        states = np.concatenate([self._read(x, d, None) for d in "fb"], axis=2)
        _, pooled = self._pool(states)
        return _sigmoid(pooled @ self.weights["o"] + self.weights["z"])

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean log loss, by back-propagation through attention, time and gates."""
        m, t, _ = x.shape
        kept = {"f": [], "b": []}
        states = np.concatenate([self._read(x, d, kept[d]) for d in "fb"], axis=2)
        focus, pooled = self._pool(states)
        p = _sigmoid(pooled @ self.weights["o"] + self.weights["z"])
        top = ((p - y) * weight / weight.sum()).astype(np.float32)
        out = {"o": pooled.T @ top, "z": top.sum(keepdims=True)}
        d_pooled = top[:, None] * self.weights["o"]
        d_focus = np.einsum("mh,mth->mt", d_pooled, states)
        d_energy = focus * (d_focus - (focus * d_focus).sum(axis=1, keepdims=True))
        out["a"] = np.einsum("mt,mth->h", d_energy, states)
        d_states = focus[:, :, None] * d_pooled[:, None, :] + d_energy[:, :, None] * self.weights["a"]
        for d, part in zip("fb", (d_states[:, :, :HIDDEN], d_states[:, :, HIDDEN:]), strict=True):
            u = self.weights["U" + d]
            d_given = np.zeros((m, t, 3 * HIDDEN), np.float32)
            d_u, back = np.zeros_like(u), np.zeros((m, HIDDEN), np.float32)
            for i, h, own, update, reset, new in reversed(kept[d]):
                d_h = back + part[:, i]
                d_new = d_h * (1 - update) * (1 - new * new)
                d_update = d_h * (h - new) * update * (1 - update)
                d_reset = d_new * own[:, 2 * HIDDEN :] * reset * (1 - reset)
                d_own = np.concatenate([d_update, d_reset, d_new * reset], axis=1)
                d_given[:, i] = np.concatenate([d_update, d_reset, d_new], axis=1)
                d_u += h.T @ d_own
                back = d_h * update + d_own @ u.T
            flat = d_given.reshape(m * t, -1)
            out |= {"W" + d: x.reshape(m * t, -1).T @ flat, "U" + d: d_u, "c" + d: flat.sum(axis=0)}
        return out


@dataclass
class Model:
    """Evidence tables, the network, and the scale that fits window scores to whole texts.

    ``share`` answers where there is no network.
    """

    words: dict[str, float] = field(default_factory=dict)
    letters: dict[str, float] = field(default_factory=dict)
    network: Network | None = None
    share: float = 0.5
    scale: tuple[float, float] = (1.0, 0.0)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.place: dict[str, int] = {}
        self.table = np.zeros((1 << 12, INPUTS), dtype=np.float32)

    def _learn(self, words: list[str]) -> None:
        get, known = self.model.letters.get, self.model.words.get
        first, end = len(self.place), len(self.place) + len(words)
        if end > len(self.table):
            self.table = np.concatenate([self.table[:first], np.zeros((max(end, 2 * first) - first, INPUTS), np.float32)])
        for i, word in enumerate(words, first):
            found = [get(g, 0.0) for g in grams(word)]
            self.table[i] = known(word, 0.0), max(found), sum(found) / len(found)
            self.place[word] = i

    def inputs(self, texts: list[str]) -> list[np.ndarray]:
        """(word, input) of each text."""
        if len(self.place) > REMEMBERED:
            self.place = {}
        cut = [text.lower().split() for text in texts]
        self._learn(list({w for words in cut for w in words}.difference(self.place)))
        at = self.place.__getitem__
        return [self.table[list(map(at, words))] if words else self.table[:0] for words in cut]

    def windows(self, inputs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All windows of the texts, short ones filled with neutral words, and where each text's windows begin."""
        counts = np.array([max(1, -(-(len(x) - (BLOCKS - STEP) * BLOCK) // (STEP * BLOCK))) for x in inputs])
        firsts = np.concatenate(([0], np.cumsum(counts)))
        held = counts * STEP + BLOCKS - STEP
        begin = np.concatenate(([0], np.cumsum(held)))
        padded = np.zeros((int(begin[-1]) * BLOCK, INPUTS), np.float32)
        for b, x in zip((begin[:-1] * BLOCK).tolist(), inputs, strict=True):
            padded[b : b + len(x)] = x
        blocks = padded.reshape(-1, BLOCK, INPUTS)
        text = np.repeat(np.arange(len(inputs)), counts)
        at = begin[text] + (np.arange(firsts[-1]) - firsts[text]) * STEP
        return blocks[at[:, None] + np.arange(BLOCKS)].reshape(-1, BLOCKS * BLOCK, INPUTS), firsts[:-1]

    def score(self, texts: list[str]) -> np.ndarray:
        if self.model.network is None:
            return np.full(len(texts), self.model.share)
        out = []
        for run in at_most(self.inputs(texts), len, AT_ONCE // 8):
            windows, firsts = self.windows(run)
            scores = np.concatenate([self.model.network.score(windows[i : i + 1024]) for i in range(0, len(windows), 1024)])
            out.append(np.maximum.reduceat(scores, firsts))
        raw = np.clip(np.concatenate(out).astype(np.float64), 1e-7, 1 - 1e-7) if out else np.empty(0)
        slope, shift = self.model.scale
        return _sigmoid(slope * np.log(raw / (1 - raw)) + shift)


def train(texts: list[str], toxic: list[int], epochs: int = 5, batch: int = 128, rate: float = 0.02, seed: int = 9) -> Model:
    """Evidence from the texts of even place, network from the others; labels are of whole texts."""
    y = np.array(toxic, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return Model(share=float(y.mean()) if len(y) else 0.5)
    counted = [i for i in range(len(y)) if i % 2 == 0]
    learned = [i for i in range(len(y)) if i % 2 == 1]
    if min(sum(y[i] for i in half) for half in (counted, learned)) < 1:
        counted = learned = list(range(len(y)))
    of = ([texts[i] for i in counted if y[i]], [texts[i] for i in counted if not y[i]])
    model = Model(evidence(*of, lambda w: [w]), evidence(*of, grams), Network.fresh(seed))
    scorer, rng = Scorer(model), np.random.default_rng(seed)
    labels = y[learned]
    windows, firsts = scorer.windows(scorer.inputs([texts[i] for i in learned]))
    counts = np.diff(np.append(firsts, len(windows)))

    def strongest(score: np.ndarray) -> np.ndarray:
        """The window of each text with the largest score."""
        order = np.lexsort((score, np.repeat(np.arange(len(firsts)), counts)))
        return order[firsts + counts - 1]

    def all_scores() -> np.ndarray:
        return np.concatenate([model.network.score(windows[i : i + 1024]) for i in range(0, len(windows), 1024)])

    chosen = strongest(windows[:, :, :2].max(axis=1).sum(axis=1))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.network.weights.items()}
    step = 0
    for epoch in range(epochs):
        if epoch == epochs // 2:  # from here on the network itself says which window makes a text toxic
            chosen = strongest(all_scores())
        clean = np.nonzero(labels == 0)[0]
        other = firsts[clean] + rng.integers(0, counts[clean])  # any window of a clean text is clean
        at, t = np.concatenate([chosen, other]), np.concatenate([labels, np.zeros(len(clean), np.float32)])
        weight = np.where(t > 0, max(1.0, (t == 0).sum() / (4 * max(1, t.sum()))), 1.0).astype(np.float32)
        for some in np.array_split(rng.permutation(len(t)), max(1, len(t) // batch)):
            step += 1
            slopes = model.network.gradients(windows[at[some]], t[some], weight[some])
            for k, g in slopes.items():
                a, b = moment[k]
                a[...] = 0.9 * a + 0.1 * g
                b[...] = 0.99 * b + 0.01 * g * g
                model.network.weights[k] -= (rate / (1 + epoch) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    most = np.clip(np.maximum.reduceat(all_scores(), firsts).astype(np.float64), 1e-7, 1 - 1e-7)
    model.scale = _scale(np.log(most / (1 - most)), labels)
    return model


def _scale(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Slope and shift of a logistic fit, by Newton steps with a small ridge."""
    z = np.stack([x - x.mean(), np.ones_like(x)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = _sigmoid(z @ w)
        slope = z.T @ (p - y) + 1e-2 * w
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), slope)
    return max(float(w[0]), 1e-3), float(w[1] - w[0] * x.mean())


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = 8_000, longest_training_text: int = 20_000
) -> Model:
    """Train on at most ``sample_docs`` labelled rows that are not held out."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    one = one.groupBy(F.col(id_col).cast("long").alias("labelled_id")).agg(F.max(label_col).cast("int").alias("label_is"))
    chosen = one.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(sample_docs)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("labelled_id"), text_of(text_col).alias("text_is"))
    rows = texts.where(F.length("text_is") <= longest_training_text).join(F.broadcast(chosen), "labelled_id")  # bounded by sample_docs
    first = rows.groupBy("labelled_id").agg(F.min(F.struct("text_is", "label_is")).alias("r")).select("labelled_id", "r.*")
    found = sorted(first.collect(), key=lambda r: r.labelled_id)
    return train([r.text_is for r in found], [r.label_is for r in found])


_LAST: dict[str, Scorer] = {}


def _scorer(key: str, model: Callable[[], Model]) -> Scorer:
    """The worker's scorer for a model; it remembers words from task to task."""
    sole_memory("toxicity", _LAST.clear)
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Scorer(model())
    return _LAST[key]


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the toxicity of each whole text, 0 to 1; a column of that name is replaced."""
    holder = df.sparkSession.sparkContext.broadcast(model)  # tables of at most TABLE entries and the weights
    key = uuid.uuid4().hex

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        one = _scorer(key, lambda: holder.value)
        out = [one.score(texts.slice(a, n).to_pylist()) for a, n in text_runs(texts, AT_ONCE)]
        give_back()
        return pa.array(np.concatenate(out).astype(np.float64) if out else [], pa.float64())

    return df.withColumn(score_col, scored(text_of(text_col)))
