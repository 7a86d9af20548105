"""Quality by hierarchical empirical Bayes: the evidence of a text, its path and its host in one posterior.

A document classifier gives each text the log likelihood ratio of good against bad, from the shares of its bytes and of
its repeated words and lines. Hosts (``source``) and paths on them (``source``, ``lang``) have rates of good documents,
which are posteriors under beta priors: a path's prior is its host's rate, a host's the whole corpus'. A prior weighs as
many documents as the spread of the rates around it shows (method of moments), so sparse sites stay near their prior.
Counts are grouped over all documents: a labelled one counts by its label, any other by half its classifier's
probability. A document's posterior adds its own evidence to the log odds of its path.

The classifier is a logistic regression, fitted in numpy on at most ``sample_docs`` labelled rows that are not held out.

Edge cases: a null or empty text has no evidence and gets its site's rate; null sources and languages are sites of their
own; without labels of both classes there is no evidence and rates stay at the share of good labels, or 0.5; a repeated
label counts once, bad if any says so; repeated rows count as often as they occur; an empty table gives an empty
result; other columns pass through, and those that have a result's name are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise.llm.common import fresh, give_back, sole_memory, text_of, text_runs, written
from headwise.llm.toxicity import held_out

#: Documents are kept at or above this posterior.
KEEP = 0.5
#: An unlabelled document counts as this share of one.
SOFT = 0.5
#: Log likelihood ratios are cut here, so that no text outweighs its site without bound.
CUT = 8.0
AT_ONCE = 1 << 22
FEATURES = 256 + 6


def features(text: str) -> np.ndarray:
    """Roots of the byte shares, and shares of repeated words and lines, upper case, word length, length."""
    out = np.zeros(FEATURES, dtype=np.float32)
    raw = text.encode()
    if not raw:
        return out
    out[:256] = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    out[256] = 1 - len(set(words)) / n
    out[257] = 1 - len(set(zip(words, words[1:]))) / max(1, n - 1)
    out[258] = 1 - len(set(lines)) / len(lines)
    out[259] = float(out[65:91] @ out[65:91])
    out[260] = min(1.0, len(text) / n / 20)
    out[261] = np.log1p(len(raw)) / 12
    return out


@dataclass
class Classifier:
    """Standardised logistic regression; without weights it has no evidence."""

    weights: np.ndarray | None
    centre: np.ndarray
    scale: np.ndarray
    shift: float
    prior: float

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Log likelihood ratio of good against bad for each text."""
        if self.weights is None:
            return np.zeros(len(texts))
        x = (np.stack([features(t) for t in texts]) - self.centre) / self.scale
        odds = x @ self.weights + self.shift - np.log(self.prior / (1 - self.prior))
        odds[[not t for t in texts]] = 0.0
        return np.clip(odds, -CUT, CUT).astype(np.float64)


def train(x: np.ndarray, good: np.ndarray, ridge: float = 3.0, rounds: int = 25) -> Classifier:
    """Newton steps on the penalised log loss."""
    y = np.asarray(good, dtype=np.float64)
    none = Classifier(None, np.zeros(FEATURES), np.ones(FEATURES), 0.0, float(y.mean()) if len(y) else 0.5)
    if not len(y) or y.min() == y.max():
        return none
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.concatenate([(x - centre) / scale, np.ones((len(x), 1))], axis=1).astype(np.float64)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(w[:-1].astype(np.float32), centre, scale, float(w[-1]), float(y.mean()))


def _labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    return known.groupBy(F.col(id_col).cast("long").alias("labelled_id")).agg(F.min(label_col).cast("int").alias("label_is"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 8_000) -> Classifier:
    """Features are taken where the texts are; the driver gets one short vector for each sampled row."""
    chosen = _labels(labels, id_col, label_col).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(sample_docs)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("labelled_id"), text_of(text_col).alias("text_is"))

    @F.arrow_udf("binary")
    def vectors(rows: pa.Array) -> pa.Array:
        out = [features(t.as_py()).tobytes() for t in rows]
        give_back()
        return pa.array(out, pa.binary())

    rows = texts.join(F.broadcast(chosen), "labelled_id")  # bounded by sample_docs
    found = rows.select("labelled_id", "label_is", vectors("text_is").alias("x")).dropDuplicates(["labelled_id"]).collect()
    found.sort(key=lambda r: r.labelled_id)
    x = np.stack([np.frombuffer(r.x, np.float32) for r in found]) if found else np.zeros((0, FEATURES), np.float32)
    return train(x, np.array([r.label_is for r in found]))


def _strength(sites: DataFrame, rate: str, prior: Column | float) -> float:
    """How many documents a prior weighs, from the spread of the rates of sites around it; one aggregation."""
    spread = (F.col(rate) - prior) ** 2
    noise = prior * (1 - prior) if isinstance(prior, float) else F.col("prior") * (1 - F.col("prior"))
    row = sites.where("n > 1").agg(F.sum(F.col("n") * spread), F.sum("n"), F.sum(F.lit(noise) if isinstance(noise, float) else noise), F.count("*")).first()
    if not row[1] or row[3] < 2:
        return 100.0
    # E[n (rate - prior)^2] = noise + n * variance between sites
    between = (row[0] - row[2]) / row[1]
    mean_noise = row[2] / row[3]
    return float(np.clip(mean_noise / between - 1, 1.0, 10_000.0)) if between > 0 else 10_000.0


def posterior(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
    classifier: Classifier | None = None,
    names: tuple[str, str, str] = ("evidence", "site_rate", "quality"),
) -> DataFrame:
    """Add evidence, site rate and quality (posterior of being good) to every row; columns of these names are replaced."""
    model = classifier or fit(df, labels, id_col, text_col, label_col)
    prior = min(max(model.prior, 1e-3), 1 - 1e-3)

    @F.arrow_udf("double")
    def evidence(texts: pa.Array) -> pa.Array:
        sole_memory("quality", lambda: None)
        out = [model.evidence(texts.slice(a, n).to_pylist()) for a, n in text_runs(texts, AT_ONCE)]
        give_back()
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    host, path = F.col(f"`{host_col}`"), F.col(f"`{path_col}`")
    scored = df.select(F.col(f"`{id_col}`").cast("long").alias("labelled_id"), host.alias("host"), path.alias("path"), evidence(text_of(text_col)).alias("evidence"))
    known = _labels(labels, id_col, label_col)
    soft = F.lit(1.0) / (1 + F.exp(-(F.col("evidence") + float(np.log(prior / (1 - prior))))))
    weighed = scored.join(known, "labelled_id", "left").select(
        "host",
        "path",
        F.when(F.col("label_is").isNull(), SOFT).otherwise(1.0).alias("weight"),
        F.coalesce(F.col("label_is").cast("double"), soft).alias("good"),
    )
    sites = weighed.groupBy("host", "path").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("good")).alias("good"))
    sites = written(sites, "sites")  # one row for each host and path
    hosts = sites.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("rate", F.col("good") / F.col("n"))
    hosts = written(hosts, "hosts")
    host_strength = _strength(hosts, "rate", prior)
    hosts = hosts.select(F.col("host").alias("of_host"), ((F.col("good") + host_strength * prior) / (F.col("n") + host_strength)).alias("prior"))
    paths = sites.join(hosts, sites["host"].eqNullSafe(hosts["of_host"])).drop("of_host").withColumn("rate", F.col("good") / F.col("n"))
    paths = written(paths, "paths")
    path_strength = _strength(paths, "rate", F.col("prior"))
    rates = paths.select(
        F.col("host").alias("of_host"),
        F.col("path").alias("of_path"),
        ((F.col("good") + path_strength * F.col("prior")) / (F.col("n") + path_strength)).alias("site_rate"),
    )
    rates = written(rates, "site-rates")
    evidence_, rate_, quality_ = names
    own = df.drop(rate_, quality_).withColumn(evidence_, evidence(text_of(text_col)))
    of_host, of_path, found = fresh(own, "of_host", "of_path", "found_rate")
    rates = rates.select(F.col("of_host").alias(of_host), F.col("of_path").alias(of_path), F.col("site_rate").alias(found))
    joined = own.join(rates, host.eqNullSafe(F.col(of_host)) & path.eqNullSafe(F.col(of_path)), "left")
    rate = F.least(F.greatest(F.coalesce(found, F.lit(0.5)), F.lit(1e-4)), F.lit(1 - 1e-4))
    odds = F.col(evidence_) + F.log(F.col(rate_) / (1 - F.col(rate_)))
    return joined.withColumn(rate_, rate).drop(of_host, of_path, found).withColumn(quality_, 1 / (1 + F.exp(-odds)))
