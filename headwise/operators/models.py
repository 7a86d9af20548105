"""Model fitting and scoring on MLlib. Rows never leave the cluster; only fitted parameters and metrics do."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import dataclass, field
from functools import partial, reduce
from operator import or_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwise.functions import scalars as X
from headwise.functions.quantiles import exact_column_quantiles, exact_quantiles
from headwise.operators import metrics as M
from headwise.operators.features import check_features
from headwise.session import materialise

SEED = 2024
# Fixed values: (regParam, elasticNetParam) grid of the linear demand model.
LINEAR_GRID = (
    (0.001, 0.0), (0.003, 0.0), (0.01, 0.0), (0.03, 0.0), (0.001, 0.5), (0.01, 0.5), (0.001, 1.0), (0.01, 1.0),
)


@dataclass(frozen=True)
class Candidate:
    """One model configuration."""

    family: str
    params: Mapping = field(default_factory=dict)
    weight: str = "none"

    @property
    def name(self) -> str:
        shown = ",".join(f"{k}={v}" for k, v in sorted(self.params.items()))
        return f"{self.family}({shown})/{self.weight}"


DEMAND_TREES = (
    Candidate("random_forest", {"numTrees": 40, "maxDepth": 8, "minInstancesPerNode": 8}),
    Candidate("random_forest", {"numTrees": 40, "maxDepth": 10, "minInstancesPerNode": 4}),
    Candidate("gbt", {"maxIter": 30, "maxDepth": 5, "stepSize": 0.1}),
)
DELAY_TREES = (
    *[
        Candidate("random_forest", {"numTrees": n, "maxDepth": d, "minInstancesPerNode": m})
        for n, d, m in ((30, 6, 10), (30, 8, 8), (40, 10, 5), (40, 12, 5))
    ],
    *[
        Candidate("gbt", {"maxIter": n, "maxDepth": d, "stepSize": s})
        for n, d, s in ((20, 3, 0.1), (20, 4, 0.1), (30, 4, 0.08), (30, 5, 0.05))
    ],
)
CLASSIFIERS = (
    Candidate("logistic", {"regParam": 0.01, "maxIter": 60}),
    Candidate("logistic", {"regParam": 0.1, "maxIter": 60}, "balanced"),
    Candidate("random_forest", {"numTrees": 30, "maxDepth": 8, "minInstancesPerNode": 5}),
    Candidate("random_forest", {"numTrees": 30, "maxDepth": 10, "minInstancesPerNode": 3}, "sqrt"),
    Candidate("boosted", {"maxIter": 12, "maxDepth": 4, "stepSize": 0.1}),
    Candidate("ordinal", {"maxIter": 12, "maxDepth": 4, "stepSize": 0.1}),
)


def with_imputation(train: DataFrame, frames: Sequence[DataFrame], features: Sequence[str]) -> list[DataFrame]:
    """Missing features -> exact medians of the training window, in every frame. All-null columns become 0.

    Medians are found for the columns that have a gap in any of the frames.
    """

    def known(c: str) -> Column:
        return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))

    gaps = [f.agg(*[F.max(known(c).isNull()).alias(c) for c in features]).first().asDict() for f in frames]  # one flag a column
    needed = [c for c in features if any(g[c] for g in gaps)]
    medians = {r["column"]: r["q"] for r in exact_column_quantiles(train, needed, 0.5).collect()} if needed else {}  # one row a column

    def filled(c: str) -> Column:
        return F.coalesce(known(c), X.dbl(medians.get(c, 0.0)))

    return [f.withColumns({c: filled(c) for c in features}) for f in frames]


def with_sentinel(df: DataFrame, features: Sequence[str], value: float = -1.0) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), X.dbl(value)) for c in features})


def regressor(candidate: Candidate, label: str):
    p = dict(candidate.params)
    if candidate.family == "linear":
        return LinearRegression(featuresCol="features", labelCol=label, maxIter=200, solver="auto", **p)
    if candidate.family == "random_forest":
        return RandomForestRegressor(featuresCol="features", labelCol=label, seed=SEED, **p)
    if candidate.family == "gbt":
        return GBTRegressor(featuresCol="features", labelCol=label, seed=SEED, **p)
    raise ValueError(f"Unknown model family: {candidate.family}")


def fit_regressor(train: DataFrame, features: Sequence[str], label: str, candidate: Candidate) -> PipelineModel:
    check_features([f for f in features if f != label])
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="error")]
    scaled = candidate.family == "linear"
    stages += (
        [StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)]
        if scaled
        else [VectorAssembler(inputCols=["raw_features"], outputCol="features")]
    )
    return Pipeline(stages=[*stages, regressor(candidate, label)]).fit(train)


def score(model: PipelineModel, df: DataFrame, lo: float | None = None, hi: float | None = None) -> DataFrame:
    out = model.transform(df).drop("raw_features", "features")
    return out.withColumn("predicted", X.clip("prediction", lo, hi)).drop("prediction")


@dataclass
class Selection:
    """Outcome of a model selection: the chosen configuration, all validation scores, the test predictions."""

    candidate: Candidate
    model: PipelineModel
    scores: list[tuple[str, float, float, float, float]]
    predictions: DataFrame


def select_regressor(
    train: DataFrame, val: DataFrame, test: DataFrame, features: Sequence[str], label: str, candidates: Sequence[Candidate],
    lo: float | None = None, hi: float | None = None,
) -> Selection:
    """Best validation R2 wins, is refitted on train + validation, and scores the test window once."""
    scores, best = [], None
    for c in candidates:
        model = fit_regressor(train, features, label, c)
        m = M.regression_metrics(score(model, val, lo, hi), "predicted", label).first()
        scores.append((c.name, m["mae"], m["rmse"], m["mape_pct"], m["r2"]))
        if best is None or m["r2"] > best[1]:
            best = (c, m["r2"])
    final = fit_regressor(train.unionByName(val), features, label, best[0])
    return Selection(best[0], final, scores, score(final, test, lo, hi))


SCORE_SCHEMA = "candidate string, mae double, rmse double, mape_pct double, r2 double"


def linear_candidates() -> list[Candidate]:
    return [Candidate("linear", {"regParam": r, "elasticNetParam": e}) for r, e in LINEAR_GRID]


def residual_bounds(pred: DataFrame, actual: str) -> DataFrame:
    """Residual mean, spread and the exact 2.5 % and 97.5 % points."""
    res = pred.select((F.col(actual) - F.col("predicted")).alias("res"))
    tails = exact_quantiles(res, [], "res", {"lower": 0.025, "upper": 0.975})
    base = res.agg(F.avg("res").alias("residual_mean"), F.stddev_pop("res").alias("residual_std"))
    return base.withColumn("_t", tails.select(F.struct("lower", "upper")).scalar()).select(
        "residual_mean", "residual_std", F.col("_t.lower").alias("residual_lower"), F.col("_t.upper").alias("residual_upper")
    )


def latest_rows(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The last row of each group."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where(F.col("_rn") == 1).drop("_rn")


def forecast_latest(
    model: PipelineModel, df: DataFrame, keys: Sequence[str], bounds: DataFrame, horizon_days: int = 7, lo: float = 0.0, hi: float = 150.0,
) -> DataFrame:
    """Forecast from the latest row of each series, with the residual interval and the target date."""
    out = score(model, latest_rows(df, keys, F.col("date").desc()), lo, hi)
    out = out.withColumn("_b", bounds.select(F.struct("residual_lower", "residual_upper")).scalar())
    return out.withColumns(
        {
            "forecast_date": F.date_add("date", horizon_days),
            "lower_bound": F.greatest(F.col("predicted") + F.col("_b.residual_lower"), X.dbl(lo)),
            "upper_bound": F.least(F.col("predicted") + F.col("_b.residual_upper"), X.dbl(hi)),
            "horizon_days": F.lit(horizon_days),
        }
    ).drop("_b")


def predict_subset(model: PipelineModel, df: DataFrame, ids: Sequence | None = None, date: str | None = None, lo=-10.0, hi=60.0) -> DataFrame:
    out = df.where(F.col("route_id").isin(*ids)) if ids else df
    out = out.where(F.col("date") == F.lit(date).cast("date")) if date else out
    return score(model, out, lo, hi)


# Classification ---------------------------------------------------------------------------------------------------


def _coded(df: DataFrame, labels: Sequence[str], label: str = "target") -> DataFrame:
    """Class index in the target's own label order, so probabilities need no re-ordering later."""
    return df.withColumn("_y", X.code_of(label, {v: float(i) for i, v in enumerate(labels)}).cast("double"))


def _weighted(train: DataFrame, labels: Sequence[str], kind: str) -> DataFrame:
    if kind == "none":
        return train.withColumn("_w", X.dbl(1.0))
    weights = {r["label"]: r["weight"] for r in M.class_weights(train, "target", kind, labels).collect()}
    return train.withColumn("_w", X.code_of("target", weights, 1.0))


@dataclass
class Classifier:
    """A fitted classifier that yields class probabilities in the order of ``labels``."""

    labels: tuple[str, ...]
    features: tuple[str, ...]
    parts: list
    kind: str

    def probabilities(self, df: DataFrame) -> DataFrame:
        """Adds ``probs``: one probability per label, summing to 1. A frame without ``features`` gets that vector first."""
        base = df if "features" in df.columns else assembled(df, self.features)
        k = len(self.labels)
        if self.kind == "single":
            out = self.parts[0].transform(base)
            probs = aligned_probabilities(vector_to_array("probability"), [float(i) for i in range(k)], k)
            return out.withColumn("probs", probs).drop("rawPrediction", "probability", "prediction", "features", "scaled")
        cols = []
        for i, part in enumerate(self.parts):
            if part is None:
                base = base.withColumn(f"_p{i}", X.dbl(0.0))
            else:
                base = part.transform(base).withColumn(f"_p{i}", vector_to_array("probability")[1])
                base = base.drop("rawPrediction", "probability", "prediction")
            cols.append(f"_p{i}")
        if self.kind == "one_vs_rest":
            raw = [F.col(c) for c in cols]
        else:  # cumulative: P(worse than class i), made non-increasing, then differenced
            cum = [F.col(cols[0])]
            for c in cols[1:]:
                cum.append(F.least(cum[-1], F.col(c)))
            raw = [1 - cum[0], *[F.greatest(a - b, X.dbl(0.0)) for a, b in zip(cum, cum[1:])], cum[-1]]
        total = raw[0]
        for r in raw[1:]:
            total = total + r
        probs = F.array(*[F.coalesce(X.ratio(r, total), X.dbl(1.0 / k)) for r in raw])
        return base.withColumn("probs", probs).drop(*cols, "features")

    def predict(self, df: DataFrame) -> DataFrame:
        return with_label(self.probabilities(df), self.labels)


def aligned_probabilities(probs: Column, class_order: Sequence[float], k: int) -> Column:
    """Probabilities re-ordered from the model's class order to 0..k-1; classes the model never saw get 0."""
    at = {int(c): i for i, c in enumerate(class_order)}
    return F.array(*[F.coalesce(F.get(probs, F.lit(at[i])), X.dbl(0.0)) if i in at else X.dbl(0.0) for i in range(k)])


def with_label(df: DataFrame, labels: Sequence[str], multipliers: Sequence[float] | None = None, name: str = "predicted") -> DataFrame:
    """Most probable label, after optional per-class factors."""
    scaled = F.col("probs")
    if multipliers is not None:
        scaled = F.array(*[F.col("probs")[i] * X.dbl(m) for i, m in enumerate(multipliers)])
    best = F.array_position(scaled, F.array_max(scaled)).cast("int")
    return df.withColumn(name, F.element_at(F.array(*[F.lit(v) for v in labels]), best))


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def fit_classifier(train: DataFrame, features: Sequence[str], labels: Sequence[str], candidate: Candidate) -> Classifier:
    """Fit one candidate. A frame that holds ``features`` already, as a shared matrix does, is used as it is."""
    check_features(features)
    df = _weighted(_coded(train, labels), labels, candidate.weight)
    df = df if "features" in df.columns else assembled(df, features)
    p, k = dict(candidate.params), len(labels)
    if candidate.family == "logistic":
        est = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="_w", standardization=True, **p)
        return Classifier(tuple(labels), tuple(features), [est.fit(df)], "single")
    if candidate.family == "random_forest":
        est = RandomForestClassifier(featuresCol="features", labelCol="_y", weightCol="_w", seed=SEED, **p)
        return Classifier(tuple(labels), tuple(features), [est.fit(df)], "single")
    present = {int(r["_y"]) for r in df.select("_y").distinct().collect()}
    gbt = GBTClassifier(featuresCol="features", labelCol="_b", weightCol="_w", seed=SEED, **p)
    if candidate.family == "boosted":
        parts = [gbt.fit(df.withColumn("_b", (F.col("_y") == i).cast("double"))) if i in present else None for i in range(k)]
        return Classifier(tuple(labels), tuple(features), parts, "one_vs_rest")
    if candidate.family == "ordinal":
        parts = []
        for i in range(k - 1):
            both = any(j > i for j in present) and any(j <= i for j in present)
            parts.append(gbt.fit(df.withColumn("_b", (F.col("_y") > i).cast("double"))) if both else None)
        return Classifier(tuple(labels), tuple(features), parts, "cumulative")
    raise ValueError(f"Unknown model family: {candidate.family}")


def one_vs_rest(train: DataFrame, features: Sequence[str], labels: Sequence[str], **params):
    """Stock one-vs-rest boosting (labels only, no probabilities)."""
    df = VectorAssembler(inputCols=list(features), outputCol="features").transform(_coded(train, labels))
    return OneVsRest(classifier=GBTClassifier(seed=SEED, **params), featuresCol="features", labelCol="_y").fit(df)


def classification_scores(pred: DataFrame) -> dict:
    return M.overall_metrics(M.confusion(pred, "target", "predicted")).first().asDict()


def binary_auc(pred: DataFrame, labels: Sequence[str]) -> dict[str, float]:
    """ROC-AUC and PR-AUC of a two-class prediction."""
    scored = _coded(pred, labels).withColumn("_score", F.col("probs")[1])
    out = {}
    for name, metric in (("roc_auc", "areaUnderROC"), ("pr_auc", "areaUnderPR")):
        out[name] = BinaryClassificationEvaluator(rawPredictionCol="_score", labelCol="_y", metricName=metric).evaluate(scored)
    return out


def fits_at_once(train: DataFrame, features: Sequence[str], most: int = 4) -> int:
    """How many fits on these rows may run side by side: as many as keep their rows in the memory that executors have for it.

    A fit holds its rows in a form of its own (8 bytes a feature and some 160 for the rest, at most) and what does not fit goes to disk,
    so fits of many rows run one by one. Small ones gain from company: each is a chain of short jobs.
    """
    status = train.sparkSession.sparkContext._jsc.sc().getExecutorMemoryStatus().values().iterator()
    memory = 0
    while status.hasNext():
        memory += status.next()._1()
    return max(1, min(most, memory // max(1, train.count() * (8 * len(features) + 160))))


SWEEP_SCHEMA = "candidate string, macro_f1 double, mean_macro_f1 double, accuracy double, refits int"


def sweep(
    folds: Sequence[tuple[DataFrame, DataFrame]], features: Sequence[str], labels: Sequence[str],
    candidates: Sequence[Candidate] = CLASSIFIERS, top: int = 3, at_once: int | None = None,
) -> list[tuple[Candidate, float, float, float, int]]:
    """Score every candidate on the newest fold, refit the best few on the older folds too, and rank.

    Order: macro F1 on the newest fold, mean macro F1 over folds, accuracy. One fold is worked on at a time; one that
    has a method ``held`` inside that context, which may write its rows for so long. Fits run ``at_once`` at a time, as many as ``fits_at_once`` tells
    for the newest fold, which has the most rows, unless given.
    """

    def scores(fold: tuple[DataFrame, DataFrame], some: Sequence[Candidate]) -> list[dict]:
        nonlocal at_once
        with getattr(fold, "held", partial(nullcontext, fold))() as (train, val):
            at_once = at_once or fits_at_once(train, features)
            with ThreadPoolExecutor(max_workers=at_once) as pool:
                return list(pool.map(lambda c: classification_scores(fit_classifier(train, features, labels, c).predict(val)), some))

    rows = [(c, s["macro_f1"], s["macro_f1"], s["accuracy"], 0) for c, s in zip(candidates, scores(folds[0], candidates), strict=True)]
    rows.sort(key=lambda r: (-r[1], -r[3]))
    best = [r[0] for r in rows[:top]]
    older = [scores(fold, best) for fold in folds[1:]]
    n = len(older)
    for i, (c, f1, _, acc, _n) in enumerate(rows[:top]):
        rows[i] = (c, f1, (f1 + sum(s[i]["macro_f1"] for s in older)) / (1 + n), acc, n)
    return sorted(rows, key=lambda r: (-r[1], -r[2], -r[3]))


MULTIPLIER_GRID = tuple(round(0.5 + 0.1 * i, 1) for i in range(16))


def tune_multipliers(
    probs: DataFrame, labels: Sequence[str], grid: Sequence[float] = MULTIPLIER_GRID, rounds: int = 3
) -> tuple[list[float], float, float]:
    """Per-class factors by coordinate ascent on macro F1. Each coordinate is one aggregation over the rows.

    Returns the factors and the macro F1 without and with them.
    """
    k = len(labels)
    codes = _coded(probs, labels).select(F.col("_y").cast("int").alias("_y"), "probs")

    def trials(factors: list[list[float]]) -> list[float]:
        options = F.array(*[
            F.struct(F.lit(i).alias("t"), F.array(*[X.dbl(x) for x in f]).alias("f")) for i, f in enumerate(factors)
        ])
        each = codes.select("_y", "probs", F.explode(options).alias("o"))
        scaled = F.zip_with("probs", F.col("o.f"), lambda a, b: a * b)
        each = each.select(F.col("o.t").alias("t"), "_y", scaled.alias("s"))
        each = each.select("t", "_y", (F.array_position("s", F.array_max("s")) - 1).cast("int").alias("p"))
        counts = {(r["t"], r["_y"], r["p"]): r["n"] for r in each.groupBy("t", "_y", "p").agg(F.count(F.lit(1)).alias("n")).collect()}
        out = []
        for t in range(len(factors)):
            f1s = []
            for c in range(k):
                hit = counts.get((t, c, c), 0)
                actual = sum(n for (a, y, _), n in counts.items() if a == t and y == c)
                predicted = sum(n for (a, _, p), n in counts.items() if a == t and p == c)
                f1s.append(2 * hit / (actual + predicted) if actual + predicted else 0.0)
            out.append(sum(f1s) / k)
        return out

    current = [1.0] * k
    base = best = trials([current])[0]
    for _ in range(rounds):
        improved = False
        for c in range(k):
            options = [[v if i == c else current[i] for i in range(k)] for v in grid]
            scores = trials(options)
            top = max(range(len(grid)), key=lambda i: scores[i])
            if scores[top] > best + 1e-6:
                current, best, improved = options[top], scores[top], True
        if not improved:
            break
    return current, base, best


def final_run(
    train: DataFrame, val: DataFrame, test: DataFrame, features: Sequence[str], labels: Sequence[str], candidate: Candidate, keep
) -> tuple[DataFrame, dict]:
    """Validate, tune the class factors on the validation window, refit on both windows, score the test window once.

    ``keep(df, name)`` persists the validation probabilities, which the tuning reads once per coordinate.
    """
    first = fit_classifier(train, features, labels, candidate)
    val_probs = keep(first.probabilities(val).select("target", "probs"), "validation_probabilities")
    factors, before, after = tune_multipliers(val_probs, labels)
    final = fit_classifier(train.unionByName(val), features, labels, candidate)
    pred = with_label(final.predict(test), labels, factors, "predicted_adjusted")
    pred = pred.select("*", *[F.col("probs")[i].alias(f"prob_{v.replace(' ', '_')}") for i, v in enumerate(labels)])
    return pred, {"factors": factors, "validation_macro_f1": before, "validation_macro_f1_adjusted": after}


def with_donors(df: DataFrame, key: str, repeats: int | Sequence[int], buckets: int, value: str = "features") -> DataFrame:
    """Each row once a repeat (of that many, or of the given ones) (``_r``) with the ``_donor`` that a permutation gives it: the ``value`` of another row.

    Rows are numbered in hashed buckets by one hash, and again for each repeat by another; a row's donor is the one that
    has its number in that repeat. The rows are joined once to as many copies of the values as there are repeats.
    """
    placed = df.withColumn("_b", F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(buckets)).cast("int"))
    here = placed.withColumn("_rn", F.row_number().over(W.partitionBy("_b").orderBy(F.xxhash64(key, F.lit(SEED + 1)), key)))
    turns = F.array(*[F.lit(r) for r in (range(repeats) if isinstance(repeats, int) else repeats)])
    turns = placed.select("_b", key, F.col(value).alias("_donor"), F.explode(turns).alias("_r"))
    there = turns.withColumn("_rn", F.row_number().over(W.partitionBy("_b", "_r").orderBy(F.xxhash64(key, F.lit(SEED + 2), F.col("_r")), key)))
    return here.join(there.drop(key), ["_b", "_rn"]).drop("_b", "_rn")


IMPORTANCE_SCHEMA = "feature string, importance double, std double"


def _macro_f1(counts: Mapping[tuple[str, str], int]) -> float:
    """Macro F1 over the classes that occur, from counts by (actual, predicted)."""
    f1s = []
    for label in {a for a, _ in counts}:
        hit = counts.get((label, label), 0)
        actual = sum(n for (a, _), n in counts.items() if a == label)
        predicted = sum(n for (_, p), n in counts.items() if p == label)
        f1s.append(2 * hit / (actual + predicted))
    return sum(f1s) / len(f1s)


def permutation_importance(
    model: Classifier, df: DataFrame, key: str, features: Sequence[str], repeats: int = 5, rows_per_bucket: int = 50_000
) -> list[tuple[str, float, float]]:
    """Macro-F1 loss when one feature at a time is shuffled: mean and spread over the repeats.

    All permuted columns of a repeat are one frame: a row and its donor become one row for each feature, whose vector has the
    donor's value in that place. Those rows are scored and counted where they arise, so that what is shuffled is one count for each
    (feature, repeat, actual, predicted) of a task, and only those counts reach the driver. Repeats come one by one: the rows
    that one moves to their donors are off the disk before the next.
    """
    at = [model.features.index(f) for f in features]
    frame = assembled(df, model.features) if "features" not in df.columns else df
    rows = frame.select(key, "target", vector_to_array("features").alias("_own"))
    buckets = max(1, rows.count() // rows_per_bucket)
    paired = [with_donors(rows, key, [r], buckets, "_own").select("target", "_own", "_donor", "_r") for r in range(repeats)]
    whole = rows.select("target", "_own", F.lit(None).cast("array<double>").alias("_donor"), F.lit(-1).alias("_r"))
    place = F.when(F.col("_r") < 0, F.array(F.lit(-1))).otherwise(F.array(*[F.lit(i) for i in at]))
    swapped = F.transform("_own", lambda x, i: F.when(i == F.col("_f"), F.get(F.col("_donor"), i)).otherwise(x))
    counts: dict[tuple[int, int], dict[tuple[str, str], int]] = {}
    for part in [whole, *paired]:
        each = part.withColumn("_f", F.explode(place))
        scored = model.predict(each.select("target", "_r", "_f", array_to_vector(swapped).alias("features")))
        found = materialise(scored.groupBy("_f", "_r", "target", "predicted").agg(F.count(F.lit(1)).alias("n")), "importance_counts")
        for r in found.collect():  # features x classes^2
            counts.setdefault((r["_f"], r["_r"]), {})[r["target"], r["predicted"]] = r["n"]
    if not counts:
        return []
    base, out = _macro_f1(counts[-1, -1]), []
    for f, i in zip(features, at, strict=True):
        drops = [base - _macro_f1(counts[i, r]) for r in range(repeats)]
        mean = sum(drops) / repeats
        out.append((f, mean, (sum((d - mean) ** 2 for d in drops) / repeats) ** 0.5))
    return sorted(out, key=lambda r: -r[1])


# Clustering -------------------------------------------------------------------------------------------------------

CLUSTER_FEATURES = (
    "passengers", "avg_boardings_per_trip", "avg_delay_min", "p90_delay_min", "on_time_share", "adherence_share",
    "occupancy_avg_pct", "occupancy_max_pct", "crowding_share", "critical_crowding_share", "underutilized_share",
    "avg_headway_min", "headway_cv", "bunching_share", "gapping_share", "avg_actual_travel_min", "route_score",
)


@dataclass
class Clustering:
    k: int
    silhouettes: dict[int, float]
    inertia: float
    assignments: DataFrame
    centres: list[list[float]]


def cluster(
    df: DataFrame, features: Sequence[str] = CLUSTER_FEATURES, key: str = "route_id", k_range: Sequence[int] = range(2, 11), k: int | None = None
) -> Clustering:
    """K-means on median-imputed, scaled metrics; k with the best silhouette unless given. Centres in original units."""
    features = [f for f in features if f in df.columns]
    filled = with_imputation(df, [df], features)[0]
    raw = VectorAssembler(inputCols=features, outputCol="raw").transform(filled)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(raw)
    scaled = scaler.transform(raw)
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="cluster", metricName="silhouette")
    silhouettes, fitted = {}, {}
    for n in [k] if k else list(k_range):
        model = KMeans(k=n, seed=42, featuresCol="features", predictionCol="cluster", maxIter=50).fit(scaled)
        labelled = model.transform(scaled)
        if labelled.select("cluster").distinct().count() < 2:
            continue
        silhouettes[n], fitted[n] = evaluator.evaluate(labelled), model
    best = max(silhouettes, key=lambda n: (silhouettes[n], -n))
    model = fitted[best]
    std, mean = scaler.std.toArray(), scaler.mean.toArray()
    centres = [[float(v) for v in c * std + mean] for c in model.clusterCenters()]
    assigned = model.transform(scaled).drop("raw", "features")
    return Clustering(best, silhouettes, float(model.summary.trainingCost), assigned, centres)


PROFILE_FEATURES = (
    "passengers", "avg_delay_min", "on_time_share", "occupancy_avg_pct", "occupancy_max_pct", "crowding_share",
    "critical_crowding_share", "underutilized_share", "bunching_share", "route_score", "avg_boardings_per_trip",
    "avg_headway_min", "avg_actual_travel_min",
)


def cluster_profiles(assigned: DataFrame, features: Sequence[str] = PROFILE_FEATURES) -> DataFrame:
    """Size, mean and spread of the key metrics per cluster, with a rule-based label."""
    have = [f for f in features if f in assigned.columns]
    out = assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_routes"),
        *[F.avg(f).alias(f"{f}_mean") for f in have],
        *[F.coalesce(F.stddev_samp(f), X.dbl(0.0)).alias(f"{f}_std") for f in have],
    )
    return out.withColumn("label", cluster_label("cluster", {f: f"{f}_mean" for f in have}))


# Descriptors of a cluster by the means of its members. Of each group the first line with a true condition
# holds; a condition is (metric, above or below, limit), and any one of a line's conditions makes it true.
CLUSTER_WORDS = (
    (
        ("Very High Demand", (("passengers", "above", 50000),)),
        ("High Demand", (("passengers", "above", 20000),)),
        ("Moderate Demand", (("passengers", "above", 5000),)),
        ("Low Demand", (("passengers", "any", 0),)),
    ),
    (
        ("Critical Crowding", (("critical_crowding_share", "above", 0.2), ("crowding_share", "above", 0.4))),
        ("High Crowding", (("crowding_share", "above", 0.2),)),
        ("High Occupancy", (("occupancy_max_pct", "above", 85),)),
    ),
    (
        ("Severe Delays", (("avg_delay_min", "above", 15), ("on_time_share", "below", 0.55))),
        ("High Delays", (("avg_delay_min", "above", 10), ("on_time_share", "below", 0.7))),
        ("High Reliability", (("on_time_share", "above", 0.9),)),
    ),
    (("Frequent Bunching", (("bunching_share", "above", 0.2),)),),
    (("Underutilized", (("underutilized_share", "above", 0.5),)),),
    (("Long Headways", (("avg_headway_min", "above", 20),)),),
)


def first_match(groups, means: Mapping[str, str]) -> list[Column]:
    """For each group of lines the word of the first true one, or null; a missing or null mean is 0."""

    def true(metric: str, side: str, limit: float) -> Column:
        mean = F.coalesce(F.col(means[metric]), X.dbl(0.0)) if metric in means else X.dbl(0.0)
        return {"above": mean > limit, "below": mean < limit}.get(side, F.lit(True))

    def word(lines) -> Column:
        return F.coalesce(*[F.when(reduce(or_, [true(*c) for c in conditions]), text) for text, conditions in lines])

    return [word(lines) for lines in groups]


def cluster_label(cluster_col: str, means: Mapping[str, str]) -> Column:
    """Up to three descriptors from the cluster's means."""
    words = F.slice(F.array_compact(F.array(*first_match(CLUSTER_WORDS, means))), 1, 3)
    return F.concat(F.lit("Cluster "), F.col(cluster_col).cast("string"), F.lit(": "), F.array_join(words, " / "))


def cluster_members(assigned: DataFrame, cluster_id: int, key: str = "route_id") -> DataFrame:
    return assigned.where(F.col("cluster") == cluster_id).select(key)
