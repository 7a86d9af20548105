"""Splits, sampling and metrics for models, all as aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headwise import settings as S
from headwise.functions import scalars as X
from headwise.functions.scans import global_rank


@dataclass(frozen=True)
class Target:
    """Ordered class labels and the right-closed delay cuts between them."""

    name: str
    labels: tuple[str, ...]
    cuts: tuple[float, ...]

    def label(self, delay: Column | str) -> Column:
        return X.label_cuts(delay, self.cuts, self.labels)


# The three delay targets.
TARGETS = {
    t.name: t
    for t in (
        Target("severity", ("on time", "moderate", "severe", "critical"), (5.0, 9.0, 30.0)),
        Target("delay_status", ("on time", "delayed"), (5.0,)),
        Target("severity_balanced", ("on time", "minor", "moderate", "severe"), (4.0, 7.0, 12.0)),
    )
}


def attach_target(df: DataFrame, target: Target, delay: str = "departure_delay_min") -> DataFrame:
    return df.withColumn("target", target.label(delay))


def last_date(df: DataFrame, date: str = "date") -> Column:
    return df.agg(F.max(date)).scalar()


def found_last_date(df: DataFrame, date: str = "date") -> Column:
    """The last date as a value that is found once, for windows that many jobs read."""
    return F.lit(df.agg(F.max(date)).first()[0]).cast("date")


def split_by_days(
    df: DataFrame, horizon_days: int = S.DEFAULTS.horizon_days, val_days: int = 28, date: str = "date", source: DataFrame | None = None,
    end: Column | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test windows by calendar: the last ``horizon_days``, the ``val_days`` before, the rest."""
    end = last_date(source if source is not None else df, date) if end is None else end
    test_from, val_from = F.date_sub(end, horizon_days), F.date_sub(end, horizon_days + val_days)
    d = F.col(date)
    return df.where(d <= val_from), df.where((d > val_from) & (d <= test_from)), df.where(d > test_from)


def with_split(df: DataFrame, horizon_days: int = S.DEFAULTS.horizon_days, val_days: int = 28, date: str = "date") -> DataFrame:
    end = last_date(df, date)
    d = F.col(date)
    part = F.when(d > F.date_sub(end, horizon_days), "test").when(d > F.date_sub(end, horizon_days + val_days), "val").otherwise("train")
    return df.withColumn("split", part)


def expanding_folds(
    df: DataFrame, n_folds: int = 3, val_days: int = 28, date: str = "date", train_cap: int | None = None, ties: Sequence[str] = (),
    end: Column | None = None,
) -> list[tuple[DataFrame, DataFrame]]:
    """Folds that walk back in blocks of ``val_days``; each trains on everything before its block.

    ``train_cap`` keeps only the newest rows of the training part.
    """
    end = last_date(df, date) if end is None else end
    out = []
    for i in range(n_folds):
        hi, lo = F.date_sub(end, i * val_days), F.date_sub(end, (i + 1) * val_days)
        train = df.where(F.col(date) <= lo)
        if train_cap:
            train = train.orderBy(F.col(date).desc(), *ties).limit(train_cap)
        out.append((train, df.where((F.col(date) > lo) & (F.col(date) <= hi))))
    return out


def fold_sizes(df: DataFrame, n_folds: int = 3, val_days: int = 28, date: str = "date") -> DataFrame:
    """Training and validation rows of every fold, in one aggregation."""
    end = last_date(df, date)
    aggs = []
    for i in range(n_folds):
        hi, lo = F.date_sub(end, i * val_days), F.date_sub(end, (i + 1) * val_days)
        aggs += [X.count_if(F.col(date) <= lo).alias(f"t{i}"), X.count_if((F.col(date) > lo) & (F.col(date) <= hi)).alias(f"v{i}")]
    rows = [F.struct(F.lit(i).alias("fold"), F.col(f"t{i}").alias("train_rows"), F.col(f"v{i}").alias("val_rows")) for i in range(n_folds)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def sample_cases(df: DataFrame, key: Sequence[str], per: str = "route_id", n: int = S.DEFAULTS.compare_cases, seed: int = 7) -> DataFrame:
    """Stable sample of n rows: one per group first, then filled up from the rest by hash order."""
    h = F.xxhash64(*key, F.lit(seed))
    first = F.row_number().over(W.partitionBy(per).orderBy("_h", *key)) == 1
    marked = df.withColumn("_h", h)
    heads = marked.withColumn("_first", first).where("_first").select(*key, F.lit(0).alias("_tier"))
    out = marked.join(heads, list(key), "left").withColumn("_tier", F.coalesce("_tier", F.lit(1)))
    return out.orderBy("_tier", "_h", *key).limit(n).drop("_h", "_tier")


def regression_metrics(df: DataFrame, predicted: Column | str, actual: Column | str) -> DataFrame:
    """MAE, RMSE, MAPE (denominator at least 1) and R2 in one pass."""
    p, a = X.col(predicted), X.col(actual)
    e = a - p
    # sum((y - mean)^2) as n * population variance: the centred form does not cancel
    return df.agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(e) / F.greatest(F.abs(a), X.dbl(1.0))) * 100).alias("mape_pct"),
        (X.dbl(1.0) - F.sum(e * e) / (F.var_pop(a) * F.count(a) + X.dbl(1e-12))).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


def dense_codes(df: DataFrame, key: str, chunk: Column, name: str = "route_code") -> DataFrame:
    """0-based code of each distinct id in sorted order. ``chunk`` grows with the id and has few values."""
    ids = df.select(key).distinct()
    return global_rank(ids, [F.col(key)], chunk, "_r").select(key, (F.col("_r") - 1).alias(name))


def confusion(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1, support and share per class that occurs among the actual labels."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)
    sides = matrix.select(
        F.inline(
            F.array(
                F.struct(F.col("actual").alias("label"), F.col("count").alias("_a"), F.lit(0).cast("long").alias("_p"), hit.cast("long").alias("_t")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("_a"), F.col("count").alias("_p"), F.lit(0).cast("long").alias("_t")),
            )
        )
    )
    g = sides.groupBy("label").agg(F.sum("_a").alias("support"), F.sum("_p").alias("_pred"), F.sum("_t").alias("_hit")).where("support > 0")
    zero = X.dbl(0.0)
    precision, recall = F.coalesce(X.ratio("_hit", "_pred"), zero), X.ratio("_hit", "support")
    g = g.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(X.ratio(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")), zero)
    whole = matrix.agg(F.sum("count").cast("double")).scalar()
    return g.select("label", "precision", "recall", f1.alias("f1"), "support", (F.col("support") / whole).alias("share"))


def overall_metrics(matrix: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted precision, recall and F1."""
    per = class_metrics(matrix)
    accuracy = matrix.agg(
        F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)) / F.sum("count")
    ).scalar()

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / F.sum("support")

    return per.agg(
        F.sum("support").alias("n"),
        F.avg("recall").alias("balanced_accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
    ).withColumn("accuracy", accuracy)


def consistency_checks(matrix: DataFrame, per_class: DataFrame, overall: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Do published figures agree with the confusion matrix? One row per check."""
    m = matrix.agg(
        F.sum("count").alias("total"),
        (F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)) / F.sum("count")).alias("acc"),
    )
    rows = matrix.groupBy(F.col("actual").alias("label")).agg(F.sum("count").alias("_n"))
    agree = per_class.join(rows, "label", "left").agg(
        F.coalesce(F.max((F.coalesce("_n", F.lit(0)) != F.col("support")).cast("int")), F.lit(0)).alias("bad_support"),
        F.avg("f1").alias("mean_f1"),
        F.sum("share").alias("shares"),
    )
    facts = overall.select(
        "n", "accuracy", "macro_f1",
        m.select(F.struct("*")).scalar().alias("_m"),
        agree.select(F.struct("*")).scalar().alias("_a"),
    )
    checks = {
        "matrix sums to n": F.col("_m.total") == F.col("n"),
        "accuracy is trace over n": F.abs(F.col("_m.acc") - F.col("accuracy")) <= tolerance,
        "supports are row sums": F.col("_a.bad_support") == 0,
        "macro F1 is the mean of the classes": F.abs(F.col("_a.mean_f1") - F.col("macro_f1")) <= tolerance,
        "shares sum to one": F.abs(F.col("_a.shares") - 1) <= tolerance,
    }
    return facts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), c.alias("passed")) for k, c in checks.items()])))


def class_weights(df: DataFrame, label: str, kind: str, labels: Sequence[str]) -> DataFrame:
    """Weight per class: ``none`` (1), ``balanced`` (n / (k n_c)) or ``sqrt`` of that, scaled to mean 1."""
    k = len(labels)
    aggs = [F.greatest(X.count_if(F.col(label) == v), F.lit(1)).alias(f"c{i}") for i, v in enumerate(labels)]
    counts = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    raw = [F.col("n") / (F.lit(k) * F.col(f"c{i}")) for i in range(k)]
    if kind == "sqrt":
        raw = [F.sqrt(r) for r in raw]
    elif kind == "none":
        raw = [X.dbl(1.0)] * k
    mean = sum(raw[1:], raw[0]) / k
    rows = [F.struct(F.lit(v).alias("label"), (raw[i] / mean).alias("weight")) for i, v in enumerate(labels)]
    return counts.select(F.inline(F.array(*rows)))


def parity(left: DataFrame, right: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Largest and mean absolute difference of the same metrics computed in two ways."""
    b = right.select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics])
    joined = left.select(*keys, *metrics).join(b, list(keys))
    delta = {m: F.abs(F.col(m) - F.col(f"_{m}")) for m in metrics}
    return joined.agg(
        F.count(F.lit(1)).alias("entities"),
        *[F.max(d).alias(f"max_{m}_delta") for m, d in delta.items()],
        *[F.avg(d).alias(f"mean_{m}_delta") for m, d in delta.items()],
    )


# Model versions ---------------------------------------------------------------------------------------------------

VERSION_SCHEMA = "version_id string, model_name string, engine string, trained_at timestamp, metrics map<string,double>, path string"


def register_versions(versions: DataFrame, path: str) -> None:
    versions.write.mode("append").parquet(path)


def version(df: DataFrame, version_id: str) -> DataFrame:
    return df.where(F.col("version_id") == version_id)


def versions(df: DataFrame, model_name: str | None = None, engine: str | None = None) -> DataFrame:
    out = df
    if model_name:
        out = out.where(F.col("model_name") == model_name)
    if engine:
        out = out.where(F.col("engine") == engine)
    return out.orderBy(F.col("trained_at").desc(), "version_id")


def latest_versions(df: DataFrame, engine: str | None = None) -> DataFrame:
    """The newest version of every model name."""
    out = df.where(F.col("engine") == engine) if engine else df
    rn = F.row_number().over(W.partitionBy("model_name").orderBy(F.col("trained_at").desc(), "version_id"))
    return out.withColumn("_rn", rn).where(F.col("_rn") == 1).drop("_rn")


def metrics_table(spark, paths: Mapping[str, str]) -> DataFrame:
    """Saved metric files of several models as one table."""
    out = None
    for name, path in paths.items():
        one = spark.read.json(path).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
