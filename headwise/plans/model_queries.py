"""Models (M): splits and metrics with SQL, fits as row-producing queries."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import lru_cache, reduce

from pyspark.sql import functions as F

from headwise import settings as S
from headwise.functions import scalars as X
from headwise.operators import features as Fe
from headwise.operators import metrics as M
from headwise.operators import models as Mo
from headwise.plans import frames
from headwise.plans import feature_queries  # noqa: F401  (M05's SQL reads that of F20)
from headwise.plans.catalog import REGISTRY, query
from headwise.plans.frames import Layer
from headwise.plans.oracle import VIEWS
from headwise.plans.stored import stored
from headwise.session import materialise, scratch
from headwise.sources import star

KEYS = ["route_id", "date", "time_band"]
DELAY = "departure_delay_min"
SEVERITY = M.TARGETS["severity"]
HORIZON, VAL = 5, 5  # the trip calendar spans thirty days
DEMAND_FEATURES = [
    "weekday", "month", "time_band_code", "event_multiplier", "route_category_code", "route_stops_count", "route_length_km",
    "lag1_boardings", "lag2_boardings", "lag7_boardings", "lag14_boardings", "roll7_mean_boardings",
    "roll7_median_boardings", "roll7_std_boardings", "roll28_mean_boardings", "route_code",
]
CLASS_FEATURES = [name for names in Fe.FEATURE_PROVENANCE.values() for name in names]
VIEWS["occupancy_cells"] = "SELECT route_id, date, time_band, avg(occupancy_max_pct) AS actual FROM trips_core GROUP BY 1, 2, 3"
VIEWS["occupancy_pred"] = """SELECT *, avg(actual) OVER (PARTITION BY route_id, time_band ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS predicted FROM occupancy_cells"""
VIEWS["stored_classes"] = f"""SELECT trip_id, delay_severity AS actual, CASE WHEN boardings*0.3e0 <= 5 THEN 'on time' WHEN boardings*0.3e0 <= 9 THEN 'moderate' WHEN boardings*0.3e0 <= 30 THEN 'severe' ELSE 'critical' END AS predicted,
  CASE WHEN boardings*0.2e0 <= 5 THEN 'on time' WHEN boardings*0.2e0 <= 9 THEN 'moderate' WHEN boardings*0.2e0 <= 30 THEN 'severe' ELSE 'critical' END AS adjusted FROM trips_core"""


def _matrix(pred: str) -> str:
    return f"SELECT actual, {pred} AS predicted, count(*) AS count FROM stored_classes GROUP BY 1, 2"


def _per_class(pred: str) -> str:
    return f"""SELECT label, coalesce(hit/nullif(pred, 0), 0) AS precision, hit/support AS recall, coalesce(2*(hit/nullif(pred, 0))*(hit/support)/nullif(hit/nullif(pred, 0) + hit/support, 0), 0) AS f1, support,
    support/(SELECT count(*) FROM stored_classes) AS share FROM (SELECT actual AS label, count(*) AS support, count(*) FILTER (WHERE actual = {pred}) AS hit,
    (SELECT count(*) FROM stored_classes p WHERE p.{pred} = s.actual) AS pred FROM stored_classes s GROUP BY actual)"""


def _overall(pred: str) -> str:
    return f"""SELECT CAST(sum(support) AS BIGINT) AS n, (SELECT avg(CAST(actual = {pred} AS INT)) FROM stored_classes) AS accuracy, avg(recall) AS balanced_accuracy,
    {', '.join(f'avg({c}) AS macro_{c}, sum({c}*support)/sum(support) AS weighted_{c}' for c in ('precision', 'recall', 'f1'))} FROM ({_per_class(pred)})"""


def _stored(spark, root, factor: float = 0.3):
    """Labels predicted by a fixed load rule, as a stored prediction table would hold them."""
    t = star.trips_core(spark, root)
    return t.select("trip_id", F.col("delay_severity").alias("actual"), SEVERITY.label(F.col("boardings") * X.dbl(factor)).alias("predicted"))


def _occupancy(spark, root):
    cells = star.trips_core(spark, root).groupBy(*KEYS).agg(F.avg("occupancy_max_pct").alias("actual"))
    return Fe.row_rolling_mean(cells, ["route_id", "time_band"], "date", "actual", 7, "predicted")


@query(
    "M01_chronological_split",
    """SELECT split, count(*) AS rows, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM (SELECT date, CASE WHEN date > (SELECT max(date) FROM daily_demand) - 28 THEN 'test'
    WHEN date > (SELECT max(date) FROM daily_demand) - 56 THEN 'val' ELSE 'train' END AS split FROM daily_demand) GROUP BY 1""",
)
def _(spark, root):
    out = M.with_split(frames.daily_demand(spark, root))
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(
    "M02_expanding_folds",
    " UNION ALL ".join(
        f"SELECT {i} AS fold, count(*) FILTER (WHERE date <= m - {28 * (i + 1)}) AS train_rows, count(*) FILTER (WHERE date > m - {28 * (i + 1)} AND date <= m - {28 * i}) AS val_rows FROM (SELECT date, (SELECT max(date) FROM daily_demand) AS m FROM daily_demand)"
        for i in range(3)
    ),
)
def _(spark, root):
    return M.fold_sizes(frames.daily_demand(spark, root))


@query("M03_case_sample")
def _(spark, root):
    return M.sample_cases(_occupancy(spark, root).where("predicted IS NOT NULL"), KEYS)


@query(
    "M04_regression_metrics",
    """SELECT avg(abs(actual - predicted)) AS mae, sqrt(avg(pow(actual - predicted, 2))) AS rmse, avg(abs(actual - predicted)/greatest(abs(actual), 1))*100 AS mape_pct,
    1 - sum(pow(actual - predicted, 2))/(var_pop(actual)*count(*)) AS r2, count(*) AS n FROM occupancy_pred WHERE predicted IS NOT NULL""",
)
def _(spark, root):
    return M.regression_metrics(_occupancy(spark, root).where("predicted IS NOT NULL"), "predicted", "actual")


_FILLED = ", ".join(
    f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM cells WHERE day <= last - {HORIZON + VAL})) AS {c}" for c in ("prev_week_occupancy_max", "rolling_7d_occupancy_max")
)


@query(
    "M05_train_median_imputation",
    f"""WITH found AS (SELECT *, CAST(date AS DATE) AS day FROM ({REGISTRY['F20_occupancy_features'].sql})),
    cells AS (SELECT *, max(day) OVER () AS last FROM found)
    SELECT route_id, CAST(day AS VARCHAR) AS date, time_band, {_FILLED} FROM cells WHERE day > last - {HORIZON}""",
)
def _(spark, root):
    d = Fe.occupancy_features(star.trips_core(spark, root))
    train, _, test = M.split_by_days(d, HORIZON, VAL)
    cols = ["prev_week_occupancy_max", "rolling_7d_occupancy_max"]
    filled = Mo.with_imputation(train, [test], cols)[0]
    return Mo.with_sentinel(filled, ["boardings"]).select(*KEYS, *cols)


@query("M06_dense_route_codes", "SELECT s_suppkey AS route_id, dense_rank() OVER (ORDER BY s_suppkey) - 1 AS route_code FROM supplier")
def _(spark, root):
    return M.dense_codes(star.routes(spark, root), "route_id", F.floor(F.col("route_id") / 4096))


def _demand(spark, root):
    d = frames.demand_frame(spark, root).withColumn("time_band_code", X.code_of("time_band", S.TIME_BAND_CODES))
    codes = M.dense_codes(star.routes(spark, root), "route_id", F.floor(F.col("route_id") / 4096))
    return materialise(d.join(codes, "route_id", "left").withColumn("boardings", F.col("boardings").cast("double")), "demand_frame")


def _demand_split(spark, root):
    d = _demand(spark, root)
    parts = M.split_by_days(d)
    return Mo.with_imputation(parts[0], parts, DEMAND_FEATURES)


@query("M07_linear_demand_model")
def _(spark, root):
    train, val, test = _demand_split(spark, root)
    out = Mo.select_regressor(train, val, test, DEMAND_FEATURES, "boardings", Mo.linear_candidates(), lo=0.0)
    return out.predictions.select(*KEYS, "boardings", "predicted")


@query("M08_tree_demand_model")
def _(spark, root):
    train, val, test = _demand_split(spark, root)
    out = Mo.select_regressor(train, val, test, DEMAND_FEATURES, "boardings", Mo.DEMAND_TREES, lo=0.0)
    return out.predictions.select(*KEYS, "boardings", "predicted")


@query("M09_forecast_parity")
def _(spark, root):
    train, _, test = _demand_split(spark, root)
    linear = Mo.fit_regressor(train, DEMAND_FEATURES, "boardings", Mo.linear_candidates()[2])
    tree = Mo.fit_regressor(train, DEMAND_FEATURES, "boardings", Mo.Candidate("random_forest", {"numTrees": 20, "maxDepth": 6}))
    cases = M.sample_cases(Mo.score(tree, test, 0.0).select(*KEYS, "boardings", "predicted"), KEYS)
    other = Mo.score(linear, test, 0.0).select(*KEYS, F.col("predicted").alias("linear"))
    out = cases.join(other, KEYS, "left")
    return out.withColumns({"error_tree": F.col("predicted") - F.col("boardings"), "error_linear": F.col("linear") - F.col("boardings")})


@query(
    "M10_pipeline_parity",
    f"""SELECT count(*) AS entities, round(max(abs(a - b)), 6) AS max_on_time_rate_delta, round(avg(abs(a - b)), 6) AS mean_on_time_rate_delta,
    round(max(abs(c - d)), 6) AS max_avg_delay_min_delta, round(avg(abs(c - d)), 6) AS mean_avg_delay_min_delta FROM (SELECT avg(CAST(on_time AS INT)) * 100 AS a,
    100e0 * count(*) FILTER (WHERE on_time) / count(*) AS b, avg({DELAY}) AS c, sum({DELAY}) / count(*) AS d FROM trips_core GROUP BY route_id)""",
)
def _(spark, root):
    return _parity(star.trips_core(spark, root))


@query(
    "M10_pipeline_parity_planted",
    f"""SELECT count(*) AS entities, round(max(abs(a - b)), 6) AS max_on_time_rate_delta, round(avg(abs(a - b)), 6) AS mean_on_time_rate_delta,
    round(max(abs(c - d)), 6) AS max_avg_delay_min_delta, round(avg(abs(c - d)), 6) AS mean_avg_delay_min_delta FROM (SELECT avg(CAST(on_time AS INT)) * 100 AS a,
    avg(CAST(on_time AND route_id % 7 <> 0 AS INT)) * 100 AS b, avg({DELAY}) AS c, avg({DELAY} + route_id % 3) AS d FROM trips_core GROUP BY route_id)""",
)
def _(spark, root):
    """The second computation reads rows in which some routes are never on time and some delays are longer."""
    core = star.trips_core(spark, root)
    wrong = core.withColumns({"on_time": F.col("on_time") & (F.col("route_id") % 7 != 0), DELAY: F.col(DELAY) + F.col("route_id") % 3})
    return _parity(core, wrong)


def _parity(core, other=None):
    left = core.groupBy("route_id").agg(F.avg(DELAY).alias("avg_delay_min"), (X.share(F.col("on_time")) * 100).alias("on_time_rate"))
    right = core.sparkSession.sql(
        f"""SELECT route_id, AVG({DELAY}) AS avg_delay_min, 100.0D * SUM(CASE WHEN on_time THEN 1 ELSE 0 END) / COUNT(*) AS on_time_rate
        FROM {{trips}} GROUP BY route_id""",
        trips=core if other is None else other,
    )
    out = M.parity(left, right, ["route_id"], ["on_time_rate", "avg_delay_min"])
    return out.select("entities", *[F.round(c, 6).alias(c) for c in out.columns if c != "entities"])


OCC_FEATURES = [
    "prev_week_occupancy_max", "rolling_7d_occupancy_max", "weekday", "month", "time_band_code", "is_weekend_int",
    "weekday_sin", "weekday_cos", "route_code",
]
OCC_CANDIDATES = {
    "random_forest": Mo.Candidate("random_forest", {"numTrees": 40, "maxDepth": 8, "minInstancesPerNode": 8}),
    "gradient_boosting": Mo.Candidate("gbt", {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1}),
    "linear": Mo.Candidate("linear", {}),
}


def _occ_split(spark, root):
    d = Fe.occupancy_features(star.trips_core(spark, root)).withColumn("route_code", F.col("route_id"))
    d = materialise(d, "occupancy_features")
    parts = M.split_by_days(d, HORIZON, VAL)
    train = parts[0].unionByName(parts[1])
    return Mo.with_imputation(train, [train, parts[2], d], OCC_FEATURES)


def _occ_model(spark, root, kind: str = "random_forest"):
    train, test, full = _occ_split(spark, root)
    model = Mo.fit_regressor(train, OCC_FEATURES, "occupancy_max_pct", OCC_CANDIDATES[kind])
    return model, Mo.score(model, test, 0.0, 150.0), full


@query("M11_occupancy_forecast_families")
def _(spark, root):
    train, test, _ = _occ_split(spark, root)
    out = None
    for name, cand in OCC_CANDIDATES.items():
        pred = Mo.score(Mo.fit_regressor(train, OCC_FEATURES, "occupancy_max_pct", cand), test, 0.0, 150.0)
        row = M.regression_metrics(pred, "predicted", "occupancy_max_pct")
        row = row.join(Mo.residual_bounds(pred, "occupancy_max_pct")).select(F.lit(name).alias("family"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("M12_occupancy_forecast_latest")
def occupancy_forecast(spark, root):
    model, pred, full = _occ_model(spark, root)
    out = Mo.forecast_latest(model, full, ["route_id", "time_band"], Mo.residual_bounds(pred, "occupancy_max_pct"))
    return out.select(*KEYS, "forecast_date", "occupancy_max_pct", "predicted", "lower_bound", "upper_bound", "horizon_days")


@query("M13_evaluate_saved_predictions")
def _(spark, root):
    _, pred, _ = _occ_model(spark, root)
    saved = materialise(pred.select(*KEYS, "occupancy_max_pct", "predicted"), "occupancy_predictions")
    return M.regression_metrics(M.sample_cases(saved, KEYS), "predicted", "occupancy_max_pct")


DELAY_FEATURES = [
    *[f"{s}_lag_{n}" for s in ("delay", "on_time", "p90") for n in (1, 7, 14)],
    *[f"{s}_rolling_{n}" for s in ("delay", "on_time", "p90") for n in (7, 14, 28)],
    "avg_headway_min", "headway_std_min", "headway_cv", "route_bunching_rate", "direction",
]


def _delay_split(spark, root):
    d = materialise(Fe.delay_features(star.trips(spark, root), keep=materialise), "delay_features")
    parts = M.split_by_days(d, HORIZON, VAL)
    return Mo.with_imputation(parts[0], parts, DELAY_FEATURES)


@query("M14_delay_regression_selection")
def _(spark, root):
    train, val, test = _delay_split(spark, root)
    out = Mo.select_regressor(train, val, test, DELAY_FEATURES, "avg_delay_min", Mo.DELAY_TREES, -10.0, 60.0)
    return out.predictions.select(*KEYS, "avg_delay_min", "predicted", F.lit(out.candidate.name).alias("model"))


@query("M15_predict_delay_for_day")
def delay_prediction(spark, root):
    """Every day of the test window, by the model that M14 selects."""
    train, val, test = _delay_split(spark, root)
    out = Mo.select_regressor(train, val, test, DELAY_FEATURES, "avg_delay_min", Mo.DELAY_TREES, -10.0, 60.0)
    return Mo.predict_subset(out.model, test).select(*KEYS, "avg_delay_min", "predicted")


@query(
    "M16_class_labels",
    f"""SELECT trip_id, delay_severity AS severity, CASE WHEN {DELAY} <= 5 THEN 'on time' ELSE 'delayed' END AS delay_status,
    CASE WHEN {DELAY} <= 4 THEN 'on time' WHEN {DELAY} <= 7 THEN 'minor' WHEN {DELAY} <= 12 THEN 'moderate' ELSE 'severe' END AS severity_balanced FROM trips_core""",
)
def _(spark, root):
    return star.trips_core(spark, root).select("trip_id", *[t.label(DELAY).alias(n) for n, t in M.TARGETS.items()])


@query("M17_confusion_matrix", _matrix("predicted"))
def _(spark, root):
    return M.confusion(_stored(spark, root))


@query("M17_per_class_metrics", _per_class("predicted"))
def _(spark, root):
    return M.class_metrics(M.confusion(_stored(spark, root)))


@query("M17_overall_metrics", _overall("predicted"))
def _(spark, root):
    return M.overall_metrics(M.confusion(_stored(spark, root)))


@query(
    "M19_metric_consistency",
    "SELECT * FROM (VALUES ('matrix sums to n', true), ('accuracy is trace over n', true), ('supports are row sums', true), ('macro F1 is the mean of the classes', true), ('shares sum to one', true)) t(\"check\", passed)",
)
def _(spark, root):
    m = M.confusion(_stored(spark, root))
    return M.consistency_checks(m, M.class_metrics(m), M.overall_metrics(m))


def _weights(kind: str) -> str:
    raw = "n/(4*c)" if kind == "balanced" else "sqrt(n/(4*c))"
    return f"SELECT '{kind}' AS kind, label, w/avg(w) OVER () AS weight FROM (SELECT delay_severity AS label, {raw} AS w FROM (SELECT delay_severity, count(*) AS c, (SELECT count(*) FROM trips_core) AS n FROM trips_core GROUP BY 1))"


@query("M20_class_weights", f"SELECT * FROM ({_weights('balanced')}) UNION ALL SELECT * FROM ({_weights('sqrt')})")
def _(spark, root):
    t = star.trips_core(spark, root)
    parts = [M.class_weights(t, "delay_severity", k, SEVERITY.labels).select(F.lit(k).alias("kind"), "*") for k in ("balanced", "sqrt")]
    return parts[0].unionByName(parts[1])


ROW_COLUMNS = ["trip_id", *KEYS, "is_peak", "us", DELAY]
#: What shapes the class windows and the sweep over them, besides the input files.
CLASS_SETTINGS = (S.DEFAULTS, tuple(CLASS_FEATURES), SEVERITY, HORIZON, VAL)


def _class_frame(spark, root):
    with scratch(spark) as keep:
        def build():
            return M.attach_target(frames.history(spark, root, keep).select(*ROW_COLUMNS, *CLASS_FEATURES), SEVERITY)

        return stored(spark, root, "class_frame", build, CLASS_SETTINGS)


def _matrices(windows):
    """Windows with their features as one vector, filled by the medians of the first."""
    filled = Mo.with_imputation(windows[0], windows, CLASS_FEATURES)
    return [Mo.assembled(d, CLASS_FEATURES).select(*ROW_COLUMNS, "target", "features") for d in filled]


def _class_windows(spark, root):
    frame = _class_frame(spark, root)
    return M.split_by_days(frame, HORIZON, VAL, end=M.found_last_date(frame))


def _class_split(spark, root):
    """The windows as matrices, written once for all fits and queries."""
    found = lru_cache(maxsize=1)(lambda: _matrices(_class_windows(spark, root)))  # medians are found once, if at all
    return [stored(spark, root, f"class_windows_{i}", lambda i=i: found()[i], CLASS_SETTINGS) for i in range(3)]


class ClassFold(tuple):
    """Training and validation rows of a fold; ``held`` writes their matrices for as long as its fits read them."""

    @contextmanager
    def held(self):
        with scratch(self[0].sparkSession) as keep:
            yield tuple(keep(d, "class_fold") for d in _matrices(self))


def _ranked(spark, root):
    """Every candidate ranked over three folds of the rows before the test window; kept for these inputs."""

    def build():
        train, val, _ = _class_windows(spark, root)
        before = train.unionByName(val)
        folds = M.expanding_folds(before, n_folds=3, val_days=VAL, ties=["trip_id"], end=M.found_last_date(before))
        ranked = Mo.sweep([ClassFold(f) for f in folds], CLASS_FEATURES, SEVERITY.labels, Mo.CLASSIFIERS, top=3)
        rows = [(i, c.name, f1, mean, accuracy, refits) for i, (c, f1, mean, accuracy, refits) in enumerate(ranked)]
        return spark.createDataFrame(rows, f"place int, {Mo.SWEEP_SCHEMA}").coalesce(1)

    return stored(spark, root, "class_sweep", build, (CLASS_SETTINGS, Mo.CLASSIFIERS))


def _winner_split(spark, root):
    """The candidate that M23 ranks first, and the windows."""
    best = _ranked(spark, root).where("place = 0").first().candidate
    return next(c for c in Mo.CLASSIFIERS if c.name == best), *_class_split(spark, root)


@query("M18_binary_auc")
def _(spark, root):
    status = M.TARGETS["delay_status"]
    train, _, test = _class_split(spark, root)
    train, test = (M.attach_target(d, status) for d in (train, test))
    model = Mo.fit_classifier(train, CLASS_FEATURES, status.labels, Mo.CLASSIFIERS[0])
    auc = Mo.binary_auc(model.predict(test), status.labels)
    return M.overall_metrics(M.confusion(model.predict(test), "target")).select("*", *[X.dbl(v).alias(k) for k, v in auc.items()])


@query("M21_multiclass_families")
def _(spark, root):
    train, val, _ = _class_split(spark, root)

    def matrix(c):
        pred = Mo.fit_classifier(train, CLASS_FEATURES, SEVERITY.labels, c).predict(val)
        return materialise(M.confusion(pred, "target"), "family_confusion")

    with ThreadPoolExecutor(max_workers=Mo.fits_at_once(train, CLASS_FEATURES)) as pool:
        found = list(pool.map(matrix, Mo.CLASSIFIERS))
    rows = [M.overall_metrics(m).select(F.lit(c.name).alias("candidate"), "*") for c, m in zip(Mo.CLASSIFIERS, found, strict=True)]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query("M22_ordinal_classifier")
def _(spark, root):
    train, val, _ = _class_split(spark, root)
    pred = Mo.fit_classifier(train, CLASS_FEATURES, SEVERITY.labels, Mo.CLASSIFIERS[5]).predict(val)
    return pred.select("trip_id", "target", "predicted", *[F.col("probs")[i].alias(f"p{i}") for i in range(4)])


@query("M23_candidate_sweep")
def _(spark, root):
    return _ranked(spark, root).drop("place")


@query("M24_class_multipliers")
def _(spark, root):
    winner, train, val, _ = _winner_split(spark, root)
    model = Mo.fit_classifier(train, CLASS_FEATURES, SEVERITY.labels, winner)
    probs = materialise(model.probabilities(val).select("trip_id", "target", "probs"), "val_probs")
    factors, _, _ = Mo.tune_multipliers(probs, SEVERITY.labels)
    return Mo.with_label(probs, SEVERITY.labels, factors).select("trip_id", "target", "predicted")


@query("M25_final_classifier_run")
def _(spark, root):
    winner, train, val, test = _winner_split(spark, root)
    pred, info = Mo.final_run(train, val, test, CLASS_FEATURES, SEVERITY.labels, winner, materialise)
    probs = [c for c in pred.columns if c.startswith("prob_")]
    return pred.select("trip_id", *KEYS, DELAY, "target", "predicted", "predicted_adjusted", *probs)


@query("M26_permutation_importance")
def _(spark, root):
    winner, train, val, _ = _winner_split(spark, root)
    model = Mo.fit_classifier(train, CLASS_FEATURES, SEVERITY.labels, winner)
    rows = Mo.permutation_importance(model, val, "trip_id", CLASS_FEATURES, repeats=5)
    return spark.createDataFrame(rows, Mo.IMPORTANCE_SCHEMA)


@query("M27_predict_latest_trip")
def _(spark, root):
    winner, train, _, test = _winner_split(spark, root)
    model = Mo.fit_classifier(train, CLASS_FEATURES, SEVERITY.labels, winner)
    latest = Mo.latest_rows(test, KEYS, F.col("us").desc(), F.col("trip_id").desc())
    pred = model.predict(latest)
    return pred.select("trip_id", *KEYS, "is_peak", DELAY, "target", "predicted", *[F.col("probs")[i].alias(f"p{i}") for i in range(4)])


def _clusters(spark, root):
    return Mo.cluster(Layer(spark, root)["route_metrics"], k_range=range(2, 11))


@query("M28_route_clusters")
def _(spark, root):
    out = _clusters(spark, root)
    return out.assignments.select("route_id", "cluster", F.lit(out.k).alias("k"), X.dbl(out.silhouettes[out.k]).alias("silhouette"))


@query("M29_cluster_profiles")
def _(spark, root):
    return Mo.cluster_profiles(_clusters(spark, root).assignments)


@query("P16_cluster_assignment_with_metrics")
def _(spark, root):
    out = _clusters(spark, root).assignments
    labels = Mo.cluster_profiles(out).select("cluster", F.col("label").alias("cluster_label"))
    cols = ["route_id", "route_name", "category", "cluster", "route_score", "route_class", "avg_delay_min", "on_time_share", "crowding_share"]
    return out.select(*cols).join(labels, "cluster")


VIEWS["model_versions"] = """SELECT 'v-' || CAST(c_custkey AS VARCHAR) AS version_id, c_mktsegment AS model_name, CASE WHEN c_custkey % 2 = 0 THEN 'tree' ELSE 'linear' END AS engine,
c_custkey*7919 % 100000 + 1704067200 AS trained_s, c_acctbal AS metric FROM customer"""


@query("M30_latest_version_per_model", "SELECT * FROM model_versions QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY trained_s DESC, version_id) = 1")
def _(spark, root):
    out = M.latest_versions(star.model_versions(spark, root))
    return out.select("version_id", "model_name", "engine", F.unix_seconds("trained_at").alias("trained_s"), "metric")


@query("M30_registered_versions", "SELECT * FROM model_versions WHERE engine = 'tree'")
def _(spark, root):
    """Versions registered in two batches, then listed by engine."""
    from headwise.session import shared_folder

    path, found = f"{shared_folder(spark)}/versions-{frames.unique()}", star.model_versions(spark, root)
    M.register_versions(found.where("engine = 'tree'"), path)
    M.register_versions(found.where("engine != 'tree'"), path)
    out = M.versions(spark.read.schema(found.schema).parquet(path), engine="tree")
    return out.select("version_id", "model_name", "engine", F.unix_seconds("trained_at").alias("trained_s"), "metric")


@query("M31_aligned_probabilities")
def _(spark, root):
    winner, train, val, _ = _winner_split(spark, root)
    model = Mo.fit_classifier(train, CLASS_FEATURES, SEVERITY.labels, winner)
    probs = model.probabilities(val)
    return probs.select("trip_id", *[F.col("probs")[i].alias(v.replace(" ", "_")) for i, v in enumerate(SEVERITY.labels)])


@query(
    "M32_metrics_from_stored_predictions",
    f"SELECT 'plain' AS kind, * FROM ({_overall('predicted')}) UNION ALL SELECT 'adjusted', * FROM ({_overall('adjusted')})",
)
def _(spark, root):
    parts = [
        M.overall_metrics(M.confusion(_stored(spark, root, f))).select(F.lit(k).alias("kind"), "*") for k, f in (("plain", 0.3), ("adjusted", 0.2))
    ]
    return parts[0].unionByName(parts[1])


@query("M33_saved_metrics_table")
def _(spark, root):
    from headwise.session import shared_folder

    base = f"{shared_folder(spark)}/metrics-{frames.unique()}"
    pred = _occupancy(spark, root).where("predicted IS NOT NULL")
    M.regression_metrics(pred, "predicted", "actual").write.json(f"{base}/occupancy")
    M.overall_metrics(M.confusion(_stored(spark, root))).write.json(f"{base}/severity")
    return M.metrics_table(spark, {"occupancy": f"{base}/occupancy", "severity": f"{base}/severity"})


