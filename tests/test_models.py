import math

import pytest
from pyspark.sql import functions as F

from headwise.operators import metrics as M
from headwise.operators import models as Mo


def test_class_weights_order(spark):
    df = spark.createDataFrame([("a",)] * 100 + [("b",)] * 20 + [("c",)] * 5, "y string")
    w = {k: {r["label"]: r["weight"] for r in M.class_weights(df, "y", k, "abc").collect()} for k in ("balanced", "sqrt", "none")}
    assert w["balanced"]["c"] > w["sqrt"]["c"] > w["sqrt"]["a"] > w["balanced"]["a"] > 0
    assert set(w["none"].values()) == {1.0}
    assert sum(w["balanced"].values()) / 3 == pytest.approx(1.0)


def test_splits_do_not_overlap(spark):
    df = spark.range(100).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    train, val, test = M.split_by_days(df)
    assert (train.count(), val.count(), test.count()) == (44, 28, 28)
    assert train.agg(F.max("date")).first()[0] < val.agg(F.min("date")).first()[0]
    assert val.agg(F.max("date")).first()[0] < test.agg(F.min("date")).first()[0]
    folds = M.expanding_folds(df, n_folds=2, train_cap=10)
    assert [f[1].count() for f in folds] == [28, 28] and folds[0][0].count() == 10


def pairs(spark):
    rows = [("a", "a")] * 50 + [("a", "b")] * 10 + [("b", "b")] * 20 + [("b", "c")] * 5 + [("c", "a")] * 3
    return spark.createDataFrame(rows, "actual string, predicted string")


def test_metrics_agree_with_the_matrix(spark):
    m = M.confusion(pairs(spark))
    per, overall = M.class_metrics(m), M.overall_metrics(m)
    assert all(r["passed"] for r in M.consistency_checks(m, per, overall).collect())
    o = overall.first()
    assert o["n"] == 88 and o["accuracy"] == pytest.approx(70 / 88)
    assert {r["label"]: r["support"] for r in per.collect()} == {"a": 60, "b": 25, "c": 3}


def test_planted_errors_are_found(spark):
    m = M.confusion(pairs(spark))
    per, overall = M.class_metrics(m), M.overall_metrics(m)
    wrong = overall.withColumn("accuracy", F.lit(0.99))
    assert not all(r["passed"] for r in M.consistency_checks(m, per, wrong).collect())
    moved = per.withColumn("support", F.col("support") + 1)
    assert not all(r["passed"] for r in M.consistency_checks(m, moved, overall).collect())


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0)], "p double, a double")
    r = M.regression_metrics(df, "p", "a").first()
    assert r["mae"] == pytest.approx(2 / 3) and r["rmse"] == pytest.approx(math.sqrt(2 / 3)) and r["n"] == 3


def test_sample_covers_every_route_first(spark):
    df = spark.range(200).select((F.col("id") % 20).alias("route_id"), "id")
    a = M.sample_cases(df, ["id"], n=50)
    assert a.count() == 50 and a.select("route_id").distinct().count() == 20
    assert sorted(r["id"] for r in a.collect()) == sorted(r["id"] for r in M.sample_cases(df.repartition(3), ["id"], n=50).collect())


def test_latest_version(spark):
    rows = [("1", "a", "x", 1), ("2", "a", "y", 3), ("3", "b", "x", 2)]
    df = spark.createDataFrame(rows, "version_id string, model_name string, engine string, trained_at long")
    assert {r["version_id"] for r in M.latest_versions(df).collect()} == {"2", "3"}
    assert M.versions(df, "a").count() == 2 and M.version(df, "3").first()["model_name"] == "b"
    assert M.latest_versions(df, engine="x").where("model_name = 'a'").first()["version_id"] == "1"


@pytest.fixture(scope="module")
def labelled(spark):
    df = spark.range(900).select("id", (F.col("id") % 30).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"))
    label = F.when(F.col("x") < 10, "low").when(F.col("x") < 20, "mid").otherwise("high")
    return df.withColumn("target", label).cache()


@pytest.mark.parametrize("candidate", [Mo.CLASSIFIERS[0], Mo.Candidate("random_forest", {"numTrees": 5, "maxDepth": 4}), Mo.Candidate("ordinal", {"maxIter": 3}), Mo.Candidate("boosted", {"maxIter": 3})], ids=lambda c: c.family)
def test_classifiers_give_ordered_probabilities(labelled, candidate):
    labels = ("low", "mid", "high")
    out = Mo.fit_classifier(labelled, ["x", "z"], labels, candidate).predict(labelled)
    rows = out.select("target", "predicted", "probs").collect()
    assert all(abs(sum(r["probs"]) - 1) < 1e-6 and min(r["probs"]) >= 0 for r in rows)
    assert sum(r["target"] == r["predicted"] for r in rows) / len(rows) > 0.8


def test_multipliers_and_importance(spark, labelled):
    labels = ("low", "mid", "high")
    model = Mo.fit_classifier(labelled, ["x", "z"], labels, Mo.Candidate("random_forest", {"numTrees": 5, "maxDepth": 3}))
    factors, before, after = Mo.tune_multipliers(model.probabilities(labelled), labels, grid=(0.5, 1.0, 2.0), rounds=1)
    assert after >= before and len(factors) == 3
    rows = Mo.permutation_importance(model, labelled, "id", ["x", "z"], repeats=1)
    assert rows[0][0] == "x" and rows[0][1] > rows[1][1]


def test_donors_permute_all_rows_in_every_repeat(labelled):
    rows = labelled.select("id", F.array("x", "z").alias("v"))
    got = Mo.with_donors(rows, "id", 3, 4, "v").collect()
    values = sorted(tuple(r.v) for r in rows.collect())
    for turn in range(3):
        of = [r for r in got if r["_r"] == turn]
        assert sorted(tuple(r["_donor"]) for r in of) == values and sorted(r.id for r in of) == list(range(900))
    assert any(a["_donor"] != b["_donor"] for a, b in zip(*(sorted((r for r in got if r["_r"] == t), key=lambda r: r.id) for t in (0, 1)), strict=True))


def test_importance_equals_one_shuffled_column_at_a_time(spark, labelled):
    labels, features = ("low", "mid", "high"), ["x", "z", "c"]
    df = labelled.withColumn("c", F.lit(3.0))
    model = Mo.fit_classifier(df, features, labels, Mo.Candidate("random_forest", {"numTrees": 5, "maxDepth": 3}))
    got = {f: (mean, std) for f, mean, std in Mo.permutation_importance(model, df, "id", features, repeats=2, rows_per_bucket=300)}
    base = Mo.classification_scores(model.predict(df))["macro_f1"]
    donors = {(r.id, r["_r"]): r["_donor"] for r in Mo.with_donors(df.select("id", F.array(*features).alias("v")), "id", 2, 3, "v").collect()}
    rows = df.select("id", "target", *features).collect()
    for i, f in enumerate(features):
        drops = []
        for turn in range(2):
            shuffled = spark.createDataFrame([(r.id, r.target, *[donors[r.id, turn][i] if g == f else r[g] for g in features]) for r in rows], f"id long, target string, {', '.join(f'{g} double' for g in features)}")
            drops.append(base - Mo.classification_scores(model.predict(shuffled))["macro_f1"])
        mean = sum(drops) / 2
        assert got[f] == pytest.approx((mean, (sum((d - mean) ** 2 for d in drops) / 2) ** 0.5), abs=1e-9)
    assert got["c"] == (0.0, 0.0) and got["x"][0] > 0.1
    assert Mo.permutation_importance(model, df.limit(0), "id", features) == []


def test_clusters(spark):
    rows = [(i, float(i % 2) * 100 + i % 5, float(i % 2) * 3) for i in range(40)]
    df = spark.createDataFrame(rows, "route_id long, passengers double, avg_delay_min double")
    out = Mo.cluster(df, k_range=range(2, 4))
    assert out.k == 2 and out.silhouettes[2] == max(out.silhouettes.values())
    profiles = Mo.cluster_profiles(out.assignments).collect()
    assert sum(r["n_routes"] for r in profiles) == 40 and all(r["label"].startswith("Cluster ") for r in profiles)
    assert Mo.cluster_members(out.assignments, 0).count() == 20
