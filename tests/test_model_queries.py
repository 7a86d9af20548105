"""The model queries try every candidate, fold, feature and repeat, and carry the winner on."""

import uuid

import pytest
from pyspark.sql import functions as F

from headwise.operators import features as Fe
from headwise.operators import models as Mo
from headwise.plans import model_queries
from headwise.plans.catalog import load

FEATURES = [f for names in Fe.FEATURE_PROVENANCE.values() for f in names]


class Stopped(Exception):
    pass


@pytest.fixture(scope="module")
def frame(spark, small):
    return model_queries._class_frame(spark, small)


def test_sweep_tries_everything_and_the_winner_is_carried(spark, small, frame, monkeypatch):
    seen, winner = {}, Mo.CLASSIFIERS[5]

    def sweep(folds, features, labels, candidates=Mo.CLASSIFIERS, top=3):
        seen.update(folds=folds, features=list(features), candidates=tuple(candidates), top=top)
        return [(winner, 0.5, 0.5, 0.5, 2)]

    def fit(train, features, labels, candidate):
        seen.update(fitted=candidate, used=list(features))
        raise Stopped

    monkeypatch.setattr(model_queries, "_class_frame", lambda spark, root: frame)
    monkeypatch.setattr(model_queries, "CLASS_SETTINGS", uuid.uuid4().hex)  # nothing that is kept here serves another test
    monkeypatch.setattr(Mo, "sweep", sweep)
    monkeypatch.setattr(Mo, "fit_classifier", fit)
    assert load()["M23_candidate_sweep"].build(spark, small).first().candidate == winner.name
    assert len(FEATURES) == 48 and seen["features"] == FEATURES
    assert seen["candidates"] == Mo.CLASSIFIERS and seen["top"] == 3 and len(seen["folds"]) == 3
    last = frame.agg(F.max("date")).first()[0]
    newest = max(v.agg(F.max("date")).first()[0] for _, v in seen["folds"])
    assert (last - newest).days == model_queries.HORIZON
    for name in ("M24_class_multipliers", "M25_final_classifier_run", "M26_permutation_importance", "M27_predict_latest_trip", "M31_aligned_probabilities"):
        seen["fitted"] = None
        with pytest.raises(Stopped):
            load()[name].build(spark, small)
        assert seen["fitted"] == winner and seen["used"] == FEATURES, name


def test_importance_of_every_feature(spark, small, frame, monkeypatch):
    seen = {}

    def importance(model, df, key, features, repeats=5):
        seen.update(features=list(features), repeats=repeats)
        return [(f, 0.0, 0.0) for f in features]

    monkeypatch.setattr(model_queries, "_class_frame", lambda spark, root: frame)
    monkeypatch.setattr(model_queries, "CLASS_SETTINGS", uuid.uuid4().hex)
    monkeypatch.setattr(Mo, "CLASSIFIERS", (Mo.Candidate("logistic", {"maxIter": 2}),))
    monkeypatch.setattr(Mo, "sweep", lambda *a, **k: [(Mo.CLASSIFIERS[0], 0.5, 0.5, 0.5, 2)])
    monkeypatch.setattr(Mo, "permutation_importance", importance)
    assert load()["M26_permutation_importance"].build(spark, small).count() == 48
    assert seen == {"features": FEATURES, "repeats": 5}
