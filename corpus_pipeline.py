"""Stages of corpus preparation, each written as Parquet and read again before the next.

Every stage takes any rows of ``documents``: nulls, empty and very long texts, repeated rows and further columns are
treated as its operator says; all but the last keep the columns they get.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise.llm import ngram_join, packing, pii, quality, toxicity
from headwise.llm.common import fresh, read_table, written
from headwise.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the rejection score go; all stay where the labels train no network.

    Null and empty texts have the score of a window without words and stay where that is below the rejection score;
    whole texts are scored, however long; equal texts score alike, so repeated rows stay or go together.
    """
    (score,) = fresh(docs, "score")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    if model.network is None:  # labels of both classes are missing: the score would be one number for all
        return docs
    return toxicity.score(docs, model, score_col=score).where(F.col(score) < toxicity.REJECT).drop(score)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of being good is too small go; all stay where the labels train no classifier.

    Null and empty texts have their site's rate; null sources and languages are sites of their own; repeated rows count
    as often as they occur and stay or go together.
    """
    labels = read_table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels)
    if model.weights is None:  # labels of both classes are missing: rates of sites would follow one class
        return docs
    names = tuple(fresh(docs, "evidence", "site_rate", "quality"))
    scored = quality.posterior(docs, labels, classifier=model, names=names)
    return scored.where(F.col(names[2]) >= quality.KEEP).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies stays, that of the smallest id; of equal rows one.

    Null and empty texts are copies of one another; null ids come last.
    """
    return ngram_join.one_of_each_class(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the names of their kinds; n_chars follows the text, and stays where it is null."""
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = dict(docs.dtypes)["n_chars"]
    length = F.coalesce(F.char_length("text").cast(kind), F.col("n_chars"))
    return clean.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full windows, with their token ids; a null or empty text is its end id alone, repeated rows are packed as they are."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

#: Trained models and tokenizers cannot be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
