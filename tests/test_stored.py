"""Stored tables are reused for the same inputs and built again for changed ones."""

import shutil

from headwise.plans import frames
from headwise.plans.catalog import load
from headwise.plans.stored import input_files, stored


def test_kept_until_an_input_or_a_setting_changes(spark, tmp_path):
    root, built = str(tmp_path), []
    spark.range(5).write.parquet(f"{root}/orders.parquet")

    def build():
        built.append(1)
        return spark.read.parquet(f"{root}/orders.parquet").selectExpr("id + 1 AS n")

    def rows(settings=None):
        return sorted(r.n for r in stored(spark, root, "test", build, settings).collect())  # root is new for each run

    assert rows() == rows() == [1, 2, 3, 4, 5] and len(built) == 1
    rows(settings=("other", 1))
    assert len(built) == 2
    spark.range(2).write.mode("append").parquet(f"{root}/orders.parquet")
    assert rows() == [1, 1, 2, 2, 3, 4, 5] and len(built) == 3
    assert len(input_files(spark, root, ("orders", "missing"))) > 1


def test_decisions_read_what_an_earlier_call_wrote(spark, small, tmp_path, monkeypatch):
    root, built = str(tmp_path / "sf"), []
    shutil.copytree(small, root)
    build = frames.Layer._build
    monkeypatch.setattr(frames.Layer, "_build", lambda self, name: built.append(name) or build(self, name))
    first = sorted(map(tuple, load()["D10_alert_counts"].build(spark, root).collect()))
    assert set(frames.DECISION_TABLES) <= set(built)
    built.clear()
    assert sorted(map(tuple, load()["D10_alert_counts"].build(spark, root).collect())) == first and not built
    load()["K07_executive_kpis"].build(spark, root).collect()
    assert set(built) <= {"daily_demand"}  # all else is there
    orders = spark.read.parquet(f"{small}/orders.parquet")
    orders.limit(max(1, orders.count() // 2)).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/less")
    shutil.rmtree(f"{root}/orders.parquet", ignore_errors=True)
    (tmp_path / "sf" / "orders.parquet").unlink(missing_ok=True)
    shutil.copytree(f"{tmp_path}/less", f"{root}/orders.parquet")
    built.clear()
    load()["D10_alert_counts"].build(spark, root).collect()
    assert set(frames.DECISION_TABLES) <= set(built)
