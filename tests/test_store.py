import pytest
from pyspark.sql import functions as F

from headwise.operators import rollups as P
from headwise.plans.run import run_steps
from headwise.sources import store


@pytest.mark.parametrize("ext", ["parquet", "csv", "jsonl"])
def test_round_trip(spark, tmp_path, ext):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", None)], "k long, s string, x double")
    path = store.write_dataset(df, f"{tmp_path}/d.{ext}")
    assert sorted(store.read_dataset(spark, path, df.schema).collect()) == sorted(df.collect())


def test_unknown_format_and_area(spark):
    with pytest.raises(ValueError, match="Unsupported"):
        store.read_dataset(spark, "x.xlsx")
    with pytest.raises(ValueError, match="Unknown area"):
        store.area_uri("hdfs://host/base", "elsewhere")
    assert store.area_uri("hdfs://host/base/", "raw", "trips") == "hdfs://host/base/raw/trips.parquet"


def test_times_go_to_micros_and_back(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",), ("nope",)], "s string")
    ts = df.select(store.to_timestamp(df, "s").alias("t"))
    back = store.times_to_micros(ts)
    again = back.select(store.to_timestamp(back, "t").alias("t"))
    assert sorted(map(str, again.collect())) == sorted(map(str, ts.collect()))


def test_export_flattens_and_filters(spark, tmp_path):
    df = spark.range(4).select("id", F.when(F.col("id") > 1, "new").otherwise("resolved").alias("status"), F.create_map(F.lit("a"), F.lit(1.0)).alias("evidence"))
    path = store.export(df, f"{tmp_path}/alerts.csv", status=["new"], one_file=True)
    back = spark.read.csv(path, header=True).collect()
    assert len(back) == 2 and back[0]["evidence"] == '{"a":1.0}'
    assert store.with_status(df, None).count() == 4


def test_broken_log_lines_are_dropped(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"ts": 1, "x": 2.0}\n{oops\n{"ts": 3, "x": 4.0}\n')
    log = store.read_log(spark, f"{tmp_path}/m.jsonl", "ts long, x double")
    assert [r["ts"] for r in store.latest(log, "ts", 1).collect()] == [3]


def test_sample_is_stable(spark):
    df = spark.range(20_000)
    a = store.development_sample(df, ["id"], full=False, percent=5)
    assert 800 < a.count() < 1200 and store.development_sample(df, ["id"]).count() == 20_000
    assert a.exceptAll(store.development_sample(df.repartition(9), ["id"], full=False, percent=5)).count() == 0


def test_failing_step_is_isolated_and_logged(spark, tmp_path):
    def broken():
        raise RuntimeError("no input")

    steps = {"a": lambda: spark.range(3), "b": broken, "c": lambda: spark.range(1)}
    log = run_steps(spark, steps, lambda n, d: d, skip=["c"])
    got = {r["action"]: (r["status"], r["details"]) for r in log.collect()}
    assert got["analytics:a"] == ("ok", "rows=3")
    assert got["analytics:b"][0] == "failed" and "no input" in got["analytics:b"][1]
    assert got["analytics:c"][0] == "skipped"
    P.append_log(log, f"{tmp_path}/log")
    P.append_log(log, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 6
