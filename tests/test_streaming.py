"""Streams give what the batch form gives, whatever the triggers."""

import pytest
from pyspark.sql import functions as F

from playledger.operators import windows
from playledger.streaming import pipelines


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(u, i, f"{i:04d}", (u + i) % 3 == 0, float(i)) for i in range(30) for u in range(3)]
    df = spark.createDataFrame(rows, "u int, i int, place string, done boolean, v double")
    for part in range(3):
        df.where(f"i >= {part * 10} and i < {part * 10 + 10}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in", df


def test_sessions_equal_batch(spark, folder):
    path, df = folder
    s = pipelines.files(spark, path, df.schema, per_trigger=10)
    got = {tuple(r) for r in pipelines.run_to_end(pipelines.closed_sessions(s, "u", "place", "done", "v")).collect()}
    w = windows.ordered(["u"], ["i"])
    b = df.withColumn("session", windows.closed_islands(F.col("done"), w)).groupBy("u", "session").agg(F.count("*").alias("n"), F.sum("v").alias("t"), F.max("done").alias("d")).where("d")
    assert got == {(r.u, r.session, r.n, r.t) for r in b.collect()}


def test_filter_state_outlives_triggers(spark, folder):
    path, df = folder

    def run(per):
        s = pipelines.files(spark, path, df.schema, per_trigger=per)
        return {(r.u, r.place): (round(r.mean, 9), round(r.var, 9)) for r in pipelines.run_to_end(pipelines.filter_states(s, "u", "place", "v", prior_var=1.0, q=0.1, r=1.0)).collect()}

    assert run(10) == run(10) and len(run(10)) == df.count()


def test_fence(spark):
    df = spark.createDataFrame([(1, 2), (2, 2), (3, 2)], "sent int, tip int")
    assert [r.sent for r in pipelines.before_fence(df, "sent", "tip").collect()] == [1]
