"""Streams give what the same rows give as a table."""

import pytest
from pyspark.sql import functions as F

from tessera.streaming import windows


@pytest.fixture(scope="module")
def source(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("events") / "in")
    e = spark.read.parquet(f"{folder}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    e.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(out)
    return e, out


def drain(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_windows(spark, source):
    e, path = source
    got = drain(windows.windowed(windows.read_events(spark, path, 100)), spark, "w", "complete").select("started", "event_type", "events").collect()
    want = e.groupBy(F.window("ts", "1 day").start.alias("started"), "event_type").agg(F.count("*").alias("events")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_sessions_and_first_deliveries(spark, source):
    e, path = source
    got = drain(windows.sessions(windows.read_events(spark, path, 100)), spark, "s", "complete")
    assert got.agg(F.sum("events")).first()[0] == e.count()
    again = windows.read_events(spark, path, 100)
    once = drain(windows.first_deliveries(again.unionByName(windows.read_events(spark, path, 100)), late="60 days"), spark, "d")
    assert once.count() == e.select("event_id").distinct().count()


def test_baseline(spark, source):
    e, path = source
    got = drain(windows.running_baseline(windows.read_events(spark, path, 1)), spark, "b")
    assert got.count() < e.count() * 0.2
    assert got.where("abs(value - baseline) = 0").count() == 0


def test_baseline_of_one_hot_type(spark, tmp_path):
    """A single type is shared by several lanes; what sticks out is found in each."""
    rows = spark.range(4000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"), F.col("id").alias("user_id"), F.lit("hot").alias("event_type"),
        F.when(F.col("id") % 1000 == 999, 500.0).when(F.col("id") % 97 == 0, None).otherwise(10.0 + F.col("id") % 5).alias("value"), F.lit("{}").alias("props"),
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drain(windows.running_baseline(windows.read_events(spark, str(tmp_path / "in")), times=8.0), spark, "hot")
    assert {r.event_id for r in got.collect()} == {999, 1999, 2999, 3999}
