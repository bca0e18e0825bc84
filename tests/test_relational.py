"""Joins over time, windows, rules and summaries against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import relational as R


def test_asof_against_brute_force(spark):
    rng = random.Random(2)
    left = [(n, rng.choice(["hot", "a", None]), rng.randint(0, 400) if n % 17 else None) for n in range(500)]
    right = [(rng.choice(["hot", "a", "b"]), rng.randint(0, 400), rng.randint(0, 9)) for _ in range(60)]
    a, b = spark.createDataFrame(left, "n int, k string, t int"), spark.createDataFrame(right, "k string, s int, v int")
    for bucket in (1, 7, 1000):
        got = {r.n: r.v for r in R.asof_backward(a, b, ["k"], "t", "s", ["v"], bucket).collect()}
        for n, k, t in left:
            hits = [(s, v) for kk, s, v in right if kk == k and t is not None and s <= t]
            assert got[n] == (max(hits)[1] if hits else None)


def test_intervals_against_brute_force(spark):
    rng = random.Random(3)
    pts = [(n, rng.randint(0, 99)) for n in range(200)]
    ivs = [(m, a, a + rng.randint(-2, 30)) for m in range(15) for a in [rng.randint(0, 90)]] + [(99, None, 5)]
    p, i = spark.createDataFrame(pts, "n int, at int"), spark.createDataFrame(ivs, "m int, lo int, hi int")
    got = sorted((r.n, r.m) for r in R.within_intervals(p, i, [], "at", "lo", "hi", 10).collect())
    assert got == sorted((n, m) for n, t in pts for m, a, b in ivs if a is not None and a <= t <= b)


def test_rules(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (4, None), (None, "a")], "o int, i string")
    got = {(r.antecedent, r.consequent): (r.pair_count, r.support, r.confidence, r.lift) for r in R.rules(df, "o", "i").collect()}
    assert got == {("a", "b"): (2, pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(1.0)), ("b", "a"): (2, pytest.approx(2 / 3), 1.0, pytest.approx(1.0))}
    assert R.rules(df.limit(0), "o", "i").count() == 0


def test_percent_rank_keeps_nulls_in_the_population(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "id int, v int")
    assert {r.id: r.p for r in R.percent_rank(df, "v", "p").collect()} == {1: None, 2: 0.5, 3: 1.0}


def test_fingerprint_doesn_t_depend_on_order(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    a = R.fingerprint(df, ["id", "v"]).collect()
    assert a == R.fingerprint(df.repartition(5).orderBy(F.desc("id")), ["id", "v"]).collect()
    assert a != R.fingerprint(df.withColumn("v", F.col("v") + 1), ["id", "v"]).collect()


def test_profile_and_cohorts(spark):
    df = spark.createDataFrame([("a", None), ("a", " "), (None, "x")], "p string, q string")
    assert {(r.column_name, r.rows, r.blank, r.distinct) for r in R.profile(df, ["p", "q"]).collect()} == {("p", 3, 1, 1), ("q", 3, 2, 2)}
    ev = spark.createDataFrame([(1, dt.date(2025, 1, 3)), (1, dt.date(2025, 3, 1)), (2, dt.date(2025, 1, 9)), (None, dt.date(2025, 1, 9))], "c int, d date")
    assert {(r.cohort, r.offset, r.active, r.retention_pct) for r in R.cohorts(ev, "c", "d").collect()} == {("2025-01", 0, 2, 100.0), ("2025-01", 2, 1, 50.0)}


def test_overlaps_and_dedupe(spark):
    iv = spark.createDataFrame([("a", 1, 5), ("a", 4, 6), ("a", 7, 9), ("b", 5, 6)], "k string, s int, e int")
    assert [(r.s, r.latest_end) for r in R.overlaps(iv, ["k"], "s", "e").collect()] == [(4, 5)]
    assert R.dedupe(iv, ["k"], [F.asc("s")]).count() == 2


def test_error_metrics(spark):
    df = spark.createDataFrame([("m", 0.0, 1.0), ("m", 2.0, 1.0), ("m", 4.0, -3.0), ("m", None, 1.0)], "g string, a double, p double")
    r = R.error_metrics(df, "a", "p", ["g"]).first()
    assert (r.n, r.mae, r.mape) == (3, 2.0, 75.0)


def test_tiles_are_ntile(spark):
    from pyspark.sql import Window

    rng = random.Random(4)
    for size in (0, 1, 3, 4, 5, 23, 300):
        df = spark.createDataFrame([(f"k{i}", rng.randint(0, 6), rng.randint(-5, 1000)) for i in range(size)], "k string, a int, b int")
        want = df.withColumns({"x": F.ntile(5).over(Window.orderBy("a", "k")), "y": F.ntile(5).over(Window.orderBy(F.desc("b"), "k"))})
        got = R.tiles(df, "k", {"x": F.col("a"), "y": -F.col("b")}, 5)
        rows = lambda d: {(r.k, r.x, r.y) for r in d.collect()}
        assert rows(got) == rows(want) and got.count() == size


def test_exact_percentile(spark):
    rng = random.Random(6)
    rows = [(k, rng.randint(-200, 5000) if rng.random() < 0.9 else None) for k in ("a", "b", None) for _ in range(rng.randint(1, 400))] + [("one", 7), ("tie", 3), ("tie", 3), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    for p in (0.0, 0.25, 0.5, 0.995, 1.0):
        want = {r.k: r.p for r in df.where("v is not null").groupBy("k").agg(F.percentile("v", F.lit(p)).alias("p")).collect()}
        for bucket in (1, 100, 10**6):
            got = {r.k: r.percentile for r in R.exact_percentile(df, ["k"], "v", p, bucket).collect()}
            assert {k: v for k, v in got.items() if k is not None} == pytest.approx({k: v for k, v in want.items() if k is not None})


def test_grid_refuses_a_large_second_set(spark):
    assert R.grid(spark.range(3), spark.range(4).toDF("b")).count() == 12
    assert R.grid(spark.range(3), spark.range(0).toDF("b")).count() == 0
    with pytest.raises(Exception, match="more than"):
        R.grid(spark.range(3), spark.range(R.GRID + 1).toDF("b")).collect()


def test_sales_reads_only_what_is_asked_for(spark, folder):
    from tessera.plans import star

    def scans(*columns):
        plan = star.sales(spark, folder, *columns)._jdf.queryExecution().executedPlan().toString()
        return {n for n in ("lineitem", "orders", "part", "customer", "nation", "region") if f"/{n}.parquet" in plan}

    assert scans("channel", "qty") == {"lineitem", "orders"}
    assert scans("brand", "profit4") == {"lineitem", "orders", "part"}
    assert scans("location") == {"lineitem", "orders", "customer", "nation", "region"}
