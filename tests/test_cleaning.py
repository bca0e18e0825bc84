"""Rules, references and small helpers of cleaning."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import cleaning as C


def test_first_reason_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (-1, "a"), (None, "a"), (1, None)], "n int, s string")
    rules = [("n below 0", F.col("n") >= 0), ("no s", F.col("s").isNotNull())]
    assert [r[0] for r in df.select(C.first_reason(rules)).collect()] == [None, "n below 0", "n below 0", "no s"]


def test_parents(spark):
    child = spark.createDataFrame([(1, " p1"), (2, "P2"), (3, None), (4, "unknown"), (5, "P9")], "n int, ref string")
    parent = spark.createDataFrame([("P1", "x"), ("p1 ", "y"), ("P2", "z"), (None, "w")], "id string, n string")
    assert {r.n: r.hit for r in C.with_parent(child, "ref", parent, "id", "hit").collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert {r.n: r.ref for r in C.null_missing(child, "ref", parent, "id").collect()} == {1: " p1", 2: "P2", 3: None, 4: None, 5: None}
    joined = C.prefixed_join(child, "ref", parent, "id", "p")
    assert joined.columns == ["n", "ref", "p__id", "p__n"] and joined.count() == 5


def test_first_filled(spark):
    df = spark.createDataFrame([(" ", "b"), ("a", "b"), (None, "")], "x string, y string")
    assert [r[0] for r in df.select(C.first_filled("x", "y")).collect()] == ["b", "a", None]


def test_cramers_v(spark):
    same = spark.createDataFrame([(k % 3, k % 3) for k in range(90)], "a int, b int")
    assert C.cramers_v(same, "a", "b").first().v == pytest.approx(1.0)
    free = spark.createDataFrame([(i, j) for i in range(4) for j in range(5)], "a int, b int")
    assert C.cramers_v(free, "a", "b").first().v == pytest.approx(0.0, abs=1e-9)
    assert C.cramers_v(spark.createDataFrame([(1, 1), (1, 2)], "a int, b int"), "a", "b").first().v is None
