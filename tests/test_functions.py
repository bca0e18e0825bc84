"""Keys, days, numbers, units."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import arith, keys, quantity
from tessera.functions.calendar import real_day


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize(("raw", "want"), [(" r001\t", "R001"), (" m0002　", "M0002"), ("unknown", None), ("-", None), ("", None), (None, None), ("C0\n", "C0")])
def test_keys(spark, raw, want):
    assert one(spark, keys.key_or_null("x"), raw) == want


def test_earliest_keeps_the_first_delivery_and_drops_null_keys(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", None, "untimed"), ("b", 9, "timed"), (None, 1, "x")], "k string, loaded_at int, v string")
    assert {(r.k, r.v) for r in keys.earliest(df, "k", ["v"]).collect()} == {("a", "first"), ("b", "timed")}
    assert keys.earliest(df.limit(0), "k", ["v"]).count() == 0


@pytest.mark.parametrize(
    ("raw", "want"),
    [("2025-03-09", "2025-03-09"), ("2025-03-09 00:00:00", "2025-03-09"), ("3/9/2025", "2025-03-09"), ("11/31/2025", None), ("2025-02-30", None), ("soon", None), ("", None), (None, None), ("09.03.2025", "2025-03-09"), ("2025/3/9", "2025-03-09")],
)
def test_real_day(spark, raw, want):
    assert str(one(spark, real_day("x"), raw)) == str(want)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("12", 12.0), (" 9.1 ", 9.1), ("8,3", 8.3), ("44,300", 44300.0), ("0,333", 0.333), ("1.234,5", 1234.5), ("1,234.5", 1234.5), ("-99", -99.0), ("7.10", 7.1), ("N/A", None), ("#REF!", None), ("--", None), ("", None), (None, None), ("9800millilitres", 9800.0), ("3 doz.", 3.0), ("1'200 g", 1200.0)],
)
def test_numbers(spark, raw, want):
    assert one(spark, quantity.to_number(quantity.number_text("x")), raw) == want


CELLS = [*"12| 9.1 |8,3|44,300|0,333|1.234,5|1,234.5|-99|7.10|N/A|#REF!|--||9800millilitres|3 doz.|1'200 g|5 (US)|9,9 gal (US)|33.5 pair|x 5|5 x|1.2.3|1,2,3|+4|.5|5.|1e6|NaN".split("|"), None, "\u00a012\u00a0kg ", "1\u202f200 ml"]
LABELS = ["kg.", "Gram", "25 kg sack", "bag (10 kg)", "750ml btl", "btl (0.75 L)", "US gal", "tray of 24", "24-pc tray", "dz", "-", "", None, "gallop", "tray", " KG ", "Sack 2,5 Kg", "case 12"]


def test_python_reads_as_spark_does(spark):
    df = spark.createDataFrame([(c,) for c in CELLS], "x string")
    own = quantity.unit_text("x")
    rows = df.select("x", quantity.to_number(quantity.number_text("x")).alias("n"), F.when(F.length(own) > 0, quantity.unit_of(own)).alias("u")).collect()
    for r in rows:
        assert quantity.read_cell(r.x) == (r.n, r.u and r.u.dim, r.u and r.u["size"]), r.x
    for r in spark.createDataFrame([(c,) for c in LABELS], "x string").select("x", quantity.unit_of("x").alias("u")).collect():
        assert quantity.read_unit(r.x) == ((r.u.dim, pytest.approx(r.u["size"])) if r.u else (None, None)), r.x


@given(st.decimals(min_value=0, max_value=999_999, places=2))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_numbers_survive_any_notation(spark, d):
    plain, grouped = f"{d:.2f}", f"{d:,.2f}"
    comma = grouped.replace(",", "'").replace(".", ",")
    df = spark.createDataFrame([(plain,), (grouped,), (comma,)], "x string")
    assert {r[0] for r in df.select(quantity.to_number("x")).collect()} == {float(d)}


@pytest.mark.parametrize(
    ("raw", "want"),
    [("kg.", ("weight", 1.0)), ("Gram", ("weight", 0.001)), ("25 kg sack", ("weight", 25.0)), ("bag (10 kg)", ("weight", 10.0)), ("750ml btl", ("volume", 0.75)), ("btl (0.75 L)", ("volume", 0.75)), ("US gal", ("volume", 3.785411784)), ("tray of 24", ("count", 24.0)), ("24-pc tray", ("count", 24.0)), ("dz", ("count", 12.0)), ("-", None), ("", None), (None, None), ("gallop", None)],
)
def test_units(spark, raw, want):
    got = one(spark, quantity.unit_of("x"), raw)
    assert (got and (got.dim, pytest.approx(got.size))) == want


def test_guarded_arithmetic(spark):
    df = spark.createDataFrame([(1, 0), (1, 4), (None, 2), (3, None)], "a int, b int")
    assert [r[0] for r in df.select(arith.ratio("a", "b")).collect()] == [None, 0.25, None, None]
    assert [r[0] for r in df.select(arith.pct_change("a", "b")).collect()] == [None, -75.0, None, None]
    assert str(spark.range(1).select(arith.r(F.lit(-0.0))).first()[0]) == "0.0"
