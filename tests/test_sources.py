"""Typed reading, quarantine, safe writing."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import ingest

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("d", T.DateType()), T.StructField("ok", T.BooleanType()), T.StructField("m", T.DecimalType(12, 2))])


def test_typed_csv(spark, tmp_path):
    (tmp_path / "t_2.csv").write_text("id,n,d,ok,m\n c ,x,2025-02-30,maybe,1e\n")
    (tmp_path / "t_1.csv").write_text("id,n,d,ok,m\na,1,3/4/2025,Yes,1.50\n,,,,\n")
    files = ingest.source_files(str(tmp_path), "t")
    assert [f[-7:] for f in files] == ["t_1.csv", "t_2.csv"]
    df = ingest.read_csv(spark, files, SCHEMA)
    rows = {r.id: r for r in df.collect()}
    assert (rows["a"].n, str(rows["a"].d), rows["a"].ok, str(rows["a"].m)) == (1, "2025-03-04", True, "1.50")
    assert rows["c"].n is None and rows["c"][ingest.FLAG + "n"] and rows["c"][ingest.FLAG + "d"]
    assert not rows[None][ingest.FLAG + "n"]
    assert {r.column_name: r.invalid_count for r in ingest.invalid_casts(df).collect()} == {"n": 1, "d": 1, "ok": 1, "m": 1}
    (tmp_path / "t.csv").write_text("id\n")
    assert ingest.source_files(str(tmp_path), "t") == [str(tmp_path / "t.csv")]
    with pytest.raises(FileNotFoundError):
        ingest.source_files(str(tmp_path), "nothing")


def test_wrong_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="missing"):
        ingest.typed(spark.createDataFrame([("a",)], "other string"), SCHEMA)


def test_write_checked_and_safe_csv(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 1), ("plain", 2), (None, 3)], "t string, y int")
    assert ingest.write_checked(df, str(tmp_path / "p"), ["y"]) == 3
    with pytest.raises(Exception, match="exist|EXISTS"):
        ingest.write_checked(df, str(tmp_path / "p"))
    ingest.write_csv(df, str(tmp_path / "c"))
    assert {r.t for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()} == {"'=1+1", "plain", None}


def test_quarantine(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    kept, aside = ingest.quarantine(df, ["k"], F.col("v").isNotNull(), "no value")
    assert kept.count() == 1
    assert sorted(r.reason for r in aside.collect()) == ["no value", "repeated"]


def test_schema_differences():
    other = T.StructType([T.StructField("id", T.LongType()), T.StructField("z", T.StringType())])
    assert ingest.schema_differences(other, SCHEMA) == {"missing": ["d", "m", "n", "ok"], "unexpected": ["z"], "mistyped": [("id", "bigint", "string")]}


def test_append_new_and_inventory(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "k int, v string")
    assert ingest.append_new(a, path, ["k"]) == 2
    assert ingest.append_new(spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), path, ["k"]) == 1
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    (tmp_path / "f.csv").write_text("x\n")
    row = ingest.file_inventory(spark, str(tmp_path / "f.csv")).first()
    assert row["bytes"] == 2 and len(row.sha256) == 64
    assert ingest.same_table(a, a.repartition(3))["equal"] and not ingest.same_table(a, a.limit(2))["equal"]


def test_pages_partitions_batches_reports(spark, tmp_path):
    df = spark.range(25).select("id", (F.col("id") % 3).cast("int").alias("g"), F.concat(F.lit("=x"), F.col("id").cast("string")).alias("t"))
    df.write.partitionBy("g").parquet(str(tmp_path / "p"))
    part = ingest.read_partitioned(spark, str(tmp_path / "p"), g=1)
    assert part.count() == 8 and "PartitionFilters: [isnotnull(g" in part._jdf.queryExecution().executedPlan().toString()
    assert ingest.read_page(spark, str(tmp_path / "p"), ["id"], 5).count() == 5
    assert [len(b) for b in ingest.batches(df, 10)] == [10, 10, 5] and list(ingest.batches(df.limit(0))) == []
    ingest.write_csv(df, str(tmp_path / "c"), mark=True)
    texts = [p.read_text(encoding="utf-8") for p in (tmp_path / "c").glob("part-*")]
    assert all(t.startswith("﻿") or t.startswith('"﻿') for t in texts) and any("'=x3" in t for t in texts)
    ingest.write_report(spark, {"rows": 25, "é": [1, None]}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["rows"] == 25
    with pytest.raises(ValueError, match="none"):
        ingest.require_rows(df.limit(0), "none")
    wide = ingest.with_columns(df.select("id", "t"), T.StructType([T.StructField("t", T.StringType()), T.StructField("new", T.DateType())]))
    assert wide.dtypes == [("t", "string"), ("new", "date")] and wide.count() == 25
    inferred = ingest.read_inferred(spark, str(tmp_path / "c"))
    assert len(inferred.columns) == 3
