"""Session construction and the shared working folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession


def build_session(app: str = "tessera", cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings that the operators expect; on a cluster the submitted settings hold."""
    n = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{n}]")
        .config("spark.sql.shuffle.partitions", shuffle_partitions or n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor reaches: spark.checkpoint.dir, or the checkpoint folder that was set.

    Where neither is set, a local session (tests) gets a temporary one; on a cluster this raises, since a folder of the driver's
    machine would be another folder on every executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    made = spark.sparkContext.getCheckpointDir()
    if made:
        return made.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Paths of the tables that `cut` wrote and nothing has dropped yet.
_written: list[str] = []


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    This ends the lineage and survives the loss of executors. The table stays until `release` drops it, a `scratch` block around
    the caller ends, or the program does.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_drop_all, spark)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Drops tables of `cut` that nothing lazy reads any more, such as the former round's of an iteration."""
    for t in tables:
        path = getattr(t, "_tessera_path", None)
        if path in _written:
            _written.remove(path)
            _drop(t.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops, at the end of the block, every table that `cut` wrote within it: consume results inside."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p in _written if p not in before]:
            _written.remove(path)
            _drop(spark, path)


def bounded(df: DataFrame, most: int, name: str) -> list[Row]:
    """The rows of a small table; raises where there are more than `most`, so that none is lost without a word."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{name}: more than {most} rows")
    return rows


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that costs far more than moving its rows.

    Tuning only: results don't depend on it. Where the input has as many partitions already, as any large one has, nothing moves.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _drop_all(spark: SparkSession) -> None:
    while _written:
        _drop(spark, _written.pop())


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone
        pass


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once per application: they needn't have it, nor the driver's working folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    home = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="tessera-ship-"))  # the driver's own: Spark serves the file to the executors
    atexit.register(shutil.rmtree, folder, True)
    path = folder / "tessera_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(path))
