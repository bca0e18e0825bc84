"""Event-time aggregates, sessions and as-they-arrive checks on streams of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of events as they appear in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events per type and window: started, ended, event_type, events, total, users (approximate). Events later than `late` are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"), F.approx_count_distinct("user_id").alias("users"))
    return out.select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "event_type", "events", "total", "users")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    """Sessions of a user that end after an idle gap: user_id, started, ended, events."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def first_deliveries(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each key once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_baseline(events: DataFrame, weight: float = 0.1, times: float = 3.0, late: str = "2 hours", lanes: int = 8) -> DataFrame:
    """Events whose value is `times` deviations off its type's exponentially weighted mean so far.

    A type's events are dealt to lanes by their id, each with a mean and deviation of its own, so a type that holds a third of the stream
    is the work of many tasks. The state per lane is three numbers, and a task holds one Arrow batch at a time; events are taken in the
    order of their time within such a batch. Null values are passed over.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, var = state.get if state.exists else (0, 0.0, 0.0)
        for batch in batches:
            out = []
            rows = batch[batch["value"].notna()].sort_values(["ts", "event_id"])
            for no, value in zip(rows["event_id"].tolist(), rows["value"].tolist()):
                off = value - mean
                if n >= 10 and var > 0 and abs(off) > times * var**0.5:
                    out.append((no, key[0], value, mean))
                mean += weight * off if n else off
                var = (1 - weight) * (var + weight * off * off) if n else 0.0
                n += 1
            yield pd.DataFrame(out, columns=["event_id", "event_type", "value", "baseline"])
        state.update((n, mean, var))

    lane = F.pmod(F.xxhash64("event_id"), F.lit(lanes)).cast("int").alias("lane")
    return events.select("event_id", "ts", "event_type", "value", lane).groupBy("event_type", "lane").applyInPandasWithState(
        step, "event_id bigint, event_type string, value double, baseline double", "n bigint, mean double, var double", "append", GroupStateTimeout.NoTimeout
    )
