"""References to records that do not exist, found with bitmaps per key range and period.

Keys become integers by a dictionary (key range, position). For each range there are bitmaps of 32,768 bits: per
period the keys referred to, and per period the parent keys that arrived or were deleted in it. A range's parents that hold
throughout a period are the arrivals of earlier periods without the deletions up to it; references AND NOT these are decoded
to keys, and only rows with such keys in such periods are looked at by their exact times.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.keys import key_or_null, norm
from tessera.session import cut

BITS = 32_768


@dataclass(frozen=True)
class Reference:
    """Column `column` of table `child` (own key `child_key`) names a row of table `parent` by its key `parent_key`."""

    child: str
    child_key: str
    column: str
    parent: str
    parent_key: str


def _period(at: str) -> Column:
    """Months since year 0; null where the time is."""
    return (F.year(at) * 12 + F.month(at) - 1).cast("int")


def reference_rows(tables: dict[str, DataFrame], refs: list[Reference]) -> DataFrame:
    """One row per child row with a key in its reference: ref (number), row_key, key, at (earliest loaded_at), period.

    Repeated deliveries count once, with the earliest time. Cells without a key (null, blank, stand-ins) are no references.
    """
    parts = []
    for no, r in enumerate(refs):
        rows = tables[r.child].select(F.lit(no).alias("ref"), norm(r.child_key).alias("row_key"), key_or_null(r.column).alias("key"), F.col("loaded_at").alias("at"))
        parts.append(rows)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return (
        rows.where("row_key is not null")
        .groupBy("ref", "row_key")
        .agg(F.min(F.struct(F.col("at").isNull(), "at", "key")).alias("v"))
        .select("ref", "row_key", F.col("v.key").alias("key"), F.col("v.at").alias("at"))
        .where("key is not null")
        .withColumn("period", F.coalesce(_period("at"), F.lit(-1)))
    )


def parent_life(tables: dict[str, DataFrame], deleted: DataFrame, refs: list[Reference]) -> DataFrame:
    """One row per parent table and key: domain, key, born (earliest loaded_at), died (earliest deletion, or null), known.

    known is false for keys that only the log of deletions has. A parent without any loaded_at counts as always there.
    """
    domains = {(r.parent, r.parent_key): None for r in refs}
    parts = []
    for t, k in domains:
        parts.append(tables[t].select(F.lit(t).alias("domain"), key_or_null(k).alias("key"), F.col("loaded_at").alias("born"), F.lit(None).cast("timestamp_ntz").alias("died"), F.lit(True).alias("known")))
    gone = deleted.select(
        F.lower(F.trim("table_name")).alias("domain"), key_or_null("record_key").alias("key"), F.lit(None).cast("timestamp_ntz").alias("born"), F.col("deleted_at").cast("timestamp_ntz").alias("died"), F.lit(False).alias("known")
    ).where(F.col("domain").isin([t for t, _ in domains]))
    rows = gone
    for p in parts:
        rows = rows.unionByName(p.withColumn("born", F.col("born").cast("timestamp_ntz")))
    return rows.where("key is not null").groupBy("domain", "key").agg(F.min("born").alias("born"), F.min("died").alias("died"), F.max("known").alias("known"))


def _and_not(batch: pd.DataFrame) -> pd.DataFrame:
    """For one key range: decoded bits of references without a parent that holds throughout the period."""
    bits = lambda b: np.unpackbits(np.frombuffer(b, dtype=np.uint8), bitorder="little")
    born = {int(p): bits(b) for k, p, b in zip(batch["kind"], batch["period"], batch["bitmap"]) if k == "born"}
    died = {int(p): bits(b) for k, p, b in zip(batch["kind"], batch["period"], batch["bitmap"]) if k == "died"}
    out = []
    refs = batch[batch["kind"] == "ref"].sort_values("period", kind="stable")
    alive, gone, seen = np.zeros(BITS, dtype=np.uint8), np.zeros(BITS, dtype=np.uint8), None
    arrivals, deletions = sorted(born), sorted(died)
    for ref, period, bitmap in zip(refs["ref"], refs["period"], refs["bitmap"]):
        if period < 0:  # no time: only keys that never existed are missing
            holds = np.bitwise_or.reduce([*born.values(), np.zeros(BITS, dtype=np.uint8)])
        else:
            if period != seen:
                while arrivals and arrivals[0] < period:
                    alive |= born[arrivals.pop(0)]
                while deletions and deletions[0] <= period:
                    gone |= died[deletions.pop(0)]
                seen = period
            holds = alive & ~gone
        at = np.flatnonzero(bits(bitmap) & ~holds & 1)
        if len(at):
            out.append(pd.DataFrame({"domain": batch["domain"].iloc[0], "range": batch["range"].iloc[0], "ref": np.int32(ref), "period": np.int32(period), "pos": at.astype("int64")}))
    columns = ["domain", "range", "ref", "period", "pos"]
    return pd.concat(out)[columns] if out else pd.DataFrame({"domain": pd.Series(dtype=str), "range": pd.Series(dtype="int64"), "ref": pd.Series(dtype="int32"), "period": pd.Series(dtype="int32"), "pos": pd.Series(dtype="int64")})


def orphans(tables: dict[str, DataFrame], deleted: DataFrame, refs: list[Reference], keys_per_range: int = 16_384) -> DataFrame:
    """Rows whose reference names no parent that existed when the row was loaded.

    tables: every child and parent, by name, each with loaded_at. deleted: table_name, record_key, deleted_at.
    Gives table_name, column_name, row_key, ref_key, loaded_at, month (first day), reason: never_existed (no parent row has the
    key), deleted (a deletion at or before the row's time), not_yet_loaded (the parent came after the row). Empty tables give no
    rows; a child without loaded_at is only tested for keys that never existed.
    """
    rows = cut(reference_rows(tables, refs), "references")  # read twice: for the keys referred to, and for the suspects' rows
    life = parent_life(tables, deleted, refs)
    domain_of = F.create_map(*[F.lit(x) for no, r in enumerate(refs) for x in (no, r.parent)])
    used = rows.groupBy("ref", "key", "period").agg(F.lit(1).alias("_one")).select(F.element_at(domain_of, F.col("ref")).alias("domain"), "key", F.struct("ref", "period").alias("use"))
    # the dictionary: one row per key, with its life and the periods that refer to it
    entry = (
        used.select("domain", "key", "use", F.lit(None).cast("timestamp_ntz").alias("born"), F.lit(None).cast("timestamp_ntz").alias("died"), F.lit(False).alias("known"))
        .unionByName(life.select("domain", "key", F.lit(None).cast("struct<ref:int,period:int>").alias("use"), "born", "died", "known"))
        .groupBy("domain", "key")
        .agg(F.collect_list("use").alias("uses"), F.min("born").alias("born"), F.min("died").alias("died"), F.max("known").alias("known"))
        .where(F.size("uses") > 0)
    )
    entry = cut(entry, "keys")
    total = entry.count()
    ranges = max(1, -(-total // keys_per_range))
    number = F.row_number().over(Window.partitionBy("domain", "slot").orderBy("key")) - 1
    coded = cut(
        entry.withColumn("slot", F.pmod(F.xxhash64("domain", "key"), F.lit(ranges)))
        .withColumn("no", number)
        .withColumn("range", F.col("slot") + F.floor(F.col("no") / BITS) * ranges)
        .withColumn("pos", (F.col("no") % BITS).cast("bigint"))
        .drop("slot", "no"),
        "dictionary",
    )
    marks = F.concat(
        F.transform("uses", lambda u: F.struct(F.lit("ref").alias("kind"), u.ref.alias("ref"), u.period.alias("period"))),
        F.filter(
            F.array(
                F.when(F.col("known"), F.struct(F.lit("born").alias("kind"), F.lit(-1).alias("ref"), F.coalesce(_period("born"), F.lit(-1)).alias("period"))),
                F.when(F.col("died").isNotNull(), F.struct(F.lit("died").alias("kind"), F.lit(-1).alias("ref"), _period("died").alias("period"))),
            ),
            lambda m: m.isNotNull(),
        ),
    )
    maps = (
        coded.select("domain", "range", "pos", F.explode(marks).alias("m"))
        .groupBy("domain", "range", F.col("m.kind").alias("kind"), F.col("m.ref").alias("ref"), F.col("m.period").alias("period"))
        .agg(F.expr("bitmap_construct_agg(pos)").alias("bitmap"))
    )
    left = maps.groupBy("domain", "range").applyInPandas(_and_not, "domain string, range bigint, ref int, period int, pos bigint")
    suspects = cut(left.join(coded.select("domain", "range", "pos", "key", "born", "died", "known"), ["domain", "range", "pos"]).select("ref", "period", "key", "born", "died", "known"), "suspects")  # its size is known now: small ones are sent to all
    near = rows.join(suspects, ["ref", "period", "key"])
    reason = (
        F.when(~F.col("known"), F.lit("never_existed"))
        .when(F.col("died") <= F.col("at"), F.lit("deleted"))
        .when(F.col("born") > F.col("at"), F.lit("not_yet_loaded"))
    )
    names = F.create_map(*[F.lit(x) for no, r in enumerate(refs) for x in (no, r.child)])
    columns = F.create_map(*[F.lit(x) for no, r in enumerate(refs) for x in (no, r.column)])
    return (
        near.withColumn("reason", reason)
        .where("reason is not null")
        .select(
            F.element_at(names, F.col("ref")).alias("table_name"), F.element_at(columns, F.col("ref")).alias("column_name"), "row_key",
            F.col("key").alias("ref_key"), F.col("at").alias("loaded_at"), F.trunc(F.col("at").cast("date"), "month").alias("month"), "reason",
        )
    )
