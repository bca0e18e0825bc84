"""References to records that don't exist, against brute force."""

import datetime as dt
import random

from tessera.operators.references import BITS, Reference, orphans

REF = [Reference("child", "id", "ref", "parent", "id")]


def at(month, day=1):
    return dt.datetime(2025, month, day, 12)


def frames(spark, child, parent, gone):
    return (
        {
            "child": spark.createDataFrame(child, "id string, ref string, loaded_at timestamp_ntz, key string, period int"),
            "parent": spark.createDataFrame(parent, "id string, loaded_at timestamp_ntz, domain string"),
        },
        spark.createDataFrame(gone, "table_name string, record_key string, deleted_at timestamp_ntz"),
    )


def run(spark, child, parent, gone, **kw):
    tables, log = frames(spark, child, parent, gone)
    return {(r.row_key, r.reason) for r in orphans(tables, log, REF, **kw).collect()}


def test_reasons(spark):
    parent = [("P1", at(1), "x"), (" p2 ", at(3, 15), "x"), ("P3", at(1), "x"), ("P4", None, "x"), (None, at(1), "x")]
    gone = [("parent", "P3", at(5, 10)), ("other", "P1", at(1)), ("PARENT", "P4", at(6)), ("parent", None, at(1))]
    child = [
        ("C1", "p1\t", at(2), "a", 1), ("C2", "P2", at(3, 1), "a", 1), ("C3", "P2", at(3, 20), "a", 1), ("C4", "P3", at(5, 1), "a", 1), ("C5", "P3", at(5, 11), "a", 1), ("C6", "P9", at(2), "a", 1), ("C7", "unknown", at(2), "a", 1),
        ("C8", None, at(2), "a", 1), ("C9", "P9", None, "a", 1), ("C10", "P1", None, "a", 1), ("C11", "P4", at(1), "a", 1), ("C12", "P4", at(7), "a", 1), (None, "P9", at(1), "a", 1), ("C13", "P3", at(5, 10), "a", 1),
    ]
    assert run(spark, child, parent, gone) == {("C2", "not_yet_loaded"), ("C5", "deleted"), ("C6", "never_existed"), ("C9", "never_existed"), ("C12", "deleted"), ("C13", "deleted")}


def test_a_row_delivered_again_counts_with_its_first_time(spark):
    child = [("C1", "P1", at(2), "a", 1), ("C1", "P1", at(8), "a", 1)]
    assert run(spark, child, [("P1", at(1), "x")], [("parent", "P1", at(5))]) == set()


def test_empty_tables(spark):
    assert run(spark, [], [], []) == set()
    assert run(spark, [("C1", "P1", at(1), "a", 1)], [], []) == {("C1", "never_existed")}


def test_many_keys_in_one_range_against_brute_force(spark):
    rng = random.Random(5)
    parent = [(f"P{k}", at(rng.randint(1, 12), rng.randint(1, 28)), "x") for k in range(0, 3000, 2)]
    gone = [("parent", f"P{k}", at(rng.randint(1, 12), rng.randint(1, 28))) for k in range(0, 3000, 7)]
    child = [(f"C{n}", f"P{rng.randint(0, 2999) if n % 3 else 10}", at(rng.randint(1, 12), rng.randint(1, 28)), "a", 1) for n in range(4000)]
    born, died = {p: t for p, t, _ in parent}, {}
    for _, k, t in gone:
        died[k] = min(t, died.get(k, t))
    want = {
        (c, "never_existed" if r not in born else "deleted" if died.get(r, t + dt.timedelta(1)) <= t else "not_yet_loaded")
        for c, r, t, _, _ in child
        if r not in born or died.get(r, t + dt.timedelta(1)) <= t or born[r] > t
    }
    assert run(spark, child, parent, gone, keys_per_range=10) == want
    assert run(spark, child, parent, gone, keys_per_range=10**9) == want
    assert BITS == 32_768
