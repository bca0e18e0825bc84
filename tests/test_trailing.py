"""Trailing totals against brute force."""

import datetime as dt
import random

from tessera.operators.trailing import blocks, trailing_totals

D = dt.date(2025, 1, 1)


def test_blocks():
    assert blocks(7) == [4, 2, 1]
    assert blocks(30) == [16, 8, 4, 2]
    assert blocks(1) == [1]


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc") if rng.random() < 0.6 else "hot", D + dt.timedelta(rng.randint(0, 90)), rng.randint(1, 9), "x") for _ in range(700)]
    rows += [(None, D, 5, "x"), ("a", None, 5, "x"), ("a", D, None, "x")]
    df = spark.createDataFrame(rows, "k string, day date, v int, total string")  # `total` clashes with a name used inside
    got = {(r.k, r.day): r for r in trailing_totals(df, "k", "day", "v", (1, 7, 13, 30)).collect()}
    good = [r for r in rows if None not in r]
    last = max(r[1] for r in good)
    n = 0
    for k in {r[0] for r in good}:
        first = min(r[1] for r in good if r[0] == k)
        for back in range((last - first).days + 1):
            day = first + dt.timedelta(back)
            for w in (1, 7, 13, 30):
                s = sum(r[2] for r in good if r[0] == k and day - dt.timedelta(w - 1) <= r[1] <= day)
                assert got[k, day][f"sum_{w}"] == s
                assert abs(got[k, day][f"avg_{w}"] - s / w) < 1e-9
            assert got[k, day].day_no == back
            n += 1
    assert n == len(got)


def test_empty(spark):
    assert trailing_totals(spark.createDataFrame([], "k string, day date, v int"), "k", "day", "v").count() == 0
