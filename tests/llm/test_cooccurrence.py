"""Pairs of items against brute force."""

import itertools
import random
from collections import Counter

import pytest

from tessera.llm import cooccurrence as C

SCHEMA = "order_id string, item_id string, items string, weight int"  # the last two clash with names used inside


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"O{rng.randint(0, 60) if n % 3 else 0}", f"{rng.choice(['', ' '])}{rng.choice('mM')}{rng.randint(1, 12)}", "x", 1) for n in range(900)]
    rows += [(None, "M1", "x", 1), ("O1", None, "x", 1), ("O1", "unknown", "x", 1), ("O99", "-", "x", 1), (" ", "M1", "x", 1)]
    held = {}
    for o, i, *_ in rows:
        if o and o.strip() and i and any(c.isdigit() for c in i):
            held.setdefault(o.strip().upper(), set()).add(i.strip().upper())
    n, single = len(held), Counter(i for s in held.values() for i in s)
    both = Counter(p for s in held.values() for p in itertools.combinations(sorted(s), 2))
    got = {(r.item_a, r.item_b): r for r in C.scored_pairs(spark.createDataFrame(rows, SCHEMA), "order_id", "item_id").collect()}
    assert set(got) == set(both)
    for (a, b), k in both.items():
        r = got[a, b]
        assert (r.together, r.count_a, r.count_b, r.baskets) == (k, single[a], single[b], n)
        assert r.lift == pytest.approx(k * n / single[a] / single[b])
        assert (r.conviction_ab is None) == (k == single[a])
    found = {(r.item_a, r.item_b) for r in C.associated(C.scored_pairs(spark.createDataFrame(rows, SCHEMA), "order_id", "item_id"), times=1.05).collect()}
    assert found == {p for p, k in both.items() if k >= 5 and k * 1000 >= n and k * n >= 1.05 * single[p[0]] * single[p[1]]}


def test_identical_baskets_collapse(spark):
    rows = [(f"O{n}", i, "x", 1) for n in range(50) for i in ("M1", "M2", "M2")]
    assert [(r["items"], r.weight) for r in C.baskets(spark.createDataFrame(rows, SCHEMA), "order_id", "item_id").collect()] == [(["M1", "M2"], 50)]


def test_empty(spark):
    assert C.scored_pairs(spark.createDataFrame([], SCHEMA), "order_id", "item_id").count() == 0


def test_large_baskets_in_blocks_give_the_same(spark):
    """Whatever the size from which on a basket is unrolled in blocks."""
    rng = random.Random(5)
    rows = [("HUGE1", f"i{rng.randint(0, 60)}") for _ in range(400)] + [(f"b{rng.randint(0, 40)}", f"i{rng.randint(0, 25)}") for _ in range(200)] + [("b1", None), (None, "i3")]
    df = spark.createDataFrame(rows, "basket string, item string")
    want = {tuple(r) for r in C.scored_pairs(df, "basket", "item").collect()}
    assert len(want) > 1000
    for large in (1, 5, 17):
        assert {tuple(r) for r in C.scored_pairs(df, "basket", "item", large=large).collect()} == want
