"""Mixing: exact targets, limits kept, missing sources reported."""

from pathlib import Path

import random

import pytest

from tessera.llm import mixing

TEXTS = "doc_id long, source string, lang string, topic string, n_tokens long, u double, bin long, copies int"
TARGETS = "source string, target_share double, max_repeats int"


def texts(spark, n=6000, seed=2):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        s = rng.choices(["big", "mid", "tiny", "unlisted"], [70, 25, 2, 3])[0]
        rows.append((k, s, rng.choice(["en", "de"]), rng.choice(["x", "y", "z"]), int(rng.lognormvariate(6, 0.7)) + 1, 0.0, 0, 0))
    return spark.createDataFrame(rows, TEXTS), rows


def test_targets_are_met_within_limits(spark):
    df, rows = texts(spark)
    targets = spark.createDataFrame([("Big ", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 8), ("gone", 0.1, 4), ("zero", 0.0, 4), (None, 0.3, 1)], TARGETS)
    sel = mixing.selection(df, targets)
    picked = sel.collect()
    limit = {"big": 1, "mid": 2, "tiny": 8}
    assert {r.source for r in picked} == set(limit)
    assert len({r.doc_id for r in picked}) == len(picked)
    assert all(1 <= r.copies <= limit[r.source] for r in picked)
    got = {r.source: r for r in mixing.reached(sel, targets).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.1)):
        assert got[s].reached_share == pytest.approx(share / 0.9, abs=0.004)
    assert got["gone"].tokens == 0 and got["gone"].reached_share == 0
    every = sum(r.n_tokens * r.copies for r in picked)
    own = {s: sum(r[4] for r in rows if r[1] == s) for s in limit}
    most = min(limit[s] * own[s] / (p / 0.9) for s, p in (("big", 0.5), ("mid", 0.3), ("tiny", 0.1)))
    assert every == pytest.approx(most, rel=0.01)  # as much as the scarcest source allows


def test_languages_keep_their_shares_where_repeats_allow(spark):
    cells = [mixing.Cell("a", "en", "x", 900), mixing.Cell("a", "de", "x", 100), mixing.Cell("b", "en", "x", 100), mixing.Cell("b", "de", "x", 900)]
    w, total = mixing.rake(cells, {"a": 0.8, "b": 0.2}, {"a": 4, "b": 4})
    assert total == 5000
    assert sum(w[c] * c.tokens for c in cells if c.source == "a") == pytest.approx(4000)
    assert max(w.values()) <= 4
    assert mixing.rake([], {}, {}) == ({}, 0)


def test_copies_of_a_text_count_once(spark):
    labelled = [(100 + k, f"the one of here was text {k}", "en", "a", None) for k in range(40)] + [(200 + k, f"der und die Katze das {k}", "DE", "a", None) for k in range(40)]
    docs = spark.createDataFrame(
        [(2, "one text here", "EN", "Registry", "Family Division"), (1, "one text here", None, "gazette ", None), (3, None, "en", "a", None), (4, "", "en", "a", None), (None, "x", "en", "a", None), (5, "der Hund und die Katze der und die", "en", "bar-bulletin", "Landgericht X"), (6, "qqq", None, "a", None), *labelled],
        "doc_id long, text string, lang string, source string, court string",
    )
    got = {r.doc_id: (r.source, r.lang, r.topic) for r in mixing.profiles(docs).where("doc_id < 100").collect()}
    assert got == {1: ("gazette", "en", "unknown"), 5: ("bar_bulletin", "de", "civil"), 6: ("a", "unknown", "unknown")}


def test_empty(spark):
    df, _ = texts(spark, 50)
    none = spark.createDataFrame([], TARGETS)
    assert mixing.selection(df, none).count() == 0
    assert mixing.selection(df.limit(0), spark.createDataFrame([("big", 0.5, 1)], TARGETS)).count() == 0
    assert [r.reached_share for r in mixing.reached(mixing.selection(df.limit(0), spark.createDataFrame([("big", 0.5, 1)], TARGETS)), spark.createDataFrame([("big", 0.5, 1)], TARGETS)).collect()] == [None]


def test_languages_are_told_from_words(spark):
    """The model is learnt from labelled documents; held-out ones come out right, labels that plainly lie are not believed."""
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("the test tables aren't here")
    docs = spark.read.parquet(str(path))
    model = mixing.fit_languages(docs, 300)
    assert set(model.names) == {"de", "en", "fr"}
    rest = [r for r in docs.where("n_chars > 400 and trim(lang) <> ''").collect()]
    right = sum(model(r.text, None) == mixing.clean_label(r.lang) for r in rest)
    assert right >= 0.95 * len(rest)  # some labels are wrong on purpose
    text = next(r.text for r in rest if mixing.clean_label(r.lang) == model(r.text, None) == "de")
    assert model(text, " DE ") == model(text, "en") == model(text, None) == model(text, "xx") == "de"
    assert model("", "FR") == "fr" and model(None, None) == "unknown" and model("zzzz", None) == "unknown"
    none = mixing.fit_languages(docs.limit(0))
    assert none("the court", "en") == "en" and none("the court", None) == "unknown"
