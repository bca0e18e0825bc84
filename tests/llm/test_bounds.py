"""Small tables that are longer than their bound raise, and aren't cut."""

import pytest

from tessera.llm import mixing, pii


def test_long_tables_raise(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 2)
    monkeypatch.setattr(pii, "GIVEN_NAMES", 2)
    texts = spark.createDataFrame([(1, "a", "en", "x", 5)], "doc_id long, source string, lang string, topic string, n_tokens int")
    targets = spark.createDataFrame([(s, 0.3, 2) for s in "abc"], "source string, target_share double, max_repeats int")
    with pytest.raises(ValueError, match="source_targets"):
        mixing.selection(texts, targets)
    assert mixing.selection(texts, targets.limit(2)).count() >= 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    with pytest.raises(ValueError, match="given_names"):
        pii.fit(docs, spark.createDataFrame([("A",), ("B",), ("C",)], "given_name string"))
