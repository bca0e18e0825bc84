"""Queries of the training-text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import cooccurrence, mixing, packing, pii
from tessera.sources.catalog import table


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of menu items that shares an order, with counts, lift and conviction."""
    out = cooccurrence.scored_pairs(table(spark, folder, "order_items"), "order_id", "item_id")
    return out.withColumns({c: F.round(c, 6) for c in ("lift", "conviction_ab", "conviction_ba")})


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that occur together much more often than chance."""
    return cooccurrence.associated(cooccurrence.scored_pairs(table(spark, folder, "order_items"), "order_id", "item_id")).select("item_a", "item_b")


def p6_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in packs of each size."""
    return packing.packs(packing.profiles(table(spark, folder, "documents")), table(spark, folder, "pack_sizes"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the packs of each size are."""
    return packing.fill(p6_packs(spark, folder), table(spark, folder, "pack_sizes"))


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The texts selected to meet the sources' target shares, and how often each is used."""
    return mixing.selection(mixing.profiles(table(spark, folder, "documents")), table(spark, folder, "source_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of every listed source."""
    out = mixing.reached(p7_selection(spark, folder), table(spark, folder, "source_targets"))
    return out.withColumn("reached_share", F.round("reached_share", 6))


def _model(spark: SparkSession, folder: str) -> pii.Model:
    return pii.fit(table(spark, folder, "documents"), table(spark, folder, "given_names"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in the documents, once per document and value."""
    return pii.find_pii(table(spark, folder, "documents"), _model(spark, folder))


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with personal data replaced by placeholders."""
    return pii.redacted(table(spark, folder, "documents"), _model(spark, folder))


QUERIES = {f.__name__: f for f in (p2_pairs, p2_found, p6_packs, p6_fill, p7_selection, p7_shares, p8_found, p8_redacted)}
