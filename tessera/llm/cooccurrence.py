"""Items that appear together, counted over collapsed baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import key_or_null, norm
from tessera.session import cut


#: Lines from which on a basket is unrolled in blocks of items rather than as one array.
LARGE = 1024


def _cells(lines: DataFrame, basket: str, item: str) -> DataFrame:
    return lines.select(norm(basket).alias("basket"), key_or_null(item).alias("item")).where("basket is not null and basket <> '' and item is not null")


def baskets(lines: DataFrame, basket: str, item: str) -> DataFrame:
    """Distinct baskets and how often each occurs: items (sorted array of item keys), weight.

    Cells without a key don't count; a basket holds each key once; lines without a basket key don't count. Lines are made
    distinct by basket and item first, on the map side, so a basket that holds a third of all lines shrinks to its different
    items before it moves.
    """
    return _collapsed(_cells(lines, basket, item))


def _collapsed(cells: DataFrame) -> DataFrame:
    pairs = cells.groupBy("basket", "item").agg(F.lit(1).alias("_one"))
    return pairs.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items")).groupBy("items").agg(F.count("*").alias("weight"))


def pair_counts(collapsed: DataFrame) -> DataFrame:
    """item_a < item_b and together, in how many baskets both are: each distinct basket's pairs once, times its weight."""
    anchored = collapsed.where(F.size("items") > 1).select("weight", "items", F.posexplode("items").alias("at", "item_a"))
    pairs = anchored.select("item_a", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("item_b"), "weight")
    return pairs.groupBy("item_a", "item_b").agg(F.sum("weight").alias("together"))


def _blocks(cells: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Large baskets in blocks of about `block` items: basket, no (of the block), items."""
    many = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    at = cells.join(sizes, "basket").groupBy("basket", "item").agg(F.max("n").alias("n"))
    return at.withColumn("no", F.pmod(F.xxhash64("item"), many)).groupBy("basket", "no").agg(F.array_sort(F.collect_list("item")).alias("items"))


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs of large baskets: within a block, and between each two blocks of a basket, every two blocks a row that any task may take."""
    inside = blocks.select("items", F.posexplode("items").alias("at", "x")).select("x", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("y"))
    # numbers of blocks meet first; the blocks themselves follow by basket and number, so that one huge basket is many tasks
    i, j = blocks.select("basket", F.col("no").alias("i")), blocks.select("basket", F.col("no").alias("j"))
    met = i.join(j, "basket").where("i < j")
    held = lambda no, items: blocks.select("basket", F.col("no").alias(no), F.col("items").alias(items))
    across = met.join(held("i", "xs"), ["basket", "i"]).join(held("j", "ys"), ["basket", "j"]).select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y"))
    both = inside.unionByName(across).select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))
    return both.groupBy("item_a", "item_b").agg(F.count("*").alias("together"))


def scored_pairs(lines: DataFrame, basket: str, item: str, large: int = LARGE) -> DataFrame:
    """Every pair of items that shares a basket: item_a, item_b (a < b), together, count_a, count_b, baskets, lift, conviction_ab,
    conviction_ba.

    lift is together * baskets / (count_a * count_b), how many times more often than chance. conviction_ab is
    (1 - count_b / baskets) / (1 - together / count_a), null where b is in every basket with a. Empty input gives no rows.
    Baskets of more than `large` lines are never one array: their items are dealt to blocks, whose pairs many tasks make.
    """
    cells = _cells(lines, basket, item)
    sizes = cut(cells.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > large), "large-baskets")
    some = not sizes.isEmpty()
    small = cells.join(sizes.select("basket"), "basket", "left_anti") if some else cells
    collapsed = cut(_collapsed(small), "baskets")
    single, total, pairs = collapsed.select(F.explode("items").alias("item"), "weight"), collapsed.agg(F.sum("weight").alias("n")), pair_counts(collapsed)
    if some:
        blocks = cut(_blocks(cells, sizes, large), "blocks")
        single = single.unionByName(blocks.select(F.explode("items").alias("item"), F.lit(1).cast("bigint").alias("weight")))
        total = total.unionByName(blocks.agg(F.count_distinct("basket").alias("n")))
        pairs = pairs.unionByName(_block_pairs(blocks)).groupBy("item_a", "item_b").agg(F.sum("together").alias("together"))
    single = single.groupBy("item").agg(F.sum("weight").alias("n"))
    total = total.agg(F.sum("n").alias("baskets"))  # one row
    return (
        pairs.join(single.select(F.col("item").alias("item_a"), F.col("n").alias("count_a")), "item_a")
        .join(single.select(F.col("item").alias("item_b"), F.col("n").alias("count_b")), "item_b")
        .crossJoin(F.broadcast(total))
        .select(
            "item_a", "item_b", "together", "count_a", "count_b", "baskets",
            (F.col("together") * F.col("baskets") / (F.col("count_a").cast("double") * F.col("count_b"))).alias("lift"),
            F.when(F.col("together") < F.col("count_a"), (1 - F.col("count_b") / F.col("baskets")) / (1 - F.col("together") / F.col("count_a"))).alias("conviction_ab"),
            F.when(F.col("together") < F.col("count_b"), (1 - F.col("count_a") / F.col("baskets")) / (1 - F.col("together") / F.col("count_b"))).alias("conviction_ba"),
        )
    )


def associated(pairs: DataFrame, least: int = 5, share: int = 1000, times: float = 2.5) -> DataFrame:
    """Pairs that occur together at least `least` times and in a 1/share of all baskets, and `times` as often as chance."""
    return pairs.where(
        (F.col("together") >= least) & (F.col("together") * share >= F.col("baskets")) & (F.col("together") * F.col("baskets") >= F.lit(times) * F.col("count_a").cast("double") * F.col("count_b"))
    )
