"""Missing values filled from similar records by label propagation.

Records are nodes; they are joined through what they have in common (group and similarity edges), never pair by pair: an
edge is a shared value, and all nodes with that value hang on it. Observed nodes are clamped. A missing number takes the
weighted mean of its edges' means; a missing category the weighted mix of its edges' distributions; and what was filled in
one round speaks in the next, until nothing moves by more than a tolerance. What observed nodes say is added up once, and only on
edges that a node with a gap hangs on; rounds move the unlabelled nodes only. An edge is named by a 64-bit hash of its values.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut, release

Edge = tuple[str, list[Column | str], float]  # name, columns or expressions, weight

#: Rounds at most; a table that needs more raises, rather than giving what hasn't settled.
MOST_ROUNDS = 200


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _there(columns: list[Column | str]) -> Column:
    return reduce(lambda a, b: a & b, [_col(c).isNotNull() for c in columns], F.lit(True))


def _hang(df: DataFrame, node: str, parts: list[tuple[str, Column, list[Edge]]]) -> DataFrame:
    """One row per node and edge it hangs on: node, target, edge, weight, x (what the node says); edges with a null value are left out."""
    items = [
        F.when(_there(columns), F.struct(F.lit(target).alias("target"), F.xxhash64(F.lit(target), F.lit(name), *[_col(c).cast("string") for c in columns]).alias("edge"), F.lit(float(weight)).alias("weight"), x.alias("x")))
        for target, x, edges in parts
        for name, columns, weight in edges
    ]
    return df.select(node, F.explode(F.filter(F.array(*items), lambda e: e.isNotNull())).alias("e")).select(node, "e.*")


def propagate_number(df: DataFrame, node: str, value: str, edges: list[Edge], tolerance: float = 1e-3) -> DataFrame:
    """Fills null `value`; gives node, filled for the nodes whose value is null (filled is null only if no edge says anything).

    edges: (name, columns or expressions, weight). An edge with a null among its values doesn't hold. The mean over all
    observed nodes is the last resort, with a very small weight. Rounds end when no filled value moves by more than tolerance.
    """
    edges = [*edges, ("all", [F.lit("")], 1e-6)]
    both = _hang(df, node, [("number", F.col(value).cast("double"), edges)])
    open_ = both.where("x is null").select(node, "edge", "weight")
    wanted = open_.groupBy("edge").agg(F.count("*").alias("others"))
    known = both.where("x is not null").groupBy("edge").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    said = wanted.join(known, "edge", "left").fillna(0, ["s", "n"]).where("n > 0 or others > 1")
    open_ = cut(open_.join(said, "edge").drop("others"), "open-edges")
    mean = (F.sum(F.col("m") * F.col("weight")) / F.sum("weight")).alias("filled")
    filled = cut(open_.where("n > 0").withColumn("m", F.col("s") / F.col("n")).groupBy(node).agg(mean), "filled")
    for _ in range(MOST_ROUNDS):
        mine = open_.join(filled, node, "left")
        sums = mine.groupBy("edge").agg(F.sum("filled").alias("s2"), F.count("filled").alias("n2"))
        # a node doesn't hear itself
        heard = mine.join(sums, "edge").withColumn("nn", F.col("n") + F.col("n2") - F.when(F.col("filled").isNull(), 0).otherwise(1))
        heard = heard.where("nn > 0").withColumn("m", (F.col("s") + F.coalesce("s2", F.lit(0.0)) - F.coalesce("filled", F.lit(0.0))) / F.col("nn"))
        now = cut(heard.groupBy(node).agg(mean, F.max("filled").alias("was")), "filled")
        moved = now.agg(F.max(F.when(F.col("was").isNull(), 1e9).otherwise(F.abs(F.col("filled") - F.col("was"))))).first()[0]
        release(filled)
        filled = now.select(node, "filled")
        filled._tessera_path = now._tessera_path
        if (moved or 0.0) <= tolerance:
            return df.where(F.col(value).isNull()).select(node).join(filled, node, "left")
    raise RuntimeError(f"numbers still move by {moved} after {MOST_ROUNDS} rounds")


@dataclass(frozen=True)
class Target:
    """A category to fill: its column, the edges that labels travel along, and wide groups, in this order, for nodes that no edge reaches."""

    label: str
    edges: list[Edge]
    wide: list[list[Column | str]] = field(default_factory=list)


def propagate_category(df: DataFrame, node: str, targets: dict[str, Target], tolerance: float = 0.05) -> DataFrame:
    """Fills null labels of several columns at once; gives node, target, filled, share (of the winning label) per gap.

    Each edge hands on the shares of the labels on it, whole distributions, times its weight; rounds end when no
    node's winning share moves by more than tolerance (then only labels that are as good as tied still change places). Ties go to
    the least label. Edges are counted before anything moves, so
    an edge costs as many rows as it has labels. Wide groups, which hold a great part of all nodes, aren't edges: a node that no
    edge reaches takes the commonest label of the first of its groups that has one, else of the whole table, with share 0.
    """
    both = _hang(df, node, [(name, F.col(t.label).cast("string"), t.edges) for name, t in targets.items()])
    open_ = both.where("x is null").select(node, "target", "edge", "weight")
    wanted = open_.groupBy("edge").agg(F.count("*").alias("others"))
    known = cut(both.where("x is not null").join(wanted, "edge", "left_semi").groupBy("edge", F.col("x").alias("label")).agg(F.count("*").cast("double").alias("n")), "edge-labels")
    # an edge on which only one gap hangs says nothing
    totals = known.groupBy("edge").agg(F.sum("n").alias("total"))
    open_ = cut(open_.join(wanted.join(totals, "edge", "left").where("total > 0 or others > 1").select("edge"), "edge"), "open-edges")
    beliefs = None
    for _ in range(MOST_ROUNDS):
        counts = known
        if beliefs is not None:
            own = open_.join(beliefs, ["target", node]).groupBy("edge", "label").agg(F.sum("share").alias("n"))
            counts = known.unionByName(own).groupBy("edge", "label").agg(F.sum("n").alias("n"))
        counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy("edge")))
        said = open_.join(counts, "edge").groupBy("target", node, "label").agg(F.sum(F.col("weight") * F.col("n") / F.col("total")).alias("w"))
        mine = Window.partitionBy("target", node)
        now = said.withColumns({"share": F.col("w") / F.sum("w").over(mine), "_r": F.row_number().over(mine.orderBy(F.desc("w"), "label"))})
        now = cut(now.select("target", node, "label", "share", "_r"), "beliefs")
        was, beliefs = beliefs, now
        if was is not None:
            winning = lambda b, name: b.where("_r = 1").select("target", node, F.col("share").alias(name))
            both_ = winning(now, "p").join(winning(was, "q"), ["target", node], "left")
            settled = both_.where(F.col("q").isNull() | (F.abs(F.col("p") - F.col("q")) > tolerance)).isEmpty()
            release(was)
            if settled:
                break
    else:
        raise RuntimeError(f"labels still change after {MOST_ROUNDS} rounds")
    best = beliefs.where("_r = 1").select("target", node, F.col("label").alias("filled"), "share")
    return _fallen_back(df, node, targets, best)


def _fallen_back(df: DataFrame, node: str, targets: dict[str, Target], best: DataFrame) -> DataFrame:
    """A row per gap: best where an edge reached it, else the commonest label of the first wide group that has one, else of the table.

    Groups of all targets and widths are counted in one pass, like edges: a join for each of them made one plan whose
    planning alone took the driver 200 MB. Of equally common labels the greatest counts.
    """
    parts = [(name, F.col(t.label).cast("string"), [*[(f"wide{k}", columns, k) for k, columns in enumerate(t.wide)], ("all", [F.lit("")], len(t.wide))]) for name, t in targets.items()]
    both = _hang(df, node, parts)
    open_ = cut(both.where("x is null").join(best, ["target", node], "left_anti").select(node, "target", "edge", "weight"), "wide-edges")
    seen = both.where("x is not null").groupBy("edge", "x").count()  # before the join, so that no wide group is hot
    top = cut(seen.join(open_.select("edge").distinct(), "edge", "left_semi").groupBy("edge").agg(F.max(F.struct("count", "x"))["x"].alias("filled")), "wide-labels")
    none = F.lit(0.0).alias("share")
    fallback = open_.join(top, "edge", "left").select(node, "target", F.when(F.col("filled").isNotNull(), F.col("weight")).alias("at"), "filled", none)
    reached = best.select(node, "target", F.lit(-1.0).alias("at"), "filled", "share")
    # the narrowest comes first; a gap of a table without labels keeps its row
    first = F.min(F.struct(F.coalesce("at", F.lit(float("inf"))).alias("at"), "filled", "share")).alias("p")
    return reached.unionByName(fallback).groupBy(node, "target").agg(first).select(node, "target", "p.filled", "p.share")
