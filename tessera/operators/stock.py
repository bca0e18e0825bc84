"""Stock sheets with their gaps filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import earliest
from tessera.operators import impute, units
from tessera.session import cut


def _bins(x: Column, width: float) -> tuple[Column, Column]:
    """Two rasters of ln x, half a bin apart, so that near values share at least one bin."""
    at = F.when(x > 0, F.ln(x) / F.lit(width))
    return F.floor(at), F.floor(at + 0.5)


def _chain(keys: list[str], tag: str, weight: float, width: float = 0.02, unless: Column | None = None) -> list[tuple[str, list, float]]:
    """Similarity edges along time: what one month closes with, the next opens with. Sheets for which `unless` holds don't hang on them."""
    out = []
    for quantity, month in (("opening", F.col("m")), ("closing", F.col("m") + 1)):
        for k, b in enumerate(_bins(F.col(quantity), width)):
            out.append((f"{tag}{k}", [*keys, month, b if unless is None else F.when(unless, None).otherwise(b)], weight))
    return out


def _levels(keys: list[str]) -> list[list]:
    """Wide groups for sheets that no chain reaches, the narrowest first: what the sheet opens and closes with, one of both, neither."""
    o, c = (_bins(F.col(q), 0.25)[0] for q in ("opening", "closing"))
    return [[*keys, o, c], [*keys, o], [*keys, c]]


def filled_sheets(inventory: DataFrame, model: units.UnitModel = units.UnitModel()) -> DataFrame:
    """Every stock sheet with branch, item and consumption, observed or filled.

    A cell is missing if it is null, blank or a stand-in: a key without a digit; a consumption that is no number, is negative, or
    is 1e6 and more. Zero is a value. Sheets delivered more than once count once, with the earliest loaded_at. Numbers are
    brought to the item's common unit first. Gives inventory_id, month_start, restaurant_id, item_id, consumed (common unit),
    restaurant_filled, item_filled, consumed_filled (booleans) and restaurant_share, item_share (support of a filled key, null
    where observed). Extra columns are ignored; empty input gives no rows. A consumption of a table without a single observed
    one stays null.
    """
    need = ["inventory_id", "restaurant_id", "item_id", "month_start", *units.FIELDS, "unit"]
    sheets = earliest(inventory.select(*need, "loaded_at"), "inventory_id", need)
    at = units.normalised(sheets, model, ("month_start",))
    nodes = cut(
        at.select(
            "inventory_id", "month_start", (F.year("month_start") * 12 + F.month("month_start")).alias("m"), F.col("_branch").alias("b"), F.col("_item").alias("i"), F.col("dim_").alias("dim"),
            F.col("opening_stock__common").alias("opening"), F.col("received_stock__common").alias("received"), F.col("consumed_stock__common").alias("consumed"), F.col("closing_stock__common").alias("closing"),
        ),
        "stock-nodes",
    )
    # without branch and item both, only the quantity itself links a sheet to its neighbours; such edges hold many labels, so no other gap hangs on them
    near = lambda me, key: [
        *_chain([key], "chain", 20.0), *_chain([], "value", 0.2, 0.002, F.col(me).isNull() & F.col(key).isNotNull())
    ]
    targets = {"b": impute.Target("b", near("b", "i"), [*_levels(["i"]), ["i"], ["m"]]), "i": impute.Target("i", near("i", "b"), [*_levels(["b", "dim"]), ["b", "dim"], ["b"], ["m"]])}
    keys = cut(impute.propagate_category(nodes, "inventory_id", targets), "stock-keys")
    got = lambda name, value, share: keys.where(F.col("target") == name).select("inventory_id", F.col("filled").alias(value), F.col("share").alias(share))
    full = cut(
        nodes.join(got("b", "b2", "restaurant_share"), "inventory_id", "left")
        .join(got("i", "i2", "item_share"), "inventory_id", "left")
        .withColumns({"bb": F.coalesce("b", "b2"), "ii": F.coalesce("i", "i2"), "x": F.log1p("consumed")})
        # what a sheet lost from its opening and received stock is how similar two sheets of an item are
        .withColumn("flow", F.col("opening") + F.col("received") - F.col("closing")),
        "stock-full",
    )
    fine, rough = _bins(F.col("flow"), 0.02), _bins(F.col("flow"), 0.2)
    number = impute.propagate_number(
        full, "inventory_id", "x",
        [
            ("flow0", ["dim", fine[0]], 100.0), ("flow1", ["dim", fine[1]], 100.0), ("rough", ["ii", rough[0]], 20.0), ("near", ["bb", "ii", F.floor(F.col("m") / 3)], 2.0),
            ("pair", ["bb", "ii"], 2.0), ("month", ["ii", "m"], 0.5), ("item", ["ii"], 0.1), ("dim", ["dim"], 0.001),
        ],
    )
    return full.join(number.select("inventory_id", F.expm1("filled").alias("filled")), "inventory_id", "left").select(
        "inventory_id", "month_start", F.col("bb").alias("restaurant_id"), F.col("ii").alias("item_id"), F.round(F.coalesce("consumed", "filled"), 3).alias("consumed"),
        F.col("b").isNull().alias("restaurant_filled"), F.col("i").isNull().alias("item_filled"), F.col("consumed").isNull().alias("consumed_filled"), "restaurant_share", "item_share",
    )


def filled_cells(inventory: DataFrame, model: units.UnitModel = units.UnitModel()) -> DataFrame:
    """One row per cell that was filled: inventory_id, field_name, filled_value (text), share (of a filled key).

    A gap that no other sheet can fill (a table without a single observed value) isn't among them.
    """
    at = filled_sheets(inventory, model)
    cell = lambda field, flag, value, share: F.when(F.col(flag), F.struct(F.lit(field).alias("field_name"), F.col(value).cast("string").alias("filled_value"), share.alias("share")))
    cells = F.array(
        cell("restaurant_id", "restaurant_filled", "restaurant_id", F.col("restaurant_share")),
        cell("item_id", "item_filled", "item_id", F.col("item_share")),
        cell("consumed_stock", "consumed_filled", "consumed", F.lit(None).cast("double")),
    )
    return at.select("inventory_id", F.explode(F.filter(cells, lambda c: c.isNotNull() & c.filled_value.isNotNull())).alias("c")).select("inventory_id", "c.*")


def unbalanced(sheets: DataFrame, model: units.UnitModel = units.UnitModel(), share: float = 0.02, least: float = 0.3) -> DataFrame:
    """Sheets whose opening + received - consumed differs from closing by more than a share of what there was, and `least`.

    Numbers are brought to common units first; sheets with a missing number aren't judged. Gives inventory_id, opening, received,
    consumed, closing and off, the difference.
    """
    at = units.normalised(sheets, model)
    o, rec, c, e = (F.col(f"{f}__common") for f in units.FIELDS)
    off = o + rec - c - e
    cols = [F.round(x, 3).alias(n) for x, n in ((o, "opening"), (rec, "received"), (c, "consumed"), (e, "closing"), (off, "off"))]
    return at.where(F.abs(off) > share * F.greatest(o + rec, F.lit(1.0)) + least).select("inventory_id", *cols)
