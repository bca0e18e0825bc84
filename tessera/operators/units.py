"""Quantities recorded in different units, brought to one unit per dimension.

Each number is seen on a log scale. There a unit is a known offset, so the numbers of one item at one branch, written in
several units, form a mixture of equal bells whose distances are known: ln(number) = ln(amount) - ln(size of the unit).
Locations (per item, branch and field), the common spread and the shares of units given a label are fitted by expectation
maximisation over a histogram of the whole table; then every cell gets the unit of the highest posterior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from tessera.functions import quantity as Q
from tessera.functions.keys import key_or_null
from tessera.session import cut

#: Fields of a stock sheet that are written in its unit.
FIELDS = ("opening_stock", "received_stock", "consumed_stock", "closing_stock")

# The sizes, in the common unit, that a number without a believable label may have.
COMPONENTS = {
    "weight": (1.0, 0.001, 0.45359237, 0.028349523125, 25.0, 10.0),
    "volume": (1.0, 0.001, 0.01, 3.785411784, 20.0, 0.75),
    "count": (1.0, 2.0, 12.0, 24.0),
}
#: Sizes that only a label can tell: contents of packages.
PACKAGES = (25.0, 10.0, 20.0, 0.75, 24.0)


@dataclass(frozen=True)
class UnitModel:
    """Settings of the mixture.

    tolerance: expectation maximisation ends when the spread and no share moves by more. bin: width of the histogram's bins on the log scale. freedom: of the t
    distribution that stands for the bell, whose tails carry months with hardly any consumption. doubt: a label is not
    believed when its posterior is below this. plain: and only if the numbers are off by at least this factor.
    sure: assignments with a posterior below this are flagged as uncertain. impossible: numbers from this on are no stock.
    """

    tolerance: float = 0.005
    bin: float = 0.05
    freedom: float = 3.0
    doubt: float = 0.01
    plain: float = 5.0
    sure: float = 0.9
    impossible: float = 1e6


def parse(sheets: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Adds, for each field f, f__num (double), f__dim, f__size (of the unit written in the cell, null if none); and
    unit__dim, unit__size of the unit column; _branch and _item, the keys, null for stand-ins.
    """
    base = sheets.withColumns({"_branch": key_or_null("restaurant_id"), "_item": key_or_null("item_id")})
    kinds = {"num": DoubleType(), "dim": StringType(), "size": DoubleType()}
    names = [f"{f}__{x}" for f in fields for x in kinds] + ["unit__dim", "unit__size"]
    schema = StructType([*base.schema.fields, *[StructField(n, kinds[n.rsplit("__", 1)[1]]) for n in names]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, labels = lru_cache(200_000)(Q.read_cell), lru_cache(10_000)(Q.read_unit)
        for b in batches:
            for f in fields:
                b[[f"{f}__num", f"{f}__dim", f"{f}__size"]] = pd.DataFrame([cells(x) for x in b[f]], index=b.index, columns=["num", "dim", "size"], dtype=object)
            b[["unit__dim", "unit__size"]] = pd.DataFrame([labels(x) for x in b["unit"]], index=b.index, columns=["dim", "size"], dtype=object)
            for n in names:
                if not n.endswith("dim"):
                    b[n] = pd.to_numeric(b[n])
            yield b

    return base.mapInPandas(run, schema)


def usable(c: Column, model: UnitModel = UnitModel()) -> Column:
    """Whether a number can be an amount of stock that tells its unit: above 0 and not a stand-in like 9999999."""
    return (c > 0) & (c < model.impossible)


DIMENSIONS = tuple(COMPONENTS)
#: The most components that a dimension has; dimensions with fewer are filled up with ones that are never taken.
WIDEST = max(map(len, COMPONENTS.values()))
_SIZES = np.array([[*sizes, *[1.0] * (WIDEST - len(sizes))] for sizes in COMPONENTS.values()])
_REAL = np.array([[c < len(sizes) for c in range(WIDEST)] for sizes in COMPONENTS.values()])


def _dim_no(dim: pd.Series) -> np.ndarray:
    """Number of each dimension; weight where it is unknown."""
    return dim.map({d: k for k, d in enumerate(DIMENSIONS)}).fillna(0).to_numpy(dtype=np.int64)


def _label_no(size: np.ndarray, dim: np.ndarray) -> np.ndarray:
    """The component (from 1) that a label of this size means; 0 if there is no label or the dimension lacks its size."""
    with np.errstate(invalid="ignore"):
        near = (np.abs(size[:, None] / _SIZES[dim] - 1) < 0.05) & _REAL[dim]
    return np.where(near.any(axis=1), near.argmax(axis=1) + 1, 0)


def _ln_shares(shares: dict) -> np.ndarray:
    """ln shares by dimension, label and component."""
    out = np.full((len(DIMENSIONS), WIDEST + 1, WIDEST), -1e6)
    for (dim, label, c), v in shares.items():
        out[DIMENSIONS.index(dim), label, c - 1] = np.log(v)
    return out


def _fit_of(x: np.ndarray, mu: np.ndarray, dim: np.ndarray, spread: float, model: UnitModel) -> np.ndarray:
    """ln density, up to a constant, of each ln number under each component; 0 where the number or its location is unknown."""
    z = (x[:, None] + np.log(_SIZES[dim]) - mu[:, None]) / spread
    return np.nan_to_num(-(model.freedom + 1) / 2 * np.log1p(z * z / model.freedom), nan=0.0)


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _long(parsed: DataFrame) -> DataFrame:
    """One row per usable number, with the label that holds for it."""
    cells = F.explode(
        F.array(*[
            F.struct(F.lit(f).alias("field"), F.col(f"{f}__num").alias("num"), F.coalesce(f"{f}__size", "unit__size").alias("size"), F.coalesce(f"{f}__dim", "unit__dim").alias("dim"))
            for f in FIELDS
        ])
    )
    return parsed.select("_branch", "_item", cells.alias("c")).select("_branch", "_item", "c.*").where(usable(F.col("num")))


def fit(parsed: DataFrame, model: UnitModel = UnitModel()) -> tuple[DataFrame, DataFrame, dict]:
    """Fits the mixture; gives (item dimensions, locations, shares and spread).

    Item dimensions: _item, item_dim. Locations: _branch, _item, mu (map field -> ln of the typical amount), with rows of a
    null branch for the item as a whole and of null branch and item, keyed by dim, for a dimension. All statistics cover all
    rows; the rows are first counted into a histogram, whose size depends on items and branches only.
    """
    long = _long(parsed)
    dims = (
        long.where(F.col("_item").isNotNull() & F.col("dim").isNotNull())
        .groupBy("_item", "dim")
        .count()
        .groupBy("_item")
        .agg(F.max_by("dim", F.struct("count", "dim")).alias("item_dim"))
    )
    # a label's meaning as ln of its size; 0 and no meaning where the label is of another dimension
    meant = F.when((F.col("dim") == F.col("dim_")) & (F.col("size") > 0), F.round(F.ln("size"), 4))
    bins = (
        long.join(dims, "_item", "left")
        .withColumn("dim_", F.coalesce("item_dim", "dim"))
        .where(F.col("dim_").isNotNull())
        .groupBy("_branch", "_item", "field", "dim_", meant.alias("meant"), F.round(F.ln("num") / model.bin).cast("int").alias("bin"))
        .agg(F.count("*").cast("double").alias("n"))
        .select("_branch", "_item", "field", "dim_", F.struct(F.coalesce("meant", F.lit(float("nan"))).alias("meant"), (F.col("bin") * model.bin).alias("x"), "n").alias("h"))
    )
    # a cell keeps its histogram, as many entries as a cell has bins and labels, so that rounds never go back to rows
    cells = cut(bins.groupBy("_branch", "_item", "field", "dim_").agg(F.collect_list("h").alias("hist")), "unit-cells")
    told = cells.select("_item", "dim_", "field", F.inline("hist")).where(~F.isnan("meant"))
    middle = F.percentile(F.col("x") + F.col("meant"), F.lit(0.5), F.col("n").cast("bigint"))
    place = {(r.dim_, r.field): r.m for r in told.groupBy("dim_", "field").agg(middle.alias("m")).collect()}  # a row per dimension and field
    items = told.where("_item is not null").groupBy("_item", "field").agg(middle.alias("m_item"))
    state = cells.withColumns({"n": F.lit(None).cast("double"), "sy": F.lit(None).cast("double")})
    spread, shares = 0.3, _first_shares()
    for _ in range(MOST_ROUNDS):
        done = cut(_expect(state.join(items, ["_item", "field"], "left"), place, shares, spread, model), "unit-sums")
        was = shares, spread
        shares, spread = _global_step(done.where("label is not null"), shares)
        state = done.where("label is null").select(*cells.columns, "n", "sy")
        place = {(r.dim_, r.field): r.m for r in state.where("n > 0").groupBy("dim_", "field").agg((F.sum("sy") / F.sum("n")).alias("m")).collect()}
        items = state.where("_item is not null and n > 0").groupBy("_item", "field").agg((F.sum("sy") / F.sum("n")).alias("m_item"))
        if abs(spread - was[1]) <= model.tolerance and all(abs(v - was[0][k]) <= model.tolerance for k, v in shares.items()):
            break
    else:
        raise RuntimeError(f"the mixture hasn't settled after {MOST_ROUNDS} rounds")
    return dims, cut(_locations(state.where("n > 0")), "unit-mu"), {"spread": spread, "shares": shares}


#: Rounds at most; a table that needs more raises, rather than giving what hasn't settled.
MOST_ROUNDS = 100


def _first_shares() -> dict[tuple[str, int, int], float]:
    """Shares of units given a label before any are fitted: a label mostly means what it says."""
    out = {}
    for dim, sizes in COMPONENTS.items():
        k = len(sizes)
        for label in range(k + 1):
            for c in range(1, k + 1):
                out[dim, label, c] = 0.9 if label == c else 0.1 / (k - 1) if label else (0.7 if c == 1 else 0.3 / (k - 1))
    return out


def _locations(cells: DataFrame) -> DataFrame:
    """Typical ln amounts per branch and item, per item, and per dimension, each as a map by field.

    cells: sums sy and n. The location of a branch leans on its item's as if by two more numbers.
    """
    at = F.sum("sy") / F.sum("n")
    wide = lambda df, keys: df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("field", "m"))).alias("mu"))
    items = cells.where("_item is not null").groupBy("_item", "field").agg(at.alias("m_item"))
    both = cells.where("_item is not null and _branch is not null").groupBy("_branch", "_item", "field").agg(at.alias("m_own"), F.sum("n").alias("n_own"))
    both = both.join(items, ["_item", "field"]).withColumn("m", (F.col("m_own") * F.col("n_own") + 2 * F.col("m_item")) / (F.col("n_own") + 2))
    dims = cells.groupBy("dim_", "field").agg(at.alias("m"))
    return (
        wide(both, ["_branch", "_item"])
        .withColumn("dim_", F.lit(None).cast("string"))
        .unionByName(wide(items.withColumnRenamed("m_item", "m"), ["_item"]).withColumns({"_branch": F.lit(None).cast("string"), "dim_": F.lit(None).cast("string")}))
        .unionByName(wide(dims, ["dim_"]).withColumns({"_branch": F.lit(None).cast("string"), "_item": F.lit(None).cast("string")}))
    )


def with_locations(df: DataFrame, mu: DataFrame) -> DataFrame:
    """Adds mu: of the branch and item, else of the item, else of the dimension dim_."""
    own = mu.where("_branch is not null").select("_branch", "_item", F.col("mu").alias("mu_own"))
    item = mu.where("_branch is null and _item is not null").select("_item", F.col("mu").alias("mu_item"))
    dim = mu.where("dim_ is not null").select("dim_", F.col("mu").alias("mu_dim"))
    return df.join(own, ["_branch", "_item"], "left").join(item, "_item", "left").join(dim, "dim_", "left")


def _mu(field: Column) -> Column:
    return F.coalesce(F.try_element_at("mu_own", field), F.try_element_at("mu_item", field), F.try_element_at("mu_dim", field))


_SUMS = ["n", "dev", *[f"w{c}" for c in range(1, WIDEST + 1)]]


def _median(x: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    at = np.cumsum(n[order])
    return float(x[order][np.searchsorted(at, at[-1] / 2)])


def _expect(cells: DataFrame, place: dict, shares: dict, spread: float, model: UnitModel) -> DataFrame:
    """One round over the cells' histograms: the cells with new n and sy (of expected ln amounts), and, with a label, sums over all
    cells of a batch: n, dev (of deviations), w1, w2, ... (per component).

    cells: _branch, _item, field, dim_, hist, n, sy (null before the first round), m_item. Arithmetic runs in numpy; as columns, the six
    components made plans of megabytes, whose planning took the driver longer than the rows.
    """
    table = _ln_shares(shares)
    keys = ["_branch", "_item", "field", "dim_"]
    schema = StructType([*[f for f in cells.schema.fields if f.name in (*keys, "hist")]] + [StructField("label", IntegerType())] + [StructField(c, DoubleType()) for c in ("sy", *_SUMS)])
    columns = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.reset_index(drop=True)
            size = b["hist"].map(len).to_numpy()
            start = np.cumsum(size) - size
            row = np.repeat(np.arange(len(b)), size)
            flat = [h for hist in b["hist"] for h in hist]
            meant, x, n = (np.array([h[k] for h in flat], dtype=float) for k in ("meant", "x", "n"))
            own_n, own_sy = b["n"].to_numpy(float).copy(), b["sy"].to_numpy(float).copy()
            for k in np.flatnonzero(np.isnan(own_n)):  # before the first round: what labels say
                mine = slice(start[k], start[k] + size[k])
                a, w = (x + meant)[mine], n[mine]
                a, w = a[~np.isnan(a)], w[~np.isnan(a)]
                own_n[k], own_sy[k] = (w.sum(), w.sum() * _median(a, w)) if len(a) else (0.0, 0.0)
            m_item = b["m_item"].to_numpy(float)
            m_dim = np.array([place.get(k, np.nan) for k in zip(b["dim_"], b["field"])], dtype=float)
            both = (b["_branch"].notna() & b["_item"].notna()).to_numpy() & (own_n > 0) & ~np.isnan(m_item)
            m = np.where(both, (own_sy + 2 * np.nan_to_num(m_item)) / (own_n + 2), np.where(np.isnan(m_item), m_dim, m_item))[row]
            dim = _dim_no(b["dim_"])[row]
            label = _label_no(np.exp(meant), dim)
            seen = ~np.isnan(m)
            p = _softmax(table[dim, label] + _fit_of(x, m, dim, spread, model))
            ln_size = np.log(_SIZES[dim])
            n = np.where(seen, n, 0.0)
            out = b[[*keys, "hist"]].copy()
            out["label"] = pd.array([None] * len(b), dtype="Int32")
            out["n"] = np.bincount(row, weights=n, minlength=len(b))
            out["sy"] = np.bincount(row, weights=n * (x + (p * ln_size).sum(axis=1)), minlength=len(b))
            out[_SUMS[1:]] = np.nan
            yield out[columns]
            far = np.minimum(np.abs(x[:, None] + ln_size - m[:, None]), 1.0)
            sums = pd.DataFrame(n[:, None] * p, columns=_SUMS[2:]).assign(dim_=np.array(DIMENSIONS, dtype=object)[dim], label=label, n=n, dev=n * np.nan_to_num((p * far).sum(axis=1)))
            sums = sums.groupby(["dim_", "label"], as_index=False)[_SUMS].sum()
            sums["label"] = sums["label"].astype("Int32")
            yield sums.assign(_branch=None, _item=None, field=None, hist=None, sy=np.nan)[columns]

    return cells.mapInPandas(run, schema)


def _global_step(sums: DataFrame, before: dict) -> tuple[dict, float]:
    """New shares and spread. What comes to the driver has a row per dimension and label."""
    rows = sums.groupBy("dim_", "label").agg(F.sum("n").alias("n"), F.sum("dev").alias("dev"), *[F.sum(f"w{c}").alias(f"w{c}") for c in range(1, WIDEST + 1)]).collect()
    seen = {(r.dim_, r.label): r for r in rows}
    shares = {}
    for (dim, label, c), was in before.items():
        k = len(COMPONENTS[dim])
        # a label counts as seen a few times in its own meaning, so that one that is rare isn't turned round
        prior = 5.0 if label == c else 0.02 / k
        r = seen.get((dim, label))
        shares[dim, label, c] = (r[f"w{c}"] + prior) / (r.n + 5.0 * bool(label) + 0.02) if r else was
        if label != c and COMPONENTS[dim][c - 1] in PACKAGES:
            shares[dim, label, c] = 0.0  # a number is taken for one of packages only where its label says so
        shares[dim, label, c] = max(shares[dim, label, c], 1e-9)
    weight = sum(r.n for r in rows)
    return shares, max(0.05, 1.1 * sum(r.dev for r in rows) / weight) if weight else 0.3


def assign(parsed: DataFrame, fitted: tuple[DataFrame, DataFrame, dict], model: UnitModel = UnitModel()) -> DataFrame:
    """Adds item_dim and, for each field f, f__used (size of its unit), f__post (posterior), f__believed (null without label).

    Numbers of a sheet that bear no unit of their own share one: their evidence is added up. A number with its own unit is
    judged alone.
    """
    dims, mu, par = fitted
    first_dim = F.coalesce("item_dim", "unit__dim", *[f"{f}__dim" for f in FIELDS])
    at = with_locations(parsed.join(dims, "_item", "left").withColumn("dim_", first_dim), mu)
    at = at.select(*parsed.columns, "item_dim", "dim_", *[_mu(F.lit(f)).alias(f"{f}__mu") for f in FIELDS])
    table, spread = _ln_shares(par["shares"]), par["spread"]
    added = {f"{f}__{x}": kind for f in FIELDS for x, kind in (("used", "double"), ("post", "double"), ("believed", "boolean"))}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            dim = _dim_no(b["dim_"])
            known = b["dim_"].notna().to_numpy()
            fits, own, labels, sizes, fitting = {}, {}, {}, {}, {}
            for f in (*FIELDS, "unit"):
                sizes[f] = b[f"{f}__size"].to_numpy(float)
                same = (b[f"{f}__dim"] == b["dim_"]).to_numpy() & known
                fitting[f] = same
                labels[f] = np.where(same | ~b[f"{f}__dim"].notna().to_numpy(), _label_no(sizes[f], dim), 0)
            sheet = table[dim, labels["unit"]].copy()
            for f in FIELDS:
                num = b[f"{f}__num"].to_numpy(float)
                with np.errstate(all="ignore"):
                    x = np.where((num > 0) & (num < model.impossible), np.log(num), np.nan)
                fits[f] = _fit_of(x, b[f"{f}__mu"].to_numpy(float), dim, spread, model)
                own[f] = ~np.isnan(sizes[f])
                sheet += np.where(own[f][:, None], 0.0, fits[f])
            out = b.copy()
            rows = np.arange(len(b))
            for f in FIELDS:
                p = _softmax(np.where(own[f][:, None], table[dim, labels[f]] + fits[f], sheet))
                best = p.argmax(axis=1)
                size = np.where(own[f], sizes[f], sizes["unit"])
                same = np.where(own[f], fitting[f], fitting["unit"])
                no = np.where(same, np.where(own[f], labels[f], labels["unit"]), 0)
                mine = p[rows, np.maximum(no - 1, 0)]
                with np.errstate(all="ignore"):
                    refuted = (no > 0) & (mine < model.doubt) & (np.abs(np.log(_SIZES[dim, best] / size)) >= np.log(model.plain))
                kept, strange = (no > 0) & ~refuted, (no == 0) & same & ~np.isnan(size)
                # a label of the right dimension whose size the list lacks is taken at its word
                out[f"{f}__used"] = np.where(kept | strange, size, _SIZES[dim, best])
                out[f"{f}__post"] = np.where(kept, mine, np.where(strange, 1.0, p.max(axis=1)))
                out[f"{f}__believed"] = pd.Series(np.where(np.isnan(size), None, same & ~refuted), index=b.index, dtype=object)
            yield out

    schema = StructType([*at.schema.fields, *[StructField(k, DoubleType() if v == "double" else BooleanType()) for k, v in added.items()]])
    return at.mapInPandas(run, schema).drop(*[f"{f}__mu" for f in FIELDS])


def normalised(sheets: DataFrame, model: UnitModel = UnitModel(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Stock sheets with every number in its item's common unit.

    Input: inventory_id, restaurant_id, item_id, the four FIELDS as text, unit; other columns are dropped but for those in keep.
    Adds per field f: f__num (the number as written), f__used, f__post, f__believed and f__common (in kg, liters or pcs). A
    number that no stock can be (negative, 1e6 and more) or text gives a null f__common; zero stays zero. Rows with a null item
    or unit are judged by what is left of item, branch and dimension. Empty input gives no rows.
    """
    parsed = cut(parse(sheets.select("inventory_id", "restaurant_id", "item_id", *FIELDS, "unit", *keep)), "sheets")
    at = assign(parsed, fit(parsed, model), model)
    return at.withColumns({
        f"{f}__common": F.when((F.col(f"{f}__num") >= 0) & (F.col(f"{f}__num") < model.impossible), F.col(f"{f}__num") * F.col(f"{f}__used")) for f in FIELDS
    })


def unit_cells(sheets: DataFrame, model: UnitModel = UnitModel(), fields: tuple[str, ...] = ("consumed_stock", "closing_stock")) -> DataFrame:
    """One row per cell of `fields` that holds a number: what it was, which unit it is in, and its amount in the common unit.

    Columns: inventory_id, field_name, raw, number, unit_size, common_unit, amount, posterior, label_believed, uncertain,
    must_change (the number isn't in the common unit; never for zeros and for numbers that no stock can be).
    """
    at = normalised(sheets, model)
    cell = F.explode(
        F.array(*[
            F.struct(
                F.lit(f).alias("field_name"), F.col(f).alias("raw"), F.col(f"{f}__num").alias("number"), F.col(f"{f}__used").alias("unit_size"),
                F.col(f"{f}__common").alias("amount"), F.col(f"{f}__post").alias("posterior"), F.col(f"{f}__believed").alias("label_believed"),
            )
            for f in fields
        ])
    )
    common = F.when(F.col("dim_") == "volume", F.lit("liters")).when(F.col("dim_") == "count", F.lit("pcs")).when(F.col("dim_") == "weight", F.lit("kg"))
    return (
        at.select("inventory_id", common.alias("common_unit"), cell.alias("c"))
        .select("inventory_id", "c.*", "common_unit")
        .where(F.col("amount").isNotNull())
        .withColumn("uncertain", (F.col("posterior") < model.sure) & (F.col("number") > 0))
        .withColumn("must_change", (F.col("number") > 0) & (F.abs(F.col("unit_size") - 1.0) > 1e-9))
    )
