"""Numbers and units out of raw text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.keys import WHITE_SPACE, col, let, strip

# Units of each dimension as (spellings, size in the common unit). Common units: kg, liters, pcs.
UNITS = {
    "weight": (
        (("kg", "kgs", "kilo", "kilos", "kilogram", "kilograms", "kilogramme", "kilogrammes"), 1.0),
        (("g", "gr", "gm", "gms", "gram", "grams", "gramme", "grammes"), 0.001),
        (("mg", "milligram", "milligrams"), 0.000001),
        (("lb", "lbs", "pound", "pounds"), 0.45359237),
        (("oz", "ounce", "ounces"), 0.028349523125),
    ),
    "volume": (
        (("l", "lt", "ltr", "ltrs", "litre", "litres", "liter", "liters"), 1.0),
        (("ml", "millilitre", "millilitres", "milliliter", "milliliters"), 0.001),
        (("cl", "centilitre", "centilitres", "centiliter", "centiliters"), 0.01),
        (("dl", "decilitre", "decilitres", "deciliter", "deciliters"), 0.1),
        (("gal", "gals", "gallon", "gallons"), 3.785411784),
        (("qt", "quart", "quarts"), 0.946352946),
    ),
    "count": (
        (("pc", "pcs", "pce", "pces", "piece", "pieces", "each", "ea", "unit", "units"), 1.0),
        (("pair", "pairs", "pr"), 2.0),
        (("dozen", "dozens", "doz", "dz"), 12.0),
    ),
}
#: Words for a package whose content, where no unit follows the number, is counted in pieces.
COUNTED_PACKAGES = ("tray", "trays", "box", "boxes", "pack", "packs", "case", "cases", "carton", "cartons")
COMMON = {"weight": "kg", "volume": "liters", "count": "pcs"}

_WORDS = {w: (dim, size) for dim, units in UNITS.items() for words, size in units for w in words}
_NUMBER = r"[-+]?[0-9][0-9.,' \u00a0\u202f]*"
_UNIT_WORD = "(?:^|[^a-z])(" + "|".join(sorted(_WORDS, key=lambda w: (-len(w), w))) + ")(?:[^a-z]|$)"


def number_text(c: str | Column) -> Column:
    """The leading number of a cell, as written; empty if the cell doesn't begin with one and continue with a unit or end."""
    return F.trim(F.regexp_extract(strip(col(c)), "^(" + _NUMBER + r")\s*(?:[A-Za-z(].*)?$", 1))


def unit_text(c: str | Column) -> Column:
    """What a cell says after its number, in lower case; empty if nothing."""
    return F.lower(strip(F.regexp_extract(strip(col(c)), "^" + _NUMBER + r"\s*([A-Za-z(].*)$", 1)))


def to_number(c: str | Column) -> Column:
    """Number text as double; null where it is none.

    Where point and comma both occur the later one is the decimal sign. A comma followed by exactly three digits, after
    one to three digits not led by 0, groups thousands; any other single comma is a decimal sign. A single point always is
    one.
    """
    bare = F.regexp_replace(col(c), r"[' \u00a0\u202f]", "")

    def read(t: Column) -> Column:
        grouped = t.rlike(r"^[-+]?[1-9][0-9]{0,2}(?:,[0-9]{3})+(?:\.[0-9]+)?$")
        dotted = t.rlike(r"^[-+]?[1-9][0-9]{0,2}(?:\.[0-9]{3})+,[0-9]+$") | t.rlike(r"^[-+]?[1-9][0-9]{0,2}(?:\.[0-9]{3}){2,}$")
        return (
            F.when(~t.contains(",") & ~dotted, t)
            .when(grouped, F.replace(t, F.lit(","), F.lit("")))
            .when(dotted, F.translate(F.replace(t, F.lit("."), F.lit("")), ",", "."))
            .otherwise(F.translate(t, ",", "."))
            .try_cast("double")
        )

    return let(bare, read)


def unit_of(label: str | Column) -> Column:
    """What a label means, as struct(dim, size): weight, volume or count, and how much of the common unit it is.

    "25 kg sack" -> (weight, 25.0), "tray of 24" -> (count, 24.0): a package counts with its content. Null if no unit is named.
    """
    sizes = F.create_map(*[F.lit(x) for w, (_, size) in _WORDS.items() for x in (w, size)])
    kinds = F.create_map(*[F.lit(x) for w, (dim, _) in _WORDS.items() for x in (w, dim)])

    def read(low: Column) -> Column:
        content = F.coalesce(to_number(F.regexp_extract(low, "([0-9]+(?:[.,][0-9]+)?)", 1)), F.lit(1.0))
        counted = low.rlike("[0-9]") & low.rlike(r"(?:^|[^a-z])(?:" + "|".join(COUNTED_PACKAGES) + ")(?:[^a-z]|$)")
        return let(
            F.regexp_extract(low, _UNIT_WORD, 1),
            lambda w: F.when(w != "", F.struct(F.element_at(kinds, w).alias("dim"), (F.element_at(sizes, w) * content).alias("size"))).when(
                counted, F.struct(F.lit("count").alias("dim"), content.alias("size"))
            ),
        )

    return let(F.lower(strip(col(label))), read)


# ---------------------------------------------------------------- the same in Python, for columns that go through Arrow anyway

_PY_CELL = re.compile("(" + _NUMBER + r")\s*([A-Za-z(].*)?", re.S)
_PY_GROUPED = re.compile(r"[-+]?[1-9][0-9]{0,2}(?:,[0-9]{3})+(?:\.[0-9]+)?")
_PY_DOTTED = re.compile(r"[-+]?[1-9][0-9]{0,2}(?:(?:\.[0-9]{3})+,[0-9]+|(?:\.[0-9]{3}){2,})")
_PY_UNIT = re.compile(_UNIT_WORD)
_PY_CONTENT = re.compile("[0-9]+(?:[.,][0-9]+)?")
_PY_COUNTED = re.compile(r"(?:^|[^a-z])(?:" + "|".join(COUNTED_PACKAGES) + ")(?:[^a-z]|$)")


def read_number(text: str) -> float | None:
    """`to_number` of a text."""
    t = re.sub("[' \u00a0\u202f]", "", text)
    if "," in t or _PY_DOTTED.fullmatch(t):
        t = t.replace(",", "") if _PY_GROUPED.fullmatch(t) else t.replace(".", "").replace(",", ".") if _PY_DOTTED.fullmatch(t) else t.replace(",", ".")
    return float(t) if re.fullmatch(r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", t) else None


def read_unit(label: str | None) -> tuple[str | None, float | None]:
    """`unit_of` a label: (dimension, size), (None, None) if it names no unit."""
    low = (label or "").strip(WHITE_SPACE).lower()
    word, content = _PY_UNIT.search(low), _PY_CONTENT.search(low)
    size = (read_number(content.group()) if content else None) or 1.0
    if word:
        dim, one = _WORDS[word.group(1)]
        return dim, one * size
    return ("count", size) if content and _PY_COUNTED.search(low) else (None, None)


def read_cell(cell: str | None) -> tuple[float | None, str | None, float | None]:
    """A cell's number, and the dimension and size of the unit written after it; all None if it doesn't begin with a number."""
    m = _PY_CELL.fullmatch((cell or "").strip(WHITE_SPACE))
    if not m:
        return None, None, None
    number, own = read_number(m.group(1).strip()), (m.group(2) or "").strip(WHITE_SPACE)
    return (number, *(read_unit(own) if own else (None, None)))
