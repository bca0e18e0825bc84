"""Calendar days out of raw text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.keys import col, strip

#: Notations of a day that are read; the first that matches counts. A day that no calendar has gives null.
DAY_PATTERNS = (
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?$", (1, 2, 3)),  # 2025-03-09, with or without a time
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", (1, 2, 3)),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?: \d{1,2}:\d{2}(?::\d{2})?)?$", (3, 1, 2)),  # month first
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", (3, 2, 1)),  # day first
)


def real_day(c: str | Column) -> Column:
    """The day that text c names, or null if it is blank, no date, or an impossible one (2025-02-30).

    Notations: yyyy-MM-dd with or without a time, yyyy/MM/dd, M/d/yyyy, d.M.yyyy.
    """
    text = strip(col(c))
    out = F.lit(None).cast("date")
    for pattern, (y, m, d) in reversed(DAY_PATTERNS):
        part = lambda g, width: F.lpad(F.regexp_extract(text, pattern, g), width, "0")  # noqa: B023, E731
        iso = F.concat_ws("-", part(y, 4), part(m, 2), part(d, 2))
        out = F.when(text.rlike(pattern), iso.try_cast("date")).otherwise(out)
    return out


def season(day: str | Column) -> Column:
    """Winter (December to February), Spring, Summer or Autumn; null where the day is."""
    m = F.month(col(day))
    return F.when(m.isNull(), None).when(m.isin(12, 1, 2), "Winter").when(m <= 5, "Spring").when(m <= 8, "Summer").otherwise("Autumn")


def time_of_day(at: str | Column) -> Column:
    """Morning (5 to 11), Afternoon (12 to 16), Evening (17 to 21) or Night; null where the time is."""
    h = F.hour(col(at))
    return F.when(h.isNull(), None).when(h.between(5, 11), "Morning").when(h.between(12, 16), "Afternoon").when(h.between(17, 21), "Evening").otherwise("Night")
