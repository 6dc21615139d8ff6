"""Dates that stay text until a job needs a calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turfline import fixed
from turfline.functions.text import text


def iso_date(value, layout: str) -> Column:
    """Text date to ISO text; the calendar is not checked, unknown layouts give ''."""
    s = F.trim(text(value))
    if layout == "YYYY-MM-DD":
        return F.regexp_extract(s, "^(\\d{4}-\\d{2}-\\d{2})", 1)
    if layout == "MM/DD/YYYY":
        part = lambda i: F.regexp_extract(s, "^(\\d{1,2})/(\\d{1,2})/(\\d{4})", i)
        iso = F.concat_ws("-", part(3), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"))
        return F.when(part(3) != "", iso).otherwise("")
    if layout == "YYYYMMDD":
        return F.when(
            s.rlike("^\\d{8}"), F.regexp_replace(F.substring(s, 1, 8), "^(\\d{4})(\\d{2})(\\d{2})$", "$1-$2-$3")
        ).otherwise("")
    return F.lit("")


def layout_date(iso, layout: str) -> Column:
    """ISO text written in a source layout (the inverse of :func:`iso_date`)."""
    iso = text(iso)
    if layout == "MM/DD/YYYY":
        return F.regexp_replace(iso, "^(\\d{4})-(\\d{2})-(\\d{2})$", "$2/$3/$1")
    if layout == "YYYYMMDD":
        return F.translate(iso, "-", "")
    return iso


def days_to_deadline(headline, today: str) -> Column:
    """Days from ``today`` to the month and day named in a headline, in the year of ``today``."""
    pattern = "(?i)(" + "|".join(fixed.MONTHS) + ")[a-z.]*\\s+(\\d{1,2})"
    month = F.lower(F.regexp_extract(text(headline), pattern, 1))
    day = F.regexp_extract(text(headline), pattern, 2)
    number = F.array_position(F.array(*[F.lit(m) for m in fixed.MONTHS]), month)
    start = F.make_date(F.lit(int(today[:4])), number.cast("int"), F.lit(1))
    # Overflowing days roll into the next month, as calendar constructors do.
    due = F.date_add(start, F.try_to_number(day, F.lit("99")).cast("int") - 1)
    left = F.datediff(due, F.lit(today).cast("date"))
    return (
        F.when(month == "", F.lit(fixed.DEFAULT_DAYS_LEFT))
        .when(left > 0, left)
        .otherwise(F.lit(fixed.PASSED_DAYS_LEFT))
    )


def days_to_filing(filing, today) -> Column:
    """Whole days until a campaign files, none once the day has passed."""
    return F.greatest(F.lit(0), F.datediff(filing, today))
