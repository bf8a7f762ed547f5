"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_date_text(c: Column | str) -> Column:
    """Keep digits and the separators ``- / .`` only."""
    return F.regexp_replace(F.trim(c), r"[^0-9\-/.]", "")


def month_start(c: Column | str) -> Column:
    return F.trunc(c, "MM")


def months_apart(later: Column, earlier: Column) -> Column:
    """Calendar months between two dates."""
    return (F.year(later) - F.year(earlier)) * 12 + (F.month(later) - F.month(earlier))


def floor_months(later: Column, earlier: Column) -> Column:
    """Whole 30-day months, rounded down: one day before is month -1."""
    return F.floor(F.datediff(later, earlier) / 30).cast("int")
