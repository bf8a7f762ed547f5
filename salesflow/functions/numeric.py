"""Number expressions that stay null-safe and do not raise under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column | str, b: Column | str) -> Column:
    """``a / b``; null where ``b`` is zero."""
    b = _col(b).cast("double")
    return _col(a) / F.nullif(b, F.lit(0.0))


def clip(c: Column | str, lo, hi) -> Column:
    """Bound ``c``; null stays null (plain least/greatest skip nulls)."""
    c = _col(c)
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def to_number0(c: Column | str) -> Column:
    """Number from anything; unreadable or null becomes 0."""
    return F.coalesce(_col(c).try_cast("double"), F.lit(0.0))


def total(c: Column | str) -> Column:
    """Sum where nothing to sum gives 0."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over complete pairs; null, not an error, where a side is constant."""
    x, y = _col(x).cast("double"), _col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return safe_div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def cut(c: Column | str, edges: list, labels: list[str]) -> Column:
    """Label of the right-closed bin (``lo < c <= hi``); outside every bin is null."""
    c = _col(c)
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        inside = c > lo if hi is None else (c > lo) & (c <= hi)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def parse_price(c: Column | str) -> Column:
    """Number from currency text: keep digits and dots; null where that is not one number."""
    return F.regexp_replace(_col(c), r"[^0-9.]", "").try_cast("double")
