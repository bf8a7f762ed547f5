"""Text expressions: trimming, casing and spelling maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesflow import fixed_values as fv


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_text(c: Column | str) -> Column:
    """Drop white space, tabs and line ends at both sides."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def capitalize(c: Column | str) -> Column:
    """First character upper case, the rest lower case."""
    c = _col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))


def title_case(c: Column | str) -> Column:
    """Upper-case every letter that follows a non-letter (``delhi-ncr`` gives ``Delhi-Ncr``).

    Built-in ``initcap`` restarts after spaces only, so a marked space is put behind every other
    non-letter and taken out again.
    """
    mark = "\u0001 "
    spaced = F.regexp_replace(_col(c), r"([^\p{L} ])(?=\p{L})", "$1" + mark)
    return F.replace(F.initcap(spaced), F.lit(mark), F.lit(""))


def map_values(c: Column | str, mapping: dict[str, str]) -> Column:
    """Replace values found in ``mapping``; others pass through."""
    c = _col(c)
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def map_state(c: Column | str) -> Column:
    return map_values(c, fv.STATE_NAMES)


def festival_key(c: Column | str) -> Column:
    """Festival of a free-text name: first keyword hit in the fixed order, else a marker."""
    text = F.lower(F.coalesce(_col(c), F.lit("")))
    out = None
    for label, words in fv.FESTIVAL_KEYWORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(fv.NO_FESTIVAL_KEY)


def parse_flag(c: Column | str) -> Column:
    """Mixed yes/no/1/0/true/false text to boolean; anything else is null."""
    words = [(w, flag) for flag, ws in ((True, fv.TRUE_WORDS), (False, fv.FALSE_WORDS)) for w in ws]
    table = F.create_map(*[F.lit(x) for pair in words for x in pair])
    return F.try_element_at(table, F.lower(strip_text(_col(c).cast("string"))))


def is_returned(c: Column | str) -> Column:
    return F.coalesce(F.lower(_col(c).cast("string")).isin(fv.RETURNED_WORDS), F.lit(False))


def return_flag(c: Column | str) -> Column:
    return F.when(is_returned(c), "Returned").otherwise("Kept")
