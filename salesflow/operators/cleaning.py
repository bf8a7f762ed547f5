"""Cleaning operators and the whole cleaning pipeline.

Steps that use a parsed text more than once put it in a helper column first: inside a CASE branch
Spark would evaluate the text functions again for every use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesflow import fixed_values as fv
from salesflow.functions.dates import strip_date_text
from salesflow.functions.numeric import clip, parse_price
from salesflow.functions.text import capitalize, map_values, parse_flag, strip_text, title_case
from salesflow.operators.filters import divide_where
from salesflow.operators.ordering import counted_values, exact_median, exact_quantiles
from salesflow.session import Scratch, materialize, materialize_buckets, scratch

HEAVY_ID_ROWS = 100_000   # more rows of one id are not left in one bucket
FLAGS = ["is_prime_member", "is_festival_sale", "is_prime_eligible"]


def fill_mode_by_group(df: DataFrame, col: str, group: str, default: str = "Unknown") -> DataFrame:
    """Fill null with the most frequent value of the row's group (smallest on ties).

    A group without values gets ``default``; a row without a group becomes null. The modes are a
    stored table, so the join is a broadcast only if its file is small.
    """
    counts = df.where(F.col(group).isNotNull()).groupBy(group, col).agg(F.count(F.lit(1)).alias("w"))
    best = F.min_by(col, F.when(F.col(col).isNotNull(), F.struct(-F.col("w"), F.col(col))))
    modes = materialize(counts.groupBy(group).agg(F.coalesce(best, F.lit(default)).alias("mode")))
    filled = F.when(F.col(group).isNotNull(), F.coalesce(F.col(col), F.col("mode")))
    return df.join(modes, group, "left").withColumn(col, filled).select(*df.columns)


def _unmarked(key: str, suffix: str) -> Column:
    return F.replace(F.col(key), F.lit(suffix), F.lit(""))


def deal_by_id(df: DataFrame, key: str = "transaction_id", suffix: str = "_DUP") -> DataFrame:
    """The rows, their ids without the duplicate mark, stored in buckets by id for ``dedup_transactions``."""
    return materialize_buckets(df.withColumn(key, _unmarked(key, suffix)), key)


def dedup_transactions(df: DataFrame, order_cols: list[str], key: str = "transaction_id",
                       suffix: str = "_DUP", dealt: DataFrame | None = None) -> DataFrame:
    """Strip the duplicate mark from the id and keep the first row per id by ``order_cols``.

    The rows are stored once, so that what they are made of is not computed again for each step. Hashes of the ids are
    counted first (fixed width, combined on the map side). While the repeated ones are few enough to broadcast, rows whose
    hash occurs once pass as they are, neither shuffled, sorted nor grouped. First rows are a minimum over the row struct,
    combined on the map side, so that many copies of one id never meet in one task; with many repeated ids it is taken over
    all rows, which then are shuffled once. An id that shares its hash with another is merely looked at twice. Columns
    after ``order_cols`` break the remaining ties.

    Rows as wide as the input take several times their stored size in a shuffle. ``dealt`` therefore names the table that
    ``df`` was made from row by row, stored by ``deal_by_id``: the marks are gone then, the rows of an id lie in one bucket, and
    first rows are found bucket by bucket without a shuffle. Only rows of ids that occur more than ``HEAVY_ID_ROWS`` times
    are spread over tasks again and combined there.
    """
    rest = [c for c in df.columns if c != key and c not in order_cols]

    def firsts(rows: DataFrame) -> DataFrame:
        picked = rows.groupBy(key).agg(F.min(F.struct(*order_cols, *rest)).alias("row"))
        return picked.select(*[F.col(c) if c == key else F.col(f"row.{c}").alias(c) for c in df.columns])

    if dealt is not None:
        heavy = materialize(dealt.groupBy(F.col(key).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HEAVY_ID_ROWS))
        if heavy.isEmpty():
            return firsts(df)
        # at most one of HEAVY_ID_ROWS rows each, so the list stays small
        marked = df.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_id")), "left")
        others, spread = marked.where(F.col("_n").isNull()), marked.where(F.col("_n").isNotNull()).repartition(*order_cols)
        return firsts(others.select(*df.columns)).unionByName(firsts(spread.select(*df.columns)))
    clean = materialize(df.withColumn(key, _unmarked(key, suffix)))
    id_hash = F.xxhash64(key)
    again = materialize(clean.groupBy(id_hash.alias("_again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_again"))

    if _is_large(again):
        return firsts(clean)
    marked = clean.join(again, id_hash == F.col("_again"), "left")
    once = marked.where(F.col("_again").isNull()).select(*df.columns)
    return once.unionByName(firsts(marked.where(F.col("_again").isNotNull())))


def _is_large(stored: DataFrame) -> bool:
    """Whether Spark will not broadcast a stored table."""
    limit = stored.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > limit


def by_value(df: DataFrame, col: str, clean: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``clean``, which changes ``col`` alone and row by row, run on the distinct values of ``col`` and looked up for every row.

    The table of values is stored. If it is too large to broadcast, ``clean`` runs on the rows instead. ``df`` should be a
    stored table, since it is read twice.
    """
    table = materialize(clean(df.select(col).distinct().withColumn("_value", F.col(col))).withColumnRenamed(col, "_clean"))
    if _is_large(table):
        return clean(df)
    found = df.join(table, F.col(col).eqNullSafe(F.col("_value")), "left")
    return found.select(*[F.col("_clean").alias(c) if c == col else F.col(c) for c in df.columns])


def normalize_text(df: DataFrame, col: str, spellings: dict[str, str]) -> DataFrame:
    """Trim, title-case and replace known misspellings."""
    return df.withColumn(col, title_case(strip_text(col))).withColumn(col, map_values(col, spellings))


def clean_city(df: DataFrame, col: str = "customer_city") -> DataFrame:
    return normalize_text(df, col, fv.CITY_SPELLINGS)


def clean_category(df: DataFrame, col: str = "category") -> DataFrame:
    return normalize_text(df, col, fv.CATEGORY_SPELLINGS)


def clean_dates(df: DataFrame, col: str = "order_date", iso_swap: bool = True, pivot: int = 76) -> DataFrame:
    """Day-first reading of three-part (or eight-digit) date text; null where impossible.

    A first part that is a year swaps day and month when that is possible (``2015-01-05`` is
    1 May), as the source data was read; ``iso_swap=False`` reads such text plainly. Two-digit
    years below ``pivot`` belong to 20xx, the others to 19xx.
    """
    plain = F.regexp_replace(strip_date_text(col), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    out = df.withColumn("_parts", F.split(plain, r"[-/.]"))
    out = out.withColumns({f"_t{i}": F.when(F.size("_parts") == 3, F.get("_parts", F.lit(i))) for i in range(3)})
    out = out.withColumns({f"_n{i}": F.col(f"_t{i}").try_cast("int") for i in range(3)})
    a, b, c = (F.col(f"_n{i}") for i in range(3))
    year_first = (F.length("_t0") == 4) | (a > 31)
    swapped = (c <= 12) if iso_swap else F.lit(False)
    day_first = (a > 12) | (b <= 12)
    month = F.when(year_first, F.when(swapped, c).otherwise(b)).otherwise(F.when(day_first, b).otherwise(a))
    day = F.when(year_first, F.when(swapped, b).otherwise(c)).otherwise(F.when(day_first, a).otherwise(b))
    out = out.withColumns({
        "_year": F.when(year_first, a).otherwise(c), "_month": month, "_day": day,
        "_digits": F.length(F.when(year_first, F.col("_t0")).otherwise(F.col("_t2"))),
        "_short": F.length(F.when(year_first, F.col("_t2")).otherwise(F.col("_t0"))) <= 2})
    century = F.when(F.col("_year") < pivot, 2000).otherwise(1900)
    year = F.when(F.col("_digits") == 4, F.col("_year")).when(F.col("_digits") <= 2, F.col("_year") + century)
    iso = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(F.col("_month").cast("string"), 2, "0"),
                   F.lit("-"), F.lpad(F.col("_day").cast("string"), 2, "0"))
    fits = F.col("_short") & F.col("_month").between(1, 12) & F.col("_day").between(1, 31)
    return out.withColumn(col, F.when(fits, iso).try_cast("date")).select(*df.columns)


def _delivery_number(df: DataFrame, col: str) -> DataFrame:
    """Days from delivery text, bounded to 0..30; null where no number is given.

    Whole-value words first, then the middle of ``2-5``, then the first number. Every value is a
    multiple of a half in a fixed range.
    """
    out = df.withColumn(col, map_values(F.col(col).cast("string"), fv.DELIVERY_WORDS))
    low, high = (F.regexp_extract(col, r"(\d+)-(\d+)", i).try_cast("double") for i in (1, 2))
    first = F.regexp_extract(col, r"(\d+)", 1).try_cast("double")
    span = F.when(F.col(col).contains("-"), (low + high) / 2)
    out = out.withColumn(col, F.coalesce(span, first))
    return out.withColumn(col, clip(col, 0.0, float(fv.MAX_DELIVERY_DAYS)))


def clean_delivery(df: DataFrame, col: str = "delivery_days", median: Column | None = None) -> DataFrame:
    """Delivery text to whole days; missing is the median (taken after bounding), fractions are cut off.

    Unless ``median`` is given, it is read from the distinct texts. The values are multiples of a half
    between 0 and 30, so the built-in percentile stays small.
    """
    mid = median
    if mid is None:
        counts = _delivery_number(df.groupBy(col).agg(F.count(F.lit(1)).alias("w")), col)
        mid = counts.agg(F.percentile(col, F.lit(0.5), F.col("w"))).scalar()
    days = _delivery_number(df, col)
    return days.withColumn(col, F.coalesce(F.col(col), mid).cast("int"))


def _rating_number(df: DataFrame, col: str) -> DataFrame:
    """First number in rating text; above 5 is null (``3/5`` is 3, ``8/10`` is null)."""
    out = df.withColumn(col, F.regexp_extract(F.col(col).cast("string"), r"\d+\.?\d*", 0).try_cast("double"))
    return out.withColumn(col, F.when(F.col(col) <= fv.MAX_RATING, F.col(col)))


def clean_rating(df: DataFrame, col: str = "customer_rating", fill: str | None = "median",
                 median: Column | None = None) -> DataFrame:
    """Rating text to a number up to 5; missing is the exact median (looked up unless given), or stays null with ``fill=None``."""
    out = _rating_number(df, col)
    if fill != "median":
        return out
    if median is not None:
        return out.withColumn(col, F.coalesce(F.col(col), median))
    counts = _rating_number(df.groupBy(col).agg(F.count(F.lit(1)).alias("w")), col)
    return out.withColumn(col, F.coalesce(F.col(col), exact_median(counts, col, "w")))


def fill_festival(df: DataFrame) -> DataFrame:
    return df.withColumn("festival_name", F.coalesce("festival_name", F.lit(fv.NO_FESTIVAL_NAME)))


def scale_error() -> Column:
    """Rows whose prices were recorded ten times too high."""
    return ((F.lower("brand") == "noise") & (F.lower("subcategory") == "smart watch")
            & (F.col("discounted_price_inr") > fv.SCALE_ERROR_LIMIT))


def fix_scale_errors(df: DataFrame) -> DataFrame:
    return divide_where(df, scale_error(), [c for c in fv.PRICE_COLUMNS if c in df.columns], fv.SCALE_ERROR_DIVISOR)


def count_scale_errors(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.coalesce(scale_error(), F.lit(False))).alias("n_fixed"))


def iqr_bounds(df: DataFrame, cols: list[str]) -> DataFrame:
    """Quartiles and the bounds 1.5 ranges outside them, for all columns in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    q = exact_quantiles(df.select(F.inline(cells)), "value", [0.25, 0.75], ["q1", "q3"], ["column"], few_groups=True)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return q.select("column", "q1", "q3", (F.col("q1") - reach).alias("lower"), (F.col("q3") + reach).alias("upper"))


def cap_iqr(df: DataFrame, cols: list[str], limits: Column | None = None) -> DataFrame:
    """Bound ``cols`` to their IQR limits; null stays null. ``limits`` maps a column to its ``lower`` and ``upper`` bound."""
    if limits is None:
        limits = iqr_bounds(df, cols).agg(F.map_from_entries(F.collect_list(
            F.struct("column", F.struct("lower", "upper"))))).scalar()

    def limit(c: str, side: str) -> Column:
        return F.try_element_at(limits, F.lit(c))[side]

    return df.withColumns({c: clip(c, limit(c, "lower"), limit(c, "upper")) for c in cols})


def pipeline_statistics(df: DataFrame, prices: list[str]) -> Column:
    """Median and IQR limits of delivery days, rating and ``prices``, as one map from column to (median, lower, upper).

    One pass counts the distinct values of all of them; texts are parsed and quartiles taken on those counts.
    """
    counted = counted_values(df, prices, ["delivery_days", "customer_rating"])
    numbers = _rating_number(_delivery_number(counted.withColumns({"days": F.col("text"), "rating": F.col("text")}), "days"), "rating")
    number = F.when(F.col("column") == "delivery_days", F.col("days")).when(F.col("column") == "customer_rating", F.col("rating")).otherwise(F.col("number"))
    q = exact_quantiles(numbers.withColumn("value", number), "value", [0.25, 0.5, 0.75], ["q1", "median", "q3"], ["column"],
                        few_groups=True, weight="w")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return q.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct(
        "median", (F.col("q1") - reach).alias("lower"), (F.col("q3") + reach).alias("upper")))))).scalar()


def clean_sales(raw: DataFrame, order_cols: list[str], iso_swap: bool = True, behind: Scratch | None = None) -> DataFrame:
    """The whole pipeline. The order of steps matters: the mode fill groups by uncleaned labels, and
    medians and quartiles are taken after the duplicates are gone.

    The raw table is stored once, in buckets by id, since its columns are read for modes and distinct values before the rows
    are. Texts are cleaned value by value. The deduplicated table is stored as well: one scan of five columns counts their
    values for all statistics, one final scan applies them. What only an earlier step reads is deleted before the next
    begins, ``behind`` (tables that nothing but ``raw`` reads) first.
    """
    kept = scratch(raw.sparkSession)
    with Scratch(raw.sparkSession):
        raw = deal_by_id(raw)
        if behind:
            behind.close()
        df = fill_mode_by_group(raw, "customer_age_group", "category")
        df = by_value(df, "order_date", lambda d: clean_dates(d, iso_swap=iso_swap))
        prices = [c for c in fv.PRICE_COLUMNS[1:] if c in df.columns]
        df = by_value(df, "customer_city", clean_city).withColumns({
            "product_name": capitalize("product_name"),
            "original_price_inr": parse_price(F.col("original_price_inr").cast("string")),
            **{c: F.col(c).try_cast("double") for c in prices},
        })
        df = materialize(dedup_transactions(df, order_cols, dealt=raw), within=kept, wide=True)
    df = fix_scale_errors(df)
    capped = [c for c in fv.CAPPED_COLUMNS if c in df.columns]
    found = pipeline_statistics(df, capped)
    df = by_value(df, "delivery_days", lambda d: clean_delivery(d, median=F.try_element_at(found, F.lit("delivery_days"))["median"]))
    df = by_value(fill_festival(df), "category", clean_category)
    for c in FLAGS:
        if c in df.columns:
            df = by_value(df, c, lambda d, c=c: d.withColumn(c, parse_flag(c)))
    rating = F.try_element_at(found, F.lit("customer_rating"))["median"]
    return by_value(cap_iqr(df, capped, found), "customer_rating", lambda d: clean_rating(d, median=rating))
