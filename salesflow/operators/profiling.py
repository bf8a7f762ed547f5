"""Profiling: shape, nulls, types, distinct counts, describe, value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.functions.numeric import safe_div
from salesflow.functions.text import strip_text
from salesflow.operators.aggregate import top_n
from salesflow.operators.filters import find_products
from salesflow.operators.ordering import counted_values, exact_quantiles
from salesflow.operators.sketches import DISTINCT_BOUND, build_sketches, distinct_of
from salesflow.session import materialize

_NUMBER = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def profile_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def profile_nulls(df: DataFrame) -> DataFrame:
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return agg.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null"))
                                         for c in df.columns])))


def profile_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column string, type string")


def infer_types(df: DataFrame) -> DataFrame:
    """What each column is and holds: column, type, n_values, and how many values read as a whole number, a number and an ISO date,
    with the narrowest type that reads all of them. Texts are looked at once per distinct value."""
    whole, number, date = (F.col("value").rlike(p) for p in (r"^[+-]?[0-9]+$", r"^[+-]?[0-9]+(\.[0-9]+)?$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))

    def times(hit):
        return F.coalesce(F.sum(F.when(hit, F.col("w"))), F.lit(0))

    found = _long_counts(df, df.columns).groupBy("column").agg(
        F.sum("w").alias("n_values"), times(whole).alias("n_whole"), times(number).alias("n_number"), times(date).alias("n_date"))
    n = F.col("n_values")
    suggested = F.when(F.col("n_whole") == n, "bigint").when(F.col("n_number") == n, "double").when(F.col("n_date") == n, "date").otherwise("string")
    return found.join(F.broadcast(profile_types(df)), "column").select("column", "type", "n_values", "n_whole", "n_number", "n_date", suggested.alias("suggested"))


def _long_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """How often each non-null value occurs in each column; repeats are combined on the map side."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return (df.select(F.inline(cells)).where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("w")))


def profile_nunique(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct non-null values per column: exact, or by sketches in one pass that shuffles a few kilobytes per column."""
    cols = df.columns
    if approx:
        agg = distinct_of(build_sketches(df, [], counted=cols), cols)
        return agg.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_unique")) for c in cols])))
    return _long_counts(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))


def nunique_holds(df: DataFrame) -> DataFrame:
    """Exact distinct counts, and whether the sketched ones are within ``sketches.DISTINCT_BOUND`` of them."""
    near = profile_nunique(df, approx=True).withColumnRenamed("n_unique", "estimate")
    return profile_nunique(df).join(near, "column").select(
        "column", "n_unique", (F.abs(F.col("estimate") - F.col("n_unique")) <= F.col("n_unique") * DISTINCT_BOUND).alias("within"))


def profile_describe(df: DataFrame) -> DataFrame:
    """Count, distinct, most frequent value (smallest on ties) of text columns; moments and exact
    quartiles of number columns. Booleans and dates are described as text.

    The rows are read once, to count the distinct values of every column; everything comes from those counts.
    """
    numbers = [c for c, t in df.dtypes if t.startswith(_NUMBER)]
    texts = [c for c in df.columns if c not in numbers]
    null_text, null_num = F.lit(None).cast("string"), F.lit(None).cast("double")
    counted = counted_values(df, numbers, texts)
    t = counted.where(F.col("text").isNotNull()).groupBy("column").agg(
        F.sum("w").alias("count"), F.count(F.lit(1)).cast("double").alias("unique"),
        F.min_by("text", F.struct(-F.col("w"), F.col("text"))).alias("top"), F.max("w").cast("double").alias("freq"))
    out = t.select("column", "count", "unique", "top", "freq",
                   *[null_num.alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])
    if not numbers:
        return out
    values = counted.where(F.col("number").isNotNull())
    m = values.groupBy("column").agg(F.sum("w").alias("count"), (F.sum(F.col("w") * F.col("number")) / F.sum("w")).alias("mean"),
                                     F.min("number").alias("min"), F.max("number").alias("max"))
    m = materialize(m)   # one row per column
    away = F.col("number") - F.col("mean")
    spread = values.join(F.broadcast(m.select("column", "mean")), "column").groupBy("column").agg(
        F.sqrt(F.sum(F.col("w") * away * away) / F.nullif(F.sum("w") - 1, F.lit(0))).alias("std"))
    q = exact_quantiles(values, "number", [0.25, 0.5, 0.75], ["p25", "p50", "p75"], ["column"], few_groups=True, weight="w")
    # a column without values is there with a count of 0
    named = df.sparkSession.createDataFrame([(c,) for c in numbers], "column string")
    rows = named.join(m, "column", "left").join(spread, "column", "left").join(q.drop("n"), "column", "left")
    return out.unionByName(rows.select(
        "column", F.coalesce("count", F.lit(0)).alias("count"), null_num.alias("unique"), null_text.alias("top"), null_num.alias("freq"),
        "mean", "std", "min", "p25", "p50", "p75", "max"))


def value_counts(df: DataFrame, col: str, n: int | None = None, clean=None) -> DataFrame:
    """How often each value occurs; ``clean`` (a function of a frame) is applied to the distinct values only."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if clean is not None:
        counts = clean(counts).where(F.col(col).isNotNull()).groupBy(col).agg(F.sum("n").alias("n"))
    return top_n(counts, n, "n", [col]) if n else counts.orderBy(F.desc("n"), col)


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """Share of each value; the total is the sum of the counts, one row per distinct value."""
    counts = materialize(df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n")))
    return counts.select(col, (safe_div(F.col("n"), counts.agg(F.sum("n")).scalar()) * 100).alias("share_pct"))


def missing_map(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Share of nulls per column and row bucket (``key`` modulo ``buckets``)."""
    cols = [c for c in df.columns if c != key]
    agg = df.groupBy(F.pmod(F.col(key), F.lit(buckets)).cast("int").alias("row_bucket")).agg(
        *[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols])
    return agg.select("row_bucket", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("null_share")) for c in cols])))


def max_for_brand(df: DataFrame, brand: str, measure: str) -> DataFrame:
    hit = df.where(F.lower(strip_text("brand")) == brand.lower())
    return hit.agg(F.max(measure).alias("max_value"))


def product_price_range(df: DataFrame, pattern: str) -> DataFrame:
    """Distinct names matching the pattern and the span of their discounted prices."""
    return find_products(df, pattern).agg(
        F.count_distinct("product_name").alias("n_names"), F.min("discounted_price_inr").alias("min_price"),
        F.max("discounted_price_inr").alias("max_price"))


def product_names(df: DataFrame, pattern: str) -> DataFrame:
    return find_products(df, pattern).select("product_name").distinct()
