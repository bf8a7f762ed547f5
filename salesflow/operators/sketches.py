"""Stored sketches of quantiles and distinct counts, merged for any set of years without another scan.

One row per year and group holds a KLL sketch of every measured column and an HLL sketch of every counted one, so a
question about any years or coarser groups reads a few kilobytes per cell instead of the facts. Sketches are built with
map-side partial aggregates and have a fixed size, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.operators.aggregate import not_null
from salesflow.sources.tables import between_years, write_by_year

KLL_K = 1024     # a rank is then off by 0.0044 of the rows in one of a hundred cases
RANK_BOUND = 0.01
LG_K = 14        # standard error 1.04 / 2 ** 7 = 0.8 %
DISTINCT_BOUND = 0.04
YEAR = "order_year"
_COLUMNS = "_columns"


def build_sketches(df: DataFrame, groups: list[str], measures: list[str] = (), counted: list[str] = ()) -> DataFrame:
    """One row per group (null groups left out): ``n``, a ``kll_`` sketch per measure and an ``hll_`` sketch per counted column.

    Null values are not counted. Counted columns are compared as text, so any type will do.
    """
    cells = [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(KLL_K)).alias(f"kll_{c}") for c in measures]
    cells += [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(LG_K)).alias(f"hll_{c}") for c in counted]
    return not_null(df, list(groups)).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), *cells)


def store_sketches(df: DataFrame, path: str, groups: list[str] = (), measures: list[str] = (), counted: list[str] = ()) -> None:
    """Sketches per year and group, one folder per year; a year that is stored again replaces its own.

    The columns are stored beside them, so that a store without rows can be read too.
    """
    sketches = build_sketches(df, [YEAR, *groups], measures, counted)
    df.sparkSession.createDataFrame([], sketches.schema).write.mode("overwrite").parquet(f"{path}/{_COLUMNS}")
    write_by_year(sketches, path)


def load_sketches(spark: SparkSession, path: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """The stored sketches of the years from ``lo`` to ``hi``; only their folders are read."""
    schema = spark.read.parquet(f"{path}/{_COLUMNS}").schema
    return between_years(spark.read.schema(schema).parquet(path), lo, hi)


def merge_sketches(sketches: DataFrame, groups: list[str] = ()) -> DataFrame:
    """The union of the sketches of every group: the same columns as ``build_sketches`` on all their rows."""
    cells = [F.kll_merge_agg_double(c).alias(c) for c in sketches.columns if c.startswith("kll_")]
    cells += [F.hll_union_agg(c).alias(c) for c in sketches.columns if c.startswith("hll_")]
    return sketches.groupBy(*groups).agg(F.sum("n").alias("n"), *cells)


def _quantile(c: str, prob: float) -> Column:
    """Null where the sketch has no value."""
    return F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(float(prob))))


def quantiles_of(sketches: DataFrame, measure: str, probs: list[float], names: list[str], groups: list[str] = ()) -> DataFrame:
    """Quantiles of the merged sketches per group, plus ``n`` (values). A result is a value of the data whose rank is off by less
    than RANK_BOUND of the values; a column without values has none."""
    c = f"kll_{measure}"
    merged = merge_sketches(sketches.select(*groups, "n", c), groups)
    return merged.select(*groups, F.kll_sketch_get_n_double(c).alias("n"), *[_quantile(c, p).alias(a) for p, a in zip(probs, names)])


def distinct_of(sketches: DataFrame, counted: list[str], groups: list[str] = ()) -> DataFrame:
    """Estimated distinct values of the merged sketches per group, off by less than DISTINCT_BOUND of the count (five standard errors)."""
    merged = merge_sketches(sketches.select(*groups, "n", *[f"hll_{c}" for c in counted]), groups)
    return merged.select(*groups, *[F.hll_sketch_estimate(f"hll_{c}").alias(c) for c in counted])


def quantiles_hold(df: DataFrame, path: str, ranges: list[tuple[int, int]], measures: list[str], probs: list[float]) -> DataFrame:
    """Quantiles of year ranges from stored sketches, each checked against the facts: lo_year, hi_year, column, prob, n, within.

    ``within`` says that the share of values below and up to the result encloses ``prob`` to RANK_BOUND. All results together
    are a fixed number of literals, so one scan of the facts counts for all of them.
    """
    spark = df.sparkSession
    names, cells, counts = [f"q{i}" for i in range(len(probs))], [], []
    for lo, hi in ranges:
        stored = load_sketches(spark, path, lo, hi)
        for m in measures:
            got = quantiles_of(stored, m, probs, names).first()
            inside = F.col(YEAR).between(lo, hi) & F.col(m).isNotNull()
            for p, q in zip(probs, names):
                i = len(cells)
                cells.append((lo, hi, m, p, got["n"] or 0))   # without rows there is one result without values
                x = F.lit(got[q]).cast("double")
                counts += [F.count_if(inside & (F.col(m) < x)).alias(f"below{i}"), F.count_if(inside & (F.col(m) <= x)).alias(f"upto{i}")]
    ranks = df.agg(*counts)
    rows = F.array(*[F.struct(F.lit(lo).alias("lo_year"), F.lit(hi).alias("hi_year"), F.lit(m).alias("column"), F.lit(p).alias("prob"), F.lit(n).cast("bigint").alias("n"),
                              ((F.col(f"below{i}") <= n * (p + RANK_BOUND)) & (F.col(f"upto{i}") >= n * (p - RANK_BOUND))).alias("within"))
                     for i, (lo, hi, m, p, n) in enumerate(cells)])
    return ranks.select(F.inline(rows))


def distinct_holds(df: DataFrame, path: str, ranges: list[tuple[int, int]], counted: list[str], group: str) -> DataFrame:
    """Distinct counts of year ranges and groups from stored sketches beside the exact ones: lo_year, hi_year, group, column, n_distinct
    (exact) and within (the estimate is off by less than DISTINCT_BOUND)."""
    parts = []
    for lo, hi in ranges:
        estimates = distinct_of(load_sketches(df.sparkSession, path, lo, hi), counted, [group])
        exact = not_null(between_years(df, lo, hi), [group]).groupBy(group).agg(*[F.count_distinct(c).alias(f"exact_{c}") for c in counted])
        both = exact.join(estimates, group)
        parts.append(both.select(F.lit(lo).alias("lo_year"), F.lit(hi).alias("hi_year"), group, F.inline(F.array(*[F.struct(
            F.lit(c).alias("column"), F.col(f"exact_{c}").alias("n_distinct"),
            (F.abs(F.col(c) - F.col(f"exact_{c}")) <= F.col(f"exact_{c}") * DISTINCT_BOUND).alias("within")) for c in counted]))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
