"""Group sums, growth, shares, arg-extremes, top-N and dense group-bys.

Null group keys are dropped. Windows run on aggregated rows only, never on the fact rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesflow.functions.numeric import safe_div, total

AMOUNT = "final_amount_inr"


def not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])) if cols else df


def group_sum(df: DataFrame, keys: list[str], value: str = AMOUNT, alias: str = "revenue") -> DataFrame:
    return not_null(df, keys).groupBy(*keys).agg(total(value).alias(alias))


def pct_change(df: DataFrame, value: str, order: str, alias: str, partition: list[str] = ()) -> DataFrame:
    """Change in % against the previous row; a missing period is skipped over, zero base is null."""
    prev = F.lag(value).over(Window.partitionBy(*partition).orderBy(order))
    return df.withColumn(alias, (safe_div(value, prev) - 1) * 100)


def share_of(value: str, partition: list[str] = ()) -> Column:
    """Percentage of the partition's total."""
    return safe_div(value, F.sum(value).over(Window.partitionBy(*partition))) * 100


def arg_extremes(df: DataFrame, metric: str, tie: Column, keep: list[str],
                 high: str = "best", low: str = "worst") -> DataFrame:
    """The rows with the largest and smallest metric; the smallest ``tie`` (a number) wins on ties."""
    row = F.struct(*keep)
    both = df.where(F.col(metric).isNotNull()).agg(
        F.max_by(row, F.struct(F.col(metric), -tie)).alias("hi"), F.min_by(row, F.struct(F.col(metric), tie)).alias("lo"))
    kinds = F.array(F.struct(F.lit(high).alias("kind"), F.col("hi").alias("row")),
                    F.struct(F.lit(low).alias("kind"), F.col("lo").alias("row")))
    return both.select(F.inline(kinds)).where(F.col("row").isNotNull()).select("kind", "row.*")


def top_n(df: DataFrame, n: int, metric: str, tie: list[str]) -> DataFrame:
    return df.orderBy(F.desc(metric), *tie).limit(n)


def top_n_per(df: DataFrame, n: int, metric: str, partition: list[str], tie: list[str],
              alias: str = "rank") -> DataFrame:
    """Top N rows in each group, over aggregated rows; Spark limits each map side first."""
    win = Window.partitionBy(*partition).orderBy(F.desc(metric), *tie)
    return df.withColumn(alias, F.row_number().over(win)).where(F.col(alias) <= n)


def dense(df: DataFrame, keys: list[str], label: str, labels: list, fills: dict[str, Column | None]) -> DataFrame:
    """Make a row for every (key, label) pair of an aggregated frame, with ``ord`` for the label order.

    ``df`` holds one row per key and label; rows with another label (or null) only prove that the
    key exists. Each key gathers at most ``len(labels)`` cells, then every label is looked up, so
    no join and no pair of unbounded sides is needed. ``fills`` gives the value of absent cells.
    """
    values = list(fills)
    known = F.col(label).isin(labels)
    cells = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(
        F.when(known, F.struct(F.col(label), F.struct(*values))))).alias("cells"))
    rows = cells.select(*keys, "cells", F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("ord", label))
    cell = F.try_element_at("cells", F.col(label))
    out = []
    for v in values:
        got = cell.getField(v)
        out.append((got if fills[v] is None else F.coalesce(got, fills[v])).alias(v))
    return rows.select(*keys, "ord", label, *out)


def rollup_totals(df: DataFrame, parent: str, child: str, value: str = AMOUNT, alias: str = "revenue") -> DataFrame:
    """Totals of every child, parent and of everything, with the value-weighted mean of the value.

    The fact rows are summed to (parent, child) first; only those sums go through the rollup.
    """
    base = not_null(df, [parent, child]).groupBy(parent, child).agg(
        total(value).alias("s1"), total(F.col(value) * F.col(value)).alias("s2"))
    return (base.rollup(parent, child)
            .agg(F.grouping_id().alias("gid"), F.sum("s1").alias(alias), F.sum("s2").alias("s2"))
            .select(F.when(F.col("gid") == 0, "child").when(F.col("gid") == 1, "parent").otherwise("all").alias("level"),
                    parent, child, alias, safe_div("s2", alias).alias("weighted_amount")))
