"""Exact order statistics from a stored, range-partitioned table.

The keys are dealt out by range and stored with the number of their range, so a heavy group spans many
ranges and no task holds a whole group. Weights per range (combined on the map side) show which range
holds each wanted rank; only those ranges are ordered, and with few groups only their files are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesflow.operators.aggregate import not_null
from salesflow.session import materialize


def counted_values(df: DataFrame, numbers: list[str], texts: list[str] = ()) -> DataFrame:
    """How often each non-null value occurs in each column: column, text or number, w. One pass, stored.

    Repeats are combined on the map side, so statistics of any number of columns read distinct values only.
    """
    none_text, none_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text"), none_number.alias("number")) for c in texts]
    cells += [F.struct(F.lit(c).alias("column"), none_text.alias("text"), F.col(c).cast("double").alias("number")) for c in numbers]
    long = df.select(F.inline(F.array(*cells))).where(F.col("text").isNotNull() | F.col("number").isNotNull())
    return materialize(long.groupBy("column", "text", "number").agg(F.count(F.lit(1)).alias("w")))


def values_at_ranks(df: DataFrame, groups: list[str], sort_cols: list[str], weight: str, wanted,
                    few_groups: bool = False) -> DataFrame:
    """The rows that stand at wanted ranks (from 0) inside their group.

    ``df`` has one row per distinct sort key with its ``weight`` (how often it occurs);
    ``wanted(n)`` turns the group's size into an array of structs that hold ``rank`` and whatever
    the caller wants back. Returns groups, ``n``, ``want`` and the sort columns. ``few_groups``
    says that the caller fixes the number of groups, so the list of hits may be broadcast;
    otherwise it is stored and Spark joins it according to its size.
    """
    keys = groups + sort_cols
    # range partitions are numbered in the order of their keys; each is one file, which holds its number
    ranged = df.repartitionByRange(*keys).withColumn("bucket", F.spark_partition_id())
    rows = materialize(ranged)
    cells = rows.groupBy(*groups, "bucket").agg(F.sum(weight).alias("w"))
    run = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.select(*groups, "bucket", "w", F.sum("w").over(run).alias("bucket_end"),
                         F.sum("w").over(Window.partitionBy(*groups)).alias("n"))
    start = F.col("bucket_end") - F.col("w")
    hits = cells.select(*groups, "bucket", "n", start.alias("bucket_start"), F.filter(
        wanted(F.col("n")), lambda t: (t["rank"] >= start) & (t["rank"] < F.col("bucket_end"))).alias("want"))
    hits = hits.where(F.size("want") > 0)
    if few_groups:
        # at most two ranges per wanted rank: the file footers tell which files hold them
        hits = materialize(hits)
        rows = rows.where(F.col("bucket").isin([r["bucket"] for r in hits.select("bucket").distinct().collect()]))
        hits = F.broadcast(hits)
    else:
        hits = materialize(hits)
    inside = Window.partitionBy(*groups, "bucket").orderBy(*sort_cols).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = rows.join(hits, groups + ["bucket"]).withColumn("hi", F.col("bucket_start") + F.sum(weight).over(inside))
    here = F.filter("want", lambda t: (t["rank"] >= F.col("hi") - F.col(weight)) & (t["rank"] < F.col("hi")))
    return found.select(*groups, "n", F.explode(here).alias("want"), *sort_cols)


def exact_quantiles(df: DataFrame, value: str, probs: list[float], names: list[str], groups: list[str] = (),
                    few_groups: bool = False, weight: str | None = None, exact: bool = True) -> DataFrame:
    """Linear-interpolated quantiles per group (null values left out), plus ``n``.

    Values are first counted per distinct value, so repeats never leave their map task. ``weight``
    names a column that says how often each row counts. With ``exact=False`` one pass builds mergeable
    sketches instead: the results are values of the data whose rank is off by less than
    ``sketches.RANK_BOUND`` of the group; weights are not taken then.
    """
    groups = list(groups)
    if not exact:
        if weight:
            raise ValueError("sketches count every row once")
        from salesflow.operators.sketches import build_sketches, quantiles_of

        return quantiles_of(build_sketches(not_null(df, [value]), groups, [value]), value, probs, names, groups)
    times = F.sum(weight) if weight else F.count(F.lit(1))
    counts = not_null(df, groups + [value]).groupBy(*groups, value).agg(times.alias("w"))

    def wanted(n: Column) -> Column:
        out = []
        for j, p in enumerate(probs):
            pos = F.lit(float(p)) * (n - 1)
            lo = F.floor(pos)
            out += [F.struct(F.lit(j).alias("prob"), lo.alias("rank"), (pos - lo).alias("part"), F.lit(0).alias("side")),
                    F.struct(F.lit(j).alias("prob"), F.ceil(pos).alias("rank"), (pos - lo).alias("part"),
                             F.lit(1).alias("side"))]
        return F.array(*out)

    got = values_at_ranks(counts, groups, [value], "w", wanted, few_groups)
    out = []
    for j, name in enumerate(names):
        here = F.col("want.prob") == j
        lo = F.max(F.when(here & (F.col("want.side") == 0), F.col(value)))
        hi = F.max(F.when(here & (F.col("want.side") == 1), F.col(value)))
        part = F.max(F.when(here, F.col("want.part")))
        out.append((lo + (hi - lo) * part).alias(name))
    return got.groupBy(*groups).agg(F.max("n").alias("n"), *out)


def exact_median(df: DataFrame, value: str, weight: str | None = None) -> Column:
    """The median of a column as a scalar subquery (null if there is no value)."""
    return exact_quantiles(df, value, [0.5], ["m"], few_groups=True, weight=weight).select("m").scalar()


def quintile_scores(df: DataFrame, key: str, metrics: dict[str, tuple[str, bool]]) -> DataFrame:
    """Score 1..5 by rank, ties ranked by ``key``; ``metrics`` maps score to (column, reversed).

    Equal to cutting the ranks 1..n at their quintiles. Only the rows at the four cut ranks are
    looked up; scoring is then a comparison per row. ``df`` must be a stored table with one row per
    key, since it is read twice.
    """
    names = list(metrics)
    pairs = F.array(*[F.struct(F.lit(s).alias("score"), F.col(c).cast("double").alias("v"))
                      for s, (c, _) in metrics.items()])
    long = df.select(F.col(key), F.inline(pairs)).withColumn("one", F.lit(1).cast("bigint"))

    def wanted(n: Column) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("cut"), F.floor(F.lit(k) * (n - 1) / 5).alias("rank"))
                         for k in range(1, 5)])

    cuts = values_at_ranks(long, ["score"], ["v", key], "one", wanted, few_groups=True)
    table = cuts.groupBy("score").agg(
        F.struct(F.max("n").alias("n"), F.collect_list(F.struct("v", key)).alias("cuts")).alias("c"))
    found = table.agg(F.map_from_entries(F.collect_list(F.struct("score", "c")))).scalar()
    out = df.withColumn("found", found)
    for s in names:
        col, rev = metrics[s]
        me = F.struct(F.col(col).cast("double").alias("v"), F.col(key))
        cell = F.try_element_at("found", F.lit(s))
        rank5 = F.lit(1)
        for i in range(4):
            rank5 = rank5 + F.when(F.get(cell["cuts"], F.lit(i)) < me, 1).otherwise(0)
        score = F.when(cell["n"] == 1, 3).otherwise(F.lit(6) - rank5 if rev else rank5)
        out = out.withColumn(s, score.cast("int"))
    return out.drop("found")
