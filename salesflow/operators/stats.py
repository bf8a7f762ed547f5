"""Correlation, least squares, tests, histograms, box summaries and binning."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesflow.functions.numeric import cut, safe_corr, safe_div
from salesflow.operators.aggregate import not_null
from salesflow.operators.ordering import exact_quantiles
from salesflow.session import materialize

HELD_GROUPS = 1000   # groups whose moments a task holds before it gives them out
BOX = ["min", "q1", "median", "q3", "max"]
_BOX_PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]


_MOMENTS = ["n", "mean_x", "mean_y", "xx", "yy", "xy"]


def _add_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together (counts, means, centred sums of squares and products)."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy, w = b[1] - a[1], b[2] - a[2], a[0] * share
    return np.stack([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w])


def _moments(x: np.ndarray) -> np.ndarray:
    """Moments of every pair of columns over the rows where both are there, by matrix products of centred values."""
    there = ~np.isnan(x)
    centre = np.divide(np.where(there, x, 0).sum(axis=0), there.sum(axis=0), out=np.zeros(x.shape[1]), where=there.any(axis=0))
    z, m = np.where(there, x - centre, 0.0), there.astype(float)
    n, s, q, p = m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z     # s and q: of the row's column, over the complete pairs
    mean = np.divide(s, n, out=np.zeros_like(n), where=n > 0)
    xx = q - mean * s
    return np.stack([n, centre[:, None] + mean, (centre[:, None] + mean).T, xx, xx.T, p - mean * s.T])


def _moment_rows(cols: int, groups: int):
    """The moments of every pair in a task's rows, one row per group and pair."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(cols)

        def given(name: tuple, moments: np.ndarray) -> pa.RecordBatch:
            cells = [pa.array([v] * len(upper[0])) for v in name]
            return pa.RecordBatch.from_arrays([*cells, *[pa.array(u.astype(np.int32)) for u in upper], *[pa.array(x[upper]) for x in moments]],
                                              names=[*[f"g{i}" for i in range(groups)], "i", "j", *_MOMENTS])

        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([batch.column(groups + i).to_numpy(zero_copy_only=False) for i in range(cols)]).astype(float)
            if groups:
                names = list(zip(*(batch.column(i).to_pylist() for i in range(groups))))
                number = {name: i for i, name in enumerate(dict.fromkeys(names))}
                code = np.array([number[name] for name in names], np.int64)
                order = np.argsort(code, kind="stable")
                parts = zip(number, np.split(x[order], np.searchsorted(code[order], np.arange(1, len(number)))))
            else:
                parts = [((), x)]
            for name, part in parts:
                mine = _moments(part)
                held[name] = _add_moments(held[name], mine) if name in held else mine
            if len(held) > HELD_GROUPS:
                yield from (given(*h) for h in held.items())
                held = {}
        yield from (given(*h) for h in held.items())
    return rows


def corr_matrix(df: DataFrame, cols: list[str], groups: list[str] = ()) -> DataFrame:
    """Long Pearson matrix over complete pairs; booleans count as 0/1, and a constant side gives null.

    Each task turns its Arrow batches into one matrix of pairwise moments per group (centred, so large values keep their digits);
    Spark adds the matrices of all tasks. Rows are neither copied per pair nor shuffled.
    """
    groups = list(groups)
    values = not_null(df, groups).select(*groups, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    kinds = [f"g{i} {df.schema[g].dataType.simpleString()}" for i, g in enumerate(groups)]
    part = values.mapInArrow(_moment_rows(len(cols), len(groups)), ", ".join([*kinds, "i int", "j int", *[f"{m} double" for m in _MOMENTS]]))
    keys = [*[f"g{i}" for i in range(len(groups))], "i", "j"]
    # a row per task and pair: the totals of a pair come first, then what its tasks' means differ from them
    everything = Window.partitionBy(*keys)
    part = part.where("n > 0").withColumns({f"all_{m}": safe_div(F.sum(F.col("n") * F.col(m)).over(everything), F.sum("n").over(everything))
                                            for m in ("mean_x", "mean_y")})
    dx, dy = F.col("mean_x") - F.col("all_mean_x"), F.col("mean_y") - F.col("all_mean_y")
    sums = part.groupBy(*keys).agg(F.sum(F.col("xx") + F.col("n") * dx * dx).alias("xx"), F.sum(F.col("yy") + F.col("n") * dy * dy).alias("yy"),
                                   F.sum(F.col("xy") + F.col("n") * dx * dy).alias("xy"))
    cells = sums.select(*[F.col(f"g{i}").alias(g) for i, g in enumerate(groups)], "i", "j", safe_div("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("corr"))
    # pairs that no row completes are in the matrix with null
    listed = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    found = cells.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("i", "j"), F.col("corr")))).alias("found"))
    grid = F.array(*[F.struct(F.lit(cols[a]).alias("col_x"), F.lit(cols[b]).alias("col_y"), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")).alias("at"))
                     for i, j in listed for a, b in {(i, j), (j, i)}])
    return found.select(*groups, "found", F.inline(grid)).select(*groups, "col_x", "col_y", F.try_element_at("found", F.col("at")).alias("corr"))


def ols_by(df: DataFrame, x: str, y: str, groups: list[str]) -> DataFrame:
    """Least-squares line of y on x per group; null where x does not vary."""
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    return (not_null(df, groups).groupBy(*groups)
            .agg(F.regr_slope(yc, xc).alias("slope"), F.regr_intercept(yc, xc).alias("intercept"),
                 F.regr_r2(yc, xc).alias("r2"), F.regr_count(yc, xc).alias("n")))


def trend(df: DataFrame, x: str, y: str, alias: str) -> DataFrame:
    """Straight-line fit evaluated on the rows of a small aggregated frame."""
    everything = Window.partitionBy()
    xc, yc = F.col(x).cast("double"), F.col(y)
    return df.withColumn(alias, F.regr_slope(yc, xc).over(everything) * xc + F.regr_intercept(yc, xc).over(everything))


def _brand_stats(df: DataFrame, brand: str, measure: str) -> DataFrame:
    x = F.when(F.col("brand") == brand, F.col(measure))
    return df.agg(F.avg(x).alias("brand_mean"), F.stddev_samp(x).alias("brand_std"), F.count(x).alias("n"),
                  F.avg(measure).alias("all_mean"), F.stddev_samp(measure).alias("all_std"))


def z_test(df: DataFrame, brand: str, measure: str) -> DataFrame:
    """One brand's mean against all rows; two-sided normal p-value, worked out on the one result row."""
    def tail(z):
        import math
        return None if z is None else math.erfc(abs(z) / math.sqrt(2.0))

    z = safe_div(F.col("brand_mean") - F.col("all_mean"), F.col("all_std") / F.sqrt(F.nullif("n", F.lit(0))))
    return _brand_stats(df, brand, measure).select("n", "brand_mean", "all_mean", "all_std", z.alias("z")).withColumn(
        "p", F.udf(tail, "double")("z"))


def t_test_1samp(df: DataFrame, brand: str, measure: str) -> DataFrame:
    """One-sample t-test of a brand against the mean of all rows, p-value on the one result row."""
    def tail(t, dof):
        if t is None or not dof or dof < 1:
            return None
        import numpy as np
        # With t = sqrt(dof) * tan(s / sqrt(dof)) the density is cos(s / sqrt(dof)) ** (dof - 1), which
        # has unit width for every dof; both integrals use Gauss points on short panels.
        root = np.sqrt(dof)
        nodes, weights = np.polynomial.legendre.leggauss(12)

        def area(lo):
            hi = min(root * np.pi / 2, lo + 40.0)
            edges = np.linspace(lo, hi, 401)
            half = (edges[1:] - edges[:-1])[:, None] / 2
            s = (edges[1:] + edges[:-1])[:, None] / 2 + half * nodes
            return float((np.exp((dof - 1) * np.log(np.cos(s / root))) * weights * half).sum())

        return min(1.0, area(root * np.arctan(abs(t) / root)) / area(0.0))

    t = safe_div(F.col("brand_mean") - F.col("all_mean"), F.col("brand_std") / F.sqrt(F.nullif("n", F.lit(0))))
    return _brand_stats(df, brand, measure).withColumn("t", t).withColumn(
        "p", F.udf(tail, "double")("t", (F.col("n") - 1).cast("double")))


def histogram(df: DataFrame, col: str, bins: int, groups: list[str] = (), alias: str = "n") -> DataFrame:
    """Counts in equal-width bins between the smallest and largest value; empty bins are left out."""
    groups = list(groups)
    rows = df.select(*groups, F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    # counted once and stored: the range and the bins come from the distinct values, not from a second scan
    counts = materialize(not_null(rows, groups).groupBy(*groups, "x").agg(F.count(F.lit(1)).alias("w")))
    span = counts.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    lo, width = span["lo"], (span["hi"] - span["lo"]) / bins
    raw = F.coalesce(F.floor(safe_div(F.col("x") - lo, width)), F.lit(0))
    binned = counts.select(*groups, F.greatest(F.least(raw, F.lit(bins - 1)), F.lit(0)).cast("int").alias("bin"), "w")
    return (binned.groupBy(*groups, "bin").agg(F.sum("w").alias(alias))
            .select(*groups, "bin", (lo + F.col("bin") * width).alias("bin_lo"),
                    (lo + (F.col("bin") + 1) * width).alias("bin_hi"), alias))


def box_summary(df: DataFrame, col: str, groups: list[str], few_values: bool = False, weight: str | None = None) -> DataFrame:
    """Five-number summary and count per group.

    ``few_values`` is for columns with a small fixed domain (days, order counts): the built-in
    ``percentile`` then keeps only that many entries. Otherwise the exact distributed form is used, in
    which ``weight`` may say how often each row counts.
    """
    if not few_values:
        return exact_quantiles(df, col, _BOX_PROBS, BOX, groups, weight=weight).select(*groups, *BOX, "n")
    counts = not_null(df, groups + [col]).groupBy(*groups, col).agg(F.count(F.lit(1)).alias("w"))
    return box_of_counts(counts, col, "w", groups)


def box_of_counts(counts: DataFrame, col: str, weight: str, groups: list[str]) -> DataFrame:
    """Five-number summary of a value/count table with few distinct values per group."""
    q = F.percentile(F.col(col).cast("double"), F.array(*[F.lit(p) for p in _BOX_PROBS]), F.col(weight))
    return (counts.groupBy(*groups).agg(q.alias("q"), F.sum(weight).alias("n"))
            .select(*groups, *[F.col("q")[i].alias(name) for i, name in enumerate(BOX)], "n"))


def qcut(df: DataFrame, col: str, labels: list[str], groups: list[str], fixed_edges: list, alias: str,
         weight: str | None = None, digits: int | None = None) -> DataFrame:
    """Label of the equal-frequency bin inside the row's group.

    Bins are right-closed and the lowest edge belongs to the first. Where two edges coincide the group
    falls back to ``fixed_edges``. ``weight`` says how often each row counts; ``digits`` compares values and
    edges rounded to so many decimals (default: as they are). The edges of all groups are a stored table:
    Spark broadcasts it if its file is small and joins by shuffle, splitting skew, if not.
    """
    k = len(labels)
    names = [f"_edge{i}" for i in range(k + 1)]
    edges = exact_quantiles(df, col, [i / k for i in range(k + 1)], names, groups, few_groups=not groups, weight=weight).drop("n")
    if groups:
        out = df.join(materialize(edges), groups, "left")
    else:
        out = df.withColumn("_edges", edges.select(F.struct(*names)).scalar()).select("*", "_edges.*")

    def shown(c):
        return c if digits is None else F.round(c, digits)

    edge = [shown(F.col(n)) for n in names]
    x = shown(F.col(col).cast("double"))
    position = sum((F.when(x > e, 1).otherwise(0) for e in edge[1:-1]), F.lit(0))
    coincide = reduce(lambda a, b: a | b, [a == b for a, b in zip(edge, edge[1:])])
    label = F.when(coincide, cut(col, fixed_edges, labels)).otherwise(F.get(F.array(*[F.lit(t) for t in labels]), position))
    return out.withColumn(alias, F.when(x.isNotNull(), label)).select(*df.columns, alias)
