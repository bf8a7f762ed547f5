"""Mergeable sketches: stated error bounds, merging, pruning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesflow.operators.ordering import exact_quantiles
from salesflow.operators.profiling import profile_nunique
from salesflow.operators.sketches import (DISTINCT_BOUND, RANK_BOUND, build_sketches, distinct_of, load_sketches,
                                          merge_sketches, quantiles_of, store_sketches)

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


def rank_error(values, got, prob):
    lo, hi = (values < got).mean(), (values <= got).mean()
    return max(0.0, lo - prob, prob - hi)


@pytest.fixture(scope="module")
def facts(spark):
    """80,000 rows of four years with a heavy tail, long runs of ties and one year of falling values."""
    x = F.col("id")
    value = F.when(x % 4 == 0, F.exp(F.rand(3) * 12)).when(x % 4 == 1, F.lit(7.0)).when(x % 4 == 2, -x.cast("double")).otherwise((x % 17).cast("double"))
    return spark.range(80_000).select((F.lit(2000) + x % 4).cast("int").alias("order_year"), value.alias("v"),
                                      (x % 30_011).alias("who"), F.lit(None).cast("double").alias("none")).cache()


def test_rank_errors_of_any_year_range(spark, facts, tmp_path):
    path = str(tmp_path / "sketches")
    store_sketches(facts, path, measures=["v"], counted=["who"])
    assert load_sketches(spark, path).count() == 4
    for lo, hi in ((2000, 2000), (2000, 2003), (2001, 2002), (2002, 2003)):
        rows = facts.where(F.col("order_year").between(lo, hi)).toPandas()
        stored = load_sketches(spark, path, lo, hi)
        got = quantiles_of(stored, "v", PROBS, [f"q{i}" for i in range(len(PROBS))]).first()
        assert got["n"] == len(rows)
        for i, p in enumerate(PROBS):
            assert rank_error(rows.v.to_numpy(), got[f"q{i}"], p) < RANK_BOUND
        exact = rows.who.nunique()
        assert abs(distinct_of(stored, ["who"]).first()["who"] - exact) <= exact * DISTINCT_BOUND
    assert "PartitionFilters: [isnotnull(order_year" in load_sketches(spark, path, 2001, 2002)._jdf.queryExecution().executedPlan().toString()


def test_a_year_that_is_stored_again_replaces_its_own(spark, facts, tmp_path):
    path = str(tmp_path / "sketches")
    for _ in range(2):
        store_sketches(facts.where("order_year = 2001"), path, measures=["v"])
    store_sketches(facts.where("order_year = 2002"), path, measures=["v"])
    assert merge_sketches(load_sketches(spark, path)).first()["n"] == 40_000


def test_exact_false_and_empty_columns(spark, facts):
    got = {r.order_year: r for r in exact_quantiles(facts, "v", [0.5], ["m"], ["order_year"], exact=False).collect()}
    want = {r.order_year: r for r in exact_quantiles(facts, "v", [0.5], ["m"], ["order_year"]).collect()}
    assert {k: r.n for k, r in got.items()} == {k: r.n for k, r in want.items()}
    for year, rows in facts.toPandas().groupby("order_year"):
        assert rank_error(rows.v.to_numpy(), got[year].m, 0.5) < RANK_BOUND
    none = quantiles_of(build_sketches(facts, [], ["none"], ["none"]), "none", [0.5], ["m"]).first()
    assert none.m is None and none.n == 0
    assert distinct_of(build_sketches(facts, [], counted=["none"]), ["none"]).first()["none"] == 0
    assert exact_quantiles(facts.limit(0), "v", [0.5], ["m"], ["order_year"], exact=False).collect() == []
    with pytest.raises(ValueError):
        exact_quantiles(facts, "v", [0.5], ["m"], weight="order_year", exact=False)
    assert np.isclose({r.column: r.n_unique for r in profile_nunique(facts, approx=True).collect()}["who"], 30_011, rtol=DISTINCT_BOUND)
