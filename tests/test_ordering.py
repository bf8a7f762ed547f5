"""Exact order statistics against brute force, with heavy ties and one dominant value or group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from salesflow import fixed_values as fv
from salesflow.operators.ordering import exact_quantiles, quintile_scores
from salesflow.operators.stats import box_summary, qcut
from salesflow.session import materialize

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    n = 3000
    return pd.DataFrame({
        "g": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcde"), n)),
        "v": np.where(rng.random(n) < 0.34, 5.0, np.round(rng.lognormal(3, 2, n), 2)),
    })


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_quantiles_match_brute_force(spark, skewed, groups):
    df = spark.createDataFrame(skewed).repartition(5)
    df = df.unionByName(df.limit(1).select("g", F.lit(None).cast("double").alias("v")))
    names = [f"q{i}" for i in range(len(PROBS))]
    got = exact_quantiles(df, "v", PROBS, names, groups, few_groups=not groups).toPandas()
    parts = skewed.groupby("g").v if groups else [("all", skewed.v)]
    for key, part in parts:
        row = got[got.g == key].iloc[0] if groups else got.iloc[0]
        assert row["n"] == len(part)
        np.testing.assert_allclose([row[c] for c in names], part.quantile(PROBS), rtol=1e-12)


def test_box_of_single_value(spark):
    df = spark.createDataFrame([("a", 2.0)], "g string, v double")
    for few in (True, False):
        assert tuple(box_summary(df, "v", ["g"], few_values=few).first()) == ("a", 2.0, 2.0, 2.0, 2.0, 2.0, 1)


EXPECTED = {1: [3], 2: [1, 5], 4: [1, 2, 4, 5], 7: [1, 1, 2, 3, 4, 5, 5], 12: [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 5]}


@pytest.mark.parametrize("n", [1, 2, 4, 7, 12])
def test_quintiles_of_small_sets(spark, n):
    df = materialize(spark.createDataFrame([(i, 1.0, float(-i)) for i in range(n)], "id long, tie double, down double"))
    got = quintile_scores(df, "id", {"a": ("tie", False), "b": ("down", True)}).orderBy("id").collect()
    assert [r.a for r in got] == EXPECTED[n]  # ties are ranked by id
    # largest "down" first (id 0), reversed: the smallest value gets 5
    assert [r.b for r in got] == ([3] if n == 1 else [6 - s for s in reversed(EXPECTED[n])])


def test_quintiles_match_ranks_under_ties(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": rng.permutation(1500), "f": np.minimum(rng.geometric(0.4, 1500), 4)})
    got = quintile_scores(materialize(spark.createDataFrame(pdf)), "id", {"s": ("f", False)}).toPandas()
    want = pdf.sort_values("id").assign(r=lambda d: d.f.rank(method="first"))
    want["s"] = pd.qcut(want.r, 5, labels=[1, 2, 3, 4, 5]).astype(int)
    merged = got.merge(want[["id", "s"]], on="id", suffixes=("", "_want"))
    assert len(merged) == 1500 and (merged.s == merged.s_want).all()
    sizes = got.s.value_counts()
    assert sizes.max() - sizes.min() <= 1


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_qcut(spark, groups):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": "wide", "v": np.round(rng.uniform(1, 20000, 400), 2)})
    flat = pd.DataFrame({"g": "flat", "v": [700.0] * 9 + [0.0, 20000.0]}) if groups else pdf[:0]
    df = spark.createDataFrame(pd.concat([pdf, flat]))
    got = qcut(df, "v", fv.PRICE_TIERS, groups, fv.PRICE_TIER_EDGES, "t").toPandas()
    wide = got[got.g == "wide"]
    assert list(wide.t) == list(pd.qcut(wide.v, 5, labels=fv.PRICE_TIERS).astype(str))
    if groups:  # coinciding quintiles: fixed right-closed edges, 0 belongs to none
        assert dict(got[got.g == "flat"][["v", "t"]].drop_duplicates().values.tolist()) == {
            700.0: "Low", 0.0: None, 20000.0: "Premium"}
