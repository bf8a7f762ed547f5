"""Reading, writing and plan shape."""

import datetime as dt

import pytest
from conftest import values
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesflow.catalog import QUERIES, _stored_by_year
from salesflow.operators.skew import heavy_keys, skew_join
from salesflow.schema import CLEAN_SCHEMA
from salesflow.sources import batches
from salesflow.sources.batches import append_batch, commit_attempt, load_batches, write_attempt
from salesflow.sources.quarantine import FIELDS, load_csv, quarantined
from salesflow.sources.star import view
from salesflow.sources.tables import (append_sales, load_sales, read_clean_csv, read_raw_csv, sample_rows, union_years,
                                      with_order_year, write_by_year, write_csv)

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_year_folders_round_trip_and_prune(spark, tmp_path):
    path = str(tmp_path / "sales")
    sales = view(spark, SF, "sales", ["transaction_id", "order_date", "order_year", "final_amount_inr"])
    write_by_year(sales, path)
    assert load_sales(spark, path).count() == 6000
    some = load_sales(spark, path, [1996, 1998, 2050])
    assert some.count() == sales.where("order_year in (1996, 1998)").count()
    assert "PartitionFilters: [isnotnull(order_year" in plan(some) or "PartitionFilters: [order_year" in plan(some)
    assert set(some.columns) >= {"order_month", "order_month_name"}
    append_sales(sales.where("order_year = 1996"), path)
    assert load_sales(spark, path, [1996]).count() == 2 * sales.where("order_year = 1996").count()
    cached = load_sales(spark, path, [1997], cache=True)
    assert cached.is_cached
    cached.unpersist()


def test_missing_table_is_empty(spark, tmp_path):
    got = load_sales(spark, str(tmp_path / "none"))
    assert got.count() == 0 and set(CLEAN_SCHEMA.names) <= set(got.columns)


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame([("T1", "2020-01-05", "12.5"), ("T2", "bad", "x")], "transaction_id string, order_date string, original_price_inr string")
    write_csv(df, path)
    raw = read_raw_csv(spark, path)
    assert {t for _, t in raw.dtypes} == {"string"} and raw.count() == 2
    full = spark.createDataFrame([tuple([None] * len(CLEAN_SCHEMA))], CLEAN_SCHEMA)
    write_csv(full, str(tmp_path / "clean"))
    assert read_clean_csv(spark, str(tmp_path / "clean")).schema == CLEAN_SCHEMA


def test_rows_without_a_year_are_stored_and_read(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 5), 2020, 1.0), (None, None, 2.0)], "order_date date, order_year int, final_amount_inr double")
    assert load_sales(spark, _stored_by_year(df)).count() == 2


LINES = """a,2020-01-05,"x, y",3,1.5
b,not a day,z,4,2.5
c,2020-01-06,z,4
d,2020-01-06,z,4,5,6
e,2020-01-07,"two
lines ""q"" end",,2.0
f,bad,z,many,?
,,,,
"""


def test_bad_lines_are_kept_with_their_reasons(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,day,name,n,x\n" + LINES)
    schema = T.StructType().add("id", "string").add("day", "date").add("name", "string").add("n", T.IntegerType()).add("x", "double")
    for multiline in (True, False):
        good = load_csv(spark, str(tmp_path / "in"), schema, str(tmp_path / "bad"), multiline=multiline)
        assert good.schema == schema
        reasons = {r.reason: r.n_lines for r in quarantined(spark, str(tmp_path / "bad")).collect()}
        names = {r.id: r.name for r in good.collect()}
        if multiline:
            assert names == {"a": "x, y", "e": 'two\nlines "q" end', None: None}
            assert reasons == {"unreadable day": 2, FIELDS: 2, "unreadable n": 1, "unreadable x": 1}
            bad = spark.read.parquet(str(tmp_path / "bad")).collect()
            assert sorted(r.line.strip()[:1] for r in bad) == ["b", "c", "d", "f"] and all(str(tmp_path) in r.source for r in bad)
        else:
            assert set(names) == {"a", None} and reasons[FIELDS] == 4
    (tmp_path / "in" / "a.csv").write_text("id,day,name,n,x\n")
    assert load_csv(spark, str(tmp_path / "in"), schema, str(tmp_path / "bad")).count() == 0
    assert quarantined(spark, str(tmp_path / "bad")).count() == 0


def test_a_repeated_append_replaces_its_batch(spark, tmp_path):
    path = str(tmp_path / "b")
    rows = lambda *xs: spark.createDataFrame([(dt.date(y, 1, 2), y, v) for y, v in xs], "order_date date, order_year int, v int")
    got = lambda **kw: sorted(values(load_batches(spark, path, **kw), "batch", "order_year", "v"))
    attempt = write_attempt(rows((2019, 1)), path, "007")
    assert got() == []                                        # nothing is committed yet
    append_batch(rows((2019, 1), (2020, 2)), path, "007")
    append_batch(rows((2020, 3)), path, "2")
    append_batch(rows((2019, 1), (2020, 2)), path, "007")       # a retry
    assert got() == [("007", 2019, 1), ("007", 2020, 2), ("2", 2020, 3)]
    append_batch(rows((2021, 9)), path, "007")                  # other years than before
    assert got() == [("007", 2021, 9), ("2", 2020, 3)] and got(years=[2020]) == [("2", 2020, 3)]
    commit_attempt(spark, path, "007", attempt)                 # a late commit wins
    assert got() == [("007", 2019, 1), ("2", 2020, 3)]
    assert "PartitionFilters: [isnotnull" in plan(load_batches(spark, path, [2020])) or "PartitionFilters: [order_year" in plan(load_batches(spark, path, [2020]))


def test_a_batch_is_written_without_columns_for_its_folders(spark, tmp_path, monkeypatch):
    path, name, written = str(tmp_path / "b"), "a/b:c=%20 [x]", []
    monkeypatch.setattr(batches, "write_by_year", lambda df, *a, **kw: (written.append(df.columns), write_by_year(df, *a, **kw)))
    append_batch(spark.createDataFrame([(dt.date(2020, 1, 2), 2020, 1), (None, None, 2)], "order_date date, order_year int, v int"), path, name)
    assert written == [["order_date", "order_year", "v"]]
    assert sorted(values(load_batches(spark, path), "batch", "v")) == [(name, 1), (name, 2)]


def test_heavy_keys_are_joined_apart(spark):
    n = 200_000
    fact = spark.range(n, numPartitions=6).select(F.when(F.col("id") % 10 < 9, 7).when(F.col("id") % 1000 == 999, None).otherwise(F.col("id") % 500).alias("k"), "id")
    dim = spark.range(490).select(F.col("id").alias("d"), (F.col("id") * 2).alias("twice"))
    want = fact.join(dim, F.col("k") == F.col("d"))
    assert [r[0] for r in heavy_keys(fact, "k", 0.01).select("heavy_key").collect()] == [7]
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", False)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        got = skew_join(fact, dim, "k", "d", 0.01)
        tasks = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
        plain = sorted(r["count"] for r in want.groupBy(F.spark_partition_id()).count().collect())
        assert tasks[-1] <= 3 * tasks[len(tasks) // 2] and plain[-1] > 5 * plain[len(plain) // 2]
        assert sorted(values(got)) == sorted(values(want))
        twice = dim.union(dim)
        assert skew_join(fact, twice, "k", "d", 0.5).count() == 2 * want.count()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert skew_join(fact.limit(0), dim, "k", "d").count() == 0
    with pytest.raises(ValueError):
        heavy_keys(fact, "k", 0)


def test_union_sample_year(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(2,)], "k int")
    assert sorted(values(union_years([a, b]), "k", "v")) == [(1, "x"), (2, None)]
    assert values(sample_rows(union_years([a, b]), 1, ["k"]), "k") == [(1,)]
    d = spark.createDataFrame([(dt.date(2019, 3, 1),)], "order_date date")
    assert values(with_order_year(d), "order_year") == [(2019,)]


def test_only_needed_tables_and_columns_are_read(spark):
    text = plan(view(spark, SF, "sales", ["subcategory", "final_amount_inr"]))
    assert "part.parquet" in text and "orders.parquet" not in text and "customer.parquet" not in text
    assert "l_shipdate" not in text and "p_name" not in text
    few = plan(QUERIES["q_filters"](spark, SF))
    assert "In(p_type, [LARGE,PROMO])" in few or "In(p_type, [PROMO,LARGE])" in few


def test_no_pairwise_joins(spark):
    for name in ("q_fest_impact", "q_fest_series", "q_brand_share", "q_age_frequency", "q_cohort_retention", "q_disc_monthly"):
        text = plan(QUERIES[name](spark, SF))
        assert "NestedLoopJoin" not in text and "CartesianProduct" not in text, name


def test_spread_setting_keeps_results(spark):
    want = QUERIES["q_geo_tier"](spark, SF).collect()
    spark.conf.set("salesflow.view.spread", "3")
    try:
        assert QUERIES["q_geo_tier"](spark, SF).collect() == want
    finally:
        spark.conf.unset("salesflow.view.spread")
