"""Literal-row tests of the rules that differ between engines."""

import datetime as dt
import pathlib
import time

import pytest
from conftest import values
from pyspark.sql import functions as F

from salesflow import fixed_values as fv
from salesflow.functions.dates import floor_months
from salesflow.functions.numeric import clip, cut, parse_price, safe_corr, to_number0
from salesflow.functions.text import capitalize, festival_key, is_returned, map_state, parse_flag, strip_text, title_case
from salesflow.operators import cleaning
from salesflow.operators.aggregate import dense, pct_change
from salesflow.operators.filters import apply_filters, find_products
from salesflow.operators.profiling import infer_types, profile_describe
from salesflow.operators.stats import corr_matrix, ols_by, t_test_1samp, z_test
from salesflow.plans import customer, market, product, revenue
from salesflow.schema import detect_column, require_columns
from salesflow.session import Scratch, materialize, materialize_buckets
from salesflow.sources import star


def one(spark, values_, dtype="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values_)], f"i int, c {dtype}").orderBy("i")


def column(spark, values_, expr, dtype="string"):
    return [r[0] for r in one(spark, values_, dtype).select(expr).collect()]


DATES = {
    "2015-01-25": dt.date(2015, 1, 25), "2015-01-05": dt.date(2015, 5, 1), "05-01-2015": dt.date(2015, 1, 5),
    "01/25/2015": dt.date(2015, 1, 25), "13/02/20": dt.date(2020, 2, 13), "5.1.2015": dt.date(2015, 1, 5),
    "20150105": dt.date(2015, 5, 1), "99-01-02": dt.date(1999, 2, 1), "13/13/2020": None, "00-01-2015": None,
    "": None, "2015-01-05000000": None, "2015": None, " 25-12-2019 ": dt.date(2019, 12, 25), "not a date": None,
    "31/02/2020": None, "01-02-80": dt.date(1980, 2, 1), "2020-02-30": None, "1-2-3-4": None, None: None,
}


def test_dates(spark):
    got = cleaning.clean_dates(one(spark, list(DATES)), "c").orderBy("i").collect()
    assert {k: r["c"] for k, r in zip(DATES, got)} == DATES
    plain = cleaning.clean_dates(one(spark, ["2015-01-05", "20150105"]), "c", iso_swap=False).collect()
    assert [r["c"] for r in plain] == [dt.date(2015, 1, 5)] * 2


def test_delivery(spark):
    text = ["Same Day", "express", "15", "15 days", "2-5 days", "-1", "45", None, "soon"]
    got = [r["c"] for r in cleaning.clean_delivery(one(spark, text), "c").orderBy("i").collect()]
    # the median of 0, 1, 1, 15, 3.5, 1, 30 is 1
    assert got == [0, 1, 1, 15, 3, 1, 30, 1, 1]


def test_rating(spark):
    text = ["4 stars", "3/5", "4.5/5.0", "8", None, "none", "5"]
    got = [r["c"] for r in cleaning.clean_rating(one(spark, text), "c").orderBy("i").collect()]
    assert got == [4.0, 3.0, 4.5, 4.25, 4.25, 4.25, 5.0]
    kept = [r["c"] for r in cleaning.clean_rating(one(spark, text), "c", fill=None).orderBy("i").collect()]
    assert kept == [4.0, 3.0, 4.5, None, None, None, 5.0]


def test_text(spark):
    assert column(spark, ["delhi-ncr o'neil", "1st floor", "  NEW  delhi", None, ""], title_case("c")) == [
        "Delhi-Ncr O'Neil", "1St Floor", "  New  Delhi", None, ""]
    assert column(spark, ["\t a b \n", None], strip_text("c")) == ["a b", None]
    assert column(spark, ["APPLE iPhone 13", "", None], capitalize("c")) == ["Apple iphone 13", "", None]
    assert column(spark, ["Delhi", "Goa", None], map_state("c")) == ["NCT of Delhi", "Goa", None]
    assert column(spark, ["Rs. 1200", "₹1,200.50", "1.2.3", "", None], parse_price("c")) == [
        0.12, 1200.5, None, None, None]
    assert column(spark, ["12", "x", None], to_number0("c")) == [12.0, 0.0, 0.0]


def test_cities(spark):
    got = cleaning.clean_city(one(spark, [" bengaluru ", "DELHI NCR", "bombay", "Pune", None]), "c").orderBy("i")
    assert [r["c"] for r in got.collect()] == ["Bangalore", "Delhi", "Mumbai", "Pune", None]
    again = cleaning.clean_city(got, "c").orderBy("i")
    assert values(again) == values(got)


def test_flags(spark):
    assert column(spark, ["Yes", " no ", "1", "0", "TRUE", "maybe", None], parse_flag("c")) == [
        True, False, True, False, True, None, None]
    assert column(spark, ["Returned", "delivered", None, "YES"], is_returned("c")) == [True, False, False, True]


def test_festival_order(spark):
    names = ["Black Friday", "Holiday", "Independence Day", "No Festival", "Great Prime Sale", "Deepavali", None]
    assert column(spark, names, festival_key("c")) == [
        "Eid", "Holi", "Independence Day", "Non-Festival", "Prime Day", "Diwali", "Non-Festival"]


def test_right_closed_bins(spark):
    got = column(spark, [0.0, 500.0, 501.0, 50000.0, 60000.0, None], cut("c", fv.PRICE_BAND_EDGES, fv.PRICE_BANDS), "double")
    assert got == [None, fv.PRICE_BANDS[0], fv.PRICE_BANDS[1], fv.PRICE_BANDS[4], fv.PRICE_BANDS[5], None]


def test_clip_and_corr(spark):
    assert column(spark, [-1.0, 5.0, None], clip("c", 0.0, 3.0), "double") == [0.0, 3.0, None]
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 3.0), (3.0, None, 3.0), (4.0, 1.0, 3.0)], "x double, y double, k double")
    assert df.agg(safe_corr("x", "k")).first()[0] is None
    pandas = df.toPandas()
    cells = {(r.col_x, r.col_y): r["corr"] for r in corr_matrix(df, ["x", "y", "k"]).collect()}
    assert len(cells) == 9 and cells["x", "k"] is None and cells["k", "k"] is None
    assert cells["x", "y"] == pytest.approx(pandas.x.corr(pandas.y)) == cells["y", "x"]
    line = ols_by(df.withColumn("g", F.lit("a")), "k", "x", ["g"]).first()
    assert line.slope is None and line.n == 4


def test_growth(spark):
    df = spark.createDataFrame([(2000, 1.0), (2001, 0.0), (2002, 5.0)], "y int, v double")
    got = [r["g"] for r in pct_change(df, "v", "y", "g").orderBy("y").collect()]
    assert got == [None, -100.0, None]


def test_mode_fill(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", None), ("h", None), (None, "z")], "grp string, v string")
    got = sorted(values(cleaning.fill_mode_by_group(df, "v", "grp")), key=str)
    assert got == sorted([("g", "b"), ("g", "a"), ("g", "a"), ("h", "Unknown"), (None, None)], key=str)


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame([("T1_DUP", 2, "late"), ("T1", 1, "early"), ("T2", 5, "only"), (None, 1, "n1"), (None, 2, "n2")],
                               "transaction_id string, seq int, note string")
    got = sorted(values(cleaning.dedup_transactions(df, ["seq"])), key=str)
    assert got == sorted([("T1", 1, "early"), ("T2", 5, "only"), (None, 1, "n1")], key=str)


def test_dense_fills_absent_cells(spark):
    df = spark.createDataFrame([(2000, "a", 1), (2000, None, 7), (2001, "zz", 2)], "y int, l string, n long")
    got = sorted(values(dense(df, ["y"], "l", ["a", "b"], {"n": F.lit(0)}), "y", "l", "n"))
    assert got == [(2000, "a", 1), (2000, "b", 0), (2001, "a", 0), (2001, "b", 0)]


def test_return_rate_counts_missing_status(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 5), "Returned"), (dt.date(2020, 1, 6), None)],
                               "order_date date, return_status string")
    assert values(revenue.monthly_returns(df)) == [(dt.date(2020, 1, 1), 50.0)]


def sale(day, amount=10.0, product="p", **more):
    return {"order_date": day, "product_id": product, "product_name": product.upper(), "subcategory": "s",
            "quantity": 1, "final_amount_inr": amount, **more}


SALE = ("order_date date, product_id string, product_name string, subcategory string, quantity long, "
        "final_amount_inr double")


def test_launch_month_counts_only_from_the_first(spark):
    d = dt.date
    df = spark.createDataFrame([sale(d(2020, 1, 15), 5.0, "mid"), sale(d(2020, 2, 3), 7.0, "mid"),
                                sale(d(2020, 1, 1), 5.0, "first"), sale(d(2020, 6, 3), 5.0, "first")], SALE)
    got = {r.product_id: r for r in product.product_lifecycle(df).collect()}
    assert got["mid"].rev_first_90days == 7.0 and got["first"].rev_first_90days == 5.0
    assert got["first"].peak_month == d(2020, 1, 1)  # earliest on ties
    assert got["mid"].time_to_peak_months == 0
    assert column(spark, [d(2020, 1, 1)], floor_months(F.col("c"), F.lit(d(2020, 1, 2))), "date") == [-1]


def test_festival_window(spark):
    d = dt.date
    rows = [(d(2020, 10, 1), 2020, None, 15.0), (d(2020, 10, 10), 2020, "Diwali", 4.0), (d(2020, 10, 10), 2020, None, 6.0),
            (d(2020, 10, 12), 2020, "Diwali", 3.0), (d(2020, 12, 1), 2020, None, 99.0)]
    df = spark.createDataFrame(rows, "order_date date, order_year int, festival_name string, final_amount_inr double")
    got = market.festival_impact(df).first()
    assert (got.before_sales, got.during_sales, got.after_sales, got.lift_pct) == (15.0, 10.0, 3.0, 900.0)


def test_filters(spark):
    df = spark.createDataFrame([(2019, "a", "x"), (2020, "a", "y"), (2020, "b", "x")], "order_year int, subcategory string, brand string")
    assert apply_filters(df).count() == 2
    assert apply_filters(df, []).count() == 3
    assert values(apply_filters(df, [2019, 2020], ["a"], ["x"])) == [(2019, "a", "x")]
    names = spark.createDataFrame([("Red Bolt",), ("blue bolt",), (None,)], "product_name string")
    assert find_products(names, "^RED").count() == 1
    with pytest.raises(ValueError):
        require_columns(df, ["nope"])
    assert detect_column(df, "BRAND") == "brand"
    with pytest.raises(ValueError):
        detect_column(df, "return")


def test_p_values(spark):
    # 1.96 standard errors: two-sided normal tail 0.05
    rows = [("A", 1.0), ("B", 3.0)] * 50
    df = spark.createDataFrame(rows, "brand string, m double")
    z = z_test(df, "A", "m").first()
    assert z.z == pytest.approx((1 - 2) / (z.all_std / 50 ** 0.5)) and 0 <= z.p < 1e-6
    # published t table: 2.228 at 10 degrees of freedom is 0.05; 12.706 at 1; 1.984 at 100
    for t_crit, dof in ((2.2281389, 10), (12.7062047, 1), (1.9839715, 100)):
        n = dof + 1
        half = [-1.0, 1.0] * (n // 2) + ([0.0] if n % 2 else [])
        mean_s = (sum(x * x for x in half) / (n - 1)) ** 0.5
        shift = t_crit * mean_s / n ** 0.5
        others = [("B", -shift)] * n  # overall mean 0 with the brand centred on +shift
        df = spark.createDataFrame([("A", x + shift) for x in half] + others, "brand string, m double")
        got = t_test_1samp(df, "A", "m").first()
        assert got.t == pytest.approx(t_crit, rel=1e-6) and got.p == pytest.approx(0.05, abs=1e-6)


def test_cohort_month_zero_is_everyone(spark):
    d = dt.date
    df = spark.createDataFrame([(1, d(2020, 1, 3)), (1, d(2020, 3, 1)), (2, d(2020, 1, 9)), (2, d(2020, 1, 20)), (3, d(2020, 2, 2))],
                               "customer_id long, order_date date")
    got = {(r.cohort_month, r.months_since): (r.customers, r.retention_rate) for r in customer.cohort_retention(df).collect()}
    assert got == {(d(2020, 1, 1), 0): (2, 1.0), (d(2020, 1, 1), 2): (1, 0.5), (d(2020, 2, 1), 0): (1, 1.0)}
    assert sorted(values(customer.cohort_matrix(df))) == [(d(2020, 1, 1), [1.0, None, 0.5]), (d(2020, 2, 1), [1.0, None, None])]
    assert len(values(customer.cohort_cells(df))) == 6
    wide = customer.cohort_columns(df, [0, 2, 7])
    assert wide.columns == ["cohort_month", "m0", "m2", "m7"] and sorted(values(wide))[0][1:] == (1.0, 0.5, None)
    assert values(customer.cohort_matrix(df.limit(0))) == []


def test_labels_carry_their_position(spark):
    df = spark.createDataFrame([("55+", "s", 5.0), ("18-25", "s", 1.0), (" 26-35", "s", 2.0)], "customer_age_group string, subcategory string, final_amount_inr double")
    got = values(customer.age_subcategory(df), "ord", "age_group", "revenue")
    assert got == [(0, "18-25", 1.0), (1, "26-35", 2.0), (2, "36-45", 0.0), (3, "46-55", 0.0), (4, "55+", 5.0)]


def test_correlations_over_many_tasks_and_large_values(spark):
    x = F.col("id").cast("double")
    df = spark.range(4000, numPartitions=7).select(
        (x % 3).cast("string").alias("g"), (x + 1e9).alias("a"), F.when(F.col("id") % 5 != 0, F.sin(x) * 1e-3 + 1e6).alias("b"),
        F.lit(4.0).alias("k"), F.lit(None).cast("double").alias("none"), (F.col("id") % 2 == 0).alias("flag"))
    frame = df.toPandas()
    for groups, parts in ((["g"], frame.groupby("g")), ([], [((), frame)])):
        got = {(r["g"] if groups else (), r.col_x, r.col_y): r["corr"] for r in corr_matrix(df, ["a", "b", "k", "none", "flag"], groups).collect()}
        assert len(got) == 25 * (3 if groups else 1)
        for name, rows in parts:
            want = rows[["a", "b", "k", "flag"]].astype(float).corr()
            for c in ("a", "b", "flag"):
                for c2 in ("a", "b", "flag"):
                    assert got[name, c, c2] == pytest.approx(want.loc[c, c2], abs=1e-6)
                assert got[name, c, "k"] is None and got[name, "none", c] is None
    assert "Generate" not in corr_matrix(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1]
    assert values(corr_matrix(df.limit(0), ["a", "b"], ["g"])) == []


def test_describe_reads_distinct_values(spark):
    df = spark.createDataFrame([("b", 1.5, None, True), ("a", 2.5, None, None), ("a", 2.5, None, False), (None, None, None, True), ("b", -4.0, None, True)],
                               "t string, x double, none int, flag boolean")
    got = {r.column: r for r in profile_describe(df).collect()}
    assert set(got) == {"t", "x", "none", "flag"}
    assert (got["t"]["count"], got["t"].unique, got["t"].top, got["t"].freq) == (4, 2.0, "a", 2.0)
    x = df.toPandas().x
    assert got["x"]["count"] == 4 and got["x"]["mean"] == pytest.approx(x.mean()) and got["x"]["std"] == pytest.approx(x.std())
    assert (got["x"]["min"], got["x"].p25, got["x"].p50, got["x"].p75, got["x"]["max"]) == tuple(x.quantile([0, .25, .5, .75, 1]))
    assert got["none"]["count"] == 0 and got["none"]["mean"] is None and got["flag"].top == "true"


def test_types_of_texts(spark):
    df = spark.createDataFrame([("1", "1.5", "2020-01-05", "x", None), ("-2", "7", "2020-02-30", "3", None)], "a string, b string, c string, d string, e string")
    got = {r.column: (r.n_values, r.n_whole, r.n_number, r.n_date, r.suggested) for r in infer_types(df).collect()}
    assert got == {"a": (2, 2, 2, 0, "bigint"), "b": (2, 1, 2, 0, "double"), "c": (2, 0, 0, 2, "date"), "d": (2, 1, 1, 0, "string")}


def test_dedup_sorts_only_repeats(spark):
    rows = [(f"T{i}", i, "single") for i in range(50)] + [(f"T{i % 5}_DUP", 100 + i, "copy") for i in range(3000)] + [(None, 7, "x"), (None, 3, "y")]
    df = spark.createDataFrame(rows, "transaction_id string, seq int, note string")
    got = cleaning.dedup_transactions(df, ["seq"])
    assert sorted(values(got), key=str) == sorted([*rows[:50], (None, 3, "y")], key=str)
    assert "_again" not in got.columns and values(cleaning.dedup_transactions(df.limit(0), ["seq"])) == []
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text


def test_dedup_of_many_repeats_shuffles_rows_once(spark):
    df = spark.createDataFrame([("T1_DUP", 3, "c"), ("T1", 1, "b"), ("T1", 1, "a"), ("T2", 2, None), (None, 5, "x"), (None, 4, "y")], "transaction_id string, seq int, v string")
    few = sorted(values(cleaning.dedup_transactions(df, ["seq"])), key=str)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        got = cleaning.dedup_transactions(df, ["seq"])
        text = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in text and text.count("Exchange") == 1
        assert sorted(values(got), key=str) == few == sorted([("T1", 1, "a"), ("T2", 2, None), (None, 4, "y")], key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_texts_are_cleaned_value_by_value(spark):
    df = spark.createDataFrame([(i, [" bombay ", "x", None][i % 3]) for i in range(9)], "id int, customer_city string")
    seen = []

    def clean(d):
        seen.append(d.count())
        return cleaning.clean_city(d)

    want = sorted(values(cleaning.clean_city(df)))
    assert sorted(values(cleaning.by_value(df, "customer_city", clean))) == want and seen == [3]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)     # too many values: row by row
        assert sorted(values(cleaning.by_value(df, "customer_city", clean))) == want and seen[1:] == [3, 9]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def dirty_rows(spark, n):
    """Raw sales: ids with several rows and marks, one id and null very often."""
    return spark.range(n).selectExpr(
        f"case id % 10 when 0 then null when 1 then 'T-hot' else concat('T', cast(id % {n // 2} as string), if(id % 3 = 0, '_DUP', '')) end as transaction_id",
        "cast(id * 7919 % 1009 as int) as seq", "element_at(array('2020-01-25', '05/02/2020', 'not a date', null), cast(id % 4 + 1 as int)) as order_date",
        "if(id % 5 = 0, null, concat('cat ', cast(id % 3 as string))) as category", "if(id % 7 = 0, null, cast(id % 6 as string)) as customer_age_group",
        "if(id % 3 = 0, ' bombay ', concat('city ', cast(id % 9 as string))) as customer_city", "md5(cast(id as string)) as product_name", "'Noise' as brand",
        "'Smart Watch' as subcategory", "concat('₹', cast(id % 500 as string)) as original_price_inr", "cast(id % 30000 as double) as discounted_price_inr",
        "cast(id * 2 as double) as subtotal_inr", "cast(id * 3 as double) as final_amount_inr", "if(id % 4 = 0, null, cast(id % 12 as string)) as delivery_days",
        "if(id % 4 = 0, null, cast(id % 6 as string)) as customer_rating", "if(id % 2 = 0, 'Yes', 'no') as is_prime_member", "cast(null as string) as festival_name")


def stored_bytes(path):
    return sum(f.stat().st_size for f in pathlib.Path(path).rglob("*") if f.is_file() and f.suffix != ".crc")


def test_dedup_of_dealt_rows_does_not_shuffle_them(spark, monkeypatch):
    raw = dirty_rows(spark, 4000)
    want = sorted(values(cleaning.dedup_transactions(raw, ["seq"])), key=str)
    dealt = cleaning.deal_by_id(raw)
    got = cleaning.dedup_transactions(dealt, ["seq"], dealt=dealt)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(values(got), key=str) == want
    monkeypatch.setattr(cleaning, "HEAVY_ID_ROWS", 300)      # null and T-hot are spread over tasks
    got = cleaning.dedup_transactions(dealt, ["seq"], dealt=dealt)
    assert got._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(seq") == 1
    assert sorted(values(got), key=str) == want
    empty = cleaning.deal_by_id(raw.limit(0))
    assert values(cleaning.dedup_transactions(empty, ["seq"], dealt=empty)) == []
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("buckets_")]


def test_pipeline_keeps_one_wide_table_and_no_shuffles(spark, tmp_path):
    dirty_rows(spark, 60000).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    behind = Scratch(spark)
    materialize(raw.select("seq"), within=behind)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
        with Scratch(spark) as kept:
            n = cleaning.clean_sales(raw, ["seq"], behind=behind).count()
            assert n == raw.select(F.replace("transaction_id", F.lit("_DUP"), F.lit(""))).distinct().count()
            # raw rows, cleaned rows and first rows together were more than twice the input
            assert 0 < stored_bytes(kept.path) < stored_bytes(tmp_path / "raw")
        assert not pathlib.Path(behind.path).exists()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_wide_tables_leave_no_shuffle_files(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    folders = [pathlib.Path(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]

    def shuffled():
        return {f for d in folders for f in d.rglob("shuffle_*")}

    for store in (lambda d: materialize(d, wide=True), lambda d: materialize_buckets(d, "id")):
        before = shuffled()
        stored = store(rows.repartition("k"))
        for _ in range(50):          # deleted in the background
            if not shuffled() - before:
                break
            time.sleep(0.2)
        assert not shuffled() - before and stored.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535"


def test_view_over_stored_lines(spark, tmp_path):
    rows = {"region": [(0, "r")], "nation": [(0, "n", 0), (1, None, 0)], "customer": [(1, "c", 0, 10.0, "BUILDING"), (2, "d", 1, None, None)],
            "part": [(1, "a b", "B", "t", 3, 1000.0), (1, "again", "C", None, 4, 1.0), (2, None, "D", "u", None, None)],
            "orders": [(k, 1 + k % 2, "O", 1.0, dt.datetime(2020, 10, 20 + k), None) for k in range(4)] + [(3, 1, "O", 2.0, None, "x"), (None, 1, "O", 2.0, None, "x")],
            "lineitem": [(k % 5, 1 + k % 3, 7, k % 2, 2.0, 50.5 * k, 0.1, 0.0, "R", "O", dt.datetime(2020, 11, 1)) for k in range(40)]
                        + [(None, 1, 7, 1, 1.0, 9.0, 0.0, 0.0, "R", "O", None), (2, None, 7, None, 1.0, 9.0, 0.0, 0.0, "R", "O", None)]}
    for name, data in rows.items():
        spark.createDataFrame(data, star.TABLES[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    within = Scratch(spark)
    for name in star.VIEWS:
        want = sorted(values(star.view(spark, str(tmp_path), name)), key=str)
        got = star.view(spark, str(tmp_path), name, within=within)
        assert len(want) > 20 and sorted(values(got), key=str) == want and got.columns == list(star.VIEWS[name])
    within.close()
