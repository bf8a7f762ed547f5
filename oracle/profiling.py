from oracle.cleaning import _CITIES, _PRICES
from oracle.common import corr_rows
from oracle.views import on_raw, on_sales

_TEXT = ["order_date", "category", "brand", "original_price_inr", "customer_city", "customer_age_group", "delivery_days",
         "customer_rating", "is_prime_member", "festival_name"]
_NUM = ["l_quantity", "l_discount"]
_NUMBERS = ["original_price_inr", "discount_percent", "discounted_price_inr", "quantity", "subtotal_inr", "delivery_charges",
            "final_amount_inr", "customer_rating", "product_rating", "product_weight_kg", "delivery_days", "is_prime_member",
            "is_festival_sale"]
_TEST = """s AS (SELECT avg(discounted_price_inr) FILTER (WHERE brand = 'Brand#12') AS bm,
    stddev_samp(discounted_price_inr) FILTER (WHERE brand = 'Brand#12') AS bs,
    count(discounted_price_inr) FILTER (WHERE brand = 'Brand#12') AS n,
    avg(discounted_price_inr) AS am, stddev_samp(discounted_price_inr) AS sd FROM sales)"""
_TAIL = "\nUNION ALL\n"
_RANGES = [(1992, 1994), (1995, 1998), (1992, 1998)]


def _simpson(density: str, upper: str, steps: int = 2000) -> str:
    """Area under ``density`` (in x) from 0 to ``upper`` by Simpson's rule."""
    return (f"(SELECT sum((CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density}) "
            f"* {upper} / {steps} / 3 FROM (SELECT i, {upper} * i / {steps} AS x FROM range(0, {steps + 1}) steps(i)))")


def _describe_text(c: str) -> str:
    counts = f"(SELECT {c} AS v, count(*) AS w FROM raw_sales WHERE {c} IS NOT NULL GROUP BY {c})"
    nulls = ", ".join(f'NULL::DOUBLE AS "{x}"' for x in ("mean", "std", "min", "p25", "p50", "p75", "max"))
    return f"""SELECT '{c}' AS "column", CAST(sum(w) AS BIGINT) AS "count", count(*)::DOUBLE AS "unique",
  arg_min(v, (-w, v)) AS top, max(w)::DOUBLE AS freq, {nulls} FROM {counts}"""


def _describe_number(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS "count", NULL::DOUBLE AS "unique", NULL::VARCHAR AS top, NULL::DOUBLE AS freq,
  round(avg({c}), 8), round(stddev_samp({c}), 8), round(min({c}), 8), round(quantile_cont({c}, 0.25), 8),
  round(quantile_cont({c}, 0.5), 8), round(quantile_cont({c}, 0.75), 8), round(max({c}), 8) FROM raw_sales"""


SQL = {
    "q_profile_shape": on_raw(f"SELECT count(*) AS n_rows, {len(_TEXT + _NUM)} AS n_cols FROM raw_sales"),
    "q_profile_nulls": on_raw(_TAIL.join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS n_null FROM raw_sales""" for c in _TEXT + _NUM)),
    "q_profile_nunique": on_raw(_TAIL.join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique FROM raw_sales""" for c in _TEXT + _NUM)),
    "q_profile_nunique_approx": on_raw(_TAIL.join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique, 'true' AS within FROM raw_sales""" for c in _TEXT + _NUM)),
    # the estimates themselves are random; every one of them has to keep the stated bound
    "q_approx_quantiles": on_sales(_TAIL.join(
        f"""SELECT {lo} AS lo_year, {hi} AS hi_year, '{c}' AS "column", CAST({p} AS DOUBLE) AS prob, count({c}) AS n, 'true' AS within
  FROM sales WHERE order_year BETWEEN {lo} AND {hi}"""
        for lo, hi in _RANGES for c in ("final_amount_inr", "discounted_price_inr") for p in (0.05, 0.25, 0.5, 0.75, 0.95))),
    "q_approx_distinct": on_sales(_TAIL.join(
        f"""SELECT {lo} AS lo_year, {hi} AS hi_year, customer_tier, '{c}' AS "column", count(DISTINCT {c}) AS n_distinct, 'true' AS within
  FROM sales WHERE order_year BETWEEN {lo} AND {hi} GROUP BY customer_tier"""
        for lo, hi in _RANGES for c in ("customer_id", "product_id", "transaction_id"))),
    "q_profile_describe": on_raw(_TAIL.join([_describe_text(c) for c in _TEXT] + [_describe_number(c) for c in _NUM])),
    "q_missing_map": on_raw(_TAIL.join(f"""SELECT CAST(l_partkey % 20 AS INTEGER) AS row_bucket, '{c}' AS "column",
  round(avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS null_share FROM raw_sales GROUP BY 1""" for c in _TEXT + _NUM)),
    "q_value_counts": on_raw(f"cities AS (SELECT {_CITIES} AS customer_city FROM raw_sales)", """
SELECT customer_city, count(*) AS n FROM cities WHERE customer_city IS NOT NULL GROUP BY customer_city
ORDER BY n DESC, customer_city LIMIT 10"""),
    "q_value_shares": on_sales("""
SELECT coalesce(festival_name, 'No Festival') AS festival_name, round(count(*) / sum(count(*)) OVER () * 100, 6) AS share_pct
FROM sales GROUP BY 1"""),
    "q_corr_matrix": on_sales(corr_rows(_NUMBERS, "sales")),
    "q_max_for_brand": on_raw(_PRICES, "SELECT round(max(final_amount_inr), 2) AS max_value FROM priced WHERE lower(trim(brand)) = 'noise'"),
    "q_product_price_range": on_sales("""
SELECT count(DISTINCT product_name) AS n_names, round(min(discounted_price_inr), 6) AS min_price,
  round(max(discounted_price_inr), 6) AS max_price FROM sales WHERE regexp_matches(product_name, '(?i)BLUE (bolt|gear)')"""),
    "q_product_names": on_sales("SELECT DISTINCT product_name FROM sales WHERE regexp_matches(product_name, '(?i)BLUE (bolt|gear)')"),
    "q_find_products": on_sales("""
SELECT transaction_id, product_name, round(final_amount_inr, 6) AS final_amount_inr FROM sales WHERE product_name ILIKE '%widget%'"""),
    "q_distinct_values": on_raw("SELECT DISTINCT delivery_days FROM raw_sales"),
    "q_z_test": on_sales(_TEST, "z AS (SELECT *, (bm - am) / (sd / sqrt(n)) AS z FROM s)", f"""
SELECT n, round(bm, 6) AS brand_mean, round(am, 6) AS all_mean, round(sd, 6) AS all_std, round(z, 6) AS z,
  round(1 - 2 * {_simpson("exp(-x * x / 2) / sqrt(2 * pi())", "abs(z)")}, 6) AS p FROM z"""),
    "q_t_test": on_sales(_TEST, "t AS (SELECT *, (bm - am) / (bs / sqrt(n)) AS t, n - 1.0::DOUBLE AS v FROM s)", f"""
SELECT n, round(bm, 6) AS brand_mean, round(bs, 6) AS brand_std, round(am, 6) AS all_mean, round(sd, 6) AS all_std, round(t, 6) AS t,
  round(1 - 2 * {_simpson("exp(lgamma((v + 1) / 2) - lgamma(v / 2) - (v + 1) / 2 * ln(1 + x * x / v)) / sqrt(v * pi())", "abs(t)")}, 6)
  AS p FROM t"""),
    "q_price_histogram": on_sales("span AS (SELECT min(discounted_price_inr) AS lo, max(discounted_price_inr) AS hi FROM sales)", """
SELECT subcategory, bin, round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 40, 6) AS bin_lo,
  round(any_value(lo) + (bin + 1) * (any_value(hi) - any_value(lo)) / 40, 6) AS bin_hi, count(*) AS n
FROM (SELECT subcategory, lo, hi, CAST(least(floor((discounted_price_inr - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin
  FROM sales, span) GROUP BY subcategory, bin"""),
    "q_filters": on_sales("""
SELECT transaction_id, order_year, subcategory, brand, round(final_amount_inr, 6) AS final_amount_inr FROM sales
WHERE order_year IN (1997, 1998) AND subcategory IN ('PROMO', 'LARGE') AND brand IN ('Brand#1', 'Brand#12')"""),
    "q_filters_latest": on_sales("""
SELECT transaction_id, order_year, brand, round(final_amount_inr, 6) AS final_amount_inr FROM sales
WHERE order_year = (SELECT max(order_year) FROM sales) AND brand = 'Brand#7'"""),
    "q_filter_options": on_sales("SELECT DISTINCT brand FROM sales WHERE brand IS NOT NULL"),
    "q_load_years": on_sales("""
SELECT order_year, order_month, order_month_name, count(*) AS n_rows, round(sum(final_amount_inr), 2) AS revenue FROM sales GROUP BY ALL"""),
    "q_load_year_list": on_sales("""
SELECT order_year, order_month, order_month_name, count(*) AS n_rows, round(sum(final_amount_inr), 2) AS revenue FROM sales
WHERE order_year IN (1890, 1996, 1998) GROUP BY ALL"""),
    "q_union_years": on_sales("""
SELECT order_year, count(*) AS n_rows, count(CASE WHEN order_year % 2 = 1 THEN customer_rating END) AS n_rated FROM sales GROUP BY order_year"""),
    "q_csv_raw": on_raw("SELECT transaction_id, brand, customer_city FROM raw_sales"),
    "q_csv_clean": on_sales("""
SELECT order_year, order_month, count(*) AS n_rows, round(sum(final_amount_inr), 2) AS revenue FROM sales GROUP BY ALL"""),
    "q_profile_types": on_raw("vals AS (" + _TAIL.join(
        f"""SELECT '{c}' AS "column", '{'double' if c in _NUM else 'string'}' AS type, CAST({c} AS VARCHAR) AS v FROM raw_sales WHERE {c} IS NOT NULL"""
        for c in _TEXT + _NUM) + ")", r"""counted AS (SELECT "column", type, count(*) AS n_values,
  count(*) FILTER (WHERE regexp_full_match(v, '[+-]?[0-9]+')) AS n_whole,
  count(*) FILTER (WHERE regexp_full_match(v, '[+-]?[0-9]+(\.[0-9]+)?')) AS n_number,
  count(*) FILTER (WHERE regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS n_date FROM vals GROUP BY ALL)""", """
SELECT *, CASE WHEN n_whole = n_values THEN 'bigint' WHEN n_number = n_values THEN 'double' WHEN n_date = n_values THEN 'date'
  ELSE 'string' END AS suggested FROM counted"""),
    "q_csv_quarantine": on_sales("""kinds AS (SELECT quantity % 10 AS k, final_amount_inr AS x FROM sales)""", """
SELECT 'good' AS reason, count(*) AS n_lines, round(sum(x), 2) AS revenue, count(*) FILTER (WHERE k = 4) AS n_line_breaks FROM kinds WHERE k >= 4
UNION ALL SELECT 'unreadable order_date', count(*), NULL, 0 FROM kinds WHERE k = 0 HAVING count(*) > 0
UNION ALL SELECT 'wrong number of fields', count(*), NULL, 0 FROM kinds WHERE k IN (1, 2) HAVING count(*) > 0
UNION ALL SELECT 'unreadable quantity', count(*), NULL, 0 FROM kinds WHERE k = 3 HAVING count(*) > 0
UNION ALL SELECT 'unreadable final_amount_inr', count(*), NULL, 0 FROM kinds WHERE k = 3 HAVING count(*) > 0"""),
    "q_append_batch": on_sales("""
SELECT CASE WHEN order_year % 2 = 0 THEN 'even years' ELSE 'odd years' END AS batch, order_year, order_month, count(*) AS n_rows,
  round(sum(final_amount_inr), 2) AS revenue FROM sales GROUP BY ALL"""),
    "q_star_heavy": on_sales("""
SELECT brand, customer_tier, count(*) AS n_rows, round(sum(final_amount_inr), 2) AS revenue FROM sales GROUP BY ALL"""),
    "q_sample_rows": on_sales("""
SELECT transaction_id, order_date, round(final_amount_inr, 6) AS final_amount_inr FROM sales
ORDER BY transaction_id, sales.final_amount_inr LIMIT 5"""),
}
