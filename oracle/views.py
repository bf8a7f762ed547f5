"""The input views as SQL common table expressions."""

from salesflow.sources.star import RAW_SALES

SALES = """sales AS (
  SELECT concat_ws('_', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR) AS transaction_id,
    CAST(o_orderdate AS DATE) AS order_date, o_custkey AS customer_id, l_partkey AS product_id, p_name AS product_name,
    split_part(p_name, ' ', 2) AS category, p_type AS subcategory, p_brand AS brand,
    l_extendedprice / l_quantity AS original_price_inr, l_discount * 100 AS discount_percent,
    l_extendedprice / l_quantity * (1 - l_discount) AS discounted_price_inr, CAST(l_quantity AS BIGINT) AS quantity,
    l_extendedprice * (1 - l_discount) AS subtotal_inr, l_extendedprice * (1 - l_discount) * l_tax AS delivery_charges,
    l_extendedprice * (1 - l_discount) * (1 + l_tax) AS final_amount_inr,
    n_name AS customer_city, r_name AS customer_state,
    CASE n_nationkey % 4 WHEN 0 THEN 'Metro' WHEN 1 THEN 'Tier1' WHEN 2 THEN 'Tier2' ELSE 'Rural' END AS customer_tier,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '18-25' WHEN 'BUILDING' THEN '26-35' WHEN 'FURNITURE' THEN '36-45'
      WHEN 'HOUSEHOLD' THEN '46-55' ELSE '55+' END AS customer_age_group,
    o_orderpriority AS payment_method, c_acctbal >= 4000 AS is_prime_member,
    CASE WHEN month(o_orderdate) = 10 AND day(o_orderdate) BETWEEN 20 AND 24 THEN 'Diwali Sale'
      WHEN month(o_orderdate) = 7 AND day(o_orderdate) BETWEEN 15 AND 16 THEN 'Prime Day'
      WHEN month(o_orderdate) = 3 AND day(o_orderdate) BETWEEN 8 AND 10 THEN 'Holi Festival'
      WHEN month(o_orderdate) = 8 AND day(o_orderdate) = 15 THEN 'Independence Day'
      WHEN month(o_orderdate) = 1 AND day(o_orderdate) = 1 THEN 'New Year'
      WHEN month(o_orderdate) = 11 AND day(o_orderdate) BETWEEN 24 AND 28 THEN 'Black Friday' END AS festival_name,
    festival_name IS NOT NULL AS is_festival_sale,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(1 + ((l_partkey + l_suppkey) % 9) / 2 AS DOUBLE) END AS customer_rating,
    CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Delivered' ELSE 'Cancelled' END AS return_status,
    CAST(year(o_orderdate) AS INTEGER) AS order_year, CAST(month(o_orderdate) AS INTEGER) AS order_month,
    monthname(o_orderdate) AS order_month_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
    p_size / 10 AS product_weight_kg, CAST(1 + (p_size % 9) / 2 AS DOUBLE) AS product_rating,
    CAST(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) % 8 AS INTEGER) AS delivery_days
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""

# the dirty text is the input definition itself, so both engines read the same expressions
RAW = "raw_sales AS (SELECT " + ", ".join(f"{expr} AS {name}" for name, (expr, _) in RAW_SALES.items()) + """
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""


def on_sales(*parts: str) -> str:
    """A query over ``sales``: further CTEs first, the final SELECT last."""
    return "WITH " + ",\n".join([SALES, *parts[:-1]]) + "\n" + parts[-1]


def on_raw(*parts: str) -> str:
    return "WITH " + ",\n".join([RAW, *parts[:-1]]) + "\n" + parts[-1]
