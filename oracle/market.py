from oracle.common import box
from oracle.views import on_sales

_KEYED = """keyed AS (SELECT *, CASE WHEN f LIKE '%diwali%' OR f LIKE '%deepavali%' THEN 'Diwali' WHEN f LIKE '%prime%' THEN 'Prime Day'
    WHEN f LIKE '%holi%' THEN 'Holi' WHEN f LIKE '%dussehra%' OR f LIKE '%vijayadashami%' THEN 'Dussehra'
    WHEN f LIKE '%independence%' THEN 'Independence Day' WHEN f LIKE '%new year%' THEN 'New Year'
    WHEN f LIKE '%id%' THEN 'Eid' ELSE 'Non-Festival' END AS festival
  FROM (SELECT *, lower(coalesce(festival_name, '')) AS f FROM sales)),
  dates AS (SELECT festival, order_year, min(order_date) AS festival_date FROM keyed WHERE festival <> 'Non-Festival' GROUP BY ALL)"""
_IMPACT = """impact AS (SELECT d.festival, d.order_year,
    coalesce(sum(CASE WHEN s.order_date < d.festival_date THEN final_amount_inr END), 0) AS b,
    coalesce(sum(CASE WHEN s.order_date = d.festival_date THEN final_amount_inr END), 0) AS du,
    coalesce(sum(CASE WHEN s.order_date > d.festival_date THEN final_amount_inr END), 0) AS a
  FROM dates d JOIN sales s ON s.order_date BETWEEN d.festival_date - 15 AND d.festival_date + 15 GROUP BY ALL),
  lifts AS (SELECT *, round_even(CASE WHEN b > 0 THEN (du - b / 15) / (b / 15) * 100 ELSE 0 END, 2) AS lift_pct FROM impact)"""
_PRICED = """priced AS (SELECT * FROM sales WHERE brand IS NOT NULL AND subcategory IS NOT NULL AND discounted_price_inr IS NOT NULL)"""
_RANKED = """ranked AS (SELECT subcategory, brand, sum(final_amount_inr) AS rev,
  row_number() OVER (PARTITION BY subcategory ORDER BY sum(final_amount_inr) DESC, brand) AS r FROM priced GROUP BY subcategory, brand)"""
_EDGES = """edges AS (SELECT subcategory, """ + ", ".join(
    f"round(quantile_cont(discounted_price_inr, {p}), 6) AS e{i}" for i, p in enumerate([0, 0.2, 0.4, 0.6, 0.8, 1])) + """
  FROM priced GROUP BY subcategory),
  tiered AS (SELECT subcategory, brand, final_amount_inr, CASE WHEN e0 = e1 OR e1 = e2 OR e2 = e3 OR e3 = e4 OR e4 = e5
      THEN CASE WHEN p <= 0 THEN NULL WHEN p <= 500 THEN 1 WHEN p <= 1000 THEN 2 WHEN p <= 5000 THEN 3 WHEN p <= 10000 THEN 4 ELSE 5 END
      ELSE 1 + (p > e1)::INT + (p > e2)::INT + (p > e3)::INT + (p > e4)::INT END AS tier
    FROM (SELECT *, round(discounted_price_inr, 6) AS p FROM priced) JOIN edges USING (subcategory))"""
_TIERS = ["very_low", "low", "mid", "high", "premium"]

SQL = {
    "q_geo_state": on_sales("""
SELECT CASE customer_state WHEN 'Andaman and Nicobar' THEN 'Andaman & Nicobar Islands' WHEN 'Delhi' THEN 'NCT of Delhi'
  WHEN 'Jammu & Kashmir' THEN 'Jammu and Kashmir' WHEN 'Odisha' THEN 'Orissa' WHEN 'Pondicherry' THEN 'Puducherry'
  WHEN 'Uttaranchal' THEN 'Uttarakhand' WHEN 'Dadra and Nagar Haveli' THEN 'Dadra & Nagar Haveli and Daman & Diu'
  ELSE customer_state END AS customer_state, round(sum(final_amount_inr), 2) AS revenue FROM sales GROUP BY 1"""),
    "q_geo_tier": on_sales("SELECT customer_tier, round(sum(final_amount_inr), 2) AS revenue FROM sales GROUP BY customer_tier"),
    "q_geo_top_cities": on_sales("""
SELECT customer_city, round(sum(final_amount_inr), 2) AS revenue FROM sales GROUP BY customer_city
ORDER BY sum(final_amount_inr) DESC, customer_city LIMIT 15"""),
    "q_geo_tier_yoy": on_sales("ty AS (SELECT order_year, customer_tier, sum(final_amount_inr) AS rev FROM sales GROUP BY ALL)", """
SELECT order_year, customer_tier, round(rev, 2) AS revenue,
  round((rev / nullif(lag(rev) OVER (PARTITION BY customer_tier ORDER BY order_year), 0) - 1) * 100, 6) AS yoy_pct FROM ty"""),
    "q_fest_dates": on_sales(_KEYED, "SELECT festival, order_year, festival_date FROM dates"),
    "q_fest_impact": on_sales(_KEYED, _IMPACT, """
SELECT festival, order_year, round(b, 2) AS before_sales, round(du, 2) AS during_sales, round(a, 2) AS after_sales, lift_pct FROM lifts"""),
    "q_fest_avg_lift": on_sales(_KEYED, _IMPACT, "SELECT festival, round(avg(lift_pct), 6) AS avg_lift_pct FROM lifts GROUP BY festival"),
    "q_fest_series": on_sales(_KEYED, """
SELECT d.festival, d.order_year, d.festival_date, s.order_date, round(sum(final_amount_inr), 2) AS revenue
FROM dates d JOIN sales s ON s.order_date BETWEEN d.festival_date - 15 AND d.festival_date + 15 GROUP BY ALL"""),
    "q_fest_subcategory_lift": on_sales(_KEYED, "last AS (SELECT festival, max(festival_date) AS d FROM dates GROUP BY festival)",
        """cells AS (SELECT festival, subcategory, coalesce(sum(CASE WHEN order_date < d THEN final_amount_inr END), 0) AS b,
    coalesce(sum(CASE WHEN order_date = d THEN final_amount_inr END), 0) AS du
  FROM last JOIN sales ON order_date BETWEEN d - 15 AND d GROUP BY ALL),
  lifted AS (SELECT *, (du - b) / (b + 1e-6::DOUBLE) * 100 AS lift FROM cells)""", """
SELECT festival, subcategory, round(b, 2) AS before_sales, round(du, 2) AS during_sales, round(lift, 6) AS lift_pct,
  CAST(row_number() OVER (PARTITION BY festival ORDER BY lift DESC, subcategory) AS INTEGER) AS rank FROM lifted QUALIFY rank <= 10"""),
    "q_comp_brands": on_sales(_PRICED, """
SELECT subcategory, brand, round(sum(final_amount_inr), 2) AS revenue, CAST(sum(quantity) AS BIGINT) AS volume,
  round(avg(discounted_price_inr), 6) AS avg_price, round(quantile_cont(discounted_price_inr, 0.5), 6) AS median_price,
  round(sum(final_amount_inr) / sum(sum(final_amount_inr)) OVER (PARTITION BY subcategory) * 100, 6) AS market_share
FROM priced GROUP BY subcategory, brand"""),
    "q_comp_price_box": on_sales(_PRICED, _RANKED, f"""
SELECT subcategory, brand, {box('discounted_price_inr')}, count(*) AS n
FROM priced JOIN (SELECT subcategory, brand FROM ranked WHERE r <= 10) USING (subcategory, brand) GROUP BY subcategory, brand"""),
    "q_comp_price_tiers": on_sales(_PRICED, _RANKED, _EDGES, "\nSELECT subcategory, brand, " + ", ".join(
        f"round(coalesce(sum(CASE WHEN tier = {i + 1} THEN final_amount_inr END) / "
        f"nullif(sum(CASE WHEN tier IS NOT NULL THEN final_amount_inr END), 0) * 100, 0), 6) AS tier_{t}"
        for i, t in enumerate(_TIERS)) + """
FROM tiered JOIN (SELECT subcategory, brand FROM ranked WHERE r <= 10) USING (subcategory, brand) GROUP BY subcategory, brand"""),
}
