from oracle.views import on_raw

_TITLE = "array_to_string(list_transform(string_split(lower(trim({c})), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def _title(c: str) -> str:
    return _TITLE.format(c=c)


_CITIES = """CASE {t} WHEN 'Bengalore' THEN 'Bangalore' WHEN 'Banglore' THEN 'Bangalore' WHEN 'Bengaluru' THEN 'Bangalore'
  WHEN 'Delhi Ncr' THEN 'Delhi' WHEN 'New Delhi' THEN 'Delhi' WHEN 'Del' THEN 'Delhi' WHEN 'Calcutta' THEN 'Kolkata'
  WHEN 'Kolkatta' THEN 'Kolkata' WHEN 'Kolkat' THEN 'Kolkata' WHEN 'Bombay' THEN 'Mumbai' WHEN 'Mumba' THEN 'Mumbai'
  WHEN 'Chenai' THEN 'Chennai' WHEN 'Madras' THEN 'Chennai' WHEN 'Chenni' THEN 'Chennai' WHEN 'Chennaii' THEN 'Chennai'
  ELSE {t} END""".format(t=_title("customer_city"))
_CATEGORIES = """CASE WHEN {t} IN ('Electronics', 'Electronicss', 'Electronic') THEN 'Electronics & Accessories' ELSE {t} END""".format(
    t=_title("category"))
_NAME = "upper(product_name[1]) || lower(product_name[2:])"
_PRICE = "TRY_CAST(regexp_replace(original_price_inr, '[^0-9.]', '', 'g') AS DOUBLE)"
_PRICES = f"""priced AS (SELECT * EXCLUDE (original_price_inr), {_PRICE} AS original_price_inr,
  {_PRICE} * (1 - l_discount) AS discounted_price_inr, {_PRICE} * (1 - l_discount) * l_quantity AS subtotal_inr,
  {_PRICE} * (1 - l_discount) * l_quantity AS final_amount_inr FROM raw_sales)"""


def _date(swap: bool = True) -> str:
    text = "regexp_replace(trim(order_date), '[^0-9/.-]', '', 'g')"
    parts = f"regexp_split_to_array({text}, '[-/.]')"
    a, b, c = (f"TRY_CAST({parts}[{i}] AS INTEGER)" for i in (1, 2, 3))
    first = f"({a} > 31)"
    swapped = f"{c} <= 12" if swap else "false"
    day = f"CASE WHEN {first} THEN CASE WHEN {swapped} THEN {b} ELSE {c} END WHEN {a} > 12 OR {b} <= 12 THEN {a} ELSE {b} END"
    month = f"CASE WHEN {first} THEN CASE WHEN {swapped} THEN {c} ELSE {b} END WHEN {a} > 12 OR {b} <= 12 THEN {b} ELSE {a} END"
    year = f"CASE WHEN {first} THEN {a} ELSE {c} END"
    return (f"CASE WHEN len({parts}) = 3 THEN TRY_CAST(concat_ws('-', lpad(({year})::VARCHAR, 4, '0'), lpad(({month})::VARCHAR, 2, '0'), "
            f"lpad(({day})::VARCHAR, 2, '0')) AS DATE) END")


def _flag(c: str) -> str:
    return (f"CASE WHEN lower(trim({c})) IN ('true', '1', 'yes') THEN 'true' "
            f"WHEN lower(trim({c})) IN ('false', '0', 'no') THEN 'false' END")


_WORDS = """CASE delivery_days WHEN 'Same Day' THEN '0' WHEN 'same day' THEN '0' WHEN 'Express' THEN '1' WHEN 'express' THEN '1'
  WHEN '15' THEN '1.5' ELSE delivery_days END"""
_RANGE = r"regexp_extract({w}, '(\d+)-(\d+)', {i})"
_DAYS = ("least(greatest(coalesce((TRY_CAST(" + _RANGE.format(w=_WORDS, i=1) + " AS DOUBLE) + TRY_CAST("
         + _RANGE.format(w=_WORDS, i=2) + r" AS DOUBLE)) / 2, TRY_CAST(regexp_extract(" + _WORDS
         + r", '(\d+)', 1) AS DOUBLE)), 0), 30)")
_DAYS = f"CASE WHEN delivery_days IS NOT NULL AND regexp_matches({_WORDS}, '\\d') THEN {_DAYS} END"
_RATING = r"TRY_CAST(regexp_extract(customer_rating, '\d+\.?\d*', 0) AS DOUBLE)"
_RATING = f"CASE WHEN {_RATING} <= 5 THEN {_RATING} END"
_MODES = """modes AS (SELECT category, coalesce(arg_min(customer_age_group, (-w, customer_age_group))
    FILTER (WHERE customer_age_group IS NOT NULL), 'Unknown') AS mode
  FROM (SELECT category, customer_age_group, count(*) AS w FROM raw_sales WHERE category IS NOT NULL GROUP BY ALL) GROUP BY category),
  filled AS (SELECT r.* EXCLUDE (customer_age_group), CASE WHEN category IS NOT NULL THEN coalesce(customer_age_group, mode) END
    AS customer_age_group FROM raw_sales r LEFT JOIN modes USING (category))"""
_ERR = "coalesce(lower(brand) = 'noise' AND lower(subcategory) = 'smart watch' AND discounted_price_inr > 10000, false)"
_PRICE_COLS = ["original_price_inr", "discounted_price_inr", "subtotal_inr", "final_amount_inr"]
_CAPPED = ["original_price_inr", "discounted_price_inr", "final_amount_inr"]


def _fixed(source: str) -> str:
    cols = ", ".join(f"CASE WHEN {_ERR} THEN {c} / 10 ELSE {c} END AS {c}" for c in _PRICE_COLS)
    return f"fixed AS (SELECT * EXCLUDE ({', '.join(_PRICE_COLS)}), {cols} FROM {source})"


def _q(c: str, p: float, source: str) -> str:
    return f"(SELECT quantile_cont({c}, {p}) FROM {source})"


def _cap(c: str, source: str) -> str:
    q1, q3 = _q(c, 0.25, source), _q(c, 0.75, source)
    return f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {q1} - 1.5 * ({q3} - {q1})), {q3} + 1.5 * ({q3} - {q1})) END"


_PIPE = _PRICES.replace("FROM raw_sales", "FROM filled") + f""",
  deduped AS (SELECT * REPLACE (replace(transaction_id, '_DUP', '') AS transaction_id) FROM priced
    QUALIFY row_number() OVER (PARTITION BY replace(transaction_id, '_DUP', '') ORDER BY l_shipdate, l_partkey, l_suppkey) = 1),
  parsed AS (SELECT * REPLACE ({_DAYS} AS delivery_days, {_RATING} AS customer_rating) FROM deduped), """ + _fixed("parsed")

SQL = {
    "q_clean_city": on_raw(f"SELECT transaction_id, customer_city AS raw_value, {_CITIES} AS customer_city FROM raw_sales"),
    "q_clean_category": on_raw(f"SELECT transaction_id, category AS raw_value, {_CATEGORIES} AS category FROM raw_sales"),
    "q_clean_product_name": on_raw(f"SELECT transaction_id, product_name AS raw_value, {_NAME} AS product_name FROM raw_sales"),
    "q_clean_dates": on_raw(f"SELECT transaction_id, order_date AS raw_value, {_date()} AS order_date FROM raw_sales"),
    "q_clean_dates_iso": on_raw(f"SELECT transaction_id, order_date AS raw_value, {_date(False)} AS order_date FROM raw_sales"),
    "q_clean_price": on_raw(f"""
SELECT transaction_id, original_price_inr AS raw_value, round({_PRICE}, 6) AS original_price_inr FROM raw_sales"""),
    "q_clean_flags": on_raw("SELECT transaction_id, " + ", ".join(
        f"{_flag(c)} AS {c}" for c in ("is_prime_member", "is_festival_sale", "is_prime_eligible")) + " FROM raw_sales"),
    "q_clean_delivery": on_raw(f"days AS (SELECT transaction_id, {_DAYS} AS d FROM raw_sales)", """
SELECT transaction_id, CAST(trunc(coalesce(d, (SELECT quantile_cont(d, 0.5) FROM days))) AS INTEGER) AS delivery_days FROM days"""),
    "q_clean_rating": on_raw(f"ratings AS (SELECT transaction_id, {_RATING} AS r FROM raw_sales)", """
SELECT transaction_id, round(coalesce(r, (SELECT quantile_cont(r, 0.5) FROM ratings)), 6) AS customer_rating FROM ratings"""),
    "q_fill_mode": on_raw(_MODES, "SELECT transaction_id, category, customer_age_group FROM filled"),
    "q_fill_festival": on_raw("SELECT transaction_id, coalesce(festival_name, 'No Festival') AS festival_name FROM raw_sales"),
    "q_dedup": on_raw("""
SELECT replace(transaction_id, '_DUP', '') AS transaction_id, l_shipdate, l_partkey, l_suppkey, product_name, customer_city,
  round(l_quantity, 6) AS l_quantity FROM raw_sales
QUALIFY row_number() OVER (PARTITION BY replace(raw_sales.transaction_id, '_DUP', '') ORDER BY l_shipdate, l_partkey, l_suppkey) = 1"""),
    "q_scale_fix": on_raw(_PRICES, _fixed("priced"), "SELECT transaction_id, brand, subcategory, " + ", ".join(
        f"round({c}, 8) AS {c}" for c in _PRICE_COLS) + " FROM fixed"),
    "q_scale_fix_count": on_raw(_PRICES, f"SELECT count(*) FILTER (WHERE {_ERR}) AS n_fixed FROM priced"),
    "q_iqr_bounds": on_raw(_PRICES, "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", round({_q(c, .25, 'priced')}, 8) AS q1, round({_q(c, .75, 'priced')}, 8) AS q3,
  round({_q(c, .25, 'priced')} - 1.5 * ({_q(c, .75, 'priced')} - {_q(c, .25, 'priced')}), 8) AS lower,
  round({_q(c, .75, 'priced')} + 1.5 * ({_q(c, .75, 'priced')} - {_q(c, .25, 'priced')}), 8) AS upper""" for c in _CAPPED)),
    "q_cap_iqr": on_raw(_PRICES, "SELECT transaction_id, " + ", ".join(
        f"round({_cap(c, 'priced')}, 8) AS {c}" for c in _CAPPED) + " FROM priced"),
    "q_clean_pipeline": on_raw(_MODES, _PIPE, f"""
SELECT transaction_id, {_date()} AS order_date, customer_id, product_id, {_NAME} AS product_name, {_CATEGORIES} AS category,
  brand, subcategory, {_CITIES} AS customer_city, customer_age_group,
  CAST(trunc(coalesce(delivery_days, (SELECT quantile_cont(delivery_days, 0.5) FROM parsed))) AS INTEGER) AS delivery_days,
  round(coalesce(customer_rating, (SELECT quantile_cont(customer_rating, 0.5) FROM parsed)), 8) AS customer_rating,
  {_flag('is_prime_member')} AS is_prime_member, {_flag('is_festival_sale')} AS is_festival_sale,
  {_flag('is_prime_eligible')} AS is_prime_eligible, coalesce(festival_name, 'No Festival') AS festival_name, l_partkey, l_suppkey,
  {', '.join(f"round({_cap(c, 'fixed')}, 8) AS {c}" for c in _CAPPED)}, round(subtotal_inr, 8) AS subtotal_inr FROM fixed"""),
}
