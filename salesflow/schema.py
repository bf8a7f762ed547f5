"""The canonical sales schema and plan-time column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_S, _D, _L, _I, _B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()

CLEAN_SCHEMA = T.StructType([
    T.StructField(name, dtype)
    for name, dtype in [
        ("transaction_id", _S),
        ("order_date", T.DateType()),
        ("customer_id", _S),
        ("product_id", _S),
        ("product_name", _S),
        ("category", _S),
        ("subcategory", _S),
        ("brand", _S),
        ("original_price_inr", _D),
        ("discount_percent", _D),
        ("discounted_price_inr", _D),
        ("quantity", _L),
        ("subtotal_inr", _D),
        ("delivery_charges", _D),
        ("final_amount_inr", _D),
        ("customer_city", _S),
        ("customer_state", _S),
        ("customer_tier", _S),
        ("customer_spending_tier", _S),
        ("customer_age_group", _S),
        ("payment_method", _S),
        ("delivery_type", _S),
        ("is_prime_member", _B),
        ("is_festival_sale", _B),
        ("festival_name", _S),
        ("customer_rating", _D),
        ("return_status", _S),
        ("order_month", _I),
        ("order_year", _I),
        ("order_quarter", _I),
        ("product_weight_kg", _D),
        ("is_prime_eligible", _B),
        ("product_rating", _D),
        ("delivery_days", _I),
    ]
])


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise if any of ``cols`` is absent."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def detect_column(df: DataFrame, part: str) -> str:
    """First column whose name contains ``part``, ignoring case."""
    for c in df.columns:
        if part.lower() in c.lower():
            return c
    raise ValueError(f"no column name contains {part!r}")
