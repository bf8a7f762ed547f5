"""The ``sales`` and ``raw_sales`` views over a lineitem/orders/customer/part star.

Both are wide (one row per line item). The caller names the columns it needs and only the tables
behind them are joined, since Catalyst prunes unused columns but not unused inner joins. The keys
are foreign keys: every line item has its order, part and customer. Dimensions are joined to their
own fact first (customer to orders, part to lineitem), and the two facts meet on the order key
last, so a heavy customer or product never sits on the partitioning that an aggregation reuses.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.operators.skew import skew_join
from salesflow.session import Scratch, materialize_buckets

_PRICE = "l_extendedprice / l_quantity"
_AMOUNT = "l_extendedprice * (1 - l_discount)"
_FESTIVAL = """case
    when month(o_orderdate) = 10 and day(o_orderdate) between 20 and 24 then 'Diwali Sale'
    when month(o_orderdate) = 7 and day(o_orderdate) between 15 and 16 then 'Prime Day'
    when month(o_orderdate) = 3 and day(o_orderdate) between 8 and 10 then 'Holi Festival'
    when month(o_orderdate) = 8 and day(o_orderdate) = 15 then 'Independence Day'
    when month(o_orderdate) = 1 and day(o_orderdate) = 1 then 'New Year'
    when month(o_orderdate) = 11 and day(o_orderdate) between 24 and 28 then 'Black Friday'
    end"""

# column -> (SQL expression, tables it needs besides lineitem)
SALES = {
    "transaction_id": ("concat_ws('_', cast(l_orderkey as string), cast(l_linenumber as string), "
                       "cast(l_partkey as string), cast(l_suppkey as string))", ""),
    "order_date": ("o_orderdate", "orders"),
    "customer_id": ("o_custkey", "orders"),
    "product_id": ("l_partkey", ""),
    "product_name": ("p_name", "part"),
    "category": ("split_part(p_name, ' ', 2)", "part"),
    "subcategory": ("p_type", "part"),
    "brand": ("p_brand", "part"),
    "original_price_inr": (_PRICE, ""),
    "discount_percent": ("l_discount * 100", ""),
    "discounted_price_inr": (f"{_PRICE} * (1 - l_discount)", ""),
    "quantity": ("cast(l_quantity as bigint)", ""),
    "subtotal_inr": (_AMOUNT, ""),
    "delivery_charges": (f"{_AMOUNT} * l_tax", ""),
    "final_amount_inr": (f"{_AMOUNT} * (1 + l_tax)", ""),
    "customer_city": ("n_name", "nation"),
    "customer_state": ("r_name", "region"),
    "customer_tier": ("case n_nationkey % 4 when 0 then 'Metro' when 1 then 'Tier1' when 2 then 'Tier2' "
                      "else 'Rural' end", "nation"),
    "customer_spending_tier": ("case when c_acctbal < 2000 then 'Budget' when c_acctbal < 6000 then 'Standard' "
                               "else 'Premium' end", "customer"),
    "customer_age_group": ("case c_mktsegment when 'AUTOMOBILE' then '18-25' when 'BUILDING' then '26-35' "
                           "when 'FURNITURE' then '36-45' when 'HOUSEHOLD' then '46-55' else '55+' end", "customer"),
    "payment_method": ("o_orderpriority", "orders"),
    "delivery_type": ("l_linestatus", ""),
    "is_prime_member": ("c_acctbal >= 4000", "customer"),
    "is_festival_sale": (f"({_FESTIVAL}) is not null", "orders"),
    "festival_name": (_FESTIVAL, "orders"),
    "customer_rating": ("case when l_linenumber = 7 then null "
                        "else cast(1 + ((l_partkey + l_suppkey) % 9) / 2 as double) end", ""),
    "return_status": ("case l_returnflag when 'R' then 'Returned' when 'A' then 'Delivered' else 'Cancelled' end", ""),
    "order_year": ("year(o_orderdate)", "orders"),
    "order_month": ("month(o_orderdate)", "orders"),
    "order_quarter": ("quarter(o_orderdate)", "orders"),
    "order_month_name": ("date_format(o_orderdate, 'MMMM')", "orders"),
    "product_weight_kg": ("p_size / 10", "part"),
    "product_rating": ("cast(1 + (p_size % 9) / 2 as double)", "part"),
    "is_prime_eligible": ("p_retailprice > 950", "part"),
    "delivery_days": ("abs(datediff(l_shipdate, o_orderdate)) % 8", "orders"),
}

_K = "(l_orderkey * 7 + l_linenumber * 3 + l_partkey + l_suppkey)"
_YY = "cast(year(o_orderdate) as string)"
_MM = "lpad(cast(month(o_orderdate) as string), 2, '0')"
_DD = "lpad(cast(day(o_orderdate) as string), 2, '0')"
_PP = "cast(cast(floor(l_extendedprice / l_quantity) as bigint) as string)"


def _pick(mod: int, values: list[str]) -> str:
    """One of ``values`` by ``k % mod``."""
    whens = " ".join(f"when {i} then {v}" for i, v in enumerate(values))
    return f"case {_K} % {mod} {whens} end"


# The same dirty text in every engine: only functions with equal meaning are used.
RAW_SALES = {
    "transaction_id": (f"concat('TXN', cast(l_orderkey as string), '_', cast(l_linenumber as string), "
                       f"case when {_K} % 5 = 0 then '_DUP' else '' end)", ""),
    "order_date": (_pick(6, [
        f"concat({_YY}, '-', {_MM}, '-', {_DD})", f"concat({_DD}, '/', {_MM}, '/', {_YY})",
        f"concat(' ', {_DD}, '-', {_MM}, '-', {_YY}, ' ')", f"concat({_DD}, '.', {_MM}, '.', {_YY})",
        "'not a date'", "null"]), "orders"),
    "customer_id": ("o_custkey", "orders"),
    "product_id": ("l_partkey", ""),
    "product_name": (f"case when {_K} % 3 = 0 then upper(p_name) else p_name end", "part"),
    "category": (_pick(5, ["'electronics'", "'ELECTRONICSS'", "' Electronics & accessories '", "'books'", "null"]), ""),
    "brand": (f"case when {_K} % 11 = 0 then 'Noise' else p_brand end", "part"),
    "subcategory": (f"case when {_K} % 11 = 0 then 'Smart Watch' else p_type end", "part"),
    "original_price_inr": (_pick(4, [
        f"concat('₹', {_PP}, '.50')", f"concat({_PP}, '.50 INR')", f"concat('₹ ', {_PP}, '/-')", _PP]), ""),
    "customer_city": (_pick(7, ["' bengaluru '", "'DELHI NCR'", "'bombay'", "'Chenai'", "'calcutta'",
                                "lower(n_name)", "null"]), "nation"),
    "customer_age_group": (f"case when {_K} % 6 = 0 then null else c_mktsegment end", "customer"),
    "delivery_days": (_pick(9, ["'Same Day'", "'express'", "'15'", "'2-5 days'", "'-1'", "'45'", "null",
                                "'3 days'", "'7'"]), ""),
    "customer_rating": (_pick(7, ["'4 stars'", "'3/5'", "'4.5/5.0'", "'8'", "null", "'5'", "'2.5'"]), ""),
    "is_prime_member": (_pick(8, ["'Yes'", "'no'", "'1'", "'0'", "'TRUE'", "'false'", "null", "'maybe'"]), ""),
    "is_festival_sale": (f"case when ({_FESTIVAL}) is not null then 'Yes' else 'False' end", "orders"),
    "is_prime_eligible": ("case when p_retailprice > 950 then '1' else 'no' end", "part"),
    "festival_name": (_FESTIVAL, "orders"),
    "l_shipdate": ("l_shipdate", ""),
    "l_partkey": ("l_partkey", ""),
    "l_suppkey": ("l_suppkey", ""),
    "l_quantity": ("l_quantity", ""),
    "l_discount": ("l_discount", ""),
}

# declared, so that opening a table starts no schema-inference job
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
}
VIEWS = {"sales": SALES, "raw_sales": RAW_SALES}
_NEEDS = {"": set(), "part": {"part"}, "orders": {"orders"}, "customer": {"orders", "customer"},
          "nation": {"orders", "customer", "nation"}, "region": {"orders", "customer", "nation", "region"}}


def view(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None, heavy_share: float | None = None,
         within: Scratch | None = None) -> DataFrame:
    """``sales`` or ``raw_sales`` with ``columns`` (all by default).

    With ``heavy_share`` products and customers that hold at least this share of their fact's rows are joined apart from the
    others (see ``operators.skew``), so that the plan does not need AQE to split them.

    With ``within`` the line items and their parts are stored there, in buckets by order, instead of being shuffled to their
    orders: that takes less than half the disk, and the shuffle to the parts is gone by then. The caller closes ``within``
    when nothing reads the view any more.

    The session setting ``salesflow.view.spread`` names a number of partitions to spread the line
    items over. Set it only where the table is one small file with a single row group, which Spark
    reads in one task; it is unset by default, and large tables need no such exchange.
    """
    spec = VIEWS[name]
    columns = columns or list(spec)
    tables = set().union(*(_NEEDS[spec[c][1]] for c in columns))

    def read(table: str) -> DataFrame:
        return spark.read.schema(TABLES[table]).parquet(f"{sf_dir}/{table}.parquet")

    lines = read("lineitem")
    spread = spark.conf.get("salesflow.view.spread", None)
    if spread:
        used = set(re.findall(r"\bl_\w+", " ".join(spec[c][0] for c in columns)))
        used |= {"l_orderkey"} | ({"l_partkey"} if "part" in tables else set())
        lines = lines.select(*sorted(used)).repartition(int(spread), "l_orderkey")
    def meet(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
        if heavy_share:
            return skew_join(fact, dim, fact_key, dim_key, heavy_share)
        return fact.join(dim, F.col(fact_key) == F.col(dim_key))

    if "part" in tables:
        lines = meet(lines, read("part"), "l_partkey", "p_partkey")
    if within and "orders" in tables:
        used = set(re.findall(r"\b[lp]_\w+", " ".join(spec[c][0] for c in columns))) | {"l_orderkey"}
        lines = materialize_buckets(lines.select(*sorted(used)).where("l_orderkey is not null"), "l_orderkey", within)
    if "orders" in tables:
        # one date per order, not one per line item
        orders = read("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
        if "customer" in tables:
            customers = read("customer")
            if "nation" in tables:
                nations = read("nation")
                if "region" in tables:
                    nations = nations.join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
                customers = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
            orders = meet(orders, customers, "o_custkey", "c_custkey")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(*[F.expr(spec[c][0]).alias(c) for c in columns])
