"""Check SQL: for each named query, the same result written for DuckDB."""

from oracle import cleaning, customer, discount, market, payment, product, profiling, revenue

ORACLES: dict[str, str] = {}
for _m in (revenue, discount, customer, product, payment, market, cleaning, profiling):
    ORACLES.update(_m.SQL)
