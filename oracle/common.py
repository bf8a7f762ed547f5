"""SQL text shared by several checks."""


def corr(x: str, y: str, digits: int = 6) -> str:
    """Correlation that is null, not NaN, where a side is constant."""
    x, y = f"CAST({x} AS DOUBLE)", f"CAST({y} AS DOUBLE)"
    return f"round(CASE WHEN isnan(corr({x}, {y})) THEN NULL ELSE corr({x}, {y}) END, {digits})"


def corr_rows(cols: list[str], source: str, group: str = "") -> str:
    """The long correlation matrix as one SELECT per cell."""
    head = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return "\nUNION ALL\n".join(
        f"SELECT {head}'{x}' AS col_x, '{y}' AS col_y, {corr(x, y)} AS corr FROM {source}{tail}" for x in cols for y in cols)


def regr(y: str, x: str) -> str:
    return (f"round(regr_slope({y}, {x}), 6) AS slope, round(regr_intercept({y}, {x}), 6) AS intercept, "
            f"round(regr_r2({y}, {x}), 6) AS r2, CAST(regr_count({y}, {x}) AS BIGINT) AS n")


def box(col: str) -> str:
    probs = {"min": 0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1}
    return ", ".join(f'round(quantile_cont(CAST({col} AS DOUBLE), {p}), 6) AS "{name}"' for name, p in probs.items())


def cut(col: str, edges: list, labels: list[str]) -> str:
    whens = []
    for lo, hi, label in zip(edges, edges[1:], labels):
        upper = "" if hi is None else f" AND {col} <= {hi}"
        whens.append(f"WHEN {col} > {lo}{upper} THEN '{label}'")
    return "CASE " + " ".join(whens) + " END"


def histogram_parts(source: str, col: str, bins: int, group: str = "", alias: str = "n", digits: int = 6) -> list[str]:
    head = f"{group}, " if group else ""
    return [f"span AS (SELECT min({col})::DOUBLE AS lo, max({col})::DOUBLE AS hi FROM {source})", f"""
SELECT {head}bin, round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / {bins}, {digits}) AS bin_lo,
  round(any_value(lo) + (bin + 1) * (any_value(hi) - any_value(lo)) / {bins}, {digits}) AS bin_hi, count(*) AS {alias}
FROM (SELECT {head}lo, hi, CAST(greatest(least(coalesce(floor(({col} - lo) / nullif((hi - lo) / {bins}, 0)), 0), {bins - 1}), 0)
  AS INTEGER) AS bin FROM {source}, span WHERE {col} IS NOT NULL) GROUP BY {head}bin"""]
