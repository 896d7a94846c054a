"""SQL text for expressions that the Spark side builds from functions."""

from __future__ import annotations

from tradeloom.functions import maths
from tradeloom.operators.indicators import LOG_RANGE_SCALE, RANGE_SCALE


def dbl(x: float) -> str:
    return f"({x!r}::DOUBLE)"


def poly(x: str, coef) -> str:
    out = dbl(coef[-1])
    for c in reversed(coef[:-1]):
        out = f"({out} * {x} + {dbl(c)})"
    return out


def probit(p: str) -> str:
    raw, p = p, f"least(greatest({p}, {dbl(maths.PROBIT_CLIP)}), {dbl(1.0 - maths.PROBIT_CLIP)})"
    t = f"sqrt(-2.0::DOUBLE * ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1.0::DOUBLE - {p} END))"
    z = f"({t} - {poly(t, maths.PROBIT_NUM)} / {poly(t, maths.PROBIT_DEN)})"
    return f"(CASE WHEN {raw} IS NULL THEN NULL WHEN {p} < 0.5 THEN -{z} ELSE {z} END)"


def normal_cdf(z: str) -> str:
    x = f"abs({z})"
    density = f"exp(-{x} * {x} / 2.0::DOUBLE)"
    near = f"({density} * {poly(x, maths.HART_NUM)} / {poly(x, maths.HART_DEN)})"
    tail = f"({x} + 0.65::DOUBLE)"
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = f"({x} + {dbl(k)} / {tail})"
    far = f"({density} / {tail} / {dbl(maths.ROOT_TWO_PI)})"
    upper = f"(CASE WHEN {x} < {dbl(maths.HART_LIMIT)} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {z} > 0 THEN 1.0::DOUBLE - {upper} ELSE {upper} END)"


def w(n: int, ahead: int = 0) -> str:
    return f"(PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {n - 1} PRECEDING AND {ahead} FOLLOWING)"


def full(x: str, value: str, n: int) -> str:
    return f"(CASE WHEN count({x}) OVER {w(n)} = {n} THEN {value} END)"


def mean(x: str, n: int) -> str:
    return full(x, f"avg({x}) OVER {w(n)}", n)


def std(x: str, n: int) -> str:
    return full(x, f"stddev_pop({x}) OVER {w(n)}", n)


def zscore(x: str, n: int) -> str:
    return f"(CASE WHEN {std(x, n)} = 0 THEN 0.0::DOUBLE ELSE ({x} - {mean(x, n)}) / nullif({std(x, n)}, 0) END)"


def rank(x: str, n: int) -> str:
    seen = f"list({x}) OVER {w(n)}"
    lt = f"len(list_filter({seen}, lambda v: v < {x}))"
    eq = f"len(list_filter({seen}, lambda v: v = {x}))"
    return full(x, f"({lt} + ({eq} + 1) / 2.0::DOUBLE)", n)


RANGE_POINTS = f"(greatest(high - low, 0) * {dbl(RANGE_SCALE)})"
RANGE_LOG = f"(CASE WHEN low > 0 AND high >= low THEN ln(high / low) / {dbl(LOG_RANGE_SCALE)} END)"

SERIES = """, s AS MATERIALIZED (
  SELECT *, (high + low + close) / 3.0::DOUBLE AS tp,
    ln(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx), 0)) AS ret,
    greatest(high - low, abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx)),
             abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx))) AS tr
  FROM session_bars)"""


def ema_cte(name: str, span: int) -> str:
    """Recursive exponential mean of close over bars."""
    a = 2.0 / (span + 1.0)
    return f""", {name} AS (
  SELECT symbol, bar_idx, close AS y FROM bars WHERE bar_idx = 0
  UNION ALL
  SELECT b.symbol, b.bar_idx, {dbl(a)} * b.close + {dbl(1.0 - a)} * e.y
  FROM {name} e JOIN bars b ON b.symbol = e.symbol AND b.bar_idx = e.bar_idx + 1)"""


EMA_PAIR = ema_cte("ef", 8) + ema_cte("es", 21) + """, pair AS MATERIALIZED (
  SELECT s.*, ef.y AS ema_fast, es.y AS ema_slow,
    ef.y > es.y AS above, coalesce(lag(ef.y > es.y) OVER (PARTITION BY symbol ORDER BY bar_idx), false) AS was
  FROM s JOIN ef USING (symbol, bar_idx) JOIN es USING (symbol, bar_idx))"""


def r6(x: str, digits: int = 6) -> str:
    """The same rounding as ``tidy``."""
    return f"round(({x}) + {maths.nudge(digits)!r}, {digits}) + 0.0"
