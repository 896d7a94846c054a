"""Column expressions for numeric helpers Spark has no built-in for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of the normal quantile (Abramowitz & Stegun 26.2.23).
PROBIT_NUM = (2.515517, 0.802853, 0.010328)
PROBIT_DEN = (1.0, 1.432788, 0.189269, 0.001308)
PROBIT_CLIP = 1e-6

# Normal distribution function to double precision (Hart's rational form).
HART_NUM = (
    220.206867912376,
    221.213596169931,
    112.079291497871,
    33.912866078383,
    6.37396220353165,
    0.700383064443688,
    0.0352624965998911,
)
HART_DEN = (
    440.413735824752,
    793.826512519948,
    637.333633378831,
    296.564248779674,
    86.7807322029461,
    16.064177579207,
    1.75566716318264,
    0.0883883476483184,
)
HART_LIMIT = 7.07106781186547
ROOT_TWO_PI = 2.506628274631


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL where den is 0 or NULL."""
    return num / F.nullif(den, F.lit(0.0))


def clip(x: Column, lo: float, hi: float) -> Column:
    """x limited to [lo, hi]; NULL stays NULL."""
    return F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x)


def poly(x: Column, coef: tuple[float, ...]) -> Column:
    """Polynomial with coefficients in rising order, by Horner's rule."""
    out = F.lit(coef[-1])
    for c in reversed(coef[:-1]):
        out = out * x + F.lit(c)
    return out


def probit(p: Column) -> Column:
    """Normal quantile of a probability, clipped away from 0 and 1."""

    def score(p):
        t = F.sqrt(-2.0 * F.ln(F.least(p, 1.0 - p)))
        z = let(t, lambda t: t - poly(t, PROBIT_NUM) / poly(t, PROBIT_DEN))
        return F.when(p < 0.5, -z).otherwise(z)

    return let(clip(p, PROBIT_CLIP, 1.0 - PROBIT_CLIP), score)


def normal_cdf(z: Column) -> Column:
    """Normal distribution function."""

    def upper(x):
        density = F.exp(-x * x / 2.0)
        near = density * poly(x, HART_NUM) / poly(x, HART_DEN)
        tail = x + 0.65
        for k in (4.0, 3.0, 2.0, 1.0):
            tail = x + F.lit(k) / tail
        return F.when(x < HART_LIMIT, near).otherwise(density / tail / ROOT_TWO_PI)

    return let(z, lambda z: let(let(F.abs(z), upper), lambda u: F.when(z > 0, 1.0 - u).otherwise(u)))


def tick_round(price: Column, tick: float) -> Column:
    """Price moved to the nearest tick, halves to even."""
    return F.rint(price / tick) * tick


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of k successes in n trials."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    scale = 1.0 + z * z / n
    centre = (p + z * z / (2.0 * n)) / scale
    half = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / scale
    return centre - half, centre + half


def hash_draw(*parts: Column | int | str) -> Column:
    """Deterministic 32-bit draw from the parts: first 8 hex digits of their md5."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_uniform(*parts: Column | int | str) -> Column:
    """Deterministic uniform number in [0, 1)."""
    return hash_draw(*parts) / F.lit(4294967296.0)


def nudge(digits: int) -> float:
    return float(f"3.7e-{digits + 4}")


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded for comparison: nudged off exact halves, with negative zero turned into zero."""
    return F.round(x + F.lit(nudge(digits)), digits) + F.lit(0.0)
