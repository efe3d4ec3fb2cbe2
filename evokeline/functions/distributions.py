"""Distribution functions: the normal one as a column expression, Student's t as an Arrow function."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The error function's polynomial 7.1.26 of Abramowitz and Stegun, absolute error about 1.5e-7.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / F.lit(math.sqrt(2))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF):
        poly = (poly + F.lit(a)) * t
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    return F.lit(0.5) * (F.lit(1.0) + F.when(z < 0, -erf).otherwise(erf))


# The normal quantile of Wichura (AS 241), rational in the middle and in the tails.
PROBIT_MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
PROBIT_TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)


def polynomial(c: Sequence[float], x: Column) -> Column:
    """c0 + c1 x + c2 x^2 + ..."""
    out = F.lit(float(c[-1]))
    for a in reversed(c[:-1]):
        out = out * x + F.lit(float(a))
    return out


def polynomial_sql(c: Sequence[float], x: str) -> str:
    out = f"{float(c[-1])!r}::DOUBLE"
    for a in reversed(c[:-1]):
        out = f"({out} * {x} + {float(a)!r}::DOUBLE)"
    return out


def probit(p: Column) -> Column:
    """The normal quantile, for p from 1e-10 to 1 - 1e-10."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p))) - 1.6
    middle = q * polynomial(PROBIT_MIDDLE[0], 0.180625 - q * q) / polynomial(PROBIT_MIDDLE[1], 0.180625 - q * q)
    return F.when(F.abs(q) <= 0.425, middle).otherwise(F.signum(q) * polynomial(PROBIT_TAIL[0], r) / polynomial(PROBIT_TAIL[1], r))


def probit_sql(p: str) -> str:
    q, r = f"({p} - 0.5e0)", f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6e0)"
    s = f"(0.180625e0 - {q} * {q})"
    return f"(CASE WHEN abs({q}) <= 0.425e0 THEN {q} * {polynomial_sql(PROBIT_MIDDLE[0], s)} / {polynomial_sql(PROBIT_MIDDLE[1], s)} ELSE sign({q}) * {polynomial_sql(PROBIT_TAIL[0], r)} / {polynomial_sql(PROBIT_TAIL[1], r)} END)"


def normal_cdf_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2e0))"
    t = f"(1e0 / (1e0 + {ERF_P}e0 * {x}))"
    poly = "0e0"
    for a in reversed(ERF):
        poly = f"(({poly} + {a}e0) * {t})"
    return f"(0.5e0 * (1e0 + CASE WHEN {z} < 0 THEN -1e0 ELSE 1e0 END * (1e0 - {poly} * exp(-{x} * {x}))))"


def tail(z: Column, alternative: str) -> Column:
    """The normal p-value of a statistic."""
    if alternative == "greater":
        return F.lit(1.0) - normal_cdf(z)
    if alternative == "less":
        return normal_cdf(z)
    return F.least(F.lit(1.0), 2 * (F.lit(1.0) - normal_cdf(F.abs(z))))


def tail_sql(z: str, alternative: str) -> str:
    return {"greater": f"(1e0 - {normal_cdf_sql(z)})", "less": normal_cdf_sql(z), "two-sided": f"least(1e0, 2 * (1e0 - {normal_cdf_sql(f'abs({z})')}))"}[alternative]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function by Stirling's series, after moving the argument up to 10 or more."""
    x = np.asarray(x, float)
    up = np.maximum(0, np.ceil(10 - x))
    shift = sum((np.where(up > k, np.log(np.where(up > k, x + k, 1.0)), 0.0) for k in range(int(up.max(initial=0)))), np.zeros_like(x))
    z = x + up
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction (modified Lentz), for arrays with 0 < x < 1."""
    turned = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    front = np.exp(a * np.log(x) + b * np.log1p(-x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a
    safe = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c, d = np.ones_like(x), 1.0 / safe(1.0 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 500):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 / safe(1.0 + numerator * d), safe(1.0 + numerator / c)
            value = value * c * d
        if np.all(np.abs(c * d - 1.0) < 1e-15):
            break
    return np.where(turned, 1.0 - front * value, front * value)


def t_sf(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) of Student's t; nothing known gives nothing."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    known = (df > 0) & ~np.isnan(t)
    out[known & np.isinf(t)] = np.where(t[known & np.isinf(t)] > 0, 0.0, 1.0)
    out[known & (t == 0)] = 0.5
    own = known & np.isfinite(t) & (t != 0)
    v, n = t[own], df[own]
    half = 0.5 * incomplete_beta(n / 2, np.full_like(n, 0.5), np.clip(n / (n + v * v), 1e-300, 1 - 1e-16))
    out[own] = np.where(v > 0, half, 1.0 - half)
    return out


@lru_cache(maxsize=4)
def t_tail(alternative: str):
    """An Arrow function (t, df) -> p."""
    side = {"greater": lambda t, n: t_sf(t, n), "less": lambda t, n: t_sf(-t, n), "two-sided": lambda t, n: np.minimum(1.0, 2 * t_sf(np.abs(t), n))}[alternative]

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        out = side(t.to_numpy(float), df.to_numpy(float))
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return p


def signed_rank_null(most: int) -> list[tuple[int, list[float]]]:
    """(n, P(W <= w) for w = 0, 1, ...) of the signed-rank statistic without ties, for n up to ``most``."""
    counts, out = np.array([1.0]), []
    for n in range(1, most + 1):
        grown = np.zeros(len(counts) + n)
        grown[: len(counts)] += counts
        grown[n:] += counts
        counts = grown / 2  # probabilities
        out.append((n, np.cumsum(counts).tolist()))
    return out


def rank_sum_null(most: int) -> list[tuple[int, int, list[float]]]:
    """(n1, n2, P(U <= u) for u = 0, 1, ...) of the rank-sum statistic without ties, for n1, n2 up to ``most``."""
    counts = {(a, b): np.array([1.0]) for a in range(most + 1) for b in range(most + 1) if a == 0 or b == 0}
    for a in range(1, most + 1):
        for b in range(1, most + 1):
            own = np.zeros(a * b + 1)
            own[b:] += counts[a - 1, b]  # the largest value is of the first sample: it beats all b
            own[: a * (b - 1) + 1] += counts[a, b - 1]
            counts[a, b] = own
    return [(a, b, (np.cumsum(c) / c.sum()).tolist()) for (a, b), c in counts.items() if a and b]
