"""Statistical Column helpers."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col

# fixed values: coefficients of Acklam's rational approximation of the
# inverse normal CDF (published constants)
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]


def norm_ppf_scalar(p: float) -> float:
    """Driver-side scalar inverse normal CDF (``statistics.NormalDist``)."""
    return NormalDist().inv_cdf(p)


def _poly(coefs, x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + c
    return out


def norm_ppf(p) -> Column:
    """Vectorised inverse normal CDF as a Column expression (Acklam's
    approximation, relative error < 1.2e-9); NULL outside (0, 1)."""
    p = col(p).cast("double")
    low, high = 0.02425, 1 - 0.02425
    ql = F.sqrt(-2 * F.log(p))
    tail_lo = _poly(_C, ql) / (_poly(_D, ql) * ql + 1)
    q = p - 0.5
    r = q * q
    central = _poly(_A, r) * q / (_poly(_B, r) * r + 1)
    qh = F.sqrt(-2 * F.log(1 - p))
    tail_hi = -_poly(_C, qh) / (_poly(_D, qh) * qh + 1)
    return (F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
             .when(p < low, tail_lo).when(p <= high, central).otherwise(tail_hi))


def fixed1(x, sign: bool = False) -> Column:
    """One decimal, the double's exact value rounded half to even (as in C and
    Python; ``format_string`` rounds its shortest decimal text half up).

    Ten times x is taken exactly, as the rounded sum s / 2 of 8x and 2x and its
    rounding error e / 2.  A value of 2 ** 49 or more has no decimals to round.
    """
    x = col(x).cast("double")
    a = F.abs(x)
    big, small = a * 16, a * 4
    s = big + small
    e = (big - (s - (s - big))) + (small - (s - big))
    whole = F.floor(s / 2)
    part = s / 2 - whole
    up = (part > 0.5) | ((part == 0.5) & ((e > 0) | ((e == 0) & (whole % 2 == 1))))
    tenths = whole + up.cast("long")
    minus = x.cast("string").startswith("-")  # negative zero too
    text = F.concat(F.when(minus, "-").otherwise("+" if sign else ""), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(a < 2.0 ** 49, text).when(x.isNotNull(), F.format_string("%+.1f" if sign else "%.1f", x))


def human_number(x) -> Column:
    """T/B/M/K suffixed text with one decimal (e.g. 1.5B)."""
    x = col(x).cast("double")
    a = F.abs(x)
    return (F.when(a >= 1e12, F.concat(fixed1(x / 1e12), F.lit("T")))
             .when(a >= 1e9, F.concat(fixed1(x / 1e9), F.lit("B")))
             .when(a >= 1e6, F.concat(fixed1(x / 1e6), F.lit("M")))
             .when(a >= 1e3, F.concat(fixed1(x / 1e3), F.lit("K")))
             .when(x.isNotNull(), F.format_string("%.0f", F.rint(x))))


def pct_delta_text(current, previous) -> Column:
    """Signed percentage change text with (previous + 1e-8)."""
    c, p = col(current).cast("double"), col(previous).cast("double")
    return F.concat(fixed1((c - p) / (p + 1e-8) * 100, sign=True), F.lit("%"))
