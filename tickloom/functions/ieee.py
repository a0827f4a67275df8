"""IEEE-754 arithmetic as Column expressions: what Spark's ANSI functions refuse or turn into null stays a number."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def nan() -> Column:
    return F.lit(NAN)


def finite(x) -> Column:
    x = _c(x)
    return ~F.isnan(x) & (F.abs(x) < INF)


def nn(x) -> Column:
    """The value, NaN as null: for aggregates that skip nulls."""
    x = _c(x)
    return F.when(~F.isnan(x), x)


def divide(a, b) -> Column:
    """a / b with signed infinities and NaN for a zero divisor."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def recip(x) -> Column:
    return divide(F.lit(1.0), x)


def _log(fn, x) -> Column:
    x = _c(x).cast("double")
    return F.when(x == 0, F.lit(-INF)).when(x < 0, nan()).otherwise(fn(x))


def log(x) -> Column:
    return _log(F.ln, x)


def log2(x) -> Column:
    return _log(F.log2, x)


def log10(x) -> Column:
    return _log(F.log10, x)


def exp(x) -> Column:
    return F.exp(_c(x))


def exp2(x) -> Column:
    return F.pow(F.lit(2.0), _c(x))


def sqrt(x) -> Column:
    return F.sqrt(_c(x))


def _whole(fn, x) -> Column:
    x = _c(x).cast("double")
    return F.when(F.abs(x) < 2.0**52, fn(x).cast("double")).otherwise(x)


def ceil(x) -> Column:
    return _whole(F.ceil, x)


def floor(x) -> Column:
    return _whole(F.floor, x)


def round_half_away(x) -> Column:
    return _whole(F.round, x)


def sign(x) -> Column:
    """NaN stays NaN; zero has the sign of its sign bit: +0 gives 1, -0 gives -1."""
    x = _c(x).cast("double")
    return F.when(F.isnan(x), x).when(x > 0, 1.0).when(x < 0, -1.0).otherwise(F.when(F.pow(x, F.lit(-1.0)) > 0, 1.0).otherwise(-1.0))


def minimum(a, b) -> Column:
    """The smaller; the other one if one is NaN."""
    return F.least(_c(a), _c(b))


def maximum(a, b) -> Column:
    """The larger; the other one if one is NaN."""
    a, b = _c(a), _c(b)
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def power(x, n: float) -> Column:
    return F.pow(_c(x), F.lit(float(n)))


def clamp(x, lo: float, hi: float) -> Column:
    """Between lo and hi; NaN becomes hi."""
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), _c(x)))


def fillna(x, value: float) -> Column:
    return F.nanvl(_c(x), F.lit(float(value)))


_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def saturating_cast(x, to: str, source: str = "double") -> Column:
    """Cast to an integer type: floats are truncated and saturate, NaN becomes 0; integers wrap around."""
    x = _c(x)
    if to not in _BITS:
        return x.cast(to)
    bits = _BITS[to]
    low, high = -(2 ** (bits - 1)), 2 ** (bits - 1) - 1
    if source in ("double", "float"):
        x = x.cast("double")
        return F.when(F.isnan(x), F.lit(0)).when(x >= float(high), F.lit(high)).when(x <= float(low), F.lit(low)).otherwise(x.cast("bigint")).cast(to)
    if bits == 64:
        return x.cast(to)
    x = x.cast("bigint").bitwiseAND(F.lit(2**bits - 1))
    return F.when(x > high, x - 2**bits).otherwise(x).cast(to)


#: Coefficients of Acklam's rational approximation to the inverse normal distribution function.
ACKLAM_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
ACKLAM_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]
ACKLAM_LOW = 0.02425


def _poly(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p) -> Column:
    """Inverse of the standard normal distribution function, to about 3e-9."""
    p = _c(p)

    def tail(q: Column) -> Column:
        r = F.sqrt(F.lit(-2.0) * F.ln(q))
        return _poly(ACKLAM_C, r) / _poly([*ACKLAM_D, 1.0], r)

    q = p - 0.5
    r = q * q
    middle = _poly(ACKLAM_A, r) * q / _poly([*ACKLAM_B, 1.0], r)
    return F.when(p < ACKLAM_LOW, tail(p)).when(p > 1 - ACKLAM_LOW, -tail(1 - p)).otherwise(middle)


UNARY = {"negate": lambda x: -_c(x), "log": log, "log2": log2, "log10": log10, "exp": exp, "exp2": exp2, "sqrt": sqrt, "ceil": ceil, "floor": floor, "round": round_half_away, "recip": recip, "abs": lambda x: F.abs(_c(x)), "sign": sign}
BINARY = {"add": lambda a, b: _c(a) + _c(b), "subtract": lambda a, b: _c(a) - _c(b), "multiply": lambda a, b: _c(a) * _c(b), "divide": divide, "min": minimum, "max": maximum}
