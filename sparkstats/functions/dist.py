"""Distribution functions.

Driver scalars (normal, t, F, chi-square tails from the regularised incomplete
beta / gamma functions, by the continued fractions and series of the NIST
Digital Library of Mathematical Functions, 8.7.1, 8.9.2 and 8.17.22) for the
handful of test statistics that reach the driver, and Spark Column forms of the
normal CDF, its logarithm and its inverse so per-row work stays inside codegen.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOLERANCE = 4e-16
_DEEPEST = 1 << 23


# ---------------------------------------------------------------------------
# Driver scalars
# ---------------------------------------------------------------------------

def _settled(fraction: Callable[[int], float]) -> float:
    """Limit of a continued fraction given by its truncations: the depth doubles
    until two values agree; a fraction that never settles raises."""
    depth, last = 32, math.nan
    while depth <= _DEEPEST:
        value = fraction(depth)
        if abs(value - last) <= _TOLERANCE * abs(value):
            return value
        last, depth = value, 2 * depth
    raise ArithmeticError("the continued fraction did not settle")


def _log_gamma_ratio(a: float, b: float) -> float:
    """ln(Gamma(a + b) / Gamma(a)) for b > 0, without cancellation for large a."""
    if a < 1e3:
        return math.lgamma(a + b) - math.lgamma(a)

    def correction(z: float) -> float:  # Stirling's series after its first terms
        return 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5)

    return ((a - 0.5) * math.log1p(b / a) - b + b * math.log(a + b)
            + correction(a + b) - correction(a))


def betainc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta I_x(a, b); ``y`` is 1 - x where the caller
    knows it more exactly."""
    y = 1.0 - x if y is None else y
    if x <= 0:
        return 0.0
    if y <= 0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - betainc(b, a, y, x)
    large, small = max(a, b), min(a, b)
    log_beta = math.lgamma(small) - _log_gamma_ratio(large, small)
    log_x = math.log(x) if x < 0.5 else math.log1p(-y)
    log_y = math.log(y) if y < 0.5 else math.log1p(-x)

    def fraction(depth: int) -> float:
        value = 0.0
        for k in range(depth, 0, -1):
            m = k // 2
            top = m * (b - m) if k % 2 == 0 else -(a + m) * (a + b + m)
            value = top * x / ((a + k - 1) * (a + k)) / (1.0 + value)
        return 1.0 / (1.0 + value)

    return math.exp(a * log_x + b * log_y - log_beta) / a * _settled(fraction)


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:  # the lower function's power series
        term = total = 1.0 / a
        k = 0
        while term > total * _TOLERANCE:
            k += 1
            term *= x / (a + k)
            total += term
        return max(0.0, 1.0 - total * math.exp(log_front))

    def fraction(depth: int) -> float:
        value = x
        for k in range(depth, 0, -1):
            value = x + (k - a) / (1.0 + k / value)
        return 1.0 / value

    return math.exp(log_front) * _settled(fraction)


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    """Inverse normal CDF (Wichura, AS 241, PPND16)."""
    return _ppnd16(p, math)


def t_sf2(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    return betainc(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


def chi2_sf(x: float, k: float) -> float:
    return gammainc_upper(k / 2.0, x / 2.0)


# ---------------------------------------------------------------------------
# AS 241 coefficients (published algorithm constants; fixed values)
# ---------------------------------------------------------------------------
_A = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
      1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
      3.3430575583588128105e4, 2.5090809287301226727e3]
_B = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
      2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
      5.2264952788528545610e3]
_C = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
      3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
      2.27238449892691845833e-2, 7.74545014278341407640e-4]
_D = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
      1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
      1.05075007164441684324e-9]
_E = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
      2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
      2.71155556874348757815e-5, 2.01033439929228813265e-7]
_F = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
      7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
      2.04426310338993978564e-15]


def _poly(coefs, x):
    acc = coefs[-1]
    for c in reversed(coefs[:-1]):
        acc = acc * x + c
    return acc


def _ppnd16(p, m):
    q = p - 0.5
    if abs(q) <= 0.425:
        r = 0.180625 - q * q
        return q * _poly(_A, r) / _poly(_B, r)
    r = p if q < 0 else 1.0 - p
    r = m.sqrt(-m.log(r))
    if r <= 5.0:
        r -= 1.6
        val = _poly(_C, r) / _poly(_D, r)
    else:
        r -= 5.0
        val = _poly(_E, r) / _poly(_F, r)
    return -val if q < 0 else val


def norm_ppf_col(p) -> Column:
    """Inverse normal CDF as a Spark expression (AS 241, about 1e-16 relative)."""
    p = F.col(p) if isinstance(p, str) else p
    q = p - 0.5
    r1 = F.lit(0.180625) - q * q
    central = q * _poly(_A, r1) / _poly(_B, r1)
    rr = F.sqrt(-F.log(F.least(p, 1.0 - p)))
    lo = rr - 1.6
    hi = rr - 5.0
    tail = F.when(rr <= 5.0, _poly(_C, lo) / _poly(_D, lo)).otherwise(
        _poly(_E, hi) / _poly(_F, hi))
    return F.when(F.abs(q) <= 0.425, central).otherwise(
        F.when(q < 0, -tail).otherwise(tail))


# West (2005) double-precision rendering of Hart's algorithm 5666 (fixed values).
_HART_N = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
           112.079291497871, 221.213596169931, 220.206867912376]
_HART_D = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
           296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def norm_cdf_col(z) -> Column:
    """Standard normal CDF as a Spark expression (Hart / West, ~1e-15)."""
    z = F.col(z) if isinstance(z, str) else z
    x = F.abs(z)
    e = F.exp(-x * x / 2.0)
    num = _poly(list(reversed(_HART_N)), x)
    den = _poly(list(reversed(_HART_D)), x)
    small = e * num / den
    b = x + 1.0 / (x + 2.0 / (x + 3.0 / (x + 4.0 / (x + 0.65))))
    large = e / b / 2.506628274631
    tail = F.when(x > 37, F.lit(0.0)).when(x < 7.07106781186547, small).otherwise(large)
    return F.when(z > 0, 1.0 - tail).otherwise(tail)


def norm_log_cdf_col(z) -> Column:
    """ln of the standard normal CDF as a Spark expression, to full precision in
    both tails: below -30 by the asymptotic series of Mills' ratio, above 0 as
    log1p of the other tail. ``norm_log_cdf_col(-z)`` is the log survival."""
    z = F.col(z) if isinstance(z, str) else z
    r = 1.0 / (z * z)
    mills = F.lit(0.0)
    for c in (-2027025.0, 135135.0, -10395.0, 945.0, -105.0, 15.0, -3.0, 1.0):  # double factorials of odd numbers, signs in turn
        mills = (mills + c) * r
    far = -z * z / 2.0 - F.log(-z) - 0.5 * math.log(2 * math.pi) + F.log1p(-mills)
    return F.when(z < -30.0, far).when(z > 0.0, F.log1p(-norm_cdf_col(-z))).otherwise(F.log(norm_cdf_col(z)))
