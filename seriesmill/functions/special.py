"""Special functions as column expressions: digamma and the quantiles of Student's t."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the asymptotic series of digamma in 1 / x^2 (Bernoulli numbers over 2k).
_SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760)
#: Lanczos coefficients (g = 7) of the gamma function.
_LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)


def digamma(x: Column) -> Column:
    """The logarithmic derivative of the gamma function for ``x > 0``, to about 1e-14.

    Moves the argument up by eight and takes the asymptotic series there.
    """
    x = x.cast("double")
    far = x + 8
    square = F.lit(1.0) / (far * far)
    series = F.lit(0.0)
    for c in reversed(_SERIES):
        series = (series + F.lit(c)) * square
    back = F.lit(0.0)
    for k in range(8):
        back = back + F.lit(1.0) / (x + k)
    return F.ln(far) - F.lit(0.5) / far + series - back


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for ``x >= 0.5`` (Lanczos)."""
    total = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:]):
        total = total + F.lit(c) / (x + k)
    base = x + 6.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.ln(base) - base + F.ln(total)


def _beta_fraction(a: Column, b: Column, x: Column, terms: int) -> Column:
    """Continued fraction of the incomplete beta function, from the last term back to the first."""
    start = F.lit(1.0)

    def step(value: Column, k: Column) -> Column:
        # k counts down from terms to 1; odd and even terms alternate
        m = F.floor(k / 2).cast("double")
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return F.lit(1.0) + F.when(k % 2 == 1, odd).otherwise(even) / value

    return F.lit(1.0) / F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), start, step)


def incomplete_beta(a: Column, b: Column, x: Column, terms: int = 160) -> Column:
    """The regularised incomplete beta function; ``x`` in [0, 1], ``a`` and ``b`` at least a half."""
    a, b, x = (v.cast("double") for v in (a, b, x))
    safe = F.least(F.greatest(x, F.lit(1e-300)), F.lit(1.0 - 2.0**-53))
    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.ln(safe) + b * F.log1p(-safe))
    low = front * _beta_fraction(a, b, safe, terms) / a
    high = F.lit(1.0) - front * _beta_fraction(b, a, F.lit(1.0) - safe, terms) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(safe < (a + 1) / (a + b + 2), low).otherwise(high)


def t_quantile(p: float, freedom: Column) -> Column:
    """The ``p`` quantile of Student's t with ``freedom`` degrees of freedom (a column, at least 1); NULL below 1.

    One and two degrees have closed forms.  Others start from the normal quantile
    with two correction terms, which lies below the quantile, and take Newton steps
    on the distribution function; it is concave there, so every step comes nearer.
    """
    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")
    if p < 0.5:
        return -t_quantile(1 - p, freedom)
    n = freedom.cast("double")
    z = NormalDist().inv_cdf(p)
    start = F.lit(z) + F.lit((z**3 + z) / 4) / n
    constant = _log_gamma((n + 1) / 2) - _log_gamma(n / 2) - F.log(n * math.pi) / 2

    def step(t: Column, _: Column) -> Column:
        tail = incomplete_beta(n / 2, F.lit(0.5), n / (n + t * t)) / 2
        density = F.exp(constant - (n + 1) / 2 * F.log1p(t * t / n))
        return t + (tail - F.lit(1 - p)) / density

    searched = F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step)
    one, two = math.tan(math.pi * (p - 0.5)), (2 * p - 1) / math.sqrt(2 * p * (1 - p))
    return F.when(n == 1, one).when(n == 2, two).when(n > 2, searched)
