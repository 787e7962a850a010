"""Normal and Student-t distribution functions as column expressions, in the engine throughout."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import ColumnLike, c

# fixed values: rational approximation of the normal quantile, AS 241 (centre, middle, far tail)
_A = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
_B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
_C = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
_D = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
_E = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
_F = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)
# fixed values: Lanczos series of the gamma function, g = 7
_G = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def _polynomial(coefs: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, k: acc * x + F.lit(k), coefs[-2::-1], F.lit(coefs[-1]))


def _integral(f, top: Column) -> Column:
    """Integral of f from 0 to top by Gauss-Legendre nodes, which stand in the plan once."""
    grid = F.array(*(F.struct(F.lit(float(0.5 * (n + 1))).alias("n"), F.lit(float(0.5 * w)).alias("w")) for n, w in zip(_NODES, _WEIGHTS, strict=True)))
    return top * F.aggregate(grid, F.lit(0.0), lambda acc, g: acc + g["w"] * f(top * g["n"]))


def norm_ppf(p: ColumnLike) -> Column:
    """Quantile; NULL outside (0, 1)."""
    p = c(p)
    q = p - 0.5
    near = F.lit(0.180625) - q * q
    r = F.sqrt(-F.log(F.least(p, 1.0 - p)))
    tail = F.when(r <= 5.0, _polynomial(_C, r - 1.6) / _polynomial(_D, r - 1.6)).otherwise(_polynomial(_E, r - 5.0) / _polynomial(_F, r - 5.0))
    return F.when((p > 0.0) & (p < 1.0), F.when(F.abs(q) <= 0.425, q * _polynomial(_A, near) / _polynomial(_B, near)).otherwise(F.signum(q) * tail))


def norm_cdf(x: ColumnLike) -> Column:
    x = c(x)
    top = F.least(F.abs(x), F.lit(12.0))  # beyond that the tail is below 1e-32
    body = _integral(lambda v: F.exp(-0.5 * v * v), top) / float(np.sqrt(2 * np.pi))
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(x >= 0, 0.5 + body).otherwise(0.5 - body))


def norm_sf(x: ColumnLike) -> Column:
    return norm_cdf(-c(x))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x of at least one half."""
    z = x - 1.0
    series = reduce(lambda acc, k: acc + F.lit(_G[k]) / (z + float(k)), range(1, 9), F.lit(_G[0]))
    t = z + 7.5
    return F.lit(float(0.5 * np.log(2 * np.pi))) + (z + 0.5) * F.log(t) - t + F.log(series)


def _t_scale(df: Column) -> Column:
    return F.exp(log_gamma((df + 1.0) / 2.0) - log_gamma(df / 2.0)) / F.sqrt(F.lit(float(np.pi)))


def t_sf(t: ColumnLike, df: ColumnLike) -> Column:
    """Upper tail: P(0 < T < |t|) is the scaled integral of cos(a)^(df - 1) with t = sqrt(df) tan(a)."""
    t, df = c(t), c(df)
    body = _t_scale(df) * _integral(lambda a: F.pow(F.cos(a), df - 1.0), F.atan(F.abs(t) / F.sqrt(df)))
    return F.when(t.isNotNull() & (df >= 1.0), F.when(t >= 0, 0.5 - body).otherwise(0.5 + body))


def t_ppf(p: ColumnLike, df: ColumnLike) -> Column:
    """Quantile by Newton steps from the normal one; from that side they approach without overshooting."""
    p, df = c(p), c(df)

    def step(t: Column, _: Column) -> Column:
        density = _t_scale(df) / F.sqrt(df) * F.pow(1.0 + t * t / df, -(df + 1.0) / 2.0)
        return t + (t_sf(t, df) - (1.0 - p)) / density

    return F.when(df >= 1.0, F.aggregate(F.sequence(F.lit(1), F.lit(40)), norm_ppf(p), step))
