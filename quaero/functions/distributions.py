"""Distribution functions on the driver: the JVM's commons-math3, and quadrature for the studentised range."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession


def _jvm(spark: SparkSession, name: str, *args: float):
    return getattr(spark._jvm.org.apache.commons.math3.distribution, name)(*args)


def t_quantile(spark: SparkSession, p: float, df: float) -> float:
    return float(_jvm(spark, "TDistribution", float(df)).inverseCumulativeProbability(float(p)))


def f_tail(spark: SparkSession, x: float, df1: float, df2: float) -> float:
    return 1.0 - float(_jvm(spark, "FDistribution", float(df1), float(df2)).cumulativeProbability(float(x)))


def chi2_tail(spark: SparkSession, x: float, df: float) -> float:
    return 1.0 - float(_jvm(spark, "ChiSquaredDistribution", float(df)).cumulativeProbability(float(x)))


def normal_tail_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def studentised_range_tail(q: float, k: int, df: float) -> float:
    """P(Q > q) of k means with df degrees of freedom, by a double trapezium rule."""
    import numpy as np

    if q <= 0:
        return 1.0
    phi = lambda x: np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    from math import erf

    cdf = np.vectorize(lambda x: 0.5 * (1 + erf(x / math.sqrt(2))))
    z = np.linspace(-8, 8, 801)
    pz, cz = phi(z), cdf(z)

    def of_range(w: float) -> float:
        return float(np.trapezoid(k * pz * (cdf(z + w) - cz) ** (k - 1), z))

    if df > 5000:
        return max(0.0, min(1.0, 1 - of_range(q)))
    s = np.linspace(max(1e-6, 1 - 8 / math.sqrt(2 * df)), 1 + 8 / math.sqrt(2 * df), 121)
    log = df / 2 * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2)
    dens = np.exp(log + (df - 1) * np.log(s) - df * s * s / 2)
    return max(0.0, min(1.0, 1 - float(np.trapezoid(dens * np.array([of_range(q * x) for x in s]), s))))


def studentised_range_quantile(p: float, k: int, df: float) -> float:
    """The q with P(Q > q) = 1 - p, by bisection."""
    lo, hi = 0.0, 100.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if studentised_range_tail(mid, k, df) > 1 - p else (lo, mid)
    return (lo + hi) / 2
