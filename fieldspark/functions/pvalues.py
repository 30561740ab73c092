"""Tail probabilities as Column expressions, for test statistics that are one row per test."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the Lanczos approximation to the gamma function (g = 7, n = 9).
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
    -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6,
    1.5056327351493116e-7,
)


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal: series near zero, continued fraction in the tail."""
    a = F.abs(z)
    x = a / math.sqrt(2.0)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)), F.struct(x.alias("t"), x.alias("s")),
        lambda acc, k: F.struct(
            (acc["t"] * -1.0 * x * x / k).alias("t"),
            (acc["s"] + acc["t"] * -1.0 * x * x / k / (2 * k + 1)).alias("s")),
        lambda acc: acc["s"] * (2.0 / math.sqrt(math.pi)))
    fraction = F.aggregate(
        F.reverse(F.sequence(F.lit(1), F.lit(120))), a,
        lambda acc, k: a + k / acc)
    tail = F.exp(-a * a / 2.0) / math.sqrt(2.0 * math.pi) / fraction
    upper = F.when(a < 2.5, 0.5 * (1.0 - series)).otherwise(tail)
    return F.when(z >= 0, upper).otherwise(1.0 - upper)


def log_gamma(x: Column) -> Column:
    """ln gamma for x >= 0.5."""
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        total = total + c / (x - 1.0 + i)
    t = x - 1.0 + 7.5
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * F.ln(t) - t + F.ln(total)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta by its continued fraction, evaluated from the tail inwards."""
    def fraction(p: Column, q: Column, y: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            return 1.0 + even / (1.0 + odd / acc)
        inner = F.aggregate(F.reverse(F.sequence(F.lit(1), F.lit(200))), F.lit(1.0), step)
        return 1.0 + (-(p + q) * y / (p + 1)) / inner

    log_front = (log_gamma(a + b) - log_gamma(a) - log_gamma(b)
                 + a * F.ln(x) + b * F.ln(1.0 - x))
    front = F.exp(log_front)
    direct = front / a / fraction(a, b, x)
    mirrored = 1.0 - front / b / fraction(b, a, 1.0 - x)
    return (F.when(x <= 0, 0.0).when(x >= 1, 1.0)
             .when(x < (a + 1) / (a + b + 2), direct).otherwise(mirrored))


def student_t_two_sided(t: Column, df: Column) -> Column:
    return incomplete_beta(df / 2.0, F.lit(0.5), df / (df + t * t))


def correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided p value of a (rank) correlation from n pairs."""
    df = n - 2.0
    t = rho * F.sqrt(F.try_divide(df, (1.0 - rho) * (1.0 + rho)))
    return F.when(F.abs(rho) >= 1, 0.0).otherwise(student_t_two_sided(t, df))


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of the F distribution."""
    return incomplete_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_sf(h: Column, df: Column) -> Column:
    """Upper tail of chi-square for an even number of degrees of freedom, else by F's limit.

    Even degrees have the closed form exp(-h/2) * sum (h/2)^k / k!. Odd degrees fold the
    same sum over half-integers from the normal tail.
    """
    half = h / 2.0
    even = F.exp(-half) * F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.floor(df / 2).cast("int"), F.lit(1))),
        F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda acc, k: F.struct((acc["t"] * half / k).alias("t"), (acc["s"] + acc["t"]).alias("s")),
        lambda acc: acc["s"])
    steps = F.floor((df - 1) / 2).cast("int")
    odd = 2.0 * normal_sf(F.sqrt(h)) + F.when(steps < 1, 0.0).otherwise(
        F.aggregate(
            F.sequence(F.lit(1), F.greatest(steps, F.lit(1))),
            F.struct((2.0 * F.exp(-half) * F.sqrt(half / math.pi)).alias("t"),
                     F.lit(0.0).alias("s")),
            lambda acc, k: F.struct((acc["t"] * half / (k + 0.5)).alias("t"),
                                    (acc["s"] + acc["t"]).alias("s")),
            lambda acc: acc["s"]))
    return F.when(F.pmod(df, F.lit(2)) == 0, even).otherwise(odd)
