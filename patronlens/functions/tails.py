"""Upper tail probabilities of the F and chi-squared distributions as column expressions.

No table and no Python function: log-gamma is its asymptotic series moved eight places up, the
incomplete beta function is its continued fraction, folded over a sequence whose length grows
with the root of the larger parameter, and chi-squared with an even number of degrees of
freedom is a finite Poisson sum in log space.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def _bound(values: dict[str, Column], use: Callable[[Column], Column]) -> Column:
    """`use` on a struct of the values, each evaluated once."""
    return F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), use)[0]


def log_gamma(z: Column) -> Column:
    """Natural logarithm of gamma for z > 0, to about 12 digits."""
    rising = z
    for i in range(1, 8):
        rising = rising * (z + i)
    s = z + 8
    series = (s - 0.5) * F.ln(s) - s + 0.5 * math.log(2 * math.pi) + 1 / (12 * s) - 1 / (360 * s * s * s) + 1 / (1260 * F.pow(s, 5)) - 1 / (1680 * F.pow(s, 7)) + 1 / (1188 * F.pow(s, 9))
    return series - F.ln(rising)


def _away_from_zero(value: Column) -> Column:
    return F.when(F.abs(value) < _TINY, _TINY).otherwise(value)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """Lentz's evaluation of the continued fraction, one coefficient at a time."""

    def coefficient(j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(j % 2 == 0, even).otherwise(odd)

    def step(state: Column, j: Column) -> Column:
        def moved(s: Column) -> Column:
            return F.struct(s["c"].alias("c"), s["d"].alias("d"), (state["total"] * s["c"] * s["d"]).alias("total"))

        own = coefficient(j)
        return _bound({"c": _away_from_zero(1 + own / state["c"]), "d": 1 / _away_from_zero(1 + own * state["d"])}, moved)

    first = 1 / _away_from_zero(1 - (a + b) * x / (a + 1))
    steps = F.sequence(F.lit(2), (F.lit(100) + 10 * F.ceil(F.sqrt(F.greatest(a, b)))).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("total")), step, lambda s: s["total"])


def _beta(x: Column, rest: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta at x, with `rest` = 1 - x given exactly; the shorter side's fraction is used."""

    def value(own: Column) -> Column:
        p, q, u, v = own["p"], own["q"], own["u"], own["v"]
        front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.ln(u) + q * F.ln(v)) / p
        part = front * _fraction(u, p, q)
        return F.when(own["turned"], 1 - part).otherwise(part)

    turned = x > (a + 1) / (a + b + 2)
    pick = lambda yes, no: F.when(turned, yes).otherwise(no)
    inside = _bound({"turned": turned, "p": pick(b, a), "q": pick(a, b), "u": pick(rest, x), "v": pick(x, rest)}, value)
    return F.when(x <= 0, 0.0).when(rest <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside)))


def f_p_value(statistic: str, d1: str, d2: str) -> Column:
    """Probability of at least this F; 1 where there is none, 0 for an infinite one."""
    f, m, n = F.col(statistic), F.col(d1).cast("double"), F.col(d2).cast("double")
    whole = n + m * f
    inside = _beta(n / whole, m * f / whole, n / 2, m / 2)
    return F.when(f.isNull() | F.isnan(f), 1.0).when(f == float("inf"), 0.0).when(f <= 0, 1.0).otherwise(inside)


def chi2_p_value(statistic: str, dof: str) -> Column:
    """Probability of at least this chi-squared for an even number of degrees of freedom; 1 where there is none."""
    x = F.col(statistic)
    y, terms = x / 2, (F.col(dof) / 2).cast("int")
    begin = F.struct((-y).alias("log"), F.exp(-y).alias("total"))

    def step(state: Column, i: Column) -> Column:
        return _bound({"log": state["log"] + F.ln(y) - F.ln(i)}, lambda s: F.struct(s["log"].alias("log"), (state["total"] + F.exp(s["log"])).alias("total")))

    more = F.when(terms > 1, F.sequence(F.lit(1), F.greatest(terms - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.when(x.isNull() | F.isnan(x) | (x <= 0), 1.0).otherwise(F.least(F.lit(1.0), F.aggregate(more, begin, step, lambda s: s["total"])))
