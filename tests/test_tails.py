"""Tail probabilities against tables and against the densities, summed up numerically."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronlens.functions.tails import chi2_p_value, f_p_value, log_gamma


def f_tail(f, d1, d2):
    """Integral of the beta density; t = 1 - u^2 takes the pole at t = 1 away."""
    u = np.linspace(math.sqrt(d1 * f / (d2 + d1 * f)), 1, 400_001)
    a, b = d2 / 2, d1 / 2
    with np.errstate(divide="ignore"):
        density = np.exp(math.log(2) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (d1 - 1) * np.log(u) + (a - 1) * np.log1p(-u * u))
    density[-1] = 0 if a > 1 else density[-1]
    h = u[1] - u[0]
    return h / 3 * (density[0] + density[-1] + 4 * density[1:-1:2].sum() + 2 * density[2:-1:2].sum())


def test_tables(spark):
    rows = spark.createDataFrame([(4.1028, 2.0, 10.0), (1.0, 5.0, 5.0), (float("inf"), 2.0, 9.0), (None, 2.0, 9.0), (0.0, 2.0, 9.0), (float("nan"), 2.0, 9.0)], "f double, d1 double, d2 double")
    assert [r[0] for r in rows.select(f_p_value("f", "d1", "d2")).collect()] == pytest.approx([0.05, 0.5, 0.0, 1.0, 1.0, 1.0], abs=1e-5)
    rows = spark.createDataFrame([(5.991465, 2.0), (18.307038, 10.0), (None, 4.0), (0.0, 4.0), (9000.0, 6.0)], "x double, dof double")
    assert [r[0] for r in rows.select(chi2_p_value("x", "dof")).collect()] == pytest.approx([0.05, 0.05, 1.0, 1.0, 0.0], abs=1e-7)


def test_f_against_the_density(spark):
    cases = [(f, float(m), float(n)) for f in (0.01, 0.7, 1.3, 4.0, 30.0) for m in (1, 2, 5, 40) for n in (4, 37, 2000, 100_000)]
    rows = spark.createDataFrame(cases, "f double, d1 double, d2 double").select("*", f_p_value("f", "d1", "d2").alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(f_tail(r.f, r.d1, r.d2), rel=1e-6, abs=1e-9), r


def test_many_customers_do_not_exhaust_the_fraction(spark):
    """With a billion customers F x d1 follows chi-squared, here with two degrees of freedom."""
    p = spark.createDataFrame([(3.0, 2.0, 1e9)], "f double, d1 double, d2 double").select(f_p_value("f", "d1", "d2")).first()[0]
    assert p == pytest.approx(math.exp(-3.0), rel=1e-5)


def test_chi_squared_against_its_terms(spark):
    cases = [(x, 2.0 * s) for x in (0.3, 8.0, 60.0, 250.0) for s in (1, 2, 9, 100)]
    for r in spark.createDataFrame(cases, "x double, dof double").select("*", chi2_p_value("x", "dof").alias("p")).collect():
        terms = [math.exp(i * math.log(r.x / 2) - r.x / 2 - math.lgamma(i + 1)) for i in range(int(r.dof / 2))]
        assert r.p == pytest.approx(min(1.0, math.fsum(terms)), rel=1e-9, abs=1e-300)


def test_log_gamma(spark):
    values = [0.5, 1.0, 1.5, 3.0, 12.5, 1e4 + 0.5, 1e9]
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "z double").select(log_gamma(F.col("z"))).collect()]
    assert found == pytest.approx([math.lgamma(v) for v in values], rel=1e-12, abs=1e-12)
