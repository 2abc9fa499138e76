import math

import pytest

from fairloom.functions.special import beta_binomial_interval, beta_i, beta_quantile, chi2_tail, f_tail


def test_tails_against_the_jvm(spark):
    d = spark._jvm.org.apache.commons.math3.distribution
    for k in (1, 2, 3, 8, 57):
        for x in (0.01, 0.7, 3.3, 20.0, 80.0):
            want = 1 - d.ChiSquaredDistribution(float(k)).cumulativeProbability(x)
            assert chi2_tail(x, k) == pytest.approx(want, rel=1e-8, abs=1e-13)
    for a, b in ((1, 5), (2, 197), (7, 33)):
        for x in (0.1, 1.0, 2.7, 9.0):
            assert f_tail(x, a, b) == pytest.approx(1 - d.FDistribution(float(a), float(b)).cumulativeProbability(x), rel=1e-8, abs=1e-13)
    for a, b in ((0.5, 2.0), (6.0, 1.5), (120.0, 300.0)):
        for p in (0.025, 0.5, 0.975):
            assert beta_quantile(a, b, p) == pytest.approx(d.BetaDistribution(a, b).inverseCumulativeProbability(p), rel=1e-6)
            assert beta_i(a, b, beta_quantile(a, b, p)) == pytest.approx(p, rel=1e-9)


def test_small_tails_keep_their_digits():
    assert chi2_tail(200.0, 2) == pytest.approx(math.exp(-100), rel=1e-10)
    assert f_tail(50.0, 2, 100) == pytest.approx((100 / (100 + 100)) ** 50, rel=1e-9)


def test_credible_intervals_rise_with_successes():
    lo = [beta_binomial_interval(k, 5) for k in (1, 3, 5)]
    assert lo[0][0] < lo[1][0] < lo[2][0] and lo[0][1] < lo[1][1] < lo[2][1]
    assert all(map(math.isnan, beta_binomial_interval(0, 0)))
