"""Numeric formulas of the refresh schedule and of the final score
(R1-R3, R5, R8, M13, M14, M16). Plain column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the period curve and of the survival curve.
MEDIAN_PERIOD_B = 6.0     # period (weeks) at the median, in the b parameter
MAX_PERIOD_B = 36.0       # period at the maximum, in the b parameter
MEDIAN_PERIOD_A = 8.0     # period at the median, in the a parameter
YEAR_WEIGHT, POPULARITY_WEIGHT = 2.0, 1.0
SURVIVAL_SHAPE, SURVIVAL_POWER, SURVIVAL_SCALE = 0.6, 0.8, 3.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def curve_b(median_feature, max_feature, median_period=MEDIAN_PERIOD_B, max_period=MAX_PERIOD_B) -> Column:
    """b = ln(ln(max_period)/ln(median_period)) / ln(max_feature/median_feature)."""
    return (F.lit(math.log(math.log(max_period) / math.log(median_period)))
            / F.log(_c(max_feature) / _c(median_feature)))


def curve_a(median_feature, b, median_period=MEDIAN_PERIOD_A) -> Column:
    """a = ln(median_period) / median_feature^b."""
    return F.lit(math.log(median_period)) / F.pow(_c(median_feature), _c(b))


def period_score(x, a, b) -> Column:
    """R2: exp(a * x^b); x below 0 (a year past the maximum) is clamped at 0."""
    return F.exp(_c(a) * F.pow(F.greatest(_c(x), F.lit(0.0)), _c(b)))


def combined_period(year_score, pop_score, wy=YEAR_WEIGHT, wp=POPULARITY_WEIGHT) -> Column:
    """Weighted geometric mean of the two scores (weeks)."""
    return F.exp((F.lit(wy) * F.log(_c(year_score)) + F.lit(wp) * F.log(_c(pop_score))) / F.lit(wy + wp))


def unit_draw(seed: int, *cols) -> Column:
    """Repeatable uniform draw in (0, 1) from a hash of the row's identity:
    the same row gets the same draw on any partitioning or task retry."""
    h = F.xxhash64(F.lit(seed), *[_c(c) for c in cols])
    return (F.pmod(h, F.lit(1 << 40)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 40))


def weibull_jitter(u, shape) -> Column:
    """Weibull(shape) draw from uniform ``u``, divided by its median
    ln(2)^(1/shape) so the jitter's median is 1."""
    k = F.lit(float(shape)) if not isinstance(shape, Column) else shape
    return F.pow(-F.log(F.lit(1.0) - _c(u)), F.lit(1.0) / k) / F.pow(F.lit(math.log(2.0)), F.lit(1.0) / k)


def exponential_gap(u, mean_seconds) -> Column:
    """Exponential draw with the given mean (seconds)."""
    return -F.log(F.lit(1.0) - _c(u)) * _c(mean_seconds)


def survival(x, shape=SURVIVAL_SHAPE, power=SURVIVAL_POWER, scale=SURVIVAL_SCALE) -> Column:
    """S(x) = exp(-((x^power)/scale)^shape); a future date (x < 0) is
    clamped to age 0, so S = 1."""
    xx = F.greatest(_c(x), F.lit(0.0))
    return F.exp(-F.pow(F.pow(xx, F.lit(power)) / F.lit(scale), F.lit(shape)))


def seeit(seen_probability, years_since_release) -> Column:
    """(seen_probability * S^3)^(1/4)."""
    return F.pow(_c(seen_probability) * F.pow(survival(years_since_release), F.lit(3.0)), F.lit(0.25))


def final_score(pred_seeit, pred_rating) -> Column:
    """(pred_seeit * (pred_rating/100)^3)^(1/4) * 100."""
    return F.pow(_c(pred_seeit) * F.pow(_c(pred_rating) / F.lit(100.0), F.lit(3.0)), F.lit(0.25)) * F.lit(100.0)
