"""Aggregates of predictions p against ratings y. All are single pass with partial sums, ignore null and NaN, and give
null where they are not defined (no rows, one row, no variance) instead of failing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sensegauge.workers import reach


def clean(x: Column) -> Column:
    """NaN as null: NaN is above every number in Spark and would pass ``> 95``."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def both(p: Column, y: Column) -> tuple[Column, Column]:
    p, y = clean(p), clean(y)
    return F.when(y.isNotNull(), p), F.when(p.isNotNull(), y)


def rounded(x: Column) -> Column:
    """To the nearest integer, halves to even."""
    return F.bround(clean(x))


def pearson(p: Column, y: Column) -> Column:
    p, y = both(p, y)
    return F.try_divide(F.covar_pop(p, y), F.stddev_pop(p) * F.stddev_pop(y))


def r2(p: Column, y: Column) -> Column:
    """1 - residual over total sum of squares: not the square of the correlation; may be negative."""
    p, y = both(p, y)
    return 1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))


def rmse(p: Column, y: Column) -> Column:
    p, y = both(p, y)
    return F.sqrt(F.avg((p - y) * (p - y)))


def mean(p: Column) -> Column:
    return F.avg(clean(p))


def stdev(p: Column, population: bool = False) -> Column:
    """Of the sample for metrics and across runs; of the population for the model's predictions."""
    return (F.stddev_pop if population else F.stddev_samp)(clean(p))


def share(test: Column) -> Column:
    """Percentage of rows that pass, of those for which the test is not null."""
    return F.avg(test.cast("double")) * 100


#: Threshold tests, strict after rounding.
ABOVE = {"ratio_95": lambda s: rounded(s) > 95, "ratio_99": lambda s: rounded(s) > 99, "ratio_equals": lambda s: rounded(s) == 100}
BELOW = {"ratio_5": lambda s: rounded(s) < 5, "ratio_1": lambda s: rounded(s) < 1, "ratio_equals": lambda s: rounded(s) == 0}


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def pearson_p(r: float | None, n: int | None) -> float | None:
    """Two-sided p-value of a correlation r of n pairs: Student's t with n - 2 degrees of freedom."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return None
    return beta_cdf((n - 2) / 2, 0.5, max(0.0, 1 - r * r)) if abs(r) < 1 else 0.0


def pearson_pvalue(r: Column, n: Column) -> Column:
    """For aggregated rows: correlation and count of pairs."""

    reach()

    @F.pandas_udf("double")
    def of(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([pearson_p(None if pd.isna(a) else float(a), None if pd.isna(b) else int(b)) for a, b in zip(r, n, strict=True)], dtype="float64")

    return of(r, n)


def pairs(p: Column, y: Column) -> Column:
    p, y = both(p, y)
    return F.count(p)
