"""Statistics as column expressions over small sets of counts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion_ratios(tp: Column, tn: Column, fp: Column, fn: Column) -> dict[str, Column]:
    total = tp + tn + fp + fn
    sensitivity, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return {
        "n": total,
        "accuracy": ratio(tp + tn, total),
        "sensitivity": sensitivity,
        "specificity": specificity,
        "ppv": ratio(tp, tp + fp),
        "npv": ratio(tn, tn + fn),
        "balanced_accuracy": (sensitivity + specificity) / 2,
        "pct_normal": ratio(tn + fn, total) * 100,
    }


def kappa(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Cohen's kappa of two raters; 0 without data or where chance agreement is certain."""
    n = tp + tn + fp + fn
    observed = ratio(tp + tn, n)
    expected = ratio(tp + fp, n) * ratio(tp + fn, n) + ratio(tn + fn, n) * ratio(tn + fp, n)
    return F.when((n > 0) & (expected < 1), (observed - expected) / (1 - expected)).otherwise(0.0)


def _stirling_error(x: Column) -> Column:
    """ln(x!) minus Stirling's formula: exact below 15, a series of error < 1e-15 from there."""
    exact = (
        F.log(F.factorial(F.least(x, F.lit(15.0)).cast("int")).cast("double"))
        - (x + 0.5) * F.log(x) + x - 0.5 * math.log(2 * math.pi)
    )
    y = x * x
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - (1 / 1188) / y) / y) / y) / y) / x
    return F.when(x <= 15, exact).otherwise(series)


def _half_binomial_pmf(k: Column, n: Column) -> Column:
    """P(X = k) for X ~ Binomial(n, 1/2), stable for counts of any size."""
    rest = n - k
    deviance = k * F.log(2 * k / n) + rest * F.log(2 * rest / n)
    body = F.exp(_stirling_error(n) - _stirling_error(k) - _stirling_error(rest) - deviance)
    inner = body * F.sqrt(n / (F.lit(2 * math.pi) * k * rest))
    return F.when(k == 0, F.exp(-n * math.log(2))).otherwise(inner)


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p-value, capped at 1; 1 without discordant pairs.

    The tail sums the largest term downwards. Terms fall off within a few standard deviations,
    so ``50 + 5 sqrt(n)`` of them hold the whole sum to double precision, and the cost does not
    grow with the counts themselves.
    """
    n = (b + c).cast("double")
    k = F.least(b, c).cast("double")
    steps = F.least(k, F.lit(50.0) + F.ceil(5 * F.sqrt(n))).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] * (k - j + 1) / (n - k + j)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    downwards = F.when(steps >= 1, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    tail = F.aggregate(downwards, start, add, lambda acc: acc["total"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * _half_binomial_pmf(k, n) * tail))
