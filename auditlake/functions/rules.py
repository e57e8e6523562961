"""Row-level classification rules as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import schema as S
from auditlake.functions.parsing import nan_to_null

Thresholds = Mapping[str, Mapping[str, float]]


def site_of(workplace: Column, sites: Mapping[str, str] = S.SITES) -> Column:
    """Short site name; unknown and missing codes are the 'other' site.

    The lookup is a literal map: ten entries need no join.
    """
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(sites.items())])
    return F.coalesce(F.try_element_at(lookup, workplace), F.lit(S.OTHER_SITE))


def complete_thresholds(
    thresholds: Thresholds = S.THRESHOLDS, findings: Sequence[str] = S.FINDING_FIELDS
) -> dict[str, dict[str, float]]:
    """Each site's overrides over the defaults; unknown findings and non-numbers are refused."""
    for site, rule in thresholds.items():
        for finding, limit in rule.items():
            if finding not in findings:
                raise ValueError(f"unknown finding in thresholds of {site}: {finding}")
            if isinstance(limit, bool) or not isinstance(limit, (int, float)):
                raise ValueError(f"threshold of {finding} at {site} is not a number: {limit!r}")
    base = thresholds["default"]
    return {site: {**base, **rule} for site, rule in thresholds.items()}


def threshold_table(spark: SparkSession, thresholds: Thresholds = S.THRESHOLDS) -> DataFrame:
    """The completed rules as rows ``(site, finding, threshold)`` for every known site."""
    full = complete_thresholds(thresholds)
    rows = [
        (site, finding, float(limit))
        for site in S.SITE_NAMES
        for finding, limit in full.get(site, full["default"]).items()
    ]
    return spark.createDataFrame(rows, "site string, finding string, threshold double")


def predict(
    site: Column, scores: Mapping[str, Column] | None = None, thresholds: Thresholds = S.THRESHOLDS
) -> Column:
    """1 if any score lies strictly above its threshold at that site, else 0.

    A missing or NaN score never fires. Only findings whose threshold differs between sites
    need the site at all, so the others compare with a literal.
    """
    full = complete_thresholds(thresholds)
    scores = scores or {f: F.col(f) for f in S.FINDING_FIELDS}
    default = full["default"]
    fired = []
    for finding, score in scores.items():
        if finding not in default and not any(finding in rule for rule in full.values()):
            continue
        limit = F.lit(float(default[finding])) if finding in default else F.lit(None).cast("double")
        for name, rule in full.items():
            if name not in ("default", S.OTHER_SITE) and rule.get(finding) != default.get(finding):
                limit = F.when(site == name, float(rule[finding])).otherwise(limit)
        fired.append(F.coalesce(nan_to_null(score.cast("double")) > limit, F.lit(False)))
    return reduce(lambda a, b: a | b, fired).cast("int")


def label_from_grade(grade: Column, cutoff: int = 1, failed_as_zero: bool = False) -> Column:
    """1 above the cutoff. A missing grade stays unlabelled unless it is to count as grade 0."""
    label = F.when(grade > cutoff, 1).when(grade.isNotNull(), 0)
    return F.coalesce(label, F.lit(0)) if failed_as_zero else label


def confusion_cell(label: Column, prediction: Column) -> Column:
    return (
        F.when((label == 1) & (prediction == 1), "TP")
        .when((label == 0) & (prediction == 0), "TN")
        .when((label == 0) & (prediction == 1), "FP")
        .when((label == 1) & (prediction == 0), "FN")
    )


def top_finding(scores: Mapping[str, Column], positive_only: bool = False) -> Column:
    """``struct(finding, score)`` of the highest score; the first wins a tie.

    With ``positive_only`` a record without a score above zero gives ``('', 0)``.
    """
    clean = {name: nan_to_null(c.cast("double")) for name, c in scores.items()}
    best = F.greatest(*clean.values()) if len(clean) > 1 else next(iter(clean.values()))
    name = F.coalesce(*[F.when(c == best, F.lit(n)) for n, c in clean.items()])
    if not positive_only:
        return F.struct(name.alias("finding"), best.alias("score"))
    positive = best > 0
    return F.struct(
        F.when(positive, name).otherwise("").alias("finding"),
        F.when(positive, best).otherwise(0.0).alias("score"),
    )


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def decision_seconds(priority: Column, end: Column, flag: Column, turnaround_minutes: Column) -> Column:
    """Routine studies: exam end to flag. All others, also without priority: report turnaround."""
    return F.when(priority == S.ROUTINE_PRIORITY, seconds_between(end, flag)).otherwise(
        turnaround_minutes.cast("double") * 60
    )


def end_to_end_seconds(priority: Column, end: Column, flag: Column) -> Column:
    """0 for urgent studies, exam end to flag for all others, also without priority."""
    return F.when(priority == S.URGENT_PRIORITY, 0.0).otherwise(seconds_between(end, flag))


def in_band(value: Column, lower: Column, upper: Column) -> Column:
    return value.between(lower, upper)
