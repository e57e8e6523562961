"""Turnaround-time statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import schema as S
from auditlake.functions import rules
from auditlake.functions.parsing import format_duration, format_minutes, nan_to_null
from auditlake.operators import ordering as O

QUARTILES = {"p25": (1, 4), "median": (2, 4), "p75": (3, 4)}
TAILS = {"p5": (1, 20), "p95": (19, 20)}


def with_times(
    df: DataFrame, priority: str = "ai_priority", end: str = "procedure_end_date",
    flag: str = "ai_flag_received_date", turnaround: str = "report_turn_around_minutes",
) -> DataFrame:
    p, e, f = F.col(priority), F.col(end), F.col(flag)
    return df.withColumns(
        {
            "time_to_clinical_decision_seconds": rules.decision_seconds(p, e, f, F.col(turnaround)),
            "time_end_to_end_seconds": rules.end_to_end_seconds(p, e, f),
        }
    )


def unpivot_times(
    df: DataFrame, tcd: str = "time_to_clinical_decision_seconds", tee: str = "time_end_to_end_seconds",
    by: list[str] | None = None,
) -> DataFrame:
    """Rows ``(by, metric, seconds)``: every decision time, and the end-to-end times above 0."""
    by = by or []
    decision, whole = (nan_to_null(F.col(c).cast("double")) for c in (tcd, tee))
    pairs = F.array(
        F.struct(F.lit("tcd").alias("metric"), decision.alias("seconds")),
        F.struct(F.lit("tee").alias("metric"), F.when(whole > 0, whole).alias("seconds")),
    )
    return df.select(*by, F.inline(pairs)).where(F.col("seconds").isNotNull())


def time_stats(
    df: DataFrame, value: str = "seconds", by: list[str] | None = None, few_groups: bool = True
) -> DataFrame:
    """Count, mean, exclusive quantiles, range, late count and count at or above P95 per group."""
    by = ["metric"] if by is None else by
    cuts = {**QUARTILES, **TAILS}
    picked = O.pick_ranks(
        df, by, value, O.exclusive_ranks(list(cuts.values())),
        {"more_than_5_min": F.col(value) > S.LATE_SECONDS}, few_groups,
    )
    total, picks = F.col("total"), F.col("picks")
    points = {name: O.exclusive_cut(i, n, total, picks) for name, (i, n) in cuts.items()}
    return picked.select(
        *by,
        total.alias("count"),
        (F.col("sum") / total).alias("mean"),
        *[points[name].alias(name) for name in ("p5", "p25", "median", "p75", "p95")],
        F.col("min"),
        F.col("max"),
        "more_than_5_min",
        O.count_at_least(*TAILS["p95"], points["p95"], total, picks).alias("above_p95"),
    )


def time_stats_text(stats: DataFrame) -> DataFrame:
    return stats.withColumns({f"{c}_fmt": format_duration(F.col(c)) for c in ("mean", "median", "p25", "p75")})


def time_summary(
    df: DataFrame, tcd: str = "time_to_clinical_decision_seconds", tee: str = "time_end_to_end_seconds"
) -> DataFrame:
    """Mean, median, deviation and range per metric, and the share later than five minutes.

    Here end-to-end times of 0 are left out but negative ones are kept. The share is taken of
    all studies; ``note`` replaces the end-to-end figures in print where no study is late.
    """
    decision, whole = (nan_to_null(F.col(c).cast("double")) for c in (tcd, tee))
    pairs = F.array(
        F.struct(F.lit("tcd").alias("metric"), decision.alias("seconds")),
        F.struct(F.lit("tee").alias("metric"), F.when(whole != 0, whole).alias("seconds")),
    )
    rows = df.select(F.inline(pairs))
    late = F.col("seconds") > S.LATE_SECONDS
    medians = O.pick_ranks(rows, ["metric"], "seconds", O.median_ranks, few_groups=True).select(
        "metric", O.median(F.col("total"), F.col("picks")).alias("median")
    )
    basic = rows.groupBy("metric").agg(
        F.count("*").alias("studies"),
        F.count("seconds").alias("n"),
        F.avg("seconds").alias("mean"),
        F.stddev_samp("seconds").alias("std"),
        F.min("seconds").alias("min"),
        F.max("seconds").alias("max"),
        F.count_if(late).alias("late"),
        F.count_if(F.col("seconds") < 0).alias("negative"),
    )
    out = basic.join(F.broadcast(medians), "metric", "left")
    return out.select(
        "metric", "studies", "n", "mean", "median", "std", "min", "max", "late", "negative",
        (F.try_divide("late", "studies") * 100).alias("late_pct"),
        F.when(
            F.col("late") == 0,
            F.concat(F.lit("All "), F.col("studies").cast("string"), F.lit(" cases processed within 5 minutes")),
        ).alias("note"),
        format_minutes(F.col("mean")).alias("mean_text"),
    )


def _beyond(value: str) -> Column:
    """Outside the whiskers; NaN, which compares as the largest number, is no value at all."""
    v = nan_to_null(F.col(value).cast("double"))
    return (v < F.col("whisker_low")) | (v > F.col("whisker_high"))


def box_plot_stats(
    df: DataFrame, value: str = "seconds", by: list[str] | None = None, few_groups: bool = True
) -> DataFrame:
    """Nearest-rank quartiles, whisker ends clamped to the data, and the number of outliers."""
    by = ["metric"] if by is None else by

    def rank(p: float, total):
        return (F.floor(total * p) + 1).cast("bigint")

    points = {"q1": 0.25, "med": 0.5, "q3": 0.75}
    picked = O.pick_ranks(
        df, by, value, lambda total: F.array(*[rank(p, total) for p in points.values()]), few_groups=few_groups
    )
    at = {name: F.element_at("picks", rank(p, F.col("total")))["value"] for name, p in points.items()}
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    box = picked.select(
        *by, F.col("total").alias("n"), *[c.alias(name) for name, c in at.items()], "min", "max"
    ).withColumns(
        {
            "whisker_low": F.greatest(F.col("min"), F.col("q1") - reach),
            "whisker_high": F.least(F.col("max"), F.col("q3") + reach),
        }
    )
    fences = box.select(*by, "whisker_low", "whisker_high")
    outside = (
        df.select(*by, value)
        .join(F.broadcast(fences) if few_groups else fences, by)
        .where(_beyond(value))
        .groupBy(*by)
        .agg(F.count("*").alias("outliers"))
    )
    return box.join(outside, by, "left").na.fill(0, ["outliers"])


def outliers(df: DataFrame, box: DataFrame, by: list[str], value: str = "seconds") -> DataFrame:
    """The rows beyond the whiskers of their group's box (groups from a fixed small domain)."""
    fences = F.broadcast(box.select(*by, "whisker_low", "whisker_high"))
    return (
        df.join(fences, by)
        .where(_beyond(value))
        .drop("whisker_low", "whisker_high")
    )
