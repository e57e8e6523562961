"""Weekly trends and the control band of the latest week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake import schema as S
from auditlake.functions import rules
from auditlake.operators.confusion import cell_counts, with_ratios


def week_start(ts: Column) -> Column:
    """Monday of the ISO week."""
    return F.date_trunc("week", ts).cast("date")


def week_label(week: Column) -> Column:
    return F.date_format(week, "dd MMM")


def weekly_site_metrics(
    df: DataFrame, label: str, prediction: str, ts: str = "procedure_start_date", site: str = "site"
) -> DataFrame:
    """Sensitivity and specificity (%) per week and site on a dense grid.

    A cell is null without positives (negatives) that week. Rows after the first aggregation
    number weeks x sites, and a week holds at most as many sites as exist, so the grid is made
    from one small array per week.
    """
    counts = (
        df.where(F.col(ts).isNotNull())
        .groupBy(week_start(F.col(ts)).alias("week"), F.col(site).alias("site"))
        .agg(*cell_counts(label, prediction))
    )
    m = with_ratios(counts).select(
        "week", "site",
        F.struct(
            F.when(F.col("tp") + F.col("fn") > 0, F.col("sensitivity") * 100).alias("sensitivity"),
            F.when(F.col("tn") + F.col("fp") > 0, F.col("specificity") * 100).alias("specificity"),
        ).alias("m"),
    )
    # The only unpartitioned step: one row per calendar week, each with a set of site names.
    weeks = m.groupBy("week").agg(F.map_from_entries(F.collect_list(F.struct("site", "m"))).alias("by_site"))
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    all_sites = F.array_distinct(F.flatten(F.collect_list(F.map_keys("by_site")).over(everything)))
    return (
        weeks.withColumn("sites", all_sites)
        .select("week", "by_site", F.explode("sites").alias("site"))
        .select(
            "week",
            week_label(F.col("week")).alias("week_label"),
            "site",
            F.try_element_at("by_site", F.col("site"))["sensitivity"].alias("sensitivity"),
            F.try_element_at("by_site", F.col("site"))["specificity"].alias("specificity"),
        )
    )


def weekly_balanced_accuracy(
    df: DataFrame, label: str, prediction: str, ts: str = "procedure_start_date"
) -> DataFrame:
    """Balanced accuracy per week in percent (1 decimal), null in weeks without labelled rows."""
    counts = (
        df.where(F.col(ts).isNotNull())
        .groupBy(week_start(F.col(ts)).alias("week"))
        .agg(*cell_counts(label, prediction))
    )
    value = F.when(F.col("n") > 0, F.round(F.col("balanced_accuracy") * 100, 1))
    return with_ratios(counts).select("week", week_label(F.col("week")).alias("week_label"), value.alias("value"))


def control_band(weekly: DataFrame) -> DataFrame:
    """95 % band over all weeks but the last, and whether the last week lies inside.

    One row. The band needs two weeks and two baseline values, else it and ``in_band`` are null.
    All aggregates run over one row per week in a single pass: the last week's share is
    subtracted from the totals.
    """
    last = F.max_by(F.struct("week", "week_label", "value"), "week")
    sums = weekly.agg(
        last.alias("last"),
        F.collect_list(F.struct("week", "value")).alias("weeks"),
    )
    base = F.filter("weeks", lambda w: w["value"].isNotNull() & (w["week"] < F.col("last.week")))
    values = F.transform(base, lambda w: w["value"])
    k = F.size("base")
    mean = F.aggregate("base", F.lit(0.0), lambda a, x: a + x) / k
    spread = F.aggregate("base", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    half = 1.96 * F.sqrt(spread / (k - 1)) / F.sqrt(k.cast("double"))
    enough = k >= 2
    return (
        sums.withColumn("base", values)
        .withColumn("mean", F.when(enough, mean))
        .withColumn("half", F.when(enough, half))
        .select(
            F.col("last.week").alias("last_week"),
            F.col("last.week_label").alias("last_week_label"),
            F.col("last.value").alias("last_value"),
            F.round(F.col("mean") - F.col("half"), 1).alias("lower"),
            F.round(F.col("mean") + F.col("half"), 1).alias("upper"),
        )
        .withColumn("in_band", rules.in_band(F.col("last_value"), F.col("lower"), F.col("upper")))
    )


def period_summary(
    df: DataFrame, ts: str = "procedure_start_date", procedure_code: str = "procedure_code"
) -> DataFrame:
    """First and last date, studies, and studies that are not the intended procedure."""
    other = ~F.col(procedure_code).eqNullSafe(F.lit(S.TARGET_PROCEDURE))
    return df.agg(
        F.date_format(F.min(ts), "dd-MMM-yyyy").alias("first_date"),
        F.date_format(F.max(ts), "dd-MMM-yyyy").alias("last_date"),
        F.count("*").alias("studies"),
        F.count_if(other).alias("inappropriate_studies"),
    )


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("studies"))
