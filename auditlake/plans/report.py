"""The whole audit report of a period, as one DataFrame per section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import rules
from auditlake.operators import confusion, filters, timing, trends
from auditlake.operators.merges import conform
from auditlake.session import materialize

NARROW = (
    "accession_no", "workplace", "procedure_start_date", "gt_llm", "gt_manual", "prediction",
    "time_to_clinical_decision_seconds", "time_end_to_end_seconds",
)


def slice_of(studies: DataFrame, first: str | None = None, last: str | None = None, sites: str | None = None) -> DataFrame:
    """Studies of the period and sites with their short site name; prunes by the timestamp itself."""
    rows = studies.where(filters.date_range("procedure_start_date", first, last) & filters.site_filter(sites))
    return rows.withColumn("site", rules.site_of(F.col("workplace")))


def report_sections(
    studies: DataFrame, first: str | None = None, last: str | None = None, sites: str | None = None, pin: bool = True
) -> dict[str, DataFrame]:
    """Every section of the report.

    Sections share the narrow slice, eight short columns without the report text. It is written
    once to the shared folder (``pin``) and each section scans the columns it needs; only the
    two case lists go back to the studies for text and scores. The raw value lists behind box
    plots are replaced by their statistics.
    """
    full = slice_of(conform(studies), first, last, sites)
    rows = full.select(*NARROW, "site")
    if pin:
        rows = materialize(rows, "report-slice")
    manual = rows.where(F.col("gt_manual").isNotNull())
    times = timing.unpivot_times(rows)
    weekly = trends.weekly_balanced_accuracy(rows, "gt_llm", "prediction")
    return {
        "summary": confusion.quick_counts(rows),
        "site_metrics": confusion.site_confusion_metrics(rows, "gt_llm", "prediction"),
        "time_stats": timing.time_stats_text(timing.time_stats(times)),
        "box_plots": timing.box_plot_stats(times),
        "weekly_site_metrics": trends.weekly_site_metrics(rows, "gt_llm", "prediction"),
        "weekly_balanced_accuracy": weekly,
        "control_band": trends.control_band(weekly),
        "manual_llm_metrics": confusion.site_confusion_metrics(manual, "gt_llm", "prediction"),
        "manual_metrics": confusion.site_confusion_metrics(manual, "gt_manual", "prediction"),
        "agreement": confusion.agreement(manual, "gt_manual", "gt_llm"),
        "mcnemar": confusion.mcnemar(manual, "gt_manual", "gt_llm", "prediction"),
        "false_negatives": confusion.disagreement_details(confusion.disagreements(full, "gt_llm", "gt_manual", "FN")),
        "false_positives": confusion.disagreement_details(confusion.disagreements(full, "gt_llm", "gt_manual", "FP")),
    }


def report_figures(studies: DataFrame, first: str | None = None, last: str | None = None, sites: str | None = None) -> DataFrame:
    """Every section's figures in one long table ``(section, item, metric, value)``; case lists have an item per study."""
    s = report_sections(studies, first, last, sites)

    def long(section: str, df: DataFrame, item, metrics: list[str]) -> DataFrame:
        pairs = F.array(
            *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        )
        return df.select(F.lit(section).alias("section"), item.alias("item"), F.inline(pairs))

    ratios = ["n", "tp", "tn", "fp", "fn", "accuracy", "sensitivity", "specificity", "ppv", "npv",
              "balanced_accuracy", "pct_normal"]
    parts = [
        long("summary", s["summary"], F.lit("all"), ["total", "gt_llm_pos", "prediction_pos", "graded", "ungraded"]),
        long("site_metrics", s["site_metrics"], F.col("site"), ratios),
        long("time_stats", s["time_stats"], F.col("metric"),
             ["count", "mean", "p5", "p25", "median", "p75", "p95", "min", "max", "more_than_5_min", "above_p95"]),
        long("weekly_balanced_accuracy", s["weekly_balanced_accuracy"], F.col("week").cast("string"), ["value"]),
        long("manual_llm_metrics", s["manual_llm_metrics"], F.col("site"), ratios),
        long("manual_metrics", s["manual_metrics"], F.col("site"), ratios),
        long("agreement", s["agreement"], F.lit("all"), ["n", "agreement_pct", "kappa"]),
        long("mcnemar", s["mcnemar"], F.lit("all"), ["b", "c", "statistic", "p_value"]),
        long("control_band", s["control_band"], F.lit("all"), ["last_value", "lower", "upper"]),
        long("box_plots", s["box_plots"], F.col("metric"), ["n", "q1", "med", "q3", "min", "max", "whisker_low", "whisker_high", "outliers"]),
        long("weekly_site_metrics", s["weekly_site_metrics"], F.concat_ws(" ", F.col("week").cast("string"), "site"), ["sensitivity", "specificity"]),
        *[long(kind, s[kind], F.concat_ws(" ", F.col("accession_no").cast("string"), "site"), ["gt_llm", "gt_manual", "highest_score"])
          for kind in ("false_negatives", "false_positives")],
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
