"""Agreement between two label columns: confusion metrics, kappa, McNemar, disagreements."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import schema as S
from auditlake.functions import rules, stats

CELLS = ("tp", "tn", "fp", "fn")


def cell_counts(label: str, prediction: str) -> list[Column]:
    """Four conditional counts; a row with a null in either column counts nowhere."""
    lab, pred = F.col(label), F.col(prediction)
    return [
        F.count_if((lab == 1) & (pred == 1)).alias("tp"),
        F.count_if((lab == 0) & (pred == 0)).alias("tn"),
        F.count_if((lab == 0) & (pred == 1)).alias("fp"),
        F.count_if((lab == 1) & (pred == 0)).alias("fn"),
    ]


def with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(stats.confusion_ratios(*[F.col(c) for c in CELLS]))


def confusion_metrics(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """Counts and ratios of ``prediction`` against ``label``, per group or overall."""
    return with_ratios(df.groupBy(*(by or [])).agg(*cell_counts(label, prediction)))


def site_confusion_metrics(
    df: DataFrame, label: str, prediction: str, site: str = "site", overall: str = "OVERALL"
) -> DataFrame:
    """Metrics per site and one overall row.

    The data is counted once per site; the overall row is a rollup of those few counts.
    """
    per_site = df.groupBy(site).agg(*cell_counts(label, prediction))
    rolled = per_site.rollup(site).agg(*[F.sum(c).alias(c) for c in CELLS], F.grouping(site).alias("_all"))
    named = rolled.withColumn(site, F.when(F.col("_all") == 1, overall).otherwise(F.col(site))).drop("_all")
    return with_ratios(named.na.fill(0, list(CELLS)))


def agreement(df: DataFrame, first: str, second: str, by: list[str] | None = None) -> DataFrame:
    """Percent agreement and Cohen's kappa between two raters, unrounded."""
    counts = df.groupBy(*(by or [])).agg(*cell_counts(first, second))
    cells = [F.col(c) for c in CELLS]
    n = sum(cells[1:], cells[0])
    return counts.withColumns(
        {
            "n": n,
            "agreement_pct": stats.ratio(cells[0] + cells[1], n) * 100,
            "kappa": stats.kappa(*cells),
        }
    )


def mcnemar(
    df: DataFrame, first: str, second: str, prediction: str, by: list[str] | None = None, alpha: float = 0.05
) -> DataFrame:
    """Exact McNemar test of two label columns, each "correct" where it equals the prediction."""
    first_right, second_right = F.col(first) == F.col(prediction), F.col(second) == F.col(prediction)
    counts = df.groupBy(*(by or [])).agg(
        F.count_if(first_right & ~second_right).alias("b"), F.count_if(~first_right & second_right).alias("c")
    )
    p = stats.mcnemar_p(F.col("b"), F.col("c"))
    return counts.withColumns({"statistic": F.least("b", "c"), "p_value": p}).withColumn(
        "significant", F.col("p_value") < alpha
    )


def contingency(df: DataFrame, truth: str, first: str, second: str) -> DataFrame:
    """Dense 2x2 table of correctness of two methods, with both accuracies and their difference.

    One row per cell ``(first_correct, second_correct)``; empty cells count 0.
    """
    one = (F.col(first) == F.col(truth)).cast("int")
    two = (F.col(second) == F.col(truth)).cast("int")
    counts = df.where(one.isNotNull() & two.isNotNull()).agg(
        *[F.count_if((one == i) & (two == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)]
    )
    total = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    acc1 = stats.ratio(F.col("n10") + F.col("n11"), total)
    acc2 = stats.ratio(F.col("n01") + F.col("n11"), total)
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("first_correct"), F.lit(j).alias("second_correct"), F.col(f"n{i}{j}").alias("n"))
            for i in (0, 1)
            for j in (0, 1)
        ]
    )
    return counts.select(
        F.inline(cells), acc1.alias("first_accuracy"), acc2.alias("second_accuracy"),
        (acc2 - acc1).alias("accuracy_difference"),
    )


def disagreements(df: DataFrame, label: str, other: str, kind: str) -> DataFrame:
    """Rows where the two differ: ``FN`` is label 0 and other 1, ``FP`` is label 1 and other 0."""
    want = {"FN": (0, 1), "FP": (1, 0)}[kind]
    return df.where((F.col(label) == want[0]) & (F.col(other) == want[1]))


def disagreement_details(df: DataFrame, scores: Mapping[str, str] | None = None) -> DataFrame:
    """What a reviewer sees per case: site, date label, top finding and a text snippet."""
    scores = scores or {f.replace("_", " ").title(): f for f in S.REPORT_FINDING_FIELDS}
    top = rules.top_finding({name: F.col(c) for name, c in scores.items()}, positive_only=True)
    dash = F.lit("—")
    return df.select(
        "accession_no",
        F.when(F.col("workplace").isNull(), dash).otherwise(rules.site_of(F.col("workplace"))).alias("site"),
        F.coalesce(F.date_format("procedure_start_date", "dd MMM yyyy"), dash).alias("procedure_date"),
        "gt_llm",
        "gt_manual",
        F.coalesce(top["finding"], F.lit("")).alias("highest_finding"),
        F.round(F.coalesce(top["score"], F.lit(0.0)), 1).alias("highest_score"),
        F.substring(F.coalesce("text_report", F.lit("")), 1, 200).alias("snippet"),
    )


def disagreement_summary(df: DataFrame, label: str, other: str, kind: str = "FN") -> DataFrame:
    want = {"FN": (0, 1), "FP": (1, 0)}[kind]
    hit = (F.col(label) == want[0]) & (F.col(other) == want[1])
    return df.agg(F.count_if(hit).alias("count"), F.count("*").alias("total_cases")).withColumn(
        "percentage", stats.ratio(F.col("count"), F.col("total_cases")) * 100
    )


def quick_counts(df: DataFrame) -> DataFrame:
    """Label and prediction positives, graded and ungraded studies, date span."""
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("gt_llm") == 1).alias("gt_llm_pos"),
        F.count_if(F.col("prediction") == 1).alias("prediction_pos"),
        F.count("gt_llm").alias("graded"),
        F.count_if(F.col("gt_llm").isNull()).alias("ungraded"),
        F.date_format(F.min("procedure_start_date"), "dd MMM yyyy").alias("actual_from"),
        F.date_format(F.max("procedure_start_date"), "dd MMM yyyy").alias("actual_to"),
    )


def store_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("accession_no").alias("total"),
        F.avg("abnormal").alias("avg_abnormal"),
        F.count_if(F.col("gt_llm") == 1).alias("gt_llm_pos"),
        F.count_if(F.col("prediction") == 1).alias("prediction_pos"),
    )
