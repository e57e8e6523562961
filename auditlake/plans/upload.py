"""From uploaded exports to rows of the study table."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake import schema as S
from auditlake.functions import rules
from auditlake.operators import grading, intake
from auditlake.session import materialize

DEFAULT_STEPS = ("llm",)
DATES = tuple(c for c, kind in S.EXPORT_TYPES.items() if kind == "timestamp")


def analyse(
    reports: DataFrame,
    scores: DataFrame,
    graders: Mapping[str, Callable],
    detailed_findings: bool = False,
    cutoff: int = 1,
    thresholds: rules.Thresholds = S.THRESHOLDS,
    **options,
) -> DataFrame:
    """Merge exports, predict, grade, label and time them; columns keep their export names.

    Date columns are read days first or months first as most cells of their upload say (``date_votes`` tells). Each export is read for
    that and for the merge, without another copy of its texts. What the graders and the last join share is written once; the result reads
    that and no export.
    """
    days = [intake.day_first_columns(intake.date_votes(df, DATES)) for df in (reports, scores)]
    merged = intake.merge_exports(reports, scores, *days)
    site = rules.site_of(F.col("WORKPLACE"))
    present = {field: F.col(f"`{name}`") for name, field in S.FINDINGS.items() if name in merged.columns}
    priority, end, flag = (F.col(c) for c in ("AI_PRIORITY", "PROCEDURE_END_DATE", "AI_FLAG_RECEIVED_DATE"))
    timed = merged.withColumns(
        {
            "Overall_binary": rules.predict(site, present, thresholds),
            "Time_to_Clinical_Decision": rules.decision_seconds(priority, end, flag, F.col(S.TURNAROUND_HEADER)),
            "Time_End_to_End": rules.end_to_end_seconds(priority, end, flag),
        }
    )
    timed = materialize(timed, "upload-timed", compression="zstd")
    steps = DEFAULT_STEPS + (("findings",) if detailed_findings else ())
    graded = grading.grade_pipeline(
        timed.select("ACCESSION_NO", "TEXT_REPORT"), steps, graders, "TEXT_REPORT", key="ACCESSION_NO", **options
    ).drop("TEXT_REPORT")
    joined = timed.join(graded, "ACCESSION_NO", "left")
    labelled = joined.withColumn("llm_grade_binary", rules.label_from_grade(F.col("llm_grade"), cutoff))
    return intake.arrange_result(labelled)


def date_votes(reports: DataFrame, scores: DataFrame) -> DataFrame:
    """Per export, upload and date column: the votes on day and month, the order read, and the cells left unparsed."""
    parts = [intake.date_votes(df, DATES).withColumn("kind", F.lit(kind)) for kind, df in (("reports", reports), ("scores", scores))]
    return parts[0].unionByName(parts[1])


def to_studies(result: DataFrame) -> DataFrame:
    """A pipeline result as study-table rows: same header table as an import."""
    return intake.map_headers(result)
