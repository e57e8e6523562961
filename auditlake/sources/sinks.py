"""Exports: CSV and JSON files written in parallel, one header set each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake import schema as S
from auditlake.operators import confusion
from auditlake.operators.filters import sort_columns
from auditlake.session import FREE_SHUFFLES, settings

CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX",
}


def write_csv(df: DataFrame, path: str) -> str:
    with settings(df.sparkSession, FREE_SHUFFLES):
        df.write.options(**CSV_OPTIONS).csv(path)
    return path


def _by_start(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Selected columns, oldest first; the prediction goes out under its exchange name."""
    return (
        df.select(*columns)
        .orderBy(F.col("procedure_start_date").asc_nulls_first(), "accession_no")
        .withColumnRenamed("prediction", S.PREDICTION_HEADER)
    )


def period_export(studies: DataFrame) -> DataFrame:
    return _by_start(studies, S.PERIOD_EXPORT)


def disagreement_export(studies: DataFrame, kind: str) -> DataFrame:
    """``FN``: llm label 0, manual label 1. ``FP``: the reverse."""
    return _by_start(confusion.disagreements(studies, "gt_llm", "gt_manual", kind), S.DISAGREEMENT_EXPORT)


def view_export(studies: DataFrame, sort: str | None = None) -> DataFrame:
    """Every column of a filtered view in the listing's order."""
    return studies.orderBy(*sort_columns(sort)).withColumnRenamed("prediction", S.PREDICTION_HEADER)


def write_result(result: DataFrame, path: str, label: str = "gt_llm", prediction: str = S.PREDICTION_HEADER) -> dict[str, str]:
    """A pipeline result as JSON records and CSV, with its false-negative set beside it.

    Here a false negative is label 0 with a positive prediction.
    """
    missed = confusion.disagreements(result, label, prediction, "FN")
    out = {"json": f"{path}/json", "csv": f"{path}/csv", "false_negatives": f"{path}/false_negatives"}
    result.write.json(out["json"])
    write_csv(result, out["csv"])
    missed.write.json(out["false_negatives"])
    return out
