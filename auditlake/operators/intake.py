"""Typing, de-duplicating and joining of exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import schema as S
from auditlake.functions import dates
from auditlake.functions import parsing as P

ROW_ORDER = "_row_order"


def blank_dashes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``-`` to null in text columns."""
    names = columns or [n for n, t in df.dtypes if t == "string"]
    return df.withColumns({n: P.dash_to_null(F.col(f"`{n}`")) for n in names})


def _upload() -> Column:
    return F.col(f"{ROW_ORDER}.file_seq")


def date_votes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per upload and date column: how many cells say which of day and month comes first, and how many no form fits (see ``dates.votes``)."""
    has_place = ROW_ORDER in df.columns and "file_seq" in getattr(df.schema[ROW_ORDER].dataType, "names", [])
    return dates.votes(df, [c for c in columns if c in df.columns], _upload() if has_place else F.lit(0), P.timestamp)


def day_first_columns(votes: DataFrame) -> dict[str, Column]:
    """Condition per column: the row's upload has its days first."""
    found: dict[str, list[int]] = {}
    for r in votes.where(F.col("first") == dates.DAY_FIRST).select("column", "upload").collect():  # one row per upload and column
        found.setdefault(r["column"], []).append(r["upload"])
    return {c: _upload().isin(uploads) for c, uploads in found.items()}


def _typed(name: str, kind: str, day_first: Column | bool = False) -> Column:
    c = F.col(f"`{name}`")
    if kind == "timestamp":
        return P.timestamp(c, day_first)
    if name in ("ACCESSION_NO", "Accession Number"):
        return P.accession(c)
    if kind in ("float", "double"):
        return P.number(c).cast(kind)
    return P.number(c).try_cast(kind)


def apply_types(df: DataFrame, types: Mapping[str, str] = S.EXPORT_TYPES, day_first: Mapping[str, Column | bool] | None = None) -> DataFrame:
    """Cast the known columns that are present, leniently and in one projection. ``day_first`` by column; else months come first."""
    first = day_first or {}
    return df.select(
        *[_typed(n, types[n], first.get(n, False)).alias(n) if n in types else F.col(f"`{n}`") for n in df.columns]
    )


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row per key in row order; rows without a key are dropped.

    An aggregate instead of a ranking window: it shrinks on the map side, so a key that holds
    a third of all rows reaches the reducers as one row per task.
    """
    others = [c for c in df.columns if c != key]
    picked = df.where(F.col(f"`{key}`").isNotNull()).groupBy(key).agg(
        F.min_by(F.struct(*[f"`{c}`" for c in others]), F.struct(*order)).alias("_row")
    )
    return picked.select(key, *[F.col(f"_row.`{c}`").alias(c) for c in others])


def canonical_score_key(df: DataFrame) -> DataFrame:
    """Score exports name their key in two ways; make it ``ACCESSION_NO``."""
    present = [c for c in S.SCORE_KEY_HEADERS if c in df.columns]
    if not present:
        raise ValueError(f"scores need one of {S.SCORE_KEY_HEADERS}")
    key = F.coalesce(*[P.accession(F.col(f"`{c}`")) for c in present])
    return df.withColumn("_key", key).drop(*present).withColumnRenamed("_key", "ACCESSION_NO")


def merge_exports(
    reports: DataFrame, scores: DataFrame, report_days: Mapping[str, Column] | None = None, score_days: Mapping[str, Column] | None = None
) -> DataFrame:
    """Typed reports joined to scores on the accession number, one row per accession.

    Both sides are cut to their first row per key before the join. That equals joining first
    and keeping the first pair, but a repeated key can no longer multiply rows. Date columns with days first are named per side.
    """
    left = first_per_key(apply_types(blank_dashes(reports), day_first=report_days), "ACCESSION_NO", [ROW_ORDER]).drop(ROW_ORDER)
    typed = apply_types(blank_dashes(canonical_score_key(scores)), day_first=score_days)
    right = first_per_key(typed, "ACCESSION_NO", [ROW_ORDER]).drop(ROW_ORDER)
    clash = [c for c in right.columns if c in left.columns and c != "ACCESSION_NO"]
    merged = left.join(right.drop(*clash), "ACCESSION_NO", "inner").drop(*S.MERGE_DROPPED)
    if "PROCEDURE_DATE" in merged.columns:
        old = P.timestamp(F.col("PROCEDURE_DATE"))
        end = F.coalesce(F.col("PROCEDURE_END_DATE"), old) if "PROCEDURE_END_DATE" in merged.columns else old
        merged = merged.withColumn("PROCEDURE_END_DATE", end).drop("PROCEDURE_DATE")
    return merged


def arrange_result(df: DataFrame) -> DataFrame:
    """Final names and column order of a pipeline result; unknown columns come last."""
    names = {
        "ground truth": "gt_manual",
        "llm_grade_binary": "gt_llm",
        "Overall_binary": S.PREDICTION_HEADER,
        "Time_to_Clinical_Decision": "Time to clinical_decision(mins)",
    }
    df = df.withColumnsRenamed(names).drop(*S.RESULT_DROPPED)
    known = [c for c in S.RESULT_ORDER if c in df.columns]
    rest = [c for c in df.columns if c not in known]
    return df.select(*[f"`{c}`" for c in known + rest])


def _field_value(header: str, field: str) -> Column:
    c = F.col(f"`{header}`")
    kind = S.STUDY_TYPES[field]
    if field in S.LABEL_FIELDS:
        return P.bool_to_int(c)
    if kind == "double":
        return P.number(c)
    if kind == "int":
        return P.number(c).try_cast("int")
    return c.cast(kind)


def map_headers(df: DataFrame, keep: Sequence[str] = (), day_first: Mapping[str, Column] | None = None) -> DataFrame:
    """An imported file's columns as study fields. Unknown headers are left out.

    Where two headers feed the same field the later one in the header table wins, even if null. ``day_first`` by header; else
    months come first.
    """
    fields: dict[str, Column] = {}
    for header, field in S.PLAIN_HEADERS.items():
        if header in df.columns:
            fields[field] = P.accession(F.col(header)) if field == "accession_no" else _field_value(header, field)
    for header, field in S.TIMESTAMP_HEADERS.items():
        if header in df.columns:
            fields[field] = P.timestamp(F.col(f"`{header}`"), (day_first or {}).get(header, False))
    for header, field in S.DURATION_HEADERS.items():
        if header in df.columns:
            fields[field] = P.duration_seconds(F.col(f"`{header}`"))
    if S.TURNAROUND_HEADER in df.columns:
        seconds = "time_to_clinical_decision_seconds"
        fields[seconds] = P.turnaround_fallback(
            fields.get(seconds, F.lit(None).cast("double")), F.col(S.TURNAROUND_HEADER)
        )
    return df.select(*[c.alias(f) for f, c in fields.items()], *keep)


def header_report(headers: Sequence[str]) -> dict[str, list]:
    """Which header feeds which field, which are unmapped, and which expected ones are missing."""
    target = {**S.PLAIN_HEADERS, **S.TIMESTAMP_HEADERS, **S.DURATION_HEADERS,
              S.TURNAROUND_HEADER: "time_to_clinical_decision_seconds (fallback)"}
    mapping = [(h, target.get(h)) for h in headers if h not in S.IGNORED_HEADERS]
    return {
        "mapping": mapping,
        "unmapped": [h for h, field in mapping if field is None],
        "missing_expected": sorted(set(S.EXPECTED_HEADERS) - set(headers)),
    }
