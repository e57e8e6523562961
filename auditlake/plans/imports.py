"""A historical file into the study table, and missing findings filled in: each as one job with its outcome counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake import schema as S
from auditlake.operators import filters, intake
from auditlake.operators import merges as M
from auditlake.session import materialize, release
from auditlake.sources import exports
from auditlake.sources.study_table import StudyTable


def import_file(table: StudyTable, path: str, batch_id: str, mode: str = "skip") -> DataFrame:
    """Import a file and return ``(outcome, lines)``.

    Of several lines of a key the first counts. Mode ``skip`` adds unknown keys only, ``update`` also
    overwrites known studies with the values that are not null. The lines are written
    once as study fields, and the outcomes are counted before the table changes. Each date column is read days first or months first
    as most of its cells say; cells that no form fits are counted as ``unparsed <header>``.
    """
    lines = exports.read_import(table.spark, path)
    votes = materialize(intake.date_votes(lines, list(S.TIMESTAMP_HEADERS)), "import-dates")
    rows = materialize(intake.map_headers(lines, [intake.ROW_ORDER], intake.day_first_columns(votes)), "import")
    release(lines)  # the file stays
    outcomes = M.import_outcomes(table.rows_of(rows), rows, [intake.ROW_ORDER], mode)
    unparsed = votes.where(F.col("unparsed") > 0).select(F.concat(F.lit("unparsed "), "column").alias("outcome"), F.col("unparsed").alias("lines"))
    counts = materialize(M.import_counts(outcomes).unionByName(unparsed), "import-counts")
    if mode == "update":
        table.upsert(rows.withColumn("processing_batch_id", F.lit(batch_id)), [intake.ROW_ORDER])
    else:
        table.insert(rows, [intake.ROW_ORDER], batch_id)
    release(rows)
    return counts


def backfill_range(
    table: StudyTable,
    find: Callable[[DataFrame], DataFrame],
    first: str | None = None,
    last: str | None = None,
    fields: Sequence[str] = S.LLM_FINDING_FIELDS,
) -> DataFrame:
    """Fill in the findings of studies with a text and none so far, and return one row ``(candidates, updated, failed)``.

    ``find`` gets ``(accession_no, text_report)`` and returns findings by accession number; it runs once
    and its answers are written before anything reads them. A candidate without any finding
    counts as failed and stays a candidate for the next run.
    """
    if first and last:
        rows = table.read_period(first, last)
    else:
        rows = table.read().where(filters.date_range("procedure_start_date", first, last))
    candidates = materialize(rows.where(filters.needs_backfill()).select(M.KEY, "text_report"), "backfill-candidates")
    found = materialize(find(candidates), "backfill-found")
    set_fields = [F.col(f) for f in fields if f in found.columns]
    hit = found.where(F.coalesce(*set_fields).isNotNull()).select(M.KEY).distinct().withColumn("_hit", F.lit(True))
    counts = candidates.select(M.KEY).join(hit, M.KEY, "left").agg(
        F.count("*").alias("candidates"), F.count("_hit").alias("updated"), F.count_if(F.col("_hit").isNull()).alias("failed")
    )
    counts = materialize(counts, "backfill-counts")
    table.backfill(found)
    return counts
