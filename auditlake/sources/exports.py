"""Reading score exports, report exports, historical imports and label files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake import schema as S
from auditlake.functions import parsing as P
from auditlake.operators.intake import ROW_ORDER
from auditlake.operators.sizing import broadcast_keys
from auditlake.session import materialize
from auditlake.sources import ranges

BOM = "﻿"


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_csv(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    """Text columns only, RFC-4180 quoting, newlines inside fields, empty cells null."""
    settings = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8", **options}
    df = spark.read.options(**settings).csv(path)
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.lstrip(BOM)) if first.startswith(BOM) else df


def _rows(spark: SparkSession, path: str, seq: int, split: bool | None) -> DataFrame:
    """A file's rows with where they came from: file position in the upload, file, place in the file.

    Files that Spark would cut are read by ranges (see ``ranges``), others by one task each; ``split`` asks for one or the other. Both
    give the same rows in the same order.
    """
    whole = read_csv(spark, path)
    if ranges.would_cut(spark, [path]) if split is None else split:
        df = ranges.parse_records(ranges.read_records(spark, [path]), whole.columns)
        place = F.struct(F.lit(seq).alias("file_seq"), *ranges.PLACE)
        return df.select(*[F.col(f"`{c}`") for c in whole.columns], place.alias(ROW_ORDER))
    place = F.struct(
        F.lit(seq).alias("file_seq"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return whole.select("*", place.alias(ROW_ORDER))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def header_groups(spark: SparkSession, paths: str | Sequence[str]) -> dict[tuple[str, ...], list[tuple[int, str]]]:
    """Uploads by header row. Only first lines are read."""
    groups: dict[tuple[str, ...], list[tuple[int, str]]] = {}
    for seq, path in enumerate(_paths(paths)):
        groups.setdefault(tuple(read_csv(spark, path).columns), []).append((seq, path))
    return groups


def read_scores(spark: SparkSession, paths: str | Sequence[str], split: bool | None = None) -> DataFrame:
    """All score exports, by name, in the order given; columns absent from one file are null."""
    return _union([_rows(spark, p, i, split) for i, p in enumerate(_paths(paths))])


def read_reports(spark: SparkSession, paths: str | Sequence[str], split: bool | None = None) -> DataFrame:
    """All report exports; an older file's ``PROCEDURE_DATE`` is the end date."""
    parts = []
    for i, p in enumerate(_paths(paths)):
        df = _rows(spark, p, i, split)
        if "PROCEDURE_END_DATE" not in df.columns:
            df = df.withColumnRenamed("PROCEDURE_DATE", "PROCEDURE_END_DATE")
        parts.append(df)
    return _union(parts)


def read_import(spark: SparkSession, path: str, split: bool | None = None) -> DataFrame:
    if "ACCESSION_NO" not in read_csv(spark, path).columns:
        raise ValueError("an import needs the column ACCESSION_NO")
    return _rows(spark, path, 0, split)


def read_labels(spark: SparkSession, path: str, split: bool | None = None) -> DataFrame:
    """A labels file with its line numbers; the header is line 1.

    Lines are counted through all files of the folder, by name, headers apart. Rows are numbered from top to bottom within a file, or
    within a range of it, so a line's number is its row less the first one there, plus the lines of the files and ranges before.
    """
    df = _rows(spark, path, 0, split)
    placed = df.select("*", F.struct(f"{ROW_ORDER}.file", f"{ROW_ORDER}.block").alias("_part"), F.col(f"{ROW_ORDER}.row").alias("_id"))
    parts = placed.groupBy("_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file or range
    shift = F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first") + 2
    shifts = broadcast_keys(materialize(parts.select("_part", shift.alias("_shift")), "label-lines"))
    columns = [placed[f"`{c}`"] for c in df.columns if c != ROW_ORDER]
    return placed.join(shifts, "_part").select(*columns, (F.col("_id") + F.col("_shift")).alias("row_no"))


def kind_of(headers: Sequence[str]) -> tuple[str, list[str]]:
    """``scores``, ``reports`` or ``unknown`` by columns alone, with the columns that are missing."""
    have = set(headers)
    no_scores = [c for c in S.SCORE_REQUIRED if c not in have]
    if not have & set(S.SCORE_KEY_HEADERS):
        no_scores.insert(0, S.SCORE_KEY_HEADERS[0])
    no_reports = [c for c in S.REPORT_REQUIRED if c not in have]
    if not no_scores:
        return "scores", []
    if not no_reports:
        return "reports", []
    return "unknown", no_reports if len(no_reports) <= len(no_scores) else no_scores


def classify_files(spark: SparkSession, paths: Sequence[str], strict: bool = True) -> dict[str, list[str]]:
    """Sort uploads into kinds; with ``strict`` a file of neither kind is refused."""
    kinds: dict[str, list[str]] = {"scores": [], "reports": [], "unknown": []}
    for headers, files in header_groups(spark, paths).items():
        kind, missing = kind_of(headers)
        if kind == "unknown" and strict:
            raise ValueError(f"{files[0][1]} is missing required columns: {missing}")
        kinds[kind] += [p for _, p in files]
    return kinds


def file_profile(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Per upload: kind, rows and distinct accession numbers."""
    parts = []
    for headers, files in header_groups(spark, paths).items():
        kind, missing = kind_of(headers)
        key = next((c for c in S.SCORE_KEY_HEADERS if c in headers), None)
        for seq, path in files:
            df = read_csv(spark, path)
            accession = P.accession(F.col(f"`{key}`")) if key else F.lit(None).cast("bigint")
            parts.append(
                df.select(accession.alias("a")).agg(F.count("*").alias("rows"), F.count_distinct("a").alias("accessions"))
                .select(
                    F.lit(seq).alias("file_seq"), F.lit(path).alias("path"), F.lit(kind).alias("kind"),
                    F.lit(",".join(missing)).alias("missing"), "rows", "accessions",
                )
            )
    return _union(parts)
