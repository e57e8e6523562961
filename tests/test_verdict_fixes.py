"""Repeated keys on write paths, date forms, and streams over files in any order."""

import pytest
from pyspark.sql import functions as F

from auditlake import schema as S
from auditlake.functions import parsing as P
from auditlake.operators import merges as M
from auditlake.sources.study_table import StudyTable
from auditlake.streaming import incremental


def studies(spark, rows):
    df = spark.createDataFrame(rows, "accession_no long, workplace string, gt_manual int")
    return M.conform(df, S.STUDY_SCHEMA)


def test_upsert_keeps_keys_unique(spark, tmp_path):
    table = StudyTable(spark, str(tmp_path / "t"))
    table.upsert(studies(spark, [(1, "A", 0), (1, "B", 0), (2, "C", 0), (None, "X", 1)]))
    table.upsert(studies(spark, [(2, "D", 1), (2, "E", 1), (3, "F", 0)]))
    rows = table.read().select("accession_no", "workplace").collect()
    assert sorted(r[0] for r in rows) == [1, 2, 3]
    assert {r[0]: r[1] for r in rows} == {1: "A", 2: "D", 3: "F"}


def test_labels_and_backfill_keep_keys_unique(spark):
    store = studies(spark, [(1, "A", None), (2, "B", None)])
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1)], "accession_no long, label int")
    assert M.apply_labels(store, labels).count() == 2
    field = S.LLM_FINDING_FIELDS[0]
    found = spark.createDataFrame([(1, 0), (1, 1), (None, 1)], f"accession_no long, {field} int")
    got = {r[0]: r[1] for r in M.backfill_merge(store, found).select("accession_no", field).collect()}
    assert got == {1: 1, 2: None}


@pytest.mark.parametrize(("text", "wanted"), [
    ("13/01/2024 10:00", "2024-01-13 10:00:00"), ("1/5/2024 9:03", "2024-01-05 09:03:00"), ("20240103", "2024-01-03 00:00:00"),
    ("01/05/2024 09:03:11 AM", "2024-01-05 09:03:11"), ("3 Jan 2024", "2024-01-03 00:00:00"), ("2024/1/3 9:05", "2024-01-03 09:05:00"),
    ("05-Jan-24", "2024-01-05 00:00:00"), ("2024/01/03 09:05", "2024-01-03 09:05:00"), ("3.1.2024", "2024-01-03 00:00:00"),
    ("Jan 3, 2024", "2024-01-03 00:00:00"), ("01/05/2024 1:03 PM", "2024-01-05 13:03:00"), ("not a date", None),
])
def test_date_forms(spark, text, wanted):
    row = spark.range(1).select(P.timestamp(F.lit(text)).cast("string")).first()
    assert row[0] == wanted


def test_backlog_in_any_order_is_counted(spark, tmp_path):
    for i, day in enumerate(("2024-06-03", "2024-07-01", "2024-01-01")):
        one = spark.range(100).select(F.lit(f"{day} 10:00:00").cast("timestamp").alias("ts"))
        one.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"f{i}"))
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    weekly = incremental.weekly_windows(stream, "ts", [F.count("*").alias("n")])
    got = incremental.run_updates(weekly, str(tmp_path / "out"), str(tmp_path / "ckpt"), ["week"])
    assert sorted((str(r[0]), r[1]) for r in got.collect()) == [("2024-01-01", 100), ("2024-06-03", 100), ("2024-07-01", 100)]
