import pytest
from pyspark.sql import functions as F

from auditlake import schema as S
from auditlake.operators import intake
from auditlake.operators import merges as M
from auditlake.sources.study_table import NO_MONTH, StudyTable

COLS = "accession_no long, workplace string, gt_manual int, procedure_start_date timestamp, seq int"


def rows(spark, *data):
    df = spark.createDataFrame([(k, w, g, d, i) for i, (k, w, g, d) in enumerate(data)],
                               "accession_no long, workplace string, gt_manual int, d string, seq int")
    return df.withColumn("procedure_start_date", F.to_timestamp("d")).drop("d")


def as_map(df, *fields):
    return {r["accession_no"]: tuple(r[f] for f in fields) for r in df.collect()}


@pytest.fixture()
def table(spark, tmp_path):
    t = StudyTable(spark, str(tmp_path / "table"))
    first = rows(spark, (1, "A", None, "2024-01-03"), (2, "B", 1, "2024-02-03"), (1, "late", 0, "2024-01-09"),
                 (None, "x", 1, "2024-01-01"), (3, "C", None, None))
    t.insert(first, ["seq"], "b1")
    return t


def test_insert_keeps_the_first_row_and_is_idempotent(spark, table):
    assert as_map(table.read(), "workplace", "gt_manual") == {1: ("A", None), 2: ("B", 1), 3: ("C", None)}
    before = table.snapshot().version
    table.insert(rows(spark, (1, "again", 1, "2024-01-03"), (2, "again", 1, "2023-01-01")), ["seq"], "b2")
    assert table.read().count() == 3 and table.snapshot().version == before
    table.insert(rows(spark, (4, "D", 1, "2024-01-20")), ["seq"], "b3")
    got = as_map(table.read(), "processing_batch_id")
    assert got[4] == ("b3",) and got[1] == ("b1",)


def test_months_are_pruned(table):
    assert table.months() == ["2024-01", "2024-02", NO_MONTH]
    january = table.read_period("2024-01-01", "2024-01-31")
    assert as_map(january, "workplace") == {1: ("A",)}
    assert all("month=2024-01" in f for f in january.inputFiles())


def test_upsert_ignores_nulls_and_may_move_a_row(spark, table):
    table.upsert(rows(spark, (1, None, 1, None), (3, "C2", None, "2024-02-20"), (9, "N", 0, "2024-05-05")).drop("seq"))
    got = as_map(table.read(), "workplace", "gt_manual")
    assert got == {1: ("A", 1), 2: ("B", 1), 3: ("C2", None), 9: ("N", 0)}
    assert table.read().count() == 4
    assert table.read([NO_MONTH]).count() == 0


def test_all_null_update_changes_nothing(spark, table):
    before = as_map(table.read(), "workplace", "gt_manual", "procedure_start_date")
    table.upsert(rows(spark, (1, None, None, None)).drop("seq"))
    assert as_map(table.read(), "workplace", "gt_manual", "procedure_start_date") == before


def test_labels_delete_edit_backfill(spark, table):
    table.set_labels(spark.createDataFrame([(1, 1), (77, 1)], "accession_no long, label int"))
    table.delete(spark.createDataFrame([(2,), (88,)], "accession_no long"))
    edits = [(1, "workplace", "Z", 0), (1, "workplace", "", 1), (3, "accession_no", "5", 2), (3, "status", "ok", 3),
             (3, "nodule", "4.5", 4), (3, "nothing", "1", 5)]
    table.edit(spark.createDataFrame(edits, "accession_no long, field string, value string, seq int"))
    table.backfill(spark.createDataFrame([(3, 1, None), (1, None, 0)], "accession_no long, nodule_llm int, tb_llm int"))
    got = as_map(table.read(), "workplace", "gt_manual", "status", "nodule", "nodule_llm", "tb_llm")
    assert got == {1: (None, 1, None, None, None, 0), 3: ("C", None, "ok", 4.5, 1, None)}
    times = {r["accession_no"]: r["updated_at"] > r["created_at"] for r in table.read().collect()}
    assert times == {1: True, 3: True}


def test_uncommitted_files_stay_invisible(spark, table):
    table.read().withColumn("month", F.lit("2024-01")).write.partitionBy("month").parquet(f"{table.root}/rows/v-dead")
    assert table.read().count() == 3


def test_runs_are_appended(table):
    table.record_run(run_id="a", status="completed", records=3)
    table.record_run(run_id="b", status="failed", message="no service")
    assert {r["run_id"]: r["status"] for r in table.runs().collect()} == {"a": "completed", "b": "failed"}


def test_import_outcomes(spark):
    store = spark.createDataFrame([(1,), (2,)], "accession_no long")
    data = spark.createDataFrame([(1, 0), (1, 1), (5, 2), (None, 3), (None, 4)], "accession_no long, seq int")
    for mode, hit in (("skip", "skipped"), ("update", "updated")):
        got = {r["outcome"]: r["lines"] for r in M.import_counts(M.import_outcomes(store, data, ["seq"], mode)).collect()}
        assert got == {hit: 1, "duplicate": 1, "new": 1, "invalid": 2}
    with pytest.raises(ValueError):
        M.import_outcomes(store, data, ["seq"], "replace")


def test_label_messages(spark):
    store = spark.createDataFrame([(12,), (13,)], "accession_no long")
    lines = [("", "1"), ("abc", "1"), ("12.0", ""), ("12", "2"), ("99", "0"), ("12", "yes"), ("12", "No"), ("13", "TRUE")]
    sheet = spark.createDataFrame([(k, g, i + 2) for i, (k, g) in enumerate(lines)], "k string, g string, row_no long")
    out = M.label_outcomes(store, sheet, "k", "g").cache()
    assert [r["message"] for r in M.first_messages(out).collect()] == [
        "Row 2: empty accession number.",
        'Row 3: accession "abc" is not a valid integer.',
        "Row 4: manual_gt is empty.",
        'Row 5: manual_gt "2" is not 0 or 1.',
        "Row 6: accession 99 not found in database.",
    ]
    assert as_map(M.accepted_labels(out), "label") == {12: (0,), 13: (1,)}


def test_header_report_and_aliases(spark):
    seen = intake.header_report(["Unnamed: 0", "ACCESSION_NO", "Institute", "Shoe size"])
    assert seen["unmapped"] == ["Shoe size"]
    assert seen["missing_expected"] == ["TEXT_REPORT", "WORKPLACE", "gt_llm", S.PREDICTION_HEADER]
    df = spark.createDataFrame([("7.0", "old", None, "1", None)], "ACCESSION_NO string, MEDICAL_LOCATION_NAME string, "
                               "Institute string, gt_manual string, manual_gt string")
    row = intake.map_headers(df).first()
    assert row["accession_no"] == 7 and row["medical_location_name"] is None and row["gt_manual"] is None


def test_merge_types_keys_before_deduplicating(spark):
    reports = spark.createDataFrame([("12", "first", 0), ("12.0", "second", 1), ("x", "bad", 2)],
                                    f"ACCESSION_NO string, TEXT_REPORT string, {intake.ROW_ORDER} int")
    scores = spark.createDataFrame([("12", "-", 1), ("12", "40.5", 0), ("13", "1", 2)],
                                   f"`Accession Number` string, Nodule string, {intake.ROW_ORDER} int")
    got = intake.merge_exports(reports, scores).collect()
    assert [(r["ACCESSION_NO"], r["TEXT_REPORT"], r["Nodule"]) for r in got] == [(12, "first", 40.5)]


def test_result_columns_are_arranged(spark):
    df = spark.sql("SELECT 1 AS extra, 2 AS Overall_binary, 3 AS ACCESSION_NO, 4 AS PROCEDURE_CODE, 5 AS `ground truth`")
    assert intake.arrange_result(df).columns == ["ACCESSION_NO", "gt_manual", S.PREDICTION_HEADER, "extra"]
