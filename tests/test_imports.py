"""Whole imports, label files in several parts, and pages over columns with nulls and NaN."""

import pathlib
from collections import Counter
from functools import partial

import pytest

from auditlake.operators import filters, selection
from auditlake.plans import imports, queries_import
from auditlake.session import scratch_path, scratch_root, settings
from auditlake.sources import exports
from auditlake.sources.study_table import StudyTable


def test_import_keeps_one_row_per_key(spark):
    path = scratch_path(spark, "sheet")
    rows = [("1", "AMKCR01"), ("1", "SEMCR01"), (None, "X"), ("2", None), ("x", "Y")]
    spark.createDataFrame(rows, "ACCESSION_NO string, WORKPLACE string").coalesce(1).write.option("header", True).csv(path)
    table = StudyTable(spark, scratch_path(spark, "table"))
    first = {r.outcome: r.lines for r in imports.import_file(table, path, "a").collect()}
    assert first == {"new": 2, "duplicate": 1, "invalid": 2}
    again = {r.outcome: r.lines for r in imports.import_file(table, path, "b", "update").collect()}
    assert again == {"updated": 2, "duplicate": 1, "invalid": 2}
    assert sorted((r.accession_no, r.workplace) for r in table.read().collect()) == [(1, "AMKCR01"), (2, None)]
    with pytest.raises(ValueError):
        imports.import_file(table, path, "c", "replace")


def test_label_lines_count_through_all_parts(spark):
    path = scratch_path(spark, "labels")
    spark.range(40).selectExpr("cast(id as string) study", "'1' verdict").repartitionByRange(4, "study").sortWithinPartitions("study") \
        .write.option("header", True).csv(path)
    got = sorted((r.row_no, r.study) for r in exports.read_labels(spark, path).collect())
    assert got == [(i + 2, s) for i, s in enumerate(sorted(str(i) for i in range(40)))]


@pytest.mark.parametrize("sort", ["nodule", "-nodule"])
def test_deep_pages_order_nulls_and_nan(spark, monkeypatch, sort):
    monkeypatch.setattr(filters, "rows_from", partial(selection.rows_from, top_rows=5, sample=64, splitters=5))
    value = "case when id % 7 = 0 then null when id % 5 = 0 then double('NaN') else double(id % 11) end"
    df = spark.range(200).selectExpr("id as accession_no", f"{value} as nodule")
    whole = [r.accession_no for r in df.orderBy(*filters.sort_columns(sort)).collect()]
    for number in (1, 2, 4, 8, 16, 20):
        got = [r.accession_no for r in filters.page(df, number, 10, sort).collect()]
        assert got == whole[number * 10 - 10 : number * 10]


def test_both_modes_import_one_file_and_keep_no_copies(spark):
    def scratch():
        root = pathlib.Path(scratch_root(spark).removeprefix("file:"))
        return Counter(p.name.rpartition("-")[0] for p in root.iterdir()) if root.exists() else Counter()

    before = scratch()
    with settings(spark, {"spark.sql.files.openCostInBytes": "4k"}):  # the file is read by ranges
        counts = queries_import.import_file_counts(spark, "/root/testdata/sf0.001").collect()
    left = scratch() - before
    assert len(counts) == 8 and left["import-file"] == 1 and left["import-skip"] == left["import-update"] == 1
    assert not {"csv-records", "import-lines", "import", "insert", "upsert", "before", "differences"} & left.keys()
