"""The study table's changes, writers and key index."""

import pytest
from pyspark.sql import functions as F

from auditlake.session import settings
from auditlake.sources import key_index
from auditlake.sources.manifests import Conflict, Manifests, Snapshot
from auditlake.sources.study_table import StudyTable

ROWS = "accession_no long, workplace string, gt_manual int, d string, seq int"


def rows(spark, data):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], ROWS)
    return df.withColumn("procedure_start_date", F.to_timestamp("d")).drop("d")


def content(table):
    return {r["accession_no"]: (r["workplace"], r["gt_manual"], str(r["procedure_start_date"])[:10]) for r in table.read().collect()}


@pytest.fixture()
def table(spark, tmp_path):
    t = StudyTable(spark, str(tmp_path / "table"), buckets=4)
    t.insert(rows(spark, [(i, f"W{i % 3}", None, f"2024-0{1 + i % 3}-05") for i in range(60)]), ["seq"], "b1")
    return t


def files(table, kind):
    import pathlib

    return sorted(str(p) for p in pathlib.Path(table.root, kind).rglob("*.parquet"))


def edits(spark, *data):
    return spark.createDataFrame([(*e, i) for i, e in enumerate(data)], "accession_no long, field string, value string, seq int")


def test_an_edit_writes_one_small_file(spark, table):
    before = files(table, "rows")
    table.edit(edits(spark, (7, "workplace", "Z")))
    assert files(table, "rows") == before and len(files(table, "changes")) == 1
    assert content(table)[7] == ("Z", None, "2024-02-05") and len(content(table)) == 60
    entry = [e for e in table.snapshot().entries if e["kind"] == "changes"]
    assert [(e["month"], e["columns"]) for e in entry] == [("2024-02", ["updated_at", "workplace"])]


def test_changes_apply_in_order_and_may_set_null(spark, table):
    table.edit(edits(spark, (7, "workplace", "Z"), (8, "gt_manual", "1")))
    table.edit(edits(spark, (7, "workplace", ""), (8, "workplace", "Q")))
    table.set_labels(spark.createDataFrame([(8, 0, 1), (8, 1, 2), (8, 0, 3)], "accession_no long, label int, row_no int"))
    got = content(table)
    assert got[7][0] is None and got[8][:2] == ("Q", 0) and got[9] == ("W0", None, "2024-01-05")


def test_deleted_keys_can_come_back_in_another_month(spark, table):
    table.edit(edits(spark, (5, "workplace", "Z")))
    table.delete(spark.createDataFrame([(5,), (6,)], "accession_no long"))
    assert not {5, 6} & set(content(table))
    table.insert(rows(spark, [(5, "new", 1, "2025-01-01"), (7, "no", 1, "2025-01-01")]), ["seq"], "b2")
    got = content(table)
    assert got[5] == ("new", 1, "2025-01-01") and got[7] == ("W1", None, "2024-02-05") and 6 not in got
    table.edit(edits(spark, (5, "procedure_start_date", "2024-03-09 00:00:00")))
    assert content(table)[5] == ("new", 1, "2024-03-09")
    assert [r["accession_no"] for r in table.read_period("2025-01-01", "2025-12-31").collect()] == []
    assert 5 in [r["accession_no"] for r in table.read_period("2024-03-01", "2024-03-31").collect()]


def test_compaction_keeps_content_and_drops_changes(spark, table):
    table.edit(edits(spark, (7, "workplace", "Z")))
    table.delete(spark.createDataFrame([(i,) for i in range(0, 60, 3)], "accession_no long"))
    table.insert(rows(spark, [(100, "N", 1, "2024-02-20")]), ["seq"], "b2")
    before = content(table)
    table.compact()
    entries = table.snapshot().entries
    assert content(table) == before and {e["kind"] for e in entries} == {"rows"}
    assert len(entries) == len({e["month"] for e in entries}) == 2  # all of January is gone
    version = table.snapshot().version
    table.compact()
    assert table.snapshot().version == version
    table.edit(edits(spark, (7, "workplace", "Y")))
    assert content(table)[7][0] == "Y"


def test_two_writers_lose_nothing(spark, table, monkeypatch):
    other = StudyTable(spark, table.root)
    tried = []
    publish = Manifests.publish

    def late(self, snapshot: Snapshot):
        """Before the first writer publishes, the second does: the same keys, and other ones."""
        if self is table.manifests and not tried:
            tried.append(1)
            other.edit(edits(spark, (7, "gt_manual", "1")))
            other.insert(rows(spark, [(200, "B", 1, "2024-01-01")]), ["seq"], "other")
        return publish(self, snapshot)

    monkeypatch.setattr(Manifests, "publish", late)
    table.insert(rows(spark, [(200, "A", 0, "2024-01-01"), (201, "A", 0, "2024-01-01")]), ["seq"], "mine")
    got = content(table)
    assert got[200] == ("B", 1, "2024-01-01") and got[201] == ("A", 0, "2024-01-01") and got[7][1] == 1 and len(got) == 62


def test_a_lost_race_for_a_number_takes_the_next(spark, table):
    now = table.snapshot()
    assert table.manifests.publish(Snapshot(now.version + 1, now.buckets, now.entries))
    assert not table.manifests.publish(Snapshot(now.version + 1, now.buckets, []))
    assert table.snapshot().version == now.version + 1 and len(content(table)) == 60


def test_publishing_by_rename_refuses_a_taken_number(spark, tmp_path, monkeypatch):
    def by_rename(self, own, name):
        import pathlib

        fs = self._fs(self._path())
        return self._rename(fs, self._path(pathlib.Path(own).name), self._path(name))

    book = Manifests(spark, str(tmp_path / "m"))
    monkeypatch.setattr(Manifests, "_link", by_rename)
    assert book.publish(Snapshot(1, 2, [{"kind": "rows", "month": "a"}])) and not book.publish(Snapshot(1, 3, []))
    assert book.latest() == Snapshot(1, 2, [{"kind": "rows", "month": "a"}]) and book.versions() == [1]


def test_endless_conflicts_end_in_an_error(spark, table, monkeypatch):
    monkeypatch.setattr(Manifests, "publish", lambda self, snapshot: False)
    monkeypatch.setattr("auditlake.sources.study_table.RETRIES", 2)
    calls = []

    def snapshot():
        now = Manifests.latest(table.manifests)
        calls.append(1)
        if len(calls) % 2 == 0:
            now.entries = [{**e, "version": 99} for e in now.entries]
        return now

    monkeypatch.setattr(table, "snapshot", snapshot)
    with pytest.raises(Conflict):
        table.edit(edits(spark, (7, "workplace", "Z")))


def test_readers_open_one_manifest_after_many_commits(spark, table, monkeypatch):
    now = table.snapshot()
    for v in range(2, 203):
        assert table.manifests.publish(Snapshot(v, now.buckets, now.entries))
    opened = []
    load = Manifests.load
    monkeypatch.setattr(Manifests, "load", lambda self, version: opened.append(version) or load(self, version))
    assert table.read().count() == 60 and opened == [202]


def test_only_files_that_may_hold_the_keys_are_opened(spark, table):
    table.insert(rows(spark, [(i, "L", None, "2024-01-09") for i in range(1000, 1400)]), ["seq"], "b2")
    keys = spark.createDataFrame([(1003,), (5000,), (None,)], "accession_no long")
    found = table.candidates(keys)
    assert sum(map(len, found.values())) == 1 < len(files(table, "rows"))
    got = table.rows_of(keys)
    assert {f.rsplit("/", 1)[1] for f in got.inputFiles()} == {f.rsplit("/", 1)[1] for names in found.values() for f in names}
    assert [r["accession_no"] for r in got.collect()] == [1003]
    assert table.candidates(spark.createDataFrame([(10**12,)], "accession_no long")) == {}
    assert table.candidates(spark.createDataFrame([(None,)], "accession_no long")) == {}


def test_filters_have_no_false_negatives_and_few_false_positives():
    import numpy as np

    r = np.random.default_rng(1)
    inside, outside = r.integers(-(2**63), 2**63 - 1, 5000), r.integers(-(2**63), 2**63 - 1, 20000)
    data = key_index.bloom(inside)
    assert key_index.may_hold(data, inside).all() and key_index.may_hold(data, outside).mean() < 0.03
    assert not key_index.may_hold(key_index.bloom(inside[:0]), inside).any()


def test_an_empty_table_and_empty_batches(spark, tmp_path):
    t = StudyTable(spark, str(tmp_path / "none"))
    assert t.read().count() == 0 and t.read_period("2024-01-01", "2024-12-31").count() == 0
    t.insert(rows(spark, []), ["seq"], "b")
    t.delete(spark.createDataFrame([(1,)], "accession_no long"))
    t.compact()
    assert t.snapshot().version == 0 and t.months() == []


def test_scratch_is_removed_on_request(spark, monkeypatch, tmp_path):
    import pathlib

    from auditlake import session

    monkeypatch.setattr(session, "scratch_root", lambda spark: f"{tmp_path}/scratch")
    assert session.materialize(spark.range(3), "few").count() == 3 and list(pathlib.Path(tmp_path, "scratch").iterdir())
    session.clear_scratch(spark)
    session.clear_scratch(spark)
    assert not pathlib.Path(tmp_path, "scratch").exists()


def plan(df):
    return df._jdf.queryExecution().toString()


def test_the_index_is_built_without_gathering_a_file_and_in_parts(spark, table, monkeypatch):
    monkeypatch.setattr(key_index, "PART_KEYS", 100)
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "50"}):
        table.insert(rows(spark, [(i, "L", None, "2024-01-09") for i in range(1000, 1400)]), ["seq"], "b2")
    index = spark.read.option("recursiveFileLookup", True).parquet(f"{table.root}/keys").where("low >= 1000")
    assert index.count() >= 4 and index.agg(F.sum("rows")).first()[0] == 400 and index.agg(F.max("rows")).first()[0] <= 150
    assert sum(e["rows"] for e in table.snapshot().entries) == 460
    written = spark.range(5).select(F.col("id").alias("k"), *[F.lit("x").alias(c) for c in ("file", "folder", "month")], F.lit(0).alias("bucket"))
    assert "Exchange" not in plan(key_index.index_files(written, "k"))


def test_many_keys_open_the_files_of_their_stretches(spark, table, monkeypatch):
    """More keys of a bucket than are probed: no file that holds one is missed, and no task gathers them."""
    for first in (1000, 5000, 9000):
        table.insert(rows(spark, [(i, "L", None, "2024-01-09") for i in range(first, first + 40)]), ["seq"], f"b{first}")
    keys = spark.createDataFrame([(k,) for k in [*range(1000, 1040), *range(9000, 9040)] * 2], "accession_no long")
    probed = table.candidates(keys)
    monkeypatch.setattr(key_index, "PROBED_KEYS", 3)
    found = table.candidates(keys)
    assert found == probed and len(found) == 2
    assert sorted(r["accession_no"] for r in table.rows_of(keys).collect()) == [*range(1000, 1040), *range(9000, 9040)]
    ends = spark.createDataFrame([(-(2**63),), (2**63 - 1,), (5010,), (5011,)], "accession_no long")
    assert [r["accession_no"] for r in table.rows_of(ends).orderBy("accession_no").collect()] == [5010, 5011]
