"""Weekly cells: replays, writers at once, odd rows."""

from pyspark.sql import functions as F

from auditlake.sources.manifests import Manifests
from auditlake.streaming.cells import WeeklyCells, weekly_confusion

ROWS = "t string, site string, label int, prediction int"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS).withColumn("ts", F.to_timestamp("t"))


def merge(book, df, number, stream="s"):
    return book.merge(df, number, stream, "ts", F.col("site"), F.col("label"), F.col("prediction"))


def content(book):
    return sorted(((str(r.week), r.site, r.label, r.prediction, r.n) for r in book.totals().collect()), key=str)


def test_batches_add_up_and_replays_change_nothing(spark, tmp_path):
    book = WeeklyCells(spark, str(tmp_path / "cells"))
    assert content(book) == [] and book.applied("s") == -1
    first = batch(spark, ("2024-01-01", "A", 1, 1), ("2024-01-07", "A", 1, 1), ("2024-01-08", "A", 0, 1), (None, "A", 1, 1), ("2024-01-01", "A", None, 1), ("2024-01-01", None, 0, 0))
    assert merge(book, first, 0)
    want = [("2024-01-01", "A", 1, 1, 2), ("2024-01-01", None, 0, 0, 1), ("2024-01-08", "A", 0, 1, 1)]
    assert content(book) == sorted(want, key=str)
    assert not merge(book, first, 0) and set(content(book)) == set(want)
    assert merge(book, batch(spark, ("2024-01-02", "A", 1, 1)), 1) and merge(book, batch(spark, ("2024-01-02", "A", 1, 1)), 0, "other")
    assert ("2024-01-01", "A", 1, 1, 4) in content(book) and book.applied("s") == 1
    got = {(str(r.week), r.site): (r.tp, r.tn, r.fp, r.fn) for r in weekly_confusion(book.totals(), "site").collect()}
    assert got == {("2024-01-01", "A"): (4, 0, 0, 0), ("2024-01-01", None): (0, 1, 0, 0), ("2024-01-08", "A"): (0, 0, 1, 0)}


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    book, other = WeeklyCells(spark, str(tmp_path / "cells")), WeeklyCells(spark, str(tmp_path / "cells"))
    publish, tried = Manifests.publish, []

    def late(self, snapshot):
        if self is book.manifests and not tried:
            tried.append(1)
            assert merge(other, batch(spark, ("2024-01-01", "B", 1, 1)), 0, "theirs")
        return publish(self, snapshot)

    monkeypatch.setattr(Manifests, "publish", late)
    assert merge(book, batch(spark, ("2024-01-01", "B", 1, 1)), 0, "ours")
    assert content(book) == [("2024-01-01", "B", 1, 1, 2)] and (book.applied("ours"), book.applied("theirs")) == (0, 0)
