"""Large CSV files by ranges: equal to the one-task reader."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators.intake import ROW_ORDER
from auditlake.session import settings
from auditlake.sources import exports, ranges

TINY = {"spark.sql.files.maxPartitionBytes": "200b", "spark.sql.files.openCostInBytes": "16b"}


def sheet(mode: str, seed: int, rows: int) -> str:
    r = random.Random(seed)
    line = "\r\n" if mode == "crlf" else "\n"

    def field():
        kind = r.random()
        if kind < 0.3:
            return "".join(r.choice("ab ") for _ in range(r.randint(0, 6)))
        if kind < 0.4 and mode == "stray":
            return "a" + "".join(r.choice('ab"') for _ in range(4))
        odd = ["\r\n", "\r"] if mode == "mixed" else []
        size = r.choice([0, 1, 5, 30, 30, 900 if r.random() < 0.1 else 10])
        return '"' + "".join(r.choice(["a", "b", ",", '""', line, " ", line, '""', *odd]) for _ in range(size)) + '"'

    lines = ["k,x,y"]
    for i in range(rows):
        lines.append(f"{i},{field()},{field()}")
        if r.random() < 0.05:
            lines.append("")
    return line.join(lines) + (line if r.random() < 0.7 else "")


def values(df):
    return [tuple(r)[:-1] for r in sorted(df.collect(), key=lambda r: r[ROW_ORDER])]


@pytest.mark.parametrize("mode", ["plain", "stray", "crlf", "mixed"])
def test_ranges_equal_one_task(spark, tmp_path, mode):
    for seed, rows in ((1, 3), (2, 80)):
        path = tmp_path / f"{mode}-{seed}.csv"
        path.write_bytes(sheet(mode, seed, rows).encode())
        with settings(spark, TINY):
            parts = spark.read.text(str(path)).rdd.getNumPartitions()
            split = values(exports.read_import(spark, str(path), split=True)) if "ACCESSION_NO" in path.read_text() else values(exports.read_scores(spark, [str(path)], split=True))
        assert parts > 1
        assert split == values(exports.read_scores(spark, [str(path)], split=False))


def test_a_field_longer_than_ranges(spark, tmp_path):
    long = "x,\n" * 400 + 'end ""q""'
    path = tmp_path / "long.csv"
    path.write_text(f'k,x,y\n1,"{long}",a\n2,b,"c\n"\n3,"{long}","{long}"\n')
    with settings(spark, TINY):
        rows = values(exports.read_scores(spark, [str(path)], split=True))
        cut = ranges.read_records(spark, [str(path)])
        assert cut.where("block > 0").count() < 4
    text = long.replace('""', '"')
    assert rows == [("1", text, "a"), ("2", "b", "c\n"), ("3", text, text)]


def test_empty_and_header_only(spark, tmp_path):
    for name, text in (("head.csv", "k,x\n"), ("bom.csv", "﻿k,x\n1,2\n")):
        (tmp_path / name).write_text(text, "utf-8")
    assert values(exports.read_scores(spark, [str(tmp_path / "head.csv")], split=True)) == []
    bom = exports.read_scores(spark, [str(tmp_path / "bom.csv")], split=True)
    assert bom.columns[:2] == ["k", "x"] and values(bom) == [("1", "2")]


def test_line_numbers_over_files_and_ranges(spark, tmp_path):
    folder = tmp_path / "labels"
    folder.mkdir()
    (folder / "a.csv").write_text("k,v\n" + "".join(f'{i},"x\n{i}"\n' for i in range(60)))
    (folder / "b.csv").write_text("k,v\n" + "".join(f"{i},y\n" for i in range(60, 90)))
    with settings(spark, TINY):
        rows = exports.read_labels(spark, str(folder), split=True)
        assert rows.where(F.col("k").cast("long") + 2 != F.col("row_no")).count() == 0 and rows.count() == 90


def test_only_files_that_spark_would_cut(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("k,x\n" + "1,2\n" * 100)
    assert not ranges.would_cut(spark, [str(path)])
    with settings(spark, TINY):
        assert ranges.would_cut(spark, [str(path)]) and ranges.would_cut(spark, [str(tmp_path)])


@pytest.mark.parametrize("line,inside,open_", [
    ('a,b', False, False), ('a,"b', False, True), ('"a""b",c', False, False), ('a"b,c"d', False, False), ('b",c', True, False),
    ('b",c,"d', True, True), ('', True, True), ('b""', True, True), ('"a" x,"b', False, True), ('"a"x"', False, False),
])
def test_leaves_open(line, inside, open_):
    assert ranges.leaves_open(line, inside) is open_


def test_records_without_quotes(spark, tmp_path):
    path = tmp_path / "simple.csv"
    path.write_bytes(b"k,x,y\n1,2,3\n,,\n 4 ,  \n5\n6,,7,8,9\n,\n10,a b,\xc3\xa9\n \n#,x,\\\n" + b"11,'q',-\n" * 30)
    with settings(spark, TINY):
        split = values(exports.read_scores(spark, [str(path)], split=True))
    assert split == values(exports.read_scores(spark, [str(path)], split=False)) and ("6", None, "7") in split
