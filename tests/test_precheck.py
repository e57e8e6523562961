"""The pre-check of uploads against hand-written files."""

import csv
import io
import random

from pyspark.sql import functions as F

from auditlake import schema as S
from auditlake.session import settings
from auditlake.sources import precheck, strict
from auditlake.sources.study_table import StudyTable


def test_files_of_all_kinds(spark, tmp_path, monkeypatch):
    table = StudyTable(spark, str(tmp_path / "table"))
    rows = spark.createDataFrame([(i, 0) for i in range(5)], "accession_no long, seq int").withColumn("procedure_start_date", F.current_timestamp())
    table.insert(rows, ["seq"], "b")
    up = tmp_path / "my up loads"
    (up / "folder").mkdir(parents=True)
    (up / "r.csv").write_text('﻿ACCESSION_NO,TEXT_REPORT\n1,"a\nb"\n2.0,x\n\n7,y\n7,z\nbad,q\n', "utf-8")
    (up / "s.csv").write_text("Accession Number," + ",".join(S.FINDINGS) + "\n2,1\n9,1\n")
    (up / "other.csv").write_text("a,b\n1,2\n")
    (up / "latin.csv").write_bytes(b"ACCESSION_NO,TEXT_REPORT\n1,\xe9\n")
    (up / "none.csv").write_text("")
    (up / "book.xlsx").write_bytes(b"PK")
    (up / "folder" / "a.csv").write_text("ACCESSION_NO,TEXT_REPORT\n1,a\n")
    (up / "folder" / "b.csv").write_text("ACCESSION_NO,TEXT_REPORT\n1,a\n3,b\n")
    names = ["r.csv", "s.csv", "other.csv", "latin.csv", "none.csv", "book.xlsx", "folder"]

    def told():
        got = precheck.precheck(table, [str(up / n) for n in names]).collect()
        return {r["upload"]: (r["kind"], r["files"], r["rows"], r["accessions"], r["new"], r["existing"], r["error"]) for r in got}

    want = {
        0: ("reports", 1, 5, 3, 1, 2, None), 1: ("scores", 1, 2, 2, 1, 1, None), 2: ("unknown", 1, 1, 0, 0, 0, None),
        3: ("error", 1, 0, 0, 0, 0, "not UTF-8 at byte 27"), 4: ("error", 1, 0, 0, 0, 0, "empty file"),
        5: ("error", 1, 0, 0, 0, 0, "unsupported file type"), 6: ("reports", 2, 3, 2, 0, 2, None), -1: ("all", 8, 11, 5, 2, 3, None),
    }
    assert told() == want
    # Files that are too large for one task give the same.
    monkeypatch.setattr(precheck, "LARGE", 30)
    names[3:6] = []
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "20b", "spark.sql.files.openCostInBytes": "8b"}):
        small = told()
    assert {k: v for k, v in small.items() if k in (0, 1, 2)} == {k: want[k] for k in (0, 1, 2)} and small[3] == want[6]


def test_keys_of_a_file_are_told_as_they_are_read(monkeypatch):
    monkeypatch.setattr(precheck, "HELD_KEYS", 2)
    kind, missing, rows, error, keys = precheck.look("r.csv", "﻿ACCESSION_NO,TEXT_REPORT\n1,a\n1,b\n2,c\n3,d\n1,e\n".encode())
    assert (kind, missing, rows, error) == ("reports", "", 5, None) and iter(keys) is keys and list(keys) == ["1", "2", "3", "1"]
    broken = precheck.look("r.csv", b'ACCESSION_NO,TEXT_REPORT\n1,a\n2,"b')
    assert broken[:3] == ("error", "", 0) and broken[3].startswith("not CSV") and list(broken[4]) == []
    assert precheck.look("r.csv", b'ACCESSION_NO,TEXT_REPORT\n1,"a"b\n\xe9')[3] == "not UTF-8 at byte 32"


def test_a_file_with_its_content_is_a_batch_of_its_own():
    assert precheck.ONE_FILE["spark.sql.execution.arrow.maxRecordsPerBatch"] == "1"


def _odd_file(r: random.Random) -> bytes:
    """Files sound and broken: quotes, line breaks of all kinds, blank and short lines, text after quotes, open quotes, bytes that are no UTF-8."""
    key = r.choice(["ACCESSION_NO", "Accession Number", '"ACCESSION_NO"', "key"])
    header = r.choice([f"{key},TEXT_REPORT", f"TEXT_REPORT,{key}", f'"a\nb",{key},TEXT_REPORT', f"{key},{key},TEXT_REPORT"])
    end, odd = r.choice(["\n", "\n", "\r\n", "\r"]), r.random() < 0.3

    def cell() -> str:
        kind = r.random()
        if kind < 0.5:
            return str(r.randint(1, 30)) + r.choice(["", ".0", " "])
        if kind < 0.6:
            return r.choice(["", "x", 'a"b', "é", " "])
        text = "".join(r.choice(["a", ",", '""', end, "\r", "\n", "é", "1"]) for _ in range(r.choice([0, 1, 3, 12, 60])))
        return f'"{text}"' + (r.choice(["x", '"', ' "b"']) if odd and r.random() < 0.1 else "")

    lines = [header, *(r.choice(["", ",".join(cell() for _ in range(r.randint(1, 4))), ",".join(cell() for _ in range(3))]) for _ in range(r.randint(0, 25)))]
    content = (r.choice(["", "", end]) + end.join(lines) + r.choice(["", end, "\n\n"])).encode()
    content = r.choice([b"", b"", b"\xef\xbb\xbf"]) + content
    if r.random() < 0.15:
        at = r.randint(0, len(content))
        content = content[:at] + r.choice([b"\xe9", b"\xc3\n", b"\xff"]) + content[at:]
    return r.choice([content] * 12 + [b"\xef\xbb\xbf", b"\n\r\n", b"\n"])


def test_what_is_told_of_a_file_does_not_depend_on_its_size(spark, tmp_path, monkeypatch):
    table, r = StudyTable(spark, str(tmp_path / "table")), random.Random(5)
    up = tmp_path / "up #1 100%25"
    up.mkdir()
    names = [f"f{i}.csv" for i in range(20)] + ["g[1].csv", "late.csv", "open.csv", "book.xlsx"]
    for name in names:
        (up / name).write_bytes(_odd_file(r))
    (up / "late.csv").write_bytes(b"ACCESSION_NO,TEXT_REPORT\n" + b'1,"a\nb"\n' * 40 + b'2,"a"b\n' + b"3,c\n" * 40)
    (up / "open.csv").write_bytes(b"ACCESSION_NO,TEXT_REPORT\n" + b"1,c\n" * 40 + b'2,"a\n' + b"3,c\n" * 40)
    folders = [tmp_path / f"u{i}" for i in range(len(names))]
    for folder, name in zip(folders, names, strict=True):
        folder.mkdir()
        (up / name).rename(folder / name)
        (folder / "_log.csv").write_text("not an upload, " * 9)
    folders[0].rename(up / "u0")

    def told():
        got = precheck.precheck(table, [str(up / "u0"), *map(str, folders[1:])]).collect()
        return sorted(map(tuple, got), key=lambda row: row[0])

    small = told()
    assert len({row[-1] for row in small}) > 5 and sum(row[5] for row in small) > 30
    assert {names[row[0]]: row[-1] for row in small if row[0] > 20} == {
        "late.csv": "not CSV: ',' expected after '\"'", "open.csv": "not CSV: unexpected end of data", "book.xlsx": "unsupported file type"}
    monkeypatch.setattr(precheck, "LARGE", 0)
    assert told() == small
    with settings(spark, {"spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "60"}):  # ranges by the bytes of all files
        assert told() == small
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "90b", "spark.sql.files.openCostInBytes": "8b", "spark.sql.execution.arrow.maxRecordsPerBatch": "3"}):
        assert told() == small


def test_lines_are_read_as_by_the_csv_module():
    r = random.Random(3)
    for _ in range(20000):
        line = "".join(r.choice('ab,""\r') for _ in range(r.randint(0, 9)))
        for inside in (False, True):
            try:
                want = sum(map(bool, csv.reader(io.StringIO('"' * inside + line, newline=""), strict=True)))
                state = (False, want, False)
            except csv.Error as e:
                state = "end of data" in str(e), None, "expected after" in str(e)
            now, ended, _, broken = strict.read_line(line, inside)
            assert (now, broken) == (state[0], state[2]) and (state[1] is None or len(ended) == state[1])
