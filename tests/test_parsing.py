import datetime as dt

import pytest
from pyspark.sql import functions as F

from auditlake.functions import parsing as P
from auditlake.functions import text


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_accession_spellings(spark):
    texts = ["12", "12.0", " 12 ", "12.7", "9007199254740993", "x12", "", "12d", "NaN", "1e3", None]
    assert values(spark, texts, P.accession) == [12, 12, 12, 12, 9007199254740993, None, None, None, None, 1000, None]


def test_bool_to_int(spark):
    texts = ["True", "FALSE", "1.0", " 0 ", "3", "2.9", "yes", "", None]
    assert values(spark, texts, P.bool_to_int) == [1, 0, 1, 0, 3, 2, None, None, None]


def test_duration_seconds(spark):
    texts = ["0 days 00:03:00", "-1 days +23:59:00", "00:00:01.5", "2 days", "1 day, 01:00:00", "-1 days 02:00:00", "75", "soon", "", None]
    assert values(spark, texts, P.duration_seconds) == [180.0, -60.0, 1.5, 172800.0, 90000.0, -93600.0, 75.0, None, None, None]


def test_format_duration(spark):
    df = spark.createDataFrame([(None,), (45.0,), (59.5,), (245.0,), (4500.0,), (3600.0,)], "s double")
    shown = [r[0] for r in df.select(P.format_duration(F.col("s"))).collect()]
    assert shown == ["—", "45s", "1m 00s", "4m 05s", "1h 15m", "1h 00m"]


def test_timestamps_are_lenient(spark):
    texts = ["2024-02-03 04:05:06", "2024-02-03", "02/03/2024", "03-Feb-2024 04:05:06", "2024-02-03T04:05:06Z", "tomorrow", ""]
    got = values(spark, texts, P.timestamp)
    day, full = dt.datetime(2024, 2, 3), dt.datetime(2024, 2, 3, 4, 5, 6)
    assert got == [full, day, day, full, full, None, None]


def test_clean_report(spark):
    raw = "CHEST of 12-Jan-2024:\nAccession No:123X\n\n\n Clear lungs.\n\nNo effusion. \n "
    assert values(spark, [raw, None, " \n "], text.clean_report) == ["Clear lungs.\nNo effusion.", None, ""]


def test_struct_list_accepts_printed_records(spark):
    texts = ["[{'a': 'x', 'b': None}]", "[{\"a\": \"o'k\", 'b': 'None left'}]", "None", "junk", None]
    got = values(spark, texts, lambda c: P.struct_list(c, "struct<a:string,b:string>"))
    assert [[tuple(r) for r in x] for x in got] == [[("x", None)], [("o'k", "None left")], [], [], []]


@pytest.mark.parametrize(
    "reply,value,status",
    [
        ('{"grade": 3}', 3, "ok"),
        ('Sure:\n{"grade": 4}\nDone', 4, "extracted"),
        ("no braces", None, "failed"),
        ('{"grade": ', None, "failed"),
        (None, None, "failed"),
    ],
)
def test_model_reply(spark, reply, value, status):
    row = values(spark, [reply], lambda c: P.model_reply(c, "grade int"))[0]
    assert (row["value"]["grade"] if row["value"] else None, row["status"]) == (value, status)


def test_every_date_part_takes_every_clock(spark):
    texts = {"3 Jan 2024 9:05:10": "09:05:10", "3-Jan-2024 9:05:10": "09:05:10", "Jan 3, 2024 09:05:10": "09:05:10",
             "3 Jan 2024 9:05 AM": "09:05:00", "1/3/24": "00:00:00", "January 3, 2024 12:05 am": "00:05:00", "3 Jan 24 12:05:01 PM": "12:05:01"}
    df = spark.createDataFrame([(t,) for t in [*texts, "3 Jan 2024 13:05 PM", "-", "", None]], "t string").withColumn("at", P.timestamp(F.col("t")))
    got = {r.t: str(r.at) for r in df.where("at is not null").collect()}
    assert got == {t: f"2024-01-03 {c}" for t, c in texts.items()}
    assert df.agg(P.count_unparsed(F.col("t"), F.col("at"))).first()[0] == 1
    assert str(spark.range(1).select(P.timestamp(F.lit("5-Jan-99"))).first()[0]) == "1999-01-05 00:00:00"
