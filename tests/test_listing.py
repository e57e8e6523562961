import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from auditlake.operators import filters as P
from auditlake.operators import sampling, selection


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    data = [
        (i, rng.choice(["AMKCR01", "SEMCR01", "tpyCR01", "ZZZ", None]), rng.choice([None, 1.0, 2.0, rng.random() * 50]),
         rng.choice([0, 1, None]), rng.choice(["text", "", None]), 1_700_000_000 + rng.randrange(10**7))
        for i in range(3000)
    ]
    df = spark.createDataFrame(data, "accession_no long, workplace string, nodule double, gt_manual int, text_report string, t long")
    return df.select("*", F.timestamp_seconds("t").alias("procedure_start_date"), F.timestamp_seconds("t").alias("created_at")).cache()


@pytest.mark.parametrize("sort", ["nodule", "-nodule", "workplace", "-workplace", "procedure_start_date", "nonsense"])
@pytest.mark.parametrize("number", [1, 4, 7, 300, 9999])
def test_deep_pages_equal_sorted_slices(rows, monkeypatch, sort, number):
    monkeypatch.setattr(P, "rows_from", partial(selection.rows_from, top_rows=5, sample=64, splitters=5))
    got = [r["accession_no"] for r in P.page(rows, number, 10, sort).collect()]
    ordered = [r["accession_no"] for r in rows.orderBy(*P.sort_columns(sort)).select("accession_no").collect()]
    offset = min(number - 1, 299) * 10
    assert got == ordered[offset:offset + 10]


def test_page_size_is_clamped(rows):
    assert P.page(rows, 1, 1).count() == 10
    assert P.page(rows, 1, 5000).count() == 500
    assert P.page(rows.limit(0), 5, 50).count() == 0


def test_filters(spark, rows):
    all_ = rows.collect()
    known = {"AMKCR01", "SEMCR01"}
    assert rows.where(P.site_filter("OTH")).count() == sum(r["workplace"] not in known for r in all_)
    assert rows.where(P.site_filter("AMK,OTH")).count() == sum(r["workplace"] != "SEMCR01" for r in all_)
    assert rows.where(P.site_filter("nowhere")).count() == 0
    assert rows.where(P.site_filter(" , ")).count() == 3000
    assert rows.where(P.priority_workplace()).count() == sum((r["workplace"] or "").upper()[:3] in ("AMK", "TPY") for r in all_)
    assert rows.where(~P.priority_workplace()).count() + rows.where(P.priority_workplace()).count() == 3000
    assert P.apply_filters(rows, equals={"gt_manual": P.NULL}).count() == sum(r["gt_manual"] is None for r in all_)
    assert rows.where(P.search("100%", ["workplace"])).count() == 0
    with pytest.raises(ValueError):
        P.apply_filters(rows, equals={"text_report": "x"})


def test_date_range_reaches_the_scan(spark, tmp_path, rows):
    rows.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(P.date_range("procedure_start_date", "2023-12-01", "2023-12-31"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(procedure_start_date" in plan and "LessThan(procedure_start_date" in plan
    days = {str(r[0]) for r in df.select(F.to_date("procedure_start_date")).distinct().collect()}
    assert min(days) == "2023-12-01" and max(days) == "2023-12-31"


def test_friday_range(spark):
    days = ["2026-02-26", "2026-02-27", "2026-02-28"]  # Thursday, Friday, Saturday
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("d"))
    first, last = P.friday_range(F.col("d"))
    got = [tuple(map(str, r)) for r in df.select(first, last).collect()]
    assert got == [("2026-02-13", "2026-02-20"), ("2026-02-13", "2026-02-20"), ("2026-02-20", "2026-02-27")]


@pytest.mark.parametrize(
    "count,priority,other,want", [(5, 1, 10, (1, 4)), (10, 8, 2, (8, 2)), (7, 50, 50, (3, 4)), (99, 4, 5, (4, 5)), (1, 3, 0, (1, 0))]
)
def test_sample_sizes(spark, count, priority, other, want):
    pool = spark.createDataFrame([(priority, other)], "priority_count long, other_count long")
    r = sampling.sample_sizes(pool, count).first()
    assert (r["priority_take"], r["other_take"]) == want


def test_sample_is_exact_distinct_and_stable(rows):
    drawn = sampling.stratified_sample(rows, count=200)
    keys = [r["accession_no"] for r in drawn.collect()]
    assert len(keys) == len(set(keys)) == 200
    again = sampling.stratified_sample(rows.repartition(13), count=200)
    assert sorted(r["accession_no"] for r in again.collect()) == sorted(keys)
    other = sampling.stratified_sample(rows, count=200, seed=7)
    assert sorted(r["accession_no"] for r in other.collect()) != sorted(keys)
    assert {r["stratum"]: r["count"] for r in drawn.groupBy("stratum").count().collect()} == {"priority": 100, "other": 100}
    whole = sampling.stratified_sample(rows, pct=100)
    assert whole.count() == rows.where(P.unlabelled()).count()


def test_recommended_size_is_at_least_one(rows):
    r = sampling.sampling_pool(rows.limit(0)).first()
    assert (r["total"], r["recommended_count"]) == (0, 1)


def test_selection_on_timestamps_and_common_prefixes(spark):
    """Every rank lands near its row, so the last step sorts few rows; microseconds and long common prefixes included."""
    df = spark.range(5000).selectExpr(
        "id as accession_no", "timestamp_micros(1700000000000000 + (id * 7919) % 3000) as at", "concat(repeat('prefix-', 9), lpad(cast((id * 31) % 977 as string), 4, '0')) as name")
    for keys in ([selection.Key("at", True), selection.Key("accession_no")], [selection.Key("name"), selection.Key("accession_no", True)]):
        order = selection.Order(df, keys)
        whole = [tuple(r) for r in df.orderBy(*order.columns()).select(*order.values()).collect()]
        for rank in (0, 1, 5, 6, 2499, 4994, 4999):
            place = selection.locate(df, keys, rank, 5000, top_rows=5, sample=100, splitters=8)
            assert place.skip <= 5
            got = df.where(place.rest(order)).orderBy(*order.columns()).offset(place.skip).limit(1).select(*order.values()).first()
            assert tuple(got) == whole[rank]


def test_selection_among_equal_rows(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "cast(null as string) as t")
    keys = [selection.Key("t"), selection.Key("k")]
    got = [r["k"] for r in selection.rows_from(df, keys, 600, 3, 1000, top_rows=5, sample=20, splitters=3).collect()]
    assert got == [1, 1, 1]
    assert selection.rows_from(df.limit(0), keys, 0, 3, 0).count() == 0
    assert selection.rows_from(df, keys, 5000, 3, 1000, top_rows=5).count() == 0
