import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from auditlake.functions import stats
from auditlake.operators import confusion, ordering, timing, trends


def exact_p(b, c):
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    return min(1.0, float(2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n))


def test_mcnemar_matches_the_binomial_sum(spark):
    random.seed(3)
    pairs = [(0, 0), (1, 0), (3, 12), (10, 10), (40, 70), (600, 800), (0, 40), (15, 16), (14, 300), (2500, 2600)]
    pairs += [(random.randrange(400), random.randrange(400)) for _ in range(30)]
    df = spark.createDataFrame(pairs, "b long, c long").withColumn("p", stats.mcnemar_p(F.col("b"), F.col("c")))
    for r in df.collect():
        assert r["p"] == pytest.approx(exact_p(r["b"], r["c"]), rel=1e-9), r


def test_mcnemar_of_billions_stays_cheap(spark):
    df = spark.createDataFrame([(10**9, 10**9 + 60_000)], "b long, c long")
    p = df.select(stats.mcnemar_p(F.col("b"), F.col("c"))).first()[0]
    z = (60_000 - 1) / math.sqrt(2 * 10**9 + 60_000)
    assert p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_confusion_against_plain_counting(spark):
    random.seed(5)
    rows = [(random.choice("ab"), random.choice([0, 1, None]), random.choice([0, 1, None, 2])) for _ in range(300)]
    df = spark.createDataFrame(rows, "site string, g int, p int")
    got = {r["site"]: r for r in confusion.site_confusion_metrics(df, "g", "p").collect()}
    for site in ("a", "b", "OVERALL"):
        part = [(g, p) for s, g, p in rows if site in (s, "OVERALL")]
        tp, tn, fp, fn = (part.count(x) for x in ((1, 1), (0, 0), (0, 1), (1, 0)))
        r = got[site]
        assert (r["tp"], r["tn"], r["fp"], r["fn"], r["n"]) == (tp, tn, fp, fn, tp + tn + fp + fn)
        assert r["accuracy"] == pytest.approx((tp + tn) / (tp + tn + fp + fn))
        assert r["balanced_accuracy"] == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2)
        assert r["pct_normal"] == pytest.approx((tn + fn) / r["n"] * 100)
    assert sum(got[s]["n"] for s in "ab") == got["OVERALL"]["n"]


def test_one_class_and_empty_groups_give_zeros(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("b", None, 1)], "site string, g int, p int")
    got = {r["site"]: r.asDict() for r in confusion.site_confusion_metrics(df, "g", "p").collect()}
    assert got["a"]["specificity"] == 0 and got["a"]["sensitivity"] == 1
    assert got["b"]["n"] == 0 and got["b"]["accuracy"] == 0
    assert confusion.site_confusion_metrics(df.limit(0), "g", "p").count() == 0


def test_kappa(spark):
    rows = [(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15
    row = confusion.agreement(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()
    assert row["kappa"] == pytest.approx(0.4) and row["agreement_pct"] == pytest.approx(70)
    same = confusion.agreement(spark.createDataFrame([(1, 1)] * 3, "a int, b int"), "a", "b").first()
    assert same["kappa"] == 0


def test_contingency_is_dense(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 0, 1), (None, 1, 1)], "t int, a int, b int")
    got = {(r["first_correct"], r["second_correct"]): r["n"] for r in confusion.contingency(df, "t", "a", "b").collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (1, 0): 0, (1, 1): 1}


GROUPS = {
    "one": [7.0],
    "two": [1.0, 5.0],
    "three": [3.0, 4.0, 10.0],
    "four": [1.0, 2.0, 3.0, 4.0],
    "ties": [2.0] * 50 + [9.0] * 3,
    "spread": [random.Random(1).uniform(-1e6, 1e9) for _ in range(501)],
    "small": [random.Random(2).uniform(-1, 1) for _ in range(400)],
    "skewed": [60.0] * 900 + [random.Random(4).expovariate(1 / 500) for _ in range(300)],
}


@pytest.fixture(scope="module")
def grouped(spark):
    rows = [(g, v) for g, vs in GROUPS.items() for v in vs]
    random.Random(9).shuffle(rows)
    rows += [("one", None), ("two", float("nan"))]
    return spark.createDataFrame(rows, "metric string, seconds double").repartition(7)


@pytest.mark.parametrize("few", [True, False])
def test_quantiles_match_the_standard_library(grouped, few):
    got = {r["metric"]: r for r in timing.time_stats(grouped, few_groups=few).collect()}
    assert set(got) == set(GROUPS)
    for g, vs in GROUPS.items():
        r, single = got[g], len(vs) == 1
        q4 = [vs[0]] * 3 if single else statistics.quantiles(vs, n=4)
        q20 = [vs[0]] * 19 if single else statistics.quantiles(vs, n=20)
        want = [q20[0], *q4, q20[18]]
        assert [r[c] for c in ("p5", "p25", "median", "p75", "p95")] == pytest.approx(want), g
        assert r["count"] == len(vs) and r["mean"] == pytest.approx(statistics.mean(vs))
        assert (r["min"], r["max"]) == (min(vs), max(vs))
        assert r["more_than_5_min"] == sum(v > 300 for v in vs)
        assert r["above_p95"] == sum(v >= r["p95"] for v in vs), g


def test_box_plot(grouped):
    got = {r["metric"]: r for r in timing.box_plot_stats(grouped).collect()}
    for g, vs in GROUPS.items():
        s, n, r = sorted(vs), len(vs), got[g]
        q1, med, q3 = (s[math.floor(n * p)] for p in (0.25, 0.5, 0.75))
        low, high = max(s[0], q1 - 1.5 * (q3 - q1)), min(s[-1], q3 + 1.5 * (q3 - q1))
        assert (r["q1"], r["med"], r["q3"]) == (q1, med, q3)
        assert (r["whisker_low"], r["whisker_high"]) == pytest.approx((low, high))
        assert r["outliers"] == sum(v < low or v > high for v in vs)


def test_value_buckets_keep_the_order(spark):
    values = sorted([-1e300, -5.5, -0.1, -0.0, 0.0, 1e-9, 0.3, 1.0, 299.99, 300.0, 1e18, 1e308, float("inf")])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    buckets = [r[0] for r in df.select(ordering.value_bucket(F.col("v"))).collect()]
    assert buckets == sorted(buckets)


def test_time_summary_notes_when_nothing_is_late(spark):
    cols = "time_to_clinical_decision_seconds double, time_end_to_end_seconds double"
    df = spark.createDataFrame([(10.0, 0.0), (20.0, 30.0), (None, -5.0)], cols)
    got = {r["metric"]: r for r in timing.time_summary(df).collect()}
    assert got["tee"]["n"] == 2 and got["tee"]["note"] == "All 3 cases processed within 5 minutes"
    assert got["tcd"]["median"] == 15.0 and got["tcd"]["std"] == pytest.approx(statistics.stdev([10, 20]))


def weekly(spark, values):
    rows = [(f"2024-01-{1 + 7 * i:02d}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "d string, value double")
    return df.select(F.to_date("d").alias("week"), F.date_format(F.to_date("d"), "dd MMM").alias("week_label"), "value")


def test_control_band_leaves_out_the_last_week(spark):
    row = trends.control_band(weekly(spark, [80.0, 82.0, None, 84.0, 60.0])).first()
    base = [80.0, 82.0, 84.0]
    half = 1.96 * statistics.stdev(base) / math.sqrt(3)
    assert (row["lower"], row["upper"]) == (round(82 - half, 1), round(82 + half, 1))
    assert row["last_value"] == 60.0 and row["in_band"] is False and row["last_week_label"] == "29 Jan"


def test_control_band_needs_two_baseline_weeks(spark):
    row = trends.control_band(weekly(spark, [80.0, 90.0])).first()
    assert row["lower"] is None and row["in_band"] is None
    row = trends.control_band(weekly(spark, [80.0, 84.0, None])).first()
    assert row["lower"] is not None and row["last_value"] is None and row["in_band"] is None


def test_iso_week_across_the_year(spark):
    df = spark.sql("SELECT timestamp '2027-01-01 10:00:00' AS t")
    assert str(df.select(trends.week_start(F.col("t"))).first()[0]) == "2026-12-28"
