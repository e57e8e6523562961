"""Hard negatives against a brute-force version in plain integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import oracle
from auditlake.llm import hard_negatives as hn
from auditlake.llm.common import table


def brute(rows):
    """All pairs; rows (id, vector, label) as in the table."""
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    for n, (i, v, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, m, other) for m, (j, w, other) in enumerate(kept) if m != n]
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))
        for p in [x for x in scored if x[3] == label][:5]:
            hits = [x for x in scored if x[3] != label and 30 * p[0] <= 100 * x[0] <= 90 * p[0]][:10]
            out += [(i, p[1], rank, x[1], p[0], x[0]) for rank, x in enumerate(hits, 1)]
    return sorted(out, key=repr)


def mined(df, **options):
    rows = df.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
                     hn.quantised(F.col("embedding")).alias("vector"), F.lit(1).alias("row"), F.lit("x").alias("anchor"))
    return sorted((tuple(r) for r in hn.mine(rows, F.col("vec_id") % 100 == 0, **options).collect()), key=repr)


def odd_rows():
    r = random.Random(1)
    rows = []
    for i in range(900):
        v = [r.choice([0.0, 0.01, -0.02, 0.03, 1.0]) for _ in range(r.choice([3, 3, 3, 2, 5, 0]))]
        v = None if i % 50 == 3 else v
        if v and i % 50 in (4, 5, 6):
            v[0] = {4: float("nan"), 5: None, 6: float("inf")}[i % 50]
        rows.append((r.choice([i, i % 300, None, 0, 100]), v, r.choice([None, 0, 1, 2, 2, 2, 2, 9])))
    rows += [(5000 + i, [0.01, 0.0, 0.03], i % 2) for i in range(200)]  # one vector, many times
    return rows + [(100, [1e9, 3e8, -2e9], 2), (17, [3e9, 3e8, -2e9], 1), (18, [1e9, 3e8, -2e9], 2)]  # beyond exact doubles


SCHEMA = "vec_id long, embedding array<float>, label int"


def as_stored(rows):
    return [(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


@pytest.mark.parametrize("numbers", [hn.BLOCK_NUMBERS, 5 * 40])
def test_odd_rows_against_brute_force(spark, numbers):
    rows = odd_rows()
    if numbers < hn.BLOCK_NUMBERS:  # fewer anchors, so few walks
        rows = [x for x in rows if x[0] is None or x[0] % 100 or x[0] == 100]
    got = mined(spark.createDataFrame(rows, SCHEMA), block_numbers=numbers)
    assert len(got) > 1000 and got == brute(as_stored(rows))


def test_query_against_brute_force(spark):
    got = sorted((tuple(r) for r in entry.queries()["op13_hard_negatives"](spark, "/root/testdata/sf0.01").collect()), key=repr)
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, "/root/testdata/sf0.01", "embeddings").collect()]
    assert got == brute(rows) and len(got) > 100


def test_small_steps_and_partitions_change_nothing(spark, monkeypatch):
    rows = odd_rows()[::3]
    monkeypatch.setattr(hn, "SCORES", 60)
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(7, "label")) != [] and mined(spark.createDataFrame(rows, SCHEMA).coalesce(1)) == brute(as_stored(rows))


def test_empty_tables_and_no_anchors(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 1)], SCHEMA)) == []
    assert mined(spark.createDataFrame([(100, [1.0], 1)], SCHEMA)) == []


def test_window_of_score_zero_takes_smaller_ids(spark):
    rows = [(0, [1.0, 0.0], 0), (99, [0.0, 1.0], 1)] + [(i, [0.0, 1.0], 5) for i in (3, 4, 150)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows) == [(0, 99, 1, 3, 0, 0), (0, 99, 2, 4, 0, 0), (0, 99, 3, 150, 0, 0)]


def test_best_keeps_the_first_of_all_batches():
    r = np.random.default_rng(3)
    best, seen = hn.Best(4, 3), []
    for start in range(0, 60, 10):
        scores, allowed = r.integers(0, 4, (10, 4)), r.random((10, 4)) < 0.6
        ids, rows = r.integers(0, 20, 10), np.arange(start, start + 10)
        best.take(scores, allowed, ids, rows)
        seen += [(g, -scores[i, g], ids[i], rows[i]) for i in range(10) for g in range(4) if allowed[i, g]]
    want = [x for g in range(4) for x in sorted(s for s in seen if s[0] == g)[:3]]
    assert [(g, -s, i, k) for g, s, i, k in zip(*best.kept)] == want


def test_query_against_its_oracle_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert oracle.differences(entry.queries()["op13_hard_negatives"](spark, sf), oracle.connect(sf), entry.oracle_sql()["op13_hard_negatives"]) == []
