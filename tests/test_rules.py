import random

import pytest
from pyspark.sql import functions as F

from auditlake import dictionaries as D
from auditlake import schema as S
from auditlake.functions import rules
from auditlake.operators import scoring


def predict(spark, workplace, **scores):
    row = {f: None for f in S.FINDING_FIELDS} | scores
    names = ", ".join(f"{f} double" for f in row)
    df = spark.createDataFrame([(workplace, *row.values())], f"workplace string, {names}")
    return df.select(rules.predict(rules.site_of(F.col("workplace")))).first()[0]


@pytest.mark.parametrize(
    "workplace,scores,want",
    [
        ("YISCR01", {"nodule": 10.0}, 1),
        ("AMKCR01", {"nodule": 10.0}, 0),
        ("AMKCR01", {"nodule": 15.0}, 0),
        ("AMKCR01", {"nodule": 15.01}, 1),
        ("AMKCR01", {"nodule": float("nan")}, 0),
        (None, {"fibrosis": 10.5}, 1),
        ("AMKCR01", {"tuberculosis": 100.0}, 0),
        ("AMKCR01", {}, 0),
    ],
)
def test_prediction(spark, workplace, scores, want):
    assert predict(spark, workplace, **scores) == want


def test_thresholds_are_validated_and_completed():
    full = rules.complete_thresholds()
    assert full["YIS"]["nodule"] == 5 and full["YIS"]["fibrosis"] == 10
    with pytest.raises(ValueError, match="unknown finding"):
        rules.complete_thresholds({"default": S.THRESHOLDS["default"], "AMK": {"warts": 3}})
    with pytest.raises(ValueError, match="not a number"):
        rules.complete_thresholds({"default": S.THRESHOLDS["default"], "AMK": {"nodule": "3"}})


def test_label_from_grade(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "g int")
    got = df.select(
        rules.label_from_grade(F.col("g")), rules.label_from_grade(F.col("g"), 2),
        rules.label_from_grade(F.col("g"), failed_as_zero=True),
    ).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0), (1, 0, 1), (1, 1, 1), (None, None, 0)]


def test_times_without_priority(spark):
    df = spark.sql("""
        SELECT * FROM VALUES (1, '5 AI_ROUTINE'), (2, '4 URGENT'), (3, NULL), (4, 'x') AS t(i, p)
    """).selectExpr("i", "p", "timestamp '2024-01-01 00:00:00' AS e", "timestamp '2024-01-01 00:02:30' AS f", "7.0D AS t")
    got = df.orderBy("i").select(
        rules.decision_seconds(F.col("p"), F.col("e"), F.col("f"), F.col("t")),
        rules.end_to_end_seconds(F.col("p"), F.col("e"), F.col("f")),
    ).collect()
    assert [tuple(r) for r in got] == [(150.0, 150.0), (420.0, 0.0), (420.0, 150.0), (420.0, 150.0)]


def test_top_finding(spark):
    df = spark.createDataFrame([(3.0, 3.0), (None, 2.0), (-1.0, 0.0), (None, None)], "a double, b double")
    scores = {"A": F.col("a"), "B": F.col("b")}
    got = df.select(rules.top_finding(scores), rules.top_finding(scores, positive_only=True)).collect()
    assert [(tuple(x), tuple(y)) for x, y in got] == [
        (("A", 3.0), ("A", 3.0)), (("B", 2.0), ("B", 2.0)), (("B", 0.0), ("", 0.0)), ((None, None), ("", 0.0)),
    ]


def score(spark, findings=(), devices=(), diagnoses=(), **flags):
    df = spark.createDataFrame([(list(findings), list(devices), list(diagnoses))], S.EXTRACTION_SCHEMA)
    df = df.select(F.struct("findings_all", "devices_all", "diagnoses_all").alias("extraction"))
    return scoring.semi_algorithmic_grade(df, **flags).first()


def finding(term, uncertainty="certain", temporal="new"):
    return (term, "", "", temporal, uncertainty)


def test_priorities(spark):
    r = score(spark, [finding("nodule", "uncertain")])
    assert (r["max_finding_priority"], r["semialgo_grade"]) == (2, 2)
    r = score(spark, diagnoses=[("Pneumonia", "stable")])
    assert (r["max_diagnosis_priority"], r["semialgo_grade"]) == (3, 1)
    assert score(spark, diagnoses=[("Pneumonia", "stable")], diagnosis_only_counts=True)["semialgo_grade"] == 3
    r = score(spark, devices=[("NG tube", "satisfactory")], diagnoses=[("Mastectomy", "new")])
    assert r["semialgo_grade"] == 3
    assert score(spark, devices=[("NG tube", "malpositioned")])["semialgo_grade"] == 5
    assert score(spark, [finding("normal", "uncertain")])["semialgo_grade"] == 1
    r = score(spark)
    assert (r["findings_priorities"], r["semialgo_grade"]) == ([1], 1)
    assert score(spark, [finding("nodule", temporal="worse")], finding_temporal=True)["semialgo_grade"] == 4
    assert score(spark, diagnoses=[("pneumonia", "new")], devices=[("dai", "x")])["max_diagnosis_priority"] == 1


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_nearest_term_is_the_first_of_the_nearest(spark):
    rng = random.Random(6)
    terms = list(D.FINDING_TERMS)
    words = ["", "zzz", "nodul", "cystt", "rib fractur"]
    for _ in range(40):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = rng.choice("abcdefgh ")
        words.append("".join(w))
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for w, code in df.select("w", scoring.nearest_code(F.col("w"), D.FINDING_TERMS)).collect():
        assert code == min(range(len(terms)), key=lambda i: (edit_distance(w, terms[i]), i)), w


def test_dictionaries_are_complete():
    assert [len(d) for d in (D.FINDING_TERMS, D.DEVICE_TERMS, D.DIAGNOSIS_TERMS)] == [139, 24, 6]
