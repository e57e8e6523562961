import sys
from functools import partial

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from auditlake import dictionaries as D
from auditlake.operators import grading

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Flaky:
    def __call__(self, report, level):
        if report == "bad":
            raise RuntimeError("no answer")
        return {"grade": level, "note": report}


@pytest.fixture(scope="module")
def reports(spark):
    rows = [(1, "a NODULE", 3, 4), (2, "clear", 1, None), (3, "bad", 2, 2), (4, None, None, 1), (5, "empyema, nodule", 5, 3)]
    return spark.createDataFrame(rows, "accession_no long, text_report string, level int, manual int")


def test_failed_calls_become_nulls_with_a_message(reports):
    out = grading.apply_grader(reports, ["text_report", "level"], Flaky, "grade int, note string", partitions=2, threads=3)
    got = {r["accession_no"]: (r["grade"], r["note"], r["error"]) for r in out.collect()}
    assert got[1] == (3, "a NODULE", None) and got[3] == (None, None, "RuntimeError: no answer")
    assert got[4] == (None, None, None)


def test_pipeline_rejects_unknown_steps_and_missing_graders(reports):
    with pytest.raises(ValueError, match="unknown steps"):
        grading.grade_pipeline(reports, ["semialgo", "guess"], {})
    with pytest.raises(ValueError, match="no grader"):
        grading.grade_pipeline(reports, ["llm"], {})
    with pytest.raises(ValueError, match="judge needs"):
        grading.grade_pipeline(reports, ["judge"], {})


def test_failed_grades_stay_unlabelled(reports):
    graders = {"llm": partial(grading.TermGrader, D.FINDING_TERMS, "bad")}
    got = {r["accession_no"]: (r["llm_grade"], r["grade_status"]) for r in grading.grade_pipeline(reports, ["llm"], graders).collect()}
    assert got == {1: (3, "ok"), 2: (1, "ok"), 3: (None, "failed"), 4: (1, "ok"), 5: (4, "ok")}


class Higher:
    def __call__(self, report, a, b):
        return {"grade": max(a or 0, b or 0), "choice": 1, "explanation": "why"}


def test_judge_sees_only_unequal_grades(reports):
    df = reports.withColumn("other", F.when(F.col("accession_no") == 1, 3).otherwise(F.col("level") - 1))
    out = grading.judge(df, reports, Higher, "text_report", "level", "other", "judge")
    got = {r["accession_no"]: (r["judge_grade"], r["judge_choice"], r["judge_explanation"]) for r in out.collect()}
    assert got[1] == (3, 3, None) and got[5] == (5, 1, "why") and got[4] == (None, 3, None)
    ext = grading.judge(out, reports, Higher, "text_report", "manual", "judge_grade", "ext", when=F.col("manual").isNotNull())
    got = {r["accession_no"]: (r["ext_grade"], r["ext_choice"]) for r in ext.collect()}
    assert got[2] == (None, None) and got[3] == (2, 3) and got[1] == (4, 1)


def test_grades_are_pinned_by_writing_them(spark, reports):
    out = grading.grade_pipeline(reports, ["llm"], {"llm": partial(grading.TermGrader, D.FINDING_TERMS)})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan


class Counting:
    """Grades by text length and notes what it was given."""

    def __call__(self, report, *_):
        return {"grade": len(report or ""), "explanation": report}


def test_repeated_and_null_keys_keep_their_rows_and_grades(spark):
    rows = [(1, "a", 1, 2), (1, "a", 1, 2), (1, "bb", 1, 2), (1, None, None, 2), (None, "ccc", 3, None), (None, "ccc", 3, None), (2, "dddd", 4, 1)]
    df = spark.createDataFrame(rows, "accession_no long, text_report string, priority_algo int, manual int").withColumn("_row", F.lit("x"))
    graders = {"hybrid": Counting, "llm": Counting, "judge": Higher}
    out = grading.grade_pipeline(df, ["hybrid", "llm", "judge"], graders, manual="manual")
    assert sorted(out.columns) == sorted([*df.columns, "priority_hybrid", "hybrid_explanation", "llm_grade", "grade_status", "judge_grade",
                                          "judge_choice", "judge_explanation", "judge_ext_grade", "judge_ext_choice", "judge_ext_explanation"])
    got = sorted(((r.accession_no, r.text_report, r.priority_hybrid, r.llm_grade, r.judge_grade) for r in out.collect()), key=str)
    want = [(k, t, len(t or ""), len(t or ""), max(p or 0, len(t or ""))) for k, t, p, _ in rows]
    assert got == sorted(want, key=str)
