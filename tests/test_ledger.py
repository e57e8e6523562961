"""The answer ledger: who is asked, and what a broken run costs."""

import os
import sys
from functools import partial

import pytest
from pyspark import cloudpickle

from auditlake.operators import grading
from auditlake.operators.ledger import AnswerLedger

cloudpickle.register_pickle_by_value(sys.modules[__name__])
OUTPUTS = "grade int, note string"


class Noting:
    """Writes a line per call; refuses some reports, and dies once at a given call."""

    def __init__(self, path, dies_at=None):
        self.path, self.dies_at = path, dies_at

    def __call__(self, report):
        with open(self.path, "a") as f:
            f.write(f"{report}\n")
        if self.dies_at is not None and not os.path.exists(self.path + ".died") and sum(1 for _ in open(self.path)) >= self.dies_at:
            open(self.path + ".died", "w").close()
            os._exit(1)
        if report == "refused":
            raise RuntimeError("no")
        return {"grade": len(report or ""), "note": report}


class Higher:
    def __call__(self, report, a, b):
        return {"grade": max(a or 0, b or 0), "choice": 1, "explanation": "why"}


def calls(path):
    return open(path).read().splitlines() if os.path.exists(path) else []


def answers(df):
    return sorted(((r.k, r.grade, r.note, r.error) for r in df.collect()), key=str)


@pytest.fixture()
def reports(spark):
    rows = [(i, "r" * (1 + i % 40)) for i in range(120)] + [(200, None), (201, None), (None, "rr"), (202, "refused")]
    return spark.createDataFrame(rows, "k long, report string")


def test_equal_inputs_are_asked_once_and_never_again(spark, reports, tmp_path):
    log = str(tmp_path / "calls")
    ledger = AnswerLedger(spark, str(tmp_path / "ledger"), batch=5, slots=2, threads=2)
    want = sorted([(i, 1 + i % 40, "r" * (1 + i % 40), None) for i in range(120)] + [(200, 0, None, None), (201, 0, None, None), (None, 2, "rr", None),
                                                                                     (202, None, None, "RuntimeError: no")], key=str)
    first, asked = ledger.ask(reports, ["report"], "llm", "v1", partial(Noting, log), OUTPUTS, "k")
    assert answers(first) == want and asked == 42 and sorted(calls(log)) == sorted({"r" * (1 + i) for i in range(40)} | {"None", "refused"})
    again, asked = ledger.ask(reports, ["report"], "llm", "v1", partial(Noting, log), OUTPUTS, "k")
    assert answers(again) == want and asked == 1 and len(calls(log)) == 43  # only the refused one
    _, asked = ledger.ask(reports.limit(3), ["report"], "llm", "v2", partial(Noting, log), OUTPUTS, "k")
    assert asked == 3
    assert ledger.ask(reports.limit(0), ["report"], "llm", "v1", partial(Noting, log), OUTPUTS, "k")[0].count() == 0


def test_a_broken_run_goes_on_where_it_stopped(spark, tmp_path):
    log, batch = str(tmp_path / "calls"), 10
    df = spark.createDataFrame([(i, f"report {i}") for i in range(100)], "k long, report string")
    ledger = AnswerLedger(spark, str(tmp_path / "ledger"), batch=batch, slots=1, threads=1)
    grader = partial(Noting, log, dies_at=55)
    with pytest.raises(Exception):  # one attempt a task in local mode, so the run ends; a cluster would try the task again
        ledger.ask(df, ["report"], "llm", "v1", grader, OUTPUTS, "k")
    done = ledger.answers("llm", "v1", OUTPUTS).count()
    assert 55 - 2 * batch <= done < 55
    out, asked = ledger.ask(df, ["report"], "llm", "v1", grader, OUTPUTS, "k")
    assert asked == 100 - done and [r[1] for r in answers(out) if r[1] is None] == []
    repeated = len(calls(log)) - len(set(calls(log)))
    assert repeated == 55 - done  # what the broken batch had asked, and nothing else


def test_the_pipeline_asks_its_ledger(spark, tmp_path):
    log = str(tmp_path / "calls")
    df = spark.createDataFrame([(1, "a", 1), (2, "bb", 2), (2, "bb", 2)], "accession_no long, text_report string, priority_algo int")
    ledger = AnswerLedger(spark, str(tmp_path / "ledger"))
    graders = {"llm": partial(Noting, log), "judge": Higher}
    runs = [grading.grade_pipeline(df, ["llm", "judge"], graders, ledger=ledger, versions={"llm": "v1"}) for _ in range(2)]
    got = [sorted((r.accession_no, r.llm_grade, r.judge_grade) for r in run.collect()) for run in runs]
    assert got == [[(1, 1, 1), (2, 2, 2), (2, 2, 2)]] * 2 and sorted(calls(log)) == ["a", "bb"]
    plain = grading.grade_pipeline(df, ["llm", "judge"], graders)
    assert sorted((r.accession_no, r.llm_grade, r.judge_grade) for r in plain.collect()) == got[0] and len(calls(log)) == 4
