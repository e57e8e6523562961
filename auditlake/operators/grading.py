"""Calling an external grader per report, and the steps built on it.

Only the key and the grader's inputs cross into Python. Grades come back keyed by accession
and are written once before anything reads them, because a model may answer differently when
a lost task is run again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake import schema as S
from auditlake.functions.binding import bind
from auditlake.functions.parsing import model_reply
from auditlake.functions.text import clean_report
from auditlake.operators import scoring
from auditlake.session import materialize, release

KEY = "accession_no"
STEPS = ("semialgo", "hybrid", "llm", "judge", "findings")
Grader = Callable[..., Mapping[str, object]]


def apply_grader(
    df: DataFrame,
    inputs: Sequence[str],
    factory: Callable[[], Grader],
    outputs: str,
    key: str = KEY,
    partitions: int | None = None,
    threads: int = 1,
    delay_seconds: float = 0.0,
) -> DataFrame:
    """``(key, outputs..., error)`` from calling a grader on every row.

    ``factory`` runs once per partition and builds the client. ``partitions`` x ``threads``
    bounds the calls in flight. A failed call gives nulls and its message.
    """
    fields = T._parse_datatype_string(outputs).fields if isinstance(outputs, str) else outputs.fields
    names = [f.name for f in fields]
    schema = T.StructType(
        [df.schema[key], *fields, T.StructField("error", T.StringType())]
    )
    narrow = df.select(key, *inputs)
    whole = {n for n in inputs if isinstance(df.schema[n].dataType, T.IntegralType)}
    dtypes = {f.name: "Int64" for f in fields if isinstance(f.dataType, T.IntegralType)}
    if partitions:
        narrow = narrow.repartition(partitions, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grade = factory()

        def one(values: tuple) -> list:
            if delay_seconds:
                time.sleep(delay_seconds)
            try:
                reply = grade(*values)
                return [reply.get(n) for n in names] + [None]
            except Exception as exc:  # a failing service must not fail the job
                return [None] * len(names) + [f"{type(exc).__name__}: {exc}"]

        with ThreadPoolExecutor(max_workers=threads) as pool:
            for batch in batches:
                # Integers with gaps arrive as floats; the grader gets integers and None.
                arguments = pd.DataFrame(
                    {n: batch[n].astype("Int64") if n in whole else batch[n] for n in inputs}
                )
                arguments = arguments.astype(object).where(arguments.notna(), None)
                rows = list(pool.map(one, arguments.itertuples(index=False, name=None)))
                out = pd.DataFrame(rows, columns=names + ["error"], dtype=object).astype(dtypes)
                out.insert(0, key, batch[key].to_numpy())
                yield out

    return narrow.mapInPandas(run, schema)


def with_grades(df: DataFrame, grades: DataFrame, key: str = KEY) -> DataFrame:
    """Graded columns back onto the studies; studies without a grade keep nulls."""
    return df.join(grades, key, "left")


def grade_or_default(grade: Column, default: int = 0) -> Column:
    return F.coalesce(grade, F.lit(default))


def parse_grade_reply(reply: Column) -> Column:
    """``struct(grade, explanation, grade_status)`` from a JSON reply; grades outside 1..5 are refused."""

    def checked(r: Column) -> Column:
        grade = r["value"]["grade"]
        valid = grade.between(1, 5)
        status = F.when(r["status"] == "failed", "failed").when(valid, "ok").otherwise("invalid")
        return F.struct(
            F.when(valid, grade).alias("grade"),
            F.coalesce(r["value"]["explanation"], F.lit("")).alias("explanation"),
            status.alias("grade_status"),
        )

    return bind(model_reply(reply, "grade int, explanation string"), checked)


def equal_choice(first: Column, second: Column) -> Column:
    """Equal grades need no judge: that grade with choice 3; null where a judge must be asked."""
    return F.when(first.eqNullSafe(second), F.struct(
        second.cast("int").alias("grade"), F.lit(3).alias("choice"), F.lit(None).cast("string").alias("explanation")
    ))


def judge(
    df: DataFrame,
    texts: DataFrame,
    factory: Callable[[], Grader] | None,
    report: str,
    first: str,
    second: str,
    prefix: str,
    key: str = KEY,
    when: Column | None = None,
    ask: Callable[..., DataFrame] = apply_grader,
    **options,
) -> DataFrame:
    """Adjudicate two grade columns: adds ``{prefix}_grade``, ``_choice`` and ``_explanation``.

    ``df`` holds keys and grades, ``texts`` keys and reports. Only rows with different grades
    (and ``when`` true) meet their text and go to the judge.
    """
    names = ("grade", "choice", "explanation")
    relevant = F.lit(True) if when is None else when
    staged = df.withColumn("_equal", F.when(relevant, equal_choice(F.col(first), F.col(second))))
    open_rows = staged.where(relevant & F.col("_equal").isNull()).select(key, first, second)
    if factory is None:
        answers = open_rows.select(
            key, *[F.lit(None).cast(t).alias(f"_{n}") for n, t in zip(names, ("int", "int", "string"))]
        )
    else:
        asked = ask(
            texts.select(key, report).join(open_rows, key), [report, first, second], factory,
            "grade int, choice int, explanation string", key, **options,
        )
        answers = materialize(asked, "judge").select(key, *[F.col(n).alias(f"_{n}") for n in names])
    return (
        staged.join(answers, key, "left")
        .withColumns({f"{prefix}_{n}": F.coalesce(F.col("_equal")[n], F.col(f"_{n}")) for n in names})
        .drop("_equal", *[f"_{n}" for n in names])
    )


def grade_pipeline(
    df: DataFrame,
    steps: Sequence[str],
    graders: Mapping[str, Callable[[], Grader]],
    report: str = "text_report",
    manual: str | None = None,
    key: str = KEY,
    ledger=None,
    versions: Mapping[str, str] | None = None,
    **options,
) -> DataFrame:
    """Run the chosen grading steps in their fixed order over cleaned reports.

    ``graders`` maps a step to a client factory:

    * ``semialgo(report)`` -> ``{"reply": json}`` in the extraction schema; without a factory
      the dictionary extractor stands in
    * ``hybrid(report, semialgo_grade)`` -> ``{"grade", "explanation"}``
    * ``llm(report)`` -> ``{"grade"}``
    * ``judge(report, grade_a, grade_b)`` -> ``{"grade", "choice", "explanation"}``
    * ``findings(report)`` -> one boolean per ``*_llm`` field

    Steps pass keys and grades on, never the reports: those narrow tables are joined with one
    another and meet the wide rows in a single last join.

    With a ``ledger`` (``AnswerLedger``) graders are asked only what they have not answered before; ``versions`` names the grader's version
    by step. Else every run asks anew.

    Every row gets the grades of its own report. Inside, rows go by a digest of key, cleaned report
    and given grades, so keys may repeat or be null; rows equal in all of them are graded once.
    """
    unknown = sorted(set(steps) - set(STEPS))
    if unknown:
        raise ValueError(f"unknown steps: {unknown}; known are {STEPS}")
    missing = [s for s in steps if s not in graders and s not in ("semialgo", "judge")]
    if missing:
        raise ValueError(f"no grader for steps: {missing}")

    def asker(step: str) -> Callable[..., DataFrame]:
        def ask(rows: DataFrame, inputs, factory, outputs: str, key: str = KEY, **options) -> DataFrame:
            return ledger.ask(rows, inputs, step, (versions or {}).get(step, "1"), factory, outputs, key)[0]

        return ask if ledger is not None else apply_grader

    given = [c for c in ("priority_algo", "llm_grade", manual) if c and c in df.columns]
    row = "_row"
    while row in df.columns:
        row += "_"
    cleaned = df.withColumn(report, clean_report(F.col(report)))
    parts = [F.col(c) for c in dict.fromkeys([key, report, *given])]
    cleaned = cleaned.withColumn(row, F.sha2(F.to_json(F.struct(*parts)), 256))
    key = row  # from here on
    # Cleaned and made distinct once: every step reads it.
    pinned_rows = materialize(cleaned.select(key, report, *given).dropDuplicates([key]), "reports", compression="zstd")
    texts, grades = pinned_rows.select(key, report), pinned_rows.select(key, *given)

    if "semialgo" in steps:
        if "semialgo" in graders:
            replies = materialize(
                asker("semialgo")(texts, [report], graders["semialgo"], "reply string", key, **options), "semialgo"
            )
            extracted = replies.select(
                key, model_reply(F.col("reply"), S.EXTRACTION_SCHEMA)["value"].alias("extraction")
            )
        else:
            extracted = texts.select(key, scoring.dictionary_extraction(F.col(report)).alias("extraction"))
        scored = scoring.semi_algorithmic_grade(extracted).drop("extraction", "semialgo_grade")
        pinned = materialize(scored.withColumnRenamed("overall_max_priority", "priority_algo"), "priorities")
        grades = with_grades(grades.drop("priority_algo"), pinned, key)
    if "hybrid" in steps:
        if "priority_algo" not in grades.columns:
            raise ValueError("step hybrid needs step semialgo or a column priority_algo")
        asked = asker("hybrid")(
            texts.join(grades.select(key, "priority_algo"), key, "left"), [report, "priority_algo"],
            graders["hybrid"], "grade int, explanation string", key, **options,
        )
        hybrid = materialize(asked, "hybrid").select(
            key, F.col("grade").alias("priority_hybrid"), F.coalesce("explanation", F.lit("")).alias("hybrid_explanation")
        )
        grades = with_grades(grades, hybrid, key)
    if "llm" in steps:
        asked = asker("llm")(texts, [report], graders["llm"], "grade int", key, **options)
        direct = materialize(asked, "grade").select(
            key, F.col("grade").alias("llm_grade"),
            F.when(F.col("grade").isNull(), "failed").otherwise("ok").alias("grade_status"),
        )
        grades = with_grades(grades.drop("llm_grade"), direct, key)
    if "judge" in steps:
        need = ["priority_algo", "llm_grade"] + ([manual] if manual else [])
        absent = [c for c in need if c not in grades.columns]
        if absent:
            raise ValueError(f"step judge needs columns {absent}")
        chosen = graders.get("judge")
        grades = judge(grades, texts, chosen, report, "priority_algo", "llm_grade", "judge", key, ask=asker("judge"), **options)
        if manual:
            grades = judge(
                grades, texts, chosen, report, manual, "judge_grade", "judge_ext", key,
                when=F.col(manual).isNotNull(), ask=asker("judge"), **options,
            )
    if "findings" in steps:
        names = S.LLM_FINDING_FIELDS
        asked = asker("findings")(
            texts, [report], graders["findings"], ", ".join(f"{n} boolean" for n in names), key, **options
        )
        found = materialize(asked, "findings").select(key, *[F.col(n).cast("int").alias(n) for n in names])
        grades = with_grades(grades, found, key)
    grades = materialize(grades, "grades")  # narrow
    release(pinned_rows)
    new = [c for c in grades.columns if c != key]
    kept = [c for c in df.columns if c not in new]
    return with_grades(cleaned.select(key, *kept), grades, key).drop(key)


class TermGrader:
    """Offline grader for tests and dry runs: the highest priority of a term contained in the text."""

    def __init__(self, terms: Mapping[str, int], failing: str | None = None):
        self.terms = {t.lower(): p for t, p in terms.items()}
        self.failing = failing

    def __call__(self, report: str | None, *_) -> dict[str, object]:
        text = (report or "").lower()
        if self.failing and self.failing in text:
            raise RuntimeError("grader refused the report")
        return {"grade": max([p for t, p in self.terms.items() if t in text], default=1)}


class TermFindings:
    """Offline detailed findings: a field is true where the text names the finding."""

    def __call__(self, report: str | None) -> dict[str, object]:
        text = (report or "").lower()
        return {
            ("tb_llm" if f == "tuberculosis" else f"{f}_llm"): f.replace("_", " ") in text for f in S.FINDING_FIELDS
        }


class TermExtractor:
    """Offline extraction reply in JSON, as a model would send it."""

    def __init__(self, findings: Sequence[str], devices: Sequence[str], diagnoses: Sequence[str]):
        self.findings, self.devices, self.diagnoses = findings, devices, diagnoses

    def __call__(self, report: str | None) -> dict[str, object]:
        text = (report or "").lower()
        quiet = "not mentioned"
        return {
            "reply": json.dumps(
                {
                    "findings_all": [
                        {"finding": t, "location": "", "system": "", "temporal": quiet, "uncertainty": quiet}
                        for t in self.findings if t.lower() in text
                    ],
                    "devices_all": [
                        {"medical_device": t, "placement": quiet} for t in self.devices if t.lower() in text
                    ],
                    "diagnoses_all": [{"diagnosis": t, "temporal": quiet} for t in self.diagnoses if t.lower() in text],
                }
            )
        }
