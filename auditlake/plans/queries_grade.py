"""Queries: dictionary codes, priority scores, grading steps."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from auditlake import dictionaries as D
from auditlake.functions.binding import literals
from auditlake.operators import grading, nearest, scoring
from auditlake.operators.ledger import AnswerLedger
from auditlake.operators.sizing import spread
from auditlake.plans import bindings as B
from auditlake.plans.queries_classify import variant
from auditlake.plans.registry import query
from auditlake.session import scratch_path


def _values(terms) -> str:
    return ", ".join(f"({i}, '{t}', {p})" for i, (t, p) in enumerate(terms.items()))


DICTIONARY_SQL = ", ".join(
    f"{name}(code, term, priority) AS (VALUES {_values(terms)})"
    for name, terms in (("findings", D.FINDING_TERMS), ("devices", D.DEVICE_TERMS), ("diagnoses", D.DIAGNOSIS_TERMS))
)


def _term(terms, position):
    return F.element_at(literals(terms), (position + 1).cast("int"))


def _word(words, position):
    return F.element_at(literals(words), (position % len(words) + 1).cast("int"))


_CERTAINTY = D.CERTAINTY_CODES + ("maybe",)


def extractions(spark, sf_dir):
    """One extraction per order line: some terms misspelt, unknown or absent.

    A line key names the row; nothing is grouped.
    """
    p, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("bigint")
    n = len(D.FINDING_TERMS)
    exact = _term(D.FINDING_TERMS, p % n)
    misspelt = F.concat(F.substring(exact, 1, F.length(exact) - 1), F.lit("x"))
    finding = F.when(p % 7 == 0, misspelt).otherwise(exact)
    device = F.when(s % 25 == 24, F.lit("shoelace")).otherwise(_term(D.DEVICE_TERMS, s % 24))
    diagnosis = F.when(q % 7 == 6, F.lit("pneumonia")).otherwise(_term(D.DIAGNOSIS_TERMS, q % 6))
    one_finding = F.struct(
        finding.alias("finding"), F.lit("left").alias("location"), F.lit("lung").alias("system"),
        _word(D.TEMPORAL_CODES, q).alias("temporal"), _word(_CERTAINTY, q).alias("uncertainty"),
    )
    one_device = F.struct(device.alias("medical_device"), _word(D.PLACEMENT_CODES, q).alias("placement"))
    one_diagnosis = F.struct(diagnosis.alias("diagnosis"), _word(D.TEMPORAL_CODES, s).alias("temporal"))

    def some(item, present):
        return F.filter(F.array(item), lambda x: present)

    return spread(B.table(spark, sf_dir, "lineitem")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.struct(
            some(one_finding, F.col("l_returnflag") != "N").alias("findings_all"),
            some(one_device, q % 3 == 0).alias("devices_all"),
            some(one_diagnosis, q % 2 == 0).alias("diagnoses_all"),
        ).alias("extraction"),
    )


def _case(words, expr: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {i}" for i in range(len(words)))
    return f"CASE {expr} % {len(words)} {arms} END"


_ENCODED = f"""
    WITH {DICTIONARY_SQL},
    lines AS (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
    words AS (SELECT code, left(term, length(term) - 1) || 'x' AS word FROM findings),
    near AS (SELECT w.code AS base, arg_min(f.code, levenshtein(w.word, f.term) * 1000 + f.code) AS code
             FROM words w, findings f GROUP BY w.code),
    enc AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CASE WHEN l_returnflag <> 'N' THEN CASE WHEN l_partkey % 7 = 0 THEN near.code ELSE l_partkey % {len(D.FINDING_TERMS)} END END AS finding,
        CASE WHEN l_returnflag <> 'N' THEN q % 5 END AS finding_temporal,
        CASE WHEN l_returnflag <> 'N' THEN CASE q % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END END AS uncertainty,
        CASE WHEN q % 3 = 0 AND l_suppkey % 25 <> 24 THEN l_suppkey % 24 END AS device,
        CASE WHEN q % 3 = 0 THEN q % 4 END AS placement,
        CASE WHEN q % 2 = 0 AND q % 7 <> 6 THEN q % 6 END AS diagnosis,
        CASE WHEN q % 2 = 0 THEN l_suppkey % 5 END AS diagnosis_temporal
      FROM lines JOIN near ON near.base = l_partkey % {len(D.FINDING_TERMS)})"""


@query(_ENCODED + """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, finding::INT AS finding, finding_temporal::INT AS finding_temporal,
           uncertainty::INT AS uncertainty, device::INT AS device, placement::INT AS placement,
           diagnosis::INT AS diagnosis, diagnosis_temporal::INT AS diagnosis_temporal FROM enc""")
def encode_findings(spark, sf_dir):
    coded = extractions(spark, sf_dir).withColumn("e", scoring.encode_findings(F.col("extraction")))

    def first(items, field):
        return F.get(F.col(f"e.{items}"), F.lit(0))[field]

    return coded.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        first("findings_all", "finding").alias("finding"),
        first("findings_all", "temporal").alias("finding_temporal"),
        first("findings_all", "uncertainty").alias("uncertainty"),
        first("devices_all", "medical_device").alias("device"),
        first("devices_all", "placement").alias("placement"),
        first("diagnoses_all", "diagnosis").alias("diagnosis"),
        first("diagnoses_all", "temporal").alias("diagnosis_temporal"),
    )


@query(_ENCODED + """
    , pri AS (SELECT enc.*, greatest(1, least(5, f.priority - CASE WHEN uncertainty = 1 THEN 1 ELSE 0 END)) AS fp,
                 CASE WHEN d.priority IS NOT NULL THEN CASE WHEN placement = 2 THEN 5 ELSE d.priority END END AS dp,
                 greatest(1, least(5, g.priority - CASE WHEN diagnosis_temporal IN (1, 3) THEN 1 ELSE 0 END)) AS gp0, g.priority AS gbase,
                 f.priority AS fbase
              FROM enc LEFT JOIN findings f ON f.code = finding LEFT JOIN devices d ON d.code = device
              LEFT JOIN diagnoses g ON g.code = diagnosis)
    , lim AS (SELECT *, CASE WHEN fbase IS NOT NULL THEN fp END AS f1, CASE WHEN gbase IS NOT NULL THEN gp0 END AS g1 FROM pri)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(f1, 1)::INT AS max_finding_priority,
           coalesce(dp, 1)::INT AS max_line_priority, coalesce(g1, 1)::INT AS max_diagnosis_priority,
           CASE WHEN f1 IS NOT NULL OR dp IS NOT NULL THEN greatest(coalesce(f1, 0), coalesce(dp, 0), coalesce(g1, 0)) ELSE 1 END::INT
             AS semialgo_grade
    FROM lim""")
def priority_scores(spark, sf_dir):
    return scoring.semi_algorithmic_grade(extractions(spark, sf_dir)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "max_finding_priority", "max_line_priority",
        "max_diagnosis_priority", "semialgo_grade",
    )


@query(f"""
    WITH {DICTIONARY_SQL}, names AS (SELECT DISTINCT p_name FROM part),
    near AS (SELECT p_name, arg_min(term, levenshtein(p_name, term) * 1000 + code) AS term FROM names, findings GROUP BY p_name)
    SELECT p_partkey, term AS nearest FROM part JOIN near USING (p_name)""")
def nearest_term(spark, sf_dir):
    code = scoring.finding_code(F.col("p_name"))
    return spread(B.table(spark, sf_dir, "part")).select("p_partkey", _term(D.FINDING_TERMS, code).alias("nearest"))


def graded_reports(spark, sf_dir):
    """Reports for grading: whole document texts with dictionary terms worked in by document number."""
    n = F.col("doc_id")
    text = F.concat_ws(
        " ", F.col("text"),
        F.when(n % 3 != 0, F.upper(_term(D.FINDING_TERMS, n % len(D.FINDING_TERMS)))),
        F.when(n % 4 == 0, _term(D.DEVICE_TERMS, n % len(D.DEVICE_TERMS))),
        F.when(n % 5 == 0, _term(D.DIAGNOSIS_TERMS, n % len(D.DIAGNOSIS_TERMS))),
    )
    return spread(B.table(spark, sf_dir, "documents")).select(
        n.alias("accession_no"), text.alias("text_report"), F.when(n % 2 == 0, (1 + n % 5).cast("int")).alias("priority_manual")
    )


_REPORTS = f"""
    WITH {DICTIONARY_SQL},
    reports AS (SELECT doc_id, concat_ws(' ', text,
        CASE WHEN doc_id % 3 <> 0 THEN (SELECT upper(term) FROM findings WHERE code = doc_id % {len(D.FINDING_TERMS)}) END,
        CASE WHEN doc_id % 4 = 0 THEN (SELECT term FROM devices WHERE code = doc_id % {len(D.DEVICE_TERMS)}) END,
        CASE WHEN doc_id % 5 = 0 THEN (SELECT term FROM diagnoses WHERE code = doc_id % {len(D.DIAGNOSIS_TERMS)}) END) AS t,
        CAST(CASE WHEN doc_id % 2 = 0 THEN 1 + doc_id % 5 END AS INT) AS manual FROM documents),
    hits AS (SELECT doc_id, 'f' AS kind, f.priority FROM reports, findings f WHERE contains(lower(t), lower(f.term))
             UNION ALL SELECT doc_id, 'd', d.priority FROM reports, devices d WHERE contains(lower(t), lower(d.term))
             UNION ALL SELECT doc_id, 'g', g.priority FROM reports, diagnoses g WHERE contains(lower(t), lower(g.term))),
    score AS (SELECT doc_id, max(priority) FILTER (WHERE kind = 'f') AS f, max(priority) FILTER (WHERE kind = 'd') AS d,
                max(priority) FILTER (WHERE kind = 'g') AS g FROM hits GROUP BY doc_id),
    grades AS (SELECT doc_id, t, manual, f, d, g,
                 CASE WHEN f IS NOT NULL OR d IS NOT NULL THEN greatest(coalesce(f, 0), coalesce(d, 0), coalesce(g, 0)) ELSE 1 END AS algo,
                 coalesce(f, 1) AS llm FROM reports LEFT JOIN score USING (doc_id))"""


@query(_REPORTS + """
    SELECT doc_id AS accession_no, coalesce(f, 1)::INT AS max_finding_priority, coalesce(d, 1)::INT AS max_line_priority,
           coalesce(g, 1)::INT AS max_diagnosis_priority, algo::INT AS semialgo_grade FROM grades""")
def semi_algorithmic_grade(spark, sf_dir):
    staged = graded_reports(spark, sf_dir).withColumn("extraction", scoring.dictionary_extraction(F.col("text_report")))
    return scoring.semi_algorithmic_grade(staged).select(
        "accession_no", "max_finding_priority", "max_line_priority", "max_diagnosis_priority", "semialgo_grade"
    )


@query(_REPORTS + """
    SELECT doc_id AS accession_no, llm::INT AS grade, CASE WHEN llm > 1 THEN 1 ELSE 0 END AS label,
           CAST(NULL AS VARCHAR) AS error FROM grades""")
def grader_fan_out(spark, sf_dir):
    from auditlake.functions.rules import label_from_grade

    graded = grading.apply_grader(
        graded_reports(spark, sf_dir), ["text_report"], partial(grading.TermGrader, D.FINDING_TERMS), "grade int", threads=2
    )
    return graded.select("accession_no", "grade", label_from_grade(F.col("grade")).alias("label"), "error")


class AverageJudge:
    """Offline judge: the higher grade is right; choice 1 for the first, 2 for the second."""

    def __call__(self, report, first, second):
        first, second = first or 0, second or 0
        return {"grade": max(first, second), "choice": 1 if first > second else 2, "explanation": "higher"}


class EchoHybrid:
    """Offline hybrid grader: keeps the algorithmic grade and says so."""

    def __call__(self, report, algo):
        return {"grade": algo, "explanation": f"as scored: {algo}"}


@query(_REPORTS + """
    SELECT doc_id AS accession_no, CASE WHEN algo = manual THEN algo END::INT AS equal_grade,
           CASE WHEN algo = manual THEN 3 END AS equal_choice FROM grades""")
def judge_equal_branch(spark, sf_dir):
    staged = graded_reports(spark, sf_dir).withColumn("extraction", scoring.dictionary_extraction(F.col("text_report")))
    scored = scoring.semi_algorithmic_grade(staged)
    choice = grading.equal_choice(F.col("semialgo_grade"), F.col("priority_manual"))
    return scored.select(
        "accession_no", choice["grade"].alias("equal_grade"), choice["choice"].alias("equal_choice")
    )


def _offline_graders():
    return {
        "semialgo": partial(
            grading.TermExtractor, list(D.FINDING_TERMS), list(D.DEVICE_TERMS), list(D.DIAGNOSIS_TERMS)
        ),
        "hybrid": EchoHybrid,
        "llm": partial(grading.TermGrader, D.FINDING_TERMS),
        "judge": AverageJudge,
        "findings": grading.TermFindings,
    }


@query(_REPORTS + """
    , j AS (SELECT *, greatest(algo, llm) AS jg, CASE WHEN algo = llm THEN 3 WHEN algo > llm THEN 1 ELSE 2 END AS jc FROM grades)
    SELECT doc_id AS accession_no, algo::INT AS priority_algo, algo::INT AS priority_hybrid,
           'as scored: ' || CAST(algo AS VARCHAR) AS hybrid_explanation, llm::INT AS llm_grade, 'ok' AS grade_status,
           jg::INT AS judge_grade, jc::INT AS judge_choice,
           CASE WHEN jc <> 3 THEN 'higher' END AS judge_explanation,
           CASE WHEN manual IS NOT NULL THEN greatest(jg, manual) END::INT AS judge_ext_grade,
           CASE WHEN manual = jg THEN 3 WHEN manual > jg THEN 1 WHEN manual < jg THEN 2 END::INT AS judge_ext_choice,
           CAST(contains(lower(t), 'nodule') AS INT) AS nodule_llm,
           CAST(contains(lower(t), 'pleural effusion') AS INT) AS pleural_effusion_llm,
           CAST(contains(lower(t), 'tuberculosis') AS INT) AS tb_llm
    FROM j""")
def grade_pipeline_offline(spark, sf_dir):
    out = grading.grade_pipeline(
        graded_reports(spark, sf_dir), grading.STEPS, _offline_graders(), manual="priority_manual"
    )
    return out.select(
        "accession_no", "priority_algo", "priority_hybrid", "hybrid_explanation", "llm_grade", "grade_status",
        "judge_grade", "judge_choice", "judge_explanation", "judge_ext_grade", "judge_ext_choice",
        "nodule_llm", "pleural_effusion_llm", "tb_llm",
    )


@query(_REPORTS + """
    , j AS (SELECT *, greatest(algo, llm) AS jg, CASE WHEN algo = llm THEN 3 WHEN algo > llm THEN 1 ELSE 2 END AS jc FROM grades),
    again AS (SELECT * FROM j UNION ALL SELECT * FROM j WHERE doc_id % 4 = 1)
    SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 3 END AS accession_no, algo::INT AS priority_algo,
           algo::INT AS priority_hybrid, 'as scored: ' || CAST(algo AS VARCHAR) AS hybrid_explanation,
           llm::INT AS llm_grade, 'ok' AS grade_status, jg::INT AS judge_grade, jc::INT AS judge_choice,
           CASE WHEN manual IS NOT NULL THEN greatest(jg, manual) END::INT AS judge_ext_grade,
           CAST(contains(lower(t), 'nodule') AS INT) AS nodule_llm
    FROM again""")
def grade_repeated_reports(spark, sf_dir):
    """Three keys and null for all reports, and a quarter of the rows twice: every row gets its own grades, once."""
    rows = graded_reports(spark, sf_dir).withColumn("doc_id", F.col("accession_no"))
    rows = rows.unionByName(rows.where(F.col("doc_id") % 4 == 1))
    rows = rows.withColumn("accession_no", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 3))
    out = grading.grade_pipeline(rows, grading.STEPS, _offline_graders(), manual="priority_manual")
    return out.select(
        "doc_id", "accession_no", "priority_algo", "priority_hybrid", "hybrid_explanation", "llm_grade", "grade_status",
        "judge_grade", "judge_choice", "judge_ext_grade", "nodule_llm",
    )


@query(_REPORTS + """
    , texts AS (SELECT doc_id, t, doc_id % 7 AS part FROM grades),
    first AS (SELECT count(DISTINCT t) AS n FROM texts WHERE part <> 0),
    later AS (SELECT count(DISTINCT t) AS n FROM texts WHERE t NOT IN (SELECT t FROM texts WHERE part <> 0))
    SELECT doc_id AS accession_no, llm::INT AS grade, CAST(NULL AS VARCHAR) AS error, (SELECT n FROM first) AS asked_first,
           (SELECT n FROM later) AS asked_then, 0 AS asked_again FROM grades""")
def answer_ledger(spark, sf_dir):
    """Graders asked in three runs: most reports, all of them, all again. Only what is new is asked."""
    reports = graded_reports(spark, sf_dir)
    book = AnswerLedger(spark, scratch_path(spark, "ledger"), batch=2000, slots=8)
    asked, factory = [], partial(grading.TermGrader, D.FINDING_TERMS)
    for rows in (reports.where(F.col("accession_no") % 7 != 0), reports, reports):
        graded, n = book.ask(rows, ["text_report"], "llm", "1", factory, "grade int", "accession_no")
        asked.append(n)
    counts = [F.lit(n).cast("long").alias(c) for n, c in zip(asked, ("asked_first", "asked_then"), strict=False)]
    return graded.select("accession_no", "grade", "error", *counts, F.lit(asked[2]).alias("asked_again"))


@query("""
    WITH dict AS (SELECT c_name AS term, c_custkey AS code FROM customer UNION ALL SELECT p_name, 1000000000 + min(p_partkey) FROM part GROUP BY p_name),
    asked AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 2) WHEN 2 THEN replace(p_name, 'i', 'yy')
                ELSE reverse(p_name) || CAST(p_partkey % 50 AS VARCHAR) END AS term FROM part)
    SELECT a.term, arg_min(d.code, levenshtein(a.term, d.term) * 10000000000 + d.code) AS code,
           min(levenshtein(a.term, d.term))::INT AS distance FROM asked a, dict d GROUP BY a.term""")
def nearest_term_indexed(spark, sf_dir):
    """Misspelt names against a dictionary of names that grows with the tables: near ones by index, far ones by bounds."""
    part, customer = B.table(spark, sf_dir, "part"), B.table(spark, sf_dir, "customer")
    known = customer.select(F.col("c_name").alias("term"), F.col("c_custkey").cast("long").alias("code")).unionByName(
        part.groupBy(F.col("p_name").alias("term")).agg((F.lit(1000000000) + F.min("p_partkey")).cast("long").alias("code")))
    name, n = F.col("p_name"), F.col("p_partkey")
    spelt = variant(n, name, F.substring(name, 2, 1000), F.replace(name, F.lit("i"), F.lit("yy")), F.concat(F.reverse(name), (n % 50).cast("string")))
    return nearest.nearest_terms(part.select(spelt.alias("term")), known)
