"""Queries: files in and out. Files are written from the tables to the shared scratch folder first."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from auditlake import dictionaries as D
from auditlake import schema as S
from auditlake.functions import parsing as P
from auditlake.operators import filters, grading, intake, sampling
from auditlake.operators import merges as M
from auditlake.plans import bindings as B
from auditlake.plans import upload
from auditlake.plans.queries_change import _LABELS, _OLDER, _label_rows, _older
from auditlake.plans.queries_classify import variant, variant_sql
from auditlake.plans.queries_grade import _REPORTS, graded_reports
from auditlake.plans.registry import query
from auditlake.session import release, scratch_path
from auditlake.sources import exports, sinks
from auditlake.sources.study_table import StudyTable


def _csv(df, name: str) -> str:
    return sinks.write_csv(df, scratch_path(df.sparkSession, name))


def _score_files(spark, sf_dir) -> list[str]:
    """Two score exports with different headers and key names."""
    s = B.studies(spark, sf_dir)
    early = F.col("procedure_start_date") < F.lit("1998-01-01").cast("timestamp")

    def cell(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("-"))

    old = s.where(early).select(
        F.concat(F.col("accession_no").cast("string"), F.lit(".0")).alias("Accession Number"),
        cell("nodule").alias("Nodule"), cell("consolidation").alias("Consolidation"),
    )
    new = s.where(~early).select(
        F.col("accession_no").alias("ACCESSION_NO"), cell("cardiomegaly").alias("Cardiomegaly"), cell("nodule").alias("Nodule")
    )
    return [_csv(old, "scores-old"), _csv(new, "scores-new")]


@query(B.oracle("""
    SELECT accession_no AS "ACCESSION_NO", CAST(nodule AS FLOAT) AS "Nodule",
           CAST(CASE WHEN procedure_start_date < TIMESTAMP '1998-01-01' THEN consolidation END AS FLOAT) AS "Consolidation",
           CAST(CASE WHEN procedure_start_date >= TIMESTAMP '1998-01-01' THEN cardiomegaly END AS FLOAT) AS "Cardiomegaly",
           CASE WHEN procedure_start_date < TIMESTAMP '1998-01-01' THEN 0 ELSE 1 END AS file_seq FROM studies"""))
def read_scores_exports(spark, sf_dir):
    scores = exports.read_scores(spark, _score_files(spark, sf_dir))
    seq = F.col(f"{intake.ROW_ORDER}.file_seq").alias("file_seq")
    typed = intake.apply_types(intake.blank_dashes(intake.canonical_score_key(scores)))
    return typed.select("ACCESSION_NO", "Nodule", "Consolidation", "Cardiomegaly", seq)


def _report_files(spark, sf_dir) -> list[str]:
    """Two report exports; the older one calls its end date PROCEDURE_DATE."""
    docs = B.table(spark, sf_dir, "documents")
    day = F.date_format(F.timestamp_seconds(F.lit(946684800) + F.col("doc_id") * 3600), "dd-MMM-yyyy HH:mm:ss")
    old = docs.where(F.col("lang") != "en").select(
        F.col("doc_id").alias("ACCESSION_NO"), F.col("text").alias("TEXT_REPORT"), day.alias("PROCEDURE_DATE")
    )
    new = docs.where(F.col("lang") == "en").select(
        day.alias("PROCEDURE_END_DATE"), F.col("doc_id").alias("ACCESSION_NO"), F.col("text").alias("TEXT_REPORT")
    )
    return [_csv(old, "reports-old"), _csv(new, "reports-new")]


@query("""
    SELECT doc_id AS "ACCESSION_NO", md5(text) AS digest,
           strftime(TIMESTAMP '2000-01-01' + to_hours(CAST(doc_id AS INT)), '%Y-%m-%d %H:%M') AS end_date FROM documents""")
def read_reports_exports(spark, sf_dir):
    reports = intake.apply_types(exports.read_reports(spark, _report_files(spark, sf_dir)))
    return reports.select(
        "ACCESSION_NO", F.md5("TEXT_REPORT").alias("digest"),
        F.date_format("PROCEDURE_END_DATE", "yyyy-MM-dd HH:mm").alias("end_date"),
    )


def _full_scores(spark, sf_dir):
    """A score export that holds every finding column."""
    given = {"nodule", "consolidation", "cardiomegaly"}
    cells = [
        (F.col(f) if f in given else F.lit(None)).cast("string").alias(name) for name, f in S.FINDINGS.items()
    ]
    return B.studies(spark, sf_dir).select(F.col("accession_no").alias("Accession Number"), *cells)


@query(B.oracle("""
    SELECT 0 AS file_seq, 'scores' AS kind, '' AS missing, count(*) AS rows, count(DISTINCT accession_no) AS accessions FROM studies
    UNION ALL SELECT 1, 'reports', '', count(*), count(DISTINCT l_orderkey) FROM lineitem
    UNION ALL SELECT 2, 'unknown', 'ACCESSION_NO,TEXT_REPORT', count(*), 0 FROM part"""))
def file_profile(spark, sf_dir):
    lines = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ACCESSION_NO"), F.col("l_returnflag").alias("TEXT_REPORT")
    )
    parts = B.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    paths = [_csv(_full_scores(spark, sf_dir), "scores"), _csv(lines, "reports"), _csv(parts, "other")]
    return exports.file_profile(spark, paths).drop("path")


@query(B.oracle("""
    SELECT 'reports' AS kind, 0 AS missing, count(*) AS rows FROM documents UNION ALL
    SELECT 'scores', 0, count(*) FROM studies"""))
def classify_files(spark, sf_dir):
    """Uploads in any order; each kind is then read as a whole."""
    paths = [*_report_files(spark, sf_dir), _csv(_full_scores(spark, sf_dir), "scores")]
    kinds = exports.classify_files(spark, paths[::-1])
    reports = exports.read_reports(spark, kinds["reports"])
    scores = exports.read_scores(spark, kinds["scores"])

    def counted(df, kind):
        return df.agg(F.count("*").alias("rows")).select(
            F.lit(kind).alias("kind"), F.lit(len(kinds["unknown"])).alias("missing"), "rows"
        )

    return counted(reports, "reports").unionByName(counted(scores, "scores"))


def _history(spark, sf_dir):
    """An import file: mapped, aliased, ignored and unknown headers."""
    n = F.col("accession_no")
    key = variant(n, n.cast("string"), F.concat(n.cast("string"), F.lit(".0")), F.lit("none"))
    return B.studies(spark, sf_dir).select(
        n.alias("Unnamed: 0"),
        key.alias("ACCESSION_NO"),
        F.col("workplace").alias("WORKPLACE"),
        F.lit("old site").alias("MEDICAL_LOCATION_NAME"),
        F.when(n % 2 == 0, F.col("site")).alias("Institute"),
        F.col("nodule").alias("Nodule"),
        variant(n, F.lit("True"), F.lit("False"), F.lit("1.0"), F.lit("perhaps")).alias("gt_llm"),
        F.col("gt_manual").alias("gt_manual"),
        F.lit("1").alias("tb"),
        F.date_format("procedure_start_date", "yyyy-MM-dd HH:mm:ss").alias("PROCEDURE_START_DATE"),
        variant(n, F.lit("0 days 00:03:00"), F.lit("75"), F.lit(None).cast("string")).alias("Time to clinical_decision(mins)"),
        F.col("report_turn_around_minutes").alias("REPORT_TURN_AROUND_TIME"),
        F.lit("x").alias("Colour"),
    )


@query(B.oracle(f"""
    SELECT CASE WHEN accession_no % 3 < 2 THEN accession_no END AS accession_no, workplace,
           CASE WHEN accession_no % 2 = 0 THEN site END AS medical_location_name, nodule,
           {variant_sql('accession_no', '1', '0', '1', 'NULL')}::SMALLINT AS gt_llm, gt_manual::SMALLINT AS gt_manual, 1::SMALLINT AS tb_llm,
           strftime(procedure_start_date, '%Y-%m-%d') AS start,
           (CASE accession_no % 3 WHEN 0 THEN 180 WHEN 1 THEN 75 ELSE report_turn_around_minutes * 60 END)::DOUBLE
             AS time_to_clinical_decision_seconds FROM studies"""))
def import_history(spark, sf_dir):
    rows = intake.map_headers(exports.read_import(spark, _csv(_history(spark, sf_dir), "history")))
    return rows.withColumn("start", F.date_format("procedure_start_date", "yyyy-MM-dd")).drop("procedure_start_date")


@query(B.oracle("""
    , h(header, field) AS (VALUES ('ACCESSION_NO', 'accession_no'), ('WORKPLACE', 'workplace'),
        ('MEDICAL_LOCATION_NAME', 'medical_location_name'), ('Institute', 'medical_location_name'), ('Nodule', 'nodule'),
        ('gt_llm', 'gt_llm'), ('gt_manual', 'gt_manual'), ('tb', 'tb_llm'), ('PROCEDURE_START_DATE', 'procedure_start_date'),
        ('Time to clinical_decision(mins)', 'time_to_clinical_decision_seconds'),
        ('REPORT_TURN_AROUND_TIME', 'time_to_clinical_decision_seconds (fallback)'), ('Colour', NULL))
    SELECT header, field, (SELECT count(*) FROM studies) AS rows, 'TEXT_REPORT,' || '@P' AS missing_expected FROM h""".replace("@P", S.PREDICTION_HEADER)))
def import_mapping(spark, sf_dir):
    """Which header of an import feeds which field, and what is missing."""
    df = exports.read_import(spark, _csv(_history(spark, sf_dir), "history")).drop(intake.ROW_ORDER)
    seen = intake.header_report(df.columns)
    names = F.array(
        *[
            F.struct(F.lit(h).alias("header"), F.lit(f).cast("string").alias("field"))
            for h, f in seen["mapping"]
        ]
    )
    return df.agg(F.count("*").alias("rows")).select(
        F.inline(names), "rows", F.lit(",".join(seen["missing_expected"])).alias("missing_expected")
    )


@query(B.oracle(_OLDER + _LABELS.removeprefix(_OLDER) + """
    , line AS (SELECT *, row_number() OVER (ORDER BY row_no) + 1 AS line_no FROM chk)
    SELECT line_no AS row_no, accession_no, label, CASE WHEN problem IS NULL THEN 'updated' ELSE 'skipped' END AS outcome,
           'Row ' || CAST(line_no AS VARCHAR) || ': ' || problem AS message FROM line"""))
def labels_file(spark, sf_dir):
    """A labels file with a byte-order mark, read and checked against the store."""
    sheet = _label_rows(spark, sf_dir).orderBy("row_no").select(F.col("study").alias(f"{exports.BOM}study"), "verdict")
    rows = exports.read_labels(spark, _csv(sheet, "labels"))
    return M.label_outcomes(_older(spark, sf_dir), rows, "study", "verdict")


def _period(rows):
    return rows.where(filters.date_range("procedure_start_date", "1996-03-01", "1998-09-30"))


_EXPORTED = "procedure_start_date >= TIMESTAMP '1996-03-01' AND procedure_start_date < TIMESTAMP '1998-10-01'"


def _exchange_store(spark, sf_dir):
    return M.conform(B.store(spark, sf_dir))


@query(B.oracle(f"""
    SELECT CAST(accession_no AS VARCHAR) AS accession_no, workplace,
           strftime(procedure_start_date, '%Y-%m-%dT%H:%M:%S') AS procedure_start_date,
           CAST(gt_llm AS VARCHAR) AS gt_llm, CAST(prediction AS VARCHAR) AS {S.PREDICTION_HEADER},
           md5(text_report) AS digest, 18 AS columns FROM store WHERE {_EXPORTED}""", store=True))
def period_export(spark, sf_dir):
    out = exports.read_csv(spark, _csv(sinks.period_export(_period(_exchange_store(spark, sf_dir))), "period"))
    return out.select(
        "accession_no", "workplace", F.substring("procedure_start_date", 1, 19).alias("procedure_start_date"),
        "gt_llm", S.PREDICTION_HEADER, F.md5("text_report").alias("digest"), F.lit(len(out.columns)).alias("columns"),
    )


@query(B.oracle("""
    SELECT 'FN' AS kind, CAST(accession_no AS VARCHAR) AS accession_no, 17 AS columns FROM store WHERE gt_llm = 0 AND gt_manual = 1
    UNION ALL SELECT 'FP', CAST(accession_no AS VARCHAR), 17 FROM store WHERE gt_llm = 1 AND gt_manual = 0""", store=True))
def disagreement_exports(spark, sf_dir):
    rows = _exchange_store(spark, sf_dir)
    read = {k: exports.read_csv(spark, _csv(sinks.disagreement_export(rows, k), k)) for k in ("FN", "FP")}
    one, two = (
        df.select(F.lit(k).alias("kind"), "accession_no", F.lit(len(df.columns)).alias("columns")) for k, df in read.items()
    )
    return one.unionByName(two)


@query(B.oracle("""
    SELECT CAST(accession_no AS VARCHAR) AS accession_no, patient_name, CAST(gt_manual AS VARCHAR) AS gt_manual
    FROM store WHERE gt_llm = 1 AND gt_manual IS NOT NULL""", store=True))
def view_export(spark, sf_dir):
    rows = filters.apply_filters(_exchange_store(spark, sf_dir), equals={"gt_llm": "1", "gt_manual": filters.NOT_NULL})
    out = exports.read_csv(spark, _csv(sinks.view_export(rows, "-workplace"), "view"))
    return out.select("accession_no", "patient_name", "gt_manual")


@query(B.oracle("""
    SELECT accession_no, text_report IS NOT NULL AS has_text, '' AS manual_gt FROM store
    WHERE text_report IS NOT NULL AND text_report <> '' AND gt_manual IS NULL""", store=True))
def label_sheet_file(spark, sf_dir):
    """A sheet over the whole open pool, written, read back and keyed again."""
    sheet = sampling.label_sheet(sampling.stratified_sample(B.store(spark, sf_dir), pct=100))
    out = exports.read_labels(spark, _csv(sheet, "sheet"))
    return out.select(
        P.accession(F.col("accession_no")).alias("accession_no"), F.col("text_report").isNotNull().alias("has_text"),
        F.coalesce("manual_gt", F.lit("")).alias("manual_gt"),
    )


def _upload_files(spark, sf_dir) -> tuple[str, str]:
    """A report export and a score export of the studies that have a document."""
    texts = graded_reports(spark, sf_dir).select("accession_no", "text_report")
    s = B.timed_studies(spark, sf_dir).join(texts, "accession_no")
    stamp = "yyyy-MM-dd HH:mm:ss"
    header = F.concat(F.lit("CHEST of 12-Jan-2024:\nAccession No:"), F.col("accession_no").cast("string"), F.lit("\n\n"))
    reports = s.select(
        F.col("accession_no").alias("ACCESSION_NO"), F.concat(header, F.col("text_report")).alias("TEXT_REPORT"),
        F.col("workplace").alias("WORKPLACE"),
        F.date_format("procedure_start_date", stamp).alias("PROCEDURE_START_DATE"),
        F.date_format("procedure_end_date", stamp).alias("PROCEDURE_END_DATE"),
        F.date_format("ai_flag_received_date", stamp).alias("AI_FLAG_RECEIVED_DATE"),
        F.col("ai_priority").alias("AI_PRIORITY"), F.col("report_turn_around_minutes").alias("REPORT_TURN_AROUND_TIME"),
    )
    twice = reports.unionByName(reports.withColumn("WORKPLACE", F.lit("LATER")))
    # Files in the order of their names; the key beside it cuts a much repeated workplace, too.
    return _csv(twice.orderBy("WORKPLACE", "ACCESSION_NO"), "reports"), _csv(_full_scores(spark, sf_dir), "scores")


@query(B.oracle(", " + _REPORTS.strip()[4:] + """
    SELECT s.accession_no, s.llm_, CASE WHEN s.llm_ > 1 THEN 1 ELSE 0 END AS gt_llm, prediction,
      (CASE WHEN ai_priority = '5 AI_ROUTINE' THEN flag_delay_seconds ELSE report_turn_around_minutes * 60 END)::DOUBLE AS tcd,
      (CASE WHEN ai_priority = '4 URGENT' THEN 0 ELSE flag_delay_seconds END)::DOUBLE AS tee,
      strftime(procedure_start_date, '%Y-%m-%d') AS start
    FROM (SELECT studies.*, llm::INT AS llm_ FROM studies JOIN grades ON doc_id = accession_no) s"""))
def upload_to_store(spark, sf_dir):
    """The whole way: two exports, merged, predicted, graded, timed, stored and read back."""
    report_file, score_file = _upload_files(spark, sf_dir)
    reports, scores = exports.read_reports(spark, report_file), exports.read_scores(spark, score_file)
    result = upload.analyse(reports, scores, {"llm": partial(grading.TermGrader, D.FINDING_TERMS)})
    release(reports, scores)  # the files stay
    table = StudyTable(spark, scratch_path(spark, "uploaded"))
    table.insert(upload.to_studies(result), ["accession_no"], "upload-1")
    rows = table.read()
    table.record_run(run_id="upload-1", task_type="upload", status="completed", records=rows.count())
    return rows.select(
        "accession_no", F.col("llm_grade").cast("int").alias("llm_"), F.col("gt_llm").cast("int").alias("gt_llm"),
        F.col("prediction").cast("int").alias("prediction"), F.col("time_to_clinical_decision_seconds").alias("tcd"),
        F.col("time_end_to_end_seconds").alias("tee"), F.date_format("procedure_start_date", "yyyy-MM-dd").alias("start"),
    )


@query(B.oracle(f"""
    SELECT 'json' AS file, count(*) AS rows, sum(accession_no)::BIGINT AS keys FROM studies
    UNION ALL SELECT 'csv', count(*), sum(accession_no)::BIGINT FROM studies
    UNION ALL SELECT 'false_negatives', count(*), sum(accession_no)::BIGINT FROM studies WHERE gt_llm = 0 AND prediction = 1"""))
def pipeline_result_files(spark, sf_dir):
    result = B.studies(spark, sf_dir).select("accession_no", "workplace", "gt_llm", "prediction")
    files = sinks.write_result(result, scratch_path(spark, "result"), prediction="prediction")
    schema = result.schema
    read = {
        "json": spark.read.schema(schema).json(files["json"]),
        "csv": exports.read_csv(spark, files["csv"]),
        "false_negatives": spark.read.schema(schema).json(files["false_negatives"]),
    }
    parts = [
        df.agg(F.count("*").alias("rows"), F.sum(F.col("accession_no").cast("bigint")).alias("keys"))
        .select(F.lit(name).alias("file"), "rows", "keys")
        for name, df in read.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(B.oracle("""
    SELECT strftime(procedure_start_date, '%Y') AS run_id, 'upload' AS task_type, 'completed' AS status, count(*) AS records,
           count(gt_llm) AS added, count(*) - count(gt_llm) AS skipped, CAST(count(gt_llm) AS VARCHAR) || ' of ' || CAST(count(*) AS VARCHAR) || ' graded' AS message,
           strftime(min(procedure_start_date), '%Y-%m-%d') AS started, strftime(max(procedure_start_date), '%Y-%m-%d') AS completed
    FROM studies GROUP BY 1"""))
def run_records(spark, sf_dir):
    """One run record per processed year, with its counts and times."""
    start = F.col("procedure_start_date")
    per_year = B.studies(spark, sf_dir).groupBy(F.date_format(start, "yyyy").alias("run_id")).agg(
        F.count("*").alias("records"), F.count("gt_llm").alias("added"), F.min(start).alias("started_at"), F.max(start).alias("completed_at"))
    graded = F.concat(F.col("added").cast("string"), F.lit(" of "), F.col("records").cast("string"), F.lit(" graded"))
    table = StudyTable(spark, scratch_path(spark, "runs"))
    table.record_runs(per_year.withColumns({
        "task_type": F.lit("upload"), "status": F.lit("completed"), "skipped": F.col("records") - F.col("added"), "message": graded}))
    day = [F.date_format(c, "yyyy-MM-dd").alias(n) for c, n in (("started_at", "started"), ("completed_at", "completed"))]
    return table.runs().select("run_id", "task_type", "status", "records", "added", "skipped", "message", *day)
