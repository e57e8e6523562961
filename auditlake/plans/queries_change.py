"""Queries: inserts, upserts, labels, backfill, edits, deletes, incremental forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import scoring
from auditlake.operators import merges as M
from auditlake.plans import bindings as B
from auditlake.plans.queries_classify import LINE_ORDER, variant, variant_sql
from auditlake.plans.registry import query
from auditlake.session import scratch_path
from auditlake.sources.study_table import StudyTable
from auditlake.streaming import cells, incremental

CUTOFF = "2000-01-01"


def _older(spark, sf_dir):
    """The stored part: studies before the cutoff."""
    return B.studies(spark, sf_dir).where(F.col("procedure_start_date") < F.lit(CUTOFF).cast("timestamp"))


def _incoming(spark, sf_dir):
    """Incoming rows with repeated keys: one per order line."""
    return B.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("accession_no"), F.col("l_returnflag").alias("status"),
        F.col("l_shipdate").cast("timestamp").alias("procedure_start_date"), *LINE_ORDER,
    )


_OLDER = f", older AS (SELECT * FROM studies WHERE procedure_start_date < TIMESTAMP '{CUTOFF}')"
_FIRST = """, first AS (SELECT * FROM lineitem QUALIFY row_number() OVER (
    PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1)"""


@query(B.oracle(_OLDER + " SELECT DISTINCT l_orderkey AS accession_no FROM lineitem WHERE l_orderkey IN (SELECT accession_no FROM older)"))
def existing_keys(spark, sf_dir):
    return M.existing_keys(_older(spark, sf_dir), _incoming(spark, sf_dir))


@query(B.oracle(_OLDER + _FIRST + """
    SELECT l_orderkey AS accession_no, l_returnflag AS status, 'batch-1' AS processing_batch_id FROM first
    WHERE l_orderkey NOT IN (SELECT accession_no FROM older)"""))
def insert_if_absent(spark, sf_dir):
    added = M.insert_if_absent(_older(spark, sf_dir), _incoming(spark, sf_dir), LINE_ORDER, "batch-1")
    return added.select("accession_no", "status", "processing_batch_id")


def _updates(spark, sf_dir):
    s = B.studies(spark, sf_dir).where(F.col("procedure_start_date") >= F.lit("1999-01-01").cast("timestamp"))
    return s.select(
        "accession_no", "procedure_start_date", F.col("gt_manual").alias("gt_llm"),
        F.when(F.col("site") != "AMK", F.lit("GLCR01")).alias("workplace"),
    )


@query(B.oracle(_OLDER + """
    , inc AS (SELECT accession_no, procedure_start_date, gt_manual AS gt_llm, CASE WHEN site <> 'AMK' THEN 'GLCR01' END AS workplace
              FROM studies WHERE procedure_start_date >= TIMESTAMP '1999-01-01')
    SELECT coalesce(i.accession_no, o.accession_no) AS accession_no, coalesce(i.workplace, o.workplace) AS workplace,
           coalesce(i.gt_llm, o.gt_llm)::INT AS gt_llm, o.gt_manual::INT AS gt_manual
    FROM older o FULL JOIN inc i ON o.accession_no = i.accession_no"""))
def upsert_non_null(spark, sf_dir):
    merged = M.upsert_non_null(_older(spark, sf_dir), _updates(spark, sf_dir))
    return merged.select("accession_no", "workplace", F.col("gt_llm").cast("int"), F.col("gt_manual").cast("int"))



@query(B.oracle(_OLDER + """
    , r AS (SELECT CASE WHEN l_linenumber <> 7 THEN l_orderkey END AS k, row_number() OVER (
              PARTITION BY CASE WHEN l_linenumber <> 7 THEN l_orderkey END ORDER BY l_linenumber) AS rn FROM lineitem)
    SELECT CASE WHEN k IS NULL THEN 'invalid' WHEN rn > 1 THEN 'duplicate'
                WHEN k IN (SELECT accession_no FROM older) THEN 'skipped' ELSE 'new' END AS outcome, count(*) AS lines
    FROM r GROUP BY 1"""))
def import_preview_counts(spark, sf_dir):
    rows = B.table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") != 7, F.col("l_orderkey")).alias("accession_no"), *LINE_ORDER
    )
    return M.import_counts(M.import_outcomes(_older(spark, sf_dir), rows, LINE_ORDER, "skip"))


LABEL_KEYS = ("k", "k || '.0'", "''", "'x' || k", "k", "k", "k", "k")
LABEL_WORDS = ("'1'", "'No'", "'1'", "'0'", "''", "'maybe'", "' TRUE '", "'false'")


def _label_rows(spark, sf_dir):
    """A labels file's rows: one per order line with keys and labels in good and bad spellings."""
    n, k = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    return B.table(spark, sf_dir, "orders").select(
        (n + 2).alias("row_no"),
        variant(n, k, F.concat(k, F.lit(".0")), F.lit(""), F.concat(F.lit("x"), k), k, k, k, k).alias("study"),
        variant(n, *[F.lit(w.strip("'")) for w in LABEL_WORDS]).alias("verdict"),
    )


_LABELS = _OLDER + f"""
    , raw AS (SELECT o_orderkey AS n, CAST(o_orderkey AS VARCHAR) AS k FROM orders)
    , lab AS (SELECT n + 2 AS row_no, n, trim({variant_sql('n', *LABEL_KEYS)}) AS study, trim({variant_sql('n', *LABEL_WORDS)}) AS verdict FROM raw)
    , chk AS (SELECT row_no, study, verdict, CASE WHEN n % 8 IN (2, 3) THEN NULL ELSE n END AS accession_no,
                CASE n % 8 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 6 THEN 1 WHEN 7 THEN 0 END AS label,
                CASE WHEN n % 8 = 2 THEN 'empty accession number.'
                     WHEN n % 8 = 3 THEN 'accession "' || study || '" is not a valid integer.'
                     WHEN n % 8 = 4 THEN 'manual_gt is empty.'
                     WHEN n % 8 = 5 THEN 'manual_gt "maybe" is not 0 or 1.'
                     WHEN n NOT IN (SELECT accession_no FROM older) THEN 'accession ' || CAST(n AS VARCHAR) || ' not found in database.'
                END AS problem FROM lab)"""


@query(B.oracle(_LABELS + """
    SELECT row_no, accession_no, label, CASE WHEN problem IS NULL THEN 'updated' ELSE 'skipped' END AS outcome,
           'Row ' || CAST(row_no AS VARCHAR) || ': ' || problem AS message FROM chk"""))
def label_outcomes(spark, sf_dir):
    return M.label_outcomes(_older(spark, sf_dir), _label_rows(spark, sf_dir), "study", "verdict")


@query(B.oracle(_LABELS + """
    SELECT row_no, 'Row ' || CAST(row_no AS VARCHAR) || ': ' || problem AS message FROM chk
    WHERE problem IS NOT NULL ORDER BY row_no LIMIT 50"""))
def label_messages(spark, sf_dir):
    return M.first_messages(label_outcomes(spark, sf_dir))


@query(B.oracle(_LABELS + """
    SELECT o.accession_no, coalesce(c.label, o.gt_manual)::INT AS gt_manual
    FROM older o LEFT JOIN (SELECT * FROM chk WHERE problem IS NULL) c ON c.accession_no = o.accession_no"""))
def apply_manual_labels(spark, sf_dir):
    labels = M.accepted_labels(label_outcomes(spark, sf_dir))
    out = M.apply_labels(_older(spark, sf_dir), labels)
    return out.select("accession_no", F.col("gt_manual").cast("int").alias("gt_manual"))


@query(B.oracle("""
    SELECT accession_no, (CASE WHEN text_report IS NOT NULL AND text_report <> '' AND atelectasis_llm IS NULL
             THEN CASE WHEN contains(lower(text_report), 'the') THEN 1 END ELSE atelectasis_llm END)::INT AS atelectasis_llm
    FROM store""", store=True))
def backfill_merge(spark, sf_dir):
    from auditlake.operators.filters import needs_backfill

    rows = B.store(spark, sf_dir)
    named = F.when(F.contains(F.lower("text_report"), F.lit("the")), 1)
    found = rows.where(needs_backfill()).select("accession_no", named.alias("atelectasis_llm"))
    return M.backfill_merge(rows, found).select("accession_no", F.col("atelectasis_llm").cast("int"))


#: Finding column -> the words that name it in a report.
_NAMED = {
    "atelectasis_llm": "atelectasis", "calcification_llm": "calcification", "cardiomegaly_llm": "cardiomegaly",
    "consolidation_llm": "consolidation", "fibrosis_llm": "fibrosis", "mediastinal_widening_llm": "mediastinal widening",
    "nodule_llm": "nodule", "pleural_effusion_llm": "pleural effusion", "pneumoperitoneum_llm": "pneumoperitoneum",
    "pneumothorax_llm": "pneumothorax", "tb_llm": "tuberculosis",
}


@query("SELECT doc_id AS accession_no, " + ", ".join(
    f"CAST(contains(lower(text), '{words}') AS INT) AS {field}" for field, words in _NAMED.items()) + " FROM documents")
def detailed_findings(spark, sf_dir):
    found = scoring.dictionary_findings(F.col("text"))
    return B.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("accession_no"), *[c.alias(f) for f, c in found.items()]
    )


def _edits(spark, sf_dir):
    """Edits from order lines: field by line number, later lines win, some values empty."""
    field = variant(F.col("l_linenumber"), F.lit("workplace"), F.lit("gt_manual"), F.lit("accession_no"), F.lit("colour"))
    value = (
        F.when(F.col("l_quantity") > 40, "")
        .when(F.col("l_linenumber") % 4 == 1, (F.col("l_partkey") % 2).cast("string"))
        .otherwise("SEMCR01")
    )
    return B.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("accession_no"), field.alias("field"), value.alias("value"),
        F.struct(*LINE_ORDER).alias("seq"),
    )


@query(B.oracle(_OLDER + """
    , e AS (SELECT l_orderkey AS k, l_linenumber % 4 AS f, CASE WHEN l_quantity > 40 THEN NULL
              WHEN l_linenumber % 4 = 1 THEN CAST(l_partkey % 2 AS VARCHAR) ELSE 'SEMCR01' END AS v
            FROM lineitem WHERE l_linenumber % 4 < 2
            QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 4
              ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1)
    SELECT o.accession_no, CASE WHEN w.k IS NOT NULL THEN w.v ELSE o.workplace END AS workplace,
           (CASE WHEN g.k IS NOT NULL THEN CAST(g.v AS INT) ELSE o.gt_manual END)::INT AS gt_manual
    FROM older o LEFT JOIN (SELECT * FROM e WHERE f = 0) w ON w.k = o.accession_no
                 LEFT JOIN (SELECT * FROM e WHERE f = 1) g ON g.k = o.accession_no"""))
def edit_rows(spark, sf_dir):
    out = M.edit_rows(_older(spark, sf_dir), _edits(spark, sf_dir))
    return out.select("accession_no", "workplace", F.col("gt_manual").cast("int").alias("gt_manual"))


@query(B.oracle("SELECT accession_no, site FROM studies WHERE accession_no NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"))
def bulk_delete(spark, sf_dir):
    gone = B.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    kept = M.delete_keys(B.studies(spark, sf_dir), gone.select(F.col("l_orderkey").alias("accession_no")))
    return kept.select("accession_no", "site")


def _new_table(spark, name):
    return StudyTable(spark, scratch_path(spark, name))


@query(B.oracle(_OLDER + _LABELS.removeprefix(_OLDER) + """
    , inc AS (SELECT accession_no, procedure_start_date, gt_manual AS gt_llm, CASE WHEN site <> 'AMK' THEN 'GLCR01' END AS workplace
              FROM studies WHERE procedure_start_date >= TIMESTAMP '1999-01-01')
    , up AS (SELECT coalesce(i.accession_no, o.accession_no) AS accession_no, coalesce(i.workplace, o.workplace) AS workplace,
               coalesce(i.gt_llm, o.gt_llm) AS gt_llm, o.gt_manual, coalesce(i.procedure_start_date, o.procedure_start_date) AS d
             FROM older o FULL JOIN inc i ON o.accession_no = i.accession_no)
    SELECT u.accession_no, workplace, gt_llm::INT AS gt_llm, coalesce(c.label, gt_manual)::INT AS gt_manual
    FROM up u LEFT JOIN (SELECT * FROM chk WHERE problem IS NULL) c USING (accession_no)
    WHERE u.accession_no NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
      AND d >= TIMESTAMP '1996-02-10' AND d < TIMESTAMP '2001-04-21'"""))
def study_table_changes(spark, sf_dir):
    """Insert, upsert, label and delete on the stored table, then read one period of it."""
    table = _new_table(spark, "studies")
    table.insert(_older(spark, sf_dir), ["accession_no"], "first")
    table.upsert(_updates(spark, sf_dir))
    older_labels = M.label_outcomes(_older(spark, sf_dir), _label_rows(spark, sf_dir), "study", "verdict")
    table.set_labels(M.accepted_labels(older_labels))
    gone = B.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    table.delete(gone.select(F.col("l_orderkey").alias("accession_no")))
    return table.read_period("1996-02-10", "2001-04-20").select(
        "accession_no", "workplace", F.col("gt_llm").cast("int"), F.col("gt_manual").cast("int")
    )


def _file_stream(spark, sf_dir, name):
    schema = B.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query(B.oracle(_FIRST + """
    SELECT l_orderkey AS accession_no, l_returnflag AS status FROM first"""))
def incremental_ingest(spark, sf_dir):
    """Files dropped into a folder go into the table once, however often they are offered."""
    table = _new_table(spark, "ingested")
    for attempt in ("first", "again"):
        stream = _file_stream(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("accession_no"), F.col("l_returnflag").alias("status"),
            F.col("l_shipdate").cast("timestamp").alias("procedure_start_date"), *LINE_ORDER,
        )
        incremental.ingest(stream, table, LINE_ORDER, scratch_path(spark, f"ingest-{attempt}"))
    return table.read().select("accession_no", "status")


@query("""
    SELECT strftime(CAST(date_trunc('week', ts) AS DATE), '%Y-%m-%d') AS week, event_type, count(*) AS n,
           round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY 1, 2""")
def streaming_weekly_events(spark, sf_dir):
    stream = _file_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    weekly = incremental.weekly_windows(
        stream, "ts", [F.count("*").alias("n"), F.sum("value").alias("total")], "14 days", ["event_type"]
    )
    out = incremental.run_updates(
        weekly, scratch_path(spark, "weekly"), scratch_path(spark, "weekly-state"), ["week", "event_type"]
    )
    return B.rounded(out.withColumn("week", B.iso("week")), "total", digits=4)


@query("""
    WITH e AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS a,
                      CASE WHEN value > 20 THEN 1 ELSE 0 END AS p FROM events)
    SELECT strftime(week, '%Y-%m-%d') AS week, count(*) FILTER (WHERE a = 1 AND p = 1) AS tp,
           count(*) FILTER (WHERE a = 0 AND p = 0) AS tn, count(*) FILTER (WHERE a = 0 AND p = 1) AS fp,
           count(*) FILTER (WHERE a = 1 AND p = 0) AS fn FROM e GROUP BY week""")
def streaming_weekly_metrics(spark, sf_dir):
    stream = _file_stream(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
        F.when(F.col("value") > 20, 1).otherwise(0).alias("prediction"),
    )
    weekly = incremental.weekly_confusion(stream, "label", "prediction", "ts")
    out = incremental.run_updates(weekly, scratch_path(spark, "trend"), scratch_path(spark, "trend-state"), ["week"])
    return out.withColumn("week", B.iso("week")).select("week", "tp", "tn", "fp", "fn")


@query("""
    WITH e AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS a,
                      CASE WHEN value > 20 THEN 1 ELSE 0 END AS p FROM events)
    SELECT strftime(week, '%Y-%m-%d') AS week, event_type AS site, count(*) FILTER (WHERE a = 1 AND p = 1) AS tp,
           count(*) FILTER (WHERE a = 0 AND p = 0) AS tn, count(*) FILTER (WHERE a = 0 AND p = 1) AS fp,
           count(*) FILTER (WHERE a = 1 AND p = 0) AS fn FROM e GROUP BY week, event_type""")
def weekly_cells_incremental(spark, sf_dir):
    """Weekly counts by site kept over a stream of files, one a batch; the whole stream comes twice and counts once."""
    events = B.table(spark, sf_dir, "events")
    path = scratch_path(spark, "event-files")
    events.repartition(3, "event_id").write.parquet(path)
    book = cells.WeeklyCells(spark, scratch_path(spark, "weekly-cells"))
    label, prediction = F.when(F.col("event_type") == "error", 1).otherwise(0), F.when(F.col("value") > 20, 1).otherwise(0)
    for attempt in ("first", "again"):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
        stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
        book.follow(stream, scratch_path(spark, f"cells-{attempt}"), "events", "ts", F.col("event_type"), label, prediction)
    return cells.weekly_confusion(book.totals(), "site").withColumn("week", B.iso("week"))
