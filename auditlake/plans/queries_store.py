"""Queries: large uploads, and the study table with patches, compaction and key index."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import parsing as P
from auditlake.operators import intake
from auditlake.plans import bindings as B
from auditlake.plans.queries_change import _FIRST, _OLDER, _edits, _incoming, _older
from auditlake.plans.queries_classify import LINE_ORDER, variant
from auditlake.plans.queries_exchange import _full_scores
from auditlake.plans.registry import query
from auditlake.session import scratch_path, settings
from auditlake.sources import exports, precheck, sinks
from auditlake.sources.study_table import StudyTable

#: So that small test files, too, are cut into a range per core.
SMALL_RANGES = {"spark.sql.files.openCostInBytes": "64k"}


@query("""
    SELECT doc_id AS "ACCESSION_NO", md5('"' || text || '", said the ""report""' || chr(10) || chr(10) || '"') AS digest,
           CASE WHEN doc_id % 3 = 0 THEN 'a"b' WHEN doc_id % 3 = 1 THEN NULL ELSE ',' || chr(10) END AS place,
           row_number() OVER (ORDER BY doc_id) AS place_in_file FROM documents""")
def read_large_report_file(spark, sf_dir):
    """Report files of many byte ranges, with quotes, delimiters and line breaks inside their fields, in the files' order."""
    docs = B.table(spark, sf_dir, "documents")
    place = variant(F.col("doc_id") % 3, F.lit('a"b'), F.lit(None).cast("string"), F.lit(",\n"))
    text = F.concat(F.lit('"'), "text", F.lit('", said the ""report""\n\n"'))
    sheet = docs.orderBy("doc_id").select(F.col("doc_id").alias("ACCESSION_NO"), text.alias("TEXT_REPORT"), place.alias("WORKPLACE"))
    path = sinks.write_csv(sheet, scratch_path(spark, "large-reports"))
    with settings(spark, SMALL_RANGES):
        numbered = exports.read_labels(spark, path, split=True)
    return numbered.select(
        P.accession(F.col("ACCESSION_NO")).alias("ACCESSION_NO"), F.md5("TEXT_REPORT").alias("digest"), F.col("WORKPLACE").alias("place"),
        (F.col("row_no") - 1).alias("place_in_file"),
    )


def _table(spark, name):
    return StudyTable(spark, scratch_path(spark, name), buckets=4)


@query(B.oracle(_OLDER + " SELECT DISTINCT l_orderkey AS accession_no FROM lineitem WHERE l_orderkey IN (SELECT accession_no FROM older)"))
def existing_keys_indexed(spark, sf_dir):
    """Known keys of a batch, found through the key index of the stored files."""
    table = _table(spark, "indexed")
    table.insert(_older(spark, sf_dir), ["accession_no"], "first")
    return table.rows_of(_incoming(spark, sf_dir)).select("accession_no")


def _changed(spark, sf_dir, name):
    """Rows inserted, edited, deleted, and some of the deleted inserted again: one write each, nothing rewritten."""
    table = _table(spark, name)
    table.insert(_older(spark, sf_dir), ["accession_no"], "first")
    table.edit(_edits(spark, sf_dir))
    gone = B.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    table.delete(gone.select(F.col("l_orderkey").alias("accession_no")))
    again = _incoming(spark, sf_dir).where(F.col("accession_no") % 3 == 0).withColumn("workplace", F.lit("KALCR01"))
    table.insert(again, LINE_ORDER, "again")
    table.set_labels(again.select("accession_no", F.lit(1).alias("label"), F.lit(1).alias("row_no")))
    return table


_CHANGED = B.oracle(_OLDER + _FIRST + """
    , e AS (SELECT l_orderkey AS k, l_linenumber % 4 AS f, CASE WHEN l_quantity > 40 THEN NULL
              WHEN l_linenumber % 4 = 1 THEN CAST(l_partkey % 2 AS VARCHAR) ELSE 'SEMCR01' END AS v
            FROM lineitem WHERE l_linenumber % 4 < 2
            QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 4
              ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1)
    , kept AS (
        SELECT o.accession_no, CASE WHEN w.k IS NOT NULL THEN w.v ELSE o.workplace END AS workplace,
               CASE WHEN g.k IS NOT NULL THEN CAST(g.v AS INT) ELSE o.gt_manual END AS gt_manual, 'first' AS batch
        FROM older o LEFT JOIN (SELECT * FROM e WHERE f = 0) w ON w.k = o.accession_no
                     LEFT JOIN (SELECT * FROM e WHERE f = 1) g ON g.k = o.accession_no
        WHERE o.accession_no NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))
    , after AS (
        SELECT * FROM kept UNION ALL
        SELECT l_orderkey, 'KALCR01', NULL, 'again' FROM first WHERE l_orderkey % 3 = 0 AND l_orderkey NOT IN (SELECT accession_no FROM kept))
    SELECT accession_no, workplace, (CASE WHEN accession_no % 3 = 0 AND accession_no IN (SELECT l_orderkey FROM first) THEN 1 ELSE gt_manual END)::INT AS gt_manual,
           batch FROM after""")


def _read_back(rows):
    return rows.select("accession_no", "workplace", F.col("gt_manual").cast("int"), F.col("processing_batch_id").alias("batch"))


@query(_CHANGED)
def study_table_patches(spark, sf_dir):
    """The table as readers see it while its changes are still files of their own."""
    return _read_back(_changed(spark, sf_dir, "patched").read())


@query(_CHANGED)
def study_table_compacted(spark, sf_dir):
    """The same table after compaction: one folder of rows a month and no changes."""
    table = _changed(spark, sf_dir, "compacted")
    table.compact()
    return _read_back(table.read())


_DAYS = """
    WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 600 AS INT)) AS t, o_orderkey % 2 AS file,
                      CASE WHEN o_orderkey % 11 = 0 THEN 'lost' WHEN o_orderkey % 13 = 0 THEN 'dash' ELSE 'date' END AS cell FROM orders)"""


def _dated_reports(spark, sf_dir):
    """Two report files with the same columns, one with days first and one with months first; some cells are no dates."""
    n = F.col("o_orderkey")
    at = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + n % 600 * 60)
    orders = B.table(spark, sf_dir, "orders").select(n.alias("ACCESSION_NO"), at.alias("at"))
    paths = []
    for file, form in ((0, "d/M/yyyy H:mm"), (1, "MM/dd/yyyy hh:mm a")):
        cell = F.when(F.col("ACCESSION_NO") % 11 == 0, "soon").when(F.col("ACCESSION_NO") % 13 == 0, "-").otherwise(F.date_format("at", form))
        sheet = orders.where(F.col("ACCESSION_NO") % 2 == file).select("ACCESSION_NO", F.lit("text").alias("TEXT_REPORT"), cell.alias("PROCEDURE_START_DATE"))
        paths.append(sinks.write_csv(sheet, scratch_path(spark, f"dated-{file}")))
    return exports.read_reports(spark, paths)


@query(_DAYS + " SELECT k AS accession_no, CASE WHEN cell = 'date' THEN strftime(t, '%Y-%m-%d %H:%M') END AS start FROM o")
def dates_by_column(spark, sf_dir):
    """Ambiguous dates read in the order that their file's column votes for."""
    reports = _dated_reports(spark, sf_dir)
    first = intake.day_first_columns(intake.date_votes(reports, ["PROCEDURE_START_DATE"]))
    typed = intake.apply_types(intake.blank_dashes(reports), day_first=first)
    return typed.select(F.col("ACCESSION_NO").alias("accession_no"), F.date_format("PROCEDURE_START_DATE", "yyyy-MM-dd HH:mm").alias("start"))


@query(_DAYS + """
    SELECT file::INT AS upload, 'PROCEDURE_START_DATE' AS "column", count(*) FILTER (WHERE cell <> 'dash') AS given,
           count(*) FILTER (WHERE cell = 'date' AND file = 0 AND day(t) > 12) AS "day", count(*) FILTER (WHERE cell = 'date' AND file = 1 AND day(t) > 12) AS "month",
           count(*) FILTER (WHERE cell = 'date' AND day(t) <= 12) AS either, count(*) FILTER (WHERE cell = 'lost') AS unparsed,
           CASE file WHEN 0 THEN 'day' ELSE 'month' END AS first FROM o GROUP BY file""")
def date_votes(spark, sf_dir):
    """What the cells of each file's date column say about the order of day and month, and how many no form fits."""
    return intake.date_votes(_dated_reports(spark, sf_dir), ["PROCEDURE_START_DATE", "PROCEDURE_END_DATE"])


@query(B.oracle(_OLDER + """
    , keys AS (SELECT 0 AS upload, accession_no AS k FROM studies UNION SELECT 1, l_orderkey FROM lineitem)
    , counted AS (SELECT upload, count(*) AS a, count(*) FILTER (WHERE k IN (SELECT accession_no FROM older)) AS e FROM keys GROUP BY upload
                  UNION ALL SELECT -1, count(DISTINCT k), count(DISTINCT k) FILTER (WHERE k IN (SELECT accession_no FROM older)) FROM keys)
    , files AS (SELECT 0 AS upload, 'scores' AS kind, '' AS missing, count(*) AS rows, NULL AS error FROM studies
                UNION ALL SELECT 1, 'reports', '', count(*), NULL FROM lineitem
                UNION ALL SELECT 2, 'unknown', 'ACCESSION_NO,TEXT_REPORT', count(*), NULL FROM part
                UNION ALL SELECT 3, 'error', '', 0, 'not CSV: unexpected end of data' UNION ALL SELECT 4, 'error', '', 0, 'unsupported file type'
                UNION ALL SELECT -1, 'all', '', (SELECT count(*) FROM studies) + (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM part), NULL)
    SELECT f.upload::INT AS upload, kind, missing, rows::BIGINT AS rows, coalesce(a, 0) AS accessions, coalesce(a - e, 0) AS "new",
           coalesce(e, 0) AS existing, error FROM files f LEFT JOIN counted USING (upload)"""))
def precheck_files(spark, sf_dir):
    """Uploads of every kind, two of them broken, looked at before anything is imported."""
    table = _table(spark, "prechecked")
    table.insert(_older(spark, sf_dir), ["accession_no"], "first")
    lines = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ACCESSION_NO"), F.col("l_returnflag").alias("TEXT_REPORT"))
    regions = B.table(spark, sf_dir, "region").coalesce(1)
    paths = [
        sinks.write_csv(_full_scores(spark, sf_dir), scratch_path(spark, "pre-scores")),
        sinks.write_csv(lines, scratch_path(spark, "pre-reports")),
        sinks.write_csv(B.table(spark, sf_dir, "part").select("p_partkey", "p_name"), scratch_path(spark, "pre-other")),
    ]
    broken, text = scratch_path(spark, "pre-broken"), scratch_path(spark, "pre-text")
    regions.agg(F.concat(F.lit('ACCESSION_NO,TEXT_REPORT\n1,"'), F.min("r_name"))).coalesce(1).write.option("quote", "").csv(broken)
    regions.select("r_name").write.text(text)
    return precheck.precheck(table, [*paths, broken, text]).drop("files")
