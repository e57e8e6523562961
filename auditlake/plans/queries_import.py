"""Queries: whole imports and backfills, from the file or the range to the stored studies and the counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import merges as M
from auditlake.plans import bindings as B
from auditlake.plans import imports
from auditlake.plans.queries_change import _OLDER, _new_table, _older
from auditlake.plans.queries_classify import LINE_ORDER
from auditlake.plans.registry import query
from auditlake.session import FREE_SHUFFLES, scratch_path, settings

#: Per finding a word that stands for it in the test texts.
FINDING_WORDS = {
    "atelectasis_llm": "the", "calcification_llm": "and", "cardiomegaly_llm": "of", "consolidation_llm": "data",
    "fibrosis_llm": "in", "mediastinal_widening_llm": "is", "nodule_llm": "for", "pleural_effusion_llm": "with",
    "pneumoperitoneum_llm": "on", "pneumothorax_llm": "by", "tb_llm": "query",
}
FIRST, LAST = "1996-03-01", "1998-09-30"


def _import_file(spark, sf_dir):
    """A file with one line per order line: repeated keys, missing keys, missing values; lines of a key in line order."""
    lines = B.table(spark, sf_dir, "lineitem")
    sheet = lines.orderBy("l_orderkey", *LINE_ORDER).select(
        F.when(F.col("l_linenumber") != 7, F.col("l_orderkey")).alias("ACCESSION_NO"),
        F.when(F.col("l_linenumber") % 3 != 0, F.when(F.col("l_returnflag") == "R", "SEMCR01").otherwise("GLCR01")).alias("WORKPLACE"),
        F.when(F.col("l_returnflag") != "A", F.col("l_partkey") % 2).alias("gt_llm"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("PROCEDURE_START_DATE"),
    )
    path = scratch_path(spark, "import-file")
    with settings(spark, FREE_SHUFFLES):
        sheet.write.option("header", True).csv(path)
    return path


_LINES = _OLDER + """
    , lines AS (SELECT CASE WHEN l_linenumber <> 7 THEN l_orderkey END AS k,
          CASE WHEN l_linenumber % 3 <> 0 THEN CASE WHEN l_returnflag = 'R' THEN 'SEMCR01' ELSE 'GLCR01' END END AS w,
          CASE WHEN l_returnflag <> 'A' THEN l_partkey % 2 END AS g, CAST(l_shipdate AS DATE) AS d,
          row_number() OVER (PARTITION BY CASE WHEN l_linenumber <> 7 THEN l_orderkey END
                             ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)
    , f AS (SELECT * FROM lines WHERE k IS NOT NULL AND rn = 1)"""


def _imported(spark, sf_dir, mode, path=None):
    table = _new_table(spark, f"import-{mode}")
    table.insert(_older(spark, sf_dir), ["accession_no"], "first")
    counts = imports.import_file(table, path or _import_file(spark, sf_dir), "second", mode)
    rows = table.read().select(
        "accession_no", "workplace", F.col("gt_llm").cast("int"), B.iso("procedure_start_date").alias("start"),
        F.col("processing_batch_id").alias("batch"),
    )
    return rows, counts


@query(B.oracle(_LINES + """
    SELECT accession_no, workplace, gt_llm::INT AS gt_llm, strftime(procedure_start_date, '%Y-%m-%d') AS start, 'first' AS batch FROM older
    UNION ALL SELECT k, w, g::INT, strftime(d, '%Y-%m-%d'), 'second' FROM f WHERE k NOT IN (SELECT accession_no FROM older)"""))
def import_file_skip(spark, sf_dir):
    return _imported(spark, sf_dir, "skip")[0]


@query(B.oracle(_LINES + """
    SELECT coalesce(k, accession_no) AS accession_no, coalesce(w, workplace) AS workplace, coalesce(g, gt_llm)::INT AS gt_llm,
           strftime(coalesce(d, CAST(procedure_start_date AS DATE)), '%Y-%m-%d') AS start,
           CASE WHEN k IS NULL THEN 'first' ELSE 'second' END AS batch
    FROM older FULL JOIN f ON k = accession_no"""))
def import_file_update(spark, sf_dir):
    return _imported(spark, sf_dir, "update")[0]


@query(B.oracle(_LINES + """
    , o AS (SELECT CASE WHEN k IS NULL THEN 'invalid' WHEN rn > 1 THEN 'duplicate'
                        WHEN k IN (SELECT accession_no FROM older) THEN 'known' ELSE 'new' END AS outcome FROM lines)
    SELECT m.mode, CASE WHEN outcome <> 'known' THEN outcome WHEN m.mode = 'skip' THEN 'skipped' ELSE 'updated' END AS outcome,
           count(*) AS lines FROM o, (VALUES ('skip'), ('update')) m(mode) GROUP BY 1, 2"""))
def import_file_counts(spark, sf_dir):
    path = _import_file(spark, sf_dir)  # the same file for both
    parts = [_imported(spark, sf_dir, mode, path)[1].withColumn("mode", F.lit(mode)) for mode in ("skip", "update")]
    return parts[0].unionByName(parts[1])


@query(B.oracle(_LINES + """
    , u AS (SELECT accession_no, workplace, gt_llm FROM older WHERE accession_no % 2 = 0)
    SELECT coalesce(k, accession_no) AS accession_no, coalesce(w, workplace) AS workplace, coalesce(g, gt_llm)::INT AS gt_llm
    FROM u FULL JOIN f ON k = accession_no"""))
def import_update_duplicates(spark, sf_dir):
    """An upsert of lines with repeated and missing keys: the first line of a key counts, one row per key is stored."""
    table = _new_table(spark, "duplicates")
    table.insert(_older(spark, sf_dir).where(F.col("accession_no") % 2 == 0), ["accession_no"], "first")
    lines = B.table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") != 7, F.col("l_orderkey")).alias("accession_no"),
        F.when(F.col("l_linenumber") % 3 != 0, F.when(F.col("l_returnflag") == "R", "SEMCR01").otherwise("GLCR01")).alias("workplace"),
        F.when(F.col("l_returnflag") != "A", F.col("l_partkey") % 2).alias("gt_llm"),
        F.col("l_shipdate").cast("timestamp").alias("procedure_start_date"), *LINE_ORDER,
    )
    table.upsert(lines, LINE_ORDER)
    return table.read().select("accession_no", "workplace", F.col("gt_llm").cast("int"))


def _stored(spark, sf_dir):
    table = _new_table(spark, "backfilled")
    table.insert(M.conform(B.store(spark, sf_dir)), ["accession_no"], "first")
    return table


def _word_findings(candidates):
    """A grader that fails on every fifth study."""
    text = F.lower("text_report")
    answered = F.col("accession_no") % 5 != 0
    return candidates.select(
        "accession_no", *[F.when(answered, F.contains(text, F.lit(w)).cast("int")).alias(f) for f, w in FINDING_WORDS.items()]
    )


_CANDIDATE = f"""text_report IS NOT NULL AND text_report <> '' AND atelectasis_llm IS NULL
    AND procedure_start_date >= TIMESTAMP '{FIRST}' AND procedure_start_date < TIMESTAMP '{LAST}' + INTERVAL 1 DAY"""
_FILLED = ", ".join(
    f"(CASE WHEN {_CANDIDATE} AND accession_no % 5 <> 0 THEN CAST(contains(lower(text_report), '{w}') AS INT) "
    f"ELSE {f if f == 'atelectasis_llm' else 'NULL'} END)::INT AS {f}"
    for f, w in FINDING_WORDS.items()
)


@query(B.oracle(f"SELECT accession_no, {_FILLED} FROM store", store=True))
def backfill_range(spark, sf_dir):
    table = _stored(spark, sf_dir)
    imports.backfill_range(table, _word_findings, FIRST, LAST)
    return table.read().select("accession_no", *[F.col(f).cast("int") for f in FINDING_WORDS])


@query(B.oracle(f"""
    SELECT count(*) AS candidates, count(*) FILTER (WHERE accession_no % 5 <> 0) AS updated,
           count(*) FILTER (WHERE accession_no % 5 = 0) AS failed FROM store WHERE {_CANDIDATE}""", store=True))
def backfill_counts(spark, sf_dir):
    return imports.backfill_range(_stored(spark, sf_dir), _word_findings, FIRST, LAST)
