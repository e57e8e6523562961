"""Queries: cleaning, typing, de-duplication, joins of exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake import schema as S
from auditlake.functions import parsing as P
from auditlake.functions import rules, text
from auditlake.operators import intake
from auditlake.operators.sizing import spread
from auditlake.plans import bindings as B
from auditlake.plans.registry import query


def variant(selector, *values):
    """One of several column values by a row number."""
    return F.element_at(F.array(*values), (selector % len(values) + 1).cast("int"))


def variant_sql(selector: str, *values: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {selector} % {len(values)} {arms} END"


@query("""
    WITH raw AS (SELECT doc_id, 'CHEST of ' || CAST(1 + doc_id % 28 AS VARCHAR) || '-Jan-2024:' || chr(10)
                 || 'Accession No:' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || chr(10) || '  ' || text || ' ' || chr(10) AS t
                 FROM documents),
      cut AS (SELECT doc_id, regexp_replace(regexp_replace(t, 'CHEST\\sof\\s\\d+-\\S{3}-\\d{4}:', '', 'g'),
                                            'Accession\\sNo:\\S+', '', 'g') AS t FROM raw)
    SELECT doc_id, md5(c) AS digest, length(c) AS size FROM (
      SELECT doc_id, regexp_replace(regexp_replace(t, '\\n+', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS c FROM cut)""")
def clean_report_text(spark, sf_dir):
    raw = F.concat(
        F.lit("CHEST of "), (1 + F.col("doc_id") % 28).cast("string"), F.lit("-Jan-2024:\nAccession No:"),
        F.col("doc_id").cast("string"), F.lit("\n\n\n  "), F.col("text"), F.lit(" \n"),
    )
    cleaned = spread(B.table(spark, sf_dir, "documents")).select("doc_id", text.clean_report(raw).alias("c"))
    return cleaned.select("doc_id", F.md5("c").alias("digest"), F.length("c").cast("bigint").alias("size"))


@query("SELECT doc_id, left(coalesce(text, ''), 200) AS snippet FROM documents")
def report_snippet(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


def _score_text(spark, sf_dir):
    """Score rows as an export would hold them: text, dashes, keys in several spellings."""
    n, k = F.col("accession_no"), F.col("accession_no").cast("string")

    def cell(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("-"))

    return B.studies(spark, sf_dir).select(
        F.col("accession_no").alias("line"),
        variant(n, k, F.concat(k, F.lit(".0")), F.concat(F.lit(" "), k, F.lit(" ")), F.concat(F.lit("A"), k)).alias("Accession Number"),
        cell("nodule").alias("Nodule"), cell("consolidation").alias("Consolidation"),
        cell("cardiomegaly").alias("Cardiomegaly"),
        variant(n, (n % 97).cast("string"), F.lit("n/a"), F.lit("-")).alias("PATIENT_AGE"),
        F.col("procedure_code").cast("string").alias("PROCEDURE_CODE"),
        F.col("site").alias("Site Note"),
    )


@query(B.oracle(f"""
    SELECT accession_no AS line, CASE WHEN accession_no % 4 = 3 THEN NULL ELSE accession_no END AS "Accession Number",
           CAST(nodule AS FLOAT) AS "Nodule", CAST(consolidation AS FLOAT) AS "Consolidation",
           CAST(cardiomegaly AS FLOAT) AS "Cardiomegaly",
           {variant_sql('accession_no', 'accession_no % 97', 'NULL', 'NULL')} AS "PATIENT_AGE",
           CAST(procedure_code AS BIGINT) AS "PROCEDURE_CODE", site AS "Site Note" FROM studies"""))
def typed_scores(spark, sf_dir):
    return intake.apply_types(intake.blank_dashes(_score_text(spark, sf_dir)))


BOOL_WORDS = ("True", " false ", "1", "0.0", "2.7", "yes", "", None, "-3")


@query(f"""SELECT o_orderkey AS accession_no,
    CAST({variant_sql('o_orderkey', '1', '0', '1', '0', '2', 'NULL', 'NULL', 'NULL', '-3')} AS SMALLINT) AS value FROM orders""")
def bool_labels(spark, sf_dir):
    word = variant(F.col("o_orderkey"), *[F.lit(w).cast("string") for w in BOOL_WORDS])
    return B.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("accession_no"), P.bool_to_int(word).alias("value")
    )


@query("""
    WITH s AS (SELECT event_id, event_id * 37 % 200000 AS s FROM events)
    SELECT event_id, (CASE event_id % 7 WHEN 0 THEN s WHEN 1 THEN s % 86400 - 86400 WHEN 2 THEN s % 86400 WHEN 3 THEN s + 0.5
                      WHEN 4 THEN NULL WHEN 5 THEN (s // 86400) * 86400 WHEN 6 THEN NULL END)::DOUBLE AS seconds FROM s""")
def duration_parse(spark, sf_dir):
    s = F.col("event_id") * 37 % 200000
    days, rest = F.floor(s / 86400), s % 86400
    clock = F.format_string("%02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    printed = variant(
        F.col("event_id"),
        F.concat(days.cast("string"), F.lit(" days "), clock),
        F.concat(F.lit("-1 days +"), clock),
        clock,
        F.concat(s.cast("string"), F.lit(".5")),
        F.lit("soon"),
        F.concat(days.cast("string"), F.lit(" days")),
        F.lit(None).cast("string"),
    )
    return B.table(spark, sf_dir, "events").select("event_id", P.duration_seconds(printed).alias("seconds"))


@query("""
    WITH t AS (SELECT event_id, round_even(value * 30, 0)::BIGINT AS s FROM events)
    SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '—' WHEN s < 60 THEN format('{}s', s)
                          WHEN s < 3600 THEN format('{}m {:02d}s', s // 60, s % 60)
                          ELSE format('{}h {:02d}m', s // 3600, s % 3600 // 60) END AS shown FROM t""")
def fmt_duration(spark, sf_dir):
    seconds = F.when(F.col("event_id") % 11 != 0, F.col("value") * 30)
    return B.table(spark, sf_dir, "events").select("event_id", P.format_duration(seconds).alias("shown"))


@query("""
    SELECT o_orderkey AS accession_no,
           CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS start
    FROM orders""")
def lenient_timestamps(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders")
    n, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy HH:mm:ss", "dd-MMM-yyyy", "yyyy/MM/dd HH:mm:ss")
    printed = variant(n, *[F.date_format(d, f) for f in forms], F.lit("unknown"))
    return orders.select(
        n.alias("accession_no"), F.date_format(P.timestamp(printed), "yyyy-MM-dd HH:mm:ss").alias("start")
    )


def printed_timestamps(spark, sf_dir):
    """Order dates with a clock by order number, printed in every pairing of date part and clock."""
    orders = B.table(spark, sf_dir, "orders")
    n, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    at = F.timestamp_seconds(F.unix_timestamp(d) + n % 24 * 3600 + n % 60 * 60 + n % 50)
    local = F.when(F.dayofmonth(d) > 12, F.date_format(at, "d/M/yyyy")).otherwise(F.date_format(at, "M/d/yyyy"))
    dates = ("yyyy/M/d", "yyyy-M-d", "yyyyMMdd", "M/d/yyyy", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "MMM d, yyyy", "M/d/yy", "d-MMM-yy", "d MMM yy")
    clocks = ("H:mm:ss", "H:mm", "h:mm:ss a", "h:mm a", "HH:mm:ss")
    day = variant(n, *[F.date_format(at, f) for f in dates], local)
    clock = variant(F.floor(n / 13), *[F.concat(F.lit(" "), F.date_format(at, f)) for f in clocks], F.lit(""))
    return orders.select(n.alias("accession_no"), F.when(n % 29 == 0, "unknown").otherwise(F.concat(day, clock)).alias("printed"))


_PRINTED = """
    WITH t AS (SELECT o_orderkey AS n, CAST(o_orderdate AS TIMESTAMP) AS d FROM orders),
    p AS (SELECT n, CASE (n // 13) % 6
                      WHEN 5 THEN d
                      WHEN 1 THEN d + to_seconds(n % 24 * 3600 + n % 60 * 60)
                      WHEN 3 THEN d + to_seconds(n % 24 * 3600 + n % 60 * 60)
                      ELSE d + to_seconds(n % 24 * 3600 + n % 60 * 60 + n % 50) END AS moment,
                 n % 29 = 0 AS unknown FROM t)"""


@query(_PRINTED + " SELECT n AS accession_no, CASE WHEN NOT unknown THEN strftime(moment, '%Y-%m-%d %H:%M:%S') END AS start FROM p")
def timestamp_forms(spark, sf_dir):
    start = F.date_format(P.timestamp(F.col("printed")), "yyyy-MM-dd HH:mm:ss")
    return printed_timestamps(spark, sf_dir).select("accession_no", start.alias("start"))


@query(_PRINTED + " SELECT count(*) AS n_rows, count(*) FILTER (WHERE unknown) AS n_unparsed FROM p")
def timestamp_unparsed(spark, sf_dir):
    parsed = printed_timestamps(spark, sf_dir).withColumn("start", P.timestamp(F.col("printed")))
    return parsed.agg(F.count("*").alias("n_rows"), P.count_unparsed(F.col("printed"), F.col("start")).alias("n_unparsed"))


@query("""
    SELECT o_orderkey AS accession_no, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice::DOUBLE
           ELSE (o_custkey % 240 * 60)::DOUBLE END AS seconds FROM orders""")
def turnaround_fallback(spark, sf_dir):
    known = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice"))
    minutes = (F.col("o_custkey") % 240).cast("string")
    return B.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("accession_no"), P.turnaround_fallback(known, minutes).alias("seconds")
    )


@query("""
    SELECT doc_id, lang, source FROM documents
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def first_row_dedupe(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("text", "doc_id", "lang", "source")
    return intake.first_per_key(docs, "text", ["doc_id"]).drop("text")


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def report_lines(spark, sf_dir):
    """Report rows with repeated accession numbers: one per order line, some keys spelled 12.0."""
    key = F.col("l_orderkey").cast("string")
    return spread(B.table(spark, sf_dir, "lineitem")).select(
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(key, F.lit(".0"))).otherwise(key).alias("ACCESSION_NO"),
        F.concat_ws(" ", F.lit("line"), F.col("l_linenumber").cast("string"), F.col("l_returnflag")).alias("TEXT_REPORT"),
        F.when(F.col("l_linestatus") == "F", "YISCR01").otherwise("AMKCR01").alias("WORKPLACE"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("PROCEDURE_END_DATE"),
        F.lit("dropped").alias("PROCEDURE_NAME"),
        F.struct(*LINE_ORDER).alias(intake.ROW_ORDER),
    )


@query(B.oracle("""
    , first AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey
                ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1)
    SELECT s.accession_no AS "ACCESSION_NO", 'line ' || CAST(l_linenumber AS VARCHAR) || ' ' || l_returnflag AS "TEXT_REPORT",
           CASE WHEN l_linestatus = 'F' THEN 'YISCR01' ELSE 'AMKCR01' END AS "WORKPLACE",
           strftime(l_shipdate, '%Y-%m-%d') AS "PROCEDURE_END_DATE", CAST(nodule AS FLOAT) AS "Nodule",
           CAST(consolidation AS FLOAT) AS "Consolidation"
    FROM first JOIN studies s ON s.accession_no = l_orderkey WHERE s.accession_no % 4 <> 3"""))
def merge_exports(spark, sf_dir):
    scores = _score_text(spark, sf_dir).select(
        "Accession Number", "Nodule", "Consolidation", F.struct("line").alias(intake.ROW_ORDER)
    )
    merged = intake.merge_exports(report_lines(spark, sf_dir), scores)
    return merged.withColumn("PROCEDURE_END_DATE", F.date_format("PROCEDURE_END_DATE", "yyyy-MM-dd"))


@query(B.oracle("""
    , long AS (SELECT site, 'nodule' AS finding, nodule AS score FROM studies UNION ALL
               SELECT site, 'consolidation', consolidation FROM studies UNION ALL
               SELECT site, 'cardiomegaly', cardiomegaly FROM studies),
      limited AS (SELECT *, CASE WHEN finding = 'nodule' AND site = 'YIS' THEN 5e0 WHEN finding = 'nodule' THEN 15e0 ELSE 10e0 END AS threshold
                  FROM long)
    SELECT site, finding, threshold, count(*) AS studies, count(*) FILTER (WHERE score > threshold) AS above
    FROM limited GROUP BY site, finding, threshold"""))
def site_thresholds(spark, sf_dir):
    pairs = F.array(*[F.struct(F.lit(c).alias("finding"), F.col(c).alias("score")) for c in B.SCORES])
    long = B.studies(spark, sf_dir).select("site", F.inline(pairs))
    limits = F.broadcast(rules.threshold_table(spark))  # sites x findings, a fixed table
    return long.join(limits, ["site", "finding"]).groupBy("site", "finding", "threshold").agg(
        F.count("*").alias("studies"), F.count_if(F.col("score") > F.col("threshold")).alias("above")
    )


@query("""
    SELECT o_orderkey AS accession_no, CAST(CASE o_orderkey % 4 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE 2 END AS INT) AS items,
           CASE WHEN o_orderkey % 4 < 2 THEN 'patient''s ' || o_orderpriority END AS first_finding,
           CAST(NULL AS VARCHAR) AS first_temporal,
           CASE WHEN o_orderkey % 4 < 2 THEN 'None seen' END AS second_finding
    FROM orders""")
def parse_list_records(spark, sf_dir):
    n = F.col("o_orderkey")
    printed = F.concat(
        F.lit("[{'finding': \"patient's "), F.col("o_orderpriority"),
        F.lit("\", 'temporal': None}, {'finding': 'None seen', 'temporal': 'new'}]"),
    )
    cell = variant(n, printed, printed, F.lit("None"), F.lit("no list"))
    items = P.struct_list(cell, "struct<finding:string,temporal:string>")
    return B.table(spark, sf_dir, "orders").select(n.alias("accession_no"), items.alias("items")).select(
        "accession_no",
        F.size("items").alias("items"),
        F.get("items", F.lit(0))["finding"].alias("first_finding"),
        F.get("items", F.lit(0))["temporal"].alias("first_temporal"),
        F.get("items", F.lit(1))["finding"].alias("second_finding"),
    )


@query("""
    SELECT o_orderkey AS accession_no, CAST(CASE WHEN o_orderkey % 5 IN (0, 1) THEN 1 + o_custkey % 5 END AS INT) AS grade,
           CASE WHEN o_orderkey % 5 IN (0, 1, 3) THEN o_orderpriority ELSE '' END AS explanation,
           CASE o_orderkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'failed' WHEN 3 THEN 'invalid' ELSE 'failed' END AS grade_status
    FROM orders""")
def parse_model_json(spark, sf_dir):
    from auditlake.operators.grading import parse_grade_reply

    n = F.col("o_orderkey")
    body = F.concat(
        F.lit('{"grade": '), (1 + F.col("o_custkey") % 5).cast("string"), F.lit(', "explanation": "'),
        F.col("o_orderpriority"), F.lit('"}'),
    )
    wild = F.concat(F.lit('{"grade": 9, "explanation": "'), F.col("o_orderpriority"), F.lit('"}'))
    reply = variant(
        n, body, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```")), F.lit("no grade"), wild, F.lit('{"grade": ')
    )
    parsed = parse_grade_reply(reply)
    return spread(B.table(spark, sf_dir, "orders")).select(n.alias("accession_no"), F.inline(F.array(parsed)))
