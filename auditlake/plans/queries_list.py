"""Queries: search, filters, paging, options, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake import schema as S
from auditlake.operators import confusion, sampling
from auditlake.operators import filters as P
from auditlake.plans import bindings as B
from auditlake.plans.registry import query

_HIT = " OR ".join(
    f"coalesce(contains(lower(CAST({f} AS VARCHAR)), '{{q}}'), false)" for f in S.SEARCH_FIELDS
)


@query(B.oracle(f"SELECT accession_no, site FROM store WHERE {_HIT.format(q='12')}", store=True))
def study_search(spark, sf_dir):
    return P.apply_filters(B.store(spark, sf_dir), query=" 12 ").select("accession_no", "site")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'ée')")
def document_search(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    return docs.where(P.search("ÉE", ["text"])).select("doc_id", "lang")


@query(B.oracle("""
    SELECT accession_no, site, strftime(procedure_start_date, '%Y-%m-%d') AS start FROM studies
    WHERE gt_llm = 1 AND gt_manual IS NOT NULL AND ai_priority IS NULL
      AND procedure_start_date >= TIMESTAMP '1997-03-05' AND procedure_start_date < TIMESTAMP '1999-11-21'"""))
def filtered_studies(spark, sf_dir):
    rows = P.apply_filters(
        B.studies(spark, sf_dir),
        equals={"gt_llm": "1", "gt_manual": P.NOT_NULL, "ai_priority": P.NULL, "workplace": ""},
        ranges={"procedure_start_date": ("1997-03-05", "1999-11-20")},
    )
    return rows.select("accession_no", "site", F.date_format("procedure_start_date", "yyyy-MM-dd").alias("start"))


def _page_sql(order: str, offset: int, size: int) -> str:
    return B.oracle(f"""
        SELECT accession_no, workplace, nodule, strftime(procedure_start_date, '%Y-%m-%d') AS start
        FROM studies ORDER BY {order}, accession_no LIMIT {size}
        OFFSET (SELECT least({offset}, ((count(*) + {size} - 1) // {size} - 1) * {size}) FROM studies)""")


def _shown(df):
    return df.select(
        "accession_no", "workplace", "nodule", F.date_format("procedure_start_date", "yyyy-MM-dd").alias("start")
    )


@query(_page_sql("procedure_start_date DESC NULLS LAST", 100, 50))
def filtered_page(spark, sf_dir):
    return _shown(P.page(B.studies(spark, sf_dir), 3, 50, "-procedure_start_date"))


@query(_page_sql("nodule ASC NULLS FIRST", 12000, 500))
def deep_page(spark, sf_dir):
    return _shown(P.page(B.studies(spark, sf_dir), 25, 900, "nodule"))


@query(_page_sql("workplace DESC NULLS LAST", 13500, 500))
def deep_page_by_category(spark, sf_dir):
    return _shown(P.page(B.studies(spark, sf_dir), 28, 500, "-workplace"))


@query(B.oracle(
    "SELECT accession_no FROM studies ORDER BY procedure_start_date DESC, accession_no LIMIT 10"
    " OFFSET (SELECT ((count(*) + 9) // 10 - 1) * 10 FROM studies)"))
def last_page(spark, sf_dir):
    return P.page(B.studies(spark, sf_dir), 10**9, 3, "-procedure_start_date").select("accession_no")


@query(B.oracle("""
    SELECT count(accession_no) AS total, round(avg(abnormal), 6)::DOUBLE AS avg_abnormal,
           count(*) FILTER (WHERE gt_llm = 1) AS gt_llm_pos, count(*) FILTER (WHERE prediction = 1) AS prediction_pos
    FROM store""", store=True))
def store_stats(spark, sf_dir):
    return B.rounded(confusion.store_stats(B.store(spark, sf_dir)), "avg_abnormal")


_OPTIONS = " UNION ".join(f"SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS value FROM studies" for f in S.FILTER_FIELDS)


@query(B.oracle(f"""
    , o AS ({_OPTIONS})
    SELECT field, value, bool_or(value IS NULL) OVER (PARTITION BY field) AS has_nulls FROM o"""))
def filter_options(spark, sf_dir):
    return P.filter_options(B.studies(spark, sf_dir))


@query(B.oracle("SELECT DISTINCT site FROM studies WHERE workplace IS NOT NULL"))
def site_names(spark, sf_dir):
    return B.studies(spark, sf_dir).where(F.col("workplace").isNotNull()).select("site").distinct()


@query(B.oracle("SELECT accession_no, workplace FROM studies WHERE site IN ('AMK', 'OTH')"))
def site_filter(spark, sf_dir):
    return B.studies(spark, sf_dir).where(P.site_filter("AMK, OTH,nowhere")).select("accession_no", "workplace")


@query(B.oracle("""
    SELECT procedure_code IS DISTINCT FROM 556 AS other_procedure,
           coalesce(upper(left(workplace, 3)) IN ('TPY', 'HOU', 'KHA', 'AMK'), false) AS priority,
           count(*) AS studies FROM studies GROUP BY ALL"""))
def strata_counts(spark, sf_dir):
    return (
        B.studies(spark, sf_dir)
        .groupBy(P.non_target_procedure().alias("other_procedure"), P.priority_workplace().alias("priority"))
        .agg(F.count("*").alias("studies"))
    )


@query(B.oracle("""
    SELECT accession_no FROM store WHERE text_report IS NOT NULL AND text_report <> '' AND atelectasis_llm IS NULL""",
    store=True))
def backfill_candidates(spark, sf_dir):
    return B.store(spark, sf_dir).where(P.needs_backfill()).select("accession_no")


@query("""
    WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
      f AS (SELECT day, (isodow(day) - 5 + 7) % 7 AS back FROM d),
      l AS (SELECT day, day - CAST(CASE WHEN back = 0 THEN 7 ELSE back END AS INT) AS last FROM f)
    SELECT strftime(day, '%Y-%m-%d') AS day, strftime(last - 7, '%Y-%m-%d') AS first_friday,
           strftime(last, '%Y-%m-%d') AS last_friday FROM l""")
def friday_windows(spark, sf_dir):
    days = B.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    first, last = P.friday_range(F.col("day"))
    return days.select(B.iso("day"), first.cast("string").alias("first_friday"), last.cast("string").alias("last_friday"))


_POOL = """
    , pool AS (SELECT *, coalesce(upper(left(workplace, 3)) IN ('TPY', 'HOU', 'KHA', 'AMK'), false) AS prio
               FROM store WHERE text_report IS NOT NULL AND text_report <> ''
                 AND procedure_start_date >= TIMESTAMP '1995-06-01' AND procedure_start_date < TIMESTAMP '2001-01-01')
    , counts AS (SELECT count(*) AS total, count(*) FILTER (WHERE gt_manual IS NULL) AS without_gt,
                        count(*) FILTER (WHERE gt_manual IS NULL AND prio) AS priority_count,
                        count(*) FILTER (WHERE gt_manual IS NULL AND NOT prio) AS other_count FROM pool)"""
_SIZES = """
    , asked AS (SELECT priority_count, other_count, {asked} AS count FROM counts)
    , halves AS (SELECT *, count // 2 AS half, count - count // 2 AS rest FROM asked)
    , sizes AS (SELECT priority_count, other_count, CAST(count AS BIGINT) AS count,
                  CAST(least(half, priority_count) + least(rest - least(rest, other_count), priority_count - least(half, priority_count)) AS BIGINT) AS priority_take,
                  CAST(least(rest, other_count) + least(half - least(half, priority_count), other_count - least(rest, other_count)) AS BIGINT) AS other_take
                FROM halves)"""
_RANGE = {"first": "1995-06-01", "last": "2000-12-31"}


@query(B.oracle(_POOL + """
    SELECT *, greatest(1, CAST(ceil(without_gt * 2 / 100.0) AS BIGINT)) AS recommended_count FROM counts""", store=True))
def sampling_pool(spark, sf_dir):
    return sampling.sampling_pool(B.store(spark, sf_dir), **_RANGE)


@query(B.oracle(_POOL + _SIZES.format(asked="least(priority_count + other_count, CAST(ceil((priority_count + other_count) * 0.85) AS BIGINT))")
                + " SELECT * FROM sizes", store=True))
def stratified_sample_sizes(spark, sf_dir):
    return sampling.sample_sizes(sampling.sampling_pool(B.store(spark, sf_dir), **_RANGE), pct=85)


@query(B.oracle(_POOL + _SIZES.format(asked="least(priority_count + other_count, 101)") + """
    , ranked AS (SELECT accession_no, prio, row_number() OVER (PARTITION BY prio
                   ORDER BY md5(CAST(accession_no AS VARCHAR) || ':42'), accession_no) AS rn FROM pool WHERE gt_manual IS NULL)
    SELECT accession_no, CASE WHEN prio THEN 'priority' ELSE 'other' END AS stratum FROM ranked, sizes
    WHERE rn <= CASE WHEN prio THEN priority_take ELSE other_take END""", store=True))
def stratified_sample(spark, sf_dir):
    drawn = sampling.stratified_sample(B.store(spark, sf_dir), count=101, **_RANGE)
    return drawn.select("accession_no", "stratum")


@query(B.oracle(_POOL + _SIZES.format(asked="least(priority_count + other_count, 101)") + """
    , ranked AS (SELECT accession_no, prio, text_report, row_number() OVER (PARTITION BY prio
                   ORDER BY md5(CAST(accession_no AS VARCHAR) || ':42'), accession_no) AS rn FROM pool WHERE gt_manual IS NULL)
    SELECT accession_no, text_report, '' AS manual_gt FROM ranked, sizes
    WHERE rn <= CASE WHEN prio THEN priority_take ELSE other_take END""", store=True))
def label_sheet(spark, sf_dir):
    return sampling.label_sheet(sampling.stratified_sample(B.store(spark, sf_dir), count=101, **_RANGE))
