"""Study views over the driver's tables, for Spark and, as SQL text, for the oracle.

The tables hold no sites, scores or labels, so one view derives them from orders and customers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import schema as S
from auditlake.functions import rules

SCORES = ("nodule", "consolidation", "cardiomegaly")

STUDIES_SQL = """
SELECT accession_no, procedure_start_date, patient_name,
  CASE s WHEN 0 THEN 'GLCR01' WHEN 1 THEN 'KALCR01' WHEN 2 THEN 'SEMCR01' WHEN 3 THEN 'TPYCR01'
         WHEN 4 THEN 'KHACR01' WHEN 5 THEN 'WDLCR01' WHEN 6 THEN 'HOUCR01' WHEN 7 THEN 'AMKCR01'
         WHEN 8 THEN 'YISCR01' WHEN 9 THEN 'SERCR01' WHEN 10 THEN 'ZZZCR99' END AS workplace,
  CASE WHEN h1 % 50 = 0 THEN NULL WHEN h1 < 150 THEN 5.5E0 + (h1 % 90) ELSE (h1 % 100) / 20E0 END AS nodule,
  CASE WHEN h2 % 50 = 0 THEN NULL WHEN h2 < 120 THEN 8.5E0 + (h2 % 90) ELSE (h2 % 100) / 20E0 END AS consolidation,
  CASE WHEN h3 % 50 = 0 THEN NULL WHEN h3 < 100 THEN 8.5E0 + (h3 % 90) ELSE (h3 % 100) / 20E0 END AS cardiomegaly,
  CASE WHEN h4 % 40 = 0 THEN NULL
       WHEN h1 < 140 OR h2 < 110 OR h3 < 90 THEN CASE WHEN h4 < 850 THEN 1 ELSE 0 END
       ELSE CASE WHEN h4 < 880 THEN 0 ELSE 1 END END AS gt_llm,
  CASE WHEN h4 % 5 <> 0 THEN NULL
       WHEN h1 < 140 OR h2 < 110 OR h3 < 90 THEN CASE WHEN h3 % 10 < 9 THEN 1 ELSE 0 END
       ELSE CASE WHEN h2 % 10 < 9 THEN 0 ELSE 1 END END AS gt_manual,
  CASE WHEN pr = '5-LOW' THEN '5 AI_ROUTINE' WHEN pr = '4-NOT SPECIFIED' THEN '4 URGENT'
       WHEN pr = '3-MEDIUM' THEN NULL ELSE '3 AI_PRIORITY' END AS ai_priority,
  CAST(1 + h3 % 5 AS INT) AS llm_grade,
  CASE WHEN h2 % 9 = 0 THEN NULL WHEN h2 % 3 = 0 THEN 557 ELSE 556 END AS procedure_code,
  CAST(60 + h1 % 600 AS DOUBLE) AS flag_delay_seconds,
  CAST(h2 % 240 AS DOUBLE) AS report_turn_around_minutes
FROM (
  SELECT b.*, (h {div} 7) % 1000 AS h1, (h {div} 11) % 1000 AS h2, (h {div} 13) % 1000 AS h3, (h {div} 17) % 1000 AS h4
  FROM (
    SELECT o.o_orderkey AS accession_no, CAST(o.o_orderdate AS TIMESTAMP) AS procedure_start_date,
           c.c_name AS patient_name, o.o_orderpriority AS pr, c.c_nationkey % 12 AS s,
           CAST(o.o_orderkey AS BIGINT) * 2654435761 AS h
    FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey) b) r
"""

_SITE_SQL = "CASE workplace " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.SITES.items()) + " ELSE 'OTH' END"

_SCORED_SQL = f"""
SELECT *, CASE WHEN coalesce(nodule > CASE WHEN site = 'YIS' THEN 5 ELSE 15 END, false)
                 OR coalesce(consolidation > 10, false) OR coalesce(cardiomegaly > 10, false)
          THEN 1 ELSE 0 END AS prediction
FROM (SELECT *, {_SITE_SQL} AS site FROM studies_raw)
"""

_STORE_SQL = """
SELECT s.*, d.text AS text_report, CAST(s.accession_no % 977 AS VARCHAR) AS patient_id,
       CASE WHEN s.accession_no % 3 = 0 THEN s.gt_llm END AS atelectasis_llm,
       s.nodule AS abnormal
FROM studies s LEFT JOIN documents d ON d.doc_id = s.accession_no
"""


def oracle(body: str, store: bool = False) -> str:
    """Oracle SQL over the study view (and, with ``store``, its version with text)."""
    raw = STUDIES_SQL.format(div="//", orders="orders", customer="customer")
    ctes = f"studies_raw AS ({raw}), studies AS ({_SCORED_SQL})"
    if store:
        ctes += f", store AS ({_STORE_SQL})"
    return f"WITH {ctes} {body}" if not body.lstrip().startswith(",") else f"WITH {ctes}{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    sql = STUDIES_SQL.replace("{div}", "div")
    return spark.sql(sql, orders=orders, customer=customer)


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study view with site and prediction."""
    raw = raw_studies(spark, sf_dir).withColumn("site", rules.site_of(F.col("workplace")))
    return raw.withColumn("prediction", rules.predict(F.col("site"), {c: F.col(c) for c in SCORES}))


def timed_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With exam end and flag time as timestamps."""
    delay = F.make_dt_interval(secs=F.col("flag_delay_seconds"))
    return studies(spark, sf_dir).withColumns(
        {
            "procedure_end_date": F.col("procedure_start_date"),
            "ai_flag_received_date": F.col("procedure_start_date") + delay,
        }
    )


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With report text for the accession numbers that documents cover."""
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("accession_no"), F.col("text").alias("text_report")
    )
    return (
        studies(spark, sf_dir)
        .join(documents, "accession_no", "left")
        .withColumns(
            {
                "patient_id": (F.col("accession_no") % 977).cast("string"),
                "atelectasis_llm": F.when(F.col("accession_no") % 3 == 0, F.col("gt_llm")),
                "abnormal": F.col("nodule"),
            }
        )
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def iso(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)
