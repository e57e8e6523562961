"""Queries: predictions, confusion metrics, agreement, times, trends, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import rules
from auditlake.operators import confusion, timing, trends
from auditlake.plans import bindings as B
from auditlake.plans import report
from auditlake.plans.registry import query

RATIOS = ("accuracy", "sensitivity", "specificity", "ppv", "npv", "balanced_accuracy", "pct_normal")


def cells_sql(label: str, pred: str) -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE {label} = {a} AND {pred} = {b}) AS {n}"
        for n, a, b in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))
    )


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END"


SENS, SPEC = _div("tp", "tp + fn"), _div("tn", "tn + fp")
RATIO_EXPR = {
    "accuracy": _div("tp + tn", "tp + tn + fp + fn"),
    "sensitivity": SENS,
    "specificity": SPEC,
    "ppv": _div("tp", "tp + fp"),
    "npv": _div("tn", "tn + fn"),
    "balanced_accuracy": f"(({SENS}) + ({SPEC})) / 2",
    "pct_normal": f"({_div('tn + fn', 'tp + tn + fp + fn')}) * 100",
}
RATIOS_SQL = "tp + tn + fp + fn AS n, " + ", ".join(f"round({e}, 6)::DOUBLE AS {n}" for n, e in RATIO_EXPR.items())


def _site_metrics_sql(label: str, where: str = "true") -> str:
    return f"""
        SELECT coalesce(site, 'OVERALL') AS site, tp, tn, fp, fn, {RATIOS_SQL}
        FROM (SELECT site, {cells_sql(label, 'prediction')} FROM studies WHERE {where} GROUP BY GROUPING SETS ((site), ()))"""


@query(B.oracle("SELECT accession_no, site, prediction FROM studies"))
def prediction_by_threshold(spark, sf_dir):
    return B.studies(spark, sf_dir).select("accession_no", "site", "prediction")


@query(B.oracle(_site_metrics_sql("gt_llm")))
def site_confusion_metrics(spark, sf_dir):
    out = confusion.site_confusion_metrics(B.studies(spark, sf_dir), "gt_llm", "prediction")
    return B.rounded(out, *RATIOS)


@query(B.oracle(_site_metrics_sql("gt_manual", "gt_manual IS NOT NULL")))
def manual_site_metrics(spark, sf_dir):
    manual = B.studies(spark, sf_dir).where(F.col("gt_manual").isNotNull())
    return B.rounded(confusion.site_confusion_metrics(manual, "gt_manual", "prediction"), *RATIOS)


@query(f"""
    SELECT lang, tp, tn, fp, fn, {RATIOS_SQL} FROM (
      SELECT lang, {cells_sql('quality', 'pred')} FROM (
        SELECT d.lang, l.quality, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS pred
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY lang)""")
def confusion_metrics_labels(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("pred")
    )
    joined = docs.join(B.table(spark, sf_dir, "labels"), "doc_id", "left")
    return B.rounded(confusion.confusion_metrics(joined, "quality", "pred", ["lang"]), *RATIOS)


@query(B.oracle("""
    SELECT site, cell, count(*) AS studies FROM (
      SELECT site, CASE WHEN gt_llm = 1 AND prediction = 1 THEN 'TP' WHEN gt_llm = 0 AND prediction = 0 THEN 'TN'
                        WHEN gt_llm = 0 AND prediction = 1 THEN 'FP' WHEN gt_llm = 1 AND prediction = 0 THEN 'FN'
                   END AS cell FROM studies) GROUP BY site, cell"""))
def confusion_cells(spark, sf_dir):
    cell = rules.confusion_cell(F.col("gt_llm"), F.col("prediction")).alias("cell")
    return B.studies(spark, sf_dir).groupBy("site", cell).agg(F.count("*").alias("studies"))


_KAPPA = """
    SELECT {keys} n, round(agreement, 6)::DOUBLE AS agreement_pct,
           round(CASE WHEN n > 0 AND pe < 1 THEN (po - pe) / (1 - pe) ELSE 0 END, 6)::DOUBLE AS kappa
    FROM (SELECT *, CASE WHEN n > 0 THEN po * 100 ELSE 0.0 END AS agreement,
             ((tp + fp)::DOUBLE / n) * ((tp + fn)::DOUBLE / n) + ((tn + fn)::DOUBLE / n) * ((tn + fp)::DOUBLE / n) AS pe
          FROM (SELECT *, (tp + tn)::DOUBLE / n AS po FROM (SELECT *, tp + tn + fp + fn AS n FROM ({cells}))))"""


@query(B.oracle(_KAPPA.format(
    keys="site,", cells=f"SELECT site, {cells_sql('gt_manual', 'gt_llm')} FROM studies GROUP BY site")))
def kappa_agreement(spark, sf_dir):
    out = confusion.agreement(B.studies(spark, sf_dir), "gt_manual", "gt_llm", ["site"])
    return B.rounded(out.select("site", "n", "agreement_pct", "kappa"), "agreement_pct", "kappa")


@query(_KAPPA.format(keys="", cells=f"SELECT {cells_sql('quality', 'toxic')} FROM labels"))
def kappa_document_labels(spark, sf_dir):
    out = confusion.agreement(B.table(spark, sf_dir, "labels"), "quality", "toxic")
    return B.rounded(out.select("n", "agreement_pct", "kappa"), "agreement_pct", "kappa")


_MCNEMAR_TAIL = """
    SELECT {keys} b, c, least(b, c) AS statistic, round(p, 6)::DOUBLE AS p_value, p < 0.05 AS significant
    FROM (SELECT *, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(
              range(0, least(b, c) + 1),
              lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2.0))))) END AS p
          FROM ({counts}))"""
_MCNEMAR_COUNTS = """
    SELECT {keys}
           count(*) FILTER (WHERE gt_manual = prediction AND gt_llm <> prediction) AS b,
           count(*) FILTER (WHERE gt_manual <> prediction AND gt_llm = prediction) AS c
    FROM studies {group}"""


@query(B.oracle(_MCNEMAR_TAIL.format(
    keys="site,", counts=_MCNEMAR_COUNTS.format(keys="site,", group="GROUP BY site"))))
def mcnemar_exact(spark, sf_dir):
    out = confusion.mcnemar(B.studies(spark, sf_dir), "gt_manual", "gt_llm", "prediction", ["site"])
    return B.rounded(out, "p_value")


@query(B.oracle(_MCNEMAR_TAIL.format(keys="", counts=_MCNEMAR_COUNTS.format(keys="", group=""))))
def mcnemar_overall(spark, sf_dir):
    out = confusion.mcnemar(B.studies(spark, sf_dir), "gt_manual", "gt_llm", "prediction")
    return B.rounded(out, "p_value")


@query(B.oracle("""
    , c AS (SELECT CASE WHEN gt_manual = gt_llm THEN 1 ELSE 0 END AS first_correct,
                   CASE WHEN prediction = gt_llm THEN 1 ELSE 0 END AS second_correct
            FROM studies WHERE gt_manual IS NOT NULL AND gt_llm IS NOT NULL),
      a AS (SELECT avg(first_correct) AS a1, avg(second_correct) AS a2 FROM c)
    SELECT i AS first_correct, j AS second_correct,
           (SELECT count(*) FROM c WHERE first_correct = i AND second_correct = j) AS n,
           round(a1, 6)::DOUBLE AS first_accuracy, round(a2, 6)::DOUBLE AS second_accuracy,
           round(a2 - a1, 6)::DOUBLE AS accuracy_difference
    FROM (VALUES (0), (1)) x(i), (VALUES (0), (1)) y(j), a"""))
def contingency_table(spark, sf_dir):
    out = confusion.contingency(B.studies(spark, sf_dir), "gt_llm", "gt_manual", "prediction")
    return B.rounded(out, "first_accuracy", "second_accuracy", "accuracy_difference")


_TOP = """CASE WHEN m > 0 THEN CASE WHEN cardiomegaly = m THEN 'Cardiomegaly' WHEN consolidation = m THEN 'Consolidation'
               ELSE 'Nodule' END ELSE '' END"""


@query(B.oracle(f"""
    SELECT accession_no, CASE WHEN workplace IS NULL THEN '—' ELSE site END AS site,
           strftime(procedure_start_date, '%d %b %Y') AS procedure_date, gt_llm, gt_manual,
           {_TOP} AS highest_finding, round(CASE WHEN m > 0 THEN m ELSE 0 END, 1)::DOUBLE AS highest_score,
           left(coalesce(text_report, ''), 200) AS snippet
    FROM (SELECT *, greatest(cardiomegaly, consolidation, nodule) AS m FROM store)
    WHERE gt_llm = 0 AND gt_manual = 1""", store=True))
def disagreement_cases(spark, sf_dir):
    rows = confusion.disagreements(B.store(spark, sf_dir), "gt_llm", "gt_manual", "FN")
    return confusion.disagreement_details(rows, {c.title(): c for c in sorted(B.SCORES)})


@query(B.oracle("""
    SELECT count(*) FILTER (WHERE gt_llm = 0 AND prediction = 1) AS count, count(*) AS total_cases,
           round(count(*) FILTER (WHERE gt_llm = 0 AND prediction = 1)::DOUBLE / count(*) * 100, 6)::DOUBLE AS percentage
    FROM studies"""))
def pipeline_disagreements(spark, sf_dir):
    return B.rounded(confusion.disagreement_summary(B.studies(spark, sf_dir), "gt_llm", "prediction"), "percentage")


@query(B.oracle(f"""
    SELECT accession_no, CASE WHEN cardiomegaly = m THEN 'Cardiomegaly' WHEN consolidation = m THEN 'Consolidation'
                              WHEN nodule = m THEN 'Nodule' END AS finding, m AS score
    FROM (SELECT *, greatest(cardiomegaly, consolidation, nodule) AS m FROM studies)"""))
def top_finding(spark, sf_dir):
    top = rules.top_finding({c.title(): F.col(c) for c in sorted(B.SCORES)})
    return B.studies(spark, sf_dir).select("accession_no", top["finding"].alias("finding"), top["score"].alias("score"))


_TIMES = """
    , t AS (SELECT accession_no, site,
              CASE WHEN ai_priority = '5 AI_ROUTINE' THEN flag_delay_seconds ELSE report_turn_around_minutes * 60 END AS tcd,
              CASE WHEN ai_priority = '4 URGENT' THEN 0 ELSE flag_delay_seconds END AS tee
            FROM studies)"""


@query(B.oracle(_TIMES + " SELECT accession_no, tcd::DOUBLE AS time_to_clinical_decision_seconds, tee::DOUBLE AS time_end_to_end_seconds FROM t"))
def turnaround_times(spark, sf_dir):
    timed = timing.with_times(B.timed_studies(spark, sf_dir))
    return timed.select("accession_no", "time_to_clinical_decision_seconds", "time_end_to_end_seconds")


def _stats_sql(rows: str, key: str) -> str:
    cuts = {"p5": (1, 20), "p25": (1, 4), "median": (2, 4), "p75": (3, 4), "p95": (19, 20)}

    def cut(i: int, n: int) -> str:
        j = f"greatest(1, least({i} * (n + 1) // {n}, n - 1))"
        return (f"CASE WHEN n = 1 THEN v[1] ELSE (v[{j}] * ({n} - ({i} * (n + 1) - {j} * {n}))"
                f" + v[{j} + 1] * ({i} * (n + 1) - {j} * {n})) / {n} END")

    points = ", ".join(f"{cut(i, n)} AS {name}" for name, (i, n) in cuts.items())
    rounded = ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in ("mean", *cuts, "min", "max"))
    return f"""
        SELECT {key}, n AS count, {rounded}, more_than_5_min,
               len(list_filter(v, lambda x: x >= p95)) AS above_p95
        FROM (SELECT *, {points} FROM (
          SELECT {key}, count(*) AS n, avg(seconds) AS mean, min(seconds) AS min, max(seconds) AS max,
                 count(*) FILTER (WHERE seconds > 300) AS more_than_5_min, list(seconds ORDER BY seconds) AS v
          FROM ({rows}) GROUP BY {key}))"""


_UNPIVOT = ("SELECT 'tcd' AS metric, tcd AS seconds FROM t WHERE tcd IS NOT NULL"
            " UNION ALL SELECT 'tee', tee FROM t WHERE tee > 0")
STAT_COLUMNS = ("mean", "p5", "p25", "median", "p75", "p95", "min", "max")


@query(B.oracle(_TIMES + _stats_sql(_UNPIVOT, "metric")))
def time_stats_quantiles(spark, sf_dir):
    times = timing.unpivot_times(timing.with_times(B.timed_studies(spark, sf_dir)))
    return B.rounded(timing.time_stats(times), *STAT_COLUMNS)


@query(_stats_sql("SELECT event_type, value AS seconds FROM events WHERE value IS NOT NULL", "event_type"))
def event_value_quantiles(spark, sf_dir):
    rows = B.table(spark, sf_dir, "events").select("event_type", F.col("value").alias("seconds"))
    return B.rounded(timing.time_stats(rows, by=["event_type"], few_groups=False), *STAT_COLUMNS)


@query(_stats_sql("SELECT l_returnflag, l_extendedprice AS seconds FROM lineitem", "l_returnflag"))
def price_quantiles(spark, sf_dir):
    rows = B.table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("seconds"))
    return B.rounded(timing.time_stats(rows, by=["l_returnflag"], few_groups=False), *STAT_COLUMNS)


@query(B.oracle(_TIMES + """
    SELECT metric, count(*) AS studies, count(seconds) AS n, round(avg(seconds), 6)::DOUBLE AS mean,
           round(median(seconds), 6)::DOUBLE AS median, round(stddev_samp(seconds), 6)::DOUBLE AS std,
           min(seconds)::DOUBLE AS min, max(seconds)::DOUBLE AS max,
           count(*) FILTER (WHERE seconds > 300) AS late, count(*) FILTER (WHERE seconds < 0) AS negative,
           round(count(*) FILTER (WHERE seconds > 300)::DOUBLE / count(*) * 100, 6)::DOUBLE AS late_pct,
           CASE WHEN count(*) FILTER (WHERE seconds > 300) = 0
                THEN 'All ' || CAST(count(*) AS VARCHAR) || ' cases processed within 5 minutes' END AS note,
           format('{}m {}s', CAST(trunc(avg(seconds) / 60) AS BIGINT), CAST(trunc(avg(seconds) % 60) AS BIGINT)) AS mean_text
    FROM (SELECT 'tcd' AS metric, tcd AS seconds FROM t UNION ALL SELECT 'tee', nullif(tee, 0) FROM t)
    GROUP BY metric"""))
def time_summary(spark, sf_dir):
    out = timing.time_summary(timing.with_times(B.timed_studies(spark, sf_dir)))
    return B.rounded(out, "mean", "median", "std", "late_pct")


_BOXES = """
    SELECT metric, n, q1::DOUBLE AS q1, med::DOUBLE AS med, q3::DOUBLE AS q3, min::DOUBLE AS min, max::DOUBLE AS max,
           whisker_low::DOUBLE AS whisker_low, whisker_high::DOUBLE AS whisker_high,
           len(list_filter(v, lambda x: x < whisker_low OR x > whisker_high)) AS outliers
    FROM (SELECT *, greatest(min, q1 - 1.5 * (q3 - q1)) AS whisker_low, least(max, q3 + 1.5 * (q3 - q1)) AS whisker_high
          FROM (SELECT metric, n, v[floor(n * 0.25)::BIGINT + 1] AS q1, v[floor(n * 0.5)::BIGINT + 1] AS med,
                       v[floor(n * 0.75)::BIGINT + 1] AS q3, v[1] AS min, v[n] AS max, v
                FROM (SELECT metric, count(*) AS n, list(seconds ORDER BY seconds) AS v FROM {rows} GROUP BY metric)))"""


@query(B.oracle(_TIMES + f", rows_ AS ({_UNPIVOT}) {_BOXES.format(rows='rows_')}"))
def box_plot_stats(spark, sf_dir):
    return timing.box_plot_stats(timing.unpivot_times(timing.with_times(B.timed_studies(spark, sf_dir))))


@query("""
    WITH q AS (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n FROM events GROUP BY event_type),
         b AS (SELECT *, v[floor(n * 0.25)::BIGINT + 1] AS q1, v[floor(n * 0.75)::BIGINT + 1] AS q3 FROM q)
    SELECT e.event_id, e.event_type, e.value FROM events e JOIN b USING (event_type)
    WHERE e.value < greatest(v[1], q1 - 1.5 * (q3 - q1)) OR e.value > least(v[n], q3 + 1.5 * (q3 - q1))""")
def box_plot_outliers(spark, sf_dir):
    rows = B.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    box = timing.box_plot_stats(rows, "value", ["event_type"], few_groups=False)
    return timing.outliers(rows, box, ["event_type"], "value")


_WEEK = "CAST(date_trunc('week', procedure_start_date) AS DATE)"
_WEEK_RATIOS = """
    round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) * 100 END, 6)::DOUBLE AS sensitivity,
    round(CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) * 100 END, 6)::DOUBLE AS specificity"""


@query(B.oracle(f"""
    , w AS (SELECT {_WEEK} AS week, site, {cells_sql('gt_llm', 'prediction')} FROM studies GROUP BY 1, 2),
      g AS (SELECT * FROM (SELECT DISTINCT week FROM w), (SELECT DISTINCT site FROM w))
    SELECT strftime(g.week, '%Y-%m-%d') AS week, strftime(g.week, '%d %b') AS week_label, g.site, {_WEEK_RATIOS}
    FROM g LEFT JOIN w ON g.week = w.week AND g.site = w.site"""))
def weekly_site_metrics(spark, sf_dir):
    out = trends.weekly_site_metrics(B.studies(spark, sf_dir), "gt_llm", "prediction")
    return B.rounded(out.withColumn("week", B.iso("week")), "sensitivity", "specificity")


_WEEKLY = f"""
    , w AS (SELECT {_WEEK} AS week, {cells_sql('gt_llm', 'prediction')} FROM studies GROUP BY 1),
      a AS (SELECT week, round(CASE WHEN tp + tn + fp + fn > 0 THEN ({RATIO_EXPR['balanced_accuracy']}) * 100 END, 1)::DOUBLE AS value FROM w)"""


@query(B.oracle(_WEEKLY + """
    SELECT strftime(week, '%Y-%m-%d') AS week, strftime(week, '%d %b') AS week_label, value FROM a"""))
def weekly_balanced_accuracy(spark, sf_dir):
    out = trends.weekly_balanced_accuracy(B.studies(spark, sf_dir), "gt_llm", "prediction")
    return out.withColumn("week", B.iso("week"))


_BAND = """
    , base AS (SELECT avg(value) AS m, stddev_samp(value) AS s, count(value) AS k
               FROM a WHERE week < (SELECT max(week) FROM a)),
      band AS (SELECT CASE WHEN k >= 2 THEN round(m - 1.96 * s / sqrt(k), 1) END AS lower,
                      CASE WHEN k >= 2 THEN round(m + 1.96 * s / sqrt(k), 1) END AS upper FROM base)"""


@query(B.oracle(_WEEKLY + _BAND + """
    SELECT strftime(week, '%Y-%m-%d') AS last_week, strftime(week, '%d %b') AS last_week_label, value AS last_value,
           lower::DOUBLE AS lower, upper::DOUBLE AS upper, value BETWEEN lower AND upper AS in_band
    FROM a, band WHERE week = (SELECT max(week) FROM a)"""))
def control_band_status(spark, sf_dir):
    weekly = trends.weekly_balanced_accuracy(B.studies(spark, sf_dir), "gt_llm", "prediction")
    return trends.control_band(weekly).withColumn("last_week", B.iso("last_week"))


@query(B.oracle("""
    SELECT strftime(min(procedure_start_date), '%d-%b-%Y') AS first_date,
           strftime(max(procedure_start_date), '%d-%b-%Y') AS last_date, count(*) AS studies,
           count(*) FILTER (WHERE procedure_code IS DISTINCT FROM 556) AS inappropriate_studies FROM studies"""))
def period_summary(spark, sf_dir):
    return trends.period_summary(B.studies(spark, sf_dir))


@query(B.oracle("SELECT workplace, count(*) AS studies FROM studies WHERE workplace IS NOT NULL GROUP BY workplace"))
def site_counts(spark, sf_dir):
    return trends.counts_by(B.studies(spark, sf_dir), "workplace")


@query(B.oracle("""
    SELECT count(*) AS total, count(*) FILTER (WHERE gt_llm = 1) AS gt_llm_pos,
           count(*) FILTER (WHERE prediction = 1) AS prediction_pos, count(gt_llm) AS graded,
           count(*) - count(gt_llm) AS ungraded, strftime(min(procedure_start_date), '%d %b %Y') AS actual_from,
           strftime(max(procedure_start_date), '%d %b %Y') AS actual_to FROM studies"""))
def quick_counts(spark, sf_dir):
    return confusion.quick_counts(B.studies(spark, sf_dir))


def _long_sql(section: str, item: str, metrics: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {item} AS item, '{m}' AS metric, round({m}::DOUBLE, 6)::DOUBLE AS value FROM {source}"
        for m in metrics
    )


_PERIOD = "procedure_start_date >= TIMESTAMP '1996-01-01' AND procedure_start_date < TIMESTAMP '2000-01-01'"
_ALL_RATIOS = ["n", "tp", "tn", "fp", "fn", *RATIOS]


@query(B.oracle(f"""
    , everything AS (SELECT * FROM studies)
    , period AS (SELECT * FROM everything WHERE {_PERIOD})
    , quick AS (SELECT count(*) AS total, count(*) FILTER (WHERE gt_llm = 1) AS gt_llm_pos,
                       count(*) FILTER (WHERE prediction = 1) AS prediction_pos, count(gt_llm) AS graded,
                       count(*) - count(gt_llm) AS ungraded FROM period)
    , sites AS ({_site_metrics_sql('gt_llm').replace('FROM studies', 'FROM period')})
    , llm_sites AS ({_site_metrics_sql('gt_llm', 'gt_manual IS NOT NULL').replace('FROM studies', 'FROM period')})
    , manual_sites AS ({_site_metrics_sql('gt_manual', 'gt_manual IS NOT NULL').replace('FROM studies', 'FROM period')})
    {_TIMES.replace('FROM studies', 'FROM period')}
    , times AS ({_stats_sql(_UNPIVOT, 'metric')})
    {_WEEKLY.replace('FROM studies', 'FROM period')} {_BAND}
    , agree AS ({_KAPPA.format(keys='', cells=f"SELECT {cells_sql('gt_manual', 'gt_llm')} FROM period")})
    , mcn AS ({_MCNEMAR_TAIL.format(keys='', counts=_MCNEMAR_COUNTS.format(keys='', group='').replace('FROM studies', 'FROM period'))})
    , box_rows AS ({_UNPIVOT}), boxes AS ({_BOXES.format(rows='box_rows')})
    , ws AS (SELECT {_WEEK} AS week, site, {cells_sql('gt_llm', 'prediction')} FROM period GROUP BY 1, 2)
    , grid AS (SELECT g.week, g.site, {_WEEK_RATIOS}
               FROM (SELECT * FROM (SELECT DISTINCT week FROM ws), (SELECT DISTINCT site FROM ws)) g LEFT JOIN ws w ON g.week = w.week AND g.site = w.site)
    , cases AS (SELECT accession_no, CASE WHEN workplace IS NULL THEN '—' ELSE site END AS site, gt_llm, gt_manual,
                       round(CASE WHEN m > 0 THEN m ELSE 0 END, 1) AS highest_score
                FROM (SELECT *, greatest(cardiomegaly, consolidation, nodule) AS m FROM period) WHERE gt_llm + gt_manual = 1)
    , last_band AS (SELECT value AS last_value, lower, upper FROM a, band WHERE week = (SELECT max(week) FROM a))
    {_long_sql('summary', "'all'", ['total', 'gt_llm_pos', 'prediction_pos', 'graded', 'ungraded'], 'quick')}
    UNION ALL {_long_sql('site_metrics', 'site', _ALL_RATIOS, 'sites')}
    UNION ALL {_long_sql('manual_llm_metrics', 'site', _ALL_RATIOS, 'llm_sites')}
    UNION ALL {_long_sql('manual_metrics', 'site', _ALL_RATIOS, 'manual_sites')}
    UNION ALL {_long_sql('time_stats', 'metric', ['count', *STAT_COLUMNS, 'more_than_5_min', 'above_p95'], 'times')}
    UNION ALL {_long_sql('weekly_balanced_accuracy', "strftime(week, '%Y-%m-%d')", ['value'], 'a')}
    UNION ALL {_long_sql('agreement', "'all'", ['n', 'agreement_pct', 'kappa'], 'agree')}
    UNION ALL {_long_sql('mcnemar', "'all'", ['b', 'c', 'statistic', 'p_value'], 'mcn')}
    UNION ALL {_long_sql('control_band', "'all'", ['last_value', 'lower', 'upper'], 'last_band')}
    UNION ALL {_long_sql('box_plots', 'metric', ['n', 'q1', 'med', 'q3', 'min', 'max', 'whisker_low', 'whisker_high', 'outliers'], 'boxes')}
    UNION ALL {_long_sql('weekly_site_metrics', "strftime(week, '%Y-%m-%d') || ' ' || site", ['sensitivity', 'specificity'], 'grid')}
    UNION ALL {_long_sql('false_negatives', "CAST(accession_no AS VARCHAR) || ' ' || site", ['gt_llm', 'gt_manual', 'highest_score'], '(SELECT * FROM cases WHERE gt_llm = 0)')}
    UNION ALL {_long_sql('false_positives', "CAST(accession_no AS VARCHAR) || ' ' || site", ['gt_llm', 'gt_manual', 'highest_score'], '(SELECT * FROM cases WHERE gt_llm = 1)')}"""))
def full_report_sections(spark, sf_dir):
    timed = timing.with_times(B.timed_studies(spark, sf_dir))
    return B.rounded(report.report_figures(timed, "1996-01-01", "1999-12-31"), "value")
