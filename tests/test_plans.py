"""What the plans must not hold: all-pairs joins, row-wise Python, whole tables in one task."""

import re

import pytest

import __spark_entry__ as entry
from auditlake.operators import sampling
from auditlake.plans import bindings as B

SF_DIR = "/root/testdata/sf0.001"
# These run several jobs while being built; their final plan is a plain read.
EAGER = ("read_", "file_", "classify_", "import_", "labels_", "period_", "disagreement_exports", "view_export",
         "label_sheet_file", "upload_", "pipeline_result", "run_records", "study_table", "incremental", "streaming",
         "grade_pipeline", "backfill_range", "backfill_counts")
# The rules are those of this package's own operators; add-ons choose their style and bring their own tests.
OWN = [n for n, f in entry.queries().items() if f.__module__.startswith("auditlake.plans.")]
LAZY = [n for n in OWN if not n.startswith(EAGER)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_plan(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    if name != "grader_fan_out":
        assert "MapInPandas" not in text
    # One task may only see rows that an aggregation has already cut to one per calendar week.
    if "Exchange SinglePartition" in text and "Window" in text:
        below = text[text.index("Exchange SinglePartition"):]
        assert "HashAggregate" in below or "SortAggregate" in below


def test_scans_read_only_needed_columns(spark):
    text = plan(entry.queries()["site_confusion_metrics"](spark, SF_DIR))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)", text)
    assert schemas and not any("o_totalprice" in s or "c_acctbal" in s for s in schemas)


def test_sample_filters_instead_of_joining_texts(spark):
    drawn = sampling.stratified_sample(B.store(spark, SF_DIR), count=10)
    assert "text_report" in drawn.columns
    joins = plan(drawn).count("SortMergeJoin") + plan(drawn).count("ShuffledHashJoin")
    bare = plan(B.store(spark, SF_DIR)).count("SortMergeJoin") + plan(B.store(spark, SF_DIR)).count("ShuffledHashJoin")
    assert joins <= 4 * bare
