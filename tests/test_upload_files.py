"""The upload's report export: several files, in the order of the workplace."""

import pathlib
import time
from collections import Counter

from pyspark.sql import functions as F

from auditlake.plans import queries_exchange
from auditlake.session import materialize, pinned, release, scratch_root, settings
from auditlake.sources import exports


def test_reports_do_not_pass_through_one_task(spark):
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        path, _ = queries_exchange._upload_files(spark, "/root/testdata/sf0.001")
    files = sorted(str(p) for p in pathlib.Path(path.removeprefix("file:")).glob("*.csv"))
    places = [[r["WORKPLACE"] for r in exports.read_csv(spark, f).select("WORKPLACE").collect()] for f in files]
    assert sum(map(bool, places)) > 1
    every = [p for some in places for p in some if p is not None]
    assert every == sorted(every)


def _scratch(spark) -> Counter:
    return Counter(p.name.rpartition("-")[0] for p in pathlib.Path(scratch_root(spark).removeprefix("file:")).iterdir())


def test_copies_of_the_texts_go_when_they_are_not_read_any_more(spark):
    materialize(spark.range(1), "first")
    before = _scratch(spark)
    with settings(spark, {"spark.sql.files.openCostInBytes": "4k"}):  # files are read by ranges
        rows = queries_exchange.upload_to_store(spark, "/root/testdata/sf0.001")
    left = _scratch(spark) - before
    assert left["upload-timed"] == 1 and left["reports"] == 1  # the export file
    assert not {"csv-records", "upload-reports", "insert"} & left.keys()
    assert rows.count() > 0


def test_only_materialized_results_are_released(spark, tmp_path):
    path = str(tmp_path / "kept")
    spark.range(3).write.parquet(path)
    one, two = materialize(spark.range(3), "one"), materialize(spark.range(3), "two")
    release(spark.read.parquet(path).union(one))
    with pinned(spark.range(3), "three") as three:
        assert three.count() == 3
    left = _scratch(spark)
    assert not left["one"] and left["two"] and not left["three"] and spark.read.parquet(path).count() == 3 and two.count() == 3


def test_shuffle_files_go_with_the_write(spark):
    blocks = spark._jsc.sc().env().blockManager().diskBlockManager()
    names = lambda: {str(blocks.getAllFiles().apply(i).getName()) for i in range(blocks.getAllFiles().size())}
    before = names()
    materialize(spark.range(50_000).groupBy((F.col("id") % 9999).alias("k")).agg(F.max("id")), "summed")
    for _ in range(50):
        if not any(n.startswith("shuffle_") for n in names() - before):
            return
        time.sleep(0.1)
    raise AssertionError("shuffle files stay")
