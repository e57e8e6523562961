"""Incremental forms: files dropped into a folder, and weekly metrics over a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.confusion import cell_counts, with_ratios
from auditlake.sources.study_table import StudyTable


def ingest(stream: DataFrame, table: StudyTable, order: Sequence[str], checkpoint: str) -> None:
    """Insert-if-absent of everything that has arrived, then stop.

    A batch repeated after a failure finds its keys present and adds nothing.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        table.insert(batch, order, f"stream-{batch_id}")

    query = (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def weekly_windows(stream: DataFrame, ts: str, aggs: Sequence[Column], lateness: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Monday-to-Monday windows; the epoch was a Thursday, so windows start four days off it.

    The state is one row per week and group, so it is kept by default: rows of a backlog count in any order of their
    files. With ``lateness`` a watermark drops weeks, and rows that come later than that.
    """
    return (
        (stream.withWatermark(ts, lateness) if lateness else stream)
        .groupBy(F.window(ts, "7 days", startTime="4 days"), *by)
        .agg(*aggs)
        .withColumn("week", F.col("window.start").cast("date"))
        .drop("window")
    )


def weekly_confusion(stream: DataFrame, label: str, prediction: str, ts: str, lateness: str | None = None) -> DataFrame:
    return with_ratios(weekly_windows(stream, ts, cell_counts(label, prediction), lateness))


def run_updates(result: DataFrame, path: str, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """Run an update-mode aggregation over what has arrived and return its latest rows.

    Each micro-batch writes its changed rows to its own folder, overwriting it if the batch is
    repeated, so a retry leaves no doubles.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch-{batch_id:09d}")

    query = (
        result.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    written = result.sparkSession.read.option("recursiveFileLookup", True).parquet(path)
    others = [c for c in result.columns if c not in keys]
    latest = written.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_row"))
    return latest.select(*keys, "_row.*")

