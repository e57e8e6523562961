"""Weekly counts that keep up with a stream: one row per week, site, label and prediction, merged batch by batch.

A batch is counted once, its counts are added to the small table of totals, and the new totals are published together with the
batch's number. A batch that comes again is passed over, so replays change nothing; neither state nor old batches are needed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.sources.manifests import Conflict, Manifests, Snapshot

CELLS = "week date, site string, label int, prediction int, n long"
RETRIES = 20


class WeeklyCells:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifests = Manifests(spark, f"{self.root}/manifest")

    def _totals(self, now: Snapshot) -> DataFrame:
        paths = [f"{self.root}/totals/{e['folder']}" for e in now.entries]
        return self.spark.read.schema(CELLS).parquet(*paths) if paths else self.spark.createDataFrame([], CELLS)

    def totals(self) -> DataFrame:
        return self._totals(self.manifests.latest())

    def applied(self, stream: str) -> int:
        """Number of the last batch of a stream that counts; -1 before the first."""
        return max((e["batches"].get(stream, -1) for e in self.manifests.latest().entries), default=-1)

    def merge(self, batch: DataFrame, number: int, stream: str, ts: str, site: Column, label: Column, prediction: Column) -> bool:
        """Add a batch's counts; false if the batch was counted before. Rows without a time or with a null label or prediction don't count."""
        if number <= self.applied(stream):
            return False
        week = F.date_trunc("week", F.col(ts)).cast("date")
        part = (
            batch.select(week.alias("week"), site.cast("string").alias("site"), label.cast("int").alias("label"), prediction.cast("int").alias("prediction"))
            .where(F.col("week").isNotNull() & F.col("label").isNotNull() & F.col("prediction").isNotNull())
            .groupBy("week", "site", "label", "prediction").agg(F.count("*").alias("n"))
        )
        counted = f"{self.root}/parts/{uuid.uuid4().hex}"
        part.write.parquet(counted)  # the batch is read once, also if the merge has to be tried again
        for _ in range(RETRIES):
            now = self.manifests.latest()
            batches = {k: v for e in now.entries for k, v in e["batches"].items()}
            if number <= batches.get(stream, -1):
                return False
            folder = f"v{now.version + 1:09d}-{uuid.uuid4().hex}"
            both = self._totals(now).unionByName(self.spark.read.schema(CELLS).parquet(counted))
            both.groupBy("week", "site", "label", "prediction").agg(F.sum("n").alias("n")).coalesce(1).write.parquet(f"{self.root}/totals/{folder}")
            if self.manifests.publish(Snapshot(now.version + 1, 1, [{"kind": "totals", "folder": folder, "batches": {**batches, stream: number}}])):
                return True
        raise Conflict(f"{self.root}: others kept publishing totals")

    def follow(self, rows: DataFrame, checkpoint: str, stream: str, ts: str, site: Column, label: Column, prediction: Column) -> None:
        """Count everything that has arrived, then stop."""
        query = (
            rows.writeStream.foreachBatch(lambda batch, number: self.merge(batch, number, stream, ts, site, label, prediction) and None)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()


def weekly_confusion(cells: DataFrame, *by: str) -> DataFrame:
    """``tp``, ``tn``, ``fp``, ``fn`` per week (and further columns) from the cells."""

    def sum_of(label: int, prediction: int) -> Column:
        return F.coalesce(F.sum(F.when((F.col("label") == label) & (F.col("prediction") == prediction), F.col("n"))), F.lit(0))

    return cells.groupBy("week", *by).agg(sum_of(1, 1).alias("tp"), sum_of(0, 0).alias("tn"), sum_of(0, 1).alias("fp"), sum_of(1, 0).alias("fn"))
