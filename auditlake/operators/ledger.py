"""Answer ledger: what graders have answered, kept by what they were asked.

An answer belongs to the digest of the inputs, the step and the grader's version. Only digests without an answer are asked,
in waves of ``slots`` tasks with one batch each; a wave's answers are written before the next one begins. So a second run asks
nothing, a run that was broken off goes on with the wave in which it stopped, a lost task asks its batch again and no other, and never
more than ``slots * threads`` calls are in flight, however large the cluster is.

Failed calls are kept apart with their messages; they are asked again by the next run. Rows with equal inputs are asked once.
Null inputs are inputs like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.operators.grading import Grader, apply_grader
from auditlake.session import materialize, scratch_path

#: Reports per batch, tasks at once and calls at once in a task.
BATCH, SLOTS, THREADS = 20, 4, 2


class AnswerLedger:
    def __init__(self, spark: SparkSession, root: str, batch: int = BATCH, slots: int = SLOTS, threads: int = THREADS, delay_seconds: float = 0.0):
        self.spark, self.root = spark, root.rstrip("/")
        self.batch, self.slots, self.threads, self.delay = batch, slots, threads, delay_seconds

    def _folder(self, step: str, version: str, kind: str) -> str:
        return f"{self.root}/{kind}/step={step}/version={version}"

    def _stored(self, folder: str, schema: T.StructType) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)

    def answers(self, step: str, version: str, outputs: str) -> DataFrame:
        """``(digest, outputs...)`` of what has been answered; one row per digest, also if two runs asked at once."""
        schema = T.StructType([T.StructField("digest", T.StringType()), *T._parse_datatype_string(outputs).fields])
        return self._stored(self._folder(step, version, "answers"), schema).dropDuplicates(["digest"])

    def failures(self, step: str, version: str) -> DataFrame:
        schema = T.StructType([T.StructField("digest", T.StringType()), T.StructField("error", T.StringType())])
        return self._stored(self._folder(step, version, "failures"), schema)

    def ask(
        self, df: DataFrame, inputs: Sequence[str], step: str, version: str, factory: Callable[[], Grader], outputs: str, key: str,
    ) -> tuple[DataFrame, int]:
        """``(key, outputs..., error)`` for every row, and how many digests were asked now."""
        names = [f.name for f in T._parse_datatype_string(outputs).fields]
        digest = F.sha2(F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}), 256).alias("digest")
        rows = materialize(df.select(key, digest), "ledger-rows")
        known = self.answers(step, version, outputs).select("digest")
        open_ = materialize(rows.select("digest").distinct().join(known, "digest", "left_anti"), "ledger-open")
        asked = open_.count()
        waves = -(-asked // (self.batch * self.slots))
        if waves:
            # Digests are spread evenly: a batch has about ``batch`` of them. Inputs move once, to their wave and slot.
            batch = F.pmod(F.xxhash64("digest"), F.lit(waves * self.slots))
            placed = df.select(*inputs, digest).join(open_, "digest", "left_semi")
            placed = placed.withColumn("slot", (batch % self.slots).cast("int")).withColumn("wave", F.floor(batch / self.slots))
            path = scratch_path(self.spark, "ledger-waves")
            placed.repartition("wave", "slot").dropDuplicates(["wave", "slot", "digest"]).write.option("compression", "zstd").partitionBy("wave").parquet(path)
            schema = T.StructType([f for f in placed.schema.fields if f.name != "wave"])
            for wave in sorted(r["wave"] for r in open_.select(F.floor(batch / self.slots).alias("wave")).distinct().collect()):
                self._wave(self.spark.read.schema(schema).parquet(f"{path}/wave={wave}"), inputs, step, version, factory, outputs, names)
        failed = self.failures(step, version).groupBy("digest").agg(F.max("error").alias("error"))
        answers = self.answers(step, version, outputs).withColumn("_answered", F.lit(True))
        met = rows.select(key, "digest").join(answers, "digest", "left").join(failed, "digest", "left")
        return met.select(key, *names, F.when(F.col("_answered").isNull(), F.col("error")).alias("error")), asked

    def _wave(self, rows: DataFrame, inputs, step, version, factory, outputs, names) -> None:
        dealt = rows.repartitionById(self.slots, "slot")  # one batch a task
        got = materialize(apply_grader(dealt, inputs, factory, outputs, "digest", threads=self.threads, delay_seconds=self.delay), "ledger-wave")
        got.where(F.col("error").isNull()).select("digest", *names).write.mode("append").parquet(self._folder(step, version, "answers"))
        got.where(F.col("error").isNotNull()).select("digest", "error").write.mode("append").parquet(self._folder(step, version, "failures"))
