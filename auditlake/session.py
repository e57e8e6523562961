"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import contextlib
import posixpath
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName("auditlake")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # cheaper plan building
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The session's own folder under the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Only a local session, whose driver and
    executors share one machine, may leave it unset and then gets a temporary folder.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="auditlake-")
        _own[context.applicationId] = base
    return f"{base.rstrip('/')}/auditlake-{context.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the session's scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove the session's scratch folder: call it when a job's results are written and none of its DataFrames is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(path):
        fs.delete(path, True)


#: For writes: what they have shuffled goes when they are done, not when the driver happens to collect its garbage.
FREE_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Folders of ``materialize`` by their names.
_written: dict[str, str] = {}


def materialize(df, name: str, **options):
    """Write a result once and read it back: cuts lineage and pins its values. Options go to the Parquet writer."""
    path = scratch_path(df.sparkSession, name)
    with settings(df.sparkSession, FREE_SHUFFLES):
        df.write.options(**options).parquet(path)
    _written[posixpath.basename(path)] = path
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._materialized = True
    return held


def release(*frames) -> None:
    """Remove the materialized results that these DataFrames read, and nothing else: call it when nobody will read them any more."""
    for df in frames:
        for name in {posixpath.basename(posixpath.dirname(f)) for f in df.inputFiles()} & _written.keys():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_written.pop(name))
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextlib.contextmanager
def pinned(df, name: str, **options):
    """A materialized result that is removed at the end; what outlives it must not read it. One that the caller has materialized is taken as it is."""
    if getattr(df, "_materialized", False):
        yield df
        return
    held = materialize(df, name, **options)
    try:
        yield held
    finally:
        release(held)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session with other settings for a while; for steps that run at once, such as writes."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
