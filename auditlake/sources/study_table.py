"""The study table: Parquet by month of the procedure and bucket of the key, changed by writing new files only.

* **Rows** land in fresh folders, by month, and are dealt to files by bucket of the key. **Changes** (patches that set some columns, and deletions) are narrow rows by
  key in folders of their own. A reader joins the pending changes of a month to its rows; months without any are
  plain scans. ``compact`` writes months anew with their changes applied.
* **Versions.** A write becomes visible by publishing a snapshot that lists everything live, so readers open one file however
  long the history is. A version number is taken by one writer only. A writer whose buckets were touched since it read
  starts over from the newest snapshot, so interleaved writers lose nothing; others just take the next number.
  A job that dies leaves nothing visible, and no path is ever overwritten.
* **Key index.** Every write records the key range and a Bloom filter per file. Inserts and changes open the files that may hold their
  keys, not the store.

Row and change folders carry the version that their writer started from, plus one. A change applies to rows of lower versions, so a key may be deleted
and inserted again.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake import schema as S
from auditlake.operators import merges as M
from auditlake.operators.intake import first_per_key
from auditlake.session import FREE_SHUFFLES, materialize, pinned, release, settings
from auditlake.sources import key_index
from auditlake.sources.manifests import Conflict, Manifests, Snapshot

NO_MONTH = "none"
RUN = (
    "run_id string, task_type string, status string, records long, added long, skipped long, "
    "message string, started_at timestamp, completed_at timestamp"
)
#: How often a writer starts over because others touched its buckets.
RETRIES = 20


def month_of(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit(NO_MONTH))


class StudyTable:
    """``buckets`` counts for a new table: so many that a month's bucket suits one task."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType = S.STUDY_SCHEMA, buckets: int = 1):
        self.spark, self.root, self.schema, self.new_buckets = spark, root.rstrip("/"), schema, buckets
        self.manifests = Manifests(spark, f"{self.root}/manifest")
        self.change_schema = T.StructType([
            *schema.fields, T.StructField("_deleted", T.BooleanType()), T.StructField("_set", T.ArrayType(T.StringType()))])

    # -- reading ---------------------------------------------------------------------------

    def snapshot(self) -> Snapshot:
        now = self.manifests.latest()
        return now if now.version else Snapshot(buckets=self.new_buckets)

    def months(self) -> list[str]:
        return sorted({e["month"] for e in self.snapshot().entries if e["kind"] == "rows"})

    def read(self, months: Sequence[str] | None = None) -> DataFrame:
        return self._rows(self.snapshot(), months)

    def read_period(self, first: str, last: str) -> DataFrame:
        """Studies that started between two days, inclusive; other months are not opened."""
        from auditlake.operators.filters import date_range

        now = self.snapshot()
        months = {e["month"] for e in now.entries if e["month"] != NO_MONTH and first[:7] <= e["month"] <= last[:7]}
        return self._rows(now, months).where(date_range("procedure_start_date", first, last))

    def _paths(self, entries: list[dict], files: dict[tuple[str, str], list[str]] | None = None) -> list[str]:
        """Where the entries' data lies, as few paths as possible: whole folders, months of folders, or some ``files`` of them."""
        whole: dict[tuple[str, str], list[dict]] = {}
        paths = []
        for e in entries:
            some = None if files is None else files[e["folder"], e["month"]]
            if some is None or len(some) == e["files"]:
                whole.setdefault((e["kind"], e["folder"]), []).append(e)
            else:
                paths += [f"{self.root}/{n}" for n in some]
        for (kind, folder), months in whole.items():
            root = f"{self.root}/{kind}/{folder}"
            paths += [root] if len(months) == months[0]["months"] else [f"{root}/month={e['month']}" for e in months]
        return paths

    def _rows(self, now: Snapshot, months: Sequence[str] | None = None, files: dict[tuple[str, str], list[str]] | None = None) -> DataFrame:
        """Rows with their changes: of all or some months, or of some files only."""

        def chosen(e: dict) -> bool:
            return (months is None or e["month"] in months) if files is None else (e["folder"], e["month"]) in files

        rows = [e for e in now.entries if e["kind"] == "rows" and chosen(e)]
        held = {e["month"] for e in rows}
        changes = [e for e in now.entries if e["kind"] == "changes" and e["month"] in held]
        changed = {e["month"] for e in changes}
        plain = self._paths([e for e in rows if e["month"] not in changed], files)
        merged = self._paths([e for e in rows if e["month"] in changed], files)
        parts = [self._parquet(self.schema, plain)] if plain else []
        if merged:
            parts.append(self._merge(merged, changes))
        return functools.reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def _parquet(self, schema: T.StructType, paths: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths)

    def _versioned(self, schema: T.StructType, paths: list[str], name: str) -> DataFrame:
        version = F.regexp_extract("_metadata.file_path", r"/v(\d+)-[0-9a-f]+/", 1).cast("long")
        return self._parquet(schema, paths).select("*", version.alias(name))

    def _merge(self, rows: list[str], entries: list[dict]) -> DataFrame:
        """Rows joined with their pending changes: a column has the value of the latest change that sets it.

        A key has at most one change per write, so ``compact`` bounds what is gathered per key.
        """
        touched = [c for c in self.schema.names if any(c in e["columns"] for e in entries)]
        narrow = T.StructType([f for f in self.change_schema.fields if f.name in {M.KEY, "_deleted", "_set", *touched}])
        changes = self._versioned(narrow, self._paths(entries), "_at")
        folded = changes.groupBy(M.KEY).agg(F.array_sort(F.collect_list(F.struct("_at", "_deleted", "_set", *touched))).alias("_changes"))
        met = self._versioned(self.schema, rows, "_version").join(folded, M.KEY, "left")
        # Null where nothing is pending: conditions over it are then not true, and values stay.
        met = met.withColumn("_changes", F.filter("_changes", lambda c: c["_at"] > F.col("_version")))
        met = met.where(~F.coalesce(F.exists("_changes", lambda c: c["_deleted"]), F.lit(False)))

        def value(c: str) -> Column:
            set_ = F.filter("_changes", lambda x: F.array_contains(x["_set"], c))
            return F.when(F.size(set_) > 0, F.get(F.reverse(set_), F.lit(0))[c]).otherwise(F.col(c))

        return met.select(*[value(c).alias(c) if c in touched else F.col(c) for c in self.schema.names])

    # -- finding keys ----------------------------------------------------------------------

    def _bucket(self, now: Snapshot) -> Column:
        return F.pmod(key_index.key_hash(M.KEY), F.lit(now.buckets)).cast("int")

    def candidates(self, keys: DataFrame, now: Snapshot | None = None) -> dict[tuple[str, str], list[str]]:
        """Files that may hold any of the keys, by folder and month: the index names them, no data file is opened."""
        now = now or self.snapshot()
        live = sorted({(e["folder"], e["month"]) for e in now.entries if e["kind"] == "rows"})
        if not live:
            return {}
        schema = T._parse_datatype_string(key_index.INDEX)
        index = self._parquet(schema, [f"{self.root}/keys/{f}" for f in sorted({f for f, _ in live})])
        alive = F.broadcast(self.spark.createDataFrame(live, "folder string, month string"))  # of the size of the manifest
        index = index.join(alive, ["folder", "month"], "left_semi")
        found: dict[tuple[str, str], list[str]] = {}
        stored = sum(e["rows"] for e in now.entries if e["kind"] == "rows")
        for r in key_index.candidate_files(index, keys, M.KEY, self._bucket(now), stored).collect():  # names of files
            found.setdefault((r["folder"], r["month"]), []).append(r["file"])
        return found

    def rows_of(self, keys: DataFrame, now: Snapshot | None = None) -> DataFrame:
        """Stored rows of the given keys, from the files that may hold them."""
        now = now or self.snapshot()
        rows = self._rows(now, files=self.candidates(keys, now))
        return rows.join(keys.select(M.KEY).distinct(), M.KEY, "left_semi")

    # -- writing ---------------------------------------------------------------------------

    def _write(self, rows: DataFrame, kind: str, now: Snapshot) -> list[dict]:
        """Write rows (with a column ``month``) into a fresh folder; returns its entries, one per month.

        Rows are dealt by month and bucket: in large writes a file holds one bucket of a month, in small ones all of it.
        """
        folder = f"v{now.version + 1:09d}-{uuid.uuid4().hex}"
        path = f"{self.root}/{kind}/{folder}"
        dealt = (
            rows.withColumn("_bucket", self._bucket(now))
            .hint("rebalance", "month", "_bucket")
            .sortWithinPartitions("month", "_bucket", "procedure_start_date")
            .drop("_bucket")
        )
        with settings(self.spark, FREE_SHUFFLES):
            dealt.write.partitionBy("month").parquet(path, compression="zstd")
        file = F.col("_metadata.file_path")
        columns = [M.KEY] + ["_set"] * (kind == "changes")
        written = self._parquet(T.StructType([self.change_schema[c] for c in columns]), [path]).select(
            *columns, F.regexp_extract(file, rf"({kind}/{folder}/.*)$", 1).alias("file"), F.lit(folder).alias("folder"),
            F.regexp_extract(file, r"/month=([^/]+)/", 1).alias("month"), self._bucket(now).alias("bucket"))
        if kind == "rows":
            key_index.index_files(written, M.KEY).write.parquet(f"{self.root}/keys/{folder}")
            written = self._parquet(T._parse_datatype_string(key_index.INDEX), [f"{self.root}/keys/{folder}"])
            sums = [F.sum("rows").alias("rows"), F.array_distinct(F.flatten(F.collect_set("buckets"))).alias("buckets"), F.array().cast("array<string>").alias("columns")]
        else:
            sums = [F.count("*").alias("rows"), F.collect_set("bucket").alias("buckets"), F.array_distinct(F.flatten(F.collect_set("_set"))).alias("columns")]
        found = written.groupBy("month").agg(F.count_distinct("file").alias("files"), *sums).orderBy("month").collect()  # one row per month
        return [
            {"kind": kind, "folder": folder, "month": r["month"], "version": 0, "rows": r["rows"], "files": r["files"], "months": len(found),
             "buckets": sorted(r["buckets"]), "columns": sorted(r["columns"])}
            for r in found
        ]

    def _commit(self, build: Callable[[Snapshot], tuple[list[dict], list[dict], set[int]]]) -> int:
        """Publish what ``build`` writes: (entries to add, entries to remove, buckets that it has read).

        If others have changed one of those buckets since the snapshot that ``build`` was given, it is called again with a newer one; if they
        only were faster with other buckets, the entries join theirs.
        """
        for _ in range(RETRIES):
            now = self.snapshot()
            added, removed, buckets = build(now)
            if not added and not removed:
                return now.version
            while True:
                latest = self.snapshot()
                since = [e for e in latest.entries if e["version"] > now.version]
                if latest.buckets != now.buckets or any(buckets & set(e["buckets"]) for e in since) or any(e not in latest.entries for e in removed):
                    break
                kept = [e for e in latest.entries if e not in removed]
                version = latest.version + 1
                if self.manifests.publish(Snapshot(version, now.buckets, kept + [{**e, "version": version} for e in added])):
                    return version
        raise Conflict(f"{self.root}: others kept changing the same buckets")

    def _buckets_of(self, keys: DataFrame, now: Snapshot) -> set[int]:
        found = keys.where(F.col(M.KEY).isNotNull()).select(self._bucket(now).alias("b")).distinct().collect()
        return {r["b"] for r in found}  # at most the table's number of buckets

    def _with_month(self, rows: DataFrame) -> DataFrame:
        return M.conform(rows, self.schema).withColumn("month", month_of(F.col("procedure_start_date")))

    def _change(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """Apply ``change`` to the stored rows of the keys and write what differs: patches, deletions, new rows.

        A row whose month changes is deleted in the old one and added to the new one.
        """

        def build(now: Snapshot):
            before = materialize(self.rows_of(keys, now), "before")
            names = self.schema.names
            old = before.select(M.KEY, month_of(F.col("procedure_start_date")).alias("_month"), F.struct(*names).alias("_old"))
            both = self._with_month(change(before)).withColumn("_new", F.lit(True)).join(old, M.KEY, "full_outer")
            differs = F.array_compact(F.array(*[F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in names]))
            kind = (
                F.when(F.col("_new").isNull(), "gone").when(F.col("_old").isNull(), "new").when(F.col("month") != F.col("_month"), "moved")
                .when(F.size("_set") > 0, "set")
            )
            told = materialize(both.withColumn("_set", differs).withColumn("_kind", kind).drop("_old").where(F.col("_kind").isNotNull()), "differences")
            kinds = {r["_kind"] for r in told.select("_kind").distinct().collect()}  # four at most
            added = []
            if kinds & {"new", "moved"}:
                added += self._write(told.where(F.col("_kind").isin("new", "moved")).select(*names, "month"), "rows", now)
            if kinds - {"new"}:
                gone = F.col("_kind") != "set"
                patches = told.where(F.col("_kind") != "new").select(
                    *names, gone.alias("_deleted"), F.when(gone, F.array().cast("array<string>")).otherwise(F.col("_set")).alias("_set"), F.col("_month").alias("month"))
                added += self._write(patches, "changes", now)
            release(before, told)
            return added, [], self._buckets_of(keys, now)

        return self._commit(build)

    # What a caller hands in is written once: it is read to find rows and to merge, and again if the writer starts over. Then it goes.

    def insert(self, incoming: DataFrame, order: Sequence[str], batch_id: str) -> int:
        """Insert if absent; running it again adds nothing."""
        with pinned(incoming, "insert", compression="zstd") as rows:

            def build(now: Snapshot):
                stored = self.rows_of(rows.select(M.KEY), now).select(M.KEY)
                new = self._with_month(M.insert_if_absent(stored, rows, order, batch_id))
                return self._write(new, "rows", now), [], self._buckets_of(rows, now)

            return self._commit(build)

    def upsert(self, incoming: DataFrame, order: Sequence[str] = ()) -> int:
        """Insert new keys and overwrite known ones with values that are not null.

        Rows without a key are left out, and of several rows of a key the first counts (by ``order``, else by all columns).
        """
        extra = [c for c in order if c not in S.STUDY_TYPES]
        keyed = incoming.where(F.col(M.KEY).isNotNull())
        now_ = F.current_timestamp()
        with pinned(first_per_key(keyed, M.KEY, list(order) or keyed.columns).drop(*extra), "upsert", compression="zstd") as rows:

            def change(before: DataFrame) -> DataFrame:
                merged = M.upsert_non_null(before, rows, touched="_touched")
                return merged.withColumns({
                    "created_at": F.coalesce("created_at", now_),
                    "updated_at": F.when(F.col("_touched"), now_).otherwise(F.col("updated_at")),
                })

            return self._change(rows.select(M.KEY), change)

    def set_labels(self, labels: DataFrame, field: str = "gt_manual") -> int:
        """Labels by key; with a column ``row_no`` the last line of a key counts."""
        order = "row_no" if "row_no" in labels.columns else None
        with pinned(labels.select(M.KEY, "label", *[c for c in ("row_no",) if c in labels.columns]), "labels") as given:
            return self._change(given.select(M.KEY), lambda rows: M.apply_labels(rows, given, field, order))

    def backfill(self, found: DataFrame) -> int:
        with pinned(found, "backfill") as given:
            return self._change(given.select(M.KEY), lambda rows: M.backfill_merge(rows, given))

    def edit(self, changes: DataFrame) -> int:
        with pinned(changes, "edits") as given:
            return self._change(given.select(M.KEY), lambda rows: M.edit_rows(rows, given))

    def delete(self, keys: DataFrame) -> int:
        with pinned(keys.select(M.KEY).distinct(), "deletes") as given:
            return self._change(given, lambda rows: M.delete_keys(rows, given))

    def compact(self, months: Sequence[str] | None = None) -> int:
        """Write months anew that have changes or several folders of rows; readers then find one folder without changes."""

        def build(now: Snapshot):
            by_month: dict[str, list[dict]] = {}
            for e in now.entries:
                if months is None or e["month"] in months:
                    by_month.setdefault(e["month"], []).append(e)
            old = [e for entries in by_month.values() if len(entries) > 1 for e in entries]
            if not old:
                return [], [], set()
            rows = self._rows(now, {e["month"] for e in old})
            added = self._write(rows.withColumn("month", month_of(F.col("procedure_start_date"))), "rows", now)
            for e in added:  # whatever the replaced entries touched
                e["buckets"] = sorted({b for o in old if o["month"] == e["month"] for b in o["buckets"]} | set(e["buckets"]))
            return added, old, {b for e in old for b in e["buckets"]}

        return self._commit(build)

    # -- run records -----------------------------------------------------------------------

    def record_run(self, **run) -> None:
        """Append one row about a finished job."""
        names = [f.name for f in T._parse_datatype_string(RUN).fields]
        row = tuple(run.get(n) for n in names)
        self.spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").parquet(f"{self.root}/runs")

    def record_runs(self, runs: DataFrame) -> None:
        """Append a row per finished job; columns that are not given stay null."""
        M.conform(runs, T._parse_datatype_string(RUN)).write.mode("append").parquet(f"{self.root}/runs")

    def runs(self) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(f"{self.root}/runs")
