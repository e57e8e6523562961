"""Changes to the study table, each as one declarative merge: DataFrames in, DataFrame out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import schema as S
from auditlake.functions import parsing as P
from auditlake.operators.intake import first_per_key

KEY = "accession_no"


def existing_keys(store: DataFrame, incoming: DataFrame, key: str = KEY) -> DataFrame:
    """Keys of ``incoming`` already stored. The store side only streams its key column past it."""
    return store.select(key).join(incoming.select(key).distinct(), key, "left_semi")


def new_rows(store: DataFrame, incoming: DataFrame, key: str = KEY) -> DataFrame:
    return incoming.join(existing_keys(store, incoming, key), key, "left_anti")


def conform(df: DataFrame, schema=S.STUDY_SCHEMA) -> DataFrame:
    """All study columns in order and type; absent ones are null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def insert_if_absent(store: DataFrame, incoming: DataFrame, order: Sequence[str], batch_id: str) -> DataFrame:
    """Only the rows to add: first per key within the batch, unknown to the store, stamped."""
    extra = [c for c in order if c not in S.STUDY_TYPES]
    first = first_per_key(incoming, KEY, order).drop(*extra)
    stamped = new_rows(store, first).withColumns(
        {
            "processing_batch_id": F.lit(batch_id),
            "created_at": F.current_timestamp(),
            "updated_at": F.current_timestamp(),
        }
    )
    return stamped


def upsert_non_null(store: DataFrame, incoming: DataFrame, key: str = KEY, touched: str | None = None) -> DataFrame:
    """Insert new keys; on known ones overwrite only with values that are not null.

    ``touched`` names an extra column that tells the rows with an incoming side.
    """
    old, new = store.alias("o"), incoming.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    kinds = dict(store.dtypes)

    def merged(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(f"o.`{c}`")
        return F.coalesce(F.col(f"n.`{c}`").cast(kinds[c]), F.col(f"o.`{c}`"))

    flag = [F.col(f"n.{key}").isNotNull().alias(touched)] if touched else []
    return joined.select(*[merged(c).alias(c) for c in store.columns], *flag)


def import_outcomes(store: DataFrame, rows: DataFrame, order: Sequence[str], mode: str = "skip") -> DataFrame:
    """One row per imported line: ``(accession_no, outcome)``.

    Outcomes: ``invalid`` (no usable key), ``duplicate`` (not the first line of its key),
    ``new``, and for known keys ``skipped`` or ``updated`` by mode. Lines are folded per key
    before the store is consulted, so a much repeated key stays one row.
    """
    if mode not in ("skip", "update"):
        raise ValueError(f"unknown mode: {mode}")
    per_key = rows.groupBy(KEY).agg(F.count("*").alias("lines"))
    known = existing_keys(store, per_key.where(F.col(KEY).isNotNull())).withColumn("_known", F.lit(True))
    hit = "updated" if mode == "update" else "skipped"
    marked = per_key.join(known, KEY, "left").withColumn(
        "first_outcome",
        F.when(F.col(KEY).isNull(), "invalid").when(F.col("_known"), hit).otherwise("new"),
    )
    pairs = F.array(
        F.struct(
            F.col("first_outcome").alias("outcome"),
            F.when(F.col(KEY).isNull(), F.col("lines")).otherwise(1).alias("lines"),
        ),
        F.struct(
            F.lit("duplicate").alias("outcome"),
            F.when(F.col(KEY).isNull(), 0).otherwise(F.col("lines") - 1).alias("lines"),
        ),
    )
    return marked.select(KEY, F.inline(pairs)).where(F.col("lines") > 0)


def import_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.sum("lines").alias("lines"))


def label_outcomes(
    store: DataFrame, rows: DataFrame, key_column: str, label_column: str, row_no: str = "row_no"
) -> DataFrame:
    """Validate a labels file against the store: ``(row_no, accession_no, label, outcome, message)``."""
    raw_key = F.coalesce(F.trim(F.col(key_column)), F.lit(""))
    raw_label = F.coalesce(F.trim(F.col(label_column)), F.lit(""))
    word = F.lower(raw_label)
    parsed = rows.select(
        row_no,
        raw_key.alias("_raw_key"),
        raw_label.alias("_raw_label"),
        P.accession(raw_key).alias(KEY),
        F.when(word.isin("0", "false", "no"), 0).when(word.isin("1", "true", "yes"), 1).alias("label"),
    )
    known = existing_keys(store, parsed.where(F.col(KEY).isNotNull())).withColumn("_known", F.lit(True))
    joined = parsed.join(known, KEY, "left")
    at = F.concat(F.lit("Row "), F.col(row_no).cast("string"), F.lit(": "))
    problem = (
        F.when(F.col("_raw_key") == "", F.lit("empty accession number."))
        .when(
            F.col(KEY).isNull(),
            F.concat(F.lit('accession "'), F.col("_raw_key"), F.lit('" is not a valid integer.')),
        )
        .when(F.col("_raw_label") == "", F.lit("manual_gt is empty."))
        .when(F.col("label").isNull(), F.concat(F.lit('manual_gt "'), F.col("_raw_label"), F.lit('" is not 0 or 1.')))
        .when(
            F.col("_known").isNull(),
            F.concat(F.lit("accession "), F.col(KEY).cast("string"), F.lit(" not found in database.")),
        )
    )
    return joined.select(
        row_no,
        KEY,
        "label",
        F.when(problem.isNull(), "updated").otherwise("skipped").alias("outcome"),
        F.concat(at, problem).alias("message"),
    )


def accepted_labels(outcomes: DataFrame, row_no: str = "row_no") -> DataFrame:
    """One label per key; the last line wins."""
    good = outcomes.where(F.col("outcome") == "updated")
    return good.groupBy(KEY).agg(F.max_by("label", row_no).alias("label"))


def first_messages(outcomes: DataFrame, limit: int = 50, row_no: str = "row_no") -> DataFrame:
    return outcomes.where(F.col("message").isNotNull()).orderBy(row_no).limit(limit).select(row_no, "message")


def apply_labels(store: DataFrame, labels: DataFrame, field: str = "gt_manual", order: str | None = None) -> DataFrame:
    """Set a label column by key. Of several labels of a key the last by ``order`` counts; without an order the largest."""
    # One label per key, whatever the caller folded: a repeated key must not repeat the study.
    last = F.max_by("label", order) if order else F.max("label")
    one = labels.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(last.alias("_label"))
    joined = store.join(one, KEY, "left")
    kind = dict(store.dtypes)[field]
    return joined.withColumn(field, F.coalesce(F.col("_label").cast(kind), F.col(field))).select(*store.columns)


def backfill_merge(store: DataFrame, found: DataFrame, fields: Sequence[str] = S.LLM_FINDING_FIELDS) -> DataFrame:
    """Set the extracted findings that are not null; everything else stays.

    Several rows of one key are folded first; where they disagree, a finding that is present wins.
    """
    fields = [f for f in fields if f in found.columns]
    if not fields:
        return store
    right = found.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(*[F.max(f).alias(f"_new_{f}") for f in fields])
    kinds = dict(store.dtypes)
    joined = store.join(right, KEY, "left")
    return joined.withColumns(
        {f: F.coalesce(F.col(f"_new_{f}").cast(kinds[f]), F.col(f)) for f in fields}
    ).select(*store.columns)


def edit_rows(
    store: DataFrame, changes: DataFrame, order: str = "seq", readonly: Sequence[str] = S.READONLY_FIELDS,
    touched_at: Column | None = None,
) -> DataFrame:
    """Apply ``(accession_no, field, value, seq)`` edits; the last edit of a field wins.

    Read-only and unknown fields are ignored, an empty value clears the field. Per study the
    edits fold into one map of at most as many entries as there are editable fields.
    """
    editable = [c for c in store.columns if c not in readonly]
    last = (
        changes.where(F.col("field").isin(editable))
        .groupBy(KEY, "field")
        .agg(F.max_by(F.coalesce(F.col("value"), F.lit("")), order).alias("value"))
        .groupBy(KEY)
        .agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_edits"))
    )
    kinds = dict(store.dtypes)
    joined = store.join(last, KEY, "left")
    edits = F.col("_edits")

    def edited(c: str) -> Column:
        value = F.nullif(F.try_element_at(edits, F.lit(c)), F.lit(""))
        present = F.coalesce(F.map_contains_key(edits, F.lit(c)), F.lit(False))
        return F.when(present, value.try_cast(kinds[c])).otherwise(F.col(c))

    columns: Mapping[str, Column] = {c: edited(c) for c in editable}
    if "updated_at" in store.columns:
        now = F.current_timestamp() if touched_at is None else touched_at
        columns = {**columns, "updated_at": F.when(edits.isNotNull(), now).otherwise(F.col("updated_at"))}
    return joined.withColumns(columns).select(*store.columns)


def delete_keys(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select(KEY).distinct(), KEY, "left_anti")
