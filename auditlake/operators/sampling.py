"""Sampling of unlabelled reports for manual review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import schema as S
from auditlake.operators import filters as P
from auditlake.operators import ordering as O
from auditlake.session import materialize


def sampling_pool(
    df: DataFrame, first: str | None = None, last: str | None = None,
    label: str = "gt_manual", text: str = "text_report", pct: int = S.RECOMMENDED_SAMPLE_PCT,
) -> DataFrame:
    """Reports with text, those without a label, their split by stratum, and the advised sample size."""
    pool = df.where(P.has_text(text) & P.date_range("procedure_start_date", first, last))
    open_ = F.col(label).isNull()
    priority = P.priority_workplace()
    return pool.agg(
        F.count("*").alias("total"),
        F.count_if(open_).alias("without_gt"),
        F.count_if(open_ & priority).alias("priority_count"),
        F.count_if(open_ & ~priority).alias("other_count"),
    ).withColumn(
        "recommended_count", F.greatest(F.lit(1), F.ceil(F.col("without_gt") * pct / 100)).cast("bigint")
    )


def sample_sizes(
    pool: DataFrame, count: int | None = None, pct: float | None = None
) -> DataFrame:
    """How many to take per stratum from a pool row: halves, each side filling the other's gap.

    The size is an absolute count or a percentage of the pool (1 to 100); both are clamped to it.
    """
    if (count is None) == (pct is None):
        raise ValueError("give either count or pct")
    if count is not None and count < 1:
        raise ValueError("count must be at least 1")
    have = F.col("priority_count") + F.col("other_count")
    asked = F.lit(count) if count is not None else F.ceil(have * min(max(pct, 1), 100) / 100)
    return pool.select(
        "priority_count", "other_count", F.least(asked, have).cast("bigint").alias("count")
    ).withColumns(
        {
            "priority_take": _take(F.floor(F.col("count") / 2), "priority_count", "other_count"),
            "other_take": _take(F.col("count") - F.floor(F.col("count") / 2), "other_count", "priority_count"),
        }
    )


def _take(goal: Column, own: str, other: str) -> Column:
    """Own goal plus what the other stratum cannot fill, as far as the own pool goes."""
    other_gap = F.greatest(F.lit(0), F.col("count") - goal - F.col(other))
    return F.least(F.col(own), goal + other_gap).cast("bigint")


def stratified_sample(
    df: DataFrame, count: int | None = None, pct: float | None = None,
    first: str | None = None, last: str | None = None, seed: int = 42,
    label: str = "gt_manual", text: str = "text_report", key: str = "accession_no",
) -> DataFrame:
    """Seeded sample without replacement, half priority workplaces and half others.

    The draw is the lowest hashes per stratum, so it does not depend on partitioning and a
    retried task draws the same rows. Telling which reports have a text reads the texts; that
    pass keeps keys and hashes only and is written once. Sizes and the cut come from there, and
    a second pass filters the wide rows by the cut without moving them.
    """
    pool = df.where(P.unlabelled(label, text) & P.date_range("procedure_start_date", first, last)).withColumns(
        {
            "stratum": F.when(P.priority_workplace(), "priority").otherwise("other"),
            "_hash": O.hash_order(F.col(key), seed),
        }
    )
    keys = materialize(pool.select("stratum", "_hash", key), "sample-keys")
    in_stratum = {s: F.count_if(F.col("stratum") == s).alias(f"{s}_count") for s in ("priority", "other")}
    quota = sample_sizes(keys.agg(*in_stratum.values()), count, pct).select(
        F.inline(
            F.array(*[F.struct(F.lit(s).alias("stratum"), F.col(f"{s}_take").alias("take")) for s in in_stratum])
        )
    )
    cut = F.broadcast(O.lowest_cut(keys, "stratum", "_hash", key, quota))
    drawn = pool.join(cut, "stratum").where(F.struct("_hash", key) <= F.col("cut"))
    return drawn.drop("_hash", "cut")


def label_sheet(sample: DataFrame, key: str = "accession_no", text: str = "text_report") -> DataFrame:
    """The blank sheet handed to reviewers, oldest study first."""
    return sample.orderBy(F.col("procedure_start_date").asc_nulls_first(), key).select(
        key, F.coalesce(F.col(text), F.lit("")).alias(text), F.lit("").alias("manual_gt")
    )
