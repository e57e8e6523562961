"""Exact order statistics and exact top-n picks without sorting a group in one task.

Both work in two steps. Rows are first counted per coarse bucket of the sort key, where the
bucket keeps the order; the counts say which few buckets hold the wanted ranks. Only rows of
those buckets are looked at again. The first step shuffles one row per bucket and task, the
second only a sliver of the data, so a group may be as large as it likes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_E = 256


def value_bucket(value: Column) -> Column:
    """An order-keeping bucket about 0.4 % wide; no knowledge of the data range is needed."""
    v = value.cast("double")
    size = F.floor(F.least(F.log1p(F.abs(v)), F.lit(800.0)) * BUCKETS_PER_E)
    return F.when(v < 0, -size).otherwise(size).cast("int")


def pick_ranks(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    ranks: Callable[[Column], Column],
    aggs: Mapping[str, Column] | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """Values at 1-based ranks within each group.

    ``ranks`` maps the group size to an array of ranks. The result has one row per group:
    ``by``, ``total``, ``sum``, ``min``, ``max``, the extra count ``aggs`` and ``picks``, a map
    rank -> struct(value, below, through) where ``below`` counts rows under that value and
    ``through`` rows up to and including it.

    ``few_groups`` states that ``by`` comes from a fixed small domain (metric names, sites);
    the list of wanted buckets is then broadcast, otherwise the join strategy is left open.
    """
    by = list(by)
    if not by:
        raise ValueError("name at least one grouping column; use a literal for the whole table")
    aggs = dict(aggs or {})
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *by, F.col(value).alias("_v"), value_bucket(F.col(value)).alias("_bucket"),
        *[c.cast("int").alias(f"_x_{n}") for n, c in aggs.items()],
    )
    buckets = rows.groupBy(*by, "_bucket").agg(
        F.count("*").alias("_n"), F.sum(F.col("_v").cast("double")).alias("_sum"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        *[F.sum(f"_x_{n}").alias(f"_x_{n}") for n in aggs],
    )
    # Buckets per group are bounded by the number format, not by the data.
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = {
        "total": F.sum("_n").over(whole), "sum": F.sum("_sum").over(whole),
        "min": F.min("_min").over(whole), "max": F.max("_max").over(whole),
        **{n: F.sum(f"_x_{n}").over(whole) for n in aggs},
    }
    wanted = (
        buckets.withColumns(totals)
        .withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
        .withColumn("_want", F.array_distinct(ranks(F.col("total"))))
        .withColumn(
            "_want",
            F.filter("_want", lambda r: (r > F.col("_before")) & (r <= F.col("_before") + F.col("_n"))),
        )
        .where(F.size("_want") > 0)
        .select(*by, "_bucket", "_before", "_want", *totals)
    )
    places = wanted.select(*by, "_bucket")
    if few_groups:
        wanted, places = F.broadcast(wanted), F.broadcast(places)
    inside = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # Counting per value comes before anything else, so that a hot value shrinks on the map side.
    histogram = (
        rows.select(*by, "_bucket", "_v")
        .join(places, [*by, "_bucket"], "left_semi")
        .groupBy(*by, "_bucket", "_v")
        .agg(F.count("*").alias("_n"))
    )
    return (
        histogram.join(wanted, [*by, "_bucket"])
        .withColumn("_through", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_below", F.col("_through") - F.col("_n"))
        .select(
            *by,
            *totals,
            F.explode(
                F.filter("_want", lambda r: (r > F.col("_below")) & (r <= F.col("_through")))
            ).alias("_rank"),
            F.struct(
                F.col("_v").alias("value"), F.col("_below").alias("below"), F.col("_through").alias("through")
            ).alias("_pick"),
        )
        .groupBy(*by, *totals)
        .agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_pick"))).alias("picks"))
    )


def _cut_rank(i: int, n: int, total: Column) -> Column:
    """Lower rank of cut i of n by the exclusive method, kept inside the data."""
    j = F.floor(i * (total + 1) / n).cast("bigint")
    return F.greatest(F.lit(1), F.least(j, total - 1)).cast("bigint")


def exclusive_ranks(cuts: Sequence[tuple[int, int]]) -> Callable[[Column], Column]:
    def ranks(total: Column) -> Column:
        lows = [_cut_rank(i, n, total) for i, n in cuts]
        return F.array(*lows, *[F.least(j + 1, total) for j in lows])

    return ranks


def exclusive_cut(i: int, n: int, total: Column, picks: Column) -> Column:
    """Cut point i of n equal parts, exclusive method; extrapolates on tiny groups."""
    j = _cut_rank(i, n, total)
    low = F.element_at(picks, j)["value"].cast("double")
    high = F.element_at(picks, F.least(j + 1, total))["value"].cast("double")
    delta = i * (total + 1) - j * n
    return F.when(total == 1, low).otherwise((low * (n - delta) + high * delta) / n)


def count_at_least(i: int, n: int, cut: Column, total: Column, picks: Column) -> Column:
    """Rows at or above cut i of n, read off the picked ranks instead of a further scan."""
    j = _cut_rank(i, n, total)
    low, high = F.element_at(picks, j), F.element_at(picks, F.least(j + 1, total))
    return (
        F.when(cut <= low["value"], total - low["below"])
        .when(cut <= high["value"], total - high["below"])
        .otherwise(total - high["through"])
    )


def median(total: Column, picks: Column) -> Column:
    low = F.element_at(picks, F.floor((total + 1) / 2).cast("bigint"))["value"]
    high = F.element_at(picks, F.ceil((total + 1) / 2).cast("bigint"))["value"]
    return (low + high) / 2


def median_ranks(total: Column) -> Column:
    return F.array(F.floor((total + 1) / 2).cast("bigint"), F.ceil((total + 1) / 2).cast("bigint"))


HASH_DIGITS = 4


def hash_order(key: Column, seed: int) -> Column:
    """A reproducible random order: the same key and seed give the same place everywhere."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def lowest_cut(keys: DataFrame, stratum: str, sort_key: str, tie: str, quota: DataFrame) -> DataFrame:
    """Where the first ``take`` rows of each stratum end, in order of a hex ``sort_key``.

    ``quota`` has one row per stratum, ``(stratum, take)``, with strata from a fixed small set.
    The result has one row per stratum with rows to take: ``(stratum, cut)``, the last row's
    ``struct(sort_key, tie)``. Counts per hash prefix place the cut; only rows sharing the cut
    prefix, one in 65,536, are shuffled and ranked.
    """
    rows = keys.select(stratum, sort_key, tie, F.substring(sort_key, 1, HASH_DIGITS).alias("_bucket"))
    counts = rows.groupBy(stratum, "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(stratum).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    edge = (
        counts.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
        .join(F.broadcast(quota), stratum)
        .where((F.col("_before") < F.col("take")) & (F.col("take") <= F.col("_before") + F.col("_n")))
        .select(stratum, "_bucket", (F.col("take") - F.col("_before")).alias("_left"))
    )
    in_edge = Window.partitionBy(stratum, "_bucket").orderBy(sort_key, tie)
    return (
        rows.join(F.broadcast(edge), [stratum, "_bucket"])
        .withColumn("_rank", F.row_number().over(in_edge))
        .where(F.col("_rank") == F.col("_left"))
        .select(stratum, F.struct(sort_key, tie).alias("cut"))
    )
