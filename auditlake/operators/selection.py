"""Exact selection by splitters: the row at a rank of any sort order, without sorting the table.

A sample of the rows gives splitters; one pass counts the rows between them exactly, and the search goes on in the interval that holds the rank, with
the sample's rows inside it as the next splitters and a new sample when they are used up. Rows equal to a splitter are an
interval of their own, so ties of any size end the search. It also ends when the rank is so near the range's start that a bounded
top-n reaches it. Every pass is a filter and a count of some hundred groups; the sample and the counts are all that reaches the driver.

End the keys with a unique one: among rows that are equal in all keys the order is open, and those before the rank are skipped one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Splitters of one pass, and rows of one sample.
SPLITTERS = 64
SAMPLE = SPLITTERS**2
#: A bounded top-n of so many rows ends the search.
TOP_ROWS = 4096


@dataclass(frozen=True)
class Key:
    """A sort column: ascending with nulls first, or descending with nulls last; NaN is the largest value."""

    name: str
    descending: bool = False

    def order(self) -> Column:
        return F.col(self.name).desc_nulls_last() if self.descending else F.col(self.name).asc_nulls_first()

    def before(self, value: Column, is_null: bool) -> Column:
        """Rows that come before the value."""
        c = F.col(self.name)
        if self.descending:
            return c.isNotNull() if is_null else F.coalesce(c > value, F.lit(False))
        return F.lit(False) if is_null else c.isNull() | F.coalesce(c < value, F.lit(False))


class Order:
    """A sort order over columns of a table, and comparisons of its rows with given ones. Timestamps travel as microseconds."""

    def __init__(self, df: DataFrame, keys: Sequence[Key]):
        self.keys = list(keys)
        self.types = [df.schema[k.name].dataType for k in keys]

    def columns(self) -> list[Column]:
        return [k.order() for k in self.keys]

    def values(self) -> list[Column]:
        return [F.unix_micros(k.name).alias(k.name) if isinstance(t, T.TimestampType) else F.col(k.name) for k, t in zip(self.keys, self.types, strict=True)]

    def _literals(self, row: Sequence) -> list[Column]:
        return [F.timestamp_micros(F.lit(v)) if isinstance(t, T.TimestampType) else F.lit(v).cast(t) for v, t in zip(row, self.types, strict=True)]

    def before(self, row: Sequence) -> Column:
        """Rows that come before the given one."""
        values, out = self._literals(row), F.lit(False)
        for key, value, given in reversed(list(zip(self.keys, values, row, strict=True))):
            out = key.before(value, given is None) | (F.col(key.name).eqNullSafe(value) & out)
        return out

    def same(self, row: Sequence) -> Column:
        """Rows that are equal to the given one in all keys."""
        return reduce(Column.__and__, [F.col(k.name).eqNullSafe(v) for k, v in zip(self.keys, self._literals(row), strict=True)])

    def interval(self, splitters: Sequence[Sequence]) -> Column:
        """2 i for rows before splitter i and after the one before it, 2 i + 1 for rows equal to splitter i: a search tree of comparisons."""

        def tree(low: int, high: int) -> Column:
            if low == high:
                return F.lit(2 * low)
            middle = (low + high) // 2
            row = splitters[middle]
            return F.when(self.before(row), tree(low, middle)).when(self.same(row), F.lit(2 * middle + 1)).otherwise(tree(middle + 1, high))

        return tree(0, len(splitters))


@dataclass(frozen=True)
class Place:
    """Where a rank lies: ``skip`` rows after those that come before ``row`` (or, unless ``inclusive``, are equal to it)."""

    row: tuple | None
    inclusive: bool
    skip: int

    def rest(self, order: Order) -> Column:
        if self.row is None:
            return F.lit(True)
        return ~order.before(self.row) if self.inclusive else ~order.before(self.row) & ~order.same(self.row)


def locate(df: DataFrame, keys: Sequence[Key], rank: int, total: int, top_rows: int = TOP_ROWS, sample: int = SAMPLE, splitters: int = SPLITTERS) -> Place:
    """The place of a 0-based rank among ``total`` rows in the order of ``keys``; ``skip`` is at most ``top_rows`` if no two rows are equal in all keys."""
    order = Order(df, keys)
    rows, size, place, within, known = df.select(*[k.name for k in keys]), total, Place(None, False, rank), F.lit(True), []
    while place.skip > top_rows and place.skip < size:
        if len(known) < 2:
            share = min(1.0, 1.2 * sample / size)
            part = rows.where(within)
            drawn = (part if share == 1.0 else part.sample(fraction=share)).limit(2 * sample)
            known = [tuple(r) for r in drawn.orderBy(*order.columns()).select(*order.values()).collect()]
            known = list(dict.fromkeys(known))
            continue  # a sample of few rows may be empty: draw again
        step = max(1, len(known) // splitters)
        cuts = known[step // 2 :: step]
        counted = rows.where(within).groupBy(order.interval(cuts).alias("i")).agg(F.count("*").alias("n")).collect()
        counts = {r["i"]: r["n"] for r in counted}
        at, skip = 0, place.skip
        while skip >= counts.get(at, 0):
            skip -= counts.get(at, 0)
            at += 1
        if at % 2:
            return Place(cuts[at // 2], True, skip)
        low, high, size = at // 2 - 1, at // 2, counts[at]
        place = Place(cuts[low], False, skip) if low >= 0 else Place(place.row, place.inclusive, skip)
        if low >= 0:
            within = within & place.rest(order)
        if high < len(cuts):
            within = within & order.before(cuts[high])
        first = known.index(cuts[low]) + 1 if low >= 0 else 0
        known = known[first : known.index(cuts[high]) if high < len(cuts) else len(known)]
    return place


def rows_from(df: DataFrame, keys: Sequence[Key], rank: int, count: int, total: int, **options) -> DataFrame:
    """``count`` rows from a 0-based rank on, in order."""
    order = Order(df, keys)
    place = locate(df, keys, rank, total, **options)
    return df.where(place.rest(order)).orderBy(*order.columns()).offset(place.skip).limit(count)
