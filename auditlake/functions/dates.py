"""Dates in text: one pattern takes a cell apart, its shape says what the parts are, and a column's votes say which of day and month comes first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.binding import bind, literals

MONTHS = "january february march april may june july august september october november december".split()
_MONTH = "|".join(m[:3] + (f"(?:{m[3:]})?" if m[3:] else "") for m in MONTHS)
_PART, _GAP = rf"(\d{{1,4}}|{_MONTH})", r"(?:\s*([-/.,])\s*|\s+)"
#: Compact date, or three parts with gaps; then a clock of any kind.
PATTERN = (
    rf"(?i)^(?:(\d{{4}})(\d{{2}})(\d{{2}})|{_PART}{_GAP}{_PART}{_GAP}(\d{{1,4}}))"
    r"(?:(?:\s*,\s*|\s+|T)(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?))?\s*([AP]M)?)?$"
)
_GROUPS = 12
MONTH_FIRST, DAY_FIRST = "month", "day"
VOTES = "upload int, column string, given long, day long, month long, either long, unparsed long, first string"
#: Two-digit years from here on are of the last century.
PIVOT = 69


def _parts(c: Column) -> Column:
    """The pattern's groups as an array; one element where it doesn't fit."""
    groups = "\x01".join(f"${i}" for i in range(1, _GROUPS + 1))
    return F.split(F.regexp_replace(F.trim(c.cast("string")), PATTERN, groups), "\x01")


def _number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("int")


def _month(text: Column) -> Column:
    """Month by name, else by number."""
    named = F.array_position(literals(m[:3] for m in MONTHS), F.lower(F.substring(text, 1, 3))).cast("int")
    return F.coalesce(F.nullif(named, F.lit(0)), _number(text))


def _year(text: Column) -> Column:
    n = _number(text)
    return F.when(F.length(text) == 4, n).when((F.length(text) == 2) & (n >= PIVOT), n + 1900).when(F.length(text) == 2, n + 2000)


def _ambiguous(p: Column) -> Column:
    """Two numbers before the year, neither of them named and no point between: either order is possible."""
    return (p[3] != "") & (F.length(p[3]) < 4) & _number(p[3]).isNotNull() & _number(p[5]).isNotNull() & (p[4] != ".")


def _moment(p: Column, day_first: Column) -> Column:
    """The moment that the parts mean; parts in the other order are read if only that gives a date."""
    named_first = _number(p[3]).isNull()
    compact, year_first = p[0] != "", F.length(p[3]) == 4
    swap = F.when(p[4] == ".", True).when(named_first, False).when(_number(p[5]).isNull(), True).otherwise(day_first)
    hour, half = F.coalesce(_number(p[8]), F.lit(0)), F.lower(p[11])
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
    minute, second = F.coalesce(_number(p[9]), F.lit(0)), F.coalesce(F.nullif(p[10], F.lit("")), F.lit("0")).try_cast("decimal(16,6)")
    either = _ambiguous(p)

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.try_make_timestamp(y, m, d, hour, minute, second)

    def plain(swapped: Column) -> Column:
        return made(_year(p[7]), F.when(swapped, _month(p[5])).otherwise(_month(p[3])), F.when(swapped, _number(p[3])).otherwise(_number(p[5])))

    return (
        F.when(compact, made(_number(p[0]), _number(p[1]), _number(p[2])))
        .when(year_first, made(_number(p[3]), _month(p[5]), _number(p[7])))
        .otherwise(bind(swap, lambda s: F.coalesce(plain(s), F.when(either, plain(~s)))))
    )


def moment(c: Column, day_first: Column | bool = False) -> Column:
    """Text to timestamp; null where the pattern doesn't fit or no such moment exists."""
    first = day_first if isinstance(day_first, Column) else F.lit(day_first)
    return bind(_parts(c), lambda p: F.when(F.size(p) == _GROUPS, _moment(p, first)))


def _vote(c: Column) -> Column:
    """``day`` or ``month`` where only that one can come first, ``either``, or null where the question doesn't arise."""

    def told(p: Column) -> Column:
        a, b = _number(p[3]), _number(p[5])
        return F.when((F.size(p) == _GROUPS) & _ambiguous(p), F.when((a > 12) & (b <= 12), DAY_FIRST).when((b > 12) & (a <= 12), MONTH_FIRST).when((a <= 12) & (b <= 12), "either"))

    # With four digits in front the year comes first, so the question doesn't arise; such cells are not taken apart.
    return F.when(~F.trim(c.cast("string")).rlike(r"^\d{4}"), bind(_parts(c), told))


def votes(df: DataFrame, columns: Sequence[str], by: Column, read) -> DataFrame:
    """``(upload, column, given, day, month, either, unparsed, first)``: one aggregate over all columns.

    ``day`` and ``month`` count the cells that allow one order only, ``unparsed`` those given (not empty, not a dash) that no form fits;
    ``read`` is the expression that reads a cell. ``first`` is the order of the majority, month first if there is none.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], VOTES)
    cells = []
    for name in columns:
        c = F.col(f"`{name}`")
        text = F.trim(c.cast("string"))
        given = text.isNotNull() & ~text.isin("", "-")
        cells.append(F.struct(F.lit(name).alias("column"), given.alias("given"), F.when(given, _vote(c)).alias("vote"), (given & read(c).isNull()).alias("lost")))
    long = df.select(by.alias("upload"), F.inline(F.array(*cells)))
    counted = long.groupBy("upload", "column").agg(
        F.count_if("given").alias("given"),
        *[F.count_if(F.col("vote") == v).alias(v) for v in (DAY_FIRST, MONTH_FIRST, "either")],
        F.count_if("lost").alias("unparsed"),
    )
    return counted.withColumn("first", F.when(F.col(DAY_FIRST) > F.col(MONTH_FIRST), DAY_FIRST).otherwise(MONTH_FIRST))
