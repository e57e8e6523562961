"""Column expressions that turn exported text into typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions import dates
from auditlake.functions.binding import bind

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
TRUE_WORDS = ("true", "1", "1.0")
FALSE_WORDS = ("false", "0", "0.0")


def dash_to_null(c: Column) -> Column:
    return F.when(c != "-", c)


def number(c: Column) -> Column:
    """Text to double; anything but a plain decimal number is null (so are NaN and infinity)."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def accession(c: Column) -> Column:
    """Accession text to bigint. ``12345.0`` is 12345; whole numbers above 2^53 stay exact."""
    text = F.trim(c.cast("string"))
    return F.coalesce(text.try_cast("bigint"), number(c).try_cast("bigint"))


def timestamp(c: Column, day_first: Column | bool = False) -> Column:
    """Text to timestamp: ISO forms (with zones), then dates of any common shape with any clock, else null.

    ``day_first`` says how to read ``05/01/2024``; cells that allow one order only are read in that one.
    """
    text = F.trim(c.cast("string"))
    iso = F.when(text.rlike(r"^\d{4}(-|$)"), text.try_cast("timestamp"))
    return F.coalesce(iso, dates.moment(text, day_first))


def count_unparsed(c: Column, parsed: Column) -> Column:
    """Aggregate: values that were given (not empty, not a dash) but came out null."""
    text = F.trim(c.cast("string"))
    return F.count_if(text.isNotNull() & ~text.isin("", "-") & parsed.isNull())


def bool_to_int(c: Column) -> Column:
    """true/false words, then any number cut to an integer, else null."""
    text = F.lower(F.trim(c.cast("string")))
    return (
        F.when(text.isin(*TRUE_WORDS), 1)
        .when(text.isin(*FALSE_WORDS), 0)
        .otherwise(number(text).try_cast("smallint"))
        .cast("smallint")
    )


def duration_seconds(c: Column) -> Column:
    """``0 days 00:03:00`` and ``00:03:00`` to seconds; a bare number already is seconds.

    In ``-1 days +23:59:00`` the clock part has its own sign; without one it takes the sign
    of the day part. The pattern runs once and hands its groups on as one split text.
    """
    text = F.trim(c.cast("string"))
    pattern = r"^(?:([+-]?)(\d+) days?)?,?\s*(?:([+-]?)(\d+):(\d+):(\d+(?:\.\d+)?))?$"

    def seconds(parts: Column) -> Column:
        def value(i: int) -> Column:
            return F.coalesce(F.nullif(parts[i], F.lit("")).try_cast("double"), F.lit(0.0))

        day_sign = F.when(parts[0] == "-", -1).otherwise(1)
        clock_sign = F.when(parts[2] == "-", -1).when(parts[2] == "+", 1).otherwise(day_sign)
        clock = value(3) * 3600 + value(4) * 60 + value(5)
        return F.when(F.size(parts) == 6, day_sign * value(1) * 86400 + clock_sign * clock)

    groups = F.split(F.regexp_replace(text, pattern, "$1\x01$2\x01$3\x01$4\x01$5\x01$6"), "\x01")
    return F.when(text.rlike("[:d]"), bind(groups, seconds)).otherwise(number(c))


def turnaround_fallback(seconds: Column, turnaround_minutes: Column) -> Column:
    return F.coalesce(seconds, number(turnaround_minutes) * 60)


def format_duration(seconds: Column) -> Column:
    """45s / 4m 05s / 1h 15m, and a dash for null."""
    total = F.bround(seconds, 0).cast("bigint")
    minutes = F.floor(total / 60)
    return (
        F.when(seconds.isNull(), "—")
        .when(total < 60, F.format_string("%ds", total))
        .when(minutes < 60, F.format_string("%dm %02ds", minutes, total % 60))
        .otherwise(F.format_string("%dh %02dm", F.floor(minutes / 60), minutes % 60))
    )


def format_minutes(seconds: Column) -> Column:
    """The older ``Xm Ys`` form."""
    return F.when(
        seconds.isNotNull(),
        F.format_string("%dm %ds", (seconds / 60).cast("bigint"), F.pmod(seconds, F.lit(60.0)).cast("bigint")),
    )


def struct_list(c: Column, element: str) -> Column:
    """A printed list of records (single quotes, ``None``) to an array; unreadable text gives []."""
    json = F.regexp_replace(c, r"(?<=[:\[,]\s?)None(?=\s*[,}\]])", "null")
    return F.coalesce(F.from_json(json, f"array<{element}>"), F.array().cast(f"array<{element}>"))


def model_reply(c: Column, schema: str) -> Column:
    """Parse a reply that should be JSON: whole text first, then the outermost braces.

    Gives ``struct(value, status)`` with status ``ok``, ``extracted`` or ``failed``. The second
    parse only runs where the first one failed.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}

    def parse(text: Column) -> Column:
        braced = bind(text, lambda t: F.when(t.rlike(r"^\s*\{"), t))
        return bind(F.from_json(braced, f"{schema}, _bad string", options), lambda p: F.when(p["_bad"].isNull(), p))

    inner = parse(F.regexp_extract(c, r"(?s)\{.*\}", 0))

    def second(first: Column) -> Column:
        return F.when(first.isNotNull(), F.struct(first.alias("value"), F.lit("ok").alias("status"))).otherwise(
            bind(inner, lambda p: F.struct(
                p.alias("value"), F.when(p.isNotNull(), "extracted").otherwise("failed").alias("status")
            ))
        )

    return bind(parse(c), second)
