"""Predicates, listing and paging over the study table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import schema as S
from auditlake.functions.text import contains_any
from auditlake.operators.selection import Key, rows_from

NULL, NOT_NULL = "__null__", "__notnull__"
DATE_FIELDS = ("procedure_start_date", "created_at")
DEFAULT_SORT = "-created_at"


def search(query: str, fields: Sequence[str] = S.SEARCH_FIELDS) -> Column:
    return contains_any([F.col(f) for f in fields], query)


def field_filter(field: str, value: str, allowed: Sequence[str] = S.FILTER_FIELDS) -> Column:
    """Equality, ``__null__`` or ``__notnull__`` on one of the filterable columns."""
    if field not in allowed:
        raise ValueError(f"not a filterable column: {field}")
    if value == NULL:
        return F.col(field).isNull()
    if value == NOT_NULL:
        return F.col(field).isNotNull()
    typed = F.lit(value) if S.STUDY_TYPES.get(field) == "string" else F.lit(int(value))
    return F.col(field) == typed


def date_range(field: str, first: str | dt.date | None, last: str | dt.date | None) -> Column:
    """Both days inclusive, written as bounds on the timestamp itself so that scans can use it."""

    def midnight(day: str | dt.date, plus: int = 0) -> Column:
        d = dt.date.fromisoformat(day) if isinstance(day, str) else day
        return F.lit((d + dt.timedelta(days=plus)).isoformat() + " 00:00:00").cast("timestamp")

    cond = F.lit(True)
    if first:
        cond = cond & (F.col(field) >= midnight(first))
    if last:
        cond = cond & (F.col(field) < midnight(last, 1))
    return cond


def site_filter(sites: str | None, workplace: str = "workplace", known: Mapping[str, str] = S.SITES) -> Column:
    """Comma list of short names. ``OTH`` keeps every unknown or missing code; an empty list keeps all.

    Unknown names are dropped from the list; a list of unknown names only keeps nothing.
    """
    names = [s.strip() for s in (sites or "").split(",") if s.strip()]
    if not names:
        return F.lit(True)
    codes = [code for code, name in known.items() if name in names]
    cond = F.coalesce(F.col(workplace).isin(codes), F.lit(False)) if codes else F.lit(False)
    if S.OTHER_SITE in names:
        cond = cond | ~F.coalesce(F.col(workplace).isin(list(known)), F.lit(False))
    return cond


def has_text(text: str = "text_report") -> Column:
    return F.col(text).isNotNull() & (F.col(text) != "")


def unlabelled(label: str = "gt_manual", text: str = "text_report") -> Column:
    return has_text(text) & F.col(label).isNull()


def needs_backfill(marker: str = "atelectasis_llm", text: str = "text_report") -> Column:
    return has_text(text) & F.col(marker).isNull()


def priority_workplace(workplace: str = "workplace") -> Column:
    """Case-insensitive prefix test; a missing workplace is not a priority one."""
    prefix = F.upper(F.substring(F.col(workplace), 1, 3))
    return F.coalesce(prefix.isin(*S.PRIORITY_PREFIXES), F.lit(False))


def non_target_procedure(code: str = "procedure_code") -> Column:
    """Everything but the intended procedure; a missing code counts as another one."""
    return ~F.col(code).eqNullSafe(F.lit(S.TARGET_PROCEDURE))


def apply_filters(
    df: DataFrame,
    query: str | None = None,
    equals: Mapping[str, str] | None = None,
    ranges: Mapping[str, tuple[str | None, str | None]] | None = None,
) -> DataFrame:
    """The one filter builder shared by listing, counting and export."""
    if query and query.strip():
        df = df.where(search(query.strip()))
    for field, value in (equals or {}).items():
        if value != "":
            df = df.where(field_filter(field, value))
    for field, (first, last) in (ranges or {}).items():
        if field not in DATE_FIELDS:
            raise ValueError(f"not a date column: {field}")
        df = df.where(date_range(field, first, last))
    return df


def sort_columns(sort: str | None, allowed: Sequence[str] = S.LISTED_FIELDS, key: str = "accession_no") -> list[Column]:
    """``field`` or ``-field``; anything not listed falls back to newest first. The key breaks ties."""
    sort = sort or DEFAULT_SORT
    if sort.lstrip("-") not in allowed:
        sort = DEFAULT_SORT
    col = F.col(sort.lstrip("-"))
    first = col.desc_nulls_last() if sort.startswith("-") else col.asc_nulls_first()
    return [first, F.col(key).asc()]


def page(
    df: DataFrame, number: int = 1, per_page: int = 50, sort: str | None = None, key: str = "accession_no"
) -> DataFrame:
    """One page of a sorted view; page size is clamped to 10..500, page number to the last page.

    The page's first row is located by splitters (``selection``) and the page is a bounded top-n from there.
    """
    per_page = min(max(per_page, 10), 500)
    total = df.count()
    pages = max(1, -(-total // per_page))
    offset = (min(max(number, 1), pages) - 1) * per_page
    field = (sort or DEFAULT_SORT).lstrip("-")
    known = field in S.LISTED_FIELDS
    keys = [Key(field, sort.startswith("-") if sort else True)] if known else [Key(DEFAULT_SORT.lstrip("-"), True)]
    return rows_from(df, [*keys, Key(key)], offset, per_page, total)


def filter_options(df: DataFrame, fields: Sequence[str] = S.FILTER_FIELDS) -> DataFrame:
    """Distinct values of the filter columns as ``(field, value, has_nulls)``, null values included."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    found = df.select(F.inline(pairs)).distinct()
    nulls = found.groupBy("field").agg(F.bool_or(F.col("value").isNull()).alias("has_nulls"))
    return found.join(F.broadcast(nulls), "field")


def friday_range(day: Column | None = None) -> tuple[Column, Column]:
    """The week from the Friday before last to the last Friday before ``day`` (today by default)."""
    day = F.current_date() if day is None else day
    back = F.pmod(F.weekday(day) - 4, F.lit(7))
    back = F.when(back == 0, 7).otherwise(back)
    last = F.date_sub(day, back.cast("int"))
    return F.date_sub(last, 7), last
