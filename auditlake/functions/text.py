"""Report text cleaning and search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Report header and accession token as the reporting system prints them.
EXAM_HEADER = r"CHEST\sof\s\d+-\S{3}-\d{4}:"
ACCESSION_TOKEN = r"Accession\sNo:\S+"


def clean_report(c: Column) -> Column:
    """Drop header and accession token, squeeze newlines, trim all white space; null stays null."""
    c = F.regexp_replace(c, f"(?U){EXAM_HEADER}", "")
    c = F.regexp_replace(c, f"(?U){ACCESSION_TOKEN}", "")
    c = F.regexp_replace(c, r"\n+", "\n")
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def snippet(c: Column, length: int = 200) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, length)


def contains_any(columns: Sequence[Column], query: str) -> Column:
    """Case-insensitive search over several columns; numbers are searched as text."""
    needle = F.lower(F.lit(query))
    hits = [F.coalesce(F.contains(F.lower(c.cast("string")), needle), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, hits)
