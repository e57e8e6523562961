"""Building blocks of larger expressions: values bound once, and literal arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to the value of ``value``.

    Branches of a conditional are not shared by the optimizer, so an expensive part that several
    branches need would run once per use. A lambda over a one-element array runs it once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sql(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def literals(values: Iterable[object]) -> Column:
    """An array of text or integer literals in one call to the JVM, however long it is."""
    return F.expr(f"array({', '.join(_sql(v) for v in values)})")


def literal_rows(names: Iterable[str], rows: Iterable[Iterable[object]]) -> Column:
    """An array of structs of literals."""
    names = list(names)
    items = [
        "named_struct(" + ", ".join(f"'{n}', {_sql(v)}" for n, v in zip(names, row)) + ")" for row in rows
    ]
    return F.expr(f"array({', '.join(items)})")
