"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, however often (or in whatever loop) the expression uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
