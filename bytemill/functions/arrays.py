"""An array helper that keeps one evaluation of a value, however often a lambda refers to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once; a plain expression inside a lambda is computed for each element."""
    return F.transform(F.array(value), body)[0]
