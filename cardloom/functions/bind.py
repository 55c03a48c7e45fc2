"""A name for a value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it.

    Without it each mention is a copy of the expression, and copies of copies grow beyond what can be compiled.
    """
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)
