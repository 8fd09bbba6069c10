"""Binding of a value that an expression uses more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row: inside lambdas a repeated expression is computed per element."""
    return F.transform(F.array(value), use)[0]
