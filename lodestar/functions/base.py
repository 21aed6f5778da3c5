"""Binding of subexpressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once and written once, so that nested functions don't multiply the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
