"""One value used several times in an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: inside lambdas Spark computes an expression anew wherever it stands."""
    return F.transform(F.array(value), body)[0]
