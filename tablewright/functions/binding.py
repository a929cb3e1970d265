"""Name an intermediate value inside an expression, so that it is computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once. For use inside list functions, which are interpreted anyway."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))
