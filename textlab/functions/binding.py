"""Local names inside column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda re-evaluates every outer expression it mentions for each element, and a
    filter pushed below a projection copies the projected expression. Binding the value
    to a lambda variable keeps both from multiplying the work.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
