"""Decimal rounding of the exact binary value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact(value: Column, digits: int | None) -> Column:
    """Round a double the way its exact binary value demands.

    2.675 becomes 2.67, because the stored double lies just below the tie. Spark's own ``round`` and
    ``bround`` work on the printed decimal and give 2.68. ``digits=None`` returns the value untouched.
    """
    if digits is None:
        return value
    text = F.translate(F.format_number(value, digits), ",", "")
    # adding zero turns -0.0 into 0.0
    return text.cast("double") + F.lit(0.0)
