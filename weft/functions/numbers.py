"""Rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int) -> Column:
    """x rounded to digits, halves to the even side: 5.625 to 5.62 and 7.875 to 7.88.

    The scaled value is rounded, so DuckDB's round_even on the scaled value gives the same double. A double
    that lies beside a half by less than scaling can tell counts as the half: 2.675 gives 2.68."""
    return F.rint(x * float(10**digits)) / float(10**digits)
