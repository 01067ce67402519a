"""Sums of doubles that don't depend on the order of their rows, so that equal runs are equal however they are partitioned.

A value is taken as a whole number of 2**-52, in two parts that are summed as longs: 2**-20 and what is left. That rounds a value by
2**-53 at most; the sums themselves are exact for values under 2**42 and up to 2**31 rows that use all digits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_HIGH, _REST = 2.0**20, 2.0**32


def exact_sum(value: Column | str) -> Column:
    """The sum of a column of doubles, null for no rows."""
    scaled = (F.col(value) if isinstance(value, str) else value) * F.lit(_HIGH)
    return F.sum(F.floor(scaled)) / F.lit(_HIGH) + F.sum(F.round((scaled - F.floor(scaled)) * F.lit(_REST)).cast("long")) / F.lit(_HIGH * _REST)


def halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of each value, as doubles: up to 2**31 of either add up without rounding, and ``exact_sum`` takes such sums as they are."""
    high = np.floor(values * _HIGH)
    return high / _HIGH, np.round((values * _HIGH - high) * _REST) / (_HIGH * _REST)
