"""Rounding to four digits, exact on the binary value.

The scaled value is compared with the midpoint between its neighbours in two
exact halves, so a value a hair under a decimal tie goes down, one a hair over
goes up, and a true tie goes to the even neighbour.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def round4(value: Column) -> Column:
    low = F.floor(value * 10_000).cast("double")
    high_part = value.cast("float").cast("double")
    above_middle = (high_part * 20_000 - (low * 2 + 1)) + (value - high_part) * 20_000
    up = (above_middle > 0) | ((above_middle == 0) & (F.pmod(low, F.lit(2.0)) == 1))
    return (low + F.when(up, 1.0).otherwise(0.0)) / 10_000


def scaled4(values: np.ndarray) -> np.ndarray:
    """The same rounding for arrays, as whole ten-thousandths."""
    low = np.floor(values * 10_000)
    high_part = values.astype(np.float32).astype(np.float64)
    above_middle = (high_part * 20_000 - (low * 2 + 1)) + (values - high_part) * 20_000
    up = (above_middle > 0) | ((above_middle == 0) & (low % 2 == 1))
    return (low + up).astype(np.int64)
