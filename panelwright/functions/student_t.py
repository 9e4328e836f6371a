"""The 97.5 % point of Student's t, as a column of the degrees of freedom.

Small degrees of freedom are solved numerically once at import of the table; beyond it the
expansion in powers of 1/df around the normal point is accurate to about 1e-9.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelwright.schema import NORMAL_975

TABLE_UP_TO = 60


def _upper_tail(t: float, df: int) -> float:
    """P(T > t), from the finite trigonometric sums that hold for whole degrees of freedom."""
    angle = math.atan(t / math.sqrt(df))
    cos, sin = math.cos(angle), math.sin(angle)
    if df == 1:
        inner = 2 * angle / math.pi
    elif df % 2:
        term, acc = cos, cos
        for k in range(3, df - 1, 2):
            term *= cos * cos * (k - 1) / k
            acc += term
        inner = 2 / math.pi * (angle + sin * acc)
    else:
        term, acc = 1.0, 1.0
        for k in range(2, df - 1, 2):
            term *= cos * cos * (k - 1) / k
            acc += term
        inner = sin * acc
    return (1 - inner) / 2


@lru_cache(maxsize=None)
def t_975(df: int) -> float:
    low, high = 0.0, 700.0
    for _ in range(200):
        mid = (low + high) / 2
        if _upper_tail(mid, df) > 0.025:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def expansion_terms() -> list[float]:
    """Coefficients of 1/df, 1/df^2, 1/df^3, 1/df^4 (Abramowitz and Stegun 26.7.5)."""
    z = NORMAL_975
    return [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]


def t_975_column(df: Column) -> Column:
    table = F.array(*[F.lit(t_975(i)) for i in range(1, TABLE_UP_TO + 1)])
    tail = F.lit(NORMAL_975)
    for power, coefficient in enumerate(expansion_terms(), start=1):
        tail = tail + F.lit(coefficient) / F.pow(df.cast("double"), F.lit(float(power)))
    in_table = F.try_element_at(table, F.greatest(df, F.lit(1)).cast("int"))
    return F.when(df < 1, F.lit(None)).when(df <= TABLE_UP_TO, in_table).otherwise(tail)
