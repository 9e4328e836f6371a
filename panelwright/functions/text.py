"""Numbers as text, rounded the way a float's exact value rounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column | str, digits: int) -> Column:
    """``digits`` decimals, half-even on the exact binary value, no grouping."""
    col = F.col(value) if isinstance(value, str) else value
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", col, F.lit(pattern))


def signed(value: Column | str, digits: int) -> Column:
    col = F.col(value) if isinstance(value, str) else value
    shown = fixed(col + F.lit(0.0), digits)  # adding zero drops the sign of a negative zero
    return F.concat(F.when(shown.startswith("-"), "").otherwise("+"), shown)
