"""Number rules, and number formats of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(c: Column) -> Column:
    """Whether a double is a number and not infinite; null is neither."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def is_whole(c: Column) -> Column:
    """Whether a finite double has no fraction."""
    return is_finite(c) & (F.floor(F.when(is_finite(c), c)) == c)


def format_count(n: int) -> str:
    """1234567 as 1.234.567."""
    return f"{n:,}".replace(",", ".")


def format_ms(seconds: float) -> str:
    """Seconds as milliseconds with two decimals."""
    return f"{seconds * 1000:.2f} ms"


def format_bytes(n: int) -> str:
    """Bytes in the largest unit of 1024 that leaves at least one."""
    size, unit = float(n), "B"
    for larger in ("KB", "MB", "GB", "TB"):
        if size < 1024:
            break
        size, unit = size / 1024, larger
    return f"{n} B" if unit == "B" else f"{size:.2f} {unit}"
