"""Numbers as text for report tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: Column, decimals: int = 1) -> Column:
    """Thousands separators and a fixed number of decimals."""
    return F.format_number(value, decimals)


def mean_median(mean: Column, std: Column, median: Column, q1: Column, q3: Column, decimals: int = 1) -> Column:
    """``Mean: m (SD: s)`` and ``Median: m (IQR: a-b)`` on two lines."""
    m, s, md, a, b = (number(c, decimals) for c in (mean, std, median, q1, q3))
    return F.concat(
        F.lit("Mean: "), m, F.lit(" (SD: "), s, F.lit(")\nMedian: "), md, F.lit(" (IQR: "), a, F.lit("-"), b, F.lit(")")
    )


def count_share(count: Column, percentage: Column) -> Column:
    """``n (p%)``."""
    return F.concat(F.format_number(count, 0), F.lit(" ("), F.format_string("%.1f", percentage), F.lit("%)"))


def percent(value: Column, decimals: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{decimals}f", value), F.lit("%"))
