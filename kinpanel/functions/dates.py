"""Date parsing, file periods, ages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinpanel.fixed_values import DATE_FORMATS, LOCALE_DATE_FORMAT, TWO_DIGIT_YEAR_PIVOT

DAYS_PER_YEAR = 365.25


def parse_date(col: Column | str, dtype: T.DataType | None = None) -> Column:
    """First format that fits wins; text that fits none becomes null.

    No text has the shape of two formats other than those grouped here, so
    choosing by shape keeps the order of the formats.

    A column that already holds dates or timestamps (``dtype``) is only cast.
    """
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    # Parsing text of another shape is slow (each failure is an exception), so
    # the shape is looked at first.  Formats of one shape share the look.
    by_shape: dict[str, list[Column]] = {}
    for pattern, shape in DATE_FORMATS:
        parsed = F.try_to_date(c, pattern)
        by_shape.setdefault(shape, []).append(_century(parsed) if pattern.endswith("/yy") else parsed)
    # Spark refuses a weekday in a pattern, so it is cut off before parsing.
    without_weekday = F.regexp_replace(c, r"^[A-Za-z]{3}\s+(?=[A-Za-z]{3}\s)", "")
    pattern, shape = LOCALE_DATE_FORMAT
    expr = F.when(without_weekday.rlike(shape), F.try_to_date(F.regexp_replace(without_weekday, r"\s+", " "), pattern))
    for shape, parsed in reversed(by_shape.items()):
        expr = F.when(c.rlike(shape), F.coalesce(*parsed)).otherwise(expr)
    return expr


def _century(parsed: Column) -> Column:
    return F.when(F.year(parsed) >= 2000 + TWO_DIGIT_YEAR_PIVOT, F.add_months(parsed, -1200)).otherwise(parsed)


def file_year(name: Column) -> Column:
    """Year from a file name: the first six digits as yyyymm, else the first four."""
    stem = _stem(name)
    return F.coalesce(_digits(stem, r"(\d{4})(\d{2})", 1), _digits(stem, r"(\d{4})", 1))


def file_month(name: Column) -> Column:
    """Month from a file name holding six digits in a row, else null."""
    return _digits(_stem(name), r"(\d{4})(\d{2})", 2)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def _digits(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("int")


def years_between(later: Column | str, earlier: Column | str) -> Column:
    """Age gap in years: days / 365.25."""
    return F.datediff(later, earlier) / F.lit(DAYS_PER_YEAR)


def day_number(date: Column | str) -> Column:
    return F.unix_date(F.col(date) if isinstance(date, str) else date)


def from_day_number(days: Column) -> Column:
    """Back to a date, fractions of a day cut off."""
    return F.date_from_unix_date(F.floor(days).cast("int"))


def age_band(age: Column | str) -> Column:
    """0-18, 19-30, 31-50, 51-70 and 70+; a missing age falls in the last band."""
    a = F.col(age) if isinstance(age, str) else age
    bands = [(18, "0-18"), (30, "19-30"), (50, "31-50"), (70, "51-70")]
    start = F.when(a <= bands[0][0], bands[0][1])
    return reduce(lambda expr, b: expr.when(a <= b[0], b[1]), bands[1:], start).otherwise("70+")
