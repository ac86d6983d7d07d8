"""Diagnosis codes: category lists, disease predicate, groups.

Codes carry one leading letter before the ICD-10 category (``DE750`` is E75.0).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinpanel.fixed_values import (
    DIAGNOSIS_GROUPS,
    SCD_CATEGORIES,
    SCD_CATEGORY_RANGE,
    SCD_SUBCATEGORY_RANGE,
)


def expand_ranges(ranges: list[str]) -> list[str]:
    """``["D55-D58", "D64"]`` -> ``["D55", "D56", "D57", "D58", "D64"]``."""
    codes = []
    for item in ranges:
        first, _, last = item.partition("-")
        last = last or first
        codes += [f"{first[0]}{n:02d}" for n in range(int(first[1:]), int(last[1:]) + 1)]
    return codes


def scd_categories() -> list[str]:
    return list(SCD_CATEGORIES)


def group_categories() -> dict[str, list[str]]:
    return {name: expand_ranges(ranges) for name, ranges in DIAGNOSIS_GROUPS.items()}


def group_masks() -> list[tuple[str, int]]:
    """(category, bits of the groups it belongs to), bit i for the i-th group."""
    masks: dict[str, int] = {}
    for i, categories in enumerate(group_categories().values()):
        for c in categories:
            masks[c] = masks.get(c, 0) | 1 << i
    return sorted(masks.items())


def column_name(group: str) -> str:
    return group.lower().replace(" ", "_")


def normal_code(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.upper(F.coalesce(c, F.lit("")))


def without_prefix(col: Column | str) -> Column:
    """Code without its leading letter."""
    c = F.col(col) if isinstance(col, str) else col
    return F.substr(c, F.lit(2))


def is_scd_code(col: Column | str, mode: str = "category") -> Column:
    """Severe chronic disease predicate for one code column; never null.

    ``category`` compares the three-character category (and the P941-P949
    subcategories).  ``literal`` compares the four and five characters after
    the leading letter with the same lists, so only short codes match.
    """
    code = normal_code(col)
    three, four, five = (F.substring(code, 2, n) for n in (3, 4, 5))
    if mode == "category":
        return (
            three.isin(scd_categories())
            | three.between(*SCD_CATEGORY_RANGE)
            | four.between(*SCD_SUBCATEGORY_RANGE)
        )
    if mode == "literal":
        return (
            four.isin(scd_categories())
            | five.isin(scd_categories())
            | four.between(*SCD_CATEGORY_RANGE)
            | five.between(*SCD_SUBCATEGORY_RANGE)
        )
    raise ValueError(f"unknown mode {mode!r}; use 'category' or 'literal'")


def any_scd(columns: list[str], mode: str = "category") -> Column:
    return reduce(or_, [is_scd_code(c, mode) for c in columns])


def in_group(columns: list[str], group: str, mode: str = "category") -> Column:
    """Whether any of the code columns belongs to a diagnosis group; never null.

    ``category`` expands the ranges.  ``literal`` searches the range text itself
    (``"D55-D61|D64-D73|D76"``) as a pattern anywhere in the code.
    """
    if mode == "category":
        members = group_categories()[group]
        return reduce(or_, [F.substring(normal_code(c), 2, 3).isin(members) for c in columns])
    if mode == "literal":
        pattern = "|".join(DIAGNOSIS_GROUPS[group])
        return reduce(or_, [F.coalesce(F.col(c).rlike(pattern), F.lit(False)) for c in columns])
    raise ValueError(f"unknown mode {mode!r}; use 'category' or 'literal'")
