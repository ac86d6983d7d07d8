"""Code -> label as a map literal, for dictionaries short enough to sit in the plan."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LITERAL_ENTRIES = 64


def label(col: Column | str, entries: dict[str, str]) -> Column:
    """Label of a code; codes without a label pass through, null stays null."""
    if len(entries) > MAX_LITERAL_ENTRIES:
        raise ValueError("too many entries for a map literal; join a dictionary table instead")
    code = (F.col(col) if isinstance(col, str) else col).cast("string")
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(entries.items())])
    return F.coalesce(F.try_element_at(table, code), code)
