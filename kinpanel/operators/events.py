"""Life events: named conditions over a person's row and its preceding row."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinpanel.operators.ordered import PREVIOUS, with_previous
from kinpanel.operators.panel import PERSON
from kinpanel.operators.scale import HOT_ROWS

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Event:
    """A condition on the columns it names.

    ``test`` takes the columns, then (if ``looks_back``) their values in the
    person's preceding row.  A null condition is no event.
    """

    columns: tuple[str, ...]
    test: Callable[..., Column]
    looks_back: bool = False


def when(column: str, test: Callable[[Column], Column]) -> Event:
    """Condition on one column of the row itself."""
    return Event((column,), test)


def changed(column: str) -> Event:
    return Event((column,), lambda now, before: before != now, looks_back=True)


def increased(column: str) -> Event:
    return Event((column,), lambda now, before: now > before, looks_back=True)


def decreased(column: str) -> Event:
    return Event((column,), lambda now, before: now < before, looks_back=True)


def more(column: str) -> Event:
    """A larger whole number; text and fractions are read as whole numbers."""
    return Event((column,), lambda now, before: now.cast("bigint") > before.cast("bigint"), looks_back=True)


def fewer(column: str) -> Event:
    return Event((column,), lambda now, before: now.cast("bigint") < before.cast("bigint"), looks_back=True)


def moved(column: str) -> Event:
    """Any difference between numbers."""
    return Event((column,), lambda now, before: now.cast("double") - before.cast("double") != 0, looks_back=True)


def _ratio(now: Column, before: Column) -> Column:
    # A preceding zero gives no ratio and so no event.
    return F.try_divide(now.cast("double") - before.cast("double"), before.cast("double"))


def rose_by(column: str, share: float) -> Event:
    return Event((column,), lambda now, before: _ratio(now, before) > share, looks_back=True)


def fell_by(column: str, share: float) -> Event:
    return Event((column,), lambda now, before: _ratio(now, before) < -share, looks_back=True)


CHILD_EVENTS = {
    "municipality_change": changed("KOM"),
    "family_composition_change": changed("FAMILIE_TYPE"),
    "household_size_increase": more("ANTPERSH"),
    "household_size_decrease": fewer("ANTPERSH"),
    "number_of_children_increase": more("ANTBOERNH"),
    "number_of_children_decrease": fewer("ANTBOERNH"),
}
FATHER_EVENTS = {
    "father_education_change": changed("FAR_EDU_LVL"),
    "father_income_change": moved("FAR_PERINDKIALT_13"),
    "significant_income_increase_father": rose_by("FAR_PERINDKIALT_13", 0.10),
    "significant_income_decrease_father": fell_by("FAR_PERINDKIALT_13", 0.10),
    "father_employment_status_change": changed("FAR_BESKST13"),
    "father_job_change": changed("FAR_STILL"),
    "father_socioeconomic_status_change": changed("FAR_SOCIO13"),
}
MOTHER_EVENTS = {
    "mother_education_change": changed("MOR_EDU_LVL"),
    "mother_income_change": moved("MOR_PERINDKIALT_13"),
    "significant_income_increase_mother": rose_by("MOR_PERINDKIALT_13", 0.10),
    "significant_income_decrease_mother": fell_by("MOR_PERINDKIALT_13", 0.10),
    "mother_employment_status_change": changed("MOR_BESKST13"),
    "mother_job_change": changed("MOR_STILL"),
    "mother_socioeconomic_status_change": changed("MOR_SOCIO13"),
}
EVENTS = {"child": CHILD_EVENTS, "father": FATHER_EVENTS, "mother": MOTHER_EVENTS}


def identify_events(
    df: DataFrame,
    definitions: dict[str, Event] | None = None,
    role: str = "child",
    keep: list[str] | None = None,
    order: list[str] | None = None,
    hot_rows: int | None = HOT_ROWS,
    within: list[str] | None = None,
) -> DataFrame:
    """One row ``(event_type, PNR, year, ...)`` per row and event that holds.

    All definitions are tested in one pass.  Definitions with columns the table
    lacks are left out; without any left the result is empty but typed.
    ``keep`` names columns carried along.  The preceding row is the person's
    row before in ``order`` (by default year, then month where there is one);
    in a panel stacked from several registers ``within`` keeps to one register.
    """
    if role not in PERSON:
        raise ValueError(f"unknown role {role!r}; use child, father or mother")
    year, person = PERSON[role]
    definitions = EVENTS[role] if definitions is None else definitions
    keep = [c for c in (keep or []) if c in df.columns]
    usable = {}
    for name, event in definitions.items():
        absent = [c for c in (*event.columns, year, person) if c not in df.columns]
        if absent:
            log.warning("event %s left out, missing columns: %s", name, ", ".join(absent))
        else:
            usable[name] = event
    if not usable:
        kept = [df.schema[c] for c in keep]
        schema = "event_type string, PNR string, year bigint"
        empty = df.sparkSession.createDataFrame([], schema)
        return empty.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in kept])

    back = list(dict.fromkeys(c for e in usable.values() if e.looks_back for c in e.columns))
    month = year.replace("year", "month")
    order = order or [c for c in (year, month) if c in df.columns]
    within = [c for c in (within or []) if c in df.columns]
    needed = list(dict.fromkeys([person, *within, *order, year, *[c for e in usable.values() for c in e.columns], *keep]))
    rows = df.select(*needed)
    if back:
        rows = with_previous(rows, person, order, back, hot_rows, within)
    names = []
    for name, event in usable.items():
        now = [F.col(c) for c in event.columns]
        before = [F.col(PREVIOUS).getField(c) for c in event.columns] if event.looks_back else []
        names.append(F.when(event.test(*now, *before), F.lit(name)))
    found = F.explode(F.array_compact(F.array(*names)))
    return rows.select(found.alias("event_type"), F.col(person).alias("PNR"), F.col(year).alias("year"), *keep)
