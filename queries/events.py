"""Life events and reports over event tables."""

from __future__ import annotations

from kinpanel.operators import event_reports as er
from kinpanel.operators import events as ev
from queries.proxies import register, with_registers
from queries.statistics import rounded

TYPES = ["click", "error", "purchase", "signup", "view"]


def child_events(spark, sf):
    """Changes from one row of a child to the next."""
    return ev.identify_events(register(spark, sf, "bef"), role="child")


def mother_events(spark, sf):
    """Changes in the mother's rows."""
    return ev.identify_events(register(spark, sf, "mother"), role="mother")


def father_events(spark, sf):
    """Changes in the father's rows; rows without a father have no row before them."""
    return ev.identify_events(register(spark, sf, "father"), role="father")


def income_events(spark, sf):
    definitions = {
        "rise": ev.rose_by("PERINDKIALT_13", 0.10),
        "fall": ev.fell_by("PERINDKIALT_13", 0.10),
        "any_change": ev.moved("PERINDKIALT_13"),
    }
    return ev.identify_events(register(spark, sf, "ind"), definitions)


def value_events(spark, sf):
    """Conditions on the row itself, with a category carried along."""
    definitions = {
        "large_household": ev.when("ANTPERSH", lambda c: c >= 5),
        "no_children": ev.when("ANTBOERNH", lambda c: c == 0),
        "not_possible": ev.when("ABSENT", lambda c: c > 0),
    }
    return ev.identify_events(register(spark, sf, "bef"), definitions, keep=["FAMILIE_TYPE"])


def event_counts(spark, sf):
    return er.event_counts(register(spark, sf, "log"), ordered=True)


def top_event_types(spark, sf):
    """The three most frequent event types."""
    return er.event_counts(register(spark, sf, "steps"), ordered=True).limit(3)


def event_timing(spark, sf):
    return er.event_timing(register(spark, sf, "log"))


def event_timing_years(spark, sf):
    return rounded(er.event_timing(register(spark, sf, "steps")))


def event_dates(spark, sf):
    return er.event_dates(register(spark, sf, "log"))


def event_summary(spark, sf):
    return rounded(er.event_summary(register(spark, sf, "log"), ["shift"]))


def event_frequency(spark, sf):
    return er.event_frequency(register(spark, sf, "log"), "year")


def age_band_frequency(spark, sf):
    return er.age_band_frequency(register(spark, sf, "log"))


def category_frequency(spark, sf):
    return er.event_frequency(register(spark, sf, "log"), "shift")


def event_group_counts(spark, sf):
    return er.with_group_count(register(spark, sf, "log"))


def event_matrix(spark, sf):
    return er.count_matrix(register(spark, sf, "log"), values=TYPES)


def category_matrix(spark, sf):
    return er.count_matrix(register(spark, sf, "log"), "year", "shift")


def event_correlation(spark, sf):
    return rounded(er.event_correlation(register(spark, sf, "log")))


def event_correlation_many(spark, sf):
    return rounded(er.event_correlation(register(spark, sf, "many")))


def event_matrix_long(spark, sf):
    return er.count_long(register(spark, sf, "many"))


def event_share(spark, sf):
    return rounded(er.event_share(register(spark, sf, "log"), "year"))


def category_share(spark, sf):
    return rounded(er.event_share(register(spark, sf, "log"), "year", "shift"))


def event_flows(spark, sf):
    return er.event_flows(register(spark, sf, "steps"))


def event_flows_per_sequence(spark, sf):
    return er.event_flows(register(spark, sf, "steps"), top_n=3, min_count=2, aggregate=False)


def time_to_event(spark, sf):
    return er.time_to_event(register(spark, sf, "log"))


def time_to_one_event(spark, sf):
    return er.time_to_event(register(spark, sf, "log"), "purchase")


# -- SQL ----------------------------------------------------------------------


def _lagged(source: str, person: str, order: str, columns: list[str]) -> str:
    w = f"(PARTITION BY {person} ORDER BY {order}, {', '.join(c + ' NULLS FIRST' for c in columns)})"
    return f"x AS (SELECT *, {', '.join(f'lag({c}) OVER {w} AS p_{c}' for c in columns)} FROM {source})"


def _events_sql(tests: dict[str, str], person: str = "PNR", year: str = "year", source: str = "x", keep: str = "") -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS event_type, {person} AS PNR, {year} AS year{keep} FROM {source} WHERE {test}" for name, test in tests.items()
    )


def _ratio(c: str) -> str:
    return f"(CASE WHEN p_{c} <> 0 THEN ({c} - p_{c}) / p_{c} END)"


_CHILD = with_registers("bef") + "," + _lagged(
    "bef", "PNR", "year NULLS FIRST, month NULLS FIRST", ["KOM", "FAMILIE_TYPE", "ANTPERSH", "ANTBOERNH"]
)
_MOTHER = with_registers("mother") + "," + _lagged(
    "mother", "MOTHER_PNR", "MOR_year NULLS FIRST, MOR_month NULLS FIRST", ["MOR_EDU_LVL", "MOR_PERINDKIALT_13", "MOR_BESKST13", "MOR_STILL", "MOR_SOCIO13"]
)
_FATHER = with_registers("father") + "," + _lagged(
    "(SELECT * FROM father WHERE FATHER_PNR IS NOT NULL)", "FATHER_PNR", "FAR_year NULLS FIRST, FAR_month NULLS FIRST", ["FAR_EDU_LVL", "FAR_PERINDKIALT_13", "FAR_BESKST13", "FAR_STILL", "FAR_SOCIO13"]
)
_INCOME = with_registers("ind") + "," + _lagged("ind", "PNR", "year NULLS FIRST", ["PERINDKIALT_13"])
_LOG = with_registers("log")
_STEPS = with_registers("steps")


def _summary(c: str) -> str:
    return f"""SELECT '{c}' AS category, {c} AS value, count(PNR) AS count,
      round(count(PNR) / CAST((SELECT count(DISTINCT PNR) FROM log) AS DOUBLE) * 100, 6) AS pct_cohort,
      round(count(PNR) / CAST((SELECT count(PNR) FROM log) AS DOUBLE) * 100, 6) AS pct_total FROM log GROUP BY {c}"""


def _frequency(group: str, name: str) -> str:
    return f"SELECT {group} AS {name}, event_type, count(PNR) AS event_count FROM log GROUP BY 1, 2"


def _matrix(values: list[str], column: str) -> str:
    cells = ", ".join(f"""count(*) FILTER ({column} = '{v}') AS "{v}" """ for v in values)
    return f"SELECT year, {cells} FROM log GROUP BY year"


def _share(column: str) -> str:
    return f"""SELECT year, {column}, count(*) AS count, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY {column}) AS DOUBLE), 6) AS share
      FROM log GROUP BY year, {column}"""


def _correlation() -> str:
    counts = ", ".join(f"CAST(count(*) FILTER (event_type = '{t}') AS DOUBLE) AS {t}" for t in TYPES)
    cells = "\nUNION ALL ".join(f"SELECT '{a}' AS event_a, '{b}' AS event_b, round(corr({a}, {b}), 6) AS correlation FROM w" for a in TYPES for b in TYPES)
    return f", w AS (SELECT PNR, {counts} FROM log GROUP BY PNR)\n{cells}"


def _flows(top_n: int, min_count: int) -> str:
    return f"""
, seqs AS (SELECT PNR, list(event_type ORDER BY year, event_type) AS s FROM steps GROUP BY PNR),
counted AS (SELECT s, count(*) AS value FROM seqs GROUP BY s HAVING count(*) >= {min_count}),
top AS (SELECT event_type FROM steps GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT {top_n}),
items AS (SELECT s, value, unnest(s) AS e, unnest(range(1, len(s) + 1)) AS i FROM counted),
named AS (SELECT s, value, i, CASE WHEN e IN (SELECT event_type FROM top) THEN e ELSE 'Other' END AS e FROM items),
pairs AS (SELECT a.e AS source, b.e AS target, a.value FROM named a JOIN named b ON a.s = b.s AND b.i = a.i + 1 WHERE a.e <> b.e)
"""


_TIMES = """SELECT event_type, PNR, CAST(min(year) - (SELECT min(year) FROM log) AS INT) AS time_to_event, count(PNR) AS events
  FROM log {where} GROUP BY event_type, PNR"""
_MEDIAN_DAY = "DATE '1970-01-01' + CAST(floor({}) AS INT)"
_DAY = "(event_date - DATE '1970-01-01')"

QUERIES = {
    "child_events": (
        child_events,
        _CHILD
        + _events_sql(
            {
                "municipality_change": "p_KOM <> KOM",
                "family_composition_change": "p_FAMILIE_TYPE <> FAMILIE_TYPE",
                "household_size_increase": "ANTPERSH > p_ANTPERSH",
                "household_size_decrease": "ANTPERSH < p_ANTPERSH",
                "number_of_children_increase": "ANTBOERNH > p_ANTBOERNH",
                "number_of_children_decrease": "ANTBOERNH < p_ANTBOERNH",
            }
        ),
    ),
    "mother_events": (
        mother_events,
        _MOTHER
        + _events_sql(
            {
                "mother_education_change": "p_MOR_EDU_LVL <> MOR_EDU_LVL",
                "mother_income_change": "MOR_PERINDKIALT_13 - p_MOR_PERINDKIALT_13 <> 0",
                "significant_income_increase_mother": _ratio("MOR_PERINDKIALT_13") + " > 0.10",
                "significant_income_decrease_mother": _ratio("MOR_PERINDKIALT_13") + " < -0.10",
                "mother_employment_status_change": "p_MOR_BESKST13 <> MOR_BESKST13",
                "mother_job_change": "p_MOR_STILL <> MOR_STILL",
                "mother_socioeconomic_status_change": "p_MOR_SOCIO13 <> MOR_SOCIO13",
            },
            "MOTHER_PNR",
            "MOR_year",
        ),
    ),
    "father_events": (
        father_events,
        _FATHER
        + _events_sql(
            {
                "father_education_change": "p_FAR_EDU_LVL <> FAR_EDU_LVL",
                "father_income_change": "FAR_PERINDKIALT_13 - p_FAR_PERINDKIALT_13 <> 0",
                "significant_income_increase_father": _ratio("FAR_PERINDKIALT_13") + " > 0.10",
                "significant_income_decrease_father": _ratio("FAR_PERINDKIALT_13") + " < -0.10",
                "father_employment_status_change": "p_FAR_BESKST13 <> FAR_BESKST13",
                "father_job_change": "p_FAR_STILL <> FAR_STILL",
                "father_socioeconomic_status_change": "p_FAR_SOCIO13 <> FAR_SOCIO13",
            },
            "FATHER_PNR",
            "FAR_year",
        ),
    ),
    "event_correlation_many": (
        event_correlation_many,
        with_registers("many")
        + """, types AS (SELECT DISTINCT event_type AS t FROM many WHERE event_type IS NOT NULL),
        people AS (SELECT DISTINCT PNR AS p FROM many),
        grid AS (SELECT p, t, (SELECT 0) AS zero FROM people, types),
        n AS (SELECT PNR AS p, event_type AS t, count(*) AS n FROM many GROUP BY 1, 2),
        full_ AS (SELECT g.p, g.t, CAST(coalesce(n.n, 0) AS DOUBLE) AS n FROM grid g LEFT JOIN n ON g.p IS NOT DISTINCT FROM n.p AND g.t = n.t)
        SELECT a.t AS event_a, b.t AS event_b, round(corr(a.n, b.n), 6) AS correlation
        FROM full_ a JOIN full_ b ON a.p IS NOT DISTINCT FROM b.p GROUP BY 1, 2""",
    ),
    "event_matrix_long": (event_matrix_long, with_registers("many") + "SELECT year, event_type, count(*) AS count FROM many GROUP BY 1, 2"),
    "income_events": (
        income_events,
        _INCOME
        + _events_sql(
            {
                "rise": _ratio("PERINDKIALT_13") + " > 0.10",
                "fall": _ratio("PERINDKIALT_13") + " < -0.10",
                "any_change": "PERINDKIALT_13 - p_PERINDKIALT_13 <> 0",
            }
        ),
    ),
    "value_events": (
        value_events,
        with_registers("bef")
        + _events_sql({"large_household": "ANTPERSH >= 5", "no_children": "ANTBOERNH = 0"}, source="bef", keep=", FAMILIE_TYPE"),
    ),
    "event_counts": (event_counts, _LOG + "SELECT event_type, count(*) AS count FROM log GROUP BY event_type"),
    "top_event_types": (
        top_event_types,
        _STEPS + "SELECT event_type, count(*) AS count FROM steps GROUP BY event_type ORDER BY count DESC, event_type LIMIT 3",
    ),
    "event_timing": (
        event_timing,
        _LOG
        + f"""SELECT event_type, min(event_date) AS min, max(event_date) AS max, {_MEDIAN_DAY.format(f'avg({_DAY})')} AS mean,
              {_MEDIAN_DAY.format(f'quantile_cont({_DAY}, 0.5)')} AS median FROM log GROUP BY event_type""",
    ),
    "event_timing_years": (
        event_timing_years,
        _STEPS
        + """SELECT event_type, CAST(min(year) AS DOUBLE) AS min, CAST(max(year) AS DOUBLE) AS max, round(avg(year), 6) AS mean,
             quantile_cont(CAST(year AS DOUBLE), 0.5) AS median FROM steps GROUP BY event_type""",
    ),
    "event_dates": (event_dates, _LOG + "SELECT event_date, event_type FROM log"),
    "event_summary": (event_summary, _LOG + _summary("event_type") + "\nUNION ALL " + _summary("shift")),
    "event_frequency": (event_frequency, _LOG + _frequency("year", "year")),
    "age_band_frequency": (
        age_band_frequency,
        _LOG
        + _frequency(
            "CASE WHEN age <= 18 THEN '0-18' WHEN age <= 30 THEN '19-30' WHEN age <= 50 THEN '31-50' WHEN age <= 70 THEN '51-70' ELSE '70+' END",
            "age_group",
        ),
    ),
    "category_frequency": (category_frequency, _LOG + _frequency("shift", "shift")),
    "event_group_counts": (event_group_counts, _LOG + "SELECT *, count(PNR) OVER (PARTITION BY year, event_type) AS count FROM log"),
    "event_matrix": (event_matrix, _LOG + _matrix(TYPES, "event_type")),
    "category_matrix": (category_matrix, _LOG + _matrix(["shift 0", "shift 1", "shift 2"], "shift")),
    "event_correlation": (event_correlation, _LOG + _correlation()),
    "event_share": (event_share, _LOG + _share("event_type")),
    "category_share": (category_share, _LOG + _share("shift")),
    "event_flows": (
        event_flows,
        _STEPS + _flows(5, 10) + "SELECT source, target, CAST(sum(value) AS BIGINT) AS value FROM pairs GROUP BY source, target",
    ),
    "event_flows_per_sequence": (event_flows_per_sequence, _STEPS + _flows(3, 2) + "SELECT source, target, value FROM pairs"),
    "time_to_event": (time_to_event, _LOG + _TIMES.format(where="")),
    "time_to_one_event": (time_to_one_event, _LOG + _TIMES.format(where="WHERE event_type = 'purchase'")),
}
