"""Descriptive statistics and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinpanel.fixed_values import DOMAIN_STATISTICS
from kinpanel.operators import statistics as s
from kinpanel.operators import tables as t
from kinpanel.plans import zones as z
from queries.proxies import register, table, with_registers

STUDY = [1996, 1998, 2000]
INCLUSION = "2002-01-01"


def rounded(df, digits=6):
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if ty == "double" else F.col(c) for c, ty in df.dtypes])


def numeric_stats(spark, sf):
    """Quartiles by selection, as for groups too large for one task."""
    return rounded(s.numeric_statistics(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], quantiles="selection"), 4)


def numeric_stats_by_year(spark, sf):
    return rounded(s.numeric_statistics(register(spark, sf, "ind"), ["PERINDKIALT_13", "BESKST13"], ["year"]), 4)


def numeric_stats_by_year_selected(spark, sf):
    """The same statistics with quartiles by selection."""
    return rounded(s.numeric_statistics(register(spark, sf, "ind"), ["PERINDKIALT_13", "BESKST13"], ["year"], quantiles="selection"), 4)


def categorical_stats(spark, sf):
    return rounded(s.categorical_statistics(register(spark, sf, "panel"), ["KOEN", "FAMILIE_TYPE", "MOR_EDU_LVL"]))


def categorical_stats_by_year(spark, sf):
    return rounded(s.categorical_statistics(register(spark, sf, "panel"), ["KOEN", "MOR_EDU_LVL"], ["year"]))


def temporal_stats(spark, sf):
    return s.temporal_statistics(register(spark, sf, "family"), ["FOED_DAG", "FAR_FDAG", "MOR_FDAG"])


def table_stats(spark, sf):
    """All columns of a table, each by its kind."""
    return rounded(s.table_statistics(register(spark, sf, "panel").select("ANTPERSH", "KOEN", "FOED_DAG", "MOR_FDAG", "FAR_PERINDKIALT_13")), 4)


def family_stats(spark, sf):
    from kinpanel.operators.population import relationships

    return rounded(z.family_statistics(relationships(register(spark, sf, "family"))), 4)


def static_stats(spark, sf):
    from kinpanel.operators.population import individuals

    return rounded(z.static_statistics(individuals(register(spark, sf, "family"))), 4)


def domain_stats(spark, sf):
    """Statistics of the demographics domain per year."""
    panel = z.domain_panel(register(spark, sf, "bef"))
    return rounded(z.domain_statistics(panel, DOMAIN_STATISTICS["demographics"]), 4)


def stratified_stats(spark, sf):
    return rounded(s.stratified_statistics(register(spark, sf, "panel"), ["ANTPERSH", "MOR_PERINDKIALT_13"], "KOEN"), 4)


def overall_stats(spark, sf):
    return rounded(s.stratified_statistics(register(spark, sf, "panel"), ["ANTPERSH", "MOR_PERINDKIALT_13"]), 4)


def distribution_at_years(spark, sf):
    return rounded(t.distribution(register(spark, sf, "panel"), "MOR_EDU_LVL", STUDY))


def distribution_overall(spark, sf):
    return rounded(t.distribution(register(spark, sf, "panel"), "KOEN"))


def baseline(spark, sf):
    return rounded(t.baseline_table(register(spark, sf, "panel"), STUDY, reference_date=INCLUSION), 4)


def baseline_by_sex(spark, sf):
    return rounded(t.baseline_table(register(spark, sf, "panel"), STUDY, stratify_by="KOEN", reference_date=INCLUSION), 4)


def baseline_text(spark, sf):
    """The baseline table as formatted text."""
    return t.baseline_text(t.baseline_table(register(spark, sf, "panel"), STUDY, reference_date=INCLUSION))


def describe(spark, sf):
    return rounded(s.describe(register(spark, sf, "panel").select("ANTPERSH", "MOR_PERINDKIALT_13", "KOEN", "FOED_DAG", "MOR_FDAG")), 4)


def missing_table(spark, sf):
    return s.missing_table(register(spark, sf, "panel"))


def non_null_counts(spark, sf):
    return s.non_null_counts(register(spark, sf, "panel"))


def column_profile(spark, sf):
    return rounded(s.profile(register(spark, sf, "panel")), 4)


# -- SQL ----------------------------------------------------------------------


def _numbers(value: str, digits: int = 4) -> str:
    q = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    quantiles = ", ".join(f"round(quantile_cont({value}, {p}), {digits}) AS {n}" for n, p in q.items())
    return (
        f"count({value}) AS count, round(avg({value}), {digits}) AS mean, round(stddev_samp({value}), {digits}) AS std, "
        f"round(min({value}), {digits}) AS min, {quantiles}, round(max({value}), {digits}) AS max, "
        f"count(*) - count({value}) AS missing"
    )


def _union(parts) -> str:
    return "\nUNION ALL ".join(parts)


def _numeric_sql(source: str, columns: list[str], by: str = "") -> str:
    group = f" GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return _union(f"SELECT {head}'{c}' AS column, {_numbers(f'CAST({c} AS DOUBLE)')} FROM {source}{group}" for c in columns)


def _categorical_sql(columns: list[str], by: str = "") -> str:
    head = f"{by}, " if by else ""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    return _union(
        f"""SELECT {head}'{c}' AS column, CAST({c} AS VARCHAR) AS value, count(*) AS count,
            round(count(*) / CAST(sum(count(*)) {over} AS DOUBLE) * 100, 6) AS percentage,
            CAST(coalesce(sum(CASE WHEN {c} IS NULL THEN count(*) END) {over}, 0) AS BIGINT) AS missing,
            CAST(sum(count(*)) {over} AS BIGINT) AS total FROM panel GROUP BY {head}{c}"""
        for c in columns
    )


def _typed_sql(source: str, numeric=(), categorical=(), temporal=(), by: str = "") -> str:
    head = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    none = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("mean", "median", "q1", "q3", "min", "max"))
    parts = []
    for c in numeric:
        parts.append(
            f"""SELECT {head}'{c}' AS column, 'numeric' AS stat_type, count, mean AS value, CAST(NULL AS VARCHAR) AS value_text, std, missing,
                mean, median, q1, q3, min, max FROM (SELECT {head}{_numbers(f'CAST({c} AS DOUBLE)')} FROM {source}{group})"""
        )
    for c in categorical:
        inner = f"SELECT {head}{c} AS v, count(*) AS n FROM {source} GROUP BY {head}{c}"
        parts.append(
            f"""SELECT {head}'{c}' AS column, 'categorical' AS stat_type, CAST(sum(n) AS BIGINT) AS count,
                round(max(n) / CAST(sum(n) AS DOUBLE) * 100, 4) AS value, CAST(NULL AS VARCHAR) AS value_text, 0.0 AS std,
                CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS missing, {none} FROM ({inner}){group}"""
        )
    for c in temporal:
        parts.append(
            f"""SELECT {head}'{c}' AS column, 'temporal' AS stat_type, count({c}) AS count, CAST(NULL AS DOUBLE) AS value,
                CAST(min({c}) AS VARCHAR) AS value_text, 0.0 AS std, count(*) - count({c}) AS missing, {none} FROM {source}{group}"""
        )
    return _union(parts)


def _stratified_sql(columns, stratum, where="") -> str:
    return _union(
        f"""SELECT '{c}' AS column, {stratum} AS stratum, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
            round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q1,
            round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q3, count({c}) AS n, count(*) - count({c}) AS missing
            FROM panel {where} GROUP BY {stratum}"""
        for c in columns
    )


_PERSONS = "(SELECT count(DISTINCT PNR) FROM panel)"


def _baseline_sql(stratum: str | None) -> str:
    """Numeric and distribution rows of the baseline table."""
    key = stratum or "'all'"
    where = f"{stratum} IS NOT NULL" if stratum else "true"
    numeric = [
        ("Child Characteristics", "Age at inclusion (years)", f"(DATE '{INCLUSION}' - FOED_DAG) / 365.25", False),
        ("Maternal Characteristics", "Mother''s age at child birth", "(FOED_DAG - MOR_FDAG) / 365.25", False),
        ("Maternal Characteristics", "Mother''s income (DKK)", "MOR_PERINDKIALT_13", True),
        ("Paternal Characteristics", "Father''s age at child birth", "(FOED_DAG - FAR_FDAG) / 365.25", False),
        ("Paternal Characteristics", "Father''s income (DKK)", "FAR_PERINDKIALT_13", True),
        ("Family Characteristics", "Number of persons in household", "CAST(ANTPERSH AS DOUBLE)", False),
        ("Family Characteristics", "Number of children in family", "CAST(ANTBOERNF AS DOUBLE)", False),
    ]
    categories = [
        ("Child Characteristics", "Sex", "KOEN", False),
        ("Maternal Characteristics", "Mother''s education", "MOR_EDU_LVL", True),
        ("Maternal Characteristics", "Mother''s employment status", "MOR_BESKST13", True),
        ("Paternal Characteristics", "Father''s education", "FAR_EDU_LVL", True),
        ("Paternal Characteristics", "Father''s employment status", "FAR_BESKST13", True),
        ("Family Characteristics", "Family type", "FAMILIE_TYPE", False),
    ]
    years = "year IN (" + ", ".join(map(str, STUDY)) + ")"
    parts = [
        """SELECT 'Child Characteristics' AS category, 'Total children' AS variable, CAST(NULL AS INT) AS period, 'all' AS stratum,
           CAST(NULL AS VARCHAR) AS value, count(DISTINCT PNR) AS n, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std,
           CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS q1, CAST(NULL AS DOUBLE) AS q3, CAST(NULL AS DOUBLE) AS percentage,
           CAST(0 AS BIGINT) AS missing, CAST(0 AS DOUBLE) AS missing_pct FROM panel"""
    ]
    for section, variable, expr, yearly in numeric:
        period = "year" if yearly else "CAST(NULL AS INT)"
        parts.append(
            f"""SELECT '{section}', '{variable}', {period}, {key}, NULL, count({expr}), avg({expr}), stddev_samp({expr}),
                quantile_cont({expr}, 0.5), quantile_cont({expr}, 0.25), quantile_cont({expr}, 0.75), NULL,
                count(*) - count({expr}), (count(*) - count({expr})) / CAST({_PERSONS} AS DOUBLE) * 100
                FROM panel WHERE {where} AND {years if yearly else 'true'} GROUP BY {period}, {key}"""
        )
    for section, variable, column, yearly in categories:
        period = "year" if yearly else "CAST(NULL AS INT)"
        parts.append(
            f"""SELECT '{section}', '{variable}', {period}, 'all', CAST({column} AS VARCHAR), count(*), NULL, NULL, NULL, NULL, NULL,
                count(*) / CAST({_PERSONS} AS DOUBLE) * 100, CASE WHEN {column} IS NULL THEN count(*) ELSE 0 END,
                CASE WHEN {column} IS NULL THEN count(*) ELSE 0 END / CAST({_PERSONS} AS DOUBLE) * 100
                FROM panel WHERE {years if yearly else 'true'} GROUP BY {period}, {column}"""
        )
    return with_registers("panel") + ", b AS (" + _union(parts) + ")\n"


_ROUNDED = "SELECT * REPLACE (" + ", ".join(f"round({c}, 4) AS {c}" for c in ("mean", "std", "median", "q1", "q3", "percentage", "missing_pct")) + ") FROM b"


def _text(digits: int) -> str:
    f = {c: f"format('{{:,.{digits}f}}', {c})" for c in ("mean", "std", "median", "q1", "q3")}
    return f"concat('Mean: ', {f['mean']}, ' (SD: ', {f['std']}, ')', chr(10), 'Median: ', {f['median']}, ' (IQR: ', {f['q1']}, '-', {f['q3']}, ')')"


_TEXT = f"""SELECT category AS Category,
  concat(variable, CASE WHEN percentage IS NOT NULL THEN concat(': ', coalesce(value, 'missing')) ELSE '' END) AS Variable,
  CASE WHEN percentage IS NOT NULL THEN concat(format('{{:,}}', n), ' (', format('{{:.1f}}', percentage), '%)')
       WHEN variable = 'Total children' THEN format('{{:,}}', n)
       WHEN variable LIKE '%(DKK)' THEN {_text(0)} ELSE {_text(1)} END AS Value,
  concat(format('{{:.1f}}', missing_pct), '%') AS Missing, coalesce(CAST(period AS VARCHAR), 'All') AS Year FROM b"""

_DESCRIBE_NULLS = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("mean", "std", "min", "q1", "median", "q3", "max"))


def _describe_sql() -> str:
    numeric = [
        f"SELECT '{c}' AS variable, count, missing AS null_count, mean, std, min, q1, median, q3, max, CAST(NULL AS VARCHAR) AS min_text, CAST(NULL AS VARCHAR) AS max_text FROM (SELECT {_numbers(f'CAST({c} AS DOUBLE)')} FROM panel)"
        for c in ("ANTPERSH", "MOR_PERINDKIALT_13")
    ]
    other = [
        f"SELECT '{c}', count({c}), count(*) - count({c}), {_DESCRIBE_NULLS}, CAST(min({c}) AS VARCHAR), CAST(max({c}) AS VARCHAR) FROM panel"
        for c in ("KOEN", "FOED_DAG", "MOR_FDAG")
    ]
    return _union(numeric + other)


_PANEL_TYPES = {
    "PNR": "string", "year": "int", "FOED_DAG": "date", "KOEN": "string", "FAMILIE_TYPE": "string", "ANTPERSH": "int", "ANTBOERNF": "int",
    "MOR_FDAG": "date", "MOR_EDU_LVL": "string", "MOR_PERINDKIALT_13": "double", "MOR_BESKST13": "string", "FAR_FDAG": "date",
    "FAR_EDU_LVL": "string", "FAR_PERINDKIALT_13": "double", "FAR_BESKST13": "string",
}


def _profile_sql() -> str:
    parts = []
    for c, kind in _PANEL_TYPES.items():
        numeric = kind in ("int", "double")
        v = f"CAST({c} AS DOUBLE)"
        stats = (
            f"round(min({v}), 4) AS min, round(max({v}), 4) AS max, round(avg({v}), 4) AS mean, round(quantile_cont({v}, 0.5), 4) AS median"
            if numeric
            else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS median"
        )
        parts.append(
            f"""SELECT '{c}' AS column, '{kind}' AS dtype, count(*) AS rows, count(*) - count({c}) AS missing,
                count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS distinct_values, {stats} FROM panel"""
        )
    return _union(parts)


_PANEL = with_registers("panel")
_FAMILY = with_registers("family")
_RELATIONS = ", relations AS (SELECT FAR_FDAG AS father_birth_date, MOR_FDAG AS mother_birth_date FROM family)\n"
_PEOPLE = """, people AS (SELECT PNR AS individual_id, FOED_DAG AS birth_date, 'child' AS role FROM family
  UNION ALL SELECT FAR_ID, FAR_FDAG, 'father' FROM family WHERE FAR_ID IS NOT NULL
  UNION ALL SELECT MOR_ID, MOR_FDAG, 'mother' FROM family WHERE MOR_ID IS NOT NULL)
"""

QUERIES = {
    "numeric_stats": (numeric_stats, _numeric_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])),
    "numeric_stats_by_year": (numeric_stats_by_year, with_registers("ind") + _numeric_sql("ind", ["PERINDKIALT_13", "BESKST13"], "year")),
    "numeric_stats_by_year_selected": (numeric_stats_by_year_selected, with_registers("ind") + _numeric_sql("ind", ["PERINDKIALT_13", "BESKST13"], "year")),
    "categorical_stats": (categorical_stats, _PANEL + _categorical_sql(["KOEN", "FAMILIE_TYPE", "MOR_EDU_LVL"])),
    "categorical_stats_by_year": (categorical_stats_by_year, _PANEL + _categorical_sql(["KOEN", "MOR_EDU_LVL"], "year")),
    "temporal_stats": (
        temporal_stats,
        _FAMILY
        + _union(
            f"SELECT '{c}' AS column, count({c}) AS count, min({c}) AS min, max({c}) AS max, count(*) - count({c}) AS missing FROM family"
            for c in ("FOED_DAG", "FAR_FDAG", "MOR_FDAG")
        ),
    ),
    "table_stats": (table_stats, _PANEL + _typed_sql("panel", ["ANTPERSH", "FAR_PERINDKIALT_13"], ["KOEN"], ["FOED_DAG", "MOR_FDAG"])),
    "family_stats": (family_stats, _FAMILY + _RELATIONS + _typed_sql("relations", temporal=["father_birth_date", "mother_birth_date"])),
    "static_stats": (static_stats, _FAMILY + _PEOPLE + _typed_sql("people", categorical=["role"], temporal=["birth_date"])),
    "domain_stats": (
        domain_stats,
        with_registers("bef")
        + ", d AS (SELECT year, ANTPERSH AS household_size, KOM AS municipality, REG AS region FROM bef)\n"
        + _typed_sql("d", ["household_size"], ["municipality", "region"], by="year"),
    ),
    "stratified_stats": (stratified_stats, _PANEL + _stratified_sql(["ANTPERSH", "MOR_PERINDKIALT_13"], "KOEN", "WHERE KOEN IS NOT NULL")),
    "overall_stats": (overall_stats, _PANEL + _stratified_sql(["ANTPERSH", "MOR_PERINDKIALT_13"], "'all'")),
    "distribution_at_years": (
        distribution_at_years,
        _PANEL
        + f"""SELECT year, MOR_EDU_LVL AS value, count(*) AS count, round(count(*) / CAST({_PERSONS} AS DOUBLE) * 100, 6) AS percentage
              FROM panel WHERE year IN (1996, 1998, 2000) GROUP BY year, MOR_EDU_LVL ORDER BY year, count DESC, value""",
    ),
    "distribution_overall": (
        distribution_overall,
        _PANEL
        + f"""SELECT KOEN AS value, count(*) AS count, round(count(*) / CAST({_PERSONS} AS DOUBLE) * 100, 6) AS percentage
              FROM panel GROUP BY KOEN ORDER BY count DESC, value""",
    ),
    "baseline_table": (baseline, _baseline_sql(None) + _ROUNDED),
    "baseline_table_by_sex": (baseline_by_sex, _baseline_sql("KOEN") + _ROUNDED),
    "baseline_text": (baseline_text, _baseline_sql(None) + _TEXT),
    "describe": (describe, _PANEL + _describe_sql()),
    "missing_table": (
        missing_table,
        _PANEL
        + _union(
            f"SELECT '{c}' AS column, count(*) - count({c}) AS missing, round(100 * (count(*) - count({c})) / CAST(count(*) AS DOUBLE), 2) AS percentage FROM panel"
            for c in _PANEL_TYPES
        ),
    ),
    "non_null_counts": (non_null_counts, _PANEL + _union(f"SELECT '{c}' AS column, count({c}) AS non_null FROM panel" for c in _PANEL_TYPES)),
    "column_profile": (column_profile, _PANEL + _profile_sql()),
}
