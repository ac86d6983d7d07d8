"""Children, parents and families."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinpanel.functions.dates import parse_date
from kinpanel.operators import population as p
from kinpanel.sources.registers import read_register
from queries.proxies import register, with_registers

YEARS = (1990, 2010)


def date_parse(spark, sf):
    d = register(spark, sf, "dates")
    return d.select("id", parse_date("text").alias("parsed"))


def register_scan(spark, sf):
    """A register file with chosen columns, declared types and the period of its name (here: none)."""
    layout = {"o_custkey": "string", "o_shippriority": "string", "o_totalprice": "double"}
    return read_register(spark, "orders", f"{sf}/orders.parquet", keep=["o_orderkey", "o_custkey", "o_totalprice", "o_absent", "year", "month"], layout=layout)


def birth_window(spark, sf):
    return p.born_between(register(spark, sf, "person"), *YEARS).select("PNR", "FOED_DAG")


def first_record(spark, sf):
    return p.unique_children(register(spark, sf, "bef"), *YEARS)


def parent_births(spark, sf):
    return p.parent_births(register(spark, sf, "bef"))


def _children(spark, sf):
    bef = p.unique_children(register(spark, sf, "bef"), *YEARS)
    mfr = p.unique_children(register(spark, sf, "mfr"), *YEARS)
    return bef, mfr


def population_full_join(spark, sf):
    return p.combine_children(*_children(spark, sf))


def family_birth_dates(spark, sf):
    return p.add_parent_births(p.combine_children(*_children(spark, sf)), p.parent_births(register(spark, sf, "bef")))


def population_summary_before(spark, sf):
    return p.summary_before(*_children(spark, sf))


def population_summary_after(spark, sf):
    return p.summary_after(p.combine_children(*_children(spark, sf)))


def family_size(spark, sf):
    return p.family_size(p.relationships(register(spark, sf, "family")))


def individuals(spark, sf):
    return p.individuals(register(spark, sf, "family"))


def relationships(spark, sf):
    return p.relationships(register(spark, sf, "family"))


def age_gaps(spark, sf):
    gaps = p.age_gaps(register(spark, sf, "family"))
    return gaps.select(*[F.round(c, 6).alias(c) for c in gaps.columns])


def births_per_year(spark, sf):
    y = p.births_per_year(register(spark, sf, "family"))
    return y.select(F.col("year").cast("int").alias("year"), "children")


_BORN = "FOED_DAG >= DATE '1990-01-01' AND FOED_DAG <= DATE '2010-12-31'"
_CHILDREN = with_registers("bef", "mfr") + f"""
, ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY PNR ORDER BY year NULLS FIRST, month NULLS FIRST, FOED_DAG NULLS FIRST, FAR_ID NULLS FIRST, MOR_ID NULLS FIRST, FAMILIE_ID NULLS FIRST) AS rn
  FROM bef WHERE {_BORN}),
children AS (SELECT PNR, FOED_DAG, FAR_ID, MOR_ID, FAMILIE_ID FROM ranked WHERE rn = 1),
births AS (SELECT PNR, FOED_DAG, FAR_ID, MOR_ID, FAMILIE_ID FROM mfr WHERE {_BORN}),
combined AS (
  SELECT coalesce(c.PNR, b.PNR) AS PNR, coalesce(c.FOED_DAG, b.FOED_DAG) AS FOED_DAG,
         coalesce(c.FAR_ID, b.FAR_ID) AS FAR_ID, coalesce(c.MOR_ID, b.MOR_ID) AS MOR_ID, c.FAMILIE_ID AS FAMILIE_ID,
         c.PNR IS NOT NULL AS in_register, b.PNR IS NOT NULL AS in_births
  FROM children c FULL JOIN births b ON c.PNR = b.PNR),
people AS (
  SELECT PNR, FOED_DAG FROM (
    SELECT *, row_number() OVER (PARTITION BY PNR ORDER BY year, month, FOED_DAG NULLS FIRST) AS rn FROM bef) WHERE rn = 1)
"""

QUERIES = {
    "register_scan": (
        register_scan,
        "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_totalprice, CAST(NULL AS INT) AS year, CAST(NULL AS INT) AS month FROM orders",
    ),
    "date_parse": (date_parse, with_registers("dates") + "SELECT id, expected AS parsed FROM dates"),
    "birth_window": (birth_window, with_registers("person") + f"SELECT PNR, FOED_DAG FROM person WHERE {_BORN}"),
    "first_record": (first_record, _CHILDREN + "SELECT * FROM children"),
    "parent_births": (parent_births, _CHILDREN + "SELECT * FROM people"),
    "population_full_join": (population_full_join, _CHILDREN + "SELECT * FROM combined"),
    "family_birth_dates": (
        family_birth_dates,
        _CHILDREN
        + """SELECT k.PNR, k.FOED_DAG, k.FAR_ID, f.FOED_DAG AS FAR_FDAG, k.MOR_ID, m.FOED_DAG AS MOR_FDAG, k.FAMILIE_ID
             FROM combined k LEFT JOIN people f ON k.FAR_ID = f.PNR LEFT JOIN people m ON k.MOR_ID = m.PNR""",
    ),
    "population_summary_before": (
        population_summary_before,
        _CHILDREN
        + """SELECT * FROM
             (SELECT count(*) AS total_bef_records, count(*) FILTER (FAR_ID IS NULL) AS bef_missing_far,
                     count(*) FILTER (MOR_ID IS NULL) AS bef_missing_mor FROM children),
             (SELECT count(*) AS total_mfr_records, count(*) FILTER (FAR_ID IS NULL) AS mfr_missing_far,
                     count(*) FILTER (MOR_ID IS NULL) AS mfr_missing_mor FROM births)""",
    ),
    "population_summary_after": (
        population_summary_after,
        _CHILDREN
        + """SELECT count(*) AS total_combined_records,
                    count(*) - count(FAR_ID) AS combined_missing_far, count(*) - count(MOR_ID) AS combined_missing_mor,
                    count(*) FILTER (in_register AND NOT in_births) AS records_only_in_bef,
                    count(*) FILTER (in_births AND NOT in_register) AS records_only_in_mfr,
                    count(FAMILIE_ID) AS records_with_family_id FROM combined""",
    ),
    "family_size": (
        family_size,
        with_registers("family") + "SELECT FAMILIE_ID AS family_id, count(PNR) AS number_of_children FROM family GROUP BY FAMILIE_ID",
    ),
    "individuals": (
        individuals,
        with_registers("family")
        + """SELECT PNR AS individual_id, FOED_DAG AS birth_date, 'child' AS role FROM family
             UNION ALL SELECT FAR_ID, FAR_FDAG, 'father' FROM family WHERE FAR_ID IS NOT NULL
             UNION ALL SELECT MOR_ID, MOR_FDAG, 'mother' FROM family WHERE MOR_ID IS NOT NULL""",
    ),
    "relationships": (
        relationships,
        with_registers("family")
        + """SELECT PNR AS child_id, FAR_ID AS father_id, MOR_ID AS mother_id, FAMILIE_ID AS family_id, FOED_DAG AS birth_date,
                    FAR_FDAG AS father_birth_date, MOR_FDAG AS mother_birth_date FROM family""",
    ),
    "age_gaps": (
        age_gaps,
        with_registers("family")
        + """SELECT round((FOED_DAG - FAR_FDAG) / 365.25, 6) AS father_age_diff,
                    round((FOED_DAG - MOR_FDAG) / 365.25, 6) AS mother_age_diff FROM family""",
    ),
    "births_per_year": (
        births_per_year,
        with_registers("family") + "SELECT CAST(year(FOED_DAG) AS INT) AS year, count(*) AS children FROM family GROUP BY 1",
    ),
}
