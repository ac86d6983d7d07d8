"""Register panels: columns, labels, joins to the population, roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinpanel.fixed_values import REG
from kinpanel.functions.labels import label
from kinpanel.operators import columns as c
from kinpanel.operators import panel as pn
from queries.proxies import register, table, with_registers


def kept_columns(spark, sf):
    """Listed columns that exist, with the period columns kept."""
    return c.keep_existing(register(spark, sf, "bef"), ["PNR", "KOM", "NOT_THERE"])


def dropped_columns(spark, sf):
    return c.keep_or_drop(register(spark, sf, "mfr"), drop=["FAMILIE_ID"])


def layout_cast(spark, sf):
    """Order rows cast to a declared layout; text that is no number becomes null."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    layout = {"o_orderkey": "string", "o_custkey": "int32", "o_orderpriority": "int32", "absent": "int8"}
    return c.apply_layout(rows, layout, "try")


def prefixed_columns(spark, sf):
    return c.prefixed(register(spark, sf, "ind"), "FAR_", "PNR")


def distinct_person_years(spark, sf):
    return register(spark, sf, "bef").select("PNR", "year").distinct()


def code_labels(spark, sf):
    """Labels from a dictionary table; unmapped codes pass through."""
    rows = table(spark, sf, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END").alias("c_nationkey"))
    return pn.apply_dictionary(rows, "c_nationkey", register(spark, sf, "dictionary"), into="nation")


def region_labels(spark, sf):
    """Labels from a short fixed dictionary, inside the projection."""
    return register(spark, sf, "bef").select("PNR", "year", "month", "KOM", label("REG", REG).alias("REG"))


def education_levels(spark, sf):
    """Level joined by code; unknown codes stay without a level."""
    codes = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("HFAUDD"))
    levels = register(spark, sf, "dictionary").select(F.col("code").alias("HFAUDD"), F.col("label").alias("EDU_LVL")).distinct()
    return pn.add_education_level(codes, levels)


def register_join(spark, sf):
    return pn.join_register(register(spark, sf, "person"), register(spark, sf, "ind"))


def parents_join(spark, sf):
    """Income rows of both parents beside each child: every combination."""
    return pn.join_parents(register(spark, sf, "person"), register(spark, sf, "ind"))


def parents_join_same_year(spark, sf):
    joined = pn.join_parents(register(spark, sf, "person"), register(spark, sf, "ind"), same_period=True)
    return joined


def _with_parents(spark, sf):
    child = pn.join_register(register(spark, sf, "person"), register(spark, sf, "ind"))
    parent = pn.join_parents(register(spark, sf, "person"), register(spark, sf, "ind"), same_period=True)
    return pn.stack_registers([child, parent])


def roles_union(spark, sf):
    return _with_parents(spark, sf)


def child_panel(spark, sf):
    return pn.split_roles(_with_parents(spark, sf))["child"]


def mother_panel(spark, sf):
    return pn.split_roles(_with_parents(spark, sf))["mother"]


def father_panel(spark, sf):
    return pn.split_roles(_with_parents(spark, sf))["father"]


def year_gaps(spark, sf):
    """Years without births between the first and the last."""
    years = register(spark, sf, "dates").where(F.col("expected").isNotNull()).select(
        (F.year("expected") * 3 + F.month("expected").cast("int") % 2).alias("year")
    )
    return pn.year_gaps(years)


def renamed_duplicates(spark, sf):
    rows = table(spark, sf, "customer")
    return c.unique_names(rows.select("c_custkey", "c_name", "c_name", "c_nationkey", "c_name"))


def panel_in_order(spark, sf):
    return c.in_order_of(register(spark, sf, "ind"), ["year", "PNR"])


_PERSON_IND = with_registers("person", "ind")
_PARENT = "{p}.PERINDKIALT_13 AS {x}_PERINDKIALT_13, {p}.BESKST13 AS {x}_BESKST13, {p}.year AS {x}_year"
_SAME_YEAR = f"""
fathers AS (SELECT p.PNR, i.year, {_PARENT.format(p="i", x="FAR")} FROM person p JOIN ind i ON p.FAR_ID = i.PNR),
mothers AS (SELECT p.PNR, i.year, {_PARENT.format(p="i", x="MOR")} FROM person p JOIN ind i ON p.MOR_ID = i.PNR),
both_parents AS (
  SELECT coalesce(f.PNR, m.PNR) AS PNR, coalesce(f.year, m.year) AS year, f.* EXCLUDE (PNR, year), m.* EXCLUDE (PNR, year)
  FROM fathers f FULL JOIN mothers m ON f.PNR = m.PNR AND f.year = m.year),
same_year AS (SELECT p.*, b.* EXCLUDE (PNR) FROM person p LEFT JOIN both_parents b ON p.PNR = b.PNR),
own AS (SELECT p.*, i.* EXCLUDE (PNR) FROM person p LEFT JOIN ind i ON p.PNR = i.PNR),
stacked AS (SELECT * FROM own UNION ALL BY NAME SELECT * FROM same_year)
"""

QUERIES = {
    "kept_columns": (kept_columns, with_registers("bef") + "SELECT PNR, KOM, year, month FROM bef"),
    "dropped_columns": (dropped_columns, with_registers("mfr") + "SELECT * EXCLUDE (FAMILIE_ID) FROM mfr"),
    "layout_cast": (
        layout_cast,
        "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, TRY_CAST(o_orderpriority AS INT) AS o_orderpriority, CAST(o_custkey AS INT) AS o_custkey FROM orders",
    ),
    "prefixed_columns": (
        prefixed_columns,
        with_registers("ind") + "SELECT PNR, PERINDKIALT_13 AS FAR_PERINDKIALT_13, BESKST13 AS FAR_BESKST13, year AS FAR_year FROM ind",
    ),
    "distinct_person_years": (distinct_person_years, with_registers("bef") + "SELECT DISTINCT PNR, year FROM bef"),
    "code_labels": (
        code_labels,
        with_registers("dictionary")
        + """, x AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer)
             SELECT x.*, coalesce(d.label, CAST(x.c_nationkey AS VARCHAR)) AS nation
             FROM x LEFT JOIN dictionary d ON CAST(x.c_nationkey AS VARCHAR) = d.code""",
    ),
    "region_labels": (
        region_labels,
        with_registers("bef")
        + ", labels_of_reg(code, label) AS (VALUES "
        + ", ".join(f"('{k}', '{v}')" for k, v in REG.items())
        + """) SELECT b.PNR, b.year, b.month, b.KOM, coalesce(l.label, b.REG) AS REG FROM bef b LEFT JOIN labels_of_reg l ON b.REG = l.code""",
    ),
    "education_levels": (
        education_levels,
        with_registers("dictionary")
        + """SELECT c.c_custkey, CAST(c.c_nationkey AS VARCHAR) AS HFAUDD, d.label AS EDU_LVL
             FROM customer c LEFT JOIN dictionary d ON CAST(c.c_nationkey AS VARCHAR) = d.code""",
    ),
    "register_join": (register_join, _PERSON_IND + "SELECT p.*, i.* EXCLUDE (PNR) FROM person p LEFT JOIN ind i ON p.PNR = i.PNR"),
    "parents_join": (
        parents_join,
        _PERSON_IND
        + f"""SELECT p.*, {_PARENT.format(p="f", x="FAR")}, {_PARENT.format(p="m", x="MOR")}
              FROM person p LEFT JOIN ind f ON p.FAR_ID = f.PNR LEFT JOIN ind m ON p.MOR_ID = m.PNR""",
    ),
    "parents_join_same_year": (parents_join_same_year, _PERSON_IND + "," + _SAME_YEAR + "SELECT * FROM same_year"),
    "roles_union": (roles_union, _PERSON_IND + "," + _SAME_YEAR + "SELECT * FROM stacked"),
    "child_panel": (
        child_panel,
        _PERSON_IND + "," + _SAME_YEAR + "SELECT PNR, FOED_DAG, FAMILIE_ID, PERINDKIALT_13, BESKST13, year FROM stacked",
    ),
    "mother_panel": (
        mother_panel,
        _PERSON_IND
        + ","
        + _SAME_YEAR
        + "SELECT PNR AS CHILD_PNR, year, MOR_ID AS MOTHER_PNR, MOR_PERINDKIALT_13, MOR_BESKST13, MOR_year FROM stacked",
    ),
    "father_panel": (
        father_panel,
        _PERSON_IND
        + ","
        + _SAME_YEAR
        + "SELECT PNR AS CHILD_PNR, year, FAR_ID AS FATHER_PNR, FAR_PERINDKIALT_13, FAR_BESKST13, FAR_year FROM stacked",
    ),
    "year_gaps": (
        year_gaps,
        with_registers("dates")
        + """, y AS (SELECT DISTINCT CAST(year(expected) * 3 + month(expected) % 2 AS INT) AS year FROM dates WHERE expected IS NOT NULL)
             SELECT CAST(g AS INT) AS year FROM (SELECT unnest(range((SELECT min(year) FROM y), (SELECT max(year) + 1 FROM y))) AS g)
             WHERE g NOT IN (SELECT year FROM y)""",
    ),
    "renamed_duplicates": (
        renamed_duplicates,
        "SELECT c_custkey, c_name, c_name AS c_name_1, c_nationkey, c_name AS c_name_2 FROM customer",
    ),
    "panel_in_order": (panel_in_order, with_registers("ind") + "SELECT * FROM ind ORDER BY year, PNR"),
}
