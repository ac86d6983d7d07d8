"""Registers derived from the given star-schema tables.

Every register is a projection of one table, written in expressions that mean
the same in Spark SQL and in ANSI SQL, so that both sides of a check start from
the same rows.  Nothing is left out: each register has a row per table row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LETTERS = "DEGIJKMNPQ"


def _code(letter: str, number: str, last: str) -> str:
    """Diagnosis code: D, category letter, two digits, one more digit."""
    return (
        f"concat('D', substr('{LETTERS}', CAST({letter} % 10 AS INT) + 1, 1), "
        f"lpad(CAST({number} % 100 AS STRING), 2, '0'), CAST({last} % 10 AS STRING))"
    )


def _id(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _part(expr: str, n: int) -> str:
    """Whole part of ``expr / n``."""
    return f"CAST(floor({expr} / {n}) AS BIGINT)"


def _born(expr: str) -> str:
    return f"DATE '1985-01-01' + CAST(({expr} * 7) % 12000 AS INT)"


def _unless(condition: str, expr: str) -> str:
    return f"CASE WHEN {condition} THEN NULL ELSE {expr} END"


_Y, _M, _D = (f"CAST({part}(o_orderdate) AS STRING)" for part in ("year", "month", "day"))
_MM, _DD = f"lpad({_M}, 2, '0')", f"lpad({_D}, 2, '0')"
_MMM = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month(o_orderdate) AS INT) * 3 - 2, 3)"

REGISTERS: dict[str, tuple[str, dict[str, str]]] = {
    # Population register, several rows per person and year.
    "bef": (
        "orders",
        {
            "PNR": _id("o_custkey"),
            "FAR_ID": _unless("o_orderkey % 11 = 0", _id(_part("o_custkey", 3))),
            "MOR_ID": _unless("o_orderkey % 13 = 0", _id(_part("o_custkey", 4))),
            "FAMILIE_ID": _unless("o_custkey % 17 = 0", f"concat('F', {_id(_part('o_custkey', 3))})"),
            "FOED_DAG": _born("o_custkey"),
            "KOEN": "CASE WHEN o_custkey % 2 = 0 THEN 'K' ELSE 'M' END",
            "KOM": "CAST(o_orderkey % 98 AS INT)",
            "FAMILIE_TYPE": "o_orderstatus",
            "ANTPERSH": "CAST(1 + o_orderkey % 6 AS INT)",
            "ANTBOERNH": "CAST(o_orderkey % 4 AS INT)",
            "REG": _unless("o_orderkey % 9 = 0", _id("80 + o_orderkey % 8")),
            "year": "CAST(year(o_orderdate) AS INT)",
            "month": "CAST(month(o_orderdate) AS INT)",
        },
    ),
    # Birth register; half of the children are known to the population register.
    "mfr": (
        "customer",
        {
            "PNR": _id("c_custkey * 2"),
            "FAR_ID": _unless("c_custkey % 7 = 0", _id(_part("c_custkey", 2))),
            "MOR_ID": _unless("c_custkey % 19 = 0", _id(_part("c_custkey", 5))),
            "FOED_DAG": _born("c_custkey * 2"),
            "FAMILIE_ID": "CAST(NULL AS STRING)",
        },
    ),
    # Children with parents, one row per person.
    "person": (
        "customer",
        {
            "PNR": _id("c_custkey"),
            "FOED_DAG": _born("c_custkey"),
            "FAR_ID": _unless("c_custkey % 11 = 0", _id(_part("c_custkey", 3))),
            "MOR_ID": _unless("c_custkey % 13 = 0", _id(_part("c_custkey", 4))),
            "FAMILIE_ID": _unless("c_custkey % 17 = 0", f"concat('F', {_id(_part('c_custkey', 3))})"),
        },
    ),
    # Families with the parents' birth dates already attached.
    "family": (
        "customer",
        {
            "PNR": _id("c_custkey"),
            "FOED_DAG": _born("c_custkey"),
            "FAR_ID": _unless("c_custkey % 11 = 0", _id(_part("c_custkey", 3))),
            "FAR_FDAG": _unless("c_custkey % 11 = 0", f"DATE '1950-01-01' + CAST(({_part('c_custkey', 3)} * 13) % 9000 AS INT)"),
            "MOR_ID": _unless("c_custkey % 13 = 0", _id(_part("c_custkey", 4))),
            "MOR_FDAG": _unless("c_custkey % 13 = 0", f"DATE '1952-01-01' + CAST(({_part('c_custkey', 4)} * 17) % 9000 AS INT)"),
            "FAMILIE_ID": _unless("c_custkey % 17 = 0", f"concat('F', {_id(_part('c_custkey', 3))})"),
        },
    ),
    # Hospital system v2.
    "adm": (
        "orders",
        {
            "RECNUM": _id("o_orderkey"),
            "PNR": _id("o_custkey"),
            "C_ADIAG": _unless("o_orderkey % 5 = 0", _code("o_orderkey", "o_custkey", "o_orderkey")),
            "D_INDDTO": "CAST(o_orderdate AS DATE)",
            "D_UDDTO": _unless("o_orderkey % 6 = 0", "CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INT)"),
            "C_INDM": _unless("o_orderkey % 10 = 3", "o_orderpriority"),
            "C_AFD": _unless("o_orderkey % 7 = 0", "concat('A', CAST(o_orderkey % 13 AS STRING))"),
            "C_SGH": "concat('H', CAST(o_custkey % 23 AS STRING))",
            "C_PATTYPE": "o_orderstatus",
            "VERSION": "'v1'",
        },
    ),
    "diag": (
        "lineitem",
        {
            "RECNUM": _id("l_orderkey"),
            "C_DIAG": _code("l_partkey", "l_suppkey", "l_linenumber"),
            "C_TILDIAG": _unless("l_returnflag = 'R'", _code("l_suppkey", "l_partkey", "l_linenumber")),
            "VERSION": "'v2'",
        },
    ),
    "bes": (
        "orders",
        {
            "RECNUM": _id("o_orderkey + o_orderkey % 2"),
            "D_AMBDTO": "CAST(o_orderdate AS DATE) + 14",
            "VERSION": "'v3'",
        },
    ),
    # Hospital system v3, dates as text.
    "kont": (
        "events",
        {
            "DW_EK_KONTAKT": _id("event_id"),
            "CPR": _id("user_id"),
            "dato_start": "concat(lpad(CAST(day(ts) AS STRING), 2, '0'), '-', lpad(CAST(month(ts) AS STRING), 2, '0'), '-', CAST(year(ts) AS STRING))",
            "dato_slut": "concat(CAST(year(ts) AS STRING), '-', lpad(CAST(month(ts) AS STRING), 2, '0'), '-', lpad(CAST(day(ts) AS STRING), 2, '0'))",
            "aktionsdiagnose": _code("event_id", "user_id", "event_id"),
            "SORENHED_ANS": _unless("event_id % 4 = 0", "concat('S', CAST(event_id % 11 AS STRING))"),
            "prioritet": "event_type",
            "kontakttype": "event_type",
        },
    ),
    "diag3": (
        "events",
        {
            "DW_EK_KONTAKT": _id(f"{_part('event_id', 2)} * 2"),
            "diagnosekode": _code("user_id", "event_id", "event_id"),
            "diagnosetype": "CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END",
            "senere_afkraeftet": "CASE WHEN event_id % 10 = 0 THEN 'Ja' ELSE 'Nej' END",
        },
    ),
    # Income register, with some missing values and zeros.
    "ind": (
        "orders",
        {
            "PNR": _id("o_custkey"),
            "PERINDKIALT_13": _unless("o_orderkey % 12 = 5", "CASE WHEN o_orderkey % 12 = 6 THEN 0.0 ELSE o_totalprice END"),
            "BESKST13": _unless("o_orderkey % 8 = 0", "CAST(o_orderkey % 5 AS INT)"),
            "year": "CAST(year(o_orderdate) AS INT)",
        },
    ),
    # Mother's panel.
    "mother": (
        "orders",
        {
            "CHILD_PNR": _id("o_custkey"),
            "MOTHER_PNR": _id(_part("o_custkey", 4)),
            "MOR_EDU_LVL": _unless("o_orderkey % 9 = 0", _id("o_orderkey % 4")),
            "MOR_PERINDKIALT_13": _unless("o_orderkey % 12 = 5", "CASE WHEN o_orderkey % 12 = 6 THEN 0.0 ELSE o_totalprice END"),
            "MOR_BESKST13": "CAST(o_orderkey % 5 AS INT)",
            "MOR_STILL": _unless("o_orderkey % 7 = 0", _id("o_orderkey % 3")),
            "MOR_SOCIO13": "CAST(o_orderkey % 4 AS INT)",
            "MOR_year": "CAST(year(o_orderdate) AS INT)",
            "MOR_month": "CAST(month(o_orderdate) AS INT)",
        },
    ),
    # Father's panel; some rows have no father.
    "father": (
        "orders",
        {
            "CHILD_PNR": _id("o_custkey"),
            "FATHER_PNR": _unless("o_orderkey % 29 = 0", _id(_part("o_custkey", 3))),
            "FAR_EDU_LVL": _unless("o_orderkey % 9 = 0", _id("o_orderkey % 4")),
            "FAR_PERINDKIALT_13": _unless("o_orderkey % 12 = 5", "CASE WHEN o_orderkey % 12 = 6 THEN 0.0 ELSE o_totalprice END"),
            "FAR_BESKST13": "CAST(o_orderkey % 5 AS INT)",
            "FAR_STILL": _unless("o_orderkey % 7 = 0", _id("o_orderkey % 3")),
            "FAR_SOCIO13": "CAST(o_orderkey % 4 AS INT)",
            "FAR_year": "CAST(year(o_orderdate) AS INT)",
            "FAR_month": "CAST(month(o_orderdate) AS INT)",
        },
    ),
    # Person-year panel with parents, for the baseline table.
    "panel": (
        "orders",
        {
            "PNR": _id("o_custkey"),
            "year": "CAST(year(o_orderdate) AS INT)",
            "FOED_DAG": _born("o_custkey"),
            "KOEN": _unless("o_orderkey % 10 = 0", "CASE WHEN o_custkey % 2 = 0 THEN 'K' ELSE 'M' END"),
            "FAMILIE_TYPE": "o_orderstatus",
            "ANTPERSH": "CAST(1 + o_orderkey % 6 AS INT)",
            "ANTBOERNF": "CAST(o_orderkey % 4 AS INT)",
            "MOR_FDAG": _unless("o_custkey % 13 = 0", f"DATE '1952-01-01' + CAST(({_part('o_custkey', 4)} * 17) % 9000 AS INT)"),
            "MOR_EDU_LVL": _unless("o_orderkey % 9 = 0", _id("o_orderkey % 4")),
            "MOR_PERINDKIALT_13": _unless("o_orderkey % 12 = 5", "o_totalprice"),
            "MOR_BESKST13": _id("o_orderkey % 5"),
            "FAR_FDAG": _unless("o_custkey % 11 = 0", f"DATE '1950-01-01' + CAST(({_part('o_custkey', 3)} * 13) % 9000 AS INT)"),
            "FAR_EDU_LVL": _unless("o_orderkey % 8 = 0", _id("o_orderkey % 3")),
            "FAR_PERINDKIALT_13": _unless("o_orderkey % 14 = 5", "o_totalprice * 2"),
            "FAR_BESKST13": _id("o_orderkey % 6"),
        },
    ),
    # Event table; the day of the month stands for the year, as all rows fall in one month.
    "log": (
        "events",
        {
            "event_type": "event_type",
            "PNR": _id("user_id"),
            "year": "CAST(day(ts) AS INT)",
            "age": _unless("event_id % 10 = 0", "CAST((user_id * 3) % 95 AS INT)"),
            "shift": _unless("event_id % 15 = 0", "concat('shift ', CAST(CAST(hour(ts) AS INT) % 3 AS STRING))"),
            "event_date": _unless("event_id % 20 = 0", "CAST(ts AS DATE)"),
        },
    ),
    # Short sequences that many persons share.
    "steps": (
        "lineitem",
        {
            "event_type": "concat(l_returnflag, '-', CAST(l_linenumber % 3 AS STRING))",
            "PNR": _id("l_orderkey"),
            "year": "CAST(year(l_shipdate) AS INT)",
        },
    ),
    # An event table with more types than a panel has.
    "many": (
        "lineitem",
        {
            "event_type": _unless("l_partkey % 31 = 0", "concat('e', CAST(l_partkey % 24 AS STRING))"),
            "PNR": _unless("l_orderkey % 37 = 0", _id("l_orderkey")),
            "year": "CAST(year(l_shipdate) AS INT)",
        },
    ),
    # Dates as text in one of eleven formats, and junk.
    "dates": (
        "orders",
        {
            "id": "o_orderkey",
            "text": "CASE CAST(o_orderkey % 12 AS INT) "
            f"WHEN 0 THEN concat({_Y}, '/', {_MM}, '/', {_DD}) "
            f"WHEN 1 THEN concat({_D}, '/', {_M}, '/', {_Y}) "
            f"WHEN 2 THEN concat({_Y}, '-', {_MM}, '-', {_DD}) "
            f"WHEN 3 THEN concat({_DD}, {_MMM}, {_Y}) "
            f"WHEN 4 THEN concat({_DD}, '-', {_MM}, '-', {_Y}) "
            f"WHEN 5 THEN concat({_Y}, '-', {_MM}, '-', {_DD}, ' 10:11:12') "
            # The American forms can only be told where the day is above twelve.
            f"WHEN 6 THEN CASE WHEN day(o_orderdate) > 12 THEN concat({_M}, '/', {_D}, '/', {_Y}) ELSE concat({_D}, '/', {_M}, '/', {_Y}) END "
            f"WHEN 7 THEN concat({_M}, '/', {_D}, '/', substr({_Y}, 3, 2)) "
            f"WHEN 8 THEN CASE WHEN day(o_orderdate) > 12 THEN concat({_M}, '-', {_D}, '-', {_Y}) ELSE concat({_D}, '-', {_M}, '-', {_Y}) END "
            f"WHEN 9 THEN concat({_Y}, '/', {_M}, '/', {_D}, ' 10:11:12') "
            f"WHEN 10 THEN concat('Mon ', {_MMM}, ' ', {_D}, ' 01:02:03 ', {_Y}) "
            "ELSE o_orderpriority END",
            "expected": _unless("o_orderkey % 12 = 11", "CAST(o_orderdate AS DATE)"),
        },
    ),
    # Code dictionary without some of the codes in use.
    "dictionary": (
        "nation",
        {
            "code": "CASE WHEN n_nationkey % 4 = 0 THEN concat('x', CAST(n_nationkey AS STRING)) ELSE CAST(n_nationkey AS STRING) END",
            "label": "n_name",
        },
    ),
    # ICD texts for some of the categories in use.
    "icd": (
        "supplier",
        {
            "icd10": f"concat(substr('{LETTERS}', CAST(s_suppkey % 10 AS INT) + 1, 1), lpad(CAST(s_suppkey % 100 AS STRING), 2, '0'), CAST(1 + s_suppkey % 7 AS STRING), CASE WHEN s_suppkey < 100 THEN '' ELSE CAST(s_suppkey AS STRING) END)",
            "description": "s_name",
        },
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = REGISTERS[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def with_registers(*names: str) -> str:
    """``WITH`` clause defining the registers in SQL."""
    parts = []
    for name in names:
        source, columns = REGISTERS[name]
        body = ", ".join(f"{e} AS {c}" for c, e in columns.items())
        parts.append(f"{name} AS (SELECT {body} FROM {source})")
    return "WITH " + ",\n".join(parts) + "\n"
