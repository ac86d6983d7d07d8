"""Registers written as yearly files and read again by the register readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinpanel.fixed_values import REG
from kinpanel.operators.panel import label_codes
from kinpanel.operators.scale import shared_folder
from kinpanel.operators.sketches import ERROR
from kinpanel.operators.statistics import profile
from kinpanel.sources.dictionaries import read_json_dictionary
from kinpanel.sources.registers import read_births, read_parquet, read_population, read_register
from kinpanel.sources.sketches import profile_panel, write_sketches
from kinpanel.sources.tables import read_panel, write_panel
from queries.proxies import register, table, with_registers

PERIOD = ("year", "month")


def _put(df, folder: str, name: str, where: str, types: dict[str, str] | None = None, drop: tuple[str, ...] = ()) -> None:
    """The rows of one file, with column types of its own."""
    own = df.filter(where).drop(*drop)
    own.withColumns({c: F.col(c).cast(t) for c, t in (types or {}).items()}).write.parquet(f"{folder}/{name}")


def parquet_scan(spark, sf):
    """Two tables' files in one scan: columns that one lacks are null."""
    return read_parquet(spark, [f"{sf}/orders.parquet", f"{sf}/customer.parquet"]).select("o_orderkey", "o_custkey", "o_totalprice", "c_custkey", "c_name", "c_nationkey")


def population_files(spark, sf):
    """Yearly files of the population register: numbers of two widths, a year of numeric ids with birth dates as text and without family."""
    folder, rows = shared_folder(spark), register(spark, sf, "bef")
    _put(rows, folder, "bef200112.parquet", "year % 3 = 0", {"KOM": "tinyint"}, PERIOD)
    _put(rows, folder, "bef2002.parquet", "year % 3 = 1", {"KOM": "smallint"}, PERIOD)
    _put(rows, folder, "bef_200306.parquet", "year % 3 = 2", {"KOM": "int", "PNR": "bigint", "FOED_DAG": "string"}, (*PERIOD, "FAMILIE_ID"))
    return read_population(spark, f"{folder}/bef*.parquet")


def births_files(spark, sf):
    """Files of the birth register, with ids as text and as numbers."""
    folder = shared_folder(spark)
    rows = register(spark, sf, "mfr").select(F.col("PNR").alias("CPR_BARN"), F.col("FAR_ID").alias("CPR_FADER"), F.col("MOR_ID").alias("CPR_MODER"), F.col("FOED_DAG").alias("FOEDSELSDATO"))
    _put(rows, folder, "mfr1999.parquet", "CAST(CPR_BARN AS BIGINT) % 4 = 0")
    _put(rows, folder, "mfr200007.parquet", "CAST(CPR_BARN AS BIGINT) % 4 <> 0", {"CPR_BARN": "bigint", "CPR_FADER": "int", "FOEDSELSDATO": "string"})
    return read_births(spark, f"{folder}/mfr*.parquet")


def register_years(spark, sf):
    """A register's files with drifting types as a panel partitioned by year, of which two years are read."""
    folder, rows = shared_folder(spark), register(spark, sf, "bef").select("PNR", "KOM", "ANTPERSH", "REG", "year")
    _put(rows, folder, "bef1995.parquet", "year = 1995", {"KOM": "tinyint", "ANTPERSH": "tinyint"}, ("year",))
    _put(rows, folder, "bef1996.parquet", "year = 1996", {"KOM": "smallint", "ANTPERSH": "string"}, ("year",))
    _put(rows, folder, "bef1997.parquet", "year = 1997", {"KOM": "int"}, ("year", "REG"))
    panel = read_register(spark, "bef", f"{folder}/bef*.parquet", layout={"PNR": "string", "KOM": "smallint", "ANTPERSH": "tinyint"})
    write_panel(panel, f"{folder}/panel")
    return read_panel(spark, f"{folder}/panel", 1996, 1997).select("PNR", "KOM", "ANTPERSH", "REG", "year", "month")


def panel_profile(spark, sf):
    """Profile of some years of a written panel from the sketches beside it; estimates are held against the rows' own figures."""
    path = f"{shared_folder(spark)}/panel"
    write_panel(register(spark, sf, "ind").select("PNR", "PERINDKIALT_13", "BESKST13", "year"), path)
    write_sketches(spark, path)
    told = profile_panel(spark, path, 1994, 1996)
    exact = profile(read_panel(spark, path, 1994, 1996).drop("year")).select("column", F.col("distinct_values").alias("d"), F.col("mean").alias("m"))
    close = F.abs(F.col("distinct_values") - F.col("d")) <= F.greatest(F.lit(1.0), 4 * ERROR * F.col("d"))
    same = F.coalesce(F.abs(F.col("mean") - F.col("m")) <= 1e-9 * F.abs("m"), F.col("m").isNull())
    return told.join(exact, "column").select("column", "rows", "missing", "min", "max", close.alias("distinct_close"), same.alias("mean_equal"))


def _profile_row(column: str, number: bool) -> str:
    ends = ", ".join(f"CAST({f}({column}) AS DOUBLE) AS {f}" if number else f"CAST(NULL AS DOUBLE) AS {f}" for f in ("min", "max"))
    return f"SELECT '{column}' AS column, count(*) AS rows, count(*) - count({column}) AS missing, {ends}, true AS distinct_close, true AS mean_equal FROM ind WHERE year BETWEEN 1994 AND 1996"


def citizenship_labels(spark, sf):
    """Coded columns of the population register labelled, citizenship by a JSON dictionary; codes it lacks stay."""
    path = f"{shared_folder(spark)}/statsb.json"
    entries = table(spark, sf, "nation").select(F.struct(F.expr("CAST(5100 + n_nationkey AS STRING)").alias("code"), F.col("n_name").alias("label")).alias("e"))
    entries.agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value")).write.text(path)
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '5999' ELSE CAST(5100 + c_nationkey AS STRING) END AS STATSB", "CAST(80 + c_custkey % 8 AS STRING) AS REG"
    )
    return label_codes(rows, "bef", {"statsb": read_json_dictionary(spark, path)})


QUERIES = {
    "citizenship_labels": (
        citizenship_labels,
        "WITH labels_of_reg(code, label) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in REG.items()) + """),
        c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '5999' ELSE CAST(5100 + c_nationkey AS VARCHAR) END AS s, CAST(80 + c_custkey % 8 AS VARCHAR) AS r FROM customer)
        SELECT c_custkey, coalesce(n_name, s) AS STATSB, coalesce(label, r) AS REG
        FROM c LEFT JOIN nation ON s = CAST(5100 + n_nationkey AS VARCHAR) LEFT JOIN labels_of_reg l ON r = l.code""",
    ),
    "panel_profile": (
        panel_profile,
        with_registers("ind") + " UNION ALL ".join(_profile_row(c, n) for c, n in (("PNR", False), ("PERINDKIALT_13", True), ("BESKST13", True))),
    ),
    "parquet_scan": (
        parquet_scan,
        "SELECT o_orderkey, o_custkey, o_totalprice, NULL AS c_custkey, NULL AS c_name, NULL AS c_nationkey FROM orders "
        "UNION ALL SELECT NULL, NULL, NULL, c_custkey, c_name, c_nationkey FROM customer",
    ),
    "population_files": (
        population_files,
        with_registers("bef")
        + """SELECT PNR, FAR_ID, MOR_ID, CASE WHEN year % 3 = 2 THEN NULL ELSE FAMILIE_ID END AS FAMILIE_ID, FOED_DAG,
                    CAST(2001 + year % 3 AS INT) AS year, CASE year % 3 WHEN 0 THEN 12 WHEN 2 THEN 6 END AS month FROM bef""",
    ),
    "births_files": (
        births_files,
        with_registers("mfr")
        + """SELECT PNR, FAR_ID, MOR_ID, FOED_DAG, FAMILIE_ID, CASE WHEN CAST(PNR AS BIGINT) % 4 = 0 THEN 1999 ELSE 2000 END AS year,
                    CASE WHEN CAST(PNR AS BIGINT) % 4 <> 0 THEN 7 END AS month FROM mfr""",
    ),
    "register_years": (
        register_years,
        with_registers("bef") + "SELECT PNR, KOM, ANTPERSH, CASE WHEN year = 1996 THEN REG END AS REG, year, CAST(NULL AS INT) AS month FROM bef WHERE year IN (1996, 1997)",
    ),
}
