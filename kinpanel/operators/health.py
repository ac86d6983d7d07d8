"""Hospital contacts of two systems: integrate, harmonise, flag, summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinpanel.fixed_values import DIAGNOSIS_GROUPS, HEALTH_NAMES, UNKNOWN_DEPARTMENT
from kinpanel.functions.codes import any_scd, column_name, group_masks, in_group, normal_code, without_prefix
from kinpanel.functions.dates import parse_date
from kinpanel.operators.columns import rename_known, require
from kinpanel.operators.scale import HOT_ROWS, hot_keys, left_join, small

DIAGNOSES = ["primary_diagnosis", "diagnosis", "secondary_diagnosis"]
DATES = ["admission_date", "discharge_date", "outpatient_date"]


def _only_new(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Columns of ``df`` that ``other`` does not have already, and the key."""
    return df.select(*[c for c in df.columns if c == key or c not in other.columns])


def _with_dates(df: DataFrame) -> DataFrame:
    """Text dates parsed, once per contact rather than once per combination."""
    text = {f.name for f in df.schema.fields if HEALTH_NAMES.get(f.name) in DATES and f.dataType.simpleString() == "string"}
    return df.withColumns({c: parse_date(c) for c in sorted(text)}) if text else df


def integrate_v2(contacts: DataFrame, diagnoses: DataFrame, visits: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Contacts with their diagnoses and outpatient visits; every combination is a row."""
    key = "RECNUM"
    of_contacts = hot_keys(contacts, key, hot_rows, with_null=True)
    of_diagnoses = hot_keys(diagnoses, key, hot_rows)
    joined = left_join(
        contacts, _only_new(diagnoses, contacts, key), key, hot_rows=hot_rows, left_hot=of_contacts, right_hot=of_diagnoses
    )
    # A contact with very many diagnoses is heavy on the left of the next join.
    return left_join(
        joined, _only_new(visits, joined, key), key, hot_rows=hot_rows, left_hot=of_contacts + of_diagnoses
    ).withColumn("department_code", _department(contacts, "C_AFD"))


def integrate_v3(contacts: DataFrame, diagnoses: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    joined = left_join(contacts, _only_new(diagnoses, contacts, "DW_EK_KONTAKT"), "DW_EK_KONTAKT", hot_rows=hot_rows)
    return joined.withColumn("department_code", _department(contacts, "SORENHED_ANS"))


def _department(df: DataFrame, name: str):
    unknown = F.lit(UNKNOWN_DEPARTMENT)
    return F.coalesce(F.col(name), unknown) if name in df.columns else unknown


def harmonise(df: DataFrame, source: str) -> DataFrame:
    """Common column names, the source, and a department for every row."""
    out = rename_known(df, {"department_code": "department"})
    out = rename_known(out, HEALTH_NAMES).withColumn("source", F.lit(source))
    if "department" not in out.columns:
        return out.withColumn("department", F.lit(UNKNOWN_DEPARTMENT))
    return out.withColumn("department", F.coalesce("department", F.lit(UNKNOWN_DEPARTMENT)))


def combine_sources(v2: DataFrame, v3: DataFrame) -> DataFrame:
    """Rows of both systems with text columns, parsed dates, columns in name order."""
    names = sorted(set(v2.columns) | set(v3.columns))

    def shaped(df: DataFrame) -> DataFrame:
        columns = []
        for c in names:
            if c in DATES:
                columns.append((parse_date(c, df.schema[c].dataType) if c in df.columns else F.lit(None).cast("date")).alias(c))
            else:
                columns.append((F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c))
        return df.select(*columns)

    return shaped(v2).unionByName(shaped(v3))


def health_data(
    contacts_v2: DataFrame, diagnoses_v2: DataFrame, visits_v2: DataFrame, contacts_v3: DataFrame, diagnoses_v3: DataFrame,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """All hospital records of both systems under common names."""
    v2 = harmonise(integrate_v2(_with_dates(contacts_v2), diagnoses_v2, _with_dates(visits_v2), hot_rows), "LPR2")
    v3 = harmonise(integrate_v3(_with_dates(contacts_v3), diagnoses_v3, hot_rows), "LPR3")
    return combine_sources(v2, v3)


def flag_records(df: DataFrame, diagnosis_columns: list[str], date: str, mode: str = "category") -> DataFrame:
    """``is_scd`` per record and the date where it is true."""
    flag = any_scd(diagnosis_columns, mode)
    return df.withColumn("is_scd", flag).withColumn("first_scd_date", F.when(F.col("is_scd"), F.col(date)))


def flag_patients(
    df: DataFrame, diagnosis_columns: list[str], date: str, patient: str, mode: str = "category"
) -> DataFrame:
    """Per patient: any record with a severe chronic disease, and its first date."""
    require(df, [*diagnosis_columns, date, patient])
    records = flag_records(df.select(patient, date, *[c for c in diagnosis_columns if c != patient]), diagnosis_columns, date, mode)
    return records.groupBy(patient).agg(
        F.coalesce(F.bool_or("is_scd"), F.lit(False)).alias("is_scd"), F.min("first_scd_date").alias("first_scd_date")
    )


def scd_by_person(health: DataFrame, mode: str = "category") -> DataFrame:
    """Flags from harmonised health data, under the population's person key."""
    flags = flag_patients(health, DIAGNOSES, "admission_date", "patient_id", mode)
    return flags.select(F.col("patient_id").alias("PNR"), "is_scd", "first_scd_date")


def _flagged(
    contacts: DataFrame, diagnoses: DataFrame, key: str, patient: str, date: str, contact_codes: list[str], diagnosis_codes: list[str],
    mode: str, hot_rows: int | None,
) -> DataFrame:
    """``PNR, is_scd, __date`` of every contact. Only the keys of diagnoses that are severe chronic diseases are joined, each once."""
    keys = diagnoses.where(any_scd(diagnosis_codes, mode)).select(F.col(key)).distinct().withColumn("__flag", F.lit(True))
    joined = left_join(contacts.select(patient, key, date, *contact_codes), keys, key, hot_rows=hot_rows, right_hot=[])
    flag = F.coalesce("__flag", F.lit(False))
    if contact_codes:
        flag = flag | any_scd(contact_codes, mode)
    return joined.select(F.col(patient).alias("PNR"), flag.alias("is_scd"), F.col(date).alias("__date"))


def _by_person(contacts: DataFrame) -> DataFrame:
    first = F.min(F.when(F.col("is_scd"), F.col("__date")))
    return contacts.groupBy("PNR").agg(F.coalesce(F.bool_or("is_scd"), F.lit(False)).alias("is_scd"), first.alias("first_scd_date"))


def flag_contacts(
    contacts: DataFrame, diagnoses: DataFrame, key: str, patient: str, date: str, contact_codes: list[str], diagnosis_codes: list[str],
    mode: str = "category", hot_rows: int | None = None,
) -> DataFrame:
    """Patient flags straight from contacts and diagnoses, without the record-level join.

    Diagnoses are reduced to the keys of flagged contacts before they are joined, so the combinations of diagnoses and visits are
    never built. These keys are unique, so a heavy contact key only makes the contacts' side uneven, which the runtime splits by
    itself; no job looks for heavy keys unless ``hot_rows`` asks for it.
    """
    return _by_person(_flagged(contacts, diagnoses, key, patient, date, contact_codes, diagnosis_codes, mode, hot_rows))


def flags_of_both(contacts_v2: DataFrame, diagnoses_v2: DataFrame, contacts_v3: DataFrame, diagnoses_v3: DataFrame, mode: str = "category") -> DataFrame:
    """Flags per person over both hospital systems. Visits do not matter to them and are not read; building the plan starts no job."""
    parts = []
    for contacts, diagnoses in ((contacts_v2, diagnoses_v2), (contacts_v3, diagnoses_v3)):
        contacts, diagnoses = _renamed(_with_dates(contacts)), _renamed(diagnoses)
        own = [c for c in DIAGNOSES if c in contacts.columns]
        told = [c for c in DIAGNOSES if c in diagnoses.columns and c not in own]
        dated = contacts.withColumn("admission_date", parse_date("admission_date", contacts.schema["admission_date"].dataType))
        parts.append(_flagged(dated, diagnoses, "record_id", "patient_id", "admission_date", own, told, mode, None))
    return _by_person(parts[0].unionByName(parts[1]))


def add_flags(population: DataFrame, flags: DataFrame) -> DataFrame:
    """Every person of the population with the flag; people without hospital records are not flagged."""
    people = population.withColumn("PNR", F.col("PNR").cast("string"))
    marks = flags.withColumn("PNR", F.col("PNR").cast("string"))
    return people.join(marks, "PNR", "left").withColumn("is_scd", F.coalesce("is_scd", F.lit(False)))


def check_people_kept(before: DataFrame, after: DataFrame, before_id: str, after_id: str) -> None:
    """Raise when the number of distinct persons changed."""
    n = before.select(before_id).distinct().count()
    m = after.select(after_id).distinct().count()
    if n != m:
        raise ValueError(f"number of persons changed from {n} to {m}")


def check_same_people(before: dict[str, object], after: dict[str, object]) -> None:
    """Raise when two tables, of which ``row_marks`` of the person key were taken, do not have the same persons' rows."""
    if before != after:
        raise ValueError(f"persons changed: {before['n']} rows before, {after['n']} after" if before["n"] != after["n"] else "other persons than before")


def summary_measures() -> dict[str, Column]:
    """The numbers of ``scd_summary`` as measures of a table that is being written."""
    return {
        "total_patients": F.count(F.lit(1)),
        "scd_positive": F.count_if(F.col("is_scd")),
        "scd_negative": F.count_if(~F.col("is_scd")),
        "has_scd_date": F.count("first_scd_date"),
    }


def scd_summary(flags: DataFrame) -> DataFrame:
    """Persons in all, flagged, not flagged and with a date; one row."""
    return flags.agg(*[c.alias(n) for n, c in summary_measures().items()])


def prevalence_of(total: Column, cases: Column, one: DataFrame) -> DataFrame:
    """Population, cases and prevalence (%, two decimals) as metric and value, from the row of ``one`` that has both numbers."""
    share = F.when(total > 0, F.round(cases / F.greatest(total, F.lit(1)) * 100, 2)).otherwise(F.lit(0.0))
    row = one.select(total.cast("double").alias("Total Population"), cases.cast("double").alias("SCD Cases"), share.alias("Prevalence (%)"))
    return row.unpivot([], row.columns, "metric", "value")


def prevalence(flags: DataFrame) -> DataFrame:
    """Population, cases and prevalence (%, two decimals) as metric and value."""
    one = flags.agg(F.count("*").alias("n"), F.count_if(F.coalesce("is_scd", F.lit(False))).alias("cases"))
    return prevalence_of(F.col("n"), F.col("cases"), one)


def _one_row_per_record(health: DataFrame) -> DataFrame:
    columns = [*DIAGNOSES, "discharge_date", "admission_type", "department"]
    return health.groupBy("patient_id", "record_id", "admission_date").agg(*[F.max(c).alias(c) for c in columns])


def person_year_health(health: DataFrame, dedupe: bool = False) -> DataFrame:
    """Use of hospital care per person and year, from records.

    Each row is counted once for its admission type and once for its department.
    ``dedupe`` counts a contact once however many diagnoses and visits it has.
    From registers, ``person_year_care`` gives the same without building records.
    """
    rows = _one_row_per_record(health) if dedupe else health
    counts = {
        "num_primary_diagnoses": "primary_diagnosis",
        "num_diagnoses": "diagnosis",
        "num_secondary_diagnoses": "secondary_diagnosis",
        "num_admissions": "admission_date",
    }
    one = F.lit(1).cast("long")
    weighted = rows.select(
        F.col("patient_id").alias("PNR"), F.year("admission_date").alias("year"), "admission_type", "department", "discharge_date", one.alias("rows"),
        *[F.when(F.col(c).isNotNull(), one).otherwise(0).alias(name) for name, c in counts.items()],
    )
    return _person_years(weighted, list(counts))


def care_summary(
    contacts: DataFrame, diagnoses: DataFrame, visits: DataFrame | None, source: str, mode: str = "category", hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """One row per contact that stands for all its combinations of diagnoses and visits.

    Diagnoses and visits are counted per contact before they are joined, so their product is never built: ``rows`` is the number
    of combinations, ``count_*`` and ``max_*`` describe each code column over them, ``groups`` holds the combinations in each
    diagnosis group, ``is_scd`` whether any code is a severe chronic disease.
    """
    contacts = _renamed(_with_dates(contacts))
    diagnoses = _renamed(diagnoses)
    key = "record_id"
    own = [c for c in DIAGNOSES if c in contacts.columns]
    told = [c for c in DIAGNOSES if c in diagnoses.columns and c not in own]
    of_contact = _with_groups(contacts, own, mode)
    groups = range(len(DIAGNOSIS_GROUPS))
    per_contact = _with_groups(diagnoses.select(key, *told), told, mode).groupBy(key).agg(
        F.count("*").alias("__n"),
        *[F.count(c).alias(f"__n_{c}") for c in told],
        *[F.max(c).alias(f"__m_{c}") for c in told],
        F.coalesce(F.bool_or(any_scd(told, mode)), F.lit(False)).alias("__scd") if told else F.lit(False).alias("__scd"),
        F.array(*[F.count_if(F.col("__mask").bitwiseAND(1 << i) != 0) for i in groups]).alias("__hits"),
    )
    of_contacts = hot_keys(contacts, key, hot_rows, with_null=True)
    joined = left_join(of_contact, per_contact, key, hot_rows=hot_rows, left_hot=of_contacts, right_hot=[])
    if visits is not None:
        seen = _renamed(visits).groupBy(key).agg(F.count("*").alias("__m"))
        joined = left_join(joined, seen, key, hot_rows=hot_rows, left_hot=of_contacts, right_hot=[])
    n = F.greatest(F.coalesce("__n", F.lit(0)), F.lit(1))
    m = F.greatest(F.coalesce("__m", F.lit(0)), F.lit(1)) if visits is not None else F.lit(1)
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("string")
    measures = {"rows": n * m}
    for c in DIAGNOSES:
        if c in own:
            measures[f"count_{c}"] = F.when(F.col(c).isNotNull(), n * m).otherwise(zero)
            measures[f"max_{c}"] = F.col(c).cast("string")
        else:
            measures[f"count_{c}"] = F.coalesce(F.col(f"__n_{c}") * m, zero) if c in told else zero
            measures[f"max_{c}"] = F.col(f"__m_{c}").cast("string") if c in told else none
    scd = F.coalesce("__scd", F.lit(False))
    measures["is_scd"] = scd | any_scd(own, mode) if own else scd
    hits = [
        F.when(F.col("__mask").bitwiseAND(1 << i) != 0, n * m).otherwise(F.coalesce(F.col("__hits")[i] * m, zero)) for i in groups
    ]
    measures["groups"] = F.array(*hits)
    plain = [F.col(c) if c in contacts.columns else none.alias(c) for c in ("patient_id", key, "admission_type")]
    dates = [parse_date(c, joined.schema[c].dataType).alias(c) if c in contacts.columns else F.lit(None).cast("date").alias(c) for c in DATES[:2]]
    unknown = F.lit(UNKNOWN_DEPARTMENT)
    department = next((F.coalesce(F.col(c), unknown) for c in ("department", "department_code", "hospital_code") if c in contacts.columns and (c != "hospital_code" or source == "LPR3")), unknown)
    return joined.select(*plain, *dates, department.alias("department"), F.lit(source).alias("source"), *[v.alias(k) for k, v in measures.items()])


def _renamed(df: DataFrame) -> DataFrame:
    return rename_known(df, HEALTH_NAMES)


def _with_groups(df: DataFrame, columns: list[str], mode: str) -> DataFrame:
    """``__mask``: one bit per diagnosis group that any of the code columns belongs to."""
    if mode == "literal":
        bits = [F.when(in_group(columns, g, mode), F.lit(1 << i)).otherwise(F.lit(0)) for i, g in enumerate(DIAGNOSIS_GROUPS)] if columns else []
        return df.withColumn("__mask", sum(bits[1:], bits[0]) if bits else F.lit(0))
    out, mask = df, F.lit(0)
    for i, c in enumerate(columns):
        # A row per category of the fixed groups, a few hundred.
        side = F.broadcast(df.sparkSession.createDataFrame(group_masks(), f"__cat{i} string, __bits{i} int"))
        out = out.join(side, F.substring(normal_code(c), 2, 3) == F.col(f"__cat{i}"), "left").drop(f"__cat{i}")
        mask = mask.bitwiseOR(F.coalesce(F.col(f"__bits{i}"), F.lit(0)))
    return out.withColumn("__mask", mask).drop(*[f"__bits{i}" for i in range(len(columns))])


def care_of_both(
    contacts_v2: DataFrame, diagnoses_v2: DataFrame, visits_v2: DataFrame, contacts_v3: DataFrame, diagnoses_v3: DataFrame,
    mode: str = "category", hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Summaries of the contacts of both systems."""
    v2 = care_summary(contacts_v2, diagnoses_v2, visits_v2, "LPR2", mode, hot_rows)
    v3 = care_summary(contacts_v3, diagnoses_v3, None, "LPR3", mode, hot_rows)
    return v2.unionByName(v3)


def care_flags(care: DataFrame) -> DataFrame:
    """Flags per person from contact summaries, under the population's person key."""
    first = F.min(F.when(F.col("is_scd"), F.col("admission_date")))
    return care.groupBy(F.col("patient_id").alias("PNR")).agg(F.coalesce(F.bool_or("is_scd"), F.lit(False)).alias("is_scd"), first.alias("first_scd_date"))


def person_year_care(care: DataFrame, dedupe: bool = False) -> DataFrame:
    """``person_year_health`` from contact summaries: the same numbers without the combinations."""
    if dedupe:
        codes = [f"max_{c}" for c in DIAGNOSES]
        rows = care.groupBy("patient_id", "record_id", "admission_date").agg(*[F.max(c).alias(c) for c in (*codes, "discharge_date", "admission_type", "department")])
        one = F.lit(1).cast("long")
        rows = rows.withColumns({"rows": one, **{f"count_{c}": F.when(F.col(f"max_{c}").isNotNull(), one).otherwise(0) for c in DIAGNOSES}})
    else:
        rows = care
    counts = {
        "num_primary_diagnoses": F.col("count_primary_diagnosis"),
        "num_diagnoses": F.col("count_diagnosis"),
        "num_secondary_diagnoses": F.col("count_secondary_diagnosis"),
        "num_admissions": F.when(F.col("admission_date").isNotNull(), F.col("rows")).otherwise(0),
    }
    weighted = rows.select(
        F.col("patient_id").alias("PNR"), F.year("admission_date").alias("year"), "admission_type", "department", "discharge_date", "rows", *[v.alias(k) for k, v in counts.items()]
    )
    return _person_years(weighted, list(counts))


def _person_years(weighted: DataFrame, counts: list[str]) -> DataFrame:
    """Counts folded per person, year and value, then per person and year: no window, and a person with very many
    records is spread by value. The commonest admission type is the smallest among equals."""
    kinds = F.explode(
        F.array(
            F.struct(F.lit("type").alias("kind"), F.col("admission_type").alias("v")),
            F.struct(F.lit("dept").alias("kind"), F.col("department").alias("v")),
        )
    )
    is_type = F.col("kind") == "type"
    per_value = (
        weighted.select("PNR", "year", *counts, "rows", "discharge_date", kinds.alias("k"))
        .select("*", "k.kind", "k.v")
        .groupBy("PNR", "year", "kind", "v")
        .agg(F.sum("rows").alias("n"), *[F.sum(c).alias(c) for c in counts], F.max("discharge_date").alias("last_discharge"))
    )
    mode = F.min(F.when(is_type & F.col("v").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("v").alias("v"))))
    return (
        per_value.groupBy("PNR", "year")
        .agg(
            *[F.sum(F.when(is_type, F.col(name)).otherwise(0)).alias(name) for name in counts],
            F.max("last_discharge").alias("last_discharge"),
            mode.alias("__mode"),
            F.count(F.when(~is_type, F.col("v"))).alias("num_unique_departments"),
        )
        .select("PNR", "year", *counts, "last_discharge", F.col("__mode.v").alias("most_common_admission_type"), "num_unique_departments")
    )


def care_groups(care: DataFrame) -> DataFrame:
    """``diagnosis_groups`` from contact summaries."""
    measures = []
    for i, g in enumerate(DIAGNOSIS_GROUPS):
        n = F.col("groups")[i]
        measures.append(F.sum(n).alias(f"num_{column_name(g)}_diagnoses"))
        measures.append(F.coalesce(F.sum(F.when(F.col("admission_date").isNotNull(), n)), F.lit(0)).alias(f"num_{column_name(g)}_admissions"))
    return care.groupBy(F.col("patient_id").alias("PNR"), F.year("admission_date").alias("year")).agg(*measures)


def diagnosis_groups(health: DataFrame, mode: str = "category") -> DataFrame:
    """Records and dated records per diagnosis group, person and year; zero where there are none."""
    names = {g: column_name(g) for g in DIAGNOSIS_GROUPS}
    flags = health.select(
        F.col("patient_id").alias("PNR"),
        F.year("admission_date").alias("year"),
        F.col("admission_date").isNotNull().alias("__dated"),
        *[in_group(DIAGNOSES, g, mode).alias(n) for g, n in names.items()],
    )
    measures = []
    for n in names.values():
        measures.append(F.count_if(F.col(n)).alias(f"num_{n}_diagnoses"))
        measures.append(F.count_if(F.col(n) & F.col("__dated")).alias(f"num_{n}_admissions"))
    return flags.groupBy("PNR", "year").agg(*measures)


def add_code_text(df: DataFrame, dictionary: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """ICD text for code columns, looked up without the leading letter.

    ``columns`` maps a code column to the name of its text column.
    """
    columns = columns or {"C_ADIAG": "description", "C_DIAG": "description_diag"}
    texts = small(dictionary.select("icd10", "description"))
    out = df
    for i, (code, name) in enumerate(columns.items()):
        side = texts.select(F.col("icd10").alias(f"__code{i}"), F.col("description").alias(name))
        out = out.join(side, without_prefix(code) == F.col(f"__code{i}"), "left").drop(f"__code{i}")
    return out
