"""Fixed values.

Everything in this module is given from outside: register layouts, code lists,
labels, date formats and column names.  Results are only right when these equal
the published registers, so they are written here plainly and in one place.
"""

from __future__ import annotations

# -- Fixed values: register layouts (column -> Spark SQL type) -----------------

BEF = {
    "AEGTE_ID": "string",
    "ALDER": "tinyint",
    "ANTBOERNF": "tinyint",
    "ANTBOERNH": "tinyint",
    "ANTPERSF": "tinyint",
    "ANTPERSH": "tinyint",
    "BOP_VFRA": "date",
    "CIVST": "string",
    "CPRTJEK": "tinyint",
    "CPRTYPE": "tinyint",
    "E_FAELLE_ID": "string",
    "FAMILIE_ID": "string",
    "FAMILIE_TYPE": "string",
    "FAR_ID": "string",
    "FM_MARK": "string",
    "FOED_DAG": "date",
    "HUSTYPE": "string",
    "IE_TYPE": "string",
    "KOEN": "string",
    "KOM": "smallint",
    "MOR_ID": "string",
    "OPR_LAND": "string",
    "PLADS": "string",
    "PNR": "string",
    "REG": "string",
    "STATSB": "string",
    "VERSION": "string",
}

BEF_REQUIRED = ["PNR", "FOED_DAG", "FAR_ID", "MOR_ID", "FAMILIE_ID", "KOM"]

BEF_FAMILY = ["PNR", "FAR_ID", "MOR_ID", "FAMILIE_ID", "FOED_DAG"]

MFR = {
    "CPR_BARN": "string",
    "CPR_FADER": "string",
    "CPR_MODER": "string",
    "FOEDSELSDATO": "string",
}

AKM = {
    "PNR": "string",
    "SOCIO": "tinyint",
    "SOCIO02": "tinyint",
    "SOCIO13": "string",
    "CPRTJEK": "string",
    "CPRTYPE": "string",
    "VERSION": "string",
    "SENR": "string",
}

IND = {
    "BESKST13": "tinyint",
    "CPRTJEK": "string",
    "CPRTYPE": "string",
    "LOENMV_13": "double",
    "PERINDKIALT_13": "double",
    "PNR": "string",
    "PRE_SOCIO": "tinyint",
    "VERSION": "string",
}

IDAN = {
    "ARBGNR": "string",
    "ARBNR": "string",
    "CPRTJEK": "string",
    "CPRTYPE": "string",
    "CVRNR": "string",
    "JOBKAT": "tinyint",
    "JOBLON": "double",
    "LBNR": "string",
    "PNR": "string",
    "STILL": "string",
    "TILKNYT": "tinyint",
}

UDDF = {
    "PNR": "string",
    "CPRTJEK": "string",
    "CPRTYPE": "string",
    "HFAUDD": "string",
    "HF_KILDE": "string",
    "HF_VFRA": "string",
    "HF_VTIL": "string",
    "INSTNR": "tinyint",
    "VERSION": "string",
}

LPR_ADM = {
    "PNR": "string",
    "C_ADIAG": "string",
    "C_AFD": "string",
    "C_HAFD": "string",
    "C_HENM": "string",
    "C_HSGH": "string",
    "C_INDM": "string",
    "C_KOM": "string",
    "C_KONTAARS": "string",
    "C_PATTYPE": "string",
    "C_SGH": "string",
    "C_SPEC": "string",
    "C_UDM": "string",
    "CPRTJEK": "string",
    "CPRTYPE": "string",
    "D_HENDTO": "date",
    "D_INDDTO": "date",
    "D_UDDTO": "date",
    "K_AFD": "string",
    "RECNUM": "string",
    "V_ALDDG": "int",
    "V_ALDER": "int",
    "V_INDMINUT": "int",
    "V_INDTIME": "int",
    "V_SENGDAGE": "int",
    "V_UDTIME": "int",
    "VERSION": "string",
}

LPR_BES = {
    "D_AMBDTO": "date",
    "LEVERANCEDATO": "date",
    "RECNUM": "string",
    "VERSION": "string",
}

LPR_DIAG = {
    "C_DIAG": "string",
    "C_DIAGTYPE": "string",
    "C_TILDIAG": "string",
    "LEVERANCEDATO": "date",
    "RECNUM": "string",
    "VERSION": "string",
}

LPR3_DIAGNOSER = {
    "DW_EK_KONTAKT": "string",
    "diagnosekode": "string",
    "diagnosetype": "string",
    "senere_afkraeftet": "string",
    "diagnosekode_parent": "string",
    "diagnosetype_parent": "string",
    "lprindberetningssystem": "string",
}

LPR3_KONTAKTER = {
    "SORENHED_IND": "string",
    "SORENHED_HEN": "string",
    "SORENHED_ANS": "string",
    "DW_EK_KONTAKT": "string",
    "DW_EK_FORLOEB": "string",
    "CPR": "string",
    "dato_start": "string",
    "tidspunkt_start": "string",
    "dato_slut": "string",
    "tidspunkt_slut": "string",
    "aktionsdiagnose": "string",
    "kontaktaarsag": "string",
    "prioritet": "string",
    "kontakttype": "string",
    "henvisningsaarsag": "string",
    "henvisningsmaade": "string",
    "dato_behandling_start": "string",
    "tidspunkt_behandling_start": "string",
    "dato_indberetning": "string",
    "lprindberetningssytem": "string",
}

REGISTERS = {
    "bef": BEF,
    "akm": AKM,
    "ind": IND,
    "idan": IDAN,
    "uddf": UDDF,
    "lpr_adm": LPR_ADM,
    "lpr_bes": LPR_BES,
    "lpr_diag": LPR_DIAG,
    "lpr3_diagnoser": LPR3_DIAGNOSER,
    "lpr3_kontakter": LPR3_KONTAKTER,
    "mfr": MFR,
}

# Columns the yearly panels leave out, by register.
PANEL_DROPS = {
    "bef": ["VERSION", "CPRTYPE", "CPRTJEK"],
    "akm": ["SOCIO", "SOCIO02", "CPRTJEK", "CPRTYPE", "VERSION"],
    "ind": ["CPRTJEK", "CPRTYPE", "VERSION"],
    "uddf": ["CPRTJEK", "CPRTYPE", "VERSION"],
}

# -- Fixed values: type names accepted in a register layout --------------------

TYPE_NAMES = {
    "int8": "tinyint",
    "int16": "smallint",
    "int32": "int",
    "int64": "bigint",
    "float32": "float",
    "float64": "double",
    "string": "string",
    "bool": "boolean",
    "date": "date",
    "datetime": "timestamp",
    "category": "string",
}

# -- Fixed values: study settings ---------------------------------------------

FIRST_BIRTH_YEAR = 1995
LAST_BIRTH_YEAR = 2020
STUDY_YEARS = [2005, 2010, 2015, 2020]

# -- Fixed values: date formats, tried in this order ---------------------------

# Each with the shape of the text it can read.
DATE_FORMATS = [
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyy/M/d HH:mm:ss", r"^\d{4}/\d{1,2}/\d{1,2} \d{2}:\d{2}:\d{2}$"),
    ("M/d/yy", r"^\d{1,2}/\d{1,2}/\d{2}$"),
    ("dMMMyyyy", r"^\d{1,2}[A-Za-z]{3}\d{4}$"),
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("yyyy-M-d HH:mm:ss", r"^\d{4}-\d{1,2}-\d{1,2} \d{2}:\d{2}:\d{2}$"),
]
# Tried last, after the weekday is cut off: "Mon May 15 01:02:03 2023".
LOCALE_DATE_FORMAT = ("MMM d HH:mm:ss yyyy", r"^[A-Za-z]{3} +\d{1,2} \d{2}:\d{2}:\d{2} +\d{4}$")
# Two-digit years from this one on belong to the 1900s.
TWO_DIGIT_YEAR_PIVOT = 70

# -- Fixed values: ICD-10 categories of severe chronic disease -----------------

SCD_CATEGORIES = [
    "D55", "D56", "D57", "D58", "D60", "D61", "D64", "D66", "D67", "D68", "D69", "D70", "D71", "D72", "D73", "D76",
    "D80", "D81", "D82", "D83", "D84", "D86", "D89",
    "E22", "E23", "E24", "E25", "E26", "E27", "E31", "E34", "E70", "E71", "E72", "E73", "E74", "E75", "E76", "E77",
    "E78", "E79", "E80", "E83", "E84", "E85", "E88",
    "F84",
    "G11", "G12", "G13", "G23", "G24", "G25", "G31", "G32", "G36", "G37", "G40", "G41", "G60", "G70", "G71", "G72",
    "G73", "G80", "G81", "G82", "G83", "G90", "G91", "G93",
    "I27", "I42", "I43", "I50", "I61", "I63", "I69", "I70", "I71", "I72", "I73", "I74", "I77", "I78", "I79",
    "J41", "J42", "J43", "J44", "J45", "J47", "J60", "J61", "J62", "J63", "J64", "J65", "J66", "J67", "J68", "J69",
    "J70", "J84", "J98",
    "K50", "K51", "K73", "K74", "K86", "K87", "K90",
    "M05", "M06", "M07", "M08", "M09", "M30", "M31", "M32", "M33", "M34", "M35", "M40", "M41", "M42", "M43", "M45",
    "M46",
    "N01", "N03", "N04", "N07", "N08", "N11", "N12", "N13", "N14", "N15", "N16", "N18", "N19", "N20", "N21", "N22",
    "N23", "N25", "N26", "N27", "N28", "N29",
    "P27",
    "Q01", "Q02", "Q03", "Q04", "Q05", "Q06", "Q07", "Q20", "Q21", "Q22", "Q23", "Q24", "Q25", "Q26", "Q27", "Q28",
    "Q30", "Q31", "Q32", "Q33", "Q34", "Q35", "Q36", "Q37", "Q38", "Q39", "Q40", "Q41", "Q42", "Q43", "Q44", "Q45",
    "Q60", "Q61", "Q62", "Q63", "Q64", "Q65", "Q66", "Q67", "Q68", "Q69", "Q70", "Q71", "Q72", "Q73", "Q74", "Q75",
    "Q76", "Q77", "Q78", "Q79", "Q80", "Q81", "Q82", "Q83", "Q84", "Q85", "Q86", "Q87", "Q89", "Q90", "Q91", "Q92",
    "Q93", "Q95", "Q96", "Q97", "Q98", "Q99",
]
SCD_CATEGORY_RANGE = ("E74", "E84")
SCD_SUBCATEGORY_RANGE = ("P941", "P949")

# -- Fixed values: diagnosis groups -------------------------------------------

DIAGNOSIS_GROUPS = {
    "Blood Disorders": ["D55-D61", "D64-D73", "D76"],
    "Immune System": ["D80-D84", "D86", "D89"],
    "Endocrine": ["E22-E27", "E31", "E34", "E70-E85", "E88"],
    "Neurological": ["F84", "G11-G13", "G23-G25", "G31-G32", "G36-G41", "G60-G73", "G80-G83", "G90-G91", "G93"],
    "Cardiovascular": ["I27", "I42-I43", "I50", "I61", "I63", "I69-I74", "I77-I79"],
    "Respiratory": ["J41-J45", "J47", "J60-J70", "J84", "J98"],
    "Gastrointestinal": ["K50-K51", "K73-K74", "K86-K87", "K90"],
    "Musculoskeletal": ["M05-M09", "M30-M35", "M40-M43", "M45-M46"],
    "Renal": ["N01-N08", "N11-N16", "N18-N29"],
    "Congenital": ["P27", "Q01-Q07", "Q20-Q28", "Q30-Q45", "Q60-Q99"],
}

# -- Fixed values: common names for the two hospital systems -------------------

HEALTH_NAMES = {
    "PNR": "patient_id",
    "CPR": "patient_id",
    "C_ADIAG": "primary_diagnosis",
    "aktionsdiagnose": "primary_diagnosis",
    "C_DIAG": "diagnosis",
    "diagnosekode": "diagnosis",
    "C_TILDIAG": "secondary_diagnosis",
    "D_INDDTO": "admission_date",
    "dato_start": "admission_date",
    "D_UDDTO": "discharge_date",
    "dato_slut": "discharge_date",
    "D_AMBDTO": "outpatient_date",
    "C_SGH": "hospital_code",
    "SORENHED_ANS": "hospital_code",
    "C_AFD": "department_code",
    "C_PATTYPE": "patient_type",
    "kontakttype": "patient_type",
    "RECNUM": "record_id",
    "DW_EK_KONTAKT": "record_id",
    "C_INDM": "admission_type",
    "prioritet": "admission_type",
    "C_UDM": "discharge_type",
    "C_SPEC": "specialty_code",
    "V_SENGDAGE": "bed_days",
    "diagnosetype": "diagnosis_type",
    "senere_afkraeftet": "diagnosis_later_disproved",
    "kontaktaarsag": "contact_reason",
    "henvisningsaarsag": "referral_reason",
    "henvisningsmaade": "referral_method",
}
UNKNOWN_DEPARTMENT = "Unknown"

# -- Fixed values: names used by the domain statistics ------------------------

DOMAIN_NAMES = {
    "ANTPERSH": "household_size",
    "KOM": "municipality",
    "REG": "region",
    "EDU_LVL": "education_level",
    "PERINDKIALT_13": "annual_income",
    "SOCIO13": "employment_status",
    "KOEN": "sex",
}

DOMAIN_SOURCES = {
    "demographics": "bef",
    "education": "uddf",
    "income": "ind",
    "employment": "akm",
}

DOMAIN_DESCRIPTIONS = {
    "demographics": "Basic demographic information",
    "education": "Educational history and achievements",
    "income": "Income and financial data",
    "employment": "Employment history and status",
    "health": "Healthcare utilization and diagnosis data",
}

ZONE_DESCRIPTIONS = {
    "static": "Non-temporal individual attributes",
    "longitudinal": "Temporal data by domain",
    "family": "Family relationships and structures",
    "derived": "Aggregated and computed features",
}

DOMAIN_STATISTICS = {
    "demographics": {"numeric": ["household_size"], "categorical": ["municipality", "region"]},
    "education": {"numeric": ["education_level"], "categorical": ["education_field"]},
    "income": {"numeric": ["annual_income", "disposable_income"], "categorical": []},
    "employment": {"numeric": [], "categorical": ["employment_status", "sector"]},
}

# -- Fixed values: code labels ------------------------------------------------

BESKST13 = {
    "1": "Selvstændig",
    "2": "Medarbejdende ægtefælle",
    "3": "Lønmodtager og ejer af virksomhed",
    "4": "Lønmodtager",
    "5": "Lønmodtager med understøttelse",
    "6": "Pensionist og ejer af virksomhed",
    "7": "Pensionist",
    "8": "Øvrige",
    "9": "Efterlønsmodtager",
    "10": "Arbejdsløs mindst halvdelen af året (nettoledighed)",
    "11": "Modtager af dagpenge (aktivering og lign.,sygdom, barsel og orlov)",
    "12": "Kontanthjælpsmodtager",
    "99": "Ikke I AKM",
}

CIVST = {
    "D": "Død",
    "E": "Enke/Enkemand",
    "F": "Skilt",
    "G": "Gift (+ separeret)",
    "L": "Længstlevende af 2 partnere",
    "O": "Ophævet partnerskab",
    "P": "Registreret partnerskab",
    "U": "Ugift",
    "9": "Uoplyst civilstand",
}

FM_MARK = {
    "1": "Bor sammen med begge forældrene",
    "2": "For børn: Bor hos mor, der er i nyt par. For voksne: Bor sammen med mor.",
    "3": "For børn: Bor hos enlig mor. For voksneVværdien findes ikke.",
    "4": "For børn: Bor hos far, der er i nyt par. For voksne: Bor sammen med far.",
    "5": "For børn: Bor hos enlig far. For voksne: Værdien findes ikke.",
    "6": "Bor ikke hos forældrene",
}

HUSTYPE = {
    "1": "En enlig mand",
    "2": "En enlig kvinde",
    "3": "Et ægtepar",
    "4": "Et par i øvrigt",
    "5": "Et ikke-hjemmeboende barn under 18 år",
    "6": "Husstand bestående af flere familier",
}

JOBKAT = {
    "1": "Fuld tid (30 timer eller mere pr. uge)",
    "2": "Deltid (15-29 timer)",
    "3": "Bijob (under 15 timer)",
    "5": "Fuld tid (Over 8 uger med delvis ledighed i løbet af året)",
    "6": "Deltid (Over 8 uger med delvis ledighed i løbet af året)",
    "7": "Bijob (Over 8 uger med delvis ledighed i løbet af året)",
    "9": "Uoplyst",
}

PLADS = {
    "1": "Hovedperson",
    "2": "Ægtefælle/partner",
    "3": "Hjemmeboende barn",
}

PRE_SOCIO = {
    "0": "Ikke i AKM",
    "110": "Selvstændige",
    "111": "Selvstændig, 10 eller flere ansatte",
    "112": "Selvstændig, 5 - 9 ansatte",
    "113": "Selvstændig, 1 - 4 ansatte",
    "114": "Selvstændig, ingen ansatte",
    "120": "Medarbejdende ægtefælle",
    "130": "Lønmodtager",
    "210": "Arbejdsløs mindst halvdelen af året",
    "220": "Modtager af sygedagpenge, uddannelsesgodtgørelse, orlovsydelser mm.",
    "310": "Under uddannelse, inkl.skoleelever min. 15 år",
    "321": "Førtidspensionister",
    "322": "Folkepensionister",
    "323": "Efterlønsmodtager mv.",
    "330": "Kontanthjælpsmodtager",
    "410": "Andre",
    "420": "Børn under 15 år ultimo året",
}

REG = {
    "0": "Uoplyst",
    "81": "Nordjylland",
    "82": "Midtjylland",
    "83": "Syddanmark",
    "84": "Hovedstaden",
    "85": "Sjælland",
}

SOCIO13 = {
    "0": "Ikke i AKM",
    "110": "Selvstændig",
    "111": "Selvstændig, 10 eller flere ansatte",
    "112": "Selvstændig, 5 - 9 ansatte",
    "113": "Selvstændig, 1 - 4 ansatte",
    "114": "Selvstændig, ingen ansatte",
    "120": "Medarbejdende ægtefælle",
    "131": "Lønmodtager med ledelsesarbejde",
    "132": "Lønmodtager i arbejde der forudsætter færdigheder på højeste niveau",
    "133": "Lønmodtager i arbejde der forudsætter færdigheder på mellemniveau",
    "134": "Lønmodtager i arbejde der forudsætter færdigheder på grundniveau",
    "135": "Andre lønmodtagere",
    "139": "Lønmodtager, stillingsangivelse ikke oplyst",
    "210": "Arbejdsløs mindst halvdelen af året",
    "220": "Modtager af sygedagpenge, uddannelsesgodtgørelse, orlovsydelser mm.",
    "310": "Under uddannelse, inkl.skoleelever min. 15 år",
    "321": "Førtidspensionister",
    "322": "Folkepensionister",
    "323": "Efterlønsmodtager mv.",
    "330": "Kontanthjælpsmodtager",
    "410": "Andre",
    "420": "Børn under 15 år ultimo året",
}

TILKNYT = {
    "1": "Heltid, kontinuert, længere end et år",
    "2": "Deltid (>= 30 timer), kontinuert, længere end et år",
    "3": "Deltid (>= 20-29 timer), kontinuert, længere end et år",
    "4": "Deltid (>= 10-19 timer), kontinuert, længere end et år",
    "5": "Deltid (< 10 timer), kontinuert, længere end et år",
    "11": "Heltid, serielt, længere end et år",
    "12": "Deltid (>= 30 timer), serielt, længere end et år",
    "13": "Deltid (>= 20-29 timer), serielt, længere end et år",
    "14": "Deltid (>= 10-19 timer), serielt, længere end et år",
    "15": "Deltid (< 10 timer), serielt, længere end et år",
    "21": "Heltid, kontinuert, kortere end et år",
    "22": "Deltid (>= 30 timer), kontinuert, kortere end et år",
    "23": "Deltid (>= 20-29 timer), kontinuert, kortere end et år",
    "24": "Deltid (>= 10-19 timer), kontinuert, kortere end et år",
    "25": "Deltid (< 10 timer), kontinuert, kortere end et år",
    "31": "Heltid, serielt, kortere end et år",
    "32": "Deltid (>= 30 timer), serielt, kortere end et år",
    "33": "Deltid (>= 20-29 timer), serielt, kortere end et år",
    "34": "Deltid (>= 10-19 timer), serielt, kortere end et år",
    "35": "Deltid (< 10 timer), serielt, kortere end et år",
}

# Citizenship (STATSB) and education (HFAUDD) have long dictionaries of their
# own; they are read from a file, see ``sources.dictionaries``.
LABELS = {
    "beskst13": BESKST13,
    "civst": CIVST,
    "fm_mark": FM_MARK,
    "hustype": HUSTYPE,
    "jobkat": JOBKAT,
    "plads": PLADS,
    "pre_socio": PRE_SOCIO,
    "reg": REG,
    "socio13": SOCIO13,
    "tilknyt": TILKNYT,
}

# Columns that carry a label dictionary, by register.
LABELLED_COLUMNS = {
    "bef": ["FM_MARK", "CIVST", "HUSTYPE", "PLADS", "REG", "STATSB"],
    "akm": ["SOCIO13"],
    "idan": ["JOBKAT", "TILKNYT"],
}

# -- Fixed values: sections and variables of the baseline table ----------------
# (section, variable, ...); yearly ones are told for each study year.

BASELINE_INCLUSION_AGE = ("Child Characteristics", "Age at inclusion (years)")
BASELINE_AGES = [
    ("Maternal Characteristics", "Mother's age at child birth", "MOR_FDAG"),
    ("Paternal Characteristics", "Father's age at child birth", "FAR_FDAG"),
]
BASELINE_NUMBERS = [
    ("Maternal Characteristics", "Mother's income (DKK)", True, "MOR_PERINDKIALT_13", 0),
    ("Paternal Characteristics", "Father's income (DKK)", True, "FAR_PERINDKIALT_13", 0),
    ("Family Characteristics", "Number of persons in household", False, "ANTPERSH", 1),
    ("Family Characteristics", "Number of children in family", False, "ANTBOERNF", 1),
]
BASELINE_CATEGORIES = [
    ("Child Characteristics", "Sex", False, "KOEN"),
    ("Maternal Characteristics", "Mother's education", True, "MOR_EDU_LVL"),
    ("Maternal Characteristics", "Mother's employment status", True, "MOR_BESKST13"),
    ("Paternal Characteristics", "Father's education", True, "FAR_EDU_LVL"),
    ("Paternal Characteristics", "Father's employment status", True, "FAR_BESKST13"),
    ("Family Characteristics", "Family type", False, "FAMILIE_TYPE"),
]
