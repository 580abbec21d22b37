"""Smaller files cut out of a survey: one country, a teaching sample, a model sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wavebook.operators import codebook, columns
from wavebook.operators.columns import Span
from wavebook.operators.predicates import all_of, drop_missing, matching
from wavebook.operators.recode import plant_missing, to_number

# Columns kept of the European Social Survey.
ESS_COLUMNS = [
    "stflife", "rlgblg", "rlgdgr", "rlgatnd", "pray", "euftf", "imsmetn", "imdfetn", "impcntr",
    "imueclt", "imwbcnt", "netusoft", "netustm", "trstplc", "crmvct", "lrscale", "health", "inprdsc",
    "atchctr", "atcherp", "dscrgrp", "wrclmch", "gndr", "agea", "maritalb", "chldhhe", "domicil",
    "eduyrs", "tporgwk", "hinctnta", "hincfel", "country", "country_iso2", "country_iso3",
]

# Columns kept of the Euromodule survey, in file order where a span is given.
EUROMODULE_COLUMNS = [
    "COUNTRY", "YEAR", "V7", "V8", "V33", "V55A", "V55D", "V55E", "V23", "V28", "V40", "V56", "V57",
    Span("V31A", "V31E"), Span("V21A", "V21U"), "V24", "V24_PPP", "V26", "V27", "V22", "V36", "V46",
    Span("V12A", "V12J"), "V13", "V14", "V15", "V55B", Span("V11_A", "V11_TR"), "V50", "V49",
    Span("V51A", "V51D"), Span("V17A", "V17J"), "V52", "V61", Span("V58A", "V58M"),
]

# The teaching sample and its questionnaire codes.
SAMPLE_IDS = [
    50378, 60555, 92713, 92730, 55709, 51138, 57305, 71215, 80670, 72206, 89194, 91883, 67396, 87715,
    84528,
]
SAMPLE_CODES = {
    "A1": "nwspol", "A2": "netusoft", "A3": "netustm", "A4": "ppltrst", "A5": "pplfair",
    "A6": "pplhlp", "B1": "polintr", "B26": "lrscale", "C7": "health", "C12": "rlgdnm",
    "C16": "rlgatnd", "C32": "wrclmch",
}
SCALES_FROM_ZERO = ["ppltrst", "pplfair", "pplhlp", "lrscale"]
SAMPLE_MISSING = {
    "A3": [(71215, 7777.0), (80670, 8888.0)], "A5": [(80670, 88.0)], "A6": [(72206, 77.0)],
    "C12": [(80670, 77.0)],
}

# The model sample.
MODEL_COLUMNS = [
    "trustindex3", "reform1_7", "reform_id_num", "female", "agea", "fbrneur", "mbrneur", "fnotbrneur",
    "mnotbrneur", "blgetmg_d", "yrbrn", "essround",
]
MODEL_FIRST = ["cntry", "dweight", "ppltrst", "pplfair", "pplhlp", "eduyrs25", "paredu_a_high"]
NO_YES = {0: "No", 1: "Yes"}
MODEL_VALUES = {
    "female": {0: "Male", 1: "Female"}, "blgetmg_d": NO_YES, "fbrneur": NO_YES, "mbrneur": NO_YES,
    "fnotbrneur": NO_YES, "mnotbrneur": NO_YES, "paredu_a_high": NO_YES,
}
MODEL_LABELS = {
    "trustindex3": "Social trust scale",
    "reform1_7": "General reform indicator",
    "reform_id_num": "Reform ID number",
    "female": "Sex",
    "fnotbrneur": "Foreign-born father, outside Europe",
    "mnotbrneur": "Foreign-born mother, outside Europe",
    "blgetmg_d": "Belongs to ethnic minority",
    "eduyrs25": "Years of full-time education",
    "paredu_a_high": "High parental education",
}


def social_survey(survey: DataFrame) -> DataFrame:
    """The columns kept of the European Social Survey, behind the country columns."""
    return columns.to_front(columns.pick(survey, *ESS_COLUMNS), "country")


def euromodule(survey: DataFrame) -> DataFrame:
    """The columns kept of the Euromodule survey."""
    return columns.pick(survey, *EUROMODULE_COLUMNS)


def one_country(survey: DataFrame, predicate: str) -> DataFrame:
    """Rows of one country, given as text: ``cntry = 'GB'``."""
    return matching(survey, predicate)


def teaching_sample(survey: DataFrame, ids: list[int] = SAMPLE_IDS) -> DataFrame:
    """Chosen respondents; level positions of 0-10 scales are shifted back to start at 0."""
    rows = columns.pick(survey, "idno", *SAMPLE_CODES.values()).where(F.col("idno").isin(ids))
    return columns.across(rows, SCALES_FROM_ZERO, lambda c: to_number(c) - 1)


def questionnaire_sample(survey: DataFrame, ids: list[int] = SAMPLE_IDS) -> DataFrame:
    """The same respondents under questionnaire codes, some missing answers coded."""
    rows = columns.across(teaching_sample(survey, ids), list(SAMPLE_CODES.values()), to_number)
    rows = columns.duplicate(rows, **SAMPLE_CODES)
    for name, rules in SAMPLE_MISSING.items():
        conditions = [(F.col("idno") == person, code) for person, code in rules]
        rows = rows.withColumn(name, plant_missing(F.col(name), conditions))
    return columns.pick(rows, "idno", Span("A1", "C32"))


def reform_sample(survey: DataFrame) -> DataFrame:
    """Natives aged 25 to 80 within seven years of a reform, complete and labelled."""
    conditions = [
        F.col("agea").between(25, 80), F.col("brncntr") == 1, F.col("reform_years").between(-7, 7),
    ]
    rows = columns.pick(survey.where(all_of(conditions)), *MODEL_FIRST, *MODEL_COLUMNS)
    rows = drop_missing(rows, MODEL_COLUMNS, strict=False)
    return codebook.set_value_labels(codebook.set_variable_labels(rows, **MODEL_LABELS), **MODEL_VALUES)
