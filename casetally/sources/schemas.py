"""Declared column types of the surveillance inputs and intermediate tables."""

from pyspark.sql import types as T

INT, LONG, STR, DBL, BOOL, DATE = (T.IntegerType(), T.LongType(), T.StringType(),
                                   T.DoubleType(), T.BooleanType(), T.DateType())

# The case-record columns the analysis reads (names as in the
# yearly child files after lower-casing) and their types.
CASE_COLUMNS = {
    "staterr": STR, "chid": STR, "subyr": INT, "rptdt": DATE, "rptfips": STR,
    "rptsrc": INT, "chage": INT,
    "chracbl": INT, "chracai": INT, "chracas": INT, "chracnh": INT, "chracwh": INT, "cethn": INT,
    "cddrug": INT, "fcdrug": INT, "cdalc": INT, "fcalc": INT,
    "chmal1": INT, "chmal2": INT, "chmal3": INT, "chmal4": INT,
    "chprior": INT, "rptvictim": INT, "afcarsid": STR,
}

# The single-age population file, 26 characters per line:
# field name, width, type, in file order.
POPULATION_FIELDS = [
    ("year", 4, INT), ("state", 2, STR), ("st_fips", 2, STR), ("cnty_fips", 3, STR),
    ("reg", 2, STR), ("race", 1, INT), ("hisp", 1, INT), ("sex", 1, INT),
    ("age", 2, INT), ("pop", 8, LONG),
]

QUALITY_COLUMNS = {"staterr": STR, "subyr": INT, "prop_missing": DBL,
                   "share_true": DBL, "n_true": LONG, "flag_1": BOOL}

STATE_COUNT_COLUMNS = {"imp": INT, "state": STR, "race_ethn": STR, "chmal1": INT,
                       "ipse": BOOL, "n": LONG}

POP_INFANT_COLUMNS = {"state": STR, "year": INT, "race_ethn": STR, "pop": LONG}

# The year in a yearly child-file name such as CF2016v3.tab.
CASE_FILE_YEAR = r"CF(\d{4})v"
