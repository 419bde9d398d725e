"""Names, tokens, patterns and limits that results depend on."""

from __future__ import annotations

import re

# Names of observation dates, in order of preference.
TIME_NAMES = ("date", "as_of", "as_of_date", "observation_date", "period", "timestamp", "time", "dt", "day", "week", "month", "year")
# Columns that say when a row was written; never a time axis.
LOAD_NAMES = ("run_date", "load_date", "ingested_at", "created_at", "fetched_at", "updated_at", "_loaded", "etl_date")
# Those of them that tell how far the observations lag behind.
STAMP_NAMES = ("run_date", "load_date", "ingested_at", "created_at", "fetched_at", "updated_at", "etl_date")
FORECAST_NAMES = ("is_forecast", "forecast", "is_projection", "projected", "is_estimate", "scenario")
YEAR_NAMES = ("year", "yr", "crop_year", "harvest_year")
MONTH_NAMES = ("month", "mon", "mo", "month_no", "month_num")
DAY_NAMES = ("day", "dom", "day_of_month")
DEKAD_NAMES = ("dekad", "decad", "tenday")
MONTH_TOKENS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

QUANTILES = (0.0, 0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99, 1.0)
NUMERIC_SENTINELS = (-99999.0, -9999.0, -999.0, -99.0, 9999.0, 99999.0, 999999.0)
STRING_SENTINELS = ("na", "n/a", "#n/a", "null", "none", "nil", "-", "--", "?", "nan", "unknown", ".")
TOP_MAX_DISTINCT, TOP_LIMIT = 50, 10
HEAVY_TAIL_RATIO, MIN_SIGMA_ROWS, NORMAL_IQR = 2.0, 30, 1.349
DERIVED_DIGITS, DERIVED_SHARE = 15, 0.05
HIGH_NULL_SHARE = 0.20
MAX_GROUP_CARDINALITY, MAX_GROUP_COLUMNS = 200, 4
MIN_CADENCE_POINTS = 12
MIN_RUN = 3
SATURATION_SHARE, MIN_SATURATION_ROWS, MIN_SATURATION_DISTINCT = 0.05, 30, 20
ROUND_BOUNDS = (0.0, 1.0, -1.0, 10.0, 100.0, -100.0, 1000.0)
MIN_RESIDUE_ROWS, RESIDUE_DECADES, FEW_DISTINCT = 20, 6, 5
STEP_MAD_MULTIPLE, STEP_TAIL_QUANTILE, STEP_TAIL_MULTIPLE, MAD_TO_SIGMA, CONTEXT, MIN_STEP_ROWS = 20.0, 0.95, 4.0, 1.4826, 10, 20
MAX_SHIFTS, MAX_GAPS_SHOWN, UNIT_TOLERANCE = 10, 5, 0.01
UNIT_RATIOS = {1000.0: "a factor of 1000", 100.0: "a factor of 100", 10.0: "a factor of 10", 2.20462: "pounds per kilogram", 2204.62: "pounds per tonne", 1.10231: "short tons per tonne", 35.3147: "cubic feet per cubic metre", 6.28981: "barrels per cubic metre"}
DELIMITERS = (",", ";", "\t", "|")
DELIMITER_CONFIDENCE = 0.95

PERCENT_NAME = re.compile(r"(^|_)(pct|percent|pc|share|rate|ratio|util)|percent|_pct|pct_|%", re.I)
AMOUNT_NAME = re.compile(r"(^|_)(qty|quantity|volume|vol|amount|amt|count|n|num|total|sum|tonnes|tons|tonnage|kg|lbs|pounds|bushels|bu|bags|barrels|bbl|head|acres|hectares|ha|units|value|revenue|sales|receipts|exports|imports|shipments|production|stocks_total)($|_)", re.I)

# UTF-8 read as Latin-1 leaves pairs of these characters.
MOJIBAKE = r"[\x{c3}\x{c2}][\x{80}-\x{bf}]|\x{e2}\x{20ac}|\x{ef}\x{bb}\x{bf}"
# Numbers that can be read in one way only, in either convention, and in both.
EU_NUMBER = r"^[+-]?\d{1,3}(\.\d{3}){2,}$|^[+-]?\d{1,3}(\.\d{3})+,\d+$|^[+-]?\d+,\d{1,2}$|^[+-]?\d+,\d{4,}$|^[+-]?\d{4,},\d{3}$"
US_NUMBER = r"^[+-]?\d{1,3}(,\d{3}){2,}$|^[+-]?\d{1,3}(,\d{3})+\.\d+$|^[+-]?\d+\.\d{1,2}$|^[+-]?\d+\.\d{4,}$|^[+-]?\d{4,}\.\d{3}$"
AMBIGUOUS_NUMBER = r"^[+-]?\d{1,3}[.,]\d{3}$"
PLAIN_INTEGER = r"^[+-]?\d+$"
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$"
PARTS_DATE = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})$"
