"""Fixed values that must equal the behaviour being reproduced.

Everything here is a plain list or number; the logic that uses them lives in
the operators.
"""

# --- fixed values: thresholds of the `pipeline` variant -----------------------
MIN_ROWS = 1
MAX_COLUMNS = 500
CATEGORICAL_CARDINALITY_THRESHOLD = 50
TEXT_AVG_LENGTH_THRESHOLD = 50
MISSING_RATIO_WARNING = 0.05
MISSING_RATIO_HIGH = 0.30
DUPLICATE_RATIO_WARNING = 0.05
IQR_MULTIPLIER = 1.5
TOP_K_CATEGORIES = 10
PREVIEW_ROWS = 5
SAMPLE_VALUES_COUNT = 5
PARSE_RATIO_THRESHOLD = 0.80

# --- fixed values: `builder` variant --------------------------------------------
BUILDER_TEXT_DISTINCT = 50
BUILDER_TEXT_AVG_LEN = 30
BUILDER_TOP_K = 5
BUILDER_PREVIEW_ROWS = 10
BOOL_TRUE = ["true", "t", "yes", "y", "1"]
BOOL_FALSE = ["false", "f", "no", "n", "0"]

# --- fixed values: boolean domain of the `pipeline` variant (string spellings) ---
PIPELINE_BOOL_STRINGS = ["True", "False", "true", "false"]
# a CSV read as all-strings: these spellings would have been typed bool/int by a
# typed reader, so they join the domain when the input came from text
PIPELINE_BOOL_TEXT_EXTRA = ["TRUE", "FALSE", "0", "1"]

# --- fixed values: null tokens of a typed CSV reader --------------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- fixed values: name keywords used by column roles ---------------------------
GEO_KEYWORDS = ["country", "state", "city", "region", "zip", "postal", "latitude",
                "longitude", "lat", "lng", "lon", "address", "province", "county"]
DATE_KEYWORDS = ["date", "time", "datetime", "timestamp", "year", "month", "day",
                 "week", "quarter", "period", "created", "updated"]
ID_KEYWORDS = ["id", "key", "code", "number", "no", "num"]
MONEY_KEYWORDS = ["sale", "revenue", "price", "profit", "cost"]
IDENTIFIER_UNIQUENESS = 0.5
NUMERIC_DIMENSION_MAX_DISTINCT = 20
MAX_KPI_MEASURES = 5

# --- fixed values: date-column fallback of the workbook writer ---------------
DATE_FALLBACK_KEYWORDS = ["date", "time", "datetime", "timestamp", "year", "month",
                          "day", "week", "quarter", "period", "created", "updated",
                          "order_date", "ship_date", "order date", "ship date"]
DATE_FALLBACK_SAMPLE = 200
TREND_EXCLUDE_KEYWORDS = ["id", "code", "zip", "postal"]

# --- fixed values: chart rules ------------------------------------------------
MAX_PIE_CATEGORIES = 7
MAX_BAR_CATEGORIES = 10
MIN_ROWS_FOR_SCATTER = 30
HIGH_CARDINALITY_LIMIT = 50
MAX_VISUALS = 10
AVG_HINTS = ["rate", "ratio", "pct", "percentage", "avg", "average", "score",
             "rating", "index", "per_"]
SUM_HINTS = ["count", "num_", "number_of", "qty", "quantity", "total"]
GROUPING_MIN_DISTINCT = 2
GROUPING_MAX_DISTINCT = 12
GROUPING_TARGET_DISTINCT = 5
GROUPING_UNKNOWN_SCORE = 10
MAX_VISUALIZATIONS_DEFAULT = 8
QUALITY_THRESHOLD_DEFAULT = 40.0

# --- fixed values: semantic type -> BI role and default aggregation ------------
SEMANTIC_ROLE = [
    ("numeric", "measure", "Sum"),
    ("categorical", "dimension", "Count"),
    ("datetime", "dimension", "Year"),
    ("boolean", "dimension", "Count"),
    ("text", "dimension", "Count"),
    ("unknown", "dimension", "Count"),
]

# --- fixed values: aggregation keywords recognised in a formula (two orders) ----
FORMULA_AGG_ORDER = ["SUM", "AVG", "COUNT", "MIN", "MAX", "MEDIAN"]
FORMULA_AGG_ORDER_ALT = ["SUM", "AVG", "MIN", "MAX", "COUNT", "MEDIAN"]

# --- fixed values: EDA notebook caps ------------------------------------------
EDA_SAMPLE_VALUES = 50
EDA_NUMERIC_MAX_COLS = 8
EDA_CATEGORICAL_MAX_COLS = 6
EDA_DATETIME_MAX_COLS = 2
EDA_TOP_K = 10
HISTOGRAM_BINS = 30

SEMANTIC_TYPES = ["numeric", "categorical", "datetime", "boolean", "text", "unknown"]
CHART_TYPES = ["bar", "line", "scatter", "pie", "histogram", "heatmap", "box", "table"]
TIME_GRAINS = ["day", "week", "month", "quarter", "year"]
