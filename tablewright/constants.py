"""Fixed values that define results.

Changing any of these changes what a query returns, so they are stated once,
here, and imported everywhere else.
"""

# Profiling
SAMPLE_ROWS = 50
TOP_VALUES = 10
HISTOGRAM_BINS = 10
WHISKER_IQR_FACTOR = 1.5
SEED = 42

# Target detection
TARGET_MAX_DISTINCT = 20
TARGET_MIN_DISTINCT = 2
TARGET_MAX_UNIQUENESS = 0.9

# Pre-processing
ONE_HOT_MAX_CATEGORIES = 10
TEST_SIZE = 0.2
OUTLIER_CLIP_STD = 3.0
UNSEEN_CATEGORY_CODE = -1

# Feature engineering
DATE_PARSE_MIN_RATE = 0.9
INTERACTION_MAX_NUMERIC = 6
CORRELATION_DROP_ABOVE = 0.95

# Training
LOGISTIC_MAX_ITER = 1000
FOREST_TREES = 300
PARAM_TEXT_MAX_CHARS = 250

# Monitoring and explanation
HISTORY_ROWS = 100
TOP_CONTRIBUTIONS = 10
MIN_BAR_DENOMINATOR = 1e-4

BINARY = "binary_classification"
MULTICLASS = "multiclass_classification"
REGRESSION = "regression"
CLASSIFICATION = (BINARY, MULTICLASS)

# Cell texts read as missing (the documented default list of the pandas CSV reader).
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Names of months in date texts; their first three letters are names too.
MONTH_NAMES = (
    "january",
    "february",
    "march",
    "april",
    "may",
    "june",
    "july",
    "august",
    "september",
    "october",
    "november",
    "december",
)

SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")

# Texts of reports and errors, read by users and front ends.
SCALING_METHOD = "StandardScaler"
OUTLIER_METHOD = f"Clip standardized values beyond +/-{OUTLIER_CLIP_STD} std"
ERROR_NOT_CSV = "Only CSV files are supported"
ERROR_NO_DATA = "CSV file contains no data"
ERROR_NO_COLUMN = "Column '{}' does not exist in this dataset"
ERROR_FEW_CLASSES = "Target column must have at least 2 distinct values"
ERROR_MISSING_FIELDS = "Missing required fields: {}"
