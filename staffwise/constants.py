"""Fixed values.

These must equal the values the reference computes with; they are stated plainly here and used
everywhere else by name.
"""

# --- Fixed values (domain constants) ---------------------------------------------------------
PRODUCTIVE_MINUTES_PER_WEEK = 2250          # productive minutes of one FTE per week
DAYS_PER_WEEK = 7                           # daily minutes = 2250 / 7
HOURS_PER_DAY = 24
STAFFING_UPLIFT = 1.4                       # staffing multiplier applied before analysis
BAND_LOW = 0.9                              # look-alike band, lower factor
BAND_HIGH = 1.1                             # look-alike band, upper factor
CHANGE_STEPS = [1, 2, 5, 10, 15, 20, 25]    # report steps in percent, used up and down
YEAR_WEIGHTS = {0: 0.6, 1: 0.2, 2: 0.2}     # years before the reference year -> weight
RELIABILITY_LOW_BELOW = 5                   # fewer matches than this: Low
RELIABILITY_MODERATE_MAX = 10               # up to this many: Moderate, above: High
RELIABILITY_LABELS = ("Low", "Moderate", "High")
CAP_OCCUPANCY = 1.0
CAP_SERVICE_LEVEL = 1.0
CAP_ABANDON_RATE = 100.0

USD_VALUES = ["USD", "Global", "Combined"]
DETAIL_USD = ["USD", "Global"]
LEVELS = ["L3", "L4", "L5", "Combined"]
DETAIL_LEVELS = ["L3", "L4", "L5"]
MEDIA = ["Hybrid", "OPI", "VIDEO"]
COMBINED = "Combined"

# text replacements at ingest
FTE_LOCATION_MAP = {"Non-USD": "Global"}
FTE_PRODUCT_MAP = {"Video Dedicated": "VIDEO"}
OCC_MEDIA_MAP = {"Video": "VIDEO"}
LANGUAGE_ALIASES = {"ASL": "AMERICAN SIGN LANGUAGE"}
PLANNER_MARKER = "Weekly Planner"
WEEK_HEADER = "Week Of:"

# planner metric families, matched by substring in the built header
PLANNER_FAMILIES = [
    "OCC Assumptions",
    "Volume (ACTUAL)",
    "STAFFING DIFFERENTIAL",
    "AHT (ACTUAL)",
    "Q4 Time",
    "Occupancy Rate",
    "Staffing Requirement (ACTUAL)",
    "Staffing (ACTUAL/FORECASTED)",
    "Q2 Time",
    "Staffing Requirement (ADJUSTED FORECAST)",
    "Staffing Requirement Adjustment",
    "Staffing Requirement (ORIGINAL FORECAST)",
    "Staffing Requirement (Variance)",
]
# staffing families that roll up by plain sums (USD + Global per level)
STAFFING_FAMILIES = [
    "Staffing Requirement (ADJUSTED FORECAST)",
    "Staffing Requirement Adjustment",
    "Staffing Requirement (ORIGINAL FORECAST)",
    "Staffing Requirement (ACTUAL)",
    "Staffing Requirement (Variance)",
    "Staffing (ACTUAL/FORECASTED)",
]

# feature buckets: left-closed edges, last bucket open
ABN_EDGES_FRACTION = [0.0, 0.02, 0.04, 0.06, 0.08]
ABN_LABELS = ["0-2%", "2-4%", "4-6%", "6-8%", "8%+"]
Q2_EDGES = [0, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50]
Q2_LABELS = ["0-5", "5-10", "10-15", "15-20", "20-25", "25-30", "30-35", "35-40", "40-45", "45-50", "50+"]
TRIM_QUANTILES = (0.05, 0.95)

# activity sessions
SESSION_IDLE_SECONDS = 180
SESSION_WARNING_SECONDS = 15
SESSION_GAP_SECONDS = SESSION_IDLE_SECONDS + SESSION_WARNING_SECONDS

# model scenario grids
SL_Q2_OFFSETS = [-2, -1, 0, 1, 2]
PERCENT_STEPS_15 = [-25, -20, -15, -10, -5, -2, -1, 0, 1, 2, 5, 10, 15, 20, 25]
OCC_ASSUMPTION_POINT_STEPS = [-10, -5, -2, -1, 0, 1, 2, 5, 10]
TRAIN_FRACTION = 0.7
SPLIT_SEED_BUCKETS = 5          # hash split: bucket 0 of 5 is the 20 % test part
LASSO_ALPHA = 0.1
CV_FOLDS = 5
FOREST_TREES = 100
FOREST_SEED = 42
IMPORTANCE_THRESHOLD = 0.05
