"""Values that the results depend on. Times of day are whole seconds since midnight."""

# The delivery window, its cut-off and its bins.
DAY_SECONDS = 86400
WINDOW_OPEN = 57600  # 16:00:00
WINDOW_CLOSE = 68400  # 19:00:00
CUTOFF = 65100  # 18:05:00
BIN_SECONDS = 300
BIN_COUNT = 37  # 16:00 to 19:00, both ends included
MINUTE_COUNT = 181
FIRST_BIN_LABEL = 961

# Cohorts and limits.
SHORT_HISTORY_DAYS = 5
OUTLIER_FENCE = 3.0
MOVING_RANGE_FACTOR = 2.66
CUTOFF_ALERT_LEAD = 300  # alert: latest arrival before the cut-off minus five minutes
LATEST_ALERT_LEAD = 120  # alert: 99% quantile minus two minutes
RED_ALLOWANCE = 0.01

# Quantile ranks (percent) and the column each one fills.
SHORT_RANKS = {"quantile01": 1, "predicted_time": 50}
LONG_RANKS = {
    "quantile01": 1,
    "quantile05": 5,
    "quantile10": 10,
    "quantile15": 15,
    "quantile20": 20,
    "predicted_time": 50,
    "quantile60": 60,
    "quantile70": 70,
    "quantile80": 80,
    "quantile95": 95,
    "quantile99": 99,
}
FORECAST_RANKS = {"red_1": 1, "red_5": 5, "red_10": 10, "red_20": 20, "predicted": 50, "green": 95}

# Alert labels from best to worst.
ALERT_LABELS = ["GREEN", "AMBER", "RED_20", "RED_10", "RED_5", "RED_1"]
