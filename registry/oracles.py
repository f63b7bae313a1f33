"""ANSI SQL for each query, run by another engine on the same tables.

Written from the definitions, not from the Spark plans: distinct counts, joins to grids and
sorted ranks stand where the library uses histograms, counters and windows.
"""

from __future__ import annotations

# Building blocks


def clock(sec: str) -> str:
    return (
        f"CASE WHEN {sec} IS NOT NULL THEN "
        f"printf('%02d:%02d:%02d', {sec} // 3600, {sec} % 3600 // 60, {sec} % 60) END"
    )


def linear(value: str, rank: float) -> str:
    return f"quantile_cont({value}, {rank / 100}::DOUBLE)"


def whole(value: str) -> str:
    return f"CAST(floor(round({value}, 6)) AS INTEGER)"


def nearest(value: str, rank: float) -> str:
    position = f"CAST(round_even({rank / 100}::DOUBLE * (count(*) - 1), 0) AS BIGINT) + 1"
    return f"list_sort(list({value}))[{position}]"


def with_(body: str, *parts: str) -> str:
    return "WITH " + ", ".join(parts) + " " + body


DENSE = """dense AS (
    SELECT 'C' || ((user_id // 10) % 5) AS client_name, CAST(user_id // 10 AS VARCHAR) AS fund_id,
        CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS nav_date,
        CAST(57600 + (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) // 8 AS INTEGER) AS sec
    FROM events)"""
SKEWED = """skewed AS (
    SELECT 'C' || ((user_id // 10) % 5) AS client_name, CAST(user_id // 10 AS VARCHAR) AS fund_id,
        CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS nav_date,
        CAST(least(57600 + floor(value * 20), 68399) AS INTEGER) AS sec
    FROM events)"""
SPARSE = """sparse AS (
    SELECT n_name AS client_name, CAST(o_custkey AS VARCHAR) AS fund_id,
        o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS nav_date,
        CAST(57600 + (o_orderkey * 7919) % 10800 AS INTEGER) AS sec
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

LONG = {
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


def sla(source: str, keys: str = "fund_id", name: str = "sla") -> str:
    return f"""{name} AS (
    SELECT {keys}, count(DISTINCT nav_date) AS total_days,
        count(DISTINCT nav_date) FILTER (WHERE sec > 65100) AS miss_days,
        max(sec) FILTER (WHERE sec < 65100) AS max_time_before_cutoff, max(sec) AS max_time
    FROM {source} GROUP BY {keys})"""


def unique(source: str) -> str:
    return f"""uniq AS (
    SELECT min(client_name) AS client_name, fund_id, nav_date, sec
    FROM {source} GROUP BY fund_id, nav_date, sec)"""


def short_profile(source: str) -> list[str]:
    return [
        unique(source),
        sla(source),
        f"""short AS (
    SELECT q.*, total_days, miss_days, max_time_before_cutoff, max_time FROM (
        SELECT client_name, fund_id, {whole(linear("sec", 1))} AS quantile01,
            {whole(linear("sec", 50))} AS predicted_time
        FROM uniq GROUP BY client_name, fund_id) q
    JOIN sla USING (fund_id) WHERE total_days <= 5)""",
    ]


def inside(source: str, keys: str, k: float, name: str = "inliers") -> str:
    return f"""{name} AS (
    SELECT * FROM (
        SELECT *, {linear("sec", 25)} OVER w AS q1, {linear("sec", 75)} OVER w AS q3
        FROM {source} WINDOW w AS (PARTITION BY {keys}))
    WHERE sec > q1 - {k} * (q3 - q1) AND sec < q3 + {k} * (q3 - q1))"""


def long_profile(source: str) -> list[str]:
    points = ", ".join(f"{whole(linear('sec', r))} AS {n}" for n, r in LONG.items())
    return [
        unique(source),
        sla(source),
        inside("uniq", "client_name, fund_id", 3.0),
        f"""long AS (
    SELECT q.*, total_days, miss_days, max_time_before_cutoff, max_time,
        max_time_before_cutoff - 300 AS alert_time FROM (
        SELECT client_name, fund_id, {points} FROM inliers GROUP BY client_name, fund_id) q
    JOIN sla USING (fund_id) WHERE total_days > 5)""",
    ]


def ticker_profile(source: str) -> list[str]:
    points = ", ".join(
        (f"{whole(linear('sec', r))} AS {n}" if r == 50 else f"{nearest('sec', r)} AS {n}")
        for n, r in LONG.items()
    )
    return [
        sla(source, "ticker"),
        inside(source, "ticker", 3.0),
        f"known AS (SELECT DISTINCT client_name, fund_id, ticker FROM {source})",
        f"""tickers AS (
    SELECT client_name, fund_id, q.*, quantile99 - 120 AS alert_time, total_days, miss_days,
        max_time
    FROM (SELECT ticker, {points} FROM inliers GROUP BY ticker) q
    JOIN sla USING (ticker) JOIN known USING (ticker) WHERE total_days > 5)""",
    ]


TICKER_KEYS = "client_name, fund_id, ticker"
SHORT_TICKERS = [
    SPARSE,
    sla("sparse", TICKER_KEYS),
    f"""short_tickers AS (
    SELECT q.*, total_days, miss_days, max_time_before_cutoff, max_time FROM (
        SELECT {TICKER_KEYS}, {whole(linear("sec", 1))} AS quantile01,
            {whole(linear("sec", 50))} AS predicted_time
        FROM sparse GROUP BY {TICKER_KEYS}) q
    JOIN sla USING ({TICKER_KEYS}) WHERE total_days <= 5)""",
]

TIMES = [*LONG, "max_time_before_cutoff", "max_time", "alert_time"]


def shown(columns: list[str], times: list[str]) -> str:
    return ", ".join(f"{clock(n)} AS {n}" if n in times else n for n in columns)


SHORT_COLUMNS = [
    "client_name",
    "fund_id",
    "quantile01",
    "predicted_time",
    "total_days",
    "miss_days",
    "max_time_before_cutoff",
    "max_time",
]
LONG_COLUMNS = [
    "client_name",
    "fund_id",
    *LONG,
    "total_days",
    "miss_days",
    "max_time_before_cutoff",
    "max_time",
    "alert_time",
]
TICKER_COLUMNS = [
    "client_name",
    "fund_id",
    "ticker",
    *LONG,
    "alert_time",
    "total_days",
    "miss_days",
    "max_time",
]

FUNDS = """funds AS (
    SELECT DISTINCT * EXCLUDE (ticker) FROM (
        SELECT *, rank() OVER (PARTITION BY fund_id ORDER BY predicted_time DESC) AS place
        FROM tickers) WHERE place = 1)"""

SHORT_FUND_COLUMNS = (
    f"client_name, {clock('quantile01')} AS {{level}}_min_time, "
    f"{clock('predicted_time')} AS predicted_time, total_days, miss_days, "
    f"{clock('max_time_before_cutoff')} AS max_time_before_cutoff, "
    f"{clock('max_time')} AS {{level}}_max_time"
)

HISTORY = f"""kept AS (
    SELECT client_name, nav_date, (sec - 57600) // 300 + 1 AS bin FROM dense
    WHERE isodow(nav_date) <= 5 AND sec BETWEEN 57600 AND 68400),
grid AS (
    SELECT client_name, nav_date, bin FROM (SELECT DISTINCT client_name, nav_date FROM kept)
    CROSS JOIN (SELECT CAST(unnest(range(1, 38)) AS INTEGER) AS bin)),
counted AS (SELECT client_name, nav_date, bin, count(*) AS n FROM kept GROUP BY ALL),
filled AS (
    SELECT grid.*, coalesce(n, 0) AS n FROM grid LEFT JOIN counted USING (client_name, nav_date, bin)),
summed AS (
    SELECT *, CAST(sum(n) OVER (PARTITION BY client_name, nav_date ORDER BY bin) AS BIGINT) AS cumsum
    FROM filled),
history AS (
    SELECT client_name, nav_date, CAST(isodow(nav_date) - 1 AS INTEGER) AS weekday, bin,
        CAST(961 + 5 * (bin - 1) AS INTEGER) AS bin_label, n, cumsum,
        round_even(cumsum / max(cumsum) OVER (PARTITION BY client_name, nav_date), 4) AS share
    FROM summed)"""
LEVELS = {"red_1": 1, "red_5": 5, "red_10": 10, "red_20": 20, "predicted": 50, "green": 95}
FORECAST = f"""daily AS (
    SELECT client_name, weekday, nav_date, max(cumsum) AS volume FROM history GROUP BY ALL),
volumes AS (
    SELECT client_name, weekday, median(volume) AS day_volume FROM daily GROUP BY ALL),
shares AS (
    SELECT client_name, weekday, bin,
        {", ".join(f"round({linear('share', r)}, 6) AS {n}_pct" for n, r in LEVELS.items())}
    FROM history GROUP BY ALL),
forecast AS (
    SELECT shares.*, day_volume,
        {", ".join(f"round(round({n}_pct * day_volume, 6), 0) AS {n}" for n in LEVELS)}
    FROM shares LEFT JOIN volumes USING (client_name, weekday))"""
ERRORS = """errors AS (
    SELECT history.*, forecast.* EXCLUDE (client_name, weekday, bin),
        predicted - cumsum AS error, abs(predicted - cumsum) AS absolute_error,
        abs(predicted_pct - share) * 100 AS error_pct,
        CASE WHEN predicted - cumsum > 0 THEN 'Positive Error'
            WHEN predicted - cumsum < 0 THEN 'Negative Error' ELSE 'No Error' END AS error_type
    FROM history LEFT JOIN forecast USING (client_name, weekday, bin))"""
ALERTS = """alerts AS (
    SELECT *, CASE WHEN cumsum >= predicted THEN 'GREEN' WHEN cumsum >= red_20 THEN 'AMBER'
        WHEN cumsum < red_1 THEN 'RED_1' WHEN cumsum < red_5 THEN 'RED_5'
        WHEN cumsum < red_10 THEN 'RED_10' WHEN cumsum < red_20 THEN 'RED_20' END AS alert
    FROM errors)"""


def zones(source: str, keys: str, k: float) -> str:
    return f"""zones AS (
    SELECT * EXCLUDE (q1, q3), CASE WHEN sec > fence_low AND sec < fence_high THEN 'inlier'
        WHEN sec < fence_low OR sec > fence_high THEN 'outlier' ELSE 'on_fence' END AS zone
    FROM (SELECT *, q1 - {k} * (q3 - q1) AS fence_low, q3 + {k} * (q3 - q1) AS fence_high FROM (
        SELECT *, {linear("sec", 25)} OVER w AS q1, {linear("sec", 75)} OVER w AS q3
        FROM {source} WINDOW w AS (PARTITION BY {keys}))))"""


RESIDUALS = [
    SKEWED,
    *ticker_profile("skewed"),
    zones("skewed", "ticker", 3.0),
    """found AS (SELECT DISTINCT ticker, fund_id, nav_date, sec FROM zones WHERE zone = 'outlier')""",
    """residuals AS (
    SELECT s.ticker, s.fund_id, s.nav_date, s.sec,
        CASE WHEN f.sec IS NULL THEN 'NotOutlier' ELSE 'Outlier' END AS outlier,
        t.client_name, quantile01, predicted_time, alert_time, quantile99,
        predicted_time - s.sec AS diff_sec, (predicted_time - s.sec) / 86400.0::DOUBLE AS diff_day
    FROM skewed s LEFT JOIN found f
        ON s.ticker = f.ticker AND s.fund_id = f.fund_id AND s.nav_date = f.nav_date AND s.sec = f.sec
    LEFT JOIN tickers t ON s.ticker = t.ticker AND s.fund_id = t.fund_id)""",
    "once AS (SELECT DISTINCT * FROM residuals)",
]


def mae(condition: str = "true") -> str:
    return f"round((avg(abs(diff_sec)) FILTER (WHERE {condition})) / 86400, 9)"


SIGNED = f"""round((avg(diff_sec) FILTER (WHERE diff_sec < 0)) / 86400, 9) AS negative_mean,
    count(*) FILTER (WHERE diff_sec < 0) AS negative_count,
    round((avg(diff_sec) FILTER (WHERE diff_sec >= 0)) / 86400, 9) AS positive_mean,
    count(*) FILTER (WHERE diff_sec >= 0) AS positive_count, {mae()} AS mae"""


FUND_RESIDUALS = [
    SKEWED,
    *long_profile("skewed"),
    zones("skewed", "fund_id", 3.0),
    """found AS (SELECT DISTINCT fund_id, nav_date, sec FROM zones WHERE zone = 'outlier')""",
    """residuals AS (
    SELECT s.fund_id, s.nav_date, s.sec,
        CASE WHEN f.sec IS NULL THEN 'NotOutlier' ELSE 'Outlier' END AS outlier,
        l.client_name, quantile01, predicted_time, alert_time, quantile99,
        predicted_time - s.sec AS diff_sec, (predicted_time - s.sec) / 86400.0::DOUBLE AS diff_day
    FROM skewed s LEFT JOIN found f
        ON s.fund_id = f.fund_id AND s.nav_date = f.nav_date AND s.sec = f.sec
    LEFT JOIN long l ON s.fund_id = l.fund_id)""",
    "once AS (SELECT DISTINCT * FROM residuals)",
]

UNEVEN = """changed AS (
    SELECT CASE WHEN CAST(fund_id AS INTEGER) % 13 <> 0 THEN client_name END AS client_name, fund_id,
        ticker, nav_date, CASE WHEN CAST(fund_id AS INTEGER) % 7 = 0 THEN 60000 ELSE sec END AS sec
    FROM sparse),
uneven AS (
    SELECT * FROM changed UNION ALL
    SELECT 'ZZ' AS client_name, fund_id, ticker, nav_date, sec FROM changed
    WHERE CAST(fund_id AS INTEGER) % 11 = 0)"""

SHORT_FUND_TIMES = {
    "fund_min_time": "quantile01",
    "predicted_time": "predicted_time",
    "max_time_before_cutoff": "max_time_before_cutoff",
    "fund_max_time": "max_time",
}


def feed_profile(name: str, definition: str, source: str, body: str) -> str:
    return f"SELECT '{name}' AS feed, * FROM ({with_(body, definition, *long_profile(source))})"


def bin_counts(source: str, columns: dict[str, str]) -> str:
    """Cumulative counts per five-minute bin for each named column."""
    volumes = ", ".join(
        f"(SELECT count(*) FROM {source} WHERE {old} BETWEEN 57600 AND 68400"
        f" AND ({old} - 57600) // 300 + 1 <= bin) AS volume_{new}"
        for new, old in columns.items()
    )
    start = "(57600 + 300 * (bin - 1))"
    axis = "(SELECT CAST(unnest(range(1, 38)) AS INTEGER) AS bin)"
    return f"SELECT {clock(start)} AS time, {volumes} FROM {axis}"


def weekday_times(point: str) -> str:
    names = ["monday", "tuesday", "wednesday", "thursday", "friday"]
    parts = [f"{clock(f'coalesce({point.format(filter="")}, 0)')} AS all_days"]
    for day, name in enumerate(names, start=1):
        value = point.format(filter=f" FILTER (WHERE isodow(nav_date) = {day})")
        parts.append(f"{clock(f'coalesce({value}, 0)')} AS {name}")
    return ", ".join(parts)


MEDIAN_POINT = "CAST(floor(round(quantile_cont(sec, 0.5::DOUBLE){filter}, 6)) AS INTEGER)"
QUANTILE_POINT = (
    "CAST(round_even(round(quantile_cont(sec, 0.95::DOUBLE){filter}, 6), 0) AS INTEGER)"
)


def five_minute_curve(low: int, high: int) -> str:
    """Cumulative counts of the long profile; bins outside low to high count nothing."""
    volumes = ", ".join(
        f"(SELECT count(*) FROM long WHERE {n} BETWEEN 57600 AND 68400"
        f" AND ({n} - 57600) // 300 + 1 BETWEEN {low} AND least({high}, bin)) AS volume_{n}"
        for n in TIMES
    )
    start = "(57600 + 300 * (bin - 1))"
    return (
        f"SELECT {clock(start)} AS time, {volumes} "
        "FROM (SELECT CAST(unnest(range(1, 38)) AS INTEGER) AS bin)"
    )


def one_minute_curve(source: str, late: str) -> str:
    def minute(column: str) -> str:
        up = f"CAST(ceil({column} / 60.0) * 60 AS INTEGER)"
        return f"CASE WHEN {up} = 57540 THEN 57600 ELSE {up} END"

    def volume(column: str) -> str:
        return (
            f"(SELECT count(*) FROM {source} p WHERE p.client_name = c.client_name"
            f" AND {minute(column)} BETWEEN 57600 AND c.moment) AS volume_{column}"
        )

    return (
        f"SELECT client_name, {clock('moment')} AS time, {volume('predicted_time')}, {volume(late)} "
        f"FROM (SELECT client_name, CAST(unnest(range(57600, 68401, 60)) AS INTEGER) AS moment "
        f"FROM (SELECT DISTINCT client_name FROM {source})) c"
    )


def summary(keys: str, value: str) -> str:
    return f"""SELECT {keys}, count({value}) AS count, round(avg({value}), 6) AS mean,
    round(stddev_samp({value}), 6) AS stddev, round(min({value}), 6) AS min,
    round({linear(value, 25)}, 6) AS quarter, round({linear(value, 50)}, 6) AS median,
    round({linear(value, 75)}, 6) AS threefourth, round(max({value}), 6) AS max
    FROM errors GROUP BY {keys}"""


def spread(keys: str) -> str:
    return with_(
        f"SELECT {keys}, round_even(stddev_samp(cumsum), 3) AS standard_deviation "
        f"FROM history GROUP BY {keys}",
        DENSE,
        HISTORY,
    )


LATEST_MONTH = "(SELECT date_trunc('month', max(nav_date)) FROM sparse)"
ACTIVE = f"SELECT fund_id FROM sparse WHERE date_trunc('month', nav_date) = {LATEST_MONTH}"
BAD_CLIENT, BAD_DATE, BAD_TIME = "sec % 83 = 0", "sec % 89 = 0", "sec % 97 = 0"

ORACLES: dict[str, str] = {
    # Normalising, cohorts, identities
    "normalize_arrivals": with_(
        f"""SELECT client_name, fund_id, nav_date,
    CAST(nav_date AS TIMESTAMP) + to_seconds(sec // 60 * 60) AS arrival_ts,
    CAST(sec // 60 * 60 AS INTEGER) AS sec
    FROM dense WHERE NOT ({BAD_CLIENT}) AND NOT ({BAD_DATE}) AND NOT ({BAD_TIME})
    AND nav_date BETWEEN DATE '2024-01-02' AND DATE '2024-01-29'""",
        DENSE,
    ),
    "normalization_audit": with_(
        f"""SELECT count(*) AS rows_read, count(*) FILTER (WHERE {BAD_CLIENT}) AS rows_incomplete,
    count(*) FILTER (WHERE NOT ({BAD_CLIENT}) AND {BAD_DATE}) AS rows_bad_date,
    count(*) FILTER (WHERE NOT ({BAD_CLIENT}) AND NOT ({BAD_DATE}) AND {BAD_TIME}) AS rows_bad_time,
    count(*) FILTER (WHERE NOT ({BAD_CLIENT}) AND NOT ({BAD_DATE}) AND NOT ({BAD_TIME})) AS rows_kept
    FROM dense""",
        DENSE,
    ),
    "grid_audit": with_(
        """SELECT count(*) AS rows_read, count(*) FILTER (WHERE isodow(nav_date) > 5) AS rows_weekend,
    count(*) FILTER (WHERE isodow(nav_date) <= 5 AND sec < 57600) AS rows_before_window,
    count(*) FILTER (WHERE isodow(nav_date) <= 5 AND sec > 68400) AS rows_after_window,
    count(*) FILTER (WHERE isodow(nav_date) <= 5 AND sec BETWEEN 57600 AND 68400) AS rows_kept,
    count(*) FILTER (WHERE sec > 65100) AS rows_after_cutoff FROM dense""",
        DENSE,
    ),
    "time_parts": with_(
        f"""SELECT ticker, nav_date AS arrival_date, {clock("sec")} AS arrival_time,
    round(sec / 86400.0::DOUBLE, 9) AS event_time_numeric, sec AS seconds,
    CAST(isodow(nav_date) - 1 AS INTEGER) AS weekday FROM dense""",
        DENSE,
    ),
    "active_cohort": with_(f"SELECT * FROM sparse WHERE fund_id IN ({ACTIVE})", SPARSE),
    "inactive_cohort": with_(f"SELECT * FROM sparse WHERE fund_id NOT IN ({ACTIVE})", SPARSE),
    "forced_cohort": with_(
        """SELECT * FROM sparse WHERE fund_id IN ('7', '8', '11') OR fund_id IN (
    SELECT fund_id FROM sparse
    WHERE nav_date BETWEEN DATE '1998-04-01' AND DATE '1998-04-30')""",
        SPARSE,
    ),
    "history_split": with_(
        """SELECT sparse.*, CASE WHEN days <= 5 THEN 'short' ELSE 'long' END AS cohort
    FROM sparse JOIN (SELECT fund_id, count(DISTINCT nav_date) AS days FROM sparse
    GROUP BY fund_id) USING (fund_id)""",
        SPARSE,
    ),
    "history_length": with_(
        "SELECT fund_id, count(DISTINCT nav_date) AS n_days FROM sparse GROUP BY fund_id", SPARSE
    ),
    "entity_map": with_("SELECT DISTINCT client_name, fund_id, ticker FROM sparse", SPARSE),
    "dedupe_arrivals": with_("SELECT * FROM uniq", SKEWED, unique("skewed")),
    "arrival_counts": with_(
        "SELECT client_name, fund_id, nav_date, sec, count(*) AS n FROM skewed GROUP BY ALL", SKEWED
    ),
    "fund_counts": with_(
        "SELECT fund_id, count(DISTINCT (nav_date, sec)) AS n FROM skewed GROUP BY fund_id", SKEWED
    ),
    "client_keys": with_(
        """SELECT CAST(row_number() OVER (ORDER BY client_name) AS INTEGER) AS client_identifier,
    client_name FROM (SELECT DISTINCT client_name FROM sparse)""",
        SPARSE,
    ),
    "client_joined": with_(
        """SELECT sparse.*, client_identifier FROM sparse JOIN (
    SELECT client_name, CAST(dense_rank() OVER (ORDER BY client_name) AS INTEGER) AS client_identifier
    FROM (SELECT DISTINCT client_name FROM sparse)) USING (client_name)""",
        SPARSE,
    ),
    # Quantiles, outliers, profiles
    "quantile_linear": with_(
        "SELECT fund_id, "
        + ", ".join(
            f"round({linear('sec', r)}, 6) AS p{r:02d}"
            for r in (1, 5, 10, 15, 20, 25, 50, 60, 70, 75, 80, 95, 99)
        )
        + " FROM dense GROUP BY fund_id",
        DENSE,
    ),
    "quantile_nearest": with_(
        "SELECT ticker, "
        + ", ".join(
            f"{nearest('sec', r)} AS p{r:02d}" for r in (1, 5, 10, 15, 20, 60, 70, 80, 95, 99)
        )
        + " FROM dense GROUP BY ticker",
        DENSE,
    ),
    "iqr_split": with_(
        """SELECT client_name, fund_id, ticker, nav_date, sec, round(fence_low, 6) AS fence_low,
    round(fence_high, 6) AS fence_high, zone FROM zones""",
        SKEWED,
        zones("skewed", "ticker", 3.0),
    ),
    "iqr_split_narrow": with_(
        """SELECT client_name, fund_id, ticker, nav_date, sec FROM zones WHERE zone = 'outlier'""",
        SKEWED,
        zones("skewed", "fund_id", 1.5),
    ),
    "iqr_on_fence": with_(
        """SELECT ticker, count(*) FILTER (WHERE zone = 'inlier') AS n_inlier,
    count(*) FILTER (WHERE zone = 'outlier') AS n_outlier,
    count(*) FILTER (WHERE zone = 'on_fence') AS n_on_fence FROM zones GROUP BY ticker""",
        SKEWED,
        "minutes AS (SELECT * REPLACE (sec - sec % 60 AS sec) FROM skewed)",
        zones("minutes", "ticker", 1.5),
    ),
    "outlier_counts": with_(
        "SELECT ticker, count(*) AS outlier_count FROM zones WHERE zone = 'outlier' GROUP BY ticker",
        SKEWED,
        zones("skewed", "ticker", 3.0),
    ),
    "outlier_times": with_(
        """SELECT nav_date, sec, count(*) AS outlier_count FROM zones WHERE zone = 'outlier'
    GROUP BY nav_date, sec""",
        SKEWED,
        zones("skewed", "ticker", 3.0),
    ),
    "sla_stats": with_("SELECT * FROM sla", SPARSE, sla("sparse")),
    "arrival_profile_short": with_(
        f"SELECT {shown(SHORT_COLUMNS, TIMES)} FROM short", SPARSE, *short_profile("sparse")
    ),
    "arrival_profile_long": with_(
        f"SELECT {shown(LONG_COLUMNS, TIMES)} FROM long", DENSE, *long_profile("dense")
    ),
    "arrival_profile_long_skewed": with_(
        f"SELECT {shown(LONG_COLUMNS, TIMES)} FROM long", SKEWED, *long_profile("skewed")
    ),
    "ticker_profile": with_(
        f"SELECT {shown(TICKER_COLUMNS, TIMES)} FROM tickers", SKEWED, *ticker_profile("skewed")
    ),
    "ticker_profile_short": with_(
        f"SELECT {shown(['client_name', 'fund_id', 'ticker', *SHORT_COLUMNS[2:]], TIMES)} "
        "FROM short_tickers",
        *SHORT_TICKERS,
    ),
    "weekday_profile_median": with_(
        f"SELECT fund_id, {weekday_times(MEDIAN_POINT)} FROM sparse GROUP BY fund_id", SPARSE
    ),
    "weekday_profile_quantile": with_(
        f"SELECT fund_id, {weekday_times(QUANTILE_POINT)} FROM dense GROUP BY fund_id", DENSE
    ),
    "time_summary": with_(
        f"""SELECT ticker, count(*) AS n, {clock(whole("median(sec)"))} AS median_time,
    {clock(whole("stddev_samp(sec)"))} AS standard_deviation FROM dense GROUP BY ticker""",
        DENSE,
    ),
    "modal_minute": with_(
        f"""SELECT fund_id, minute AS modal_minute, {clock("(minute * 60)")} AS modal_time FROM (
    SELECT fund_id, CAST(sec // 60 AS INTEGER) AS minute,
        row_number() OVER (PARTITION BY fund_id ORDER BY count(*) DESC, sec // 60) AS place
    FROM dense GROUP BY fund_id, sec // 60) WHERE place = 1""",
        DENSE,
    ),
    # Roll-ups and reports
    "rollup_ticker_fund": with_(
        "SELECT "
        + ", ".join(
            {
                "quantile01": f"{clock('quantile01')} AS fund_min_time",
                "quantile99": f"{clock('quantile99')} AS fund_max_time",
            }.get(n, shown([n], TIMES))
            for n in TICKER_COLUMNS
            if n != "ticker"
        )
        + " FROM funds",
        SKEWED,
        *ticker_profile("skewed"),
        FUNDS,
    ),
    "rollup_fund_client": with_(
        "SELECT "
        + ", ".join(
            {
                "quantile01": f"{clock('quantile01')} AS client_min_time",
                "quantile99": f"{clock('quantile99')} AS client_max_time",
            }.get(n, shown([n], TIMES))
            for n in TICKER_COLUMNS
            if n not in ("ticker", "fund_id")
        )
        + """ FROM (SELECT * EXCLUDE (place),
        rank() OVER (PARTITION BY client_name ORDER BY predicted_time DESC) AS top FROM funds)
    WHERE top = 1""",
        SKEWED,
        *ticker_profile("skewed"),
        FUNDS,
    ),
    "rollup_ticker_fund_short": with_(
        f"SELECT {SHORT_FUND_COLUMNS.format(level='fund')}, fund_id FROM funds",
        *SHORT_TICKERS,
        FUNDS.replace("FROM tickers", "FROM short_tickers"),
    ),
    "rollup_fund_client_short": with_(
        f"""SELECT {SHORT_FUND_COLUMNS.format(level='client')} FROM (SELECT * EXCLUDE (place),
        rank() OVER (PARTITION BY client_name ORDER BY predicted_time DESC) AS top FROM funds)
    WHERE top = 1""",
        *SHORT_TICKERS,
        FUNDS.replace("FROM tickers", "FROM short_tickers"),
    ),
    "rollup_time_dedupe": with_(
        f"""SELECT DISTINCT {shown(["client_name", *SHORT_COLUMNS[2:4], *SHORT_COLUMNS[6:]], TIMES)}
    FROM (SELECT *, row_number() OVER (PARTITION BY predicted_time ORDER BY fund_id, client_name)
        AS first FROM (
        SELECT *, rank() OVER (PARTITION BY fund_id ORDER BY predicted_time DESC) AS place
        FROM short) WHERE place = 1) WHERE first = 1""",
        SPARSE,
        *short_profile("sparse"),
    ),
    "rollup_fund_dedupe": with_(
        "SELECT DISTINCT "
        + ", ".join(
            {
                "quantile01": f"{clock('quantile01')} AS client_min_time",
                "quantile99": f"{clock('quantile99')} AS client_max_time",
            }.get(n, shown([n], TIMES))
            for n in ["client_name", *LONG, "alert_time"]
        )
        + """ FROM (SELECT *, row_number() OVER (PARTITION BY fund_id ORDER BY client_name) AS first
    FROM (SELECT *, rank() OVER (PARTITION BY fund_id ORDER BY predicted_time DESC) AS place
        FROM long) WHERE place = 1) WHERE first = 1""",
        SKEWED,
        *long_profile("skewed"),
    ),
    "combine_reports": with_(
        f"""SELECT {shown(["client_name", "fund_id", "ticker", *SHORT_COLUMNS[2:]], TIMES)} FROM (
    SELECT * FROM short_tickers WHERE quantile01 < 65100 AND max_time_before_cutoff IS NOT NULL
    UNION ALL SELECT * REPLACE (CAST(NULL AS INTEGER) AS max_time_before_cutoff)
    FROM short_tickers WHERE quantile01 >= 65100)""",
        *SHORT_TICKERS,
    ),
    # Volume
    "volume_curve_5min_keep": with_(five_minute_curve(1, 37), SPARSE, *long_profile("sparse")),
    "volume_curve_5min_zero": with_(five_minute_curve(2, 36), SPARSE, *long_profile("sparse")),
    "curve_ends": with_(
        f"SELECT * FROM ({five_minute_curve(1, 37)}) WHERE time < '16:50:00' OR time > '18:10:00'",
        SPARSE,
        *long_profile("sparse"),
    ),
    "volume_curve_1min_short": with_(
        one_minute_curve("short", "max_time"), SPARSE, *short_profile("sparse")
    ),
    "volume_curve_1min_long": with_(
        one_minute_curve("long", "quantile99"), SPARSE, *long_profile("sparse")
    ),
    "volume_totals": with_(
        f"""SELECT time, CAST(sum(volume_predicted_time) AS BIGINT) AS volume_predicted_time,
    CAST(sum(volume_quantile99) AS BIGINT) AS volume_quantile99
    FROM ({one_minute_curve("long", "quantile99")}) GROUP BY time""",
        SPARSE,
        *long_profile("sparse"),
    ),
    "bucket_counts": with_(
        """SELECT client_name, CAST(nav_date AS TIMESTAMP) + to_seconds(sec // 300 * 300)
    AS bucket_start, count(*) AS n FROM dense GROUP BY ALL""",
        DENSE,
    ),
    "bucket_floor_counts": with_(
        """SELECT predicted_time - predicted_time % 300 AS bucket, predicted_time, count(*) AS n
    FROM short GROUP BY ALL""",
        SPARSE,
        *short_profile("sparse"),
    ),
    "bin_history": with_("SELECT * FROM history", DENSE, HISTORY),
    "bin_history_keyed": with_(
        """SELECT * EXCLUDE (client_name), CAST(dense_rank() OVER (ORDER BY client_name) AS INTEGER)
    AS client_identifier FROM history""",
        DENSE,
        HISTORY,
    ),
    # Forecast and its quality
    "end_of_day_volume": with_("SELECT * FROM volumes", DENSE, HISTORY, FORECAST),
    "bin_forecast": with_("SELECT * FROM forecast", DENSE, HISTORY, FORECAST),
    "forecast_totals": with_(
        "SELECT bin, weekday, "
        + ", ".join(f"sum({n}) AS {n}" for n in LEVELS if n != "green")
        + " FROM forecast GROUP BY bin, weekday",
        DENSE,
        HISTORY,
        FORECAST,
    ),
    "limit_table": with_(
        f"""SELECT {clock("(57600 + 300 * (bin - 1))")} AS bin, weekday,
    sum(predicted) AS predicted, sum(red_1) AS lower_limit FROM forecast f
    GROUP BY f.bin, weekday""",
        DENSE,
        HISTORY,
        FORECAST,
    ),
    "actual_totals": with_(
        """SELECT bin, nav_date, weekday, CAST(sum(cumsum) AS BIGINT) AS cumsum
    FROM history GROUP BY bin, nav_date, weekday""",
        DENSE,
        HISTORY,
    ),
    "xmr_limits": with_(
        """SELECT d.client_name, d.weekday, d.bin, nav_date, cumsum, moving_range, centre,
    range_centre, round(centre + 2.66::DOUBLE * range_centre, 6) AS upper_limit,
    round(centre - 2.66::DOUBLE * range_centre, 6) AS lower_limit,
    CASE WHEN cumsum BETWEEN round(centre - 2.66::DOUBLE * range_centre, 6)
        AND round(centre + 2.66::DOUBLE * range_centre, 6) THEN 0 ELSE 1 END AS is_outlier
    FROM detail d JOIN limits l
        ON d.client_name = l.client_name AND d.weekday = l.weekday AND d.bin = l.bin""",
        DENSE,
        HISTORY,
        """detail AS (SELECT client_name, weekday, bin, nav_date, cumsum, coalesce(abs(cumsum -
        lag(cumsum) OVER (PARTITION BY client_name, bin ORDER BY nav_date)), 0) AS moving_range
    FROM history)""",
        """limits AS (SELECT client_name, weekday, bin, CAST(ceil(median(cumsum)) AS BIGINT) AS centre,
        CAST(ceil(median(moving_range)) AS BIGINT) AS range_centre
    FROM detail GROUP BY client_name, weekday, bin)""",
    ),
    "spread_bin": spread("client_name, weekday, bin"),
    "spread_weekday": spread("client_name, weekday"),
    "spread_overall": spread("weekday"),
    "training_error": with_(
        """SELECT client_name, nav_date, weekday, bin, cumsum, predicted, error, absolute_error,
    round(error_pct, 6) AS error_pct, error_type FROM errors""",
        DENSE,
        HISTORY,
        FORECAST,
        ERRORS,
    ),
    "stored_forecast_error": with_(
        "SELECT client_name, nav_date, bin, predicted, green, error FROM errors",
        DENSE,
        HISTORY,
        FORECAST,
        ERRORS,
    ),
    "error_summary_client": with_(
        summary("client_name, weekday", "absolute_error"), DENSE, HISTORY, FORECAST, ERRORS
    ),
    "error_summary_bin": with_(
        summary("client_name, weekday, bin", "absolute_error"), DENSE, HISTORY, FORECAST, ERRORS
    ),
    "error_summary_pct": with_(
        summary("client_name, weekday, bin", "error_pct"), DENSE, HISTORY, FORECAST, ERRORS
    ),
    "moving_average": with_(
        """SELECT *, round(CASE WHEN count(*) OVER w = 3 THEN avg(volume) OVER w END, 6)
    AS moving_average FROM daily
    WINDOW w AS (PARTITION BY client_name ORDER BY nav_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
        DENSE,
        HISTORY,
        FORECAST,
    ),
    # Alerts
    "alert_level": with_(
        "SELECT client_name, nav_date, bin, cumsum, predicted, alert FROM alerts",
        DENSE,
        HISTORY,
        FORECAST,
        ERRORS,
        ALERTS,
    ),
    "alert_summary": with_(
        """SELECT client_name, weekday, count(*) FILTER (WHERE alert = 'GREEN') AS green,
    count(*) FILTER (WHERE alert = 'AMBER') AS amber, count(*) FILTER (WHERE alert = 'RED_1') AS red_1,
    count(*) FILTER (WHERE alert IN ('RED_1', 'RED_5')) AS red_5,
    count(*) FILTER (WHERE alert IN ('RED_1', 'RED_5', 'RED_10')) AS red_10,
    count(*) FILTER (WHERE alert LIKE 'RED%') AS red_20, count(*) AS rows_seen,
    round(count(*) * 0.01::DOUBLE, 6) AS red_max_count FROM alerts GROUP BY client_name, weekday""",
        DENSE,
        HISTORY,
        FORECAST,
        ERRORS,
        ALERTS,
    ),
    "alert_pivot": with_(
        "SELECT client_name, weekday, "
        + ", ".join(
            f"count(*) FILTER (WHERE alert = '{a}') AS {a.lower()}"
            for a in ("GREEN", "AMBER", "RED_20", "RED_10", "RED_5", "RED_1")
        )
        + " FROM alerts GROUP BY client_name, weekday",
        DENSE,
        HISTORY,
        FORECAST,
        ERRORS,
        ALERTS,
    ),
    # Validation
    "prediction_residuals": with_(
        "SELECT * REPLACE (round(diff_day, 9) AS diff_day) FROM once", *RESIDUALS
    ),
    "mae_overall": with_(
        f"""SELECT {mae()} AS mae, {mae("outlier = 'NotOutlier'")} AS mae_inliers FROM residuals""",
        *RESIDUALS,
    ),
    **{
        f"mae_{name}": with_(f"SELECT {key}, {mae()} AS mae FROM once GROUP BY {key}", *RESIDUALS)
        for name, key in (("ticker", "ticker"), ("fund", "fund_id"), ("client", "client_name"))
    },
    "signed_errors_ticker": with_(f"SELECT ticker, {SIGNED} FROM once GROUP BY ticker", *RESIDUALS),
    "signed_errors_fund": with_(
        f"""SELECT k.client_name, e.* FROM (SELECT fund_id, {SIGNED} FROM once GROUP BY fund_id) e
    LEFT JOIN (SELECT DISTINCT client_name, fund_id FROM skewed) k USING (fund_id)""",
        *RESIDUALS,
    ),
    "ticker_report": with_(
        f"""SELECT DISTINCT ticker, fund_id, client_name, quantile01, predicted_time, alert_time,
    quantile99, e.mae FROM once JOIN (SELECT ticker, {mae()} AS mae FROM once GROUP BY ticker) e
    USING (ticker)""",
        *RESIDUALS,
    ),
    # Feeds without tickers
    "fund_residuals": with_(
        "SELECT * REPLACE (round(diff_day, 9) AS diff_day), count(*) AS n FROM residuals GROUP BY ALL",
        *FUND_RESIDUALS,
    ),
    "fund_mae_overall": with_(
        f"""SELECT {mae()} AS mae, {mae("outlier = 'NotOutlier'")} AS mae_inliers FROM residuals""",
        *FUND_RESIDUALS,
    ),
    "fund_signed_errors": with_(
        f"""SELECT k.client_name, e.* FROM (SELECT fund_id, {SIGNED} FROM once GROUP BY fund_id) e
    LEFT JOIN (SELECT DISTINCT client_name, fund_id FROM skewed) k USING (fund_id)""",
        *FUND_RESIDUALS,
    ),
    "fund_report": with_(
        f"""SELECT DISTINCT fund_id, client_name, quantile01, predicted_time, alert_time,
    quantile99, e.mae FROM once JOIN (SELECT fund_id, {mae()} AS mae FROM once GROUP BY fund_id) e
    USING (fund_id)""",
        *FUND_RESIDUALS,
    ),
    # The counted history
    "profile_short_from_history": with_(
        f"SELECT {shown(SHORT_COLUMNS, TIMES)} FROM short", SPARSE, *short_profile("sparse")
    ),
    "profile_long_from_history": with_(
        f"SELECT {shown(LONG_COLUMNS, TIMES)} FROM long", SKEWED, *long_profile("skewed")
    ),
    "ticker_profile_from_history": with_(
        f"SELECT {shown(TICKER_COLUMNS, TIMES)} FROM tickers", SKEWED, *ticker_profile("skewed")
    ),
    "ticker_profile_short_from_history": with_(
        f"SELECT {shown(['ticker', *SHORT_COLUMNS], TIMES)} FROM short_tickers", *SHORT_TICKERS
    ),
    "outliers_from_history": with_(
        """SELECT client_name, fund_id, ticker, nav_date, sec, count(*) AS n FROM zones
    WHERE zone = 'outlier' GROUP BY ALL""",
        SKEWED,
        zones("skewed", "ticker", 3.0),
    ),
    "outlier_counts_from_history": with_(
        "SELECT ticker, count(*) AS outlier_count FROM zones WHERE zone = 'outlier' GROUP BY ticker",
        SKEWED,
        zones("skewed", "ticker", 3.0),
    ),
    "sla_stats_from_history": with_("SELECT * FROM sla", SPARSE, sla("sparse")),
    "profile_gaps": with_(
        """SELECT p.client_name, p.fund_id, CASE WHEN p.client_name IS NULL THEN 'incomplete'
        WHEN owned IS NULL THEN 'other_client' ELSE 'on_fences' END AS reason, total_days, n_arrivals
    FROM (SELECT client_name, fund_id, count(*) AS n_arrivals FROM uneven GROUP BY ALL) p
    JOIN sla USING (fund_id)
    LEFT JOIN (SELECT client_name, fund_id, count(*) AS owned FROM uniq GROUP BY ALL) o
        ON o.client_name = p.client_name AND o.fund_id = p.fund_id
    LEFT JOIN (SELECT client_name, fund_id, count(*) AS inside FROM inliers GROUP BY ALL) i
        ON i.client_name = p.client_name AND i.fund_id = p.fund_id
    WHERE p.client_name IS NULL OR owned IS NULL OR (total_days > 5 AND inside IS NULL)""",
        SPARSE,
        UNEVEN,
        *long_profile("uneven"),
    ),
    "profiles_by_feed": " UNION ALL ".join(
        feed_profile(name, definition, source, f"SELECT {shown(LONG_COLUMNS, TIMES)} FROM long")
        for name, definition, source in (("even", DENSE, "dense"), ("skewed", SKEWED, "skewed"))
    ),
    "volume_curve_by_feed": " UNION ALL ".join(
        feed_profile(name, definition, source, five_minute_curve(1, 37))
        for name, definition, source in (("even", DENSE, "dense"), ("skewed", SKEWED, "skewed"))
    ),
    "volume_curve_5min_funds_short": with_(
        bin_counts("funds", SHORT_FUND_TIMES),
        *SHORT_TICKERS,
        FUNDS.replace("FROM tickers", "FROM short_tickers"),
    ),
    # History by the day
    "history_increment": with_("SELECT * FROM history", DENSE, HISTORY),
    "stats_increment": with_(
        "SELECT sla.*, n_rows FROM sla JOIN (SELECT fund_id, count(*) AS n_rows FROM dense "
        "GROUP BY fund_id) USING (fund_id)",
        DENSE,
        sla("dense"),
    ),
    # Deliveries and what is stored of them
    "rejected_rows": with_(
        f"""SELECT CASE WHEN NOT ({BAD_CLIENT}) THEN client_name END AS client_name,
    ' ' || fund_id || ' ' AS fund_id,
    CASE WHEN {BAD_DATE} THEN '2/30/2024' ELSE strftime(nav_date, '%-m/%-d/%Y') END AS nav_date,
    CASE WHEN {BAD_TIME} THEN 'late' ELSE strftime(nav_date + to_seconds(sec), '%-m/%-d/%y %H:%M') END
        AS datetime, strftime(nav_date, '%Y%m%d') AS date_identifier,
    CASE WHEN {BAD_CLIENT} THEN 'incomplete' WHEN {BAD_DATE} THEN 'bad_date' ELSE 'bad_time' END
        AS reason FROM dense WHERE {BAD_CLIENT} OR {BAD_DATE} OR {BAD_TIME}""",
        DENSE,
    ),
    "observed_drops": with_(
        f"""SELECT count(*) AS rows_read, count(*) FILTER (WHERE {BAD_CLIENT}) AS rows_incomplete,
    count(*) FILTER (WHERE NOT ({BAD_CLIENT}) AND {BAD_DATE}) AS rows_bad_date,
    count(*) FILTER (WHERE NOT ({BAD_CLIENT}) AND NOT ({BAD_DATE}) AND {BAD_TIME}) AS rows_bad_time,
    count(*) FILTER (WHERE NOT ({BAD_CLIENT}) AND NOT ({BAD_DATE}) AND NOT ({BAD_TIME})) AS rows_kept
    FROM dense""",
        DENSE,
    ),
    "active_cohort_partitioned": with_(f"SELECT * FROM sparse WHERE fund_id IN ({ACTIVE})", SPARSE),
    "stored_date_range": with_(
        """SELECT *, strftime(nav_date, '%Y%m') AS yyyymm FROM sparse
    WHERE nav_date BETWEEN DATE '1995-03-10' AND DATE '1995-05-20'""",
        SPARSE,
    ),
    "client_keys_merged": with_(
        """SELECT client_name, CAST(row_number() OVER (ORDER BY early DESC, client_name) AS INTEGER)
    AS client_identifier FROM (
        SELECT client_name, min(nav_date) <= DATE '1992-01-03' AS early FROM sparse GROUP BY client_name)""",
        SPARSE,
    ),
    "catalog_table": with_("SELECT client_name, fund_id, nav_date FROM sparse", SPARSE),
    # Publishing
    "partition_overwrite": with_(
        """SELECT client_name, count(*) AS n,
    CAST(CASE WHEN strftime(nav_date, '%Y%m') = (SELECT strftime(max(nav_date), '%Y%m') FROM sparse)
        THEN 2 ELSE 1 END AS INTEGER) AS run, strftime(nav_date, '%Y%m') AS yyyymm
    FROM sparse GROUP BY ALL""",
        SPARSE,
    ),
    "read_month": with_(
        """SELECT CAST(row_number() OVER (ORDER BY client_name) AS INTEGER) AS client_identifier,
    client_name, (SELECT strftime(max(nav_date), '%Y%m') FROM sparse) AS yyyymm
    FROM (SELECT DISTINCT client_name FROM sparse)""",
        SPARSE,
    ),
    "csv_report": with_(
        f"SELECT {shown(SHORT_COLUMNS, TIMES)} FROM short", SPARSE, *short_profile("sparse")
    ),
    "report_view": with_(
        "SELECT client_name, count(*) AS funds, max(predicted_time) AS latest FROM short "
        "GROUP BY client_name",
        SPARSE,
        *short_profile("sparse"),
    ),
}
