"""The same queries as SQL over the same tables."""

from __future__ import annotations

D = """d AS (
  SELECT l_returnflag || '_' || l_linestatus AS id, l_returnflag AS item_id, l_linestatus AS store_id,
         CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS sales
  FROM lineitem GROUP BY ALL)"""

P = """p AS (
  SELECT p_brand || '_' || r_name AS id, p_brand AS item_id, r_name AS store_id,
         CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS sales
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""

SPAN = """span AS (
  SELECT MIN(CAST(l_shipdate AS DATE)) AS first, MAX(CAST(l_shipdate AS DATE)) AS last FROM lineitem)"""

C = """c AS (
  SELECT 'd_' || (day - first + 1) AS d, CAST(day AS VARCHAR) AS date, day,
         CASE WHEN day(day) <= 10 THEN '1' ELSE '0' END AS snap_CA,
         CASE WHEN day(day) % 2 = 1 THEN '1' ELSE '0' END AS snap_TX,
         CASE WHEN day(day) % 3 = 0 THEN '1' ELSE '0' END AS snap_WI
  FROM (SELECT CAST(UNNEST(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS day, first FROM span))"""

# One cell per series and day, NULL where nothing was shipped: the wide table, melted.
CELLS = """cells AS (
  SELECT k.id, k.item_id, 'dept_' || k.item_id AS dept_id, 'cat' AS cat_id, k.store_id,
         'state_' || k.store_id AS state_id, c.d, c.day, d.sales
  FROM (SELECT DISTINCT id, item_id, store_id FROM d) k CROSS JOIN c
       LEFT JOIN d ON d.id = k.id AND d.date = c.day)"""

E = """e AS (
  SELECT user_id, CAST(ts AS DATE) AS day, CAST(MAX(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS INTEGER) AS event
  FROM events GROUP BY ALL)"""

DAY_NUMBER = "date_diff('day', DATE '1970-01-01', {date})"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def months_between(a: str, b: str) -> str:
    months = f"((year({a}) - year({b})) * 12 + month({a}) - month({b}))"
    return (
        f"CASE WHEN day({a}) = day({b}) OR ({a} = last_day({a}) AND {b} = last_day({b})) THEN CAST({months} AS DOUBLE) "
        f"ELSE round({months} + (day({a}) - day({b})) / 31.0::DOUBLE, 8) END"
    )


SQL_FUNCTIONS = {
    "mean": "avg",
    "std": "stddev_samp",
    "var": "var_samp",
    "stddev_pop": "stddev_pop",
    "var_pop": "var_pop",
    "min": "min",
    "max": "max",
    "sum": "sum",
    "count": "count",
}


def rolled(
    prefix, windows, lags, functions=("mean", "std"), *, by="item_id, store_id", value="sales", order=None, unit=1, digits=6
) -> str:
    """The columns of rolling features over a relation with a ``date``."""
    order = DAY_NUMBER.format(date="date") if order is None else order
    partition = f"PARTITION BY {by} " if by else ""
    cols = []
    for w in windows:
        for lag in lags:
            for f in functions:
                frame = f"RANGE BETWEEN {unit * (lag + w - 1)} PRECEDING AND {unit * lag} PRECEDING"
                agg = f"{SQL_FUNCTIONS[f]}({value}) OVER ({partition}ORDER BY {order} {frame})"
                agg = f"CAST({agg} AS BIGINT)" if f == "count" else f"round({agg}, {digits})"
                cols.append(f"{agg} AS {prefix}_window_{w}_lag_{lag}_{f}")
    return ",\n  ".join(cols)


DATE_PARTS = {
    "day_of_week": "dayofweek(date) + 1",
    "day_of_year": "dayofyear(date)",
    "day_of_month": "day(date)",
    "week_of_year": "weekofyear(date)",
    "week_of_month": "ceil((day(date) + dayofweek(date_trunc('month', date))) / 7.0)",
    "month": "month(date)",
    "quarter": "quarter(date)",
    "year": "year(date)",
}


def parts(names, outputs=None) -> str:
    return ", ".join(f"CAST({DATE_PARTS[n]} AS BIGINT) AS {o}" for n, o in zip(names, outputs or names))


SERIES = "id, item_id, store_id"
DATE = "CAST(date AS VARCHAR) AS date"


def future(step: str) -> str:
    """History and 28 periods after the last day of all series; ``step`` moves ``m`` by ``i``."""
    return (
        with_(D)
        + f"""SELECT {SERIES}, {DATE}, sales FROM d
UNION ALL
SELECT {SERIES}, CAST({step} AS VARCHAR), NULL
FROM (SELECT DISTINCT {SERIES} FROM d), (SELECT MAX(date) AS m FROM d), range(1, 29) t(i)"""
    )


def proximity(distance_next: str, distance_last: str, window: int) -> str:
    return (
        with_(
            E,
            """n AS (
  SELECT *,
    MIN(CASE WHEN event = 1 THEN day END) OVER (PARTITION BY user_id ORDER BY day
        RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next,
    MAX(CASE WHEN event = 1 THEN day END) OVER (PARTITION BY user_id ORDER BY day
        RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last
  FROM e)""",
            f"g AS (SELECT *, {distance_next} AS ahead, {distance_last} AS behind FROM n)",
        )
        + f"""SELECT user_id, CAST(day AS VARCHAR) AS day, CAST(event AS BIGINT) AS event,
  greatest(CASE WHEN ahead <= {window} THEN ahead END, CASE WHEN behind >= -{window} THEN behind END) AS nearest
FROM g"""
    )


def split(n_splits, horizon, *, step, offset=0, size=None, move="{} - {}::INT") -> str:
    """Tagged rows of the flag panel; ``move`` takes a date some units back."""
    furthest = max(horizon)
    end = move.format("m", f"(i * {step} + {offset + furthest})")
    after = f"AND date > {move.format('te', size)}" if size else ""
    tests = ", ".join(move.format("te", f"(-{h})") for h in horizon)
    return (
        with_(D, f"f AS (SELECT i, CAST({end} AS DATE) AS te FROM (SELECT MAX(date) AS m FROM d), range({n_splits}) t(i))")
        + f"""SELECT id, {DATE}, CAST(i AS BIGINT) AS fold, 'train' AS role FROM d, f WHERE date <= te {after}
UNION ALL
SELECT id, {DATE}, CAST(i AS BIGINT) AS fold, 'test' AS role FROM d, f WHERE date IN ({tests})"""
    )


def lagged(*lags: int) -> str:
    cols = ", ".join(
        f"avg(sales) OVER (PARTITION BY item_id, store_id ORDER BY {DAY_NUMBER.format(date='date')} "
        f"RANGE BETWEEN {lag + 6} PRECEDING AND {lag} PRECEDING) AS lag_{lag}"
        for lag in lags
    )
    return f"x AS (SELECT *, {cols} FROM d)"


FOLDS = "f AS (SELECT i, CAST(m - ((i + 1) * 28)::INT AS DATE) AS te FROM (SELECT MAX(date) AS m FROM d), range(2) t(i))"
BOUNDS = "b AS (SELECT i, te, MIN(date) AS train_start, MAX(date) AS train_end FROM f JOIN d ON date <= te GROUP BY i, te)"
FORECASTS = (
    D,
    lagged(28),
    FOLDS,
    BOUNDS,
    """fc AS (
  SELECT id, date, sales, lag_28 AS forecast, CAST(i AS BIGINT) AS cv, train_start, train_end
  FROM x JOIN b ON date > te AND date <= te + 28)""",
)
FORECAST_COLUMNS = f"""SELECT id, {DATE}, sales, round(forecast, 6) AS forecast, cv,
  CAST(train_start AS VARCHAR) AS train_start, CAST(train_end AS VARCHAR) AS train_end FROM fc"""

SUMMARY = """s AS (
  SELECT cv, MIN(train_start) AS train_start, MAX(train_end) AS train_end, MIN(date) AS forecast_start,
         MAX(date) AS forecast_end, sqrt(avg((sales - forecast) ** 2)) AS rmse, COUNT(*) AS n_rows,
         COUNT(CASE WHEN sales IS NOT NULL AND forecast IS NOT NULL THEN 1 END) AS n_scored
  FROM fc GROUP BY cv)"""

PIVOT = """pv AS (
  SELECT id, date, avg(forecast) FILTER (cv = 0) AS cv_0, avg(forecast) FILTER (cv = 1) AS cv_1
  FROM fc WHERE forecast IS NOT NULL GROUP BY id, date)"""

PANEL = """panel AS (
  SELECT coalesce(cells.id, pv.id) AS id, item_id, dept_id, cat_id, store_id, state_id, d, sales,
         coalesce(day, pv.date) AS date, cv_0, cv_1
  FROM cells FULL JOIN pv ON cells.id = pv.id AND cells.day = pv.date)"""

LINES = """l AS (
  SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_shipdate AS DATE) AS date, l_quantity,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge
  FROM lineitem)"""

ORDERS = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day
FROM orders"""

CUSTOMER_ORDERS = "(SELECT o_orderkey, o_custkey AS c_custkey, o_totalprice FROM orders)"
EVENT_USERS = "(SELECT user_id AS c_custkey FROM events)"
DAILY_ORDERS = "(SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n_orders FROM orders GROUP BY 1)"
DAILY_LINES = "(SELECT CAST(l_shipdate AS DATE) AS day, SUM(l_quantity) AS qty FROM lineitem GROUP BY 1)"

# Straight lines per horizon block and fold.
LINE_FORECASTS = """(
  SELECT x.id, x.date, x.sales, slope * {lag} + icept AS forecast, CAST(i AS BIGINT) AS cv, train_start, train_end
  FROM (SELECT i, te, train_start, train_end, regr_slope(sales, {lag}) AS slope, regr_intercept(sales, {lag}) AS icept
        FROM x JOIN b ON date <= te GROUP BY ALL) w
       JOIN x ON x.date > te + {low} AND x.date <= te + {high})"""


def line_forecasts() -> str:
    return " UNION ALL ".join(
        LINE_FORECASTS.format(lag=f"lag_{7 * i}", low=7 * (i - 1), high=7 * i) for i in (1, 2, 3, 4)
    )


MULTI = (D, lagged(7, 14, 21, 28), FOLDS, BOUNDS, f"fc AS ({line_forecasts()})")

WINDOWS, LAGS = (7, 15, 30, 90, 180), (7, 14, 21, 28)

WEEKDAYS = "y AS (SELECT *, dayofweek(date) AS weekday, dayofweek(date) IN (0, 6) AS weekend FROM d)"


def fitted_groups(by: str, forecast: str) -> str:
    """Forecasts of each fold by group, from the count and sum of its training rows."""
    return f"""g AS (SELECT i, te, train_start, train_end, {by}, COUNT(*) AS n, SUM(sales) AS s FROM y JOIN b ON date <= te GROUP BY ALL),
fc AS (SELECT y.id, y.date, y.sales, {forecast} AS forecast, CAST(i AS BIGINT) AS cv, train_start, train_end
  FROM g JOIN y ON y.{by} = g.{by} AND y.date > te AND y.date <= te + 28)"""


PERIODS = (("week", "(m + 7 * i::INT)::DATE", "week"), ("month", "(m + to_months(i::INT))::DATE", "month"))


def final_fit_at(unit: str, step: str, part: str) -> str:
    """Sums by week or month, the two periods before a lag, and a straight line for each of two horizons."""
    order = "date_diff('day', DATE '1970-01-01', date)" if unit == "week" else "year(date) * 12 + month(date)"
    days = 7 if unit == "week" else 1
    lag = lambda n: (
        f"avg(sales) OVER (PARTITION BY item_id, store_id ORDER BY {order} "
        f"RANGE BETWEEN {days * (n + 1)} PRECEDING AND {days * n} PRECEDING) AS lag_{n}"
    )
    shift = step.replace("m +", "m.m +")
    return with_(
        D,
        f"w AS (SELECT id, item_id, store_id, CAST(date_trunc('{part}', date) AS DATE) AS date, SUM(sales) AS sales FROM d GROUP BY ALL)",
        "m AS (SELECT MAX(date) AS m FROM w)",
        f"""a AS (SELECT * FROM w UNION ALL
  SELECT k.*, {shift}, NULL FROM (SELECT DISTINCT id, item_id, store_id FROM w) k, m, range(1, 5) t(i))""",
        f"x AS (SELECT *, {lag(2)}, {lag(4)} FROM a)",
    ) + " UNION ALL ".join(
        f"""SELECT id, {DATE}, '{name}' AS model, round(slope * lag_{n} + icept, 6) AS forecast
FROM x, (SELECT regr_slope(sales, lag_{n}) AS slope, regr_intercept(sales, lag_{n}) AS icept FROM x)
WHERE date IN (SELECT {shift} FROM m, range({n - 1}, {n + 1}) t(i))"""
        for name, n in (("near", 2), ("far", 4))
    )


SQL: dict[str, str] = {
    "select_columns": "SELECT l_orderkey AS L_OrderKey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_returnflag FROM lineitem",
    "cast_columns": """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  CAST(TRY_CAST(CASE WHEN l_linestatus = 'O' THEN 'x' ELSE '' END || l_quantity AS FLOAT) AS DOUBLE) AS qty,
  CAST(l_suppkey AS VARCHAR) AS supplier, CAST(CAST(l_suppkey AS FLOAT) AS DOUBLE) AS supplier_number
FROM lineitem""",
    "parse_dates": """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, shipped,
  CAST(CAST(try_strptime(shipped, '%Y-%m-%d') AS DATE) AS VARCHAR) AS day
FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN strftime(l_shipdate, '%Y/%m/%d')
                     ELSE strftime(l_shipdate, '%Y-%m-%d') END AS shipped FROM lineitem)""",
    "parquet_scan_cutoff": """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_totalprice
FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'""",
    "filter_dimensions": with_(P) + f"SELECT {SERIES}, {DATE}, sales FROM p WHERE item_id IN ('Brand#2', 'Brand#17')",
    "dimension_members": with_(P) + "SELECT DISTINCT item_id FROM p",
    "parquet_roundtrip": ORDERS,
    "csv_string_scan": """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
  CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS VARCHAR) AS o_totalprice, o_orderpriority,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day
FROM orders""",
    "csv_typed_scan": ORDERS,
    "csv_roundtrip": with_(*FORECASTS) + FORECAST_COLUMNS,
    "checkpoint_passthrough": ORDERS,
    "join_inner": f"SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer JOIN {CUSTOMER_ORDERS} USING (c_custkey)",
    "join_left": f"SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer LEFT JOIN {CUSTOMER_ORDERS} USING (c_custkey)",
    "join_right": f"SELECT CAST(day AS VARCHAR) AS day, n_orders, qty FROM {DAILY_ORDERS} RIGHT JOIN {DAILY_LINES} USING (day)",
    "join_full": f"SELECT CAST(day AS VARCHAR) AS day, n_orders, qty FROM {DAILY_ORDERS} FULL JOIN {DAILY_LINES} USING (day)",
    "join_semi": f"SELECT c_custkey, c_mktsegment FROM customer SEMI JOIN {EVENT_USERS} USING (c_custkey)",
    "join_anti": f"SELECT c_custkey, c_mktsegment FROM customer ANTI JOIN {EVENT_USERS} USING (c_custkey)",
    "join_calendar": with_(D, SPAN, C, CELLS)
    + """SELECT cells.d, id, item_id, store_id, CAST(CAST(sales AS BIGINT) AS VARCHAR) AS sales, c.date AS day, snap_CA
FROM cells LEFT JOIN c ON cells.d = c.d""",
    "melt_listed": with_(D, SPAN, C, CELLS)
    + f"SELECT {SERIES}, d, CAST(CAST(sales AS BIGINT) AS VARCHAR) AS sales FROM cells",
    "melt_rest": with_(D, SPAN, C, CELLS)
    + """SELECT id, item_id, dept_id, cat_id, store_id, state_id, d, CAST(CAST(sales AS BIGINT) AS VARCHAR) AS sales
FROM cells""",
    "pivot_fold_forecasts": with_(*FORECASTS, PIVOT)
    + f"SELECT id, {DATE}, round(cv_0, 6) AS cv_0, round(cv_1, 6) AS cv_1 FROM pv",
    "date_features": with_(D) + f"SELECT {SERIES}, {DATE}, sales, {parts(DATE_PARTS)} FROM d",
    "date_features_renamed": with_(D)
    + f"SELECT {SERIES}, {DATE}, sales, {parts(['month', 'quarter', 'year'], ['m', 'q', 'y'])} FROM d",
    "future_day": future("m + i::INT"),
    "future_week": future("m + 7 * i::INT"),
    "future_month": future("(m + to_months(i::INT))::DATE"),
    "future_per_group": with_(D)
    + f"""SELECT {SERIES}, {DATE}, sales FROM d
UNION ALL
SELECT {SERIES}, CAST(m + i::INT AS VARCHAR), NULL
FROM (SELECT {SERIES}, MAX(date) AS m FROM d GROUP BY ALL), range(1, 29) t(i)""",
    "future_no_group": f"""SELECT CAST(day AS VARCHAR) AS day, qty FROM {DAILY_LINES}
UNION ALL
SELECT CAST(m + i::INT AS VARCHAR), NULL FROM (SELECT MAX(day) AS m FROM {DAILY_LINES}), range(1, 29) t(i)""",
    "densify": with_(P, SPAN)
    + f"""SELECT k.item_id, k.store_id, CAST(CAST(g.day AS DATE) AS VARCHAR) AS date, coalesce(p.sales, 0) AS sales
FROM (SELECT DISTINCT item_id, store_id FROM p) k
     CROSS JOIN (SELECT UNNEST(generate_series(first, last, INTERVAL 1 DAY)) AS day FROM span) g
     LEFT JOIN p ON p.item_id = k.item_id AND p.store_id = k.store_id AND p.date = g.day""",
    "encode_day": with_(P) + f"SELECT {SERIES}, {DATE}, sales, {rolled('r', [7, 30], [7, 28])} FROM p",
    "encode_week": with_(P) + f"SELECT {SERIES}, {DATE}, sales, {rolled('r', [2, 8], [1, 4], unit=7)} FROM p",
    "encode_month": with_(D, f"q AS (SELECT *, {months_between('date', 'm')} AS period FROM d, (SELECT MIN(date) AS m FROM d))")
    + f"SELECT {SERIES}, {DATE}, sales, {rolled('r', [1, 3], [1, 2], order='period')} FROM q",
    "encode_coarse": with_(LINES)
    + f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, {DATE}, l_quantity,
  {rolled('r', [7, 30], [1, 7], by='l_returnflag', value='l_quantity')}
FROM l""",
    "encode_price": with_(LINES)
    + f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  {rolled('r', [30], [7], by='l_returnflag', value='charge', digits=4)}
FROM l""",
    "encode_no_partition": with_(LINES)
    + f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, {DATE}, l_quantity,
  {rolled('r', [7, 30], [1], by='', value='l_quantity')}
FROM l""",
    "encode_functions": with_(D)
    + f"""SELECT {SERIES}, {DATE}, sales,
  {rolled('r', [7], [7], ['mean', 'std', 'min', 'max', 'sum', 'count', 'var', 'stddev_pop', 'var_pop'])}
FROM d""",
    "event_proximity_day": proximity(
        "CAST(date_diff('day', day, next) AS BIGINT)", "CAST(date_diff('day', day, last) AS BIGINT)", 3
    ),
    "event_proximity_week": proximity(
        "round(date_diff('day', day, next) / 7.0::DOUBLE, 6)", "round(date_diff('day', day, last) / 7.0::DOUBLE, 6)", 1
    ),
    "event_proximity_month": proximity(
        f"round({months_between('next', 'day')}, 6)", f"round({months_between('last', 'day')}, 6)", 1
    ),
    "event_proximity_ties": with_(
        """r AS (
  SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_type = 'purchase' AS bought, event_type = 'error' AS failed
  FROM events)""",
        "n AS (SELECT *, "
        + ", ".join(
            f"""date_diff('day', day, MIN(CASE WHEN {c} THEN day END) OVER (PARTITION BY user_id ORDER BY day
        RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}_ahead,
    date_diff('day', day, MAX(CASE WHEN {c} THEN day END) OVER (PARTITION BY user_id ORDER BY day
        RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS {c}_behind"""
            for c in ("bought", "failed")
        )
        + " FROM r)",
    )
    + "SELECT event_id, user_id, CAST(day AS VARCHAR) AS day, "
    + ", ".join(
        f"""CAST(greatest(CASE WHEN {c}_ahead <= 2 THEN {c}_ahead END, CASE WHEN {c}_behind >= -2 THEN {c}_behind END)
  AS BIGINT) AS {c}"""
        for c in ("bought", "failed")
    )
    + " FROM n",
    "calendar_table": with_(SPAN, C)
    + 'SELECT d, date, snap_CA AS "Snap_CA", snap_TX AS "Snap_TX", snap_WI AS "Snap_WI" FROM c',
    "feature_table": with_(
        D,
        SPAN,
        C,
        CELLS,
        """a AS (
  SELECT cells.d, id, item_id, dept_id, cat_id, store_id, state_id, sales, cells.day AS date, snap_CA, snap_TX, snap_WI
  FROM cells JOIN c ON cells.d = c.d
  UNION ALL
  SELECT NULL, id, item_id, dept_id, cat_id, store_id, state_id, NULL, last + i::INT, NULL, NULL, NULL
  FROM (SELECT DISTINCT id, item_id, dept_id, cat_id, store_id, state_id FROM cells), span, range(1, 29) t(i))""",
    )
    + f"""SELECT d, id, item_id, dept_id, cat_id, store_id, state_id, sales, {DATE},
  snap_CA AS "Snap_CA", snap_TX AS "Snap_TX", snap_WI AS "Snap_WI",
  {rolled('item_store', WINDOWS, LAGS)},
  {parts(['day_of_week', 'day_of_month', 'week_of_year', 'week_of_month', 'month', 'year'])}
FROM a""",
    "minimum_slice": with_(
        D,
        f"""a AS (
  SELECT {SERIES}, date, sales FROM d
  UNION ALL
  SELECT {SERIES}, m + i::INT, NULL FROM (SELECT DISTINCT {SERIES} FROM d), (SELECT MAX(date) AS m FROM d), range(1, 29) t(i))""",
    )
    + f"""SELECT {SERIES}, {DATE}, sales, {rolled('r', [7, 30], [7, 28])},
  {parts(['day_of_week', 'week_of_month', 'month', 'year'])}
FROM a""",
    "cv_split_expanding": split(3, range(1, 8), step=7),
    "cv_split_sliding": split(3, range(1, 8), step=7, size=90),
    "cv_split_gap": split(3, [8, 11, 14], step=28, offset=14),
    "cv_split_month": split(3, [1, 2], step=2, size=12, move="CAST({} - to_months(({})::INT) AS DATE)"),
    "cv_split_hour": """WITH h AS (SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour FROM events),
f AS (SELECT i, m - to_hours((i * 6 + 6)::INT) AS te FROM (SELECT MAX(hour) AS m FROM h), range(2) t(i))
SELECT event_id, CAST(hour AS VARCHAR) AS hour, CAST(i AS BIGINT) AS fold, 'train' AS role
FROM h, f WHERE hour <= te AND hour > te - to_hours(48)
UNION ALL
SELECT event_id, CAST(hour AS VARCHAR), CAST(i AS BIGINT), 'test'
FROM h, f WHERE hour IN (te + to_hours(1), te + to_hours(2), te + to_hours(3), te + to_hours(6))""",
    "cv_forecast_passthrough": with_(*FORECASTS) + FORECAST_COLUMNS,
    "cv_forecast_ols": with_(
        D, lagged(28), FOLDS, BOUNDS, f"fc AS ({LINE_FORECASTS.format(lag='lag_28', low=0, high=28)})"
    )
    + FORECAST_COLUMNS,
    "cv_direct_multi_horizon": with_(*MULTI) + FORECAST_COLUMNS,
    # Trees deep enough put each weekday into a leaf: its mean under squared loss, and under Tweedie loss a Newton
    # step from its count and sum in each of 100 rounds. A straight line over a 0/1 feature gives two means.
    "cv_forecast_gbt": with_(D, FOLDS, BOUNDS, WEEKDAYS, fitted_groups("weekday", "s / n")) + FORECAST_COLUMNS,
    "cv_forecast_tweedie": "WITH RECURSIVE "
    + with_(
        D,
        FOLDS,
        BOUNDS,
        WEEKDAYS,
        """g AS (SELECT *, SUM(s) OVER (PARTITION BY i) / SUM(n) OVER (PARTITION BY i) AS mean
        FROM (SELECT i, te, train_start, train_end, weekday, COUNT(*)::DOUBLE AS n, SUM(sales)::DOUBLE AS s
              FROM y JOIN b ON date <= te GROUP BY ALL))""",
        """r AS (
  SELECT i, weekday, 0 AS round, ln(mean)::DOUBLE AS score FROM g
  UNION ALL
  SELECT r.i, r.weekday, round + 1, score + 0.1::DOUBLE * (s * exp(-0.5::DOUBLE * score) - n * exp(0.5::DOUBLE * score))
    / (0.5::DOUBLE * n * exp(0.5::DOUBLE * score) + 0.5::DOUBLE * s * exp(-0.5::DOUBLE * score))
  FROM r JOIN g ON r.i = g.i AND r.weekday = g.weekday WHERE round < 100)""",
        """fc AS (SELECT y.id, y.date, y.sales, exp(score) AS forecast, CAST(g.i AS BIGINT) AS cv, train_start, train_end
  FROM r JOIN g ON r.i = g.i AND r.weekday = g.weekday AND round = 100 JOIN y ON y.weekday = g.weekday AND y.date > te AND y.date <= te + 28)""",
    ).removeprefix("WITH ")
    + FORECAST_COLUMNS,
    "cv_forecast_tweedie_linear": with_(D, FOLDS, BOUNDS, WEEKDAYS, fitted_groups("weekend", "s / n"))
    + FORECAST_COLUMNS.replace("round(forecast, 6)", "round(forecast, 4)"),
    "final_fit_predict": with_(
        D,
        "m AS (SELECT MAX(date) AS m FROM d)",
        f"""a AS (
  SELECT * FROM d
  UNION ALL
  SELECT {SERIES}, m + i::INT, NULL FROM (SELECT DISTINCT {SERIES} FROM d), m, range(1, 29) t(i))""",
        lagged(7, 14, 21, 28).replace("FROM d", "FROM a"),
    )
    + " UNION ALL ".join(
        f"""SELECT id, {DATE}, 'week_{i}' AS model, round(slope * lag_{7 * i} + icept, 6) AS forecast
FROM x, m, (SELECT regr_slope(sales, lag_{7 * i}) AS slope, regr_intercept(sales, lag_{7 * i}) AS icept FROM x)
WHERE date > m + {7 * i - 7} AND date <= m + {7 * i}"""
        for i in (1, 2, 3, 4)
    ),
    "stacked_predictions": with_(
        D,
        lagged(28),
        """y AS (SELECT *, avg(sales) OVER (PARTITION BY item_id, store_id ORDER BY date_diff('day', DATE '1970-01-01', date)
           RANGE BETWEEN 57 PRECEDING AND 28 PRECEDING) AS month_28 FROM x)""",
        FOLDS,
        """w AS (SELECT i, te, regr_slope(sales, lag_28) AS s1, regr_intercept(sales, lag_28) AS i1,
                   regr_slope(sales, month_28) AS s2, regr_intercept(sales, month_28) AS i2 FROM y JOIN f ON date <= te GROUP BY i, te)""",
    )
    + f"""SELECT id, {DATE}, sales, CAST(i AS BIGINT) AS cv, round(lag_28, 6) AS pred_1, round(s1 * lag_28 + i1, 6) AS pred_2,
  round(s2 * month_28 + i2, 6) AS pred_3
FROM y JOIN w ON date > te AND date <= te + 28""",
    **{f"final_fit_predict_{unit}": final_fit_at(unit, step, days) for unit, step, days in PERIODS},
    "rmse_global": with_(*FORECASTS) + "SELECT round(sqrt(avg((sales - forecast) ** 2)), 6) AS rmse FROM fc",
    "fold_summary": with_(*FORECASTS, SUMMARY)
    + """SELECT cv, CAST(train_start AS VARCHAR) AS train_start, CAST(train_end AS VARCHAR) AS train_end,
  CAST(forecast_start AS VARCHAR) AS forecast_start, CAST(forecast_end AS VARCHAR) AS forecast_end,
  round(rmse, 6) AS rmse, n_rows, n_scored FROM s""",
    "rmse_mean_of_folds": with_(*FORECASTS, SUMMARY) + "SELECT round(avg(rmse), 6) AS rmse FROM s",
    "rmse_by_fold_column": with_(*FORECASTS, SUMMARY)
    + """SELECT 'cv_' || cv AS fold, round(rmse, 3) AS rmse FROM s
UNION ALL SELECT 'mean', round(avg(rmse), 3) FROM s""",
    "runlog_append": with_(*FORECASTS, SUMMARY)
    + """SELECT 'first' AS run_id, cv, n_rows, round(rmse, 6) AS rmse, round(avg(rmse) OVER (), 6) AS mean_rmse FROM s""",
    "runlog_unscored": with_(*FORECASTS) + "SELECT 'second' AS run_id, COUNT(*) AS n_rows FROM fc",
    "logged_backtest": with_(*MULTI, SUMMARY)
    + """SELECT 'run' AS run_id, cv, CAST(train_start AS VARCHAR) AS train_start, CAST(train_end AS VARCHAR) AS train_end,
  CAST(forecast_start AS VARCHAR) AS forecast_start, CAST(forecast_end AS VARCHAR) AS forecast_end, n_rows,
  round(rmse, 6) AS rmse FROM s""",
    "dash_panel": with_(*FORECASTS, PIVOT, SPAN, C, CELLS, PANEL)
    + f"""SELECT id, item_id, dept_id, cat_id, store_id, state_id, d, sales, {DATE},
  round(cv_0, 6) AS cv_0, round(cv_1, 6) AS cv_1 FROM panel""",
    "dash_series_by_date": with_(*FORECASTS, PIVOT, SPAN, C, CELLS, PANEL)
    + f"""SELECT {DATE}, SUM(sales) AS sales, round(SUM(cv_0), 6) AS cv_0, round(SUM(cv_1), 6) AS cv_1
FROM panel WHERE item_id IN ('A', 'R') GROUP BY panel.date""",
}
