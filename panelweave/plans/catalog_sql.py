"""The catalogue in plain SQL, for comparison on another engine."""

from __future__ import annotations

KEY = "station, rate, pollutant, ts"
W = "(PARTITION BY station, rate, pollutant ORDER BY ts)"


def hourly(stations: int = 2, files: int = 0) -> str:
    part = f", CAST(user_id % {files} AS INT) AS file_seq" if files else ""
    return f"""SELECT 'ST' || CAST(user_id % {stations} AS VARCHAR) AS station, 'H' AS rate, event_type AS pollutant,
      date_trunc('hour', ts) AS ts{part}, SUM(CAST(ROUND(value * 100) AS BIGINT))::DOUBLE / 100::DOUBLE / COUNT(value) AS value
      FROM events GROUP BY ALL"""


DAILY = """SELECT 'ST0' AS station, 'D' AS rate, o_orderpriority AS pollutant, o_orderdate + INTERVAL 23 HOUR AS ts,
      SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT))::DOUBLE / 100::DOUBLE / COUNT(o_totalprice) AS value
      FROM orders GROUP BY ALL"""


def _cents(col: str, scale: str = "100") -> str:
    return f"SUM(CAST(ROUND({col} * 100) AS BIGINT))::DOUBLE / {scale}::DOUBLE / COUNT({col})"


EVALUATION = f"""SELECT *, NOT direct AS timebased FROM (SELECT 'ST' || CAST(l_suppkey % 10 AS VARCHAR) AS station,
      CASE WHEN l_linestatus = 'O' THEN 'H' ELSE 'D' END AS rate, l_returnflag AS pollutant,
      CAST(l_quantity AS INT) % 7 + 1 AS distance, l_orderkey % 3 = 0 AS differenced, l_orderkey % 2 = 0 AS direct,
      (l_orderkey % 2 = 0 AND l_partkey % 2 = 0) AS artificial, 'm' || CAST(l_linenumber AS VARCHAR) AS model,
      {_cents('l_quantity')} AS fit_time, {_cents('l_tax')} AS prediction_time,
      {_cents('l_extendedprice')} AS mean_squared_error, {_cents('l_extendedprice', '69997')} AS norm_mean_squared_error,
      {_cents('l_quantity', '2999')} AS norm_mean_absolute_error, {_cents('l_discount', '71')} AS norm_median_absolute_error
      FROM lineitem GROUP BY ALL)"""


def grid(points: str, step: str, floor_to: str) -> str:
    """CTEs ``cells`` (grid with empty cells), ``filled`` (interpolated) and ``g`` (aligned) over ``m`` and ``points``."""
    return f"""rng AS (SELECT station, rate, date_trunc('{floor_to}', MIN(ts)) AS lo, date_trunc('{floor_to}', MAX(ts)) AS hi FROM m GROUP BY ALL),
    labels AS (SELECT station, rate, UNNEST(generate_series(lo, hi, INTERVAL 1 {step})) AS ts FROM rng),
    points AS ({points}),
    cells AS (SELECT l.station, l.rate, k.pollutant, l.ts, p.value FROM labels l
      JOIN (SELECT DISTINCT station, rate, pollutant FROM m) k USING (station, rate)
      LEFT JOIN points p ON p.station = l.station AND p.rate = l.rate AND p.pollutant = k.pollutant AND p.ts = l.ts),
    marked AS (SELECT *, CASE WHEN value IS NOT NULL THEN epoch(ts) END AS x FROM cells),
    near AS (SELECT *,
      last_value(x IGNORE NULLS) OVER before_ AS px, last_value(value IGNORE NULLS) OVER before_ AS pv,
      first_value(x IGNORE NULLS) OVER after_ AS nx, first_value(value IGNORE NULLS) OVER after_ AS nv FROM marked
      WINDOW before_ AS (PARTITION BY station, rate, pollutant ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             after_ AS (PARTITION BY station, rate, pollutant ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    filled AS (SELECT {KEY}, CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv
      ELSE pv + (nv - pv) * ((epoch(ts) - px) / (nx - px)) END AS value FROM near),
    begun AS (SELECT station, rate, MAX(f) AS start FROM
      (SELECT station, rate, pollutant, MIN(CASE WHEN value IS NOT NULL THEN ts END) AS f FROM filled GROUP BY ALL)
      GROUP BY ALL HAVING COUNT(*) = COUNT(f)),
    g AS (SELECT f.* FROM filled f JOIN begun b USING (station, rate) WHERE f.ts >= b.start)"""


def hourly_grid(stations: int = 2) -> str:
    return f"WITH m AS ({hourly(stations)}), {grid('SELECT * FROM m WHERE value IS NOT NULL', 'HOUR', 'hour')}"


DAILY_POINTS = """SELECT m.station, m.rate, m.pollutant, c.ts, m.value FROM
      (SELECT l.station, l.rate, l.ts, MIN(r.ts) AS t FROM labels l JOIN (SELECT DISTINCT station, rate, ts FROM m) r
        ON r.station = l.station AND r.rate = l.rate AND r.ts >= l.ts AND r.ts <= l.ts + INTERVAL 1 DAY GROUP BY ALL) c
      JOIN m ON m.station = c.station AND m.rate = c.rate AND m.ts = c.t WHERE m.value IS NOT NULL"""
DAILY_GRID = f"WITH m AS ({DAILY}), {grid(DAILY_POINTS, 'DAY', 'day')}"

G = hourly_grid()
VALUE = "ROUND(value, 6) AS value"
NUMBERED = (f"pos AS (SELECT *, ROW_NUMBER() OVER {W} - 1 AS pos, COUNT(*) OVER (PARTITION BY station, rate, pollutant) AS n "
            "FROM g)")


def _lags(n: int) -> str:
    return ", ".join(f"LAG(value, {i - 1}) OVER w AS lag_{i}" for i in range(1, n + 1))


def _lag_list(n: int) -> str:
    return "list_filter([" + ", ".join(f"lag_{i}" for i in range(1, n + 1)) + "], lambda v: v IS NOT NULL)"


LAG24 = f"lags AS (SELECT *, {_lags(24)} FROM g WINDOW w AS {W})"


def _score_sql(horizon: int) -> str:
    return f"""{G}, f AS (SELECT *, LAG(value, {horizon}) OVER {W} AS predicted,
      ROW_NUMBER() OVER (PARTITION BY station, rate, pollutant ORDER BY ts DESC) AS rev FROM g),
    e AS (SELECT *, value AS y, value - predicted AS err FROM f WHERE rev <= 24 AND predicted IS NOT NULL),
    s AS (SELECT station, rate, pollutant, AVG(err * err) AS mean_squared_error, AVG(ABS(err)) AS mean_absolute_error,
      MEDIAN(ABS(err)) AS median_absolute_error, 1 - SUM(err * err) / (VAR_POP(y) * COUNT(*)) AS r2,
      1 - VAR_POP(err) / VAR_POP(y) AS explained_variance FROM e GROUP BY ALL)"""


SCORES = ["mean_squared_error", "mean_absolute_error", "median_absolute_error", "r2", "explained_variance"]
_ROUNDED_SCORES = ", ".join(f"ROUND({s}, 6) AS {s}" for s in SCORES)


def _stats(keys: str, measures: list[str], frame: str = "ev", where: str = "") -> str:
    cols = ", ".join(f"ROUND({fn}({m}), 6) AS {m}_{name}" for m in measures
                     for name, fn in (("mean", "AVG"), ("median", "MEDIAN"), ("min", "MIN"), ("max", "MAX")))
    return f"SELECT {keys}, {cols} FROM {frame} {where} GROUP BY ALL"


EV = f"WITH ev AS ({EVALUATION})"
TIMES = ["fit_time", "prediction_time"]
NORM = ["norm_median_absolute_error", "norm_mean_squared_error", "norm_mean_absolute_error"]
SETUP = "timebased, differenced, artificial"


def _best(keys: str, measure: str, label: str, frame: str = "ev") -> str:
    return (f"SELECT {keys}, {label}, {measure} FROM {frame} QUALIFY ROW_NUMBER() OVER (PARTITION BY {keys} "
            f"ORDER BY {measure} NULLS LAST, {label}) = 1")


WINNERS = f"{EV}, best AS ({_best(SETUP + ', rate, distance, station, pollutant', 'mean_squared_error', 'model')})"


def _wins(keys: str) -> str:
    return f"{WINNERS} SELECT {keys}, model, COUNT(mean_squared_error) AS best_mse_count FROM best GROUP BY ALL"


MEANS = f"""{EV}, means AS (SELECT {SETUP}, rate, pollutant, distance, model, ROUND(SUM(CAST(norm_mean_absolute_error AS DECIMAL(30, 12)))::DOUBLE / COUNT(norm_mean_absolute_error), 9) AS
      norm_mean_absolute_error_mean FROM ev GROUP BY ALL),
    best AS ({_best(SETUP + ', rate, pollutant, distance', 'norm_mean_absolute_error_mean', 'model', 'means')})"""

_FLAG = "CASE WHEN {0} THEN 'True' ELSE 'False' END"
RUN_NAME = ("station || '-' || rate || '-' || pollutant || '-distance=' || CAST(distance AS VARCHAR) || '-differenced=' || "
            + _FLAG.format("differenced") + " || '-direct=' || " + _FLAG.format("direct")
            + " || CASE WHEN direct THEN '-artificial=' || " + _FLAG.format("artificial") + " ELSE '' END || '.csv'")
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
POLLUTANTS = ["click", "error", "purchase", "signup", "view"]

_RAW = """SELECT 'ST' || CAST(user_id % 2 AS VARCHAR) AS station, 'H' AS rate, event_type AS pollutant,
      date_trunc('hour', ts) AS ts, user_id % 4 AS part, value FROM events WHERE event_id % 6 <> 0 AND event_id % 5 <> 0"""
_DIRECT_ROWS = """w AS (SELECT *, LAG(value, 1) OVER s AS l2, LAG(value, 2) OVER s AS l3, LEAD(value, 1) OVER s AS label
      FROM g WINDOW s AS (PARTITION BY station, rate, pollutant ORDER BY ts)),
    r AS (SELECT * FROM w WHERE l3 IS NOT NULL AND label IS NOT NULL)"""


def _sc(v: str) -> str:
    return f"ROUND(({v} - MIN({v}) OVER k) / (MAX({v}) OVER k - MIN({v}) OVER k) * 2 - 1, 6)"


_ROWS = f"""{hourly_grid(1)}, lags AS (SELECT *, {_lags(24)}, LEAD(value) OVER w AS label,
      ROW_NUMBER() OVER w AS rn FROM g WINDOW w AS {W}),
    feat AS (SELECT {KEY}, label, rn, [{', '.join(f'lag_{i}' for i in range(1, 25))}] AS v FROM lags WHERE rn > 24 AND label IS NOT NULL),
    rows_ AS (SELECT {KEY}, label, rn, MAX(rn) OVER (PARTITION BY station, rate, pollutant) - rn < 24 AS held,
      list_concat(v, [list_sum(v), 2 * list_sum(v) / 25, list_median(list_concat(v, [list_sum(v), 2 * list_sum(v) / 25]))]) AS f FROM feat)"""


def _pairs(test: str, train: str, extra: str = "") -> str:
    return f"""pairs AS (SELECT q.station, q.rate, q.pollutant, q.ts, q.label{extra}, t.label AS y, t.rn,
      list_distance(q.f, t.f) AS d FROM ({test}) q JOIN ({train}) t
      ON t.station = q.station AND t.rate = q.rate AND t.pollutant = q.pollutant)"""


_KNN = f"""{_ROWS}, {_pairs('SELECT * FROM rows_ WHERE held', 'SELECT * FROM rows_ WHERE NOT held')},
    top AS (SELECT * FROM pairs QUALIFY ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY d, rn) <= 5)"""

_KNN_CV = f"""{hourly_grid(1)}, wide AS (SELECT a.station, a.rate, a.pollutant, a.ts, a.value, list(b.value ORDER BY b.pollutant) AS f FROM g a JOIN g b
      ON a.station = b.station AND a.rate = b.rate AND a.ts = b.ts AND a.pollutant <> b.pollutant GROUP BY ALL),
    led AS (SELECT *, LEAD(value) OVER w AS label, ROW_NUMBER() OVER w AS rn FROM wide WINDOW w AS {W}),
    r AS (SELECT *, ROW_NUMBER() OVER {W} - 1 AS pos, COUNT(*) OVER (PARTITION BY station, rate, pollutant) AS n FROM led
      WHERE rn > 24 AND label IS NOT NULL),
    folds AS (SELECT *, n - (n // 4) * (3 - fold) AS start, n // 4 AS size FROM r, (SELECT UNNEST([0, 1, 2]) AS fold)),
    pairs AS (SELECT q.station, q.rate, q.pollutant, q.fold, q.ts, q.label, t.label AS y, t.rn, list_distance(q.f, t.f) AS d
      FROM folds q JOIN folds t ON t.station = q.station AND t.rate = q.rate AND t.pollutant = q.pollutant AND t.fold = q.fold
      WHERE q.pos >= q.start AND q.pos < q.start + q.size AND t.pos < t.start),
    top AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEY}, fold ORDER BY d, rn) AS k FROM pairs QUALIFY k <= 50),
    run AS (SELECT *, SUM(y) OVER u AS sy, SUM(CASE WHEN d > 0 THEN y / d ELSE 0 END) OVER u AS sw, SUM(CASE WHEN d > 0 THEN 1 / d ELSE 0 END) OVER u AS w,
      COUNT(*) FILTER (d = 0) OVER u AS hits, SUM(CASE WHEN d = 0 THEN y ELSE 0 END) OVER u AS sh FROM top
      WINDOW u AS (PARTITION BY {KEY}, fold ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    err AS (SELECT station, rate, pollutant, fold, k, 'uniform' AS weights, AVG((label - sy / k) ** 2) AS mse FROM run GROUP BY ALL
      UNION ALL SELECT station, rate, pollutant, fold, k, 'distance', AVG((label - CASE WHEN hits > 0 THEN sh / hits ELSE sw / w END) ** 2) FROM run GROUP BY ALL),
    cv AS (SELECT station, rate, pollutant, k, weights, AVG(-mse) AS score FROM err WHERE k % 2 = 0 GROUP BY ALL)"""

_DESIGN = f"""{G}, rows_ AS (SELECT station, rate, pollutant, value AS a, LAG(value) OVER w AS b, LEAD(value) OVER w AS y FROM g WINDOW w AS {W})"""

ORACLE: dict[str, str] = {
    "bulk_filter": "SELECT p_partkey, p_name FROM part WHERE p_name IS NULL OR lower(p_name) NOT LIKE '%widget%'",
    "column_prune": "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem",
    "ingest_raw": f"""WITH raw AS ({_RAW}), per_file AS (SELECT station, rate, pollutant, ts, part, AVG(value) AS value FROM raw GROUP BY ALL)
      SELECT {KEY}, ROUND(arg_max(value, part), 6) AS value FROM per_file GROUP BY ALL""",
    "pivot_mean": f"WITH m AS ({hourly()}) SELECT station, rate, ts, " + ", ".join(
        f"ROUND(AVG(CASE WHEN pollutant = '{p}' THEN value END), 6) AS {p}" for p in POLLUTANTS) + " FROM m GROUP BY ALL",
    "unpivot_long": f"SELECT station, rate, ts, pollutant, {VALUE} FROM ({hourly()}) WHERE value IS NOT NULL",
    "merge_newest_wins": f"WITH m AS ({hourly(2, 4)}) SELECT {KEY}, ROUND(arg_max(value, file_seq), 6) AS value FROM m GROUP BY ALL",
    "upsert": f"WITH m AS ({hourly(2, 4)}) SELECT {KEY}, ROUND(arg_max(value, file_seq), 6) AS value FROM m GROUP BY ALL",
    "coverage": f"""WITH m AS ({hourly(1)}), d AS (SELECT station, rate, CAST(floor((epoch(MAX(ts)) - epoch(MIN(ts))) / 86400) AS BIGINT) AS days
      FROM m GROUP BY ALL) SELECT station, rate, pollutant, COUNT(value) AS n_values, days FROM m JOIN d USING (station, rate) GROUP BY ALL""",
    "density_filter": f"""WITH m AS ({hourly(1)}), d AS (SELECT station, rate, floor((epoch(MAX(ts)) - epoch(MIN(ts))) / 86400) AS days
      FROM m GROUP BY ALL), k AS (SELECT station, rate, pollutant FROM m JOIN d USING (station, rate) GROUP BY station, rate, pollutant, days
      HAVING COUNT(value) >= 0.98 * days * 24) SELECT {KEY}, {VALUE} FROM m SEMI JOIN k USING (station, rate, pollutant)""",
    "station_enrich": f"""WITH m AS ({hourly()}), s AS (SELECT 'ST' || CAST(n_nationkey % 3 AS VARCHAR) AS station, n_nationkey * 1.5::DOUBLE AS latitude,
      n_regionkey * -2.5::DOUBLE AS longitude FROM nation), f AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER
      (PARTITION BY station ORDER BY latitude, longitude) = 1)
      SELECT {KEY}, {VALUE}, latitude, longitude FROM m LEFT JOIN f USING (station)""",
    "rate_vocab": """WITH o AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'day' WHEN 'F' THEN 'hour' ELSE 'other' END AS averaging FROM orders)
      SELECT averaging, CASE averaging WHEN 'day' THEN 'D' WHEN 'hour' THEN 'H' ELSE averaging END AS rate, averaging AS restored,
      COUNT(*) AS n FROM o GROUP BY ALL""",
    "resample_hourly": f"{G} SELECT {KEY}, {VALUE} FROM cells",
    "resample_daily_bfill": f"{DAILY_GRID} SELECT {KEY}, value FROM cells",
    "interpolate_time": f"{G} SELECT {KEY}, {VALUE} FROM filled",
    "interpolate_position": f"""WITH m AS ({hourly()}), r AS (SELECT *, ROW_NUMBER() OVER {W} - 1 AS slot FROM m),
      h AS (SELECT {KEY}, slot, CASE WHEN slot % 3 <> 1 THEN value END AS value, CASE WHEN slot % 3 <> 1 THEN slot END AS x FROM r),
      near AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS px, last_value(value IGNORE NULLS) OVER b AS pv,
        first_value(x IGNORE NULLS) OVER a AS nx, first_value(value IGNORE NULLS) OVER a AS nv FROM h
        WINDOW b AS (PARTITION BY station, rate, pollutant ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               a AS (PARTITION BY station, rate, pollutant ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
      SELECT {KEY}, ROUND(CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv
        ELSE pv + (nv - pv) * (slot - px) / (nx - px) END, 6) AS value FROM near""",
    "align_start": f"{G} SELECT {KEY}, {VALUE} FROM g",
    "resample_daily": f"{DAILY_GRID} SELECT {KEY}, value FROM g",
    "head_n_per_series": f"{G}, {NUMBERED} SELECT {KEY}, {VALUE} FROM pos WHERE pos < 200",
    "skip_n_per_series": f"{G}, {NUMBERED} SELECT {KEY}, {VALUE} FROM pos WHERE pos >= 24",
    "tail_n_per_series": f"{G}, {NUMBERED} SELECT {KEY}, {VALUE} FROM pos WHERE pos >= n - 24",
    "holdout_split": f"{G}, {NUMBERED} SELECT {KEY}, {VALUE}, pos >= n - 24 AS is_holdout FROM pos",
    "ts_split": f"""{G}, {NUMBERED}, f AS (SELECT *, n - (n // 4) * (3 - fold) AS start, n // 4 AS size FROM pos,
      (SELECT UNNEST([0, 1, 2]) AS fold)) SELECT station, rate, pollutant, CAST(fold AS INT) AS fold, COUNT(*) FILTER (pos < start) AS n_train,
      COUNT(*) FILTER (pos >= start AND pos < start + size) AS n_test, MAX(ts) FILTER (pos < start) AS train_end,
      MIN(ts) FILTER (pos >= start) AS test_start, MAX(ts) FILTER (pos >= start AND pos < start + size) AS test_end
      FROM f GROUP BY station, rate, pollutant, fold""",
    "lag_features": f"{G}, {LAG24} SELECT {KEY}, {VALUE}, " + ", ".join(
        f"ROUND(lag_{i}, 6) AS lag_{i}" for i in range(1, 25)) + " FROM lags",
    "stat_features": f"""{G}, {LAG24}, l AS (SELECT *, {_lag_list(24)} AS v FROM lags),
      s AS (SELECT *, list_sum(v) AS s1, 2 * list_sum(v) / (len(v) + 1) AS s2 FROM l)
      SELECT {KEY}, {VALUE}, ROUND(s1, 6) AS sum, ROUND(s2, 6) AS mean,
      ROUND(list_median(list_concat(v, [s1, s2])), 6) AS median FROM s""",
    "stat_features_lags_only": f"""{G}, lags AS (SELECT *, {_lags(7)} FROM g WINDOW w AS {W}), l AS (SELECT *, {_lag_list(7)} AS v FROM lags)
      SELECT {KEY}, {VALUE}, ROUND(list_sum(v), 6) AS sum, ROUND(list_avg(v), 6) AS mean, ROUND(list_median(v), 6) AS median FROM l""",
    "weekday_onehot": f"SELECT station, pollutant, ts, " + ", ".join(
        f"dayname(ts) = '{d}' AS {d}" for d in DAYS) + f" FROM ({DAILY})",
    "month_onehot": f"SELECT station, pollutant, ts, " + ", ".join(
        f"strftime(ts, '%b') = '{m}' AS {m}" for m in MONTHS) + f" FROM ({DAILY})",
    "difference": f"""{G}, d AS (SELECT {KEY}, value - LAG(value) OVER {W} AS value, ROW_NUMBER() OVER {W} AS rn FROM g)
      SELECT {KEY}, {VALUE} FROM d WHERE rn > 1""",
    "difference_irregular": f"""WITH g AS ({hourly()}), d AS (SELECT {KEY}, value - LAG(value, 2) OVER {W} AS value,
      ROW_NUMBER() OVER {W} AS rn FROM g) SELECT {KEY}, {VALUE} FROM d WHERE rn > 2""",
    "dedifference": f"""{G}, d AS (SELECT {KEY}, value - LAG(value) OVER {W} AS d, first_value(value) OVER {W} AS start,
      ROW_NUMBER() OVER {W} AS rn FROM g) SELECT {KEY}, ROUND(start + SUM(d) OVER {W}, 6) AS value FROM d WHERE rn > 1""",
    "rotate_left": f"{G} SELECT {KEY}, ROUND(COALESCE(LEAD(value) OVER {W}, first_value(value) OVER {W}), 6) AS value FROM g",
    "target_shift": f"""{G}, t AS (SELECT *, LEAD(value, 3) OVER {W} AS target, LEAD(ts, 3) OVER {W} AS later FROM g)
      SELECT {KEY}, {VALUE}, ROUND(target, 6) AS target FROM t WHERE later IS NOT NULL""",
    "horizon_explode": f"""{G}, {NUMBERED} SELECT a.station, a.rate, a.pollutant, a.ts, ROUND(a.value, 6) AS value, CAST(h AS INT) AS horizon,
      ROUND(b.value, 6) AS target FROM pos a, (SELECT UNNEST([1, 2, 3, 5, 10, 12, 24]) AS h), pos b
      WHERE b.station = a.station AND b.rate = a.rate AND b.pollutant = a.pollutant AND b.pos = a.pos + h""",
    "minmax_scale": f"""{G} SELECT {KEY}, ROUND(CASE WHEN MAX(value) OVER k = MIN(value) OVER k THEN -1 ELSE (value - MIN(value) OVER k) /
      (MAX(value) OVER k - MIN(value) OVER k) * 2 - 1 END, 6) AS value FROM g WINDOW k AS (PARTITION BY station, rate, pollutant)""",
    "minmax_rescale": f"{G} SELECT {KEY}, {VALUE} FROM g",
    "scaled_sequences": f"""{G}, {_DIRECT_ROWS} SELECT {KEY}, {_sc('value')} AS x0, {_sc('l2')} AS x1, {_sc('l3')} AS x2, {_sc('label')} AS scaled_label,
      ROUND(label, 6) AS restored_label FROM r WINDOW k AS (PARTITION BY station, rate, pollutant)""",
    "other_series_features": f"""{G}, o AS (SELECT a.station, a.rate, a.pollutant, a.ts, a.value, list(b.value ORDER BY b.pollutant) AS f FROM g a JOIN g b
      ON a.station = b.station AND a.rate = b.rate AND a.ts = b.ts AND a.pollutant <> b.pollutant GROUP BY ALL)
      SELECT {KEY}, {VALUE}, """ + ", ".join(f"ROUND(f[{i + 1}], 6) AS x{i}" for i in range(4)) + " FROM o",
    "feature_gate": """WITH p AS (SELECT 'ST' || CAST(o_custkey AS VARCHAR) AS station, 'D' AS rate, o_orderpriority AS pollutant, o_totalprice AS value
      FROM orders) SELECT station, rate, pollutant, COUNT(*) AS n, MAX(value) AS max_value FROM p
      WHERE station IN (SELECT station FROM p GROUP BY station HAVING COUNT(DISTINCT pollutant) >= 5) GROUP BY ALL""",
    "todo_anti_join": f"""{EV}, d AS (SELECT * FROM ev WHERE fit_time > 40) SELECT DISTINCT station, rate, pollutant, distance, differenced, direct, artificial
      FROM ev ANTI JOIN d USING (station, rate, pollutant, distance, differenced, direct, artificial)""",
    "with_results_semi_join": f"""WITH m AS ({hourly(50)}) SELECT {KEY}, {VALUE} FROM m WHERE station IN
      (SELECT 'ST' || CAST(user_id % 50 AS VARCHAR) FROM events WHERE value > 480)""",
    "run_setups": f"""WITH k AS (SELECT DISTINCT station, rate, pollutant FROM ({hourly()})), s AS (SELECT *, COUNT(*) OVER (PARTITION BY station, rate) AS c FROM k),
      w AS (SELECT s.*, differenced, direct, artificial, h FROM s, (SELECT UNNEST([TRUE, FALSE]) AS differenced),
        (SELECT FALSE AS direct, FALSE AS artificial, 24 AS h UNION ALL SELECT TRUE, a, h FROM (SELECT UNNEST([TRUE, FALSE]) AS a),
         (SELECT UNNEST([1, 2, 3, 5, 10, 12, 24]) AS h)) WHERE NOT direct OR artificial OR c >= 3)
      SELECT station, rate, differenced, direct, artificial, COUNT(*) AS n, CAST(SUM(h) AS BIGINT) AS distances FROM w GROUP BY ALL""",
    "run_name_build": f"{EV} SELECT {RUN_NAME} AS run_name, COUNT(*) AS n FROM ev GROUP BY ALL",
    "run_name_parse": f"""{EV} SELECT station, rate, pollutant, distance, differenced, direct, artificial, COUNT(*) AS n
      FROM ev GROUP BY ALL""",
    "report_name_build": f"{EV} SELECT 'timebased=' || {_FLAG.format('timebased')} || '-differenced=' || {_FLAG.format('differenced')} || "
      f"CASE WHEN timebased THEN '' ELSE '-artificial=' || {_FLAG.format('artificial')} END || '-rate=' || rate AS name, "
      "COUNT(*) AS n FROM ev GROUP BY ALL",
    "params_roundtrip": """SELECT p_partkey, CAST(p_size AS INT) AS n_neighbors, lower(p_brand) AS weights,
      CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS INT) END AS max_depth, CAST(NULL AS INT) AS n_estimators FROM part""",
    "score_naive": f"{_score_sql(1)} SELECT station, rate, pollutant, {_ROUNDED_SCORES} FROM s",
    "score_seasonal_naive": f"{_score_sql(24)} SELECT station, rate, pollutant, {_ROUNDED_SCORES} FROM s",
    "norm_scores": f"""{_score_sql(24)}, n AS (SELECT station, rate, pollutant, 1 / (MAX(value) - MIN(value)) AS nf FROM g GROUP BY ALL)
      SELECT station, rate, pollutant, {_ROUNDED_SCORES}, ROUND(nf, 6) AS norm_factor, """ + ", ".join(
        f"ROUND({s} * nf, 6) AS norm_{s}" for s in SCORES) + " FROM s JOIN n USING (station, rate, pollutant)",
    "baseline_report": f"""{_score_sql(24)}, n AS (SELECT station, rate, pollutant, 1 / (MAX(value) - MIN(value)) AS nf FROM g GROUP BY ALL),
      j AS (SELECT rate, mean_absolute_error * nf AS norm_mean_absolute_error FROM s JOIN n USING (station, rate, pollutant))
      """ + _stats("rate", ["norm_mean_absolute_error"], "j"),
    "report_q1_general_prediction_times_overall": f"{EV} {_stats('timebased, model', TIMES)}",
    "report_q2_general_fit_times_overall": f"{EV} {_stats('timebased, model', TIMES)}",
    "report_q3_best_by_dist_and_poll": _wins(f"{SETUP}, rate, pollutant, distance"),
    "report_q4_best_by_dist": _wins(f"{SETUP}, rate, distance"),
    "report_q5_best_by_poll": _wins(f"{SETUP}, rate, pollutant"),
    "report_q6_best_by_artificial": f"""{EV}, best AS ({_best('timebased, differenced, rate, model, station, pollutant, distance', 'mean_squared_error', 'artificial')})
      SELECT timebased, differenced, rate, model, artificial, COUNT(mean_squared_error) AS best_mse_count FROM best GROUP BY ALL""",
    "report_q7_best_by_differenced": f"""{EV}, best AS ({_best('timebased, artificial, rate, model, station, pollutant, distance', 'norm_mean_absolute_error', 'differenced')})
      SELECT timebased, artificial, rate, model, differenced, COUNT(norm_mean_absolute_error) AS count_best_nmae FROM best GROUP BY ALL""",
    "report_q8_general_norm_measures": f"{EV} {_stats(SETUP + ', rate, model', NORM)}",
    "report_q9_distance_norm_measures": f"{EV} {_stats(SETUP + ', rate, distance, model', NORM)}",
    "report_q10_pollutant_norm_measures": f"{EV} {_stats(SETUP + ', rate, pollutant, model', NORM)}",
    "report_q11_general_prediction_times": f"{EV} {_stats(SETUP + ', rate, model', TIMES)}",
    "report_q12_general_fit_times": f"{EV} {_stats(SETUP + ', rate, model', TIMES)}",
    "report_q13_best_by_poll_over_distances": f"""{EV}, a AS (SELECT {SETUP}, rate, station, pollutant, model, ROUND(SUM(CAST(mean_squared_error AS DECIMAL(30, 12)))::DOUBLE / COUNT(mean_squared_error), 9) AS mse FROM ev GROUP BY ALL),
      best AS ({_best(SETUP + ', rate, station, pollutant', 'mse', 'model', 'a')})
      SELECT {SETUP}, rate, pollutant, model, COUNT(mse) AS best_mse_by_distance_avg FROM best GROUP BY ALL""",
    "report_q14_all_norm_measures": f"{EV} {_stats(SETUP + ', rate, pollutant, model, distance', NORM)}",
    "report_q15_best_by_mean_nmae": f"""{MEANS} SELECT {SETUP}, rate, pollutant, distance, model,
      ROUND(norm_mean_absolute_error_mean, 6) AS norm_mean_absolute_error_mean FROM best""",
    "report_q16_best_by_mean_nmae_per_pollutant": f"{MEANS} SELECT {SETUP}, pollutant, model, COUNT(*) AS best_count FROM best GROUP BY ALL",
    "report_q17_best_by_mean_nmae_per_distance": f"{MEANS} SELECT {SETUP}, distance, model, COUNT(*) AS best_count FROM best GROUP BY ALL",
    "knn_uniform": f"{_KNN} SELECT {KEY}, ROUND(label, 6) AS actual, ROUND(AVG(y), 6) AS predicted FROM top GROUP BY {KEY}, label",
    "knn_distance": f"""{_KNN} SELECT {KEY}, ROUND(label, 6) AS actual, ROUND(CASE WHEN MIN(d) = 0 THEN AVG(y) FILTER (d = 0)
      ELSE SUM(y / NULLIF(d, 0)) / SUM(1 / NULLIF(d, 0)) END, 6) AS predicted FROM top GROUP BY {KEY}, label""",
    "knn_cv_best": f"""{_KNN_CV} SELECT station, rate, pollutant, CAST(k AS INT) AS n_neighbors, weights, ROUND(score, 6) AS score FROM cv
      QUALIFY ROW_NUMBER() OVER (PARTITION BY station, rate, pollutant ORDER BY score DESC) = 1""",
    "knn_cv_best_absolute": f"""{_KNN_CV.replace("AVG((label - sy / k) ** 2)", "AVG(ABS(label - sy / k))").replace(
        "AVG((label - CASE WHEN hits > 0 THEN sh / hits ELSE sw / w END) ** 2)", "AVG(ABS(label - CASE WHEN hits > 0 THEN sh / hits ELSE sw / w END))")}
      SELECT station, rate, pollutant, CAST(k AS INT) AS n_neighbors, weights, ROUND(score, 6) AS score FROM cv
      QUALIFY ROW_NUMBER() OVER (PARTITION BY station, rate, pollutant ORDER BY score DESC) = 1""",
    # The season's values are a list that turns by one place a step.
    "holt_winters_stored": f"""WITH RECURSIVE {DAILY_GRID.removeprefix('WITH ')},
        y AS (SELECT station, rate, pollutant, list(value ORDER BY ts) AS y, COUNT(*) - 7 AS n FROM g GROUP BY ALL),
        st(station, rate, pollutant, y, n, t, level, slope, s) AS (
            SELECT station, rate, pollutant, y, n, 7::BIGINT, list_avg(y[1:7])::DOUBLE, ((list_avg(y[8:14]) - list_avg(y[1:7])) / 7)::DOUBLE,
                   list_transform(y[1:7], lambda v: (v - list_avg(y[1:7]))::DOUBLE) FROM y WHERE n >= 14
            UNION ALL
            SELECT station, rate, pollutant, y, n, t + 1, new, 0.05::DOUBLE * (new - level) + 0.95::DOUBLE * 0.97::DOUBLE * slope,
                   list_append(s[2:7], 0.2::DOUBLE * (y[t + 1] - new) + 0.8::DOUBLE * s[1])
            FROM (SELECT *, 0.5::DOUBLE * (y[t + 1] - s[1]) + 0.5::DOUBLE * (level + 0.97::DOUBLE * slope) AS new FROM st WHERE t < n))
        SELECT station, rate, pollutant, CAST(h AS INTEGER) AS step,
               ROUND(level + slope * list_sum(list_transform(range(1, h + 2), lambda k: pow(0.97::DOUBLE, k))) + s[h + 1], 6) AS predicted
        FROM st, range(0, 7) AS r(h) WHERE t = n""",
    "linreg_one_feature": f"""{_DESIGN} SELECT station, rate, pollutant, ROUND(regr_intercept(y, a), 6) AS intercept, ROUND(regr_slope(y, a), 6) AS coef_1,
      COUNT(*) AS n FROM rows_ WHERE y IS NOT NULL GROUP BY ALL""",
    "linreg_two_features": f"""{_DESIGN}, c AS (SELECT station, rate, pollutant, AVG(a) AS ma, AVG(b) AS mb, AVG(y) AS my, VAR_POP(a) AS saa, VAR_POP(b) AS sbb,
      COVAR_POP(a, b) AS sab, COVAR_POP(a, y) AS say, COVAR_POP(b, y) AS sby, COUNT(*) AS n FROM rows_ WHERE y IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
      k AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS c1, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS c2 FROM c)
      SELECT station, rate, pollutant, ROUND(my - c1 * ma - c2 * mb, 6) AS intercept, ROUND(c1, 6) AS coef_1, ROUND(c2, 6) AS coef_2, n FROM k""",
    "asof_last_order": """SELECT e.event_id, r.orderkey, CAST(r.day AS VARCHAR) AS day FROM events e ASOF LEFT JOIN
      (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, MAX(o_orderkey) AS orderkey FROM orders GROUP BY ALL) r
      ON e.user_id = r.o_custkey AND e.ts >= r.day""",
    "asof_next_purchase": """SELECT v.event_id, CASE WHEN r.ts <= v.ts + INTERVAL 1 DAY THEN r.purchase END AS purchase
      FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN
      (SELECT user_id, ts, MIN(event_id) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY ALL) r
      ON v.user_id = r.user_id AND v.ts <= r.ts""",
    "merge_stored": f"WITH m AS ({hourly(2, 4)}) SELECT {KEY}, ROUND(arg_max(value, file_seq), 6) AS value FROM m GROUP BY ALL",
    "stored_evaluation": f"""{EV} SELECT station, rate, pollutant, distance, differenced, direct, artificial, model, """ + ", ".join(
        f"ROUND({c}, 6) AS {c}" for c in [*TIMES, "mean_squared_error", "norm_mean_squared_error", "norm_mean_absolute_error",
                                         "norm_median_absolute_error"]) + " FROM ev",
    "stored_results": f"""{EV} SELECT station, rate, pollutant, distance, differenced, direct, artificial, model,
      CAST(floor(fit_time) AS INT) AS n_neighbors, ROUND(mean_squared_error, 6) AS score FROM ev""",
    "incremental_ingest": f"WITH m AS ({hourly(2, 3)}) SELECT {KEY}, ROUND(arg_max(value, file_seq), 6) AS value FROM m GROUP BY ALL",
    "stored_dense": f"""WITH m AS ({hourly(1)}), d AS (SELECT station, rate, floor((epoch(MAX(ts)) - epoch(MIN(ts))) / 86400) AS days
      FROM m GROUP BY ALL), k AS (SELECT station, rate, pollutant FROM m JOIN d USING (station, rate) GROUP BY station, rate, pollutant, days
      HAVING COUNT(value) >= 0.94 * days * 24) SELECT {KEY}, {VALUE} FROM m SEMI JOIN k USING (station, rate, pollutant)""",
    "station_files": f"SELECT {KEY}, {VALUE} FROM ({hourly()}) WHERE value IS NOT NULL",
    "evaluation_files": f"""{EV} SELECT station, rate, pollutant, distance, differenced, direct, artificial, model, """ + ", ".join(
        f"ROUND({c}, 6) AS {c}" for c in [*TIMES, "mean_squared_error"]) + " FROM ev",
}
