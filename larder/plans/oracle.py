"""The same results as plain SQL over the same tables, for DuckDB.

`sql(doubles, body)` rounds the named double columns as plans.queries.comparable does.
"""

from __future__ import annotations

from itertools import combinations

from larder.functions.columns import CATEGORY_ADVICE, PRODUCT_ADVICE, price_bucket_labels
from larder.operators.validate import NON_NEGATIVE, OUTLIER_COLUMNS, RULES
from larder.params import DEFAULTS
from larder.schema import CATEGORICAL_COLUMNS, FACT_COLUMNS, FACT_SCHEMA, MONTH_NAMES, NUMERIC_COLUMNS

FACT = """
fact AS (
  SELECT CAST(l_shipdate AS DATE) AS date, 'S' || CAST(l_suppkey AS VARCHAR) AS store_id, p_brand AS product_id,
         p_type AS category, r_name AS region, CAST(p_size AS BIGINT) AS inventory_level,
         CAST(l_quantity AS BIGINT) AS units_sold, CAST(l_linenumber * 5 AS BIGINT) AS units_ordered,
         l_quantity * (1 + l_tax) - 1 AS demand_forecast, l_extendedprice / nullif(l_quantity, 0) AS price,
         CAST(round(l_discount * 100) AS INTEGER) AS discount, l_returnflag AS weather,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS holiday_promotion,
         p_retailprice AS competitor_pricing,
         CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'Winter' WHEN month(l_shipdate) IN (3, 4, 5) THEN 'Spring'
              WHEN month(l_shipdate) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS seasonality,
         'P' || CAST(l_partkey AS VARCHAR) AS sku
  FROM lineitem
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN orders ON l_orderkey = o_orderkey
),
f AS (
  SELECT *, inventory_level / nullif(units_sold, 0) AS ratio,
         1 - abs(demand_forecast - units_sold) / nullif(demand_forecast, 0) AS accuracy,
         inventory_level - units_sold AS gap,
         CASE WHEN inventory_level < units_sold THEN 'Undersupplied'
              WHEN inventory_level <= units_sold * 1.5 THEN 'Optimal'
              WHEN inventory_level > units_sold * 1.5 THEN 'Oversupplied' ELSE 'Unknown' END AS status,
         price * units_sold * (1 - discount / 100) AS revenue,
         (price - competitor_pricing) / nullif(competitor_pricing, 0) * 100 AS diff_pct
  FROM fact
),
damaged AS (
  SELECT * REPLACE (CASE WHEN units_sold = 7 THEN NULL ELSE category END AS category, demand_forecast - 10 AS demand_forecast,
                    discount * 11 AS discount, CAST(holiday_promotion * units_sold AS INTEGER) AS holiday_promotion)
  FROM fact
)
"""

COLUMNS = ", ".join(FACT_COLUMNS)
DAYS_AND_REGIONS = "date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND region IN ('ASIA', 'EUROPE')"
CATEGORY_CHOICE = "category IN ('ECONOMY', 'STANDARD')"
PRODUCT_CHOICE = "product_id IN ('Brand#11', 'Brand#12')"


def sql(doubles: str, body: str, ctes: str = "") -> str:
    rounded = ", ".join(
        f"round_even({c} * 1000000.0::DOUBLE + 0.00037::DOUBLE, 0) / 1000000.0::DOUBLE AS {c}" for c in doubles.split()
    )
    chosen = f"* REPLACE ({rounded})" if rounded else "*"
    extra = f", {ctes}" if ctes else ""
    return f"WITH {FACT}{extra} SELECT {chosen} FROM ({body}) AS result"


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def bucket(column: str = "diff_pct") -> str:
    bins = DEFAULTS.price_diff_bins
    cases = " ".join(f"WHEN {column} > {a} AND {column} <= {b} THEN {i}" for i, (a, b) in enumerate(zip(bins, bins[1:])))
    return f"CASE {cases} END"


def labels() -> str:
    rows = ", ".join(f"({i}, '{label}')" for i, label in enumerate(price_bucket_labels(DEFAULTS.price_diff_bins)))
    return f"labels(bucket_no, bucket) AS (VALUES {rows})"


MODE = """(SELECT {key}, status FROM (SELECT {key}, status, row_number() OVER (PARTITION BY {key}
  ORDER BY count(*) DESC, status) AS rn FROM f GROUP BY {key}, status) AS s WHERE rn = 1)"""


def product_metrics(key: str) -> str:
    join = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in key.split(","))
    return f"""SELECT a.*, b.status AS supply_status FROM (SELECT {key}, avg(gap) AS avg_gap,
      CAST(sum(units_sold) AS BIGINT) AS units_sold, avg(inventory_level) AS avg_inventory,
      avg(accuracy) AS avg_accuracy, avg(ratio) AS avg_ratio FROM f GROUP BY {key}) AS a
      JOIN {MODE.format(key=key)} AS b ON {join}"""


def monthly(key: str, source: str = "f") -> str:
    names = ", ".join(f"({i}, '{m}')" for i, m in enumerate(MONTH_NAMES, 1))
    return f"""SELECT m.month_no, m.month_name, k.{key}, a.avg_units
      FROM (VALUES {names}) AS m(month_no, month_name) CROSS JOIN (SELECT DISTINCT {key} FROM {source}) AS k
      LEFT JOIN (SELECT {key}, month(date) AS month_no, avg(units_sold) AS avg_units FROM {source} GROUP BY ALL) AS a
      ON a.{key} = k.{key} AND a.month_no = m.month_no"""


def peak(key: str, source: str = "f") -> str:
    return f"""SELECT {key}, month_name AS peak_month, avg_units AS peak_value FROM (SELECT *, row_number() OVER
      (PARTITION BY {key} ORDER BY avg_units DESC NULLS LAST, month_no) AS rn FROM ({monthly(key, source)}) AS x) AS y WHERE rn = 1"""


def top(key: str, n: int) -> str:
    return f"SELECT {key}, CAST(sum(units_sold) AS BIGINT) AS units_sold FROM f GROUP BY {key} ORDER BY units_sold DESC, {key} LIMIT {n}"


def top_rows(key: str, n: int) -> str:
    return f"top_rows AS (SELECT * FROM f WHERE {key} IN (SELECT {key} FROM ({top(key, n)}) AS t))"


def index(key: str) -> str:
    return f"""SELECT {key}, (max(avg_units) - min(avg_units)) / avg(avg_units) AS seasonality_index
      FROM ({monthly(key)}) AS x GROUP BY {key} HAVING avg(avg_units) > 0"""


def by_season(key: str) -> str:
    return f"""SELECT seasonality, {key}, units_sold FROM (SELECT seasonality, {key}, CAST(sum(units_sold) AS BIGINT) AS units_sold,
      row_number() OVER (PARTITION BY seasonality ORDER BY sum(units_sold) DESC, {key}) AS rn FROM f GROUP BY seasonality, {key}) AS x
      WHERE rn = 1"""


def mean_by(*keys: str) -> str:
    named = ", ".join(keys)
    return f"SELECT {named}, avg(units_sold) AS avg_units FROM f GROUP BY {named}"


def status_by(key: str) -> str:
    return f"""SELECT k.{key}, s.supply_status, count(f.status) AS n,
      count(f.status) * 100.0::DOUBLE / sum(count(f.status)) OVER (PARTITION BY k.{key}) AS pct
      FROM (SELECT DISTINCT {key} FROM f) AS k CROSS JOIN (VALUES ('Optimal'), ('Oversupplied'), ('Undersupplied')) AS s(supply_status)
      LEFT JOIN f ON f.{key} = k.{key} AND f.status = s.supply_status GROUP BY k.{key}, s.supply_status"""


def describe(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std,
      CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
      quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50,
      quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75 FROM f"""


DESCRIBE = union(describe(c) for c in NUMERIC_COLUMNS)


def in_duckdb(condition: str) -> str:
    return condition.replace("try_cast", "TRY_CAST").replace(" AS double)", " AS DOUBLE)").replace(" AS date)", " AS DATE)")


def violations(source: str) -> str:
    return union(
        f"""SELECT date, store_id, product_id, '{r.column}' AS column_name, '{r.message}' AS message FROM {source}
        WHERE NOT coalesce({in_duckdb(r.holds)}, false)""" for r in RULES
    )


def rule_summary(source: str) -> str:
    return union(
        f"""SELECT '{r.column}' AS column_name, '{r.message}' AS message, count(*) FILTER (WHERE NOT coalesce({in_duckdb(r.holds)}, false))
        AS n_violations, count(*) FILTER (WHERE NOT coalesce({in_duckdb(r.holds)}, false)) = 0 AS passed FROM {source}""" for r in RULES
    )


def negatives(source: str) -> str:
    return union(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} < 0) AS n_negative, count(*) FILTER (WHERE {c} < 0) * 100.0::DOUBLE / count(*) AS pct FROM {source}"
        for c in NON_NEGATIVE
    )


def outliers(source: str) -> str:
    return union(
        f"""SELECT '{c}' AS column_name, low AS low_fence, high AS high_fence,
        count(*) FILTER (WHERE {c} < low OR {c} > high) AS n_outliers,
        count(*) FILTER (WHERE {c} < low OR {c} > high) * 100.0::DOUBLE / count(*) AS pct
        FROM {source}, (SELECT q1 - 1.5::DOUBLE * (q3 - q1) AS low, q3 + 1.5::DOUBLE * (q3 - q1) AS high
          FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source}) AS q) AS b
        GROUP BY low, high""" for c in OUTLIER_COLUMNS
    )


def status(source: str) -> str:
    missing = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in FACT_COLUMNS)
    negative = " + ".join(f"count(*) FILTER (WHERE {c} < 0)" for c in NON_NEGATIVE)
    return f"""SELECT *, n_missing = 0 AND n_duplicates = 0 AND n_violations = 0 AND n_outliers = 0 AND n_missing_days = 0
        AND n_negative = 0 AS passed FROM (SELECT count(*) AS n_rows, CAST({len(FACT_COLUMNS)} AS BIGINT) AS n_columns, {missing} AS n_missing,
      (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM {source} GROUP BY {COLUMNS}) AS d) AS n_duplicates,
      (SELECT count(*) FROM ({violations(source)}) AS v) AS n_violations,
      (SELECT CAST(sum(n_outliers) AS BIGINT) FROM ({outliers(source)}) AS o) AS n_outliers,
      date_diff('day', min(date), max(date)) + 1 - count(DISTINCT date) AS n_missing_days, {negative} AS n_negative FROM {source}) AS c"""


def corr_rows() -> str:
    cells = [(a, b) for a, b in combinations(NUMERIC_COLUMNS, 2)]
    cells += [(b, a) for a, b in cells] + [(a, a) for a in NUMERIC_COLUMNS]
    return union(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round_even(corr({a}, {b}), 2) AS r FROM f" for a, b in cells)


DIMENSIONS = ("category", "region", "seasonality", "weather", "holiday_promotion")
GROUP_MEANS = union(
    f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, '{c}' AS column_name, round_even(avg({c}), 2) AS mean FROM f GROUP BY {d}"
    for d in DIMENSIONS for c in NUMERIC_COLUMNS
)
CATEGORY_COUNTS = union(
    f"""SELECT * FROM (SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n,
    CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INTEGER) AS rank, count(*) OVER () AS n_values
    FROM f GROUP BY {c}) AS x WHERE rank <= 10""" for c in CATEGORICAL_COLUMNS
)


def profile(c: str, number: bool) -> str:
    if number:
        facts = f"""count(*) FILTER (WHERE {c} = 0) AS n_zeros, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value,
          avg({c}) AS mean, CAST(NULL AS VARCHAR) AS first_text, CAST(NULL AS VARCHAR) AS last_text, count(DISTINCT {c}) AS n_distinct,
          quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75"""
    else:
        null = "CAST(NULL AS DOUBLE)"
        facts = f"""CAST(0 AS BIGINT) AS n_zeros, {null} AS min_value, {null} AS max_value, {null} AS mean, CAST(min({c}) AS VARCHAR) AS first_text,
          CAST(max({c}) AS VARCHAR) AS last_text, count(DISTINCT {c}) AS n_distinct, {null} AS q25, {null} AS q50, {null} AS q75"""
    return f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, {facts} FROM f"


TEXTS = {f.name for f in FACT_SCHEMA if f.dataType.simpleString() in ("string", "date")}
PROFILE = union(profile(c, c not in TEXTS) for c in FACT_COLUMNS)

HISTOGRAM = """
  shape AS (
    SELECT low, high, greatest(CAST(ceil((high - low) / greatest(CASE WHEN fd > 0 THEN least(sturges, fd) ELSE sturges END, 1.0)) AS BIGINT), 1) AS bins
    FROM (SELECT low, high, (high - low) / (log2(n) + 1) AS sturges, 2 * iqr / pow(n, 1::DOUBLE / 3) AS fd
          FROM (SELECT count(*)::DOUBLE AS n, min(units_sold)::DOUBLE AS low, max(units_sold)::DOUBLE AS high,
                quantile_cont(units_sold::DOUBLE, 0.75) - quantile_cont(units_sold::DOUBLE, 0.25) AS iqr FROM f) AS s) AS t),
  xs AS (SELECT units_sold::DOUBLE AS x FROM f)"""
RATIO_HISTOGRAM = """
  xs AS (SELECT greatest(least(ratio, 10.0::DOUBLE), 0.0::DOUBLE) AS x FROM f WHERE ratio IS NOT NULL),
  shape AS (SELECT min(x) AS low, max(x) AS high, CAST(50 AS BIGINT) AS bins FROM xs)"""
BINS = """SELECT b.bin_no, low + b.bin_no * ((high - low) / bins) AS bin_low, low + (b.bin_no + 1) * ((high - low) / bins) AS bin_high, count(c.bin_no) AS n
  FROM (SELECT low, high, bins, unnest(range(bins)) AS bin_no FROM shape) AS b
  LEFT JOIN (SELECT least(CAST(floor((x - low) / (high - low) * bins) AS BIGINT), bins - 1) AS bin_no FROM xs, shape) AS c ON c.bin_no = b.bin_no
  GROUP BY b.bin_no, low, high, bins"""

BOX = """SELECT f.category, q1, median, q3, min(units_sold)::DOUBLE AS low_whisker, max(units_sold)::DOUBLE AS high_whisker FROM f JOIN
  (SELECT category, quantile_cont(units_sold::DOUBLE, 0.25) AS q1, quantile_cont(units_sold::DOUBLE, 0.5) AS median,
          quantile_cont(units_sold::DOUBLE, 0.75) AS q3 FROM f GROUP BY category) AS b ON b.category = f.category
  WHERE units_sold BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY f.category, q1, median, q3"""

Z = 1.6448536269514715  # Fixed value: the 95 % quantile of the standard normal distribution.


def stock(keys: str = "product_id, store_id", always: bool = False) -> str:
    days = "(SELECT date_diff('day', min(date), max(date)) + 1 FROM f)"
    factor = f"365.0::DOUBLE / {days}"
    factor = factor if always else f"CASE WHEN {days} < 365 THEN {factor} ELSE 1.0::DOUBLE END"
    return f"""SELECT *, {Z}::DOUBLE * demand_std * sqrt(7.0::DOUBLE) AS safety_stock,
      demand_mean * 7 + {Z}::DOUBLE * demand_std * sqrt(7.0::DOUBLE) AS reorder_point,
      sqrt(2 * annual_demand * 50 / nullif(unit_cost * 0.25::DOUBLE, 0)) AS eoq
      FROM (SELECT {keys}, avg(units_sold) AS demand_mean, stddev_samp(units_sold) AS demand_std,
        CAST(sum(units_sold) AS DOUBLE) * ({factor}) AS annual_demand, avg(price) AS unit_cost FROM f GROUP BY {keys}) AS s"""


def whole_stock(keys: str = "product_id, store_id") -> str:
    return f"""SELECT * REPLACE (CAST(round_even(safety_stock, 0) AS BIGINT) AS safety_stock,
      CAST(round_even(reorder_point, 0) AS BIGINT) AS reorder_point, CAST(round_even(eoq, 0) AS BIGINT) AS eoq) FROM ({stock(keys)}) AS u"""


PRODUCT_STOCK = f"""SELECT product_id, sum(demand_mean) AS demand_mean, sum(demand_std) AS demand_std, sum(annual_demand) AS annual_demand,
  CAST(sum(safety_stock) AS BIGINT) AS safety_stock, CAST(sum(reorder_point) AS BIGINT) AS reorder_point, CAST(sum(eoq) AS BIGINT) AS eoq,
  avg(unit_cost) AS unit_cost FROM ({whole_stock()}) AS w GROUP BY product_id"""


def fits(key: str) -> str:
    return f"""points AS (SELECT {key}, price, avg(units_sold) AS avg_units FROM f WHERE price IS NOT NULL GROUP BY {key}, price),
      usable AS (SELECT * FROM points WHERE price > 0 AND avg_units > 0),
      fits AS (SELECT {key}, count(*) AS n_points, regr_slope(ln(avg_units), ln(price)) AS elasticity,
        regr_intercept(ln(avg_units), ln(price)) AS intercept, avg(price) AS avg_price, min(price) AS min_price, max(price) AS max_price
        FROM usable GROUP BY {key} HAVING count(*) > 2),
      first_seen AS (SELECT {key}, first(category ORDER BY date, store_id, category) AS category FROM f GROUP BY {key})"""


def elasticity(key: str) -> str:
    return f"""SELECT fits.{key}, elasticity, avg_price, n_points, CASE WHEN elasticity < -1 THEN 'Elastic' ELSE 'Inelastic' END AS elastic_status,
      category FROM fits LEFT JOIN first_seen ON first_seen.{key} = fits.{key} WHERE elasticity IS NOT NULL"""


def category_elasticity(key: str) -> str:
    return f"""SELECT category, elasticity, CASE WHEN abs(elasticity) > 1 THEN 'Elastic' ELSE 'Inelastic' END AS elastic_status, n_products
      FROM (SELECT category, quantile_cont(elasticity, 0.5) AS elasticity, count(*) AS n_products FROM ({elasticity(key)}) AS e
            WHERE category IS NOT NULL GROUP BY category) AS m"""


def advice(texts, price: str | None = None) -> str:
    def text(t: str) -> str:
        if price is None:
            return f"'{t}'"
        before, after = t.split("{}")
        return f"'{before}' || printf('%.2f', {price}) || '{after}'"
    return f"""CASE WHEN elasticity > -0.5 THEN {text(texts[0])} WHEN elasticity > -1 THEN {text(texts[1])}
      WHEN elasticity > -1.5 THEN {text(texts[2])} ELSE {text(texts[3])} END"""


def listed(name: str, source: str, value: str, direction: str, n: int, *ties: str) -> str:
    order = ", ".join([f"{value} {direction} NULLS LAST", *ties])
    return f"""SELECT *, '{name}' AS ranking FROM (SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank FROM ({source}) AS s) AS r WHERE rank <= {n}"""


BUCKETED = f"(SELECT *, {bucket()} AS bucket_no FROM f)"


def every_bucket(value: str, expression: str) -> str:
    return f"""SELECT CAST(labels.bucket_no AS INTEGER) AS bucket_no, bucket, {value} FROM labels LEFT JOIN
      (SELECT bucket_no, avg({expression}) AS {value} FROM {BUCKETED} AS b GROUP BY bucket_no) AS m ON m.bucket_no = labels.bucket_no"""


CATEGORY_BUCKETS = f"""SELECT category, CAST(b.bucket_no AS INTEGER) AS bucket_no, avg(revenue) AS avg_revenue, bucket FROM {BUCKETED} AS b
  JOIN labels ON labels.bucket_no = b.bucket_no GROUP BY category, b.bucket_no, bucket"""


def dense(key: str, source: str = "f") -> str:
    return f"""SELECT k.{key}, d.date, CAST(coalesce(sum(units_sold), 0) AS BIGINT) AS units_sold
      FROM (SELECT DISTINCT {key} FROM {source}) AS k CROSS JOIN (SELECT DISTINCT date FROM {source}) AS d
      LEFT JOIN {source} AS s ON s.{key} = k.{key} AND s.date = d.date GROUP BY k.{key}, d.date"""


PANEL = f"""{top_rows("product_id", 5)},
  panel AS (SELECT 'total' AS kind, 'all' AS series_id, date AS ds, CAST(sum(units_sold) AS DOUBLE) AS y FROM f GROUP BY date
    UNION ALL SELECT 'category', category, date, CAST(units_sold AS DOUBLE) FROM ({dense("category")}) AS c
    UNION ALL SELECT 'product', product_id, date, CAST(units_sold AS DOUBLE) FROM ({dense("product_id", "top_rows")}) AS p),
  split AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY kind, series_id ORDER BY ds) <= floor(count(*) OVER (PARTITION BY kind, series_id) * 0.8::DOUBLE)
    THEN 'train' ELSE 'test' END AS split, lag(y, 7) OVER (PARTITION BY kind, series_id ORDER BY ds) AS predicted FROM panel)"""


def scores(keys: str, where: str) -> str:
    return f"""SELECT {keys}, count(*) AS n, avg(abs(y - predicted)) AS mae, sqrt(avg((y - predicted) * (y - predicted))) AS rmse,
      1 - sum((y - predicted) * (y - predicted)) / nullif(var_pop(y) * count(*), 0) AS r2,
      avg(abs((y - predicted) / nullif(y, 0))) AS mape FROM split WHERE predicted IS NOT NULL AND {where} GROUP BY {keys}"""


SCORES = scores("kind, series_id", "split = 'test'")

# A constant, decades since 2000, the days from Tuesday to Sunday, five yearly waves, and the logarithm.
DAY_NUMBER = "date_diff('day', DATE '1970-01-01', ds)"
MEASURES = ["1.0::DOUBLE", f"({DAY_NUMBER} - 10957) / 3652.5::DOUBLE"]
MEASURES += [f"CAST(isodow(ds) = {k} AS INTEGER)::DOUBLE" for k in range(2, 8)]
MEASURES += [f"{wave}({k} * {DAY_NUMBER} * 2 * pi() / 365.25::DOUBLE)" for k in range(1, 6) for wave in ("sin", "cos")]
MEASURES += ["ln(y + 1)"]
NORMAL_SUMS = f"""SELECT kind, series_id, CAST(row_number() OVER (PARTITION BY kind, series_id ORDER BY i, j) - 1 AS INTEGER) AS pair, total
    FROM (SELECT kind, series_id, i, j, sum(m[i] * m[j]) AS total
          FROM (SELECT kind, series_id, [{", ".join(MEASURES)}] AS m FROM panel WHERE kind IN ('total', 'category')) AS a,
               range(1, {len(MEASURES) + 1}) AS r(i), range(1, {len(MEASURES) + 1}) AS s(j)
          WHERE i <= j GROUP BY kind, series_id, i, j) AS b"""
DAILY_STORE = "daily AS (SELECT date, store_id, CAST(sum(units_sold) AS BIGINT) AS units_sold FROM f GROUP BY date, store_id)"
LAGS = ", ".join(f"CAST(lag(units_sold, {k}) OVER (PARTITION BY store_id ORDER BY date) AS DOUBLE) AS lag_{k}" for k in (1, 7, 14, 28))


def rolling(shift: int) -> str:
    parts = []
    for w in (7, 14, 28):
        frame = f"OVER (PARTITION BY store_id ORDER BY date ROWS BETWEEN {w - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"
        parts.append(f"CASE WHEN count(units_sold) {frame} = {w} THEN avg(units_sold) {frame} END AS rolling_{w}")
    return ", ".join(parts)


STORE_DAY = """store_day AS (SELECT date, store_id, CAST(sum(units_sold) AS BIGINT) AS units_sold, avg(inventory_level) AS avg_inventory, avg(price) AS avg_price,
  avg(discount) AS avg_discount, avg(competitor_pricing) AS avg_competitor,
  first(weather ORDER BY product_id, price, units_sold, weather) AS weather,
  first(holiday_promotion ORDER BY product_id, price, units_sold, holiday_promotion) AS holiday_promotion,
  month(date) AS month, year(date) AS year, day(date) AS day, isodow(date) - 1 AS weekday, weekofyear(date) AS week FROM f GROUP BY date, store_id)"""


def split_rows(source: str) -> str:
    return f"""SELECT *, CASE WHEN row_number() OVER (ORDER BY date, store_id) <= floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM {source}"""


SCALED = ("avg_inventory", "avg_price", "avg_discount", "avg_competitor")
STANDARDISED = f"""SELECT date, store_id, split, {", ".join(f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}" for c in SCALED)}
  FROM marked, (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALED)} FROM marked WHERE split = 'train') AS t"""

SLICE = """date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND category IN ('ECONOMY', 'STANDARD') AND region IN ('ASIA', 'EUROPE')"""
KPI_COLUMNS = "date, category, store_id, region, product_id, units_sold, inventory_level, demand_forecast"


def kpis(where: str) -> str:
    return f"""SELECT *, coalesce(total_sales / nullif(avg_inventory, 0), 0) AS inventory_turn FROM (SELECT CAST(sum(units_sold) AS BIGINT) AS total_sales,
      avg(inventory_level) AS avg_inventory, 100 - 100 * avg(abs(units_sold - demand_forecast)) / nullif(avg(units_sold), 0) AS forecast_accuracy_pct
      FROM f WHERE {where}) AS k"""


ORDERED = ", ".join(FACT_COLUMNS)
SEASONAL_SUMMARY = f"""
  SELECT * FROM (SELECT 'peak_month' AS item, month_name AS label, avg_units AS value FROM ({monthly('one', '(SELECT *, 1 AS one FROM f)')}) AS a
    ORDER BY avg_units DESC NULLS LAST, month_no LIMIT 1) AS p
  UNION ALL SELECT * FROM (SELECT 'most_seasonal_category', category, seasonality_index FROM ({index("category")}) AS b ORDER BY seasonality_index DESC, category LIMIT 1) AS q
  UNION ALL SELECT * FROM (SELECT 'best_weather', weather, avg_units FROM ({mean_by("weather")}) AS c ORDER BY avg_units DESC, weather LIMIT 1) AS r
  UNION ALL SELECT * FROM (SELECT 'worst_weather', weather, avg_units FROM ({mean_by("weather")}) AS d ORDER BY avg_units, weather LIMIT 1) AS s"""

def labelled(name: str, body: str, value: str, *keys: str) -> str:
    label = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"SELECT '{name}' AS table_name, {label} AS label, {value} AS value FROM ({body}) AS t"


# Without coefficients the series grows by its last difference of a week; error j days ahead weighs 1 + j // 7.
SEASONAL_WALK = """
  WITH days AS (
    SELECT *, y - lag(y, 1) OVER w - lag(y, 7) OVER w + lag(y, 8) OVER w AS z, y - lag(y, 7) OVER w AS growth,
           row_number() OVER (PARTITION BY kind, series_id ORDER BY ds DESC) AS back
    FROM panel WINDOW w AS (PARTITION BY kind, series_id ORDER BY ds)
  ), series AS (
    SELECT kind, series_id, max(ds) AS last, stddev_pop(z) AS noise, count(*) AS n, max(growth) FILTER (back = 1) AS growth
    FROM days GROUP BY kind, series_id
  ), ahead AS (
    SELECT CAST(h AS INTEGER) AS h, 1 + (h - 1) // 7 AS weeks, sqrt(sum((1 + (h - 1) // 7) ** 2) OVER (ORDER BY h)) AS width
    FROM generate_series(1, 30) AS g(h)
  ), path AS (
    SELECT kind, series_id, last + h AS ds, days.y + series.growth * weeks AS predicted, 1.959964 * noise * width AS spread
    FROM series JOIN ahead ON n >= 8 + 30 + 14 JOIN days USING (kind, series_id) WHERE back = 7 - (h - 1) % 7
  )
  SELECT kind, series_id, ds, predicted, predicted - spread AS lower, predicted + spread AS upper,
         CAST(NULL AS VARCHAR) AS error, true AS converged FROM path
  UNION ALL
  SELECT kind, series_id, NULL, NULL, NULL, NULL, 'only ' || n || ' days', NULL FROM series WHERE n < 8 + 30 + 14
"""

ORACLE: dict[str, str] = {
    "s3_read_results": sql("pct", "SELECT status AS supply_status, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM f GROUP BY status"),
    "w1_w20_from_sums": sql("value", union([
        labelled("monthly_by_category", monthly("category"), "avg_units", "month_no", "month_name", "category"),
        labelled("monthly_by_region", monthly("region"), "avg_units", "month_no", "month_name", "region"),
        labelled("weather", mean_by("weather"), "avg_units", "weather"),
        labelled("promotion", mean_by("holiday_promotion"), "avg_units", "holiday_promotion"),
        labelled("season_category", mean_by("seasonality", "category"), "avg_units", "seasonality", "category"),
        labelled("day_of_week", "SELECT dayname(date) AS day_name, avg(units_sold) AS avg_units FROM f GROUP BY 1", "avg_units", "day_name")])),
    "g7_g14_from_sums": sql("value", union([
        labelled("discount", "SELECT discount, avg(revenue) AS avg_revenue FROM f GROUP BY discount", "avg_revenue", "discount"),
        labelled("category_discount", "SELECT category, discount, avg(revenue) AS avg_revenue FROM f GROUP BY category, discount", "avg_revenue", "category", "discount"),
        labelled("optimal_discount", "SELECT discount, avg(revenue) AS avg_revenue FROM f GROUP BY discount ORDER BY avg_revenue DESC, discount LIMIT 1", "avg_revenue", "discount"),
        labelled("bucket", every_bucket("avg_revenue", "revenue"), "avg_revenue", "bucket_no", "bucket"),
        labelled("category_bucket", CATEGORY_BUCKETS, "avg_revenue", "category", "bucket_no", "bucket"),
        labelled("category_position", f"""SELECT category, bucket, avg_revenue FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY avg_revenue DESC, bucket_no) AS rn
          FROM ({CATEGORY_BUCKETS}) AS c) AS x WHERE rn = 1""", "avg_revenue", "category", "bucket")]), labels()),
    "s1_read_fact_csv": sql("demand_forecast price competitor_pricing", f"SELECT {COLUMNS} FROM fact"),
    "s1_read_fact_parquet": sql("demand_forecast price competitor_pricing", f"SELECT {COLUMNS} FROM fact"),
    "s1_read_fact": sql("demand_forecast price competitor_pricing", "SELECT * FROM fact"),
    "s2_write_json": sql("pct", "SELECT status AS supply_status, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM f GROUP BY status"),
    "c1_calendar_columns": sql("", """SELECT date, store_id, year(date) AS year, quarter(date) AS quarter, month(date) AS month, weekofyear(date) AS week,
        day(date) AS day, isodow(date) - 1 AS weekday, strftime(date, '%b') AS month_name, strftime(date, '%Y-%m') AS month_year FROM f"""),
    "c2_inventory_sales_ratio": sql("ratio", "SELECT inventory_level, units_sold, ratio FROM f"),
    "c3_sell_through_rate": sql("rate", "SELECT inventory_level, units_sold, units_sold / nullif(inventory_level + units_sold, 0) AS rate FROM f"),
    "c4_forecast_accuracy": sql("demand_forecast accuracy", "SELECT demand_forecast, units_sold, accuracy FROM f"),
    "c5_supply_gap": sql("", "SELECT inventory_level, units_sold, gap FROM f"),
    "c6_optimal_inventory": sql("optimal", "SELECT units_sold, CAST(units_sold * 1.5 AS DOUBLE) AS optimal FROM f"),
    "c7_supply_status": sql("", "SELECT inventory_level, units_sold, status FROM f"),
    "c8_net_revenue": sql("price revenue", "SELECT price, units_sold, discount, revenue FROM f"),
    "c9_price_difference": sql("price competitor_pricing difference pct", "SELECT price, competitor_pricing, price - competitor_pricing AS difference, diff_pct AS pct FROM f"),
    "c10_price_diff_bucket": sql("price competitor_pricing", f"""SELECT price, competitor_pricing, CAST(coalesce(b.bucket_no, -1) AS INTEGER) AS bucket_no, bucket
        FROM {BUCKETED} AS b LEFT JOIN labels ON labels.bucket_no = b.bucket_no""", labels()),
    "c11_clip": sql("clipped", "SELECT inventory_level, units_sold, CASE WHEN ratio IS NOT NULL THEN greatest(least(ratio, 10.0::DOUBLE), 0.0::DOUBLE) END AS clipped FROM f"),
    "c12_one_hot": sql("", "SELECT date, store_id, weather, CASE WHEN weather = 'A' THEN 1 ELSE 0 END AS weather_A, CASE WHEN weather = 'N' THEN 1 ELSE 0 END AS weather_N, CASE WHEN weather = 'R' THEN 1 ELSE 0 END AS weather_R FROM f"),
    "c13_log_transform": sql("price log_price log_quantity", "SELECT price, units_sold, ln(price) AS log_price, ln(units_sold) AS log_quantity FROM f"),
    "c14_recode_flag": sql("", "SELECT date, holiday_promotion, CASE WHEN holiday_promotion = 1 THEN 'Yes' ELSE 'No' END AS promotion FROM f"),
    "c15_category_price_action": sql("elasticity", f"SELECT category, elasticity, {advice(CATEGORY_ADVICE)} AS recommendation FROM ({category_elasticity('product_id')}) AS e", fits("product_id")),
    "c16_product_price_action": sql("elasticity avg_price", f"SELECT product_id, elasticity, avg_price, {advice(PRODUCT_ADVICE, 'avg_price')} AS recommendation FROM fits", fits("product_id")),
    "p1_filter_slice": sql("demand_forecast", f"SELECT {KPI_COLUMNS} FROM f WHERE {SLICE}"),
    "p2_topn_semi": sql("", "SELECT date, product_id, store_id, units_sold FROM top_rows", top_rows("product_id", 10)),
    "p2_topn_semi_sku": sql("", "SELECT date, sku, store_id, units_sold FROM top_rows", top_rows("sku", 10)),
    "p3_latest_day": sql("", "SELECT date, store_id, product_id, units_sold, inventory_level FROM f WHERE date = (SELECT max(date) FROM f)"),
    "p4_poor_forecast_rows": sql("demand_forecast forecast_accuracy", """SELECT date, store_id, units_sold, demand_forecast, accuracy AS forecast_accuracy FROM f
        WHERE accuracy < (SELECT quantile_cont(accuracy, 0.1) FROM f)"""),
    "p4_poor_forecast_head": sql("demand_forecast price competitor_pricing forecast_accuracy", f"SELECT {COLUMNS}, accuracy AS forecast_accuracy FROM f WHERE accuracy < 0.5 ORDER BY {ORDERED} LIMIT 10"),
    "p5_status_head": sql("demand_forecast price competitor_pricing", f"SELECT {COLUMNS}, status AS supply_status FROM f WHERE status = 'Undersupplied' ORDER BY {ORDERED} LIMIT 10"),
    "p6_drop_incomplete": sql("lag_1 lag_7 lag_14 lag_28 rolling_7 rolling_14 rolling_28", f"SELECT * FROM (SELECT *, {LAGS}, {rolling(1)} FROM daily) AS x WHERE lag_28 IS NOT NULL AND rolling_28 IS NOT NULL", DAILY_STORE),
    "p7_positive_points": sql("price", "SELECT date, product_id, price, units_sold FROM f WHERE price > 0 AND units_sold > 0"),
    "p8_filter_options": sql("", union([f"SELECT DISTINCT '{c}' AS field, {c} AS value FROM f" for c in ("category", "store_id", "region", "product_id")]
        + ["SELECT 'min_date', CAST(min(date) AS VARCHAR) FROM f", "SELECT 'max_date', CAST(max(date) AS VARCHAR) FROM f"])),
    "a1_basic_info": sql("", union(f"SELECT '{f.name}' AS column_name, '{f.dataType.simpleString()}' AS data_type, count(*) AS n_rows, CAST({len(FACT_COLUMNS)} AS BIGINT) AS n_columns, count(*) FILTER (WHERE {f.name} IS NULL) AS n_missing FROM f" for f in FACT_SCHEMA)),
    "a2_null_counts": sql("", union(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM damaged" for c in FACT_COLUMNS)),
    "a3_duplicate_count": sql("", f"SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM f GROUP BY {COLUMNS}) AS x"),
    "a3_duplicate_count_documents": "SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang) AS x",
    "a4_temporal_range": sql("", "SELECT min(date) AS min_date, max(date) AS max_date, date_diff('day', min(date), max(date)) + 1 AS span_days, count(DISTINCT date) AS n_dates FROM f"),
    "a5_monthly_counts": sql("", "SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, count(*) AS n FROM f GROUP BY ALL"),
    "a6_category_counts": sql("", CATEGORY_COUNTS),
    "a7_numeric_describe": sql("mean std min max median range", f"SELECT column_name, mean, std, min, max, max - min AS range, q50 AS median FROM ({DESCRIBE}) AS d"),
    "a8_summary_stats": sql("mean std min max q25 q50 q75", DESCRIBE),
    "a9_correlation_matrix": sql("r", corr_rows()),
    "a10_pair_correlation": sql("r", "SELECT round_even(corr(price, units_sold), 3) AS r FROM f"),
    "a11_group_means": sql("mean", GROUP_MEANS),
    "a12_top_products": sql("", top("product_id", 5)),
    "a12_top_stores": sql("", top("store_id", 5)),
    "a13_category_totals": sql("", top("category", 1000)),
    "a14_mean_by_discount": sql("avg_units", "SELECT discount, round_even(avg(units_sold), 2) AS avg_units FROM f GROUP BY discount"),
    "a14_mean_by_season": sql("avg_units", "SELECT seasonality, round_even(avg(units_sold), 2) AS avg_units FROM f GROUP BY seasonality"),
    "a14_mean_by_weather": sql("avg_units", "SELECT weather, round_even(avg(units_sold), 2) AS avg_units FROM f GROUP BY weather"),
    "a15_mean_inventory_ratio": sql("avg_inventory_sales_ratio", "SELECT avg(ratio) AS avg_inventory_sales_ratio FROM f"),
    "a16_mean_forecast_accuracy": sql("avg_forecast_accuracy", "SELECT avg(accuracy) AS avg_forecast_accuracy FROM f"),
    "a17_histogram": sql("bin_low bin_high", BINS, HISTOGRAM),
    "a17_ratio_histogram": sql("bin_low bin_high", BINS, RATIO_HISTOGRAM),
    "a18_box_stats": sql("q1 median q3 low_whisker high_whisker", BOX),
    "a19_monthly_totals": sql("", """SELECT CAST(m AS DATE) AS month_start, CAST(coalesce(sum(units_sold), 0) AS BIGINT) AS units_sold
        FROM (SELECT unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS m FROM f) AS s
        LEFT JOIN f ON date_trunc('month', date) = m GROUP BY m"""),
    "a20_column_profile": sql("min_value max_value mean q25 q50 q75", PROFILE),
    "q1_missing_report": sql("pct", union(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*) AS pct FROM damaged" for c in FACT_COLUMNS)),
    "q2_negative_report": sql("pct", negatives("fact")),
    "q2_negative_report_damaged": sql("pct", negatives("damaged")),
    "q3_rule_violations": sql("", violations("fact")),
    "q3_rule_violations_damaged": sql("", violations("damaged")),
    "q4_rule_summary": sql("", rule_summary("fact")),
    "q4_rule_summary_damaged": sql("", rule_summary("damaged")),
    "q6_iqr_outliers": sql("low_fence high_fence pct", outliers("fact")),
    "q7_date_continuity": sql("", "SELECT *, span_days - n_dates AS n_missing, span_days = n_dates AS passed FROM (SELECT min(date) AS min_date, max(date) AS max_date, date_diff('day', min(date), max(date)) + 1 AS span_days, count(DISTINCT date) AS n_dates FROM f) AS x"),
    "q7_missing_days": sql("", "SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM f) AS s WHERE CAST(d AS DATE) NOT IN (SELECT date FROM f)"),
    "q8_validation_status": sql("", status("fact")),
    "q8_validation_status_damaged": sql("", status("damaged")),
    "q9_light_status": sql("", f"""SELECT *, n_missing = 0 AND n_negative_inventory = 0 AS passed FROM (SELECT {" + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in FACT_COLUMNS)} AS n_missing,
        count(*) FILTER (WHERE inventory_level < 0) AS n_negative_inventory FROM fact) AS x"""),
    "w1_monthly_by_category": sql("avg_units", monthly("category")),
    "w2_category_peak_month": sql("peak_value", peak("category")),
    "w3_category_seasonality_index": sql("seasonality_index", index("category")),
    "w4_top10_products": sql("", top("product_id", 10)),
    "w5_monthly_by_top_product": sql("avg_units", monthly("product_id", "top_rows"), top_rows("product_id", 10)),
    "w6_product_peak_month": sql("peak_value", peak("product_id", "top_rows"), top_rows("product_id", 10)),
    "w7_monthly_by_region": sql("avg_units", monthly("region")),
    "w8_region_peak_month": sql("peak_value", peak("region")),
    "w9_monthly_overall": sql("avg_units", f"SELECT month_no, month_name, avg_units FROM ({monthly('one', '(SELECT *, 1 AS one FROM f)')}) AS x"),
    "w10_weather_impact": sql("avg_units", mean_by("weather")),
    "w11_promotion_impact": sql("avg_units", mean_by("holiday_promotion")),
    "w12_yearly_monthly": sql("avg_units", monthly("year", "years"), "years AS (SELECT *, CAST(year(date) AS INTEGER) AS year FROM f)"),
    "w13_seasonality_summary": sql("value", SEASONAL_SUMMARY),
    "w14_seasonal_by_category": sql("avg_units", mean_by("seasonality", "category")),
    "w15_top_category_by_season": sql("", by_season("category")),
    "w16_seasonal_by_top_product": sql("avg_units", "SELECT seasonality, product_id, avg(units_sold) AS avg_units FROM top_rows GROUP BY seasonality, product_id", top_rows("product_id", 5)),
    "w17_high_variance_products": sql("mean std cv", "SELECT *, std / nullif(mean, 0) AS cv FROM (SELECT product_id, avg(units_sold) AS mean, stddev_samp(units_sold) AS std FROM f GROUP BY product_id) AS x ORDER BY cv DESC NULLS LAST, product_id LIMIT 5"),
    "w18_seasonal_by_region": sql("avg_units", mean_by("seasonality", "region")),
    "w18_best_region_by_season": sql("", by_season("region")),
    "w19_seasonal_overall": sql("avg_units", mean_by("seasonality")),
    "w20_day_of_week_sales": sql("avg_units", "SELECT dayname(date) AS day_name, avg(units_sold) AS avg_units FROM f GROUP BY 1"),
    "y1_supply_status_counts": sql("pct", "SELECT status AS supply_status, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM f GROUP BY status"),
    "y2_status_by_category": sql("", """SELECT category, count(*) FILTER (WHERE status = 'Optimal') AS "Optimal", count(*) FILTER (WHERE status = 'Oversupplied') AS "Oversupplied",
        count(*) FILTER (WHERE status = 'Undersupplied') AS "Undersupplied", count(*) FILTER (WHERE status = 'Unknown') AS "Unknown" FROM f GROUP BY category"""),
    "y3_status_pct_by_category": sql("pct", status_by("category")),
    "y4_product_supply_metrics": sql("avg_gap avg_inventory avg_accuracy avg_ratio", product_metrics("product_id, category")),
    "y5_critical_undersupply": sql("avg_gap avg_inventory avg_accuracy", """SELECT * EXCLUDE (avg_ratio) FROM under WHERE units_sold > (SELECT quantile_cont(units_sold::DOUBLE, 0.5) FROM under)
        ORDER BY avg_gap, product_id, category LIMIT 10""", f"under AS (SELECT * FROM ({product_metrics('product_id, category')}) AS p WHERE supply_status = 'Undersupplied')"),
    "y6_excessive_oversupply": sql("avg_gap avg_inventory avg_accuracy", """SELECT * EXCLUDE (avg_ratio) FROM over_ WHERE avg_gap > (SELECT quantile_cont(avg_gap, 0.9) FROM over_)
        ORDER BY avg_gap DESC, product_id, category LIMIT 10""", f"over_ AS (SELECT * FROM ({product_metrics('product_id, category')}) AS p WHERE supply_status = 'Oversupplied')"),
    "y7_store_supply_metrics": sql("avg_ratio avg_gap avg_accuracy", f"SELECT store_id, supply_status, avg_ratio, avg_gap, avg_accuracy FROM ({product_metrics('store_id')}) AS p"),
    "y8_supply_overall": sql("avg_ratio avg_gap avg_accuracy", "SELECT avg(ratio) AS avg_ratio, avg(gap) AS avg_gap, avg(accuracy) AS avg_accuracy FROM f"),
    "y9_category_gap_extremes": sql("avg_gap", """SELECT * FROM (SELECT category, avg(gap) AS avg_gap, 'most_undersupplied' AS item FROM f GROUP BY category ORDER BY avg_gap, category LIMIT 1) AS a
        UNION ALL SELECT * FROM (SELECT category, avg(gap) AS avg_gap, 'most_oversupplied' FROM f GROUP BY category ORDER BY avg_gap DESC, category LIMIT 1) AS b"""),
    "y10_category_supply_metrics": sql("avg_ratio avg_gap avg_accuracy", "SELECT category, avg(ratio) AS avg_ratio, avg(gap) AS avg_gap, avg(accuracy) AS avg_accuracy FROM f GROUP BY category"),
    "y11_product_supply_rankings": sql("avg_gap avg_inventory avg_accuracy avg_ratio", union([
        listed("most_sold", product_metrics("product_id"), "units_sold", "DESC", 10, "product_id"),
        listed("most_undersupplied", product_metrics("product_id"), "avg_gap", "ASC", 10, "product_id"),
        listed("most_oversupplied", product_metrics("product_id"), "avg_gap", "DESC", 10, "product_id"),
        listed("worst_forecast", product_metrics("product_id"), "avg_accuracy", "ASC", 10, "product_id")])),
    "y12_store_status_distribution": sql("pct", status_by("store_id")),
    "y12_store_sums": sql("", "SELECT store_id, CAST(sum(units_sold) AS BIGINT) AS units_sold, CAST(sum(inventory_level) AS BIGINT) AS inventory_level FROM f GROUP BY store_id"),
    "y13_poor_forecast_products": sql("avg_accuracy", "SELECT product_id, category, avg(accuracy) AS avg_accuracy FROM f GROUP BY product_id, category ORDER BY avg_accuracy, product_id, category LIMIT 5"),
    "n1_demand_stats": sql("demand_mean demand_std annual_demand unit_cost", "SELECT product_id, store_id, avg(units_sold) AS demand_mean, stddev_samp(units_sold) AS demand_std, CAST(sum(units_sold) AS DOUBLE) AS annual_demand, avg(price) AS unit_cost FROM f GROUP BY product_id, store_id"),
    "n2_annualised_demand": sql("demand_mean demand_std annual_demand unit_cost", f"SELECT product_id, store_id, demand_mean, demand_std, annual_demand, unit_cost FROM ({stock(always=True)}) AS s"),
    "n3_safety_stock": sql("safety_stock", f"SELECT product_id, store_id, safety_stock FROM ({stock()}) AS s"),
    "n4_reorder_point": sql("reorder_point", f"SELECT product_id, store_id, reorder_point FROM ({stock()}) AS s"),
    "n5_eoq": sql("eoq", f"SELECT product_id, store_id, eoq FROM ({stock()}) AS s"),
    "n6_inventory_params": sql("demand_mean demand_std annual_demand unit_cost", whole_stock()),
    "n6_inventory_params_sku": sql("demand_mean demand_std annual_demand unit_cost", whole_stock("sku, store_id")),
    "n7_product_inventory_params": sql("demand_mean demand_std annual_demand unit_cost", PRODUCT_STOCK),
    "n8_top10_inventory_products": sql("demand_mean demand_std annual_demand unit_cost", f"SELECT * FROM ({PRODUCT_STOCK}) AS p ORDER BY annual_demand DESC, product_id LIMIT 10"),
    "n9_store_top5_products": sql("annual_demand", f"""SELECT store_id, rank, product_id, annual_demand, safety_stock, reorder_point, eoq FROM (SELECT *, CAST(row_number() OVER
        (PARTITION BY store_id ORDER BY annual_demand DESC, product_id) AS INTEGER) AS rank FROM ({whole_stock()}) AS w) AS r WHERE rank <= 5"""),
    "n10_inventory_lookup": sql("demand_mean demand_std annual_demand unit_cost", f"SELECT * FROM ({PRODUCT_STOCK}) AS p WHERE product_id = 'Brand#1'"),
    "g1_price_points": sql("price avg_units", "SELECT product_id, price, avg_units FROM usable WHERE product_id IN (SELECT product_id FROM usable GROUP BY product_id HAVING count(*) > 2)", fits("product_id")),
    "g2_product_elasticity": sql("elasticity avg_price", elasticity("product_id"), fits("product_id")),
    "g2_sku_elasticity": sql("elasticity avg_price", elasticity("sku"), fits("sku")),
    "g3_product_category": sql("", "SELECT product_id, category FROM first_seen", fits("product_id")),
    "g4_category_elasticity": sql("elasticity", category_elasticity("product_id"), fits("product_id")),
    "g4_category_elasticity_sku": sql("elasticity", category_elasticity("sku"), fits("sku")),
    "g5_elasticity_summary": sql("", "SELECT count(*) AS n_products, count(*) FILTER (WHERE elasticity < -1) AS n_elastic, count(*) FILTER (WHERE elasticity >= -1) AS n_inelastic FROM fits", fits("product_id")),
    "g6_elasticity_curve": sql("price fitted_units", """SELECT product_id, step, price, exp(intercept + elasticity * ln(price)) AS fitted_units FROM (SELECT *, CAST(step AS INTEGER) AS step,
        min_price + step * ((max_price - min_price) / 99) AS price FROM fits, (SELECT unnest(range(100)) AS step) AS g) AS x""".replace("SELECT *, CAST(step AS INTEGER) AS step", "SELECT fits.*, CAST(g.step AS INTEGER) AS step"), fits("product_id")),
    "g7_discount_units": sql("avg_units", mean_by("discount")),
    "g8_discount_revenue": sql("avg_revenue", "SELECT discount, avg(revenue) AS avg_revenue FROM f GROUP BY discount"),
    "g9_optimal_discount": sql("avg_revenue", "SELECT discount, avg(revenue) AS avg_revenue FROM f GROUP BY discount ORDER BY avg_revenue DESC, discount LIMIT 1"),
    "g10_category_discount_revenue": sql("avg_revenue", "SELECT category, discount, avg(revenue) AS avg_revenue FROM f GROUP BY category, discount"),
    "g10_category_optimal_discount": sql("avg_revenue", """SELECT category, discount, avg_revenue FROM (SELECT category, discount, avg(revenue) AS avg_revenue,
        row_number() OVER (PARTITION BY category ORDER BY avg(revenue) DESC, discount) AS rn FROM f GROUP BY category, discount) AS x WHERE rn = 1"""),
    "g11_bucket_units": sql("avg_units", every_bucket("avg_units", "units_sold"), labels()),
    "g12_bucket_revenue": sql("avg_revenue", every_bucket("avg_revenue", "revenue"), labels()),
    "g13_optimal_price_position": sql("avg_revenue", f"{every_bucket('avg_revenue', 'revenue')} ORDER BY avg_revenue DESC NULLS LAST, labels.bucket_no LIMIT 1", labels()),
    "g14_category_bucket_revenue": sql("avg_revenue", CATEGORY_BUCKETS, labels()),
    "g14_category_price_position": sql("avg_revenue", f"""SELECT category, bucket, avg_revenue FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY avg_revenue DESC, bucket_no) AS rn
        FROM ({CATEGORY_BUCKETS}) AS c) AS x WHERE rn = 1""", labels()),
    "g15_category_price_recommendations": sql("elasticity", f"SELECT category, elasticity, {advice(CATEGORY_ADVICE)} AS recommendation FROM ({category_elasticity('product_id')}) AS e", fits("product_id")),
    "g16_product_price_recommendations": sql("elasticity avg_price", f"""SELECT *, {advice(PRODUCT_ADVICE, 'avg_price')} AS recommendation FROM ({union([
        listed("most_elastic", "SELECT product_id, elasticity, avg_price FROM fits", "elasticity", "ASC", 5, "product_id"),
        listed("least_elastic", "SELECT product_id, elasticity, avg_price FROM fits", "elasticity", "DESC", 5, "product_id")])}) AS u""", fits("product_id")),
    "f1_daily_totals": sql("", "SELECT date, CAST(sum(units_sold) AS BIGINT) AS units_sold FROM f GROUP BY date"),
    "f2_daily_by_category": sql("", dense("category")),
    "f3_daily_by_store": sql("", dense("store_id")),
    "f3_daily_gaps": sql("", """SELECT date, store_id, units_sold,
        CAST(coalesce(lead(day_no) OVER w, (SELECT max(day_no) FROM days) + 1) - day_no AS INTEGER) AS n_days,
        CAST(CASE WHEN lag(day_no) OVER w IS NULL THEN day_no - 1 ELSE 0 END AS INTEGER) AS n_before
        FROM daily JOIN days USING (date) WINDOW w AS (PARTITION BY store_id ORDER BY day_no)""", f"""{DAILY_STORE},
        days AS (SELECT date, row_number() OVER (ORDER BY date) AS day_no FROM (SELECT DISTINCT date FROM daily) AS d)"""),
    "f4_daily_by_top_product": sql("", dense("product_id", "top_rows"), top_rows("product_id", 5)),
    "f5_chrono_split": sql("y", "SELECT kind, series_id, ds, y, split FROM split", PANEL),
    "f5_store_day_split": sql("", split_rows("daily"), DAILY_STORE),
    "f6_seasonal_difference": sql("y z", """SELECT kind, series_id, ds, y, y - lag(y, 1) OVER w - lag(y, 7) OVER w + lag(y, 8) OVER w AS z FROM panel
        WINDOW w AS (PARTITION BY kind, series_id ORDER BY ds)""", PANEL),
    "f6_seasonal_walk": sql("predicted lower upper", SEASONAL_WALK, PANEL),
    "f7_future_dates": sql("", "SELECT CAST(unnest(generate_series(max(date) + INTERVAL 1 DAY, max(date) + INTERVAL 30 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM f"),
    "f8_forecast_metrics": sql("mae rmse r2 mape", SCORES, PANEL),
    "f9_store_day_features": sql("avg_inventory avg_price avg_discount avg_competitor", "SELECT * FROM store_day", STORE_DAY),
    "f10_lag_features": sql("lag_1 lag_7 lag_14 lag_28", f"SELECT *, {LAGS} FROM daily", DAILY_STORE),
    "f11_rolling_features": sql("rolling_7 rolling_14 rolling_28", f"SELECT *, {rolling(1)} FROM daily", DAILY_STORE),
    "f11_rolling_features_same_day": sql("rolling_7 rolling_14 rolling_28", f"SELECT *, {rolling(0)} FROM daily", DAILY_STORE),
    "f12_standardise": sql(" ".join(SCALED), STANDARDISED, f"{STORE_DAY}, marked AS ({split_rows('store_day')})"),
    "f17_normal_sums": sql("total", NORMAL_SUMS, PANEL),
    "f16_history_tail": sql("", "SELECT date, CAST(sum(units_sold) AS BIGINT) AS units_sold FROM f GROUP BY date ORDER BY date DESC LIMIT 90"),
    "f19_naive_leaderboard": sql("mae rmse r2 mape", f"SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY rmse, series_id) AS INTEGER) AS rank FROM ({SCORES}) AS s", PANEL),
    "f20_seasonal_naive": sql("y predicted", "SELECT kind, series_id, ds, y, predicted FROM split", PANEL),
    "d1_kpis": sql("avg_inventory forecast_accuracy_pct inventory_turn", kpis("true")),
    "d1_kpis_sliced": sql("avg_inventory forecast_accuracy_pct inventory_turn", kpis(SLICE)),
    "d2_sales_trend": sql("", "SELECT date, CAST(sum(units_sold) AS BIGINT) AS units_sold FROM f GROUP BY date"),
    "d3_sales_by_category": sql("", top("category", 1000)),
    "d4_top_products_table": sql("avg_inventory avg_price avg_discount", """SELECT product_id, category, CAST(sum(units_sold) AS BIGINT) AS units_sold, round_even(avg(inventory_level), 1) AS avg_inventory,
        round_even(avg(price), 2) AS avg_price, round_even(avg(discount), 2) AS avg_discount FROM f GROUP BY product_id, category ORDER BY units_sold DESC, product_id, category LIMIT 10"""),
    "d5_inventory_vs_sales": sql("avg_inventory", """SELECT a.date, avg_inventory, units_sold FROM (SELECT date, avg(inventory_level) AS avg_inventory FROM f GROUP BY date) AS a
        JOIN (SELECT date, CAST(sum(units_sold) AS BIGINT) AS units_sold FROM f GROUP BY date) AS b ON a.date = b.date"""),
    "d2_sales_trend_sliced": sql("", f"SELECT date, CAST(sum(units_sold) AS BIGINT) AS units_sold FROM f WHERE {DAYS_AND_REGIONS} AND {CATEGORY_CHOICE} AND {PRODUCT_CHOICE} GROUP BY date"),
    "d3_sales_by_category_sliced": sql("", f"SELECT category, CAST(sum(units_sold) AS BIGINT) AS units_sold FROM f WHERE {DAYS_AND_REGIONS} AND {PRODUCT_CHOICE} GROUP BY category"),
    "d4_top_products_table_sliced": sql("avg_inventory avg_price avg_discount", f"""SELECT product_id, category, CAST(sum(units_sold) AS BIGINT) AS units_sold, round_even(avg(inventory_level), 1) AS avg_inventory,
        round_even(avg(price), 2) AS avg_price, round_even(avg(discount), 2) AS avg_discount FROM f WHERE {DAYS_AND_REGIONS} AND {CATEGORY_CHOICE} GROUP BY product_id, category ORDER BY units_sold DESC, product_id, category LIMIT 10"""),
    "d5_inventory_vs_sales_sliced": sql("avg_inventory", f"SELECT date, avg(inventory_level) AS avg_inventory, CAST(sum(units_sold) AS BIGINT) AS units_sold FROM f WHERE {DAYS_AND_REGIONS} AND {CATEGORY_CHOICE} AND {PRODUCT_CHOICE} GROUP BY date"),
    "d6_overview_cards": sql("", """SELECT count(DISTINCT product_id) AS n_products, count(DISTINCT store_id) AS n_stores, CAST(sum(units_sold) AS BIGINT) AS units_sold,
        (SELECT CAST(sum(inventory_level) AS BIGINT) FROM f WHERE date = (SELECT max(date) FROM f)) AS current_inventory FROM f"""),
    "d7_data_overview": sql("", union(["SELECT 'period_start' AS item, CAST(min(date) AS VARCHAR) AS value FROM f", "SELECT 'period_end', CAST(max(date) AS VARCHAR) FROM f",
        "SELECT 'n_stores', CAST(count(DISTINCT store_id) AS VARCHAR) FROM f", "SELECT 'n_products', CAST(count(DISTINCT product_id) AS VARCHAR) FROM f",
        "SELECT DISTINCT 'category', category FROM f", "SELECT DISTINCT 'region', region FROM f"])),
    "r1_naive_metrics": sql("value", union([
        "SELECT 'optimal_inventory_pct' AS metric, avg(CASE WHEN status = 'Optimal' THEN 1.0::DOUBLE ELSE 0 END) * 100 AS value FROM f",
        "SELECT 'avg_supply_gap', avg(gap) FROM f", "SELECT 'avg_forecast_accuracy', avg(accuracy) FROM f",
        f"SELECT 'naive_forecast_r2', r2 FROM ({scores('kind', chr(39).join(['split = ', 'test', ' AND kind = ', 'total', '']))}) AS s",
        "SELECT 'products_analyzed', CAST(count(*) AS DOUBLE) FROM fits", "SELECT 'inelastic_products', CAST(count(*) FILTER (WHERE elasticity >= -1) AS DOUBLE) FROM fits"]),
        f"{PANEL}, {fits('product_id')}"),
    "r2_key_insights": sql("", f"""SELECT 'peak_season' AS insight, (SELECT seasonality FROM ({mean_by('seasonality')}) AS a ORDER BY avg_units DESC, seasonality LIMIT 1) AS answer
        UNION ALL SELECT 'best_autumn_region', (SELECT region FROM ({by_season('region')}) AS b WHERE seasonality = 'Autumn')
        UNION ALL SELECT 'worst_forecast_category', (SELECT category FROM f GROUP BY category ORDER BY avg(accuracy), category LIMIT 1)
        UNION ALL SELECT 'optimal_discount', (SELECT CAST(discount AS VARCHAR) FROM f GROUP BY discount ORDER BY avg(revenue) DESC, discount LIMIT 1)
        UNION ALL SELECT 'optimal_price_position', (SELECT bucket FROM ({every_bucket('avg_revenue', 'revenue')}) AS c ORDER BY avg_revenue DESC NULLS LAST, bucket_no LIMIT 1)""", labels()),
}

ORACLE["f18_naive_from_cut"] = sql("y predicted", """SELECT h.kind, h.series_id, h.ds, h.y, k.y AS predicted
    FROM (SELECT *, row_number() OVER (ORDER BY ds DESC) AS r FROM panel WHERE kind = 'total') AS h
    JOIN (SELECT y, row_number() OVER (ORDER BY ds DESC) AS r FROM panel WHERE kind = 'total') AS k
      ON h.r <= 30 AND k.r = 30 + 7 - (30 - h.r) % 7""", PANEL)
ORACLE["p1_filter_slice_pruned"] = sql("demand_forecast price competitor_pricing", f"SELECT {COLUMNS} FROM f WHERE {DAYS_AND_REGIONS} AND {CATEGORY_CHOICE}")
ORACLE["p3_latest_day_pruned"] = sql("demand_forecast price competitor_pricing", f"SELECT {COLUMNS} FROM f WHERE date = (SELECT max(date) FROM f)")
ORACLE["s4_sample_rows"] = sql("price", """SELECT price, units_sold, inventory_level, category FROM f
    ORDER BY md5('42|' || coalesce(round_even(price * 1000000.0::DOUBLE, 0)::BIGINT::VARCHAR, 'null') || '|' || coalesce(units_sold::VARCHAR, 'null')
        || '|' || coalesce(inventory_level::VARCHAR, 'null') || '|' || coalesce(category, 'null')) LIMIT 5000""")
ORACLE["s5_run_stats"] = sql("", f"""SELECT count(*) AS n_rows, {len(FACT_COLUMNS)} AS n_columns, CAST(sum({' + '.join(
    f"CASE WHEN {f.name} IS NULL THEN 0 ELSE {dict(string=f'strlen({f.name})', date='4', int='4').get(f.dataType.simpleString(), '8')} END"
    for f in FACT_SCHEMA)}) AS BIGINT) AS data_bytes FROM f""")
