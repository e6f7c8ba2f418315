"""The datasets of the engine, derived from order tables.

Each text runs unchanged in Spark SQL and in other engines: a name in braces is
an input table.  Money is summed as decimals, so sums do not depend on order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SUFFIX = "CASE CAST({0} % 3 AS INT) WHEN 0 THEN '.SZ' WHEN 1 THEN '.SH' ELSE '.BJ' END"


def _code(key: str) -> str:
    return f"lpad(CAST({key} AS STRING), 6, '0') || " + _SUFFIX.format(key)


_BAR = """
    SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high,
           CAST(sum(CAST(l_quantity AS DECIMAL(12, 2))) AS DOUBLE) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS amount,
           max(CASE WHEN l_orderkey % 97 = 0 THEN 1 ELSE 0 END) = 1 AS is_paused
    FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS DATE)"""

DATASETS: dict[str, str] = {
    "stock_basic": f"""
SELECT {_code("s_suppkey")} AS stock_code, CASE WHEN s_suppkey % 11 = 0 THEN '*ST ' ELSE '' END || 'Stock ' || CAST(s_suppkey AS STRING) AS stock_name,
       CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'SZSE' WHEN 1 THEN 'SSE' ELSE 'BSE' END AS exchange,
       CAST(DATE '1995-01-01' + CAST((s_suppkey * 37) % 900 AS INT) AS STRING) AS list_date,
       CASE WHEN s_suppkey % 10 = 3 THEN CAST(DATE '1999-01-01' + CAST((s_suppkey * 53) % 900 AS INT) AS STRING) END AS delist_date,
       n_name AS industry, r_name AS market_type, s_suppkey % 11 = 0 AS is_st
FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey""",
    "daily_price": f"""
SELECT {_code("k")} AS stock_code, CAST(d AS STRING) AS trade_date, (low + high) / 2 AS open, high, low, amount / volume AS close,
       coalesce(lag(amount / volume) OVER (PARTITION BY k ORDER BY d), (low + high) / 2) AS pre_close, volume, amount * 1500.0e0 AS amount,
       (amount / volume / coalesce(lag(amount / volume) OVER (PARTITION BY k ORDER BY d), (low + high) / 2) - 1) * 100 AS pct_chg, is_paused,
       amount / volume * 1.1e0 AS limit_up, amount / volume * 0.9e0 AS limit_down
FROM ({_BAR}) b""",
    "adj_factor": f"""
SELECT DISTINCT {_code("l_suppkey")} AS stock_code, CAST(CAST(l_shipdate AS DATE) AS STRING) AS trade_date, CAST(1 + (l_suppkey % 5) * 0.01 AS DOUBLE) AS adj_factor
FROM {{lineitem}} WHERE l_suppkey % 17 <> 0""",
    "daily_basic": f"""
SELECT {_code("k")} AS stock_code, CAST(d AS STRING) AS trade_date, 4.0e0 + CAST(CAST(round(volume * 131) AS BIGINT) % 6000 AS DOUBLE) / 100 AS pe_ttm,
       0.4e0 + CAST(CAST(round(volume * 37) AS BIGINT) % 900 AS DOUBLE) / 100 AS pb, 0.4e0 + CAST(CAST(round(volume * 59) AS BIGINT) % 1600 AS DOUBLE) / 100 AS ps_ttm,
       amount / volume * 1.0e8 AS total_mv, amount / volume * 7.0e7 AS circ_mv, volume / 100 AS turnover_rate
FROM ({_BAR}) b WHERE k % 13 <> 0""",
    "financial": f"""
SELECT stock_code, report_period, announce_date, revenue_yoy, net_profit_yoy, roe, gross_margin, debt_ratio, operating_cashflow FROM (
  SELECT *, row_number() OVER (PARTITION BY stock_code, report_period, announce_date ORDER BY seq DESC) AS nth FROM (
    SELECT {_code("k")} AS stock_code, CAST(d AS STRING) AS report_period, CAST(d + CAST(o_orderkey % 90 AS INT) AS STRING) AS announce_date,
           CAST(cents % 700 AS DOUBLE) / 1000 - 0.3e0 AS revenue_yoy, CAST(cents % 900 AS DOUBLE) / 1000 - 0.4e0 AS net_profit_yoy, CAST(cents % 260 AS DOUBLE) / 1000 AS roe,
           CAST(cents % 770 AS DOUBLE) / 1000 AS gross_margin, CAST(cents % 1000 AS DOUBLE) / 1000 AS debt_ratio, CAST(cents AS DOUBLE) / 100 AS operating_cashflow, o_orderkey AS seq
    FROM (SELECT o_custkey % n + 1 AS k, CAST(o_orderdate AS DATE) AS d, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
          FROM {{orders}} CROSS JOIN (SELECT count(*) AS n FROM {{supplier}}) c) x) y) z WHERE nth = 1""",
    "st_history": f"""
SELECT DISTINCT {_code("k")} AS stock_code, 'ST' AS st_type, CAST(d AS STRING) AS start_date,
       CASE WHEN o_orderkey % 350 <> 0 THEN CAST(d + 30 AS STRING) END AS end_date, 'orders-' || CAST(o_orderkey AS STRING) AS source
FROM (SELECT o_custkey % n + 1 AS k, CAST(o_orderdate AS DATE) AS d, o_orderkey
      FROM {{orders}} CROSS JOIN (SELECT count(*) AS n FROM {{supplier}}) c WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') x""",
    "benchmark_price": """
SELECT CASE f WHEN 'A' THEN '000300.SH' WHEN 'N' THEN '000905.SH' ELSE '000906.SH' END AS index_code, CAST(d AS STRING) AS trade_date,
       (low + high) / 2 AS open, high, low, amount / volume AS close, CAST(0 AS DOUBLE) AS pct_chg
FROM (SELECT l_returnflag AS f, CAST(l_shipdate AS DATE) AS d, min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high,
             CAST(sum(CAST(l_quantity AS DECIMAL(12, 2))) AS DOUBLE) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS amount,
             count(*) OVER (PARTITION BY CAST(l_shipdate AS DATE)) AS flags
      FROM {lineitem} GROUP BY l_returnflag, CAST(l_shipdate AS DATE)) b WHERE flags = 3""",
    "suspend_event": f"""
SELECT DISTINCT {_code("l_suppkey")} AS stock_code, CAST(CAST(l_shipdate AS DATE) AS STRING) AS trade_date, 'S' AS suspend_type
FROM {{lineitem}} WHERE l_returnflag = 'R' AND l_linestatus = 'F'""",
    "trade_cal": """
SELECT DISTINCT 'SSE' AS exchange, CAST(CAST(l_shipdate AS DATE) AS STRING) AS cal_date, '1' AS is_open FROM {lineitem}""",
}

TABLES = ("lineitem", "orders", "supplier", "nation", "region")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A dataset, lazily, over the Parquet tables of ``sf_dir``."""
    text = DATASETS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def plain_sql(name: str) -> str:
    """The dataset's text with plain table names."""
    return DATASETS[name].replace("{", "").replace("}", "").strip()
