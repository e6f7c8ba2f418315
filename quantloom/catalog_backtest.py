"""Registered queries of whole backtests, and a recursive simulation in SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_queries import FROM, TO, Tables, _simple, _stored
from .operators import backtest as B

_CONFIG = B.BacktestConfig("core", FROM, TO, "monthly", top_n=5, slippage_bps=20.0, commission_rate=0.001, stamp_tax_rate=0.001)
_UP, _DOWN, _FEE, _TAX = "1.002e0", "0.998e0", "0.001e0", "0.001e0"
_SPAN = f"trade_date BETWEEN '{FROM}' AND '{TO}'"

#: Steps of the simulation: for each rebalance day one for what leaves (j = 0), then one for each target by rank.
_SIM = f"""
WITH RECURSIVE days AS (SELECT DISTINCT trade_date FROM adjusted WHERE {_SPAN}),
plan AS (SELECT trade_date AS signal_date, nxt AS day, row_number() OVER (ORDER BY trade_date) AS k FROM (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS nxt, row_number() OVER (PARTITION BY substr(trade_date, 1, 7) ORDER BY trade_date DESC) AS nth FROM days) x WHERE nth = 1 AND nxt IS NOT NULL),
target AS (SELECT p.k, p.day, s.stock_code, row_number() OVER (PARTITION BY p.k ORDER BY s.rank, s.stock_code) AS j FROM plan p JOIN selection s ON s.trade_date = p.signal_date AND s.rank <= 5),
wanted AS (SELECT k, list(stock_code ORDER BY j) AS codes FROM target GROUP BY k),
quote AS (SELECT a.trade_date AS day, map_from_entries(list(struct_pack(k := a.stock_code, v := struct_pack(p := a.adj_open, b := CASE WHEN a.is_paused THEN 'PAUSED' WHEN d.open >= d.limit_up THEN 'LIMIT_UP' ELSE '' END, s := CASE WHEN a.is_paused THEN 'PAUSED' WHEN d.open <= d.limit_down THEN 'LIMIT_DOWN' ELSE '' END)))) AS m
  FROM adjusted a JOIN daily_price d USING (stock_code, trade_date) WHERE a.trade_date IN (SELECT day FROM plan) GROUP BY a.trade_date),
step AS (SELECT row_number() OVER (ORDER BY k, j) AS seq, k, j, x.day, stock_code, coalesce(codes, CAST([] AS VARCHAR[])) AS codes, m FROM (SELECT k, 0 AS j, day, NULL AS stock_code FROM plan UNION ALL SELECT k, j, day, stock_code FROM target) x LEFT JOIN wanted USING (k) JOIN quote q ON q.day = x.day),
sim AS (
  SELECT CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS day, 100000e0 AS cash, CAST([] AS STRUCT(c VARCHAR, n DOUBLE)[]) AS h, 0e0 AS goal, CAST([] AS STRUCT(c VARCHAR, side VARCHAR, n DOUBLE, r VARCHAR)[]) AS orders
  UNION ALL
  SELECT seq, k, day, cash,  h, CASE WHEN j = 0 THEN (cash + coalesce(list_sum([x.n * m[x.c].p FOR x IN h IF m[x.c] IS NOT NULL]), 0)) / greatest(len(codes), 1) ELSE goal END AS goal, orders FROM (
    SELECT seq, k, day, j, m, codes, goal, orders,
      cash + coalesce(list_sum([CASE WHEN o.r <> '' THEN 0e0 WHEN o.side = 'buy' THEN -(o.n * m[o.c].p * {_UP}) * (1 + {_FEE}) ELSE o.n * m[o.c].p * {_DOWN} * (1 - {_FEE} - {_TAX}) END FOR o IN orders]), 0) AS cash,
      CASE WHEN j = 0 THEN [x FOR x IN h IF len([o FOR o IN orders IF o.c = x.c AND o.r = '']) = 0]
           WHEN len(orders) = 1 AND orders[1].r = '' THEN list_concat([x FOR x IN h IF x.c <> c], [struct_pack(c := c, n := held + CASE WHEN orders[1].side = 'buy' THEN orders[1].n ELSE -orders[1].n END)]) ELSE h END AS h
    FROM (SELECT *, CASE
        WHEN j = 0 THEN [struct_pack(c := x.c, side := 'sell', n := x.n, r := CASE WHEN m[x.c] IS NULL THEN 'MISSING_PRICE' ELSE m[x.c].s END) FOR x IN h IF x.n > 0 AND NOT list_contains(codes, x.c)]
        WHEN m[c] IS NULL THEN [struct_pack(c := c, side := 'buy', n := 0e0, r := 'MISSING_PRICE')]
        WHEN gap > 1e-9 THEN [struct_pack(c := c, side := 'buy', n := bought, r := CASE WHEN bought <= 0 THEN 'ZERO_SHARES' ELSE m[c].b END)]
        WHEN gap < -1e-9 THEN [struct_pack(c := c, side := 'sell', n := least(held, -gap / m[c].p), r := CASE WHEN least(held, -gap / m[c].p) <= 0 THEN 'ZERO_SHARES' ELSE m[c].s END)]
        ELSE CAST([] AS STRUCT(c VARCHAR, side VARCHAR, n DOUBLE, r VARCHAR)[]) END AS orders
      FROM (SELECT *, greatest(0e0, least(gap / m[c].p, cash / (m[c].p * {_UP} * (1 + {_FEE})))) AS bought FROM (
        SELECT e.seq, e.k, e.day, e.j, e.codes, e.m, e.stock_code AS c, s.cash, s.h, s.goal, coalesce(list_sum([x.n FOR x IN s.h IF x.c = e.stock_code]), 0) AS held, s.goal - coalesce(list_sum([x.n FOR x IN s.h IF x.c = e.stock_code]), 0) * e.m[e.stock_code].p AS gap
        FROM sim s JOIN step e ON e.seq = s.seq + 1) y) z) w) v)"""
_VALUES = f""", last AS (SELECT k, arg_max(cash, seq) AS cash, arg_max(h, seq) AS h, max(day) AS since FROM sim WHERE seq > 0 GROUP BY k),
marked AS (SELECT d.trade_date, l.since, coalesce(l.cash, 100000e0) AS cash, l.h FROM days d ASOF LEFT JOIN last l ON d.trade_date >= l.since),
worth AS (SELECT u.trade_date, sum(x.n * coalesce(adj_close, 0)) AS v, count(*) AS n FROM (SELECT trade_date, unnest(h) AS x FROM marked) u LEFT JOIN adjusted a ON a.stock_code = u.x.c AND a.trade_date = u.trade_date WHERE u.x.n > 0 GROUP BY u.trade_date),
daily AS (SELECT trade_date, cash, coalesce(v, 0) AS position_value, cash + coalesce(v, 0) AS total_asset, coalesce(n, 0) AS holding_count FROM marked LEFT JOIN worth USING (trade_date))"""


def _detail(t: Tables):
    return B.simulate(_stored(t).selection, B.backtest_prices(t.adjusted, t.daily_price), [_CONFIG])


def _rounded(column: str, places: int):
    return (F.rint(F.col(column) * 10**places) / 10**places).alias(column)


_simple(
    "b4_backtest_orders",
    lambda t: _detail(t).where("record_type = 'trade'").select("trade_date", "stock_code", "side", "status", "reason", _rounded("shares", 2), _rounded("gross_amount", 1)),
    f"SELECT day AS trade_date, o.c AS stock_code, o.side AS side, CASE WHEN o.r = '' THEN 'filled' ELSE 'blocked' END AS status, o.r AS reason, round_even(o.n, 2) AS shares, CASE WHEN o.r = '' THEN round_even(o.n * a.adj_open * CASE WHEN o.side = 'buy' THEN {_UP} ELSE {_DOWN} END, 1) END AS gross_amount FROM ({_SIM} SELECT day, unnest(orders) AS o FROM sim) s LEFT JOIN adjusted a ON a.stock_code = s.o.c AND a.trade_date = s.day",
)
_simple(
    "b4_backtest_values",
    lambda t: _detail(t).where("record_type = 'portfolio'").select("trade_date", _rounded("cash", 1), _rounded("position_value", 1), _rounded("total_asset", 1), "holding_count"),
    f"SELECT trade_date, round_even(cash, 1) AS cash, round_even(position_value, 1) AS position_value, round_even(total_asset, 1) AS total_asset, holding_count FROM ({_SIM}{_VALUES} SELECT * FROM daily) x",
)
_simple(
    "b5_backtest_run_metrics",
    lambda t: B.metrics(_detail(t)).select(_rounded("total_return", 6), _rounded("annual_return", 6), _rounded("max_drawdown", 6), _rounded("turnover", 4), _rounded("transaction_cost", 1), "trade_count"),
    f"""SELECT round_even(r, 6) AS total_return, round_even(pow(1 + r, 252e0 / (n - 1)) - 1, 6) AS annual_return, round_even(dd, 6) AS max_drawdown, round_even(g / m, 4) AS turnover, round_even(c, 1) AS transaction_cost, trades AS trade_count FROM (
  {_SIM}{_VALUES}, peaks AS (SELECT *, max(total_asset) OVER (ORDER BY trade_date) AS peak FROM daily), fills AS (SELECT o.n * a.adj_open * CASE WHEN o.side = 'buy' THEN {_UP} ELSE {_DOWN} END AS gross, o.side AS side FROM (SELECT day, unnest(orders) AS o FROM sim) s JOIN adjusted a ON a.stock_code = s.o.c AND a.trade_date = s.day WHERE o.r = '')
  SELECT (SELECT arg_max(total_asset, trade_date) / arg_min(total_asset, trade_date) - 1 FROM daily) AS r, (SELECT count(*) FROM daily) AS n, (SELECT min(total_asset / peak - 1) FROM peaks) AS dd, (SELECT avg(total_asset) FROM daily) AS m,
    (SELECT sum(gross) FROM fills) AS g, (SELECT sum(gross * CASE WHEN side = 'buy' THEN {_FEE} ELSE {_FEE} + {_TAX} END) FROM fills) AS c, (SELECT count(*) FROM fills) AS trades) x""",
)
