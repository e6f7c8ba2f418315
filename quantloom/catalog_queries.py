"""Registered queries: each operator over whole tables, and the same in SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import api
from .functions import scalars as S
from .operators import backtest as B
from .operators import candidate as C
from .operators import clean as K
from .operators import factors as X
from .operators import merge as M
from .operators import quality as Q
from .operators import scoring as R
from .operators import universe as U
from .schemas import FACTORS, SCORES, dataset
from .sources import adapter
from .sources.storage import discard, keep

DAY = "1998-06-30"
FROM, TO = "1997-01-01", "1999-12-31"
KEYS = ["stock_code", "trade_date"]


class Tables:
    """Datasets and derived tables of one folder, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in adapter.DATASETS:
            return adapter.load(self.spark, self.sf_dir, name)
        raise AttributeError(name)

    @cached_property
    def adjusted(self):
        return K.adjusted_price(self.daily_price, self.adj_factor)

    @cached_property
    def snapshot(self):
        return K.clean_snapshot(self.daily_price, self.adjusted, self.stock_basic, self.daily_basic, self.financial, self.st_history)

    @cached_property
    def risk(self):
        return U.risk_filter(self.snapshot)

    @cached_property
    def eligible(self):
        return self.classified.where("is_eligible").select(*dataset("eligible_universe").names)

    @cached_property
    def inputs(self):
        return self.classified.where("is_eligible").select(*dataset("factor_input_table").names)

    @cached_property
    def classified(self):
        return U.classify(self.snapshot)

    @cached_property
    def framed(self):
        """All factors of the eligible rows, from one snapshot."""
        return X.factor_frame(self.classified, X.trend(self.adjusted), self.benchmark_price)

    @cached_property
    def factors(self):
        return self.framed.drop("exclude_reasons", "risk_flags")

    @cached_property
    def signals(self):
        return B.rebalance_schedule(self.daily_price.select("trade_date"), "monthly")

    @cached_property
    def selection(self):
        """Monthly selection: windows over all history, then only the signal dates go on."""
        days = self.signals.select(F.col("signal_date").alias("trade_date"))
        return R.select_classified(self.framed.join(F.broadcast(days), "trade_date", "left_semi"), R.ScoringConfig(top_n=20))  # a row a month


class StoredTables(Tables):
    """The same tables, worked out in steps: what a step gives is stored and its shuffle files go before the next one.

    For queries that read a table several times, or several tables that are made
    of the same ones: otherwise the shuffles of all their parts are on disk at once.
    """

    @cached_property
    def classified(self):
        """Columns that inputs, risk, universe and factors are made of."""
        names = [n for k in ("factor_input_table", "risk_filter", "eligible_universe") for n in dataset(k).names]
        return keep(super().classified.select(*dict.fromkeys(names)), "classified")

    @cached_property
    def closes(self):
        return keep(self.adjusted.select(*KEYS, "adj_close"), "closes")

    @cached_property
    def framed(self):
        return X.factor_frame(self.classified, X.trend(self.closes), self.benchmark_price)

    @cached_property
    def selection(self):
        return self._last(super().selection, "selection")

    def by_tables(self):
        """All factors from separate tables."""
        rows = self.classified
        found = X.factor_daily(U.factor_input(rows, rows), self.closes, rows, self.benchmark_price)
        return self._last(found, "factors")

    def _last(self, df: DataFrame, name: str) -> DataFrame:
        """The rows, stored; the steps before go."""
        out = keep(df, name)
        for step in ("classified", "closes"):
            if step in self.__dict__:
                discard(self.__dict__.pop(step))
        self.__dict__.pop("framed", None)
        return out


def _stored(t: Tables) -> StoredTables:
    return StoredTables(t.spark, t.sf_dir)


# --- the derived tables in SQL ------------------------------------------------

_FIN = ", ".join(K.FIN_VALUES)
_SQL: dict[str, str] = {
    "adjusted": """SELECT stock_code, trade_date, open * adj_factor AS adj_open, high * adj_factor AS adj_high, low * adj_factor AS adj_low, close * adj_factor AS adj_close,
  volume, amount, pct_chg, is_paused, limit_up, limit_down FROM daily_price JOIN adj_factor USING (stock_code, trade_date) WHERE adj_factor > 0""",
    "known": f"""SELECT stock_code, trade_date, report_period, announce_date, {_FIN} FROM (
  SELECT p.stock_code, p.trade_date, f.report_period, f.announce_date, {", ".join("f." + c for c in K.FIN_VALUES)},
         row_number() OVER (PARTITION BY p.stock_code, p.trade_date ORDER BY f.announce_date DESC NULLS LAST, f.report_period DESC) AS nth
  FROM daily_price p LEFT JOIN financial f ON f.stock_code = p.stock_code AND f.announce_date <= p.trade_date AND f.report_period <= p.trade_date) x WHERE nth = 1""",
    "st": """SELECT p.stock_code, p.trade_date, EXISTS (SELECT 1 FROM st_history s WHERE s.stock_code = p.stock_code AND s.start_date <= p.trade_date
  AND (s.end_date IS NULL OR s.end_date > p.trade_date)) AS is_st_on_date FROM daily_price p""",
    "snapshot": f"""SELECT p.stock_code, p.trade_date, b.stock_name, b.industry, b.market_type, p.open, p.high, p.low, p.close, p.pre_close, p.volume, p.amount, p.pct_chg, p.is_paused,
  p.limit_up, p.limit_down, a.adj_open, a.adj_high, a.adj_low, a.adj_close, v.pe_ttm, v.pb, v.ps_ttm, v.total_mv, v.circ_mv, v.turnover_rate, f.report_period, f.announce_date,
  {", ".join("f." + c for c in K.FIN_VALUES)}, s.is_st_on_date, CAST(date_diff('day', CAST(b.list_date AS DATE), CAST(p.trade_date AS DATE)) AS BIGINT) AS listed_days
  FROM daily_price p JOIN stock_basic b ON b.stock_code = p.stock_code AND b.list_date <= p.trade_date AND (b.delist_date IS NULL OR b.delist_date > p.trade_date)
  JOIN adjusted a ON a.stock_code = p.stock_code AND a.trade_date = p.trade_date LEFT JOIN daily_basic v ON v.stock_code = p.stock_code AND v.trade_date = p.trade_date
  JOIN known f ON f.stock_code = p.stock_code AND f.trade_date = p.trade_date JOIN st s ON s.stock_code = p.stock_code AND s.trade_date = p.trade_date""",
    "risk": """SELECT stock_code, trade_date, reasons = '' AS is_eligible, reasons AS exclude_reasons, reasons AS risk_flags, is_st_on_date, is_paused, listed_days, amount, roe, debt_ratio, report_period, announce_date
  FROM (SELECT *, concat_ws(';', CASE WHEN is_st_on_date THEN 'ST' END, CASE WHEN is_paused THEN 'PAUSED' END, CASE WHEN listed_days < 180 THEN 'LISTED_DAYS_LT_MIN' END, CASE WHEN amount < 5e7 THEN 'AMOUNT_LT_MIN' END,
    CASE WHEN roe IS NULL OR debt_ratio IS NULL THEN 'FINANCIAL_MISSING' END, CASE WHEN debt_ratio IS NOT NULL AND roe < 0.03e0 THEN 'ROE_LT_MIN' END, CASE WHEN roe IS NOT NULL AND debt_ratio > 0.8e0 THEN 'DEBT_RATIO_GT_MAX' END) AS reasons FROM snapshot) x""",
    "eligible": "SELECT s.stock_code, s.trade_date, stock_name, industry, market_type, s.listed_days, s.amount, s.roe, s.debt_ratio FROM snapshot s JOIN risk r USING (stock_code, trade_date) WHERE r.is_eligible",
    "inputs": f"SELECT s.stock_code, s.trade_date, industry, market_type, adj_close, s.amount, turnover_rate, pe_ttm, pb, ps_ttm, total_mv, circ_mv, {', '.join('s.' + c for c in K.FIN_VALUES)} FROM snapshot s JOIN risk r USING (stock_code, trade_date) WHERE r.is_eligible",
    "trend": f"""SELECT stock_code, trade_date, adj_close, {", ".join(f"CASE WHEN lag(adj_close, {n}) OVER w <> 0 THEN adj_close / lag(adj_close, {n}) OVER w - 1 END AS trend_ret_{n}d" for n in (20, 60, 120))},
  {", ".join(f"CASE WHEN count(*) OVER w{n} >= {n} THEN avg(adj_close) OVER w{n} END AS trend_ma{n}" for n in (20, 60, 120))} FROM adjusted
  WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date), {", ".join(f"w{n} AS (PARTITION BY stock_code ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (20, 60, 120))}""",
    "bench": """SELECT trade_date, close / lag(close, 60) OVER (ORDER BY trade_date) - 1 AS b60, close / lag(close, 120) OVER (ORDER BY trade_date) - 1 AS b120 FROM benchmark_price WHERE index_code = '000300.SH'""",
    "ind": """SELECT trade_date, industry, r60 AS industry_ret_60d, r120 AS industry_ret_120d, r60 - b60 AS industry_strength_60d, r120 - b120 AS industry_strength_120d
  FROM (SELECT trade_date, industry, avg(trend_ret_60d) AS r60, avg(trend_ret_120d) AS r120 FROM inputs LEFT JOIN trend USING (stock_code, trade_date) GROUP BY trade_date, industry) g LEFT JOIN bench USING (trade_date)""",
    "hist": """SELECT stock_code, trade_date, pe_ttm, pb, list(pe_ttm) FILTER (pe_ttm IS NOT NULL) OVER w AS pes, list(pb) FILTER (pb IS NOT NULL) OVER w AS pbs, min(CAST(trade_date AS DATE)) OVER w AS first_day FROM snapshot
  WINDOW w AS (PARTITION BY stock_code ORDER BY CAST(trade_date AS DATE) RANGE BETWEEN INTERVAL 1095 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)""",
    "pct": f"""SELECT stock_code, trade_date, {", ".join(f"CASE WHEN {v} IS NOT NULL THEN CAST(coalesce(len([x FOR x IN {h} IF x <= {v}]), 0) + 1 AS DOUBLE) / (coalesce(len({h}), 0) + 1) END AS valuation_{p}_percentile_3y" for v, h, p in (("pe_ttm", "pes", "pe"), ("pb", "pbs", "pb")))} FROM hist""",
}
_R = {
    "quality_roe": "roe", "quality_gross_margin": "gross_margin", "quality_debt_ratio": "debt_ratio", "quality_cashflow_profit_ratio": "CAST(NULL AS DOUBLE)", "growth_revenue_yoy": "revenue_yoy", "growth_net_profit_yoy": "net_profit_yoy",
    "valuation_pe_ttm": "pe_ttm", "valuation_pb": "pb", "valuation_ps_ttm": "ps_ttm", "trend_price_ma60_ratio": "CASE WHEN trend_ma60 <> 0 THEN t.adj_close / trend_ma60 END", "liquidity_amount": "amount", "liquidity_turnover_rate": "turnover_rate",
}
_ANCHORS = {
    "quality_score": [("quality_roe", 0.03, 0.20, 1), ("quality_gross_margin", 0.10, 0.60, 1), ("quality_debt_ratio", 0.20, 0.80, 0)],
    "growth_score": [("growth_revenue_yoy", -0.20, 0.30, 1), ("growth_net_profit_yoy", -0.20, 0.30, 1)],
    "valuation_score": [("valuation_pe_ttm", 5.0, 60.0, 0), ("valuation_pb", 0.5, 8.0, 0), ("valuation_ps_ttm", 0.5, 15.0, 0), ("valuation_pe_percentile_3y", 0.0, 1.0, 0), ("valuation_pb_percentile_3y", 0.0, 1.0, 0)],
    "trend_score": [("trend_ret_20d", -0.20, 0.40, 1), ("trend_ret_60d", -0.30, 0.80, 1), ("trend_ret_120d", -0.40, 1.20, 1), ("trend_price_ma60_ratio", 0.70, 1.30, 1)],
    "industry_score": [("industry_ret_60d", -0.30, 0.80, 1), ("industry_ret_120d", -0.40, 1.20, 1), ("industry_strength_60d", -0.20, 0.20, 1), ("industry_strength_120d", -0.30, 0.30, 1)],
}


def _scaled(column: str, low: float, high: float, up: int) -> str:
    x = f"greatest(0e0, least(100e0, ({column} - ({low!r}e0)) / {high - low!r}e0 * 100))"
    return f"CASE WHEN {column} IS NOT NULL THEN {x if up else '100 - ' + x} END"


def _mean(parts: list[tuple]) -> str:
    cells = [_scaled(*p) for p in parts]
    total = " + ".join(f"coalesce({c}, 0e0)" for c in cells)
    count = " + ".join(f"CASE WHEN {p[0]} IS NULL THEN 0 ELSE 1 END" for p in parts)
    return f"CASE WHEN {count} > 0 THEN ({total}) / ({count}) ELSE 50e0 END"


_SQL["factor"] = (
    f"SELECT *, {', '.join(f'{_mean(p)} AS {n}' for n, p in _ANCHORS.items())} FROM (SELECT i.stock_code, i.trade_date, i.industry, i.market_type, {', '.join(f'{_R.get(c, c)} AS {c}' for c in FACTORS)} "
    "FROM inputs i LEFT JOIN pct p ON p.stock_code = i.stock_code AND p.trade_date = i.trade_date LEFT JOIN trend t ON t.stock_code = i.stock_code AND t.trade_date = i.trade_date "
    "LEFT JOIN ind g ON g.trade_date = i.trade_date AND g.industry = i.industry) x"
)
_SQL["signal"] = """SELECT trade_date AS signal_date, nxt AS execution_date FROM (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS nxt,
  row_number() OVER (PARTITION BY substr(trade_date, 1, 7) ORDER BY trade_date DESC) AS nth FROM (SELECT DISTINCT trade_date FROM daily_price) d) x WHERE nth = 1 AND nxt IS NOT NULL"""
_WEIGHTS = R.ScoringConfig().weights
_SQL["scored"] = f"""SELECT f.*, round_even(greatest(0e0, least(100e0, 0e0 + {" + ".join(f"{c} * {w!r}e0" for c, w in _WEIGHTS.items())})), 6) AS total_score
  FROM factor f JOIN signal s ON s.signal_date = f.trade_date"""
_CLAUSES = ", ".join(f"CASE WHEN {c} {'>=' if op == 'ge' else '<'} {n} THEN '{t}' END" for c, op, n, t in S.REASON_CLAUSES)
_SQL["selection"] = f"""SELECT stock_code, trade_date, industry, market_type, {", ".join(SCORES)}, total_score, risk_level, rank,
  CASE WHEN total_score >= 80 AND risk_level = 'low' THEN '{S.SUGGESTIONS[0]}' WHEN total_score >= 70 AND risk_level IN ('low', 'medium') THEN '{S.SUGGESTIONS[1]}' WHEN total_score >= 60 THEN '{S.SUGGESTIONS[2]}' ELSE '{S.SUGGESTIONS[3]}' END AS suggestion,
  CASE WHEN clauses = '' THEN '{S.DEFAULT_REASON}' ELSE clauses END || '。' AS reason, '' AS exclude_reasons, '' AS risk_flags
  FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY total_score DESC, stock_code) AS rank, concat_ws('；', {_CLAUSES}) AS clauses,
    CASE WHEN total_score < 55 OR quality_score < 40 OR growth_score < 30 THEN 'high' WHEN total_score >= 75 AND quality_score >= 60 AND growth_score >= 50 THEN 'low' ELSE 'medium' END AS risk_level FROM scored) x WHERE rank <= 20"""


def _sql(final: str) -> str:
    """``final`` with the tables that it names, and those that they name, as common tables in front."""
    import re

    texts = {n: adapter.plain_sql(n) for n in adapter.DATASETS} | _SQL
    order: list[str] = []

    def need(text: str) -> None:
        for word in re.findall(r"(?:FROM|JOIN)\s+\(?\s*([a-z_]+)", text):
            if word in texts and word not in order:
                need(texts[word])
                if word not in order:
                    order.append(word)

    need(final)
    if final.lstrip().startswith("WITH"):
        final = f"SELECT * FROM ({final}) q"
    head = ",\n".join(f"{n} AS MATERIALIZED ({texts[n]})" for n in order)
    return f"WITH {head}\n{final}" if order else final


def _r6(df: DataFrame, skip: tuple = ()) -> DataFrame:
    return df.select(*[S.round6(f.name).alias(f.name) if f.dataType.typeName() == "double" and f.name not in skip else F.col(f.name) for f in df.schema.fields])


def _r6_sql(columns: list[str], table: str, doubles: set[str]) -> str:
    return f"SELECT {', '.join(f'round_even({c}, 6) AS {c}' if c in doubles else c for c in columns)} FROM {table}"


_QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def _add(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = (f, _sql(sql) if sql else None)
        return f

    return keep


def _simple(name: str, f: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    _add(name, sql)(f)


# scans, projections, filters
for _n in adapter.DATASETS:
    _simple(f"s1_{_n}", lambda t, n=_n: getattr(t, n), f"SELECT * FROM {_n}")
_simple("s2_history", lambda t: t.daily_price.where(F.col("trade_date") <= DAY), f"SELECT * FROM daily_price WHERE trade_date <= '{DAY}'")
_simple("s3_between", lambda t: t.daily_price.where(F.col("trade_date").between(FROM, TO)), f"SELECT * FROM daily_price WHERE trade_date BETWEEN '{FROM}' AND '{TO}'")
_simple(
    "s5_ad_hoc_sql",
    lambda t: t.spark.sql("SELECT trade_date, count(*) AS n, max(close) AS top FROM {p} GROUP BY trade_date", p=t.daily_price),
    "SELECT trade_date, count(*) AS n, max(close) AS top FROM daily_price GROUP BY trade_date",
)
_simple("s6_first_rows", lambda t: t.daily_price.orderBy(*KEYS).limit(10), "SELECT * FROM daily_price ORDER BY stock_code, trade_date LIMIT 10")


@_add("s7_stock_price", f"SELECT * FROM daily_price WHERE stock_code = '000001.SH' AND trade_date BETWEEN '{FROM}' AND '{TO}'")
def _s7(t):
    from .sources.storage import stock_prices

    return stock_prices(t.daily_price, "000001.SH", FROM, TO)


_simple("f1_members", lambda t: K.stock_basic_as_of(t.stock_basic, DAY), f"SELECT * FROM stock_basic WHERE list_date <= '{DAY}' AND (delist_date IS NULL OR delist_date > '{DAY}')")
_simple(
    "f1_membership_counts",
    lambda t: K.membership_counts(t.stock_basic, t.trade_cal.select(F.col("cal_date").alias("trade_date"))),
    "SELECT cal_date AS trade_date, CASE WHEN list_date > cal_date THEN 'NOT_YET_LISTED' ELSE 'DELISTED' END AS reason, count(*) AS n FROM trade_cal CROSS JOIN stock_basic WHERE list_date > cal_date OR delist_date <= cal_date GROUP BY 1, 2",
)
_simple(
    "f3_visibility",
    lambda t: K.visibility_counts(t.financial, DAY),
    f"SELECT count(*) AS source_rows, count(*) FILTER (v) AS usable_rows, count(*) FILTER (NOT v) AS future_rows, count(DISTINCT stock_code) FILTER (v) AS latest_rows FROM (SELECT *, announce_date <= '{DAY}' AND report_period <= '{DAY}' AS v FROM financial) x",
)
_simple("f10_open_dates", lambda t: C.open_dates(t.trade_cal), "SELECT DISTINCT cal_date AS trade_date FROM trade_cal WHERE is_open = '1'")
_simple("f13_overlaps", lambda t: K.overlapping(t.st_history, FROM, TO), f"SELECT * FROM st_history WHERE start_date <= '{TO}' AND coalesce(end_date, '9999-12-31') > '{FROM}'")

# joins
_simple("j1_adjusted_price", lambda t: t.adjusted, "SELECT * FROM adjusted")
_simple("j2_clean_snapshot", lambda t: t.snapshot.select(*dataset("clean_daily_snapshot").names), f"SELECT {', '.join(dataset('clean_daily_snapshot').names)} FROM snapshot")
_simple("j3_financial_as_of", lambda t: K.financial_as_of(t.daily_price.select(*KEYS), t.financial), "SELECT * FROM known")
_simple(
    "j3_latest_on_day",
    lambda t: K.latest_financials(t.financial, DAY),
    f"SELECT stock_code, report_period, announce_date, {_FIN} FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY announce_date DESC, report_period DESC) AS nth FROM financial WHERE announce_date <= '{DAY}' AND report_period <= '{DAY}') x WHERE nth = 1",
)
_simple("j4_st_intervals", lambda t: K.st_flags(t.daily_price.select(*KEYS), t.st_history), "SELECT * FROM st")
_simple("f6_risk_filter", lambda t: t.risk, "SELECT * FROM risk")
_simple("j5_eligible_universe", lambda t: U.eligible_universe(t.snapshot, t.risk), "SELECT * FROM eligible")
_simple("f8_factor_input", lambda t: U.factor_input(t.snapshot, t.risk), "SELECT * FROM inputs")
_simple(
    "j9_carry_state",
    lambda t: K.carry_financial_state(t.financial.where("announce_date <= '1998-06-30'"), t.financial.where("announce_date > '1998-03-31' and announce_date <= '1999-03-31'").withColumn("roe", F.col("roe") + 1)),
    "SELECT * FROM financial WHERE announce_date <= '1998-03-31' UNION ALL SELECT * REPLACE (roe + 1 AS roe) FROM financial WHERE announce_date > '1998-03-31' AND announce_date <= '1999-03-31'",
)
_simple("j13_expected_axis", lambda t: C.expected_axis(t.stock_basic, C.open_dates(t.trade_cal)), "SELECT stock_code, cal_date AS trade_date FROM trade_cal CROSS JOIN stock_basic WHERE list_date <= cal_date AND (delist_date IS NULL OR delist_date > cal_date)")
_AXIS = "(SELECT stock_code, cal_date AS trade_date FROM trade_cal CROSS JOIN stock_basic WHERE list_date <= cal_date AND (delist_date IS NULL OR delist_date > cal_date))"
_simple("j14_missing_keys", lambda t: C.missing_keys(C.expected_axis(t.stock_basic, C.open_dates(t.trade_cal)), t.daily_basic), f"SELECT e.* FROM {_AXIS} e ANTI JOIN daily_basic USING (stock_code, trade_date)")
_simple(
    "a14_coverage",
    lambda t: C.coverage(C.expected_axis(t.stock_basic, C.open_dates(t.trade_cal)), t.daily_basic),
    f"SELECT count(*) FILTER (e) AS expected, count(*) FILTER (e AND o) AS matched, count(*) FILTER (e AND o IS NULL) AS missing, count(*) FILTER (o AND e IS NULL) AS unexpected, CAST(count(*) FILTER (e AND o) AS DOUBLE) / count(*) FILTER (e) AS rate FROM (SELECT *, true AS e FROM {_AXIS} a) x FULL JOIN (SELECT stock_code, trade_date, true AS o FROM daily_basic) y USING (stock_code, trade_date)",
)
_simple(
    "j15_event_intersection",
    lambda t: C.event_intersection(t.suspend_event, t.eligible),
    "SELECT count(*) AS events, count(e.stock_code) AS matched, count(*) - count(e.stock_code) AS out_of_universe FROM suspend_event s LEFT JOIN eligible e USING (stock_code, trade_date)",
)
_LIMITS = KEYS + ["limit_up", "limit_down"]
_BATCH_COLUMNS = [*KEYS, "open", "high", "low", "close", "pre_close", "volume", "amount", "limit_up", "limit_down", "adj_factor", "pe_ttm", "pb", "ps_ttm", "total_mv", "circ_mv", "turnover_rate", "pause_status", "is_paused_candidate"]


def _batch(t: Tables) -> DataFrame:
    daily = t.daily_price.select(*KEYS, "open", "high", "low", "close", "pre_close", "volume", "amount")
    covered = C.open_dates(t.trade_cal).where("trade_date < '1998-01-01'")
    return C.candidate_batch(daily, t.daily_price.select(*_LIMITS), t.adj_factor, t.daily_basic, t.suspend_event, covered).select(*_BATCH_COLUMNS)


_SQL["batch"] = """SELECT p.stock_code, p.trade_date, open, high, low, close, pre_close, volume, amount, limit_up, limit_down, adj_factor, pe_ttm, pb, ps_ttm, total_mv, circ_mv, turnover_rate,
  CASE WHEN s.suspend_type IS NOT NULL THEN 'true_candidate' WHEN p.trade_date < '1998-01-01' THEN 'false_candidate' ELSE 'unknown' END AS pause_status,
  CASE WHEN s.suspend_type IS NOT NULL THEN true WHEN p.trade_date < '1998-01-01' THEN false END AS is_paused_candidate
  FROM daily_price p LEFT JOIN adj_factor a ON a.stock_code = p.stock_code AND a.trade_date = p.trade_date LEFT JOIN daily_basic v ON v.stock_code = p.stock_code AND v.trade_date = p.trade_date
  LEFT JOIN suspend_event s ON s.stock_code = p.stock_code AND s.trade_date = p.trade_date"""
_simple("j8_candidate_batch", _batch, "SELECT * FROM batch")
_simple("a16_pause_counts", lambda t: C.pause_counts(_batch(t)), "SELECT pause_status, count(*) AS n FROM batch GROUP BY pause_status")
_simple(
    "p11_promotion",
    lambda t: C.promote(t.daily_price.where("trade_date < '1997-01-01'"), _batch(t).where("trade_date >= '1996-07-01' and trade_date < '1998-01-01'")).withColumn("pct_chg", F.when(F.col("trade_date") >= "1996-07-01", F.col("pct_chg"))),
    """SELECT stock_code, trade_date, open, high, low, close, pre_close, volume, amount, CASE WHEN trade_date >= '1996-07-01' THEN round_even((close - pre_close) / pre_close * 100, 6) END AS pct_chg, is_paused, limit_up, limit_down
  FROM (SELECT * FROM daily_price WHERE trade_date < '1996-07-01' UNION ALL SELECT stock_code, trade_date, open, high, low, close, pre_close, volume, amount, 0e0, is_paused_candidate, limit_up, limit_down FROM batch WHERE trade_date >= '1996-07-01' AND trade_date < '1998-01-01') x""",
)
_simple(
    "v10_promotion_faults",
    lambda t: C.promotion_faults(_batch(t)),
    """SELECT unnest(['negative_price', 'ohlc_order', 'volume_amount', 'adj_factor', 'limits', 'pause']) AS rule, unnest([count(*) FILTER (least(open, high, low, close, pre_close) < 0),
  count(*) FILTER (high < low OR high < open OR high < close OR low > open OR low > close), count(*) FILTER (volume < 0 OR amount < 0), count(*) FILTER (adj_factor IS NULL OR adj_factor <= 0),
  count(*) FILTER (limit_up IS NULL OR limit_down IS NULL), count(*) FILTER (is_paused_candidate IS NULL)]) AS n FROM batch""",
)

# windows and factors
_TREND = [*KEYS, "adj_close", *[f"trend_{k}" for k in ("ret_20d", "ret_60d", "ret_120d", "ma20", "ma60", "ma120")]]
_simple("w1_trend", lambda t: _r6(X.trend(t.adjusted).select(*_TREND)), _r6_sql(_TREND, "trend", set(_TREND[2:])))
_simple("w5_benchmark_return", lambda t: _r6(X.benchmark_returns(t.benchmark_price)), "SELECT trade_date, round_even(b60, 6) AS benchmark_ret_60d, round_even(b120, 6) AS benchmark_ret_120d FROM bench")
_IND = ["trade_date", "industry", "industry_ret_60d", "industry_ret_120d", "industry_strength_60d", "industry_strength_120d"]
_simple("a1_industry", lambda t: _r6(X.industry(t.inputs, X.trend(t.adjusted), t.benchmark_price).select(*_IND)), _r6_sql(_IND, "ind", set(_IND[2:])))
_simple("w7_percentile", lambda t: X.valuation_percentiles(t.snapshot), "SELECT * FROM pct")
_simple(
    "w8_percentile_strict",
    lambda t: X.valuation_percentiles(t.snapshot, strict=True),
    "SELECT stock_code, trade_date, "
    + ", ".join(f"CASE WHEN len({h}) >= 720 AND first_day <= CAST(trade_date AS DATE) - 1064 AND {v} IS NOT NULL THEN CAST(len([x FOR x IN {h} IF x <= {v}]) + 1 AS DOUBLE) / (len({h}) + 1) END AS valuation_{p}_percentile_3y" for v, h, p in (("pe_ttm", "pes", "pe"), ("pb", "pbs", "pb")))
    + " FROM hist",
)
_FD = dataset("factor_daily").names
_simple("j6_factor_daily", lambda t: _r6(t.factors), _r6_sql(_FD, "factor", set(FACTORS + SCORES)))
_simple("j6_factor_daily_by_tables", lambda t: _r6(_stored(t).by_tables()), _r6_sql(_FD, "factor", set(FACTORS + SCORES)))
_w = lambda: Window.partitionBy("index_code").orderBy("trade_date")
_simple(
    "w9_drawdown",
    lambda t: t.benchmark_price.withColumn("peak", F.max("close").over(_w().rowsBetween(Window.unboundedPreceding, 0))).groupBy("index_code").agg(F.min(F.col("close") / F.col("peak") - 1).alias("max_drawdown")),
    "SELECT index_code, min(close / peak - 1) AS max_drawdown FROM (SELECT *, max(close) OVER (PARTITION BY index_code ORDER BY trade_date) AS peak FROM benchmark_price) x GROUP BY index_code",
)
_simple(
    "w10_daily_return",
    lambda t: t.benchmark_price.select("index_code", "trade_date", B.daily_return("close", _w()).alias("daily_return")),
    "SELECT index_code, trade_date, coalesce(close / lag(close) OVER (PARTITION BY index_code ORDER BY trade_date) - 1, 0) AS daily_return FROM benchmark_price",
)
_simple(
    "w12_pct_change",
    lambda t: t.benchmark_price.withColumn("pre_close", F.lag("close").over(_w())).where("pre_close is not null").select("index_code", "trade_date", S.pct_change("close", "pre_close").alias("pct_chg")),
    "SELECT index_code, trade_date, (close / p - 1) * 100 AS pct_chg FROM (SELECT *, lag(close) OVER (PARTITION BY index_code ORDER BY trade_date) AS p FROM benchmark_price) x WHERE p IS NOT NULL",
)

# scores, selection, reports
_SEL = dataset("selection_result").names
_SEL_F = {*SCORES, "total_score"}
_simple("o1_selection", lambda t: _r6(t.selection), _r6_sql(_SEL, "selection", _SEL_F))


def _selected_by_tables(t):
    """The selection from separate tables, as a user with stored datasets makes it."""
    days = F.broadcast(t.signals.select(F.col("signal_date").alias("trade_date")))  # a row a month
    on = lambda df: df.join(days, "trade_date", "left_semi")
    return R.select_top(on(t.factors), on(t.eligible), on(t.risk), on(t.inputs), R.ScoringConfig(top_n=20))


_simple("j7_selection_by_tables", lambda t: _r6(_selected_by_tables(t)), _r6_sql(_SEL, "selection", _SEL_F))
_simple(
    "a5_selection_summary",
    lambda t: _r6(R.summarize_selection(t.selection, 5).drop("top_stocks")),
    "SELECT trade_date, count(*) AS stock_count, round_even(avg(total_score), 6) AS avg_total_score, max(total_score) AS max_total_score, min(total_score) AS min_total_score FROM selection GROUP BY trade_date",
)
_simple(
    "a5_top_stocks",
    lambda t: R.summarize_selection(t.selection, 5).select("trade_date", F.explode("top_stocks").alias("x")).select("trade_date", "x.rank", "x.stock_code", "x.total_score"),
    "SELECT trade_date, rank, stock_code, total_score FROM selection WHERE rank <= 5",
)
_simple("a6_exclusion_counts", lambda t: Q.exclusion_counts(t.risk), "SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(exclude_reasons, ';')) AS reason FROM risk WHERE exclude_reasons <> '') x GROUP BY reason")
_MISS = ["report_period", "roe", "pe_ttm", "turnover_rate", "close"]
_simple("a7_missing_rates", lambda t: Q.missing_rates(t.snapshot, _MISS), "SELECT unnest([" + ", ".join(f"'{c}'" for c in _MISS) + "]) AS column, unnest([" + ", ".join(f"round_even(avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END), 8)" for c in _MISS) + "]) AS rate FROM snapshot")
_simple(
    "a8_factor_audit",
    lambda t: Q.factor_audit(t.factors).select("factor", "n", "all_null", "effective", "enough"),
    "SELECT factor, n, n = 0 AS all_null, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER () AS BIGINT) AS effective, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER () >= 15 AS enough FROM (SELECT unnest(["
    + ", ".join(f"'{c}'" for c in FACTORS) + "]) AS factor, unnest([" + ", ".join(f"count({c})" for c in FACTORS) + "]) AS n FROM factor) x",
)
_simple(
    "a9_history_coverage",
    lambda t: Q.history_coverage(t.adjusted, t.snapshot, DAY),
    f"""SELECT p.stock_code, price_rows, first_price, coalesce(valuation_rows, 0) AS valuation_rows, first_valuation, price_rows <= 120 AS short_trend, coalesce(valuation_rows, 0) < 720 AS short_valuation
  FROM (SELECT stock_code, count(*) AS price_rows, min(trade_date) AS first_price FROM adjusted WHERE trade_date <= '{DAY}' GROUP BY stock_code) p
  LEFT JOIN (SELECT stock_code, count(pe_ttm) AS valuation_rows, min(trade_date) AS first_valuation FROM snapshot WHERE trade_date < '{DAY}' GROUP BY stock_code) v USING (stock_code)""",
)
_simple(
    "a10_score_statistics",
    lambda t: _r6(R.score_statistics(t.selection, [*SCORES, "total_score"])),
    " UNION ALL ".join(f"SELECT '{c}' AS column, count({c}) AS n, round_even(min({c}), 6) AS least, round_even(max({c}), 6) AS greatest, round_even(avg({c}), 6) AS mean FROM selection" for c in [*SCORES, "total_score"]),
)
_simple("v14_recomputation", lambda t: Q.recomputation_faults(t.selection, _WEIGHTS), "SELECT CAST(0 AS BIGINT) AS total_score, CAST(0 AS BIGINT) AS risk_level, CAST(0 AS BIGINT) AS reason, CAST(0 AS BIGINT) AS suggestion FROM selection LIMIT 1")
_simple("j12_key_audit", lambda t: M.key_audit(t.factors, t.eligible, t.inputs, t.risk), "SELECT " + ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in ("factor_not_eligible", "eligible_not_factor", "eligible_not_input", "input_not_eligible", "eligible_not_in_risk")))
_simple("v2_daily_price_rules", lambda t: Q.violations(t.daily_price, "daily_price"), """SELECT unnest(['rows', 'stock_code', 'date:trade_date', 'prices_positive', 'high_low', 'volume_amount', 'limits', 'nulls', 'duplicate_keys']) AS rule,
  unnest([count(*), count(*) FILTER (NOT regexp_matches(stock_code, '^[0-9]{6}\\.(SZ|SH|BJ)$')), count(*) FILTER (try_cast(trade_date AS DATE) IS NULL), count(*) FILTER (NOT (open > 0 AND close > 0)), count(*) FILTER (high < low),
  count(*) FILTER (volume < 0 OR amount < 0), count(*) FILTER (close > limit_up OR close < limit_down), count(*) FILTER (pre_close IS NULL), count(*) - count(DISTINCT (stock_code, trade_date))]) AS n FROM daily_price""")
_simple("v4_financial_rules", lambda t: Q.violations(t.financial, "financial", DAY).where("rule in ('roe', 'debt_ratio', 'visible')"), f"""SELECT unnest(['roe', 'debt_ratio', 'visible']) AS rule, unnest([count(*) FILTER (roe IS NULL),
  count(*) FILTER (debt_ratio IS NULL OR debt_ratio < 0 OR debt_ratio > 1), count(*) FILTER (announce_date > '{DAY}' OR report_period > '{DAY}')]) AS n FROM financial""")
_ACTIVE = f"(SELECT DISTINCT stock_code FROM stock_basic WHERE list_date <= '{DAY}' AND (delist_date IS NULL OR delist_date > '{DAY}'))"
_simple(
    "v16_coverage_gaps",
    lambda t: Q.coverage_gaps(t.daily_price, t.adj_factor, t.daily_basic, t.financial, t.stock_basic, DAY).withColumnRenamed("check", "rule"),
    " UNION ALL ".join(f"SELECT 'no_{n}' AS rule, count(*) AS n FROM {_ACTIVE} a ANTI JOIN (SELECT stock_code FROM {n} WHERE {c}) b USING (stock_code)" for n, c in (("daily_price", f"trade_date = '{DAY}'"), ("adj_factor", f"trade_date = '{DAY}'"), ("daily_basic", f"trade_date = '{DAY}'"), ("financial", f"announce_date <= '{DAY}' AND report_period <= '{DAY}'")))
    + f" UNION ALL SELECT 'no_master', count(*) FROM (SELECT DISTINCT stock_code FROM daily_price WHERE trade_date = '{DAY}') p ANTI JOIN stock_basic USING (stock_code) UNION ALL SELECT 'active', count(*) FROM {_ACTIVE} a",
)
_simple("a15_duplicate_keys", lambda t: Q.duplicate_keys(t.spark.read.parquet(f"{t.sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"]), "SELECT count(*) AS keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) x")
_simple("a21_spans", lambda t: C.spans(t.daily_price), "SELECT min(trade_date) AS first_day, max(trade_date) AS last_day, count(DISTINCT trade_date) AS days, count(DISTINCT stock_code) AS codes FROM daily_price")

# merges
_OLD = "trade_date < '1998-07-01'"
_NEW = "trade_date >= '1998-01-01' and trade_date < '1999-01-01'"
_changed = lambda df: df.withColumn("adj_factor", F.when(F.col("stock_code") > "000050", F.col("adj_factor") * 2).otherwise(F.col("adj_factor")))
_CHANGED = "SELECT stock_code, trade_date, CASE WHEN stock_code > '000050' THEN adj_factor * 2 ELSE adj_factor END AS adj_factor FROM adj_factor WHERE trade_date >= '1998-01-01' AND trade_date < '1999-01-01'"
_simple("u1_upsert", lambda t: M.upsert(t.adj_factor.where(_OLD), _changed(t.adj_factor.where(_NEW)), KEYS), f"SELECT * FROM adj_factor WHERE trade_date < '1998-01-01' UNION ALL {_CHANGED}")
_simple("a18_upsert_counts", lambda t: M.upsert_counts(t.adj_factor.where(_OLD), _changed(t.adj_factor.where(_NEW)), KEYS), """SELECT count(*) FILTER (trade_date >= '1998-07-01' AND trade_date < '1999-01-01') AS inserted, count(*) FILTER (trade_date >= '1998-01-01' AND trade_date < '1998-07-01' AND stock_code > '000050') AS updated,
  count(*) FILTER (trade_date >= '1998-01-01' AND trade_date < '1998-07-01' AND stock_code <= '000050') AS unchanged, count(*) FILTER (trade_date < '1998-01-01') AS kept FROM adj_factor""")
_simple("u2_keep_last", lambda t: M.upsert_keep_last(t.financial.select("stock_code", "announce_date", "roe").where("announce_date < '1998-01-01'"), t.financial.select("stock_code", "announce_date", "roe").where("announce_date >= '1997-06-01'"), ["stock_code"], ["announce_date", "roe"]),
        """SELECT stock_code, announce_date, roe FROM (SELECT *, row_number() OVER (PARTITION BY stock_code, new ORDER BY announce_date DESC, roe DESC) AS nth, max(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY stock_code) AS any_new
  FROM (SELECT stock_code, announce_date, roe, false AS new FROM financial WHERE announce_date < '1998-01-01' UNION ALL SELECT stock_code, announce_date, roe, true FROM financial WHERE announce_date >= '1997-06-01') x) y WHERE nth = 1 AND (new OR any_new = 0)""")
_simple("u4_replace_scope", lambda t: M.replace_scope(t.adj_factor, _changed(t.adj_factor.where(_NEW)).where("stock_code <= '000060'"), (F.col("trade_date") >= "1998-01-01") & (F.col("trade_date") < "1999-01-01")), f"SELECT * FROM adj_factor WHERE NOT (trade_date >= '1998-01-01' AND trade_date < '1999-01-01') UNION ALL SELECT * FROM ({_CHANGED}) c WHERE stock_code <= '000060'")
_simple("u6_key_difference", lambda t: M.key_difference(t.adj_factor, t.daily_basic, KEYS), "SELECT stock_code, trade_date, 'left' AS side FROM adj_factor ANTI JOIN daily_basic USING (stock_code, trade_date) UNION ALL SELECT stock_code, trade_date, 'right' FROM daily_basic ANTI JOIN adj_factor USING (stock_code, trade_date)")
_simple("u9_projection", lambda t: K.project_by_date(t.financial, t.signals.select(F.col("signal_date").alias("trade_date"))), "SELECT signal_date AS trade_date, financial.* FROM signal JOIN financial ON announce_date <= signal_date AND report_period <= signal_date")

# schedule and backtest
_simple("b1_schedule_monthly", lambda t: t.signals, "SELECT * FROM signal")
_simple("b1_schedule_quarterly", lambda t: B.rebalance_schedule(t.daily_price.select("trade_date"), "quarterly"), """SELECT trade_date AS signal_date, nxt AS execution_date FROM (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS nxt,
  row_number() OVER (PARTITION BY date_trunc('quarter', CAST(trade_date AS DATE)) ORDER BY trade_date DESC) AS nth FROM (SELECT DISTINCT trade_date FROM daily_price) d) x WHERE nth = 1 AND nxt IS NOT NULL""")
_ORDER = ["stock_code", "trade_date", "side", "status", "reason", "fill_price", "gross_amount", "commission", "stamp_tax", "cash_delta"]


def _orders(t: Tables) -> DataFrame:
    rows = B.backtest_prices(t.adjusted, t.daily_price)
    side = F.when(F.col("trade_date").substr(10, 1) < "5", "buy").otherwise("sell")
    return B.execute_orders(rows.withColumn("side", side).withColumn("shares", F.col("volume") - 20), 0.001, 50, 0.001).select(*_ORDER)


_simple("b2_execution", lambda t: _r6(_orders(t)), """SELECT stock_code, trade_date, side, CASE WHEN reason = '' THEN 'filled' ELSE 'blocked' END AS status, reason, round_even(fill, 6) AS fill_price, round_even(shares * fill, 6) AS gross_amount, round_even(shares * fill * 0.001e0, 6) AS commission,
  round_even(CASE WHEN fill IS NOT NULL THEN CASE WHEN side = 'buy' THEN 0e0 ELSE shares * fill * 0.001e0 END END, 6) AS stamp_tax,
  round_even(CASE WHEN side = 'buy' THEN -(shares * fill + shares * fill * 0.001e0) ELSE shares * fill - shares * fill * 0.001e0 - shares * fill * 0.001e0 END, 6) AS cash_delta
  FROM (SELECT *, CASE WHEN reason = '' THEN adj_open * CASE WHEN side = 'buy' THEN 1.005e0 ELSE 0.995e0 END END AS fill FROM (SELECT *, CASE WHEN shares <= 0 THEN 'ZERO_SHARES' WHEN is_paused THEN 'PAUSED' WHEN side = 'buy' AND open >= limit_up THEN 'LIMIT_UP'
    WHEN side = 'sell' AND open <= limit_down THEN 'LIMIT_DOWN' ELSE '' END AS reason FROM (SELECT a.*, p.open, CASE WHEN substr(a.trade_date, 10, 1) < '5' THEN 'buy' ELSE 'sell' END AS side, a.volume - 20 AS shares FROM adjusted a JOIN daily_price p USING (stock_code, trade_date)) x) y) z""")
_CONFIGS = [B.BacktestConfig("core", FROM, TO, mode, top_n=n) for mode in ("monthly", "quarterly") for n in (5, 20)]
_simple("b4_backtest", lambda t: B.simulate(_stored(t).selection, B.backtest_prices(t.adjusted, t.daily_price), _CONFIGS))
_simple("b5_backtest_metrics", lambda t: B.metrics(B.simulate(_stored(t).selection, B.backtest_prices(t.adjusted, t.daily_price), _CONFIGS)))


def _index_detail(t: Tables) -> DataFrame:
    """Index closes as a portfolio's assets: one run for each index."""
    days = t.benchmark_price.select(F.col("index_code").alias("run_key"), F.lit("portfolio").alias("record_type"), "trade_date", F.col("close").alias("total_asset"))
    fills = t.benchmark_price.select(F.col("index_code").alias("run_key"), F.lit("trade").alias("record_type"), "trade_date", F.lit("filled").alias("status"), F.floor("close").cast("double").alias("gross_amount"), F.lit(1.0).alias("commission"), F.lit(0.5).alias("stamp_tax"))
    return M.union_all([days, fills])


_simple("a11_metrics", lambda t: _r6(B.metrics(_index_detail(t))), """SELECT index_code AS run_key, round_even(r, 6) AS total_return, round_even(pow(1 + r, 252e0 / (n - 1)) - 1, 6) AS annual_return, round_even(dd, 6) AS max_drawdown, round_even(g / m, 6) AS turnover, n * 1.5e0 AS transaction_cost, n AS trade_count
  FROM (SELECT index_code, arg_max(close, trade_date) / arg_min(close, trade_date) - 1 AS r, count(*) AS n, avg(close) AS m, sum(floor(close)) AS g FROM benchmark_price GROUP BY index_code) x
  JOIN (SELECT index_code, min(close / peak - 1) AS dd FROM (SELECT *, max(close) OVER (PARTITION BY index_code ORDER BY trade_date) AS peak FROM benchmark_price) p GROUP BY index_code) y USING (index_code)""")
_simple("a12_index_returns", lambda t: B.index_returns(t.benchmark_price, FROM, TO), f"SELECT index_code, arg_max(close, trade_date) / arg_min(close, trade_date) - 1 AS index_return FROM benchmark_price WHERE trade_date BETWEEN '{FROM}' AND '{TO}' GROUP BY index_code")

# scalars
_simple("m11_codes", lambda t: t.stock_basic.select("stock_code", S.normalize_stock_code(F.concat(F.lower(F.split("stock_code", r"\.")[1]), F.split("stock_code", r"\.")[0])).alias("code"), S.exchange_of("stock_code").alias("exchange"), S.is_st_name("stock_name").alias("st_name")),
        "SELECT stock_code, stock_code AS code, exchange, stock_name LIKE '%ST%' OR stock_name LIKE '%st%' OR upper(stock_name) LIKE '%ST%' AS st_name FROM stock_basic")
_simple("m12_dates", lambda t: t.trade_cal.select("cal_date", S.normalize_date(F.replace("cal_date", F.lit("-"), F.lit(""))).alias("day"), S.period_start("cal_date", "quarterly").alias("quarter"), S.weekdays_between(F.lit("1995-01-01"), "cal_date").cast("long").alias("weekdays")),
        "SELECT cal_date, cal_date AS day, CAST(CAST(date_trunc('quarter', CAST(cal_date AS DATE)) AS DATE) AS VARCHAR) AS quarter, (SELECT count(*) FROM range(DATE '1995-01-01', CAST(cal_date AS DATE) + INTERVAL 1 DAY, INTERVAL 1 DAY) r(d) WHERE isodow(d) < 6) AS weekdays FROM trade_cal")
_simple("m7_flags", lambda t: t.risk.select(*KEYS, F.array_join(F.array_sort(S.parse_flags(F.concat("risk_flags", F.lit(", Extra ;")))), "|").alias("flags")), "SELECT stock_code, trade_date, array_to_string(list_sort(list_distinct([lower(trim(x)) FOR x IN regexp_split_to_array(risk_flags || ', Extra ;', '[;,]') IF trim(x) <> ''])), '|') AS flags FROM risk")

# the query API over summary tables
_SNAP = "SELECT trade_date, 'monthly' AS rebalance_mode, count(*) AS stock_count, max(total_score) AS max_total_score, trade_date AS created_at FROM selection GROUP BY trade_date"
_snap = lambda t: t.selection.groupBy("trade_date").agg(F.lit("monthly").alias("rebalance_mode"), F.count(F.lit(1)).alias("stock_count"), F.max("total_score").alias("max_total_score")).withColumn("created_at", F.col("trade_date"))
_simple("r1_selections", lambda t: api.selections(_snap(t), 20, 5), f"SELECT * FROM ({_SNAP}) x ORDER BY trade_date DESC LIMIT 20 OFFSET 5")
_simple("r2_selection", lambda t: api.selection(_snap(t), "1998-06-30"), f"SELECT * FROM ({_SNAP}) x WHERE trade_date = '1998-06-30'")
_RUNS = "SELECT substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 16) AS run_key, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'monthly' ELSE 'quarterly' END AS rebalance_mode, CAST(o_totalprice AS DOUBLE) AS total_return, CAST(o_orderdate AS DATE) AS created_at FROM orders"


def _runs(t: Tables) -> DataFrame:
    o = t.spark.read.parquet(f"{t.sf_dir}/orders.parquet")
    return o.select(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 16).alias("run_key"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "monthly").otherwise("quarterly").alias("rebalance_mode"),
                    F.to_json(F.struct(F.col("o_totalprice").alias("total_return"))).alias("metrics"), F.to_date("o_orderdate").alias("created_at"))


_simple("r3_backtests", lambda t: api.backtests(_runs(t), "done", "monthly", 20, 10).drop("metrics", "annual_return"), f"SELECT * FROM ({_RUNS}) x WHERE status = 'done' AND rebalance_mode = 'monthly' ORDER BY created_at DESC, run_key DESC LIMIT 20 OFFSET 10")
_simple("r4_backtest", lambda t: api.backtest(_runs(t), "c4ca4238a0b92382").select("run_key", "status"), "SELECT DISTINCT substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 16) AS run_key, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS status FROM orders WHERE o_orderkey = 1 LIMIT 1")
_simple("r6_task_logs", lambda t: api.task_logs(t.spark.read.parquet(f"{t.sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("task_type"), F.to_date("o_orderdate").alias("created_at")), "O", "2-HIGH", 50), "SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS task_type, CAST(o_orderdate AS DATE) AS created_at FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' ORDER BY 4 DESC, 1 DESC LIMIT 50")
_simple("r7_health", lambda t: api.health(t.spark), "SELECT 1 AS ok")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top twenty candidates of each month's last trade date."""
    return Tables(spark, sf_dir).selection


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog_backtest, catalog_more, catalog_reports  # noqa: F401  they register theirs when they are read

    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from . import catalog_backtest, catalog_more, catalog_reports  # noqa: F401

    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
