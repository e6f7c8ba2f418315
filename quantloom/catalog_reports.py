"""Registered queries of reports, gates, proofs and validators, over frames with planted faults, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog_queries as Q
from .catalog_more import _both, _long, _values
from .catalog_queries import _WEIGHTS, DAY, KEYS, Tables, _simple
from .functions import contracts as T
from .functions import driver as D
from .functions import scalars as S
from .operators import candidate as C
from .operators import merge as M
from .operators import quality
from .operators import readiness as R
from .plans import runners
from .schemas import FACTORS

_BAD_DATE = lambda c: f"({c} IS NOT NULL AND (NOT regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') OR try_cast({c} AS DATE) IS NULL))"
_CODE = "NOT coalesce(regexp_matches(stock_code, '^[0-9]{6}\\.(SZ|SH|BJ)$'), false)"


def _rules(name: str, text: str, used: tuple, of: str, counts: list[tuple[str, str]], date: str | None = None, strict: bool = False) -> None:
    """Register a validator over a frame with planted faults: its named rules against conditions in SQL."""
    frame, sql = _both(text, *used)
    wanted = [n for n, _ in counts]
    _simple(name, lambda t: quality.violations(frame(t), of, date, strict).where(F.col("rule").isin(wanted)), _long(counts, f"({sql}) x"))


_rules(
    "v1_stock_basic_rules",
    """SELECT CASE WHEN stock_code LIKE '%7.SH' THEN lower(stock_code) ELSE stock_code END AS stock_code, stock_name, exchange, CASE WHEN stock_code LIKE '00001%' THEN '1995-02-30' WHEN stock_code LIKE '00002%' THEN '19950101' ELSE list_date END AS list_date,
    CASE WHEN stock_code LIKE '00003%' THEN list_date ELSE delist_date END AS delist_date, industry, CASE WHEN is_st THEN CAST(NULL AS STRING) ELSE market_type END AS market_type, is_st, '1998-06-30' AS trade_date FROM {stock_basic}""",
    ("stock_basic",),
    "stock_basic",
    [("stock_code", _CODE), ("date:list_date", f"list_date IS NULL OR {_BAD_DATE('list_date')}"), ("date:delist_date", _BAD_DATE("delist_date")), ("delisted_before_listed", "delist_date <= list_date"), ("nulls", "market_type IS NULL")],
)
_rules("v3_adj_factor_rules", "SELECT stock_code, trade_date, CASE WHEN trade_date LIKE '%-15' THEN -adj_factor WHEN trade_date LIKE '%-16' THEN NULL ELSE adj_factor END AS adj_factor FROM {adj_factor} UNION ALL SELECT * FROM {adj_factor} WHERE trade_date LIKE '1997-03%'", ("adj_factor",), "adj_factor", [("rows", "true"), ("positive", "NOT (adj_factor > 0)"), ("nulls", "adj_factor IS NULL")])
_rules(
    "v4_valuation_rules",
    "SELECT stock_code, CASE WHEN trade_date LIKE '%-15' THEN replace(trade_date, '-', '/') ELSE trade_date END AS trade_date, CASE WHEN pe_ttm > 60 THEN NULL ELSE pe_ttm END AS pe_ttm, pb, ps_ttm, total_mv, circ_mv, turnover_rate FROM {daily_basic}",
    ("daily_basic",), "daily_basic", [("date:trade_date", f"trade_date IS NULL OR {_BAD_DATE('trade_date')}"), ("nulls", "pe_ttm IS NULL")],
)
_rules("v5_st_history_rules", "SELECT stock_code, st_type, start_date, CASE WHEN source LIKE '%1' THEN start_date WHEN source LIKE '%2' THEN '1998-13-01' ELSE end_date END AS end_date, source FROM {st_history}", ("st_history",), "st_history", [("date:end_date", _BAD_DATE("end_date")), ("interval", "end_date <= start_date")])
_rules("v5_benchmark_rules", "SELECT index_code, trade_date, CASE WHEN trade_date LIKE '%-15' THEN 0e0 ELSE open END AS open, CASE WHEN trade_date LIKE '%-16' THEN low - 1 ELSE high END AS high, low, close, pct_chg FROM {benchmark_price}", ("benchmark_price",), "benchmark_price", [("prices_positive", "NOT (open > 0) OR NOT (high > 0) OR NOT (low > 0) OR NOT (close > 0)"), ("high_low", "low > high")])


def _missing_index(t: Tables) -> DataFrame:
    out = []
    for name, df in (("whole", t.benchmark_price), ("two", t.benchmark_price.where("index_code <> '000905.SH'"))):
        try:
            quality.validate(df, "benchmark_price")
            out.append((name, "PASS"))
        except quality.DataQualityError as e:
            out.append((name, str(e).split("; ")[-1].removeprefix("benchmark_price: ")))
    return _values(t, out, "frame string, outcome string")


_simple("v5_missing_index", _missing_index, "SELECT * FROM (VALUES ('whole', 'PASS'), ('two', 'missing index 000905.SH')) v(frame, outcome)")


def _on(frame, name: str, wanted: list[str], sql: str, query: str, date: str | None = None) -> None:
    _simple(query, lambda t: quality.violations(frame(t), name, date).where(F.col("rule").isin(wanted)), sql)


_on(
    lambda t: t.adjusted.withColumn("adj_low", F.when(F.col("trade_date").like("%-15"), F.lit(0.0)).when(F.col("trade_date").like("%-16"), F.col("adj_high") + 1).otherwise(F.col("adj_low"))),
    "adjusted_price", ["prices_positive", "high_low"],
    _long([("prices_positive", "NOT (adj_low > 0)"), ("high_low", "adj_low > adj_high")], "(SELECT * REPLACE (CASE WHEN trade_date LIKE '%-15' THEN 0e0 WHEN trade_date LIKE '%-16' THEN adj_high + 1 ELSE adj_low END AS adj_low) FROM adjusted) x"), "v6_adjusted_rules",
)
_on(
    lambda t: t.snapshot.withColumn("listed_days", F.col("listed_days") - 400).withColumn("announce_date", F.when(F.col("trade_date").like("%-15"), F.lit("2009-01-01")).otherwise(F.col("announce_date"))),
    "clean_daily_snapshot", ["listed_days", "visible"],
    _long([("listed_days", "listed_days - 400 < 0"), ("visible", "CASE WHEN trade_date LIKE '%-15' THEN '2009-01-01' ELSE announce_date END > trade_date")], "snapshot"), "v6_snapshot_rules",
)
_on(
    lambda t: t.risk.withColumn("risk_flags", F.when(F.col("trade_date").like("%-15"), F.lit(None).cast("string")).otherwise(F.col("risk_flags"))).withColumn("is_eligible", F.when(F.col("trade_date").like("%-16"), ~F.col("is_eligible")).otherwise(F.col("is_eligible"))),
    "risk_filter", ["text", "eligible"], _long([("text", "trade_date LIKE '%-15'"), ("eligible", "trade_date LIKE '%-16'")], "risk"), "v7_risk_rules",
)
_on(
    lambda t: t.inputs.withColumn("adj_close", F.when(F.col("trade_date").like("%-15"), -F.col("adj_close")).otherwise(F.col("adj_close"))),
    "factor_input_table", ["rows", "adj_close"], _long([("rows", "true"), ("adj_close", "trade_date LIKE '%-15'")], "inputs"), "v7_factor_input_rules",
)
_on(
    lambda t: t.factors.withColumn("quality_roe", F.when(F.col("trade_date").like("%-15"), F.lit(float("inf"))).otherwise(F.col("quality_roe"))).withColumn("trend_score", F.when(F.col("trade_date").like("%-16"), F.col("trend_score") + 101).when(F.col("trade_date").like("%-17"), F.lit(None).cast("double")).otherwise(F.col("trend_score"))),
    "factor_daily", ["finite", "scores"], _long([("finite", "trade_date LIKE '%-15'"), ("scores", "trade_date LIKE '%-16' OR trade_date LIKE '%-17'")], "factor"), "v8_factor_rules",
)


def _forbidden_column(t: Tables) -> DataFrame:
    try:
        quality.validate(t.factors.withColumn("total_score", F.lit(1.0)), "factor_daily")
        return _values(t, [("PASS",)], "outcome string")
    except quality.DataQualityError as e:
        return _values(t, [(str(e).rpartition(": ")[2],)], "outcome string")


_simple("v8_forbidden_total", _forbidden_column, "SELECT 'total_score' AS outcome")
_on(
    lambda t: t.selection.withColumn("reason", F.when(F.col("rank") == 1, F.lit(" ")).when(F.col("rank") == 2, F.lit("稳赚")).otherwise(F.col("reason"))).withColumn("risk_level", F.when(F.col("rank") == 3, F.lit("none")).otherwise(F.col("risk_level"))).withColumn("total_score", F.when(F.col("rank") == 4, F.lit(101.0)).otherwise(F.col("total_score"))),
    "selection_result", ["scores", "risk_level", "texts", "forbidden_words"], _long([("scores", "rank = 4"), ("risk_level", "rank = 3"), ("texts", "rank = 1"), ("forbidden_words", "rank = 2")], "selection"), "v9_selection_rules",
)
_simple(
    "v9_ranking",
    lambda t: quality.ranking_faults(t.selection.withColumn("rank", F.when(F.col("rank") == 2, F.lit(3)).when(F.col("rank") == 3, F.lit(2)).otherwise(F.col("rank")))).unionByName(quality.ranking_faults(t.selection)),
    "SELECT count(*) FILTER (rank IN (2, 3)) AS n FROM selection UNION ALL SELECT 0",
)
_rules(
    "v11_canonical_price_rules",
    "SELECT stock_code, trade_date, CASE WHEN trade_date LIKE '%-15' THEN high + 1 ELSE open END AS open, high, CASE WHEN trade_date LIKE '%-16' THEN 0e0 ELSE low END AS low, close, pre_close, volume, amount, pct_chg, CASE WHEN trade_date LIKE '%-17' THEN NULL ELSE is_paused END AS is_paused, CASE WHEN trade_date LIKE '%-18' THEN close - 1 ELSE limit_up END AS limit_up, limit_down FROM {daily_price}",
    ("daily_price",), "daily_price",
    [("prices_positive", "NOT (open > 0) OR NOT (high > 0) OR NOT (low > 0) OR NOT (close > 0) OR NOT (pre_close > 0)"), ("ohlc_order", "open > high OR close > high OR low > open OR low > close"), ("limits", "close > limit_up OR limit_down > close"), ("nulls", "is_paused IS NULL")], strict=True,
)
_V12 = "SELECT stock_code, CASE WHEN trade_date LIKE '%-15' THEN CAST(NULL AS STRING) ELSE trade_date END AS trade_date, open, high, low, close, pre_close, volume, amount, pct_chg, is_paused, limit_up, limit_down FROM {daily_price} UNION ALL SELECT stock_code, trade_date, open, high, low, close, pre_close, volume, amount, pct_chg, is_paused, limit_up, limit_down FROM {daily_price} WHERE trade_date LIKE '1997-03-1%'"
_v12, _v12_sql = _both(_V12, "daily_price")
_simple("v12_input_semantics", lambda t: quality.violations(_v12(t), "daily_price").where("rule in ('nulls', 'duplicate_keys')"), f"SELECT 'nulls' AS rule, count(*) FILTER (trade_date IS NULL) AS n FROM ({_v12_sql}) x UNION ALL SELECT 'duplicate_keys', CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM ({_v12_sql}) y GROUP BY stock_code, trade_date) z")
_simple(
    "v12_faults_by_date",
    lambda t: _values(t, [(d, len(b), b[0].split(":")[0]) for d, b in quality.faults_by_date(t.daily_price.withColumn("high", F.when(F.col("trade_date").like("1998-0%-15"), F.col("low") - 1).otherwise(F.col("high"))), "daily_price", [f"1998-{m:02d}-15" for m in range(1, 13)]).items()], "trade_date string, n long, rule string"),
    "SELECT trade_date, CAST(1 AS BIGINT) AS n, 'high_low' AS rule FROM daily_price WHERE trade_date LIKE '1998-0%-15' GROUP BY trade_date UNION ALL SELECT d, CAST(1 AS BIGINT), 'no rows' FROM (SELECT '1998-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-15' AS d FROM range(1, 13) r(m)) x WHERE d NOT IN (SELECT trade_date FROM daily_price)",
)

# recomputation and keys, with faults planted
_FAULTY = "(SELECT * REPLACE (CASE WHEN rank % 5 = 0 THEN total_score + 1e-5 ELSE total_score END AS total_score, CASE WHEN rank % 3 = 0 THEN 'medium' ELSE risk_level END AS risk_level, CASE WHEN rank % 7 = 0 THEN reason || 'x' ELSE reason END AS reason, CASE WHEN rank % 4 = 0 THEN 'none' ELSE suggestion END AS suggestion) FROM selection)"
_LEVEL = "CASE WHEN total_score < 55 OR quality_score < 40 OR growth_score < 30 THEN 'high' WHEN total_score >= 75 AND quality_score >= 60 AND growth_score >= 50 THEN 'low' ELSE 'medium' END"
_ADVICE = f"CASE WHEN total_score >= 80 AND risk_level = 'low' THEN '{S.SUGGESTIONS[0]}' WHEN total_score >= 70 AND risk_level IN ('low', 'medium') THEN '{S.SUGGESTIONS[1]}' WHEN total_score >= 60 THEN '{S.SUGGESTIONS[2]}' ELSE '{S.SUGGESTIONS[3]}' END"


def _faulty(t: Tables) -> DataFrame:
    on = lambda n, new, old: F.when(F.col("rank") % n == 0, new).otherwise(F.col(old))
    return t.selection.withColumns({"total_score": on(5, F.col("total_score") + 1e-5, "total_score"), "risk_level": on(3, F.lit("medium"), "risk_level"), "reason": on(7, F.concat("reason", F.lit("x")), "reason"), "suggestion": on(4, F.lit("none"), "suggestion")})


_simple("v14_planted_faults", lambda t: quality.recomputation_faults(_faulty(t), _WEIGHTS), f"SELECT count(*) FILTER (rank % 5 = 0) AS total_score, count(*) FILTER (risk_level <> {_LEVEL}) AS risk_level, count(*) FILTER (rank % 7 = 0) AS reason, count(*) FILTER (suggestion <> {_ADVICE}) AS suggestion FROM {_FAULTY} x")


def _key_faults(t: Tables) -> tuple:
    day = lambda n: f"trade_date not like '%-{n}'"
    keys = t.inputs.select(*KEYS)
    return keys.where(day("15")), keys.where(day("16")), keys.where(day("17")), t.risk.withColumn("is_eligible", F.col("is_eligible") & ~F.col("trade_date").like("%-18"))


_D = lambda n: f"trade_date LIKE '%-{n}'"
_simple("j12_planted_faults", lambda t: M.key_audit(*_key_faults(t)), f"SELECT count(*) FILTER ({_D(16)}) AS factor_not_eligible, count(*) FILTER ({_D(15)}) AS eligible_not_factor, count(*) FILTER ({_D(17)}) AS eligible_not_input, count(*) FILTER ({_D(16)}) AS input_not_eligible, count(*) FILTER ({_D(18)}) AS eligible_not_in_risk FROM inputs")
_simple(
    "j12_audits_by_date",
    lambda t: _values(t, [(d, sum(c.values())) for d, c in M.key_audits(*_key_faults(t)).items()], "trade_date string, n long"),
    f"SELECT trade_date, CAST(CASE WHEN {_D(16)} THEN 2 * count(*) WHEN {_D(15)} OR {_D(17)} OR {_D(18)} THEN count(*) ELSE 0 END AS BIGINT) AS n FROM inputs GROUP BY trade_date",
)
_simple(
    "p6_effective_factors",
    lambda t: _values(t, sorted(quality.effective_factors(t.factors).items()), "trade_date string, n long"),
    "SELECT trade_date, CAST(" + " + ".join(f"CASE WHEN count({c}) > 0 THEN 1 ELSE 0 END" for c in FACTORS) + " AS BIGINT) AS n FROM factor GROUP BY trade_date",
)

# --- event evidence and gates -----------------------------------------------------------

_CALLS, _CALLS_SQL = _both(
    """SELECT cal_date AS trade_date, CAST(NULL AS STRING) AS stock_code, 'by_trade_date_full_market_event_set' AS strategy, CASE WHEN substr(cal_date, 9, 2) = '03' THEN 'reused' ELSE 'provider' END AS source FROM {trade_cal} WHERE substr(cal_date, 9, 2) < '16'
UNION ALL SELECT cal_date, stock_code, 'by_code', 'provider' FROM {trade_cal} JOIN {stock_basic} ON substr(cal_date, 9, 2) IN ('20', '21') AND substr(cal_date, 1, 4) = '1997' WHERE NOT (substr(cal_date, 9, 2) = '21' AND stock_code LIKE '%5.%')""",
    "trade_cal", "stock_basic",
)
_ERRORS, _ERRORS_SQL = _both(
    "SELECT cal_date AS trade_date, CASE substr(cal_date, 9, 2) WHEN '05' THEN 'PROVIDER_EMPTY_AFTER_RETRIES' WHEN '06' THEN 'PROVIDER_FETCH_INCOMPLETE' ELSE 'OTHER' END AS reason, substr(cal_date, 9, 2) = '07' AS fatal FROM {trade_cal} WHERE substr(cal_date, 9, 2) IN ('05', '06', '07', '08')",
    "trade_cal",
)


def _coverage(t: Tables) -> DataFrame:
    return R.event_coverage(C.open_dates(t.trade_cal), _CALLS(t), _ERRORS(t), t.suspend_event, t.stock_basic)


_EVENTS = f"""(SELECT trade_date, query_scope_mode, CASE WHEN empties + incompletes > 0 THEN 'INCOMPLETE' WHEN errors > 0 THEN 'FAILED' WHEN calls > 0 THEN 'SUCCESS' ELSE 'UNKNOWN' END AS fetch_status, row_count, reasons,
    query_scope_mode IN ('DATE_FULL_MARKET_EVENT_SET', 'CODE_DATE_EXPLICIT_FULL_UNIVERSE') AND len(reasons) = 0 AS miss_is_false, empties
  FROM (SELECT *, [x FOR x IN [CASE WHEN query_scope_mode = 'UNKNOWN' THEN 'SUSPEND_D_QUERY_SCOPE_UNKNOWN' END, CASE WHEN query_scope_mode = 'PARTIAL' THEN 'SUSPEND_D_PARTIAL_UNIVERSE_COVERAGE' END, CASE WHEN empties > 0 THEN 'SUSPEND_D_PROVIDER_EMPTY_AFTER_RETRIES' END,
      CASE WHEN incompletes > 0 THEN 'SUSPEND_D_PROVIDER_FETCH_INCOMPLETE' END, CASE WHEN fatals > 0 THEN 'SUSPEND_D_PROVIDER_FETCH_FAILED' END] IF x IS NOT NULL] AS reasons
    FROM (SELECT d.trade_date, coalesce(c.calls, 0) AS calls, coalesce(e.errors, 0) AS errors, coalesce(e.empties, 0) AS empties, coalesce(e.incompletes, 0) AS incompletes, coalesce(e.fatals, 0) AS fatals, coalesce(s.n, 0) AS row_count,
        CASE WHEN coalesce(c.provider, 0) = 0 THEN 'UNKNOWN' WHEN c.market > 0 THEN 'DATE_FULL_MARKET_EVENT_SET' WHEN c.codes = (SELECT count(*) FROM stock_basic) THEN 'CODE_DATE_EXPLICIT_FULL_UNIVERSE' WHEN c.codes > 0 THEN 'PARTIAL' ELSE 'UNKNOWN' END AS query_scope_mode
      FROM (SELECT DISTINCT cal_date AS trade_date FROM trade_cal) d LEFT JOIN (SELECT trade_date, count(*) AS calls, count(*) FILTER (source = 'provider') AS provider, count(*) FILTER (source = 'provider' AND stock_code IS NULL) AS market, count(DISTINCT stock_code) AS codes FROM ({_CALLS_SQL}) a GROUP BY trade_date) c USING (trade_date)
      LEFT JOIN (SELECT trade_date, count(*) AS errors, count(*) FILTER (reason = 'PROVIDER_EMPTY_AFTER_RETRIES') AS empties, count(*) FILTER (reason = 'PROVIDER_FETCH_INCOMPLETE') AS incompletes, count(*) FILTER (fatal) AS fatals FROM ({_ERRORS_SQL}) b GROUP BY trade_date) e USING (trade_date)
      LEFT JOIN (SELECT trade_date, count(*) AS n FROM suspend_event GROUP BY trade_date) s USING (trade_date)) q) r)"""
_simple(
    "p8_event_coverage",
    lambda t: _coverage(t).withColumn("blocked_reasons", F.array_join("blocked_reasons", ";")),
    f"SELECT trade_date, query_scope_mode, fetch_status, row_count, CASE WHEN empties > 0 THEN 'EMPTY_AFTER_RETRIES' WHEN row_count > 0 THEN 'NOT_EMPTY' WHEN fetch_status = 'SUCCESS' AND miss_is_false THEN 'VALID_EMPTY_EVENT_SET' ELSE 'UNKNOWN' END AS empty_semantics, miss_is_false, array_to_string(reasons, ';') AS blocked_reasons FROM {_EVENTS} x",
)
_simple("p8_event_status", lambda t: R.event_coverage_status(_coverage(t)), f"SELECT 'FAILED' AS status, 'PARTIAL' AS query_scope_mode, count(*) AS dates, count(*) FILTER (miss_is_false) AS confirmed_dates FROM {_EVENTS} x")
_simple("p8_pause_resolution", lambda t: R.pause_resolution(t.daily_price, t.suspend_event, _coverage(t)), f"SELECT count(*) FILTER (s.stock_code IS NOT NULL) AS true_candidate, count(*) FILTER (s.stock_code IS NULL AND miss_is_false) AS false_candidate, count(*) FILTER (s.stock_code IS NULL AND NOT miss_is_false) AS unknown FROM daily_price p LEFT JOIN suspend_event s USING (stock_code, trade_date) JOIN {_EVENTS} x USING (trade_date)")


def _interfaces(t: Tables) -> dict[str, DataFrame]:
    return {"daily": t.daily_price, "stk_limit": t.daily_price.where("trade_date not like '%-15'"), "adj_factor": t.adj_factor.unionByName(t.adj_factor.where("trade_date like '1997-03%'")), "daily_basic": t.daily_basic}


def _batch_coverage(t: Tables) -> DataFrame:
    return R.batch_coverage(t.adj_factor, _interfaces(t))


_FACES = "(SELECT 'daily' AS interface, stock_code, trade_date FROM daily_price UNION ALL SELECT 'stk_limit', stock_code, trade_date FROM daily_price WHERE trade_date NOT LIKE '%-15' UNION ALL SELECT 'adj_factor', stock_code, trade_date FROM adj_factor UNION ALL SELECT 'adj_factor', stock_code, trade_date FROM adj_factor WHERE trade_date LIKE '1997-03%' UNION ALL SELECT 'daily_basic', stock_code, trade_date FROM daily_basic)"
_COVERED = f"SELECT interface, count(e) AS expected, count(*) FILTER (e AND n IS NOT NULL) AS matched, count(*) FILTER (e AND n IS NULL) AS missing, count(*) FILTER (e IS NULL) AS unexpected, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows FROM (SELECT *, true AS e FROM (SELECT DISTINCT stock_code, trade_date FROM adj_factor) a, (VALUES ('daily'), ('stk_limit'), ('adj_factor'), ('daily_basic')) v(interface)) w FULL JOIN (SELECT interface, stock_code, trade_date, count(*) AS n FROM {_FACES} f GROUP BY ALL) h USING (interface, stock_code, trade_date) GROUP BY interface"
_simple("p7_batch_coverage", _batch_coverage, _COVERED)
_SHORT = f"(SELECT bool_or(matched < expected) FILTER (interface = 'daily') AS a, bool_or(matched < expected) FILTER (interface = 'stk_limit') AS b, bool_or(matched < expected) FILTER (interface = 'adj_factor') AS c, bool_or(matched < expected) FILTER (interface = 'daily_basic') AS d, sum(surplus_rows) > 0 AS s, (SELECT count(*) FROM batch WHERE pause_status = 'unknown') > 0 AS u, (SELECT count(*) FROM ({_ERRORS_SQL}) e) > 0 AS e FROM ({_COVERED}) x)"
_GAPS = "CASE WHEN a THEN 'INCOMPLETE_DAILY_COVERAGE' END, CASE WHEN b THEN 'INCOMPLETE_LIMIT_PRICE_COVERAGE' END, CASE WHEN c THEN 'INCOMPLETE_ADJ_FACTOR_COVERAGE' END, CASE WHEN d THEN 'INCOMPLETE_DAILY_BASIC_COVERAGE' END"
_simple(
    "p10_preflight",
    lambda t: R.preflight(_batch_coverage(t), Q._batch(t), "PARTIAL", _ERRORS(t)).withColumn("blocked_reasons", F.array_join("blocked_reasons", ";")),
    f"SELECT 'BLOCKED' AS status, array_to_string([x FOR x IN [{_GAPS}, CASE WHEN e THEN 'PROVIDER_EMPTY_AFTER_RETRIES' END, CASE WHEN e THEN 'PROVIDER_FETCH_INCOMPLETE' END, 'SUSPEND_D_FULL_COVERAGE_NOT_CONFIRMED', CASE WHEN u THEN 'UNRESOLVED_IS_PAUSED' END] IF x IS NOT NULL], ';') AS blocked_reasons FROM {_SHORT} y",
)
_simple(
    "p10_preflight_ready",
    lambda t: R.preflight(R.batch_coverage(t.daily_basic, {n: t.daily_basic for n in R.COVERAGE_REASONS}), Q._batch(t).where("pause_status <> 'unknown'"), "CONFIRMED", _ERRORS(t).limit(0)).withColumn("blocked_reasons", F.array_join("blocked_reasons", ";")),
    "SELECT 'READY_FOR_PROMOTION_VALIDATOR' AS status, '' AS blocked_reasons",
)
_simple(
    "p10_dq3_audit",
    lambda t: R.dq3_audit(_batch_coverage(t), Q._batch(t), False, _ERRORS(t)).withColumn("blocked_reasons", F.array_join("blocked_reasons", ";")),
    f"SELECT array_to_string(list_distinct_ordered, ';') AS blocked_reasons, NOT (a OR b OR c OR d) AS price_coverage_complete, false AS ready_for_dq3_promotion FROM (SELECT *, [x FOR x IN [{_GAPS}, CASE WHEN s THEN 'DUPLICATE_KEYS_FOUND' END, CASE WHEN e THEN 'PROVIDER_EMPTY_AFTER_RETRIES' END, CASE WHEN e THEN 'PROVIDER_FETCH_INCOMPLETE' END, CASE WHEN u THEN 'UNRESOLVED_IS_PAUSED' END, 'INCOMPLETE_OR_UNKNOWN_SUSPEND_D_COVERAGE'] IF x IS NOT NULL] AS list_distinct_ordered FROM {_SHORT} y) z",
)
_P12_CODES, _P12_DAYS = ["000001.SH", "000002.BJ", "000010.SH"], ["1997-03-03", "1997-03-04", "1997-03-05", "1997-03-06"]
_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_simple(
    "p12_small_batch",
    lambda t: R.small_batch(t.daily_price, Q._batch(t).withColumn("close", F.col("close") + 1), _P12_CODES, _P12_DAYS).where(F.col("stock_code").isin(_P12_CODES)).select(*KEYS, "close", "is_paused"),
    f"SELECT stock_code, trade_date, close, is_paused FROM daily_price WHERE stock_code IN {_in(_P12_CODES)} AND trade_date NOT IN {_in(_P12_DAYS)} UNION ALL SELECT stock_code, trade_date, close + 1, is_paused_candidate FROM batch WHERE stock_code IN {_in(_P12_CODES)} AND trade_date IN {_in(_P12_DAYS)}",
)


def _scope_guard(t: Tables) -> DataFrame:
    out = []
    for codes, days in ((3, 4), (6, 1), (1, 11), (5, 10), (5, 9)):
        try:
            R.check_scope([str(i) for i in range(codes)], [str(i) for i in range(days)], max_rows=45)
            out.append((codes, days, "fine"))
        except R.ScopeTooLarge as e:
            out.append((codes, days, str(e).split(" ")[1].rstrip(",")))
    return _values(t, out, "codes int, days int, outcome string")


_simple("p12_scope_guard", _scope_guard, "SELECT * FROM (VALUES (3, 4, 'fine'), (6, 1, 'codes'), (1, 11, 'days'), (5, 10, 'rows'), (5, 9, 'fine')) v(codes, days, outcome)")

# --- landing and readiness --------------------------------------------------------------------

_simple(
    "p13_standard_input_faults",
    lambda t: R.standard_input_faults(t.daily_basic.where("stock_code <= '000020.SZ'"), t.financial, _P12_CODES, _P12_DAYS),
    f"""WITH w AS (SELECT c AS stock_code, d AS trade_date FROM (VALUES {', '.join(f"('{c}')" for c in _P12_CODES)}) a(c), (VALUES {', '.join(f"('{d}')" for d in _P12_DAYS)}) b(d)), h AS (SELECT stock_code, trade_date FROM daily_basic WHERE stock_code <= '000020.SZ' AND trade_date IN {_in(_P12_DAYS)})
SELECT 'daily_basic' AS dataset, 'DAILY_BASIC_MISSING_PAIR' AS reason, count(*) AS n FROM w ANTI JOIN h USING (stock_code, trade_date) UNION ALL SELECT 'daily_basic', 'DAILY_BASIC_UNEXPECTED_PAIR', count(*) FROM h ANTI JOIN w USING (stock_code, trade_date) UNION ALL SELECT 'daily_basic', 'DAILY_BASIC_DUPLICATE_PAIR', 0
UNION ALL SELECT 'financial', 'FINANCIAL_ANNOUNCE_DATE_AFTER_SCOPE_START', count(*) FROM financial WHERE stock_code IN {_in(_P12_CODES)} AND announce_date > '1997-03-03' UNION ALL SELECT 'financial', 'FINANCIAL_CODE', 0""",
)
_simple(
    "p13_land_financial",
    lambda t: R.land_financial(t.financial.where("report_period < '1998-01-01'"), t.financial.where("report_period >= '1997-06-01'").withColumn("roe", F.col("roe") + 1), ["1997-12-31", "1998-06-30"]).select("as_of", "stock_code", "report_period", "announce_date", "roe"),
    "SELECT as_of, stock_code, report_period, announce_date, CASE WHEN report_period >= '1997-06-01' THEN roe + 1 ELSE roe END AS roe FROM financial, (VALUES ('1997-12-31'), ('1998-06-30')) v(as_of) WHERE announce_date <= as_of",
)
_simple(
    "p14_source_precedence",
    lambda t: R.first_source([("staging", t.adj_factor.where("trade_date like '1997%'").withColumn("adj_factor", F.col("adj_factor") + 1)), ("earlier", t.adj_factor.where("trade_date like '1997-0%' or trade_date like '1998-0%'").withColumn("adj_factor", F.col("adj_factor") + 2)), ("canonical", t.adj_factor)], C.open_dates(t.trade_cal)),
    "SELECT stock_code, trade_date, adj_factor + CASE WHEN trade_date LIKE '1997%' THEN 1 WHEN trade_date LIKE '1998-0%' THEN 2 ELSE 0 END AS adj_factor, CASE WHEN trade_date LIKE '1997%' THEN 'staging' WHEN trade_date LIKE '1998-0%' THEN 'earlier' ELSE 'canonical' END AS source FROM adj_factor",
)
_READY = lambda t: {"daily_price": t.daily_price, "adj_factor": t.adj_factor, "daily_basic": t.daily_basic, "whole": t.inputs}
_HAVE = "(SELECT 'daily_price' AS input, stock_code, trade_date FROM daily_price UNION ALL SELECT 'adj_factor', stock_code, trade_date FROM adj_factor UNION ALL SELECT 'daily_basic', stock_code, trade_date FROM daily_basic UNION ALL SELECT 'whole', stock_code, trade_date FROM inputs)"
_WANT = "(SELECT stock_code, trade_date, input FROM inputs, (VALUES ('daily_price'), ('adj_factor'), ('daily_basic'), ('whole')) v(input))"
_simple("p14_input_readiness", lambda t: R.input_readiness(t.inputs, _READY(t)), f"SELECT input, count(*) AS expected, count(h.hit) AS rows, count(*) - count(h.hit) AS missing, CAST(0 AS BIGINT) AS surplus_rows, count(*) = count(h.hit) AS ready FROM {_WANT} w LEFT JOIN (SELECT *, true AS hit FROM {_HAVE} a) h USING (input, stock_code, trade_date) GROUP BY input")
_simple("p14_missing_pairs", lambda t: R.missing_pairs(t.daily_price, {"adj_factor": t.adj_factor, "daily_basic": t.daily_basic}), "SELECT 'adj_factor' AS input, stock_code, trade_date FROM daily_price ANTI JOIN adj_factor USING (stock_code, trade_date) UNION ALL SELECT 'daily_basic', stock_code, trade_date FROM daily_price ANTI JOIN daily_basic USING (stock_code, trade_date)")
_GAPDAYS = [f"1998-{m:02d}-{d:02d}" for m in range(1, 13) for d in (10, 20)]
_simple(
    "p3_gaps_by_date",
    lambda t: _values(t, [(d, g["active"], g["no_daily_price"], g["no_adj_factor"], g["no_daily_basic"], g["no_financial"], g["no_master"]) for d, g in quality.gaps_by_date(t.daily_price, t.adj_factor, t.daily_basic, t.financial, t.stock_basic.where("stock_code not like '%9.%'"), _GAPDAYS).items()], "trade_date string, active long, no_daily_price long, no_adj_factor long, no_daily_basic long, no_financial long, no_master long"),
    f"""WITH g AS (SELECT d AS trade_date FROM (VALUES {', '.join(f"('{d}')" for d in _GAPDAYS)}) v(d)), m AS (SELECT * FROM stock_basic WHERE stock_code NOT LIKE '%9.%'), a AS (SELECT trade_date, stock_code FROM g JOIN m ON list_date <= trade_date AND (delist_date IS NULL OR delist_date > trade_date)),
f AS (SELECT stock_code, min(greatest(announce_date, report_period)) AS known FROM financial GROUP BY stock_code)
SELECT g.trade_date, coalesce(c.active, 0) AS active, coalesce(c.p, 0) AS no_daily_price, coalesce(c.q, 0) AS no_adj_factor, coalesce(c.r, 0) AS no_daily_basic, coalesce(c.s, 0) AS no_financial, coalesce(o.n, 0) AS no_master FROM g LEFT JOIN (SELECT a.trade_date, count(*) AS active, count(*) FILTER (p.close IS NULL) AS p, count(*) FILTER (q.adj_factor IS NULL) AS q, count(*) FILTER (r.pb IS NULL) AS r, count(*) FILTER (NOT coalesce(known <= a.trade_date, false)) AS s
  FROM a LEFT JOIN daily_price p ON p.stock_code = a.stock_code AND p.trade_date = a.trade_date LEFT JOIN adj_factor q ON q.stock_code = a.stock_code AND q.trade_date = a.trade_date LEFT JOIN daily_basic r ON r.stock_code = a.stock_code AND r.trade_date = a.trade_date LEFT JOIN f ON f.stock_code = a.stock_code GROUP BY a.trade_date) c ON c.trade_date = g.trade_date
LEFT JOIN (SELECT trade_date, count(*) AS n FROM daily_price ANTI JOIN m USING (stock_code) GROUP BY trade_date) o ON o.trade_date = g.trade_date""",
)

# --- proofs ---------------------------------------------------------------------------------------

_PROOF, _PROOF_SQL = _both(
    """SELECT stock_code, stock_name, exchange, list_date, delist_date, industry, market_type, is_st, '1998-06-30' AS trade_date, CASE WHEN stock_code LIKE '%3.%' THEN 'CURRENT' ELSE 'POINT_IN_TIME_HISTORICAL_SNAPSHOT' END AS source_semantics,
    CASE WHEN stock_code LIKE '%4.%' THEN '1998-07-01' ELSE '1998-06-30' END AS source_snapshot_date, CASE WHEN stock_code LIKE '%5.%' THEN ' ' WHEN stock_code LIKE '%6.%' THEN '../x' WHEN stock_code LIKE '%8.%' THEN 'raw/latest/a' ELSE 'raw/1998/a' END AS source_object_key FROM {stock_basic}""",
    "stock_basic",
)
_simple(
    "v13_snapshot_proofs",
    lambda t: R.snapshot_proof_faults(_PROOF(t), t.stock_basic.withColumn("trade_date", F.lit("1998-06-30")).withColumn("industry", F.when(F.col("stock_code").like("%1.%"), F.lit("other")).otherwise(F.col("industry")))),
    f"SELECT * FROM ({_long([('semantics', 'stock_code LIKE ' + repr('%3.%')), ('snapshot_date', 'stock_code LIKE ' + repr('%4.%')), ('source_key', 'stock_code LIKE ' + repr('%5.%') + ' OR stock_code LIKE ' + repr('%6.%') + ' OR stock_code LIKE ' + repr('%8.%')), ('listed_later', 'list_date > trade_date'), ('delisted', 'delist_date <= trade_date')], f'({_PROOF_SQL}) x')}) y UNION ALL SELECT 'evidence', 2 * count(*) FROM stock_basic WHERE stock_code LIKE '%1.%'",
)
_SPANS, _SPANS_SQL = _both(
    """SELECT stock_code, CASE WHEN source LIKE '%3' THEN 'ST_CURRENT' ELSE st_type END AS st_type, start_date, CASE WHEN source LIKE '%4' THEN start_date ELSE end_date END AS end_date, source, CASE WHEN source LIKE '%5' THEN 'SNAPSHOT' ELSE 'HISTORICAL_INTERVAL_SOURCE' END AS source_semantics, source NOT LIKE '%6' AS coverage_complete,
    CASE WHEN source LIKE '%7' THEN 'x' ELSE 'a, ' || stock_code END AS coverage_codes, CASE WHEN source LIKE '%8' THEN '1999-01-01' ELSE '1995-01-01' END AS coverage_start_date, '2001-12-31' AS coverage_end_date FROM {st_history}""",
    "st_history",
)
_simple(
    "v13_interval_proofs",
    lambda t: R.interval_proof_faults(_SPANS(t), "1995-06-01", "2001-06-30"),
    f"SELECT * FROM ({_long([('semantics', 'source LIKE ' + repr('%5')), ('coverage', 'source LIKE ' + repr('%6')), ('coverage_dates', 'source LIKE ' + repr('%8')), ('coverage_code', 'source LIKE ' + repr('%7')), ('current_source', 'source LIKE ' + repr('%3')), ('interval', 'end_date <= start_date')], f'({_SPANS_SQL}) x')}) y UNION ALL SELECT 'duplicate_keys', 0",
)
_STATE, _STATE_SQL = _both("SELECT stock_code, CASE WHEN announce_date LIKE '%-15' THEN '2009-01-01' ELSE report_period END AS report_period, announce_date, revenue_yoy, net_profit_yoy, CASE WHEN announce_date LIKE '%-16' THEN NULL ELSE roe END AS roe, gross_margin, debt_ratio, operating_cashflow FROM {financial} UNION ALL SELECT * FROM {financial} WHERE announce_date LIKE '1997-03%' AND announce_date NOT LIKE '%-15' AND announce_date NOT LIKE '%-16'", "financial")
_simple(
    "v15_financial_state",
    lambda t: R.financial_state_faults(_STATE(t), DAY),
    f"SELECT * FROM ({_long([('finite', 'roe IS NULL'), ('period_after_announcement', 'report_period > announce_date'), ('announced_later', f'announce_date > ' + repr(DAY))], f'({_STATE_SQL}) x')}) y UNION ALL SELECT 'duplicate_keys', CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM ({_STATE_SQL}) z GROUP BY stock_code, report_period, announce_date) w",
)
_simple(
    "p17b_axis_faults",
    lambda t: R.axis_faults(t.daily_price.where("trade_date <= '1999-12-31'"), t.adj_factor.where("trade_date >= '1996-01-01'"), t.suspend_event.where("trade_date between '1996-01-01' and '2000-06-30'")),
    """WITH s AS (SELECT DISTINCT stock_code, trade_date FROM suspend_event WHERE trade_date BETWEEN '1996-01-01' AND '2000-06-30'), e AS (SELECT stock_code, trade_date FROM daily_price WHERE trade_date <= '1999-12-31'), w AS (SELECT * FROM e ANTI JOIN s USING (stock_code, trade_date)), o AS (SELECT stock_code, trade_date FROM adj_factor WHERE trade_date >= '1996-01-01')
SELECT 'suspension_outside' AS fault, stock_code, trade_date FROM s ANTI JOIN e USING (stock_code, trade_date) UNION ALL SELECT 'missing', stock_code, trade_date FROM w ANTI JOIN o USING (stock_code, trade_date) UNION ALL SELECT 'surplus', stock_code, trade_date FROM o ANTI JOIN w USING (stock_code, trade_date)""",
)
_MASTERS, _MASTERS_SQL = _both("SELECT stock_code, list_date, CASE WHEN stock_code LIKE '%3.%' THEN list_date ELSE delist_date END AS delist_date FROM {stock_basic} UNION ALL SELECT stock_code, CASE WHEN stock_code LIKE '%5.%' THEN '1994-01-01' ELSE list_date END, CASE WHEN stock_code LIKE '%3.%' THEN list_date ELSE delist_date END FROM {stock_basic}", "stock_basic")
_simple(
    "v17_provider_history",
    lambda t: R.history_faults(_MASTERS(t), t.financial, t.st_history, "1996-01-01", "1999-12-31"),
    f"SELECT 'list_date_changes' AS rule, 2 * count(*) AS n FROM stock_basic WHERE stock_code LIKE '%5.%' UNION ALL SELECT 'delist_date_changes', 0 UNION ALL SELECT 'delist_before_list', count(*) FROM ({_MASTERS_SQL}) x WHERE delist_date <= list_date UNION ALL SELECT 'announced_before', count(*) FROM financial WHERE announce_date < '1996-01-01' UNION ALL SELECT 'announced_after', count(*) FROM financial WHERE announce_date > '1999-12-31' UNION ALL SELECT 'st_after_scope', count(*) FROM st_history WHERE start_date > '1999-12-31' UNION ALL SELECT 'st_before_scope', count(*) FROM st_history WHERE end_date <= '1996-01-01'",
)
_simple("p17a_calendar_proof", lambda t: C.calendar_proof(t.trade_cal.unionByName(t.trade_cal.where("cal_date like '1997-03%'")), "1995-06-01", "2001-06-30"), "WITH d AS (SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS cal_date FROM generate_series(TIMESTAMP '1995-06-01', TIMESTAMP '2001-06-30', INTERVAL 1 DAY) s(d)) SELECT (SELECT count(*) FROM d ANTI JOIN trade_cal USING (cal_date)) AS missing, (SELECT count(*) FROM trade_cal WHERE cal_date LIKE '1997-03%') AS repeated, (SELECT count(*) FROM trade_cal ANTI JOIN d USING (cal_date)) AS outside")
_simple("p17c_index_changes", lambda t: quality.index_change_faults(t.benchmark_price.withColumn("pre_close", F.col("open")).withColumn("pct_chg", (F.col("close") / F.col("open") - 1) * 100 + F.when(F.col("trade_date").like("%-15"), 0.01).when(F.col("trade_date").like("%-16"), 0.00005).otherwise(0.0))), "SELECT count(*) AS n FROM benchmark_price WHERE trade_date LIKE '%-15'")
_simple("p17d_pause_agreement", lambda t: C.pause_agreement(t.daily_price, t.suspend_event, False).unionByName(C.pause_agreement(t.daily_price, t.suspend_event, True)), "SELECT count(*) AS n FROM (SELECT stock_code, trade_date FROM daily_price WHERE is_paused) a FULL JOIN (SELECT DISTINCT stock_code, trade_date, true AS e FROM suspend_event) b USING (stock_code, trade_date) FULL JOIN (SELECT stock_code, trade_date, true AS p FROM daily_price WHERE is_paused) c USING (stock_code, trade_date) WHERE e IS NULL OR p IS NULL UNION ALL SELECT count(*) FROM daily_price WHERE is_paused")
_EMPTIES = [("daily_price", 0, False, 0, None, True), ("daily_price", 3, True, 1, 0, False), ("st_history", 3, True, 1, None, True), ("st_history", 3, True, 0, None, False), ("financial", 3, False, 1, None, False), ("stock_basic", 3, True, 1, 0, True), ("stock_basic", 3, True, 1, 2, False)]
_simple(
    "p17e_provable_emptiness",
    lambda t: _values(t, [(i, R.empty_is_proven(d, open_days=o, coverage_complete=c, source_keys=("k",) * k, members=m)) for i, (d, o, c, k, m, _) in enumerate(_EMPTIES)], "case int, proven boolean"),
    "SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(e[-1]).lower()})" for i, e in enumerate(_EMPTIES)) + ") v(\"case\", proven)",
)
_GAP_CASES = [({"truncated": True, "missing": [("a", "d")]}, "SAMPLE_TRUNCATED"), ({"missing_fields": ["x"], "duplicate_rows": 2}, "SCHEMA_MISMATCH"), ({"duplicate_rows": 2}, "DUPLICATE_KEYS_FOUND"), ({"missing": []}, "none"), ({"missing": [("a", "d")], "empty_after_retries": True}, "PROVIDER_EMPTY_AFTER_RETRIES"), ({"missing": [("a", "d")], "dates": ["d", "e"], "codes": ["a"]}, "DATE_ALIGNMENT_GAP"), ({"missing": [("a", "d")], "dates": ["d"], "codes": ["a", "b"]}, "CODE_ALIGNMENT_GAP"), ({"missing": [("a", "d")], "dates": ["d"], "codes": ["a"]}, "MISSING_PROVIDER_ROW")]
_simple("p9_gap_reasons", lambda t: _values(t, [(i, C.gap_reason(item) or "none") for i, (item, _) in enumerate(_GAP_CASES)], "case int, reason string"), "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{r}')" for i, (_, r) in enumerate(_GAP_CASES)) + ") v(\"case\", reason)")


def _contracts(t: Tables) -> DataFrame:
    """Predicates over all levels, modes and a grid of facts."""
    rows = []
    for level in T.LEVELS:
        for full in (True, False):
            fields = T.PRICE_FIELDS if full else T.PRICE_FIELDS - {"is_paused"}
            rows.append((level, full, T.promotable(level, fields), T.usable_in("strict_tradable_required", level, "daily_price", fields), T.usable_in("price_only_diagnostic", level, "benchmark_price"), T.batch_promotion(True, full, ["true_candidate"], True, True, True, level).status, T.suspension_promotion("FULL_EVENT_COVERAGE" if full else "SAMPLE_TRUNCATED", [], True, level).status))
    return _values(t, rows, "level string, full boolean, promotable boolean, strict boolean, diagnostic boolean, batch string, suspension string")


_simple(
    "p19_quality_contracts",
    _contracts,
    """SELECT level, f AS "full", f AND level IN ('DQ3', 'DQ4') AS promotable, f AND level IN ('DQ3', 'DQ4') AS strict, level = 'DQ2' AS diagnostic, CASE WHEN NOT f THEN 'BLOCKED_BY_INCOMPLETE_PROVIDER_COVERAGE' WHEN level IN ('DQ3', 'DQ4') THEN 'READY_FOR_PROMOTION_VALIDATOR' ELSE 'BLOCKED_BY_VALIDATOR' END AS batch,
CASE WHEN NOT f THEN 'BLOCKED_BY_INCOMPLETE_SUSPEND_D_COVERAGE' WHEN level IN ('DQ3', 'DQ4') THEN 'READY_FOR_DQ3_PROMOTION' ELSE 'CANDIDATE_AUDIT_COMPLETED_NOT_PROMOTABLE' END AS suspension FROM (VALUES ('DQ0'), ('DQ1'), ('DQ2'), ('DQ3'), ('DQ4')) v(level), (VALUES (true), (false)) w(f)""",
)


def _lineage(t: Tables) -> DataFrame:
    """Receipts that may be trusted together, and what speaks against others."""
    names = runners.RAW
    version = lambda n: {x: {"checksum": f"{x}-{n}", "scope_rows": 3, "object_rows": 5} for x in names}

    def receipt(dates, codes=("a", "b"), n=1, **more):
        report = {"status": "READY", "blockers": [], "read_back": True, "dates": list(dates), "codes": list(codes), "versions": {d: version(n) for d in dates}} | more
        return report, {"report_checksum": D.stable_hash(report)}

    days = ["2026-01-05", "2026-01-06"]
    first, second = receipt(days[:1]), receipt(days)
    cases = {"fine": [first, second], "uncovered": [first], "codes": [first, receipt(days, ("a",))], "versions": [first, receipt(days, n=2)], "not_ready": [receipt(days, status="BLOCKED")], "checksum": [(second[0], {"report_checksum": "x"})], "other_dates": [second, receipt(["2026-02-02"])], "rows": [receipt(days, versions={d: {x: {"checksum": "c", "scope_rows": 9, "object_rows": 5} for x in names} for d in days})]}
    out = []
    for name, receipts in cases.items():
        try:
            found = runners.trusted_lineage(receipts, days)
            out.append((name, f"{len(found['versions'])} dates"))
        except ValueError as e:
            out.append((name, str(e).split(":")[-1].strip()))
    return _values(t, out, "case string, outcome string")


_simple("p4_trusted_lineage", _lineage, "SELECT * FROM (VALUES ('fine', '2 dates'), ('uncovered', 'no receipt covers 2026-01-06'), ('codes', 'OTHER_CODES'), ('versions', 'receipts name different versions for 2026-01-05'), ('not_ready', 'NOT_READY'), ('checksum', 'CHECKSUM_MISMATCH'), ('other_dates', 'NO_DATE_OF_THE_RANGE'), ('rows', 'MORE_ROWS_THAN_THE_OBJECT')) v(\"case\", outcome)")
