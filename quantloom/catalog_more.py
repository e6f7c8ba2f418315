"""Registered queries over stored datasets, reports, proofs and planted faults, and the same in SQL.

Frames that both sides need, with faults planted in them, are made by one text
that runs unchanged in both engines; what is compared is the operator.
"""

from __future__ import annotations

import json
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import api
from . import catalog_queries as Q
from .catalog_queries import DAY, FROM, KEYS, TO, Tables, _r6, _r6_sql, _simple
from .functions import driver as D
from .functions import scalars as S
from .operators import backtest as B
from .operators import candidate as C
from .operators import clean as K
from .operators import merge as M
from .operators import quality
from .operators import readiness as R
from .operators import scoring
from .plans import backfill, publish, runners
from .plans import backtests as P
from .schemas import FACTORS, SCORES, dataset
from .sources import mock, providers
from .sources.storage import Store, query_parquet, scratch_root


def _table(t: Tables, name: str) -> DataFrame:
    return t.spark.read.parquet(f"{t.sf_dir}/{name}.parquet")


def _both(text: str, *names: str):
    """A frame from a text over datasets, in braces there: (callable over Tables, SQL with plain names)."""
    return lambda t: t.spark.sql(text, **{n: getattr(t, n) for n in names}), text.replace("{", "").replace("}", "")


def _values(t: Tables, rows: list[tuple], schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


def _long(counts: list[tuple[str, str]], table: str, label: str = "rule") -> str:
    """SQL of (label, n): one row for each named condition, counted over a table."""
    return f"SELECT unnest([{', '.join(repr(n) for n, _ in counts)}]) AS {label}, unnest([{', '.join(f'count(*) FILTER ({c})' for _, c in counts)}]) AS n FROM {table}"


# --- stored datasets -----------------------------------------------------------------

_STORES: dict[tuple, str] = {}


def _store(t: Tables) -> Store:
    """Index prices, stored by date once for each session and folder."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _STORES:
        root = scratch_root(t.spark)
        Store(t.spark, root).write(t.benchmark_price, "benchmark_price")
        _STORES[key] = root
    return Store(t.spark, _STORES[key])


_simple("s1_store_read", lambda t: _store(t).read("benchmark_price", DAY), f"SELECT * FROM benchmark_price WHERE trade_date = '{DAY}'")
_simple("s2_store_history", lambda t: _store(t).history("benchmark_price", DAY), f"SELECT * FROM benchmark_price WHERE trade_date <= '{DAY}'")
_simple("s3_store_between", lambda t: _store(t).between("benchmark_price", FROM, TO), f"SELECT * FROM benchmark_price WHERE trade_date BETWEEN '{FROM}' AND '{TO}'")
_simple(
    "s4_days_without_rows_vanish",
    lambda t: _store(t).between("benchmark_price", "1994-06-01", "1996-12-31").groupBy("trade_date").agg(F.count(F.lit(1)).alias("n")),
    "SELECT trade_date, count(*) AS n FROM benchmark_price WHERE trade_date BETWEEN '1994-06-01' AND '1996-12-31' GROUP BY trade_date",
)
_simple(
    "s5_query_parquet",
    lambda t: query_parquet(t.spark, f"{t.sf_dir}/orders.parquet", "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM {dataset} GROUP BY o_orderstatus"),
    "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus",
)
_simple("s6_query_limit", lambda t: query_parquet(t.spark, f"{t.sf_dir}/orders.parquet", "SELECT o_orderkey, o_orderstatus FROM {dataset} ORDER BY o_orderkey, o_orderstatus", 10), "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey, o_orderstatus LIMIT 10")


def _replaced(t):
    """Dates of 1998 written again with one index only: exactly those partitions change."""
    store = Store(t.spark, scratch_root(t.spark))
    store.write(t.benchmark_price, "benchmark_price")
    store.write(t.benchmark_price.where("trade_date like '1998%' and index_code = '000300.SH'").withColumn("close", F.col("close") * 2), "benchmark_price")
    return store.history("benchmark_price", "9999-12-31")


_simple("k6_partition_replace", _replaced, "SELECT * FROM benchmark_price WHERE trade_date NOT LIKE '1998%' UNION ALL SELECT * REPLACE (close * 2 AS close) FROM benchmark_price WHERE trade_date LIKE '1998%' AND index_code = '000300.SH'")


def _published(t: Tables, df: DataFrame, name: str, inputs: dict, mode: str | None = None) -> tuple[publish.Publisher, list[str]]:
    publisher = publish.Publisher(t.spark, scratch_root(t.spark))
    dates = [r[0] for r in t.signals.select("signal_date").orderBy("signal_date").collect()]  # a row a month
    publisher.publish_dates(df, name, dates, inputs, mode)
    return publisher, dates


def _on_signals(t: Tables, df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(t.signals.select(F.col("signal_date").alias("trade_date"))), "trade_date", "left_semi")  # a row a month


def _committed_universe(t):
    publisher, dates = _published(t, _on_signals(t, t.eligible), "eligible_universe", {"run": "x"})
    return publisher.read_dates("eligible_universe", dates)


def _committed_factors(t):
    publisher, dates = _published(t, _on_signals(t, t.factors), "factor_daily", {"run": "x", "run_id": "r1"})
    return _r6(publisher.read_dates("factor_daily", dates, run_id="r1"))


def _committed_selection(t):
    # worked out twice, from the tables: the second time must give the same rows to the last digit
    publisher, dates = _published(t, Q._stored(t).selection, "selection_result", {"weights": scoring.ScoringConfig().weights, "top_n": 20}, "monthly")
    again = publisher.publish_dates(Q._stored(t).selection, "selection_result", dates, {"weights": scoring.ScoringConfig().weights, "top_n": 20}, "monthly")
    assert set(again) == set(publisher.committed("selection_result", "monthly"))
    return _r6(publisher.read_dates("selection_result", dates, "monthly"))


_FD = dataset("factor_daily").names
_SEL = dataset("selection_result").names
_simple("s8_committed_universe", _committed_universe, "SELECT * FROM eligible WHERE trade_date IN (SELECT signal_date FROM signal)")
_simple("s9_committed_factors", _committed_factors, _r6_sql(_FD, "factor", set(FACTORS + SCORES)) + " WHERE trade_date IN (SELECT signal_date FROM signal)")
_simple("s10_committed_selection", _committed_selection, _r6_sql(_SEL, "selection", {*SCORES, "total_score"}))


def _commit_race(t):
    """Create-only: the first contents stay, equal ones are taken for the same, others are refused."""
    publisher = publish.Publisher(t.spark, scratch_root(t.spark))
    day = t.adj_factor.where(F.col("trade_date") == DAY)
    first = publisher.publish(day, "adj_factor", DAY, {"run": 1})
    same = publisher.publish(day.orderBy(F.desc("stock_code")), "adj_factor", DAY, {"run": 1})
    try:
        publisher.publish(day.withColumn("adj_factor", F.col("adj_factor") + 1), "adj_factor", DAY, {"run": 1})
        other = "taken"
    except publish.Conflict:
        other = "refused"
    names = publisher.files.names("commits/adj_factor")
    return _values(t, [(first["rows"], first == same, other, len(names))], "rows long, same boolean, other string, files long")


_simple("k5_create_only_commit", _commit_race, f"SELECT count(*) AS rows, true AS same, 'refused' AS other, CAST(1 AS BIGINT) AS files FROM adj_factor WHERE trade_date = '{DAY}'")


def _landed(t):
    root = scratch_root(t.spark)
    rows = _table(t, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    key = publish.land_raw(t.spark, root, rows, "orders", {"interface": "orders"}, {"complete": True})
    assert key == publish.land_raw(t.spark, root, rows.orderBy(F.desc("o_orderkey")), "orders", {"interface": "orders"}, {"complete": True})
    return t.spark.read.parquet(f"{root}/{key}")


_simple("k7_raw_landing", _landed, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")


def _objects(t):
    writer = publish.AtomicWriter(t.spark, scratch_root(t.spark))
    rows = [(r.r_name, writer.put(f"regions/{r.r_name}.txt", r.r_name.encode())) for r in _table(t, "region").collect()]  # five rows
    left = len(writer.files.names("tmp"))
    return _values(t, [(n, s, left) for n, s in rows], "name string, size long, drafts long")


_simple("k2_atomic_objects", _objects, "SELECT r_name AS name, CAST(length(r_name) AS BIGINT) AS size, CAST(0 AS BIGINT) AS drafts FROM region")


def _sorted_write(t):
    path = scratch_root(t.spark)
    publish.write_sorted(t.adj_factor.repartition(4, "adj_factor"), ["stock_code", "trade_date"], path)
    files = t.spark.read.parquet(path).select(*KEYS, F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
    # place in the file, and files by name: the order in which the rows lie
    from pyspark.sql import Window

    inside = files.withColumn("n", F.row_number().over(Window.partitionBy("f").orderBy("i")))
    sizes = inside.groupBy("f").agg(F.count(F.lit(1)).alias("c"))
    starts = sizes.withColumn("s", F.coalesce(F.sum("c").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a file
    return inside.join(F.broadcast(starts), "f").select(*KEYS, (F.col("n") + F.col("s")).alias("place"))


_simple("o3_canonical_sort", _sorted_write, "SELECT stock_code, trade_date, row_number() OVER (ORDER BY stock_code, trade_date) AS place FROM adj_factor")

# keyed tables: summaries, logs, streams
_LOG = "SELECT CAST(CAST(o_orderdate AS DATE) AS {text}) AS trade_date, o_orderpriority AS step_name, max(o_orderkey) AS seq, max(o_orderstatus) AS status FROM {orders} WHERE {where} GROUP BY 1, 2"


def _log_rows(t, where: str) -> DataFrame:
    return t.spark.sql(_LOG.replace("{text}", "STRING").replace("{where}", where), orders=_table(t, "orders"))


def _update_log(t):
    table = publish.PointerTable(t.spark, scratch_root(t.spark), by="step_name")
    keys, order = ["trade_date", "step_name"], ["seq", "status"]
    for n, where in enumerate(("o_orderstatus <> 'F'", "o_orderstatus = 'F'")):
        table.merge(_log_rows(t, where), keys, order, f"v{n}")
    table.merge(_log_rows(t, "o_orderstatus = 'O'"), keys, order, "v1")  # a version that stands is not written again
    return table.read(_log_rows(t, "true").schema)


_LOG_SQL = lambda where: _LOG.replace("{text}", "VARCHAR").replace("{orders}", "orders").replace("{where}", where)
_simple("k10_update_log", _update_log, f"SELECT * FROM ({_LOG_SQL(chr(111) + '_orderstatus <> ' + repr('F'))}) a ANTI JOIN ({_LOG_SQL('o_orderstatus = ' + repr('F'))}) b USING (trade_date, step_name) UNION ALL {_LOG_SQL('o_orderstatus = ' + repr('F'))}")
_simple("r5_update_logs", lambda t: api.update_logs(_log_rows(t, "true"), "1997-03-03"), f"SELECT * FROM ({_LOG_SQL('true')}) x WHERE trade_date = '1997-03-03' ORDER BY step_name")


def _summaries(t):
    table = publish.PointerTable(t.spark, scratch_root(t.spark))
    rows = Q._snap(Q._stored(t)).select("trade_date", "rebalance_mode", "stock_count")
    table.upsert(rows, ["trade_date", "rebalance_mode"])
    table.upsert(rows.where("trade_date like '1998%'").withColumn("stock_count", F.col("stock_count") + 100), ["trade_date", "rebalance_mode"])
    return table.read(rows.schema)


_simple("k9_summary_upsert", _summaries, f"SELECT trade_date, rebalance_mode, CASE WHEN trade_date LIKE '1998%' THEN stock_count + 100 ELSE stock_count END AS stock_count FROM ({Q._SNAP}) x")
_simple(
    "k13_newest_by_key",
    lambda t: publish.newest_by_key(_table(t, "orders").select("o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderkey"), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]),
    "SELECT o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS nth FROM orders) x WHERE nth = 1",
)


def _streamed(t):
    """Two streams, each with a checkpoint of its own, into one table; the second brings later states of some keys."""
    from .streaming import upsert_stream

    root = scratch_root(t.spark)
    rows = _table(t, "orders").groupBy("o_orderkey").agg(F.max("o_totalprice").alias("price"), F.max("o_orderpriority").alias("kind")).withColumn("state", F.lit(1))
    rows.write.parquet(f"{root}/in1")
    rows.where("o_orderkey % 3 = 0").withColumn("state", F.lit(2)).unionByName(rows.where("o_orderkey % 5 = 0 and o_orderkey > 0").withColumn("o_orderkey", -F.col("o_orderkey"))).write.parquet(f"{root}/in2")
    for n in (1, 2):
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{root}/in{n}")
        upsert_stream(stream, f"{root}/table", ["o_orderkey", "kind"], ["state"], f"{root}/check{n}", by="kind").awaitTermination()
    return publish.PointerTable(t.spark, f"{root}/table", "kind").read(rows.schema)


_ORD = "(SELECT o_orderkey, max(o_totalprice) AS price, max(o_orderpriority) AS kind FROM orders GROUP BY o_orderkey)"
_simple("k_stream_upsert", _streamed, f"SELECT o_orderkey, price, kind, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS state FROM {_ORD} x UNION ALL SELECT -o_orderkey, price, kind, CAST(1 AS INTEGER) FROM {_ORD} y WHERE o_orderkey % 5 = 0 AND o_orderkey > 0")


# --- sources ----------------------------------------------------------------------------

_MOCK_DAY = "2026-06-19"
_MOCK = """(SELECT i, ['000001.SZ', '000002.SZ', '600000.SH', '600519.SH', '300750.SZ'][i + 1] AS stock_code, 10e0 + 8 * i AS pre, round((10e0 + 8 * i) * (1.01e0 + 0.002e0 * i), 2) AS c,
  round((10e0 + 8 * i) * (1.005e0 + 0.001e0 * i), 2) AS o, 1000000 + 120000 * i AS v FROM range(5) r(i))"""
_MOCK_PRICES = f"""SELECT stock_code, '{_MOCK_DAY}' AS trade_date, o AS open, round(greatest(o, c) * 1.02e0, 2) AS high, round(least(o, c) * 0.98e0, 2) AS low, c AS close, pre AS pre_close, CAST(v AS DOUBLE) AS volume,
  v * c AS amount, round((c / pre - 1) * 100, 4) AS pct_chg, false AS is_paused, round(pre * 1.1e0, 2) AS limit_up, round(pre * 0.9e0, 2) AS limit_down FROM {_MOCK} m"""
_simple("s11_mock_prices", lambda t: mock.frame(t.spark, "daily_price", [_MOCK_DAY]), _MOCK_PRICES)
_simple("s11_mock_factors", lambda t: mock.frame(t.spark, "adj_factor", [_MOCK_DAY]), f"SELECT stock_code, '{_MOCK_DAY}' AS trade_date, 1 + 0.01e0 * i AS adj_factor FROM {_MOCK} m")
_simple("f12_provider_mapping", lambda t: providers.map_frame(t.spark, providers.make_provider("mock").fetch("daily_price", _MOCK_DAY), "daily_price"), _MOCK_PRICES)


def _pages(t):
    keys = _table(t, "orders").select(F.col("o_orderkey").alias("k")).distinct().orderBy("k").toLocalIterator(prefetchPartitions=True)  # what a provider would send, a part at a time
    rows, proof = providers.land_all_pages(t.spark, lambda at, n: [{"k": r[0]} for r in islice(keys, n)], ["k"], "k long", f"{scratch_root(t.spark)}/pages", size=1000)
    return rows.select(F.col("k").alias("o_orderkey"), F.lit(proof.pages).cast("long").alias("pages"), F.lit(proof.complete).alias("complete"))


_simple("s15_all_pages", _pages, "SELECT DISTINCT o_orderkey, (SELECT count(DISTINCT o_orderkey) // 1000 + 1 FROM orders) AS pages, true AS complete FROM orders")


def _retries(t):
    out = []
    for fails, permanent in ((0, False), (2, False), (3, False), (1, True)):
        tries = []

        def call(fails=fails, permanent=permanent, tries=tries):
            tries.append(1)
            if len(tries) <= fails:
                raise PermissionError("no") if permanent else OSError("later")
            return "ok"

        try:
            got = providers.retry(call, sleep=lambda s: None)
        except (OSError, PermissionError) as e:
            got = type(e).__name__
        out.append((fails, permanent, got, len(tries)))
    for name in ("mock", "tushare", "other"):
        try:
            got = type(providers.make_provider(name)).__name__
        except (ValueError, providers.CapabilityError) as e:
            got = type(e).__name__
        out.append((0, False, f"{name}:{got}", 0))
    return _values(t, out, "fails int, permanent boolean, outcome string, tries int")


_simple("s16_retry_and_factory", _retries, "SELECT * FROM (VALUES (0, false, 'ok', 1), (2, false, 'ok', 3), (3, false, 'OSError', 3), (1, true, 'PermissionError', 1), (0, false, 'mock:MockProvider', 0), (0, false, 'tushare:CapabilityError', 0), (0, false, 'other:ValueError', 0)) v(fails, permanent, outcome, tries)")
_simple(
    "s17_probe",
    lambda t: _values(t, [(r["dataset"], r["reachable"], r["rows"], ",".join(r["missing"]), r["level"]) for r in providers.probe(providers.make_provider("mock"), {"daily_price": ["close", "limit_up", "halted"], "adj_factor": ["adj_factor"], "nothing": ["x"]}, _MOCK_DAY)], "dataset string, reachable boolean, rows long, missing string, level string"),
    "SELECT * FROM (VALUES ('daily_price', true, CAST(5 AS BIGINT), 'halted', 'DQ1'), ('adj_factor', true, CAST(5 AS BIGINT), '', 'DQ1'), ('nothing', false, CAST(0 AS BIGINT), 'x', 'DQ0')) v(dataset, reachable, rows, missing, level)",
)


def _sql_source(t):
    Q._runs(t).createOrReplaceTempView("backtest_summary")
    return api.sql_rows(t.spark, "backtest_summary", {"status": "done", "rebalance_mode": "monthly"}, ["created_at", "run_key"], 20, 10).select("run_key", "status", "created_at")


_simple("s18_sql_source", _sql_source, f"SELECT run_key, status, created_at FROM ({Q._RUNS}) x WHERE status = 'done' AND rebalance_mode = 'monthly' ORDER BY created_at DESC, run_key DESC LIMIT 20 OFFSET 10")


def _settings(t):
    from .settings import parse, scoring_config

    text = "risk:\n  min_listed_days: 180  # days\n  min_amount: 5e7\nnames:\n  title: 'a # b'\n  flag: true\nweights:\n  quality: 0.5\n  growth: 0.5\n  valuation: 0\n  industry: 0\n  trend: 0\ntop_n: 7\n"
    found = parse(text)
    config = scoring_config(found)
    rows = [("min_listed_days", str(found["risk"]["min_listed_days"])), ("min_amount", str(found["risk"]["min_amount"])), ("title", found["names"]["title"]), ("flag", str(found["names"]["flag"])), ("quality", str(config.weights["quality_score"])), ("top_n", str(config.top_n))]
    return _values(t, rows, "name string, value string")


_simple("s19_settings", _settings, "SELECT * FROM (VALUES ('min_listed_days', '180'), ('min_amount', '50000000.0'), ('title', 'a # b'), ('flag', 'True'), ('quality', '0.5'), ('top_n', '7')) v(name, value)")

# --- filters, joins, windows ---------------------------------------------------------------

_CODES, _DAYS = ["000001.SH", "000010.SH", "000055.SH"], ["1997-03-03", "1998-06-30", "1999-12-30"]
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_simple("f9_scope", lambda t: C.scope(t.daily_price, _CODES, None).unionByName(C.scope(t.daily_price, None, _DAYS)).unionByName(C.scope(t.daily_price, _CODES, _DAYS)), f"SELECT * FROM daily_price WHERE stock_code IN {_IN(_CODES)} UNION ALL SELECT * FROM daily_price WHERE trade_date IN {_IN(_DAYS)} UNION ALL SELECT * FROM daily_price WHERE stock_code IN {_IN(_CODES)} AND trade_date IN {_IN(_DAYS)}")
_simple(
    "f11_alias_projection",
    lambda t: C.project_aliases(_table(t, "supplier"), {"id": ["code", "s_suppkey"], "label": ["s_name", "name"], "none": ["missing"], "extra": ["absent"]}, frozenset({"extra"})).withColumn("none", F.col("none").cast("string")),
    "SELECT s_suppkey AS id, s_name AS label, CAST(NULL AS VARCHAR) AS none FROM supplier",
)
_simple(
    "j10_limits_and_pauses",
    lambda t: R.paused_by_event(C.limits_one_to_one(t.daily_price.select(*KEYS, "close"), t.daily_price.select(*KEYS, "limit_up", "limit_down")), t.suspend_event),
    "SELECT p.stock_code, p.trade_date, close, limit_up, limit_down, e.stock_code IS NOT NULL AS is_paused FROM daily_price p LEFT JOIN (SELECT DISTINCT stock_code, trade_date FROM suspend_event) e USING (stock_code, trade_date)",
)
_simple("j16_limit_join", lambda t: C.limits_one_to_one(t.daily_price.select(*KEYS, "volume"), t.daily_price.select(*KEYS, "limit_up", "limit_down")), "SELECT stock_code, trade_date, volume, limit_up, limit_down FROM daily_price")
_simple(
    "j8b_dry_run",
    lambda t: R.dry_run_candidate(t.daily_price.select(*KEYS, "close"), t.daily_price, t.adj_factor, t.daily_basic, t.trade_cal.where("cal_date < '1999-01-01'")),
    "SELECT p.stock_code, p.trade_date, close, limit_up, limit_down, adj_factor, pe_ttm, pb, turnover_rate, p.trade_date < '1999-01-01' AS is_open, CAST(NULL AS BOOLEAN) AS is_paused FROM daily_price p LEFT JOIN adj_factor USING (stock_code, trade_date) LEFT JOIN daily_basic USING (stock_code, trade_date)",
)
_simple(
    "j8b_suspension_candidate",
    lambda t: R.suspension_candidate(t.daily_price, t.suspend_event),
    "SELECT p.stock_code, p.trade_date, suspend_type, CASE WHEN suspend_type IS NULL THEN 'unknown' ELSE 'true_candidate' END AS pause_status, CASE WHEN suspend_type IS NULL THEN 'unresolved_no_event_match' ELSE 'suspend_d_match' END AS evidence FROM daily_price p LEFT JOIN suspend_event USING (stock_code, trade_date)",
)
_WINDOWS = [("1995-01-01", "1997-06-30", 0), ("1997-04-01", "1999-03-31", 1), ("1998-12-01", "2002-01-01", 2)]
_simple(
    "j9_carry_chain",
    lambda t: K.carry_chain([t.financial.where(F.col("announce_date").between(a, b)).withColumn("roe", F.col("roe") + n) for a, b, n in _WINDOWS]),
    "SELECT * EXCLUDE (nth, seq) FROM (SELECT *, row_number() OVER (PARTITION BY stock_code, report_period, announce_date ORDER BY seq DESC) AS nth FROM (" + " UNION ALL ".join(f"SELECT * REPLACE (roe + {n} AS roe), {n} AS seq FROM financial WHERE announce_date BETWEEN '{a}' AND '{b}'" for a, b, n in _WINDOWS) + ") x) y WHERE nth = 1",
)
_simple("w12_previous_close", lambda t: C.previous_close_change(t.benchmark_price, "index_code", DAY), f"SELECT index_code, (c / p - 1) * 100 AS pct_chg FROM (SELECT index_code, arg_max(close, trade_date) FILTER (trade_date < '{DAY}') AS p, max(close) FILTER (trade_date = '{DAY}') AS c FROM benchmark_price GROUP BY index_code) x WHERE c IS NOT NULL")
_simple("w14_date_windows", lambda t: _values(t, D.date_windows("1995-01-01", "2001-12-31", 31), "first string, last string"), "SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS first, CAST(CAST(least(d + INTERVAL 30 DAY, TIMESTAMP '2001-12-31') AS DATE) AS VARCHAR) AS last FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 31 DAY) s(d)")
_simple("a9_index_coverage", lambda t: quality.index_coverage(t.benchmark_price, "1995-08-31"), "SELECT i AS index_code, count(trade_date) AS index_rows, min(trade_date) AS first_day, count(trade_date) < 121 AS short FROM (VALUES ('000300.SH'), ('000905.SH'), ('000906.SH')) v(i) LEFT JOIN benchmark_price ON index_code = i AND trade_date <= '1995-08-31' GROUP BY i")
_COVER = Q._QUERIES["a9_history_coverage"][1]
_simple(
    "a9_history_minima",
    lambda t: quality.history_minima(quality.history_coverage(t.adjusted, t.snapshot, DAY)),
    f"SELECT min(price_rows) AS least_price_rows, min(valuation_rows) AS least_valuation_rows, max(first_price) AS latest_first_price, count(*) FILTER (short_trend) AS short_trend, count(*) FILTER (short_valuation) AS short_valuation FROM ({_COVER}) z",
)
_simple("a12_required_indexes", lambda t: B.index_returns(t.benchmark_price, FROM, TO, tuple(quality.INDEXES)), f"SELECT index_code, arg_max(close, trade_date) / arg_min(close, trade_date) - 1 AS index_return FROM benchmark_price WHERE trade_date BETWEEN '{FROM}' AND '{TO}' GROUP BY index_code")
_simple("a15_duplicate_examples", lambda t: quality.duplicate_examples(_table(t, "lineitem"), ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 5")
_simple("u8_history_concat", lambda t: M.concat_history([t.adj_factor.where("trade_date < '1997-01-01'"), t.adj_factor.where("trade_date >= '1997-01-01' and trade_date <= '1998-06-30'")], DAY, KEYS), f"SELECT * FROM adj_factor WHERE trade_date <= '{DAY}'")


def _guards(t):
    out = []
    for name, frames in (("late", [t.adj_factor]), ("twice", [t.adj_factor.where("trade_date < '1997-01-01'")] * 2), ("fine", [t.adj_factor.where("trade_date < '1997-01-01'")])):
        try:
            M.concat_history(frames, DAY, KEYS)
            out.append((name, "ok"))
        except ValueError as e:
            out.append((name, "late" if "after" in str(e) else "repeated"))
    return _values(t, out, "case string, outcome string")


_simple("u8_history_guards", _guards, "SELECT * FROM (VALUES ('late', 'late'), ('twice', 'repeated'), ('fine', 'ok')) v(\"case\", outcome)")


def _checksums(t):
    a = t.adj_factor
    one, two, three = M.fingerprint(a), M.fingerprint(a.repartition(5, "trade_date").select("adj_factor", "trade_date", "stock_code")), M.fingerprint(a.withColumn("adj_factor", F.when(F.col("trade_date") == DAY, F.col("adj_factor") + 1e-9).otherwise(F.col("adj_factor"))))
    by = M.fingerprints(a, "trade_date")
    return _values(t, [(one[0], one == two, one == three, len(by), sum(n for n, _ in by.values()))], "rows long, same boolean, changed_same boolean, dates long, rows_by_date long")


_simple("a19_checksum", _checksums, "SELECT count(*) AS rows, true AS same, false AS changed_same, count(DISTINCT trade_date) AS dates, count(*) AS rows_by_date FROM adj_factor")
_FOLDS = [("COMPLETED,COMPLETED", "COMPLETED"), ("COMPLETED,DATABASE_PENDING", "DATABASE_PENDING"), ("COMPLETED,BLOCKED", "PARTIAL"), ("BLOCKED,FAILED", "FAILED"), ("BLOCKED,BLOCKED", "BLOCKED"), ("READY_FOR_APPLY,FAILED", "PARTIAL"), ("", "BLOCKED")]
_simple("a20_status_fold", lambda t: _values(t, [(s, runners.fold_status([x for x in s.split(",") if x])) for s, _ in _FOLDS], "states string, status string"), f"SELECT * FROM (VALUES {', '.join(map(str, _FOLDS))}) v(states, status)")


def _conservation(t):
    files, chunks = publish.Files(t.spark, scratch_root(t.spark)), backfill.plan("1997-01-01", "1997-03-31", 10)
    first = next(c for c in chunks if c.dataset == "financial")

    def work(c):
        if c == first:
            raise backfill.BackfillFailure("RATE_LIMITED")
        return {}

    found = backfill.execute(files, "r", chunks, work)
    return _values(t, [(d, s, n) for d, states in found["by_dataset"].items() for s, n in states.items()], "dataset string, state string, n long")


_simple("a17_state_conservation", _conservation, "SELECT d AS dataset, s AS state, CAST(n AS BIGINT) AS n FROM (VALUES ('daily_price', 'COMPLETED', 3), ('adj_factor', 'COMPLETED', 3), ('daily_basic', 'COMPLETED', 3), ('benchmark_price', 'COMPLETED', 3), ('stock_basic', 'COMPLETED', 1), ('st_history', 'COMPLETED', 1), ('financial', 'FAILED', 1), ('financial', 'BLOCKED', 2)) v(d, s, n)")
_simple(
    "p15_backfill_plan",
    lambda t: _values(t, [(c.dataset, c.start, c.end, c.after is not None) for c in backfill.plan("1995-01-01", "2001-12-31", 100)], "dataset string, first string, last string, chained boolean"),
    """WITH w AS (SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS first, CAST(CAST(least(d + INTERVAL 30 DAY, TIMESTAMP '2001-12-31') AS DATE) AS VARCHAR) AS last FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 31 DAY) s(d))
SELECT dataset, first, last, false AS chained FROM (VALUES ('daily_price'), ('adj_factor'), ('daily_basic'), ('benchmark_price')) v(dataset), w UNION ALL SELECT dataset, '1995-01-01', '2001-12-31', false FROM (VALUES ('stock_basic'), ('st_history')) v(dataset) UNION ALL SELECT 'financial', first, last, first > '1995-01-01' FROM w""",
)
_simple("p18_failures", lambda t: _values(t, [(c, c in backfill.RETRYABLE) for c in backfill.FAILURES], "category string, retryable boolean"), "SELECT unnest(['EMPTY_RESULT', 'RATE_LIMITED', 'PERMISSION_DENIED', 'SCHEMA_DRIFT', 'TRANSIENT_PROVIDER_ERROR', 'CONFIGURATION_ERROR', 'SEMANTIC_SOURCE_UNAVAILABLE', 'DQ_FAILED', 'WRITE_FAILED', 'READBACK_FAILED', 'INTERRUPTED', 'UNKNOWN']) AS category, unnest([false, true, false, false, true, false, false, false, true, true, false, true]) AS retryable")

# --- scalars and small functions --------------------------------------------------------------

_simple("m10_forbidden_words", lambda t: _texts(t).agg(F.count_if(S.has_forbidden_word("x")).alias("n"), F.count(F.lit(1)).alias("rows")), "SELECT count(*) FILTER (regexp_matches(x, '" + "|".join(S.FORBIDDEN_WORDS) + "')) AS n, count(*) AS rows FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'a' || ['" + "', '".join(S.FORBIDDEN_WORDS) + f"'][1 + o_orderkey % {len(S.FORBIDDEN_WORDS)}] || 'b' ELSE '观察' || CAST(o_orderkey AS VARCHAR) END AS x FROM orders) y")


def _texts(t):
    word = F.get(F.array(*[F.lit(w) for w in S.FORBIDDEN_WORDS]), (F.col("o_orderkey") % len(S.FORBIDDEN_WORDS)).cast("int"))
    return _table(t, "orders").select(F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("a"), word, F.lit("b"))).otherwise(F.concat(F.lit("观察"), F.col("o_orderkey").cast("string"))).alias("x"))


_TOKENS = ["1", " TRUE", "Yes ", "y", "0", "false", "NO", "n"]
_simple("m13_booleans", lambda t: _table(t, "orders").select("o_orderkey", S.to_bool(F.get(F.array(*[F.lit(x) for x in _TOKENS]), (F.col("o_orderkey") % 8).cast("int"))).alias("flag")), "SELECT o_orderkey, o_orderkey % 8 < 4 AS flag FROM orders")
_simple("m19_stable_hash", lambda t: _values(t, [(r.r_name, D.stable_hash({"name": r.r_name, "key": int(r.r_regionkey)})) for r in _table(t, "region").collect()], "name string, hash string"), "SELECT r_name AS name, sha256('{\"key\":' || CAST(r_regionkey AS VARCHAR) || ',\"name\":\"' || r_name || '\"}') AS hash FROM region")
_SECRETS = [("token=abc rest", "token=*** rest"), ("password: 'a b' x", "password: *** x"), ('{"api_key": "k1", "n": 2}', '{"api_key": ***, "n": 2}'), ("Authorization: Bearer xyz.1; ok", "Authorization: Bearer ***; ok"), ("nothing here", "nothing here"), ("x" * 600, "x" * 500)]
_simple("m20_redaction", lambda t: _values(t, [(a, D.redact(a)) for a, _ in _SECRETS], "raw string, shown string"), "SELECT * FROM (VALUES " + ", ".join("('" + a.replace("'", "''") + "', '" + b.replace("'", "''") + "')" for a, b in _SECRETS) + ") v(raw, shown)")
_KEYS = ["a/b.json", "/a", "a/../b", "a\\b", "a//b", "", "./a", "a/"]


def _safe(key: str) -> bool:
    try:
        return D.check_key(key) == key
    except ValueError:
        return False


_simple("k12_key_safety", lambda t: _values(t, [(k, _safe(k)) for k in _KEYS], "key string, safe boolean"), "SELECT k AS key, k = 'a/b.json' AS safe FROM (VALUES " + ", ".join(f"('{k}')" for k in _KEYS) + ") v(k)")


def _api_errors(t):
    rows = Q._snap(t)
    calls = {"limit": lambda: api.selections(rows, 0), "offset": lambda: api.selections(rows, 1, -1), "date": lambda: api.selection(rows, "1998-6-30"), "run_key": lambda: api.backtest(rows, "XYZ"), "fine": lambda: api.selections(rows, 100, 0)}
    out = []
    for name, call in calls.items():
        try:
            call()
            out.append((name, "OK"))
        except api.ApiError as e:
            out.append((name, e.code))
    return _values(t, out, "call string, code string")


_simple("r8_parameter_errors", _api_errors, "SELECT * FROM (VALUES ('limit', 'INVALID_LIMIT'), ('offset', 'INVALID_OFFSET'), ('date', 'INVALID_DATE'), ('run_key', 'INVALID_RUN_KEY'), ('fine', 'OK')) v(call, code)")

# --- backtests ------------------------------------------------------------------------------------

_CONFIG = B.BacktestConfig("core", FROM, TO, "monthly", top_n=5)
_CONFIG_JSON = json.dumps({"commission_rate": 0.0003, "end_date": TO, "execution_rule": "next_open", "initial_cash": 100000.0, "rebalance_mode": "monthly", "slippage_bps": 10.0, "stamp_tax_rate": 0.0005, "start_date": FROM, "strategy_name": "core", "top_n": 5}, sort_keys=True, separators=(",", ":"))
_simple("b6_run_key", lambda t: _values(t, [(_CONFIG.run_key(),)], "run_key string"), f"SELECT substr(sha256('{_CONFIG_JSON}'), 1, 16) AS run_key")


def _idempotent(t):
    root = scratch_root(t.spark)
    selection, prices = Q._stored(t).selection, B.backtest_prices(t.adjusted, t.daily_price)
    states = [P.run_backtest(t.spark, root, selection, prices, t.benchmark_price, _CONFIG, force) for force in (False, False, True)]
    found = publish.PointerTable(t.spark, f"{root}/backtest/summary").read("run_key string, strategy_name string, status string, rebalance_mode string, metrics string, config string")
    days = P.read_detail(t.spark, root).where("record_type = 'portfolio'").agg(F.count(F.lit(1)).alias("days"))
    return found.select("run_key", "strategy_name", "status", "rebalance_mode").withColumn("states", F.lit(",".join(states))).join(F.broadcast(days), F.lit(True))


_simple("b7_idempotent_run", _idempotent, f"SELECT substr(sha256('{_CONFIG_JSON}'), 1, 16) AS run_key, 'core' AS strategy_name, 'done' AS status, 'monthly' AS rebalance_mode, 'done,skipped,done' AS states, (SELECT count(DISTINCT trade_date) FROM adjusted WHERE trade_date BETWEEN '{FROM}' AND '{TO}') AS days")


def _rule_error(t):
    try:
        B.simulate(t.selection, t.daily_price, [B.BacktestConfig("x", FROM, TO, execution_rule="close")])
        return _values(t, [("ran",)], "outcome string")
    except ValueError:
        return _values(t, [("refused",)], "outcome string")


_simple("b8_execution_rule", _rule_error, "SELECT 'refused' AS outcome")



# --- connectors over recorded answers ---------------------------------------------------------


class _Recorded:
    """A package's client that answers from the tables: index bars, stock bars, endpoints."""

    error_code, error_msg = "0", ""

    def __init__(self, t: Tables):
        #: The last day up to DAY on which all indexes have a bar.
        self.on = t.benchmark_price.where(F.col("trade_date") <= DAY).agg(F.max("trade_date")).first()[0]
        self.bars = [r.asDict() for r in t.benchmark_price.where(F.col("trade_date") <= self.on).select("index_code", F.col("trade_date").alias("date"), "open", "high", "low", "close").collect()]  # what a provider would send
        self.day = [r.asDict() for r in t.daily_price.where(F.col("trade_date") == self.on).orderBy("stock_code").collect()]
        self.calls: list[str] = []

    def stock_zh_index_daily(self, symbol):
        return [r for r in self.bars if r["index_code"][:6] == symbol[2:]]

    def stock_zh_a_hist(self, symbol, **_):
        r = self.day[0]
        return [{"日期": r["trade_date"], "开盘": r["open"], "最高": r["high"], "最低": r["low"], "收盘": r["close"], "成交量": r["volume"], "成交额": r["amount"], "涨跌幅": r["pct_chg"]}]

    def login(self):
        self.calls.append("login")
        return self

    def logout(self):
        self.calls.append("logout")

    def query_history_k_data_plus(self, symbol, fields, **_):
        self.fields, r = fields.split(","), self.day[0]
        self.left = [[r["trade_date"], symbol, *(str(r[c]) for c in ("open", "high", "low", "close", "pre_close", "volume", "amount", "pct_chg"))]]
        return self

    def next(self):
        return bool(self.left)

    def get_row_data(self):
        return self.left.pop()

    def adj_factor(self, **_):
        self.calls.append("adj_factor")
        if len(self.calls) < 3:
            raise OSError("later")
        return [{"ts_code": r["stock_code"], "trade_date": r["trade_date"].replace("-", ""), "adj_factor": 1.5} for r in self.day]

    def suspend_d(self, offset, limit, **_):
        return [{"ts_code": r["stock_code"], "trade_date": self.on.replace("-", "")} for r in self.day[offset : offset + limit]]

    def daily_basic(self, **_):
        raise RuntimeError("抱歉，您没有访问该接口的权限")


def _akshare(t):
    from .sources.connectors import SMOKE, AkshareConnector

    client = _Recorded(t)
    source = AkshareConnector(client)
    rows = [(r["index_code"], r["trade_date"], r["close"], r["pct_chg"]) for r in source.fetch("benchmark_price", client.on)]
    rows += [(r["source_symbol"], r["trade_date"], r["close"], r["pct_chg"]) for r in source.fetch(SMOKE, client.on)]
    return _values(t, rows, "code string, trade_date string, close double, pct_chg double")


def _baostock(t):
    from .sources.connectors import SMOKE, BaostockConnector

    client = _Recorded(t)
    rows = BaostockConnector(client).fetch(SMOKE, client.on)
    return _values(t, [(r["stock_code"], r["open"], r["volume"], r["pct_chg"], ",".join(client.calls)) for r in rows], "code string, open double, volume double, pct_chg double, calls string")


def _tushare(t):
    from .sources.connectors import TushareConnector

    client = _Recorded(t)
    source = TushareConnector(client, sleep=lambda s: None)
    factors = providers.map_frame(t.spark, source.fetch("adj_factor", client.on), "adj_factor")
    events, proof = source.events(client.on, size=3)
    refused = 0
    for name in ("daily_basic", "financial"):
        try:
            source.fetch(name, client.on)
        except providers.CapabilityError:
            refused += 1
    return factors.withColumns({"events": F.lit(len(events)), "complete": F.lit(proof.complete), "refused": F.lit(refused), "tries": F.lit(len(client.calls))})


_LAST = f"(SELECT max(trade_date) FROM benchmark_price WHERE trade_date <= '{DAY}')"
_FIRST = f"(SELECT * FROM daily_price WHERE trade_date = {_LAST} ORDER BY stock_code LIMIT 1)"
_simple(
    "s12_akshare",
    _akshare,
    f"SELECT index_code AS code, d AS trade_date, c AS close, (c / p - 1) * 100 AS pct_chg FROM (SELECT index_code, max(trade_date) AS d, arg_max(close, trade_date) AS c, arg_max(close, trade_date) FILTER (trade_date < {_LAST}) AS p FROM benchmark_price WHERE trade_date <= '{DAY}' GROUP BY index_code) x UNION ALL SELECT '000001', trade_date, close, pct_chg FROM {_FIRST} y",
)
_simple("s13_baostock", _baostock, f"SELECT '000001.SZ' AS code, open, volume, pct_chg, 'login,logout' AS calls FROM {_FIRST} x")
_simple("s14_tushare", _tushare, f"SELECT stock_code, trade_date, 1.5e0 AS adj_factor, CAST(count(*) OVER () AS INTEGER) AS events, true AS complete, CAST(2 AS INTEGER) AS refused, CAST(3 AS INTEGER) AS tries FROM daily_price WHERE trade_date = {_LAST}")
