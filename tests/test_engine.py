"""Operators of the factor engine on small fixtures with known results."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quantloom import api, schemas
from quantloom.functions import driver as D
from quantloom.functions import scalars as S
from quantloom.operators import backtest, candidate, clean, factors, merge, quality, scoring, universe
from quantloom.plans import backfill, publish, runners
from quantloom.sources import mock, providers
from quantloom.sources.storage import Store, stock_prices

DAY = "2026-06-19"
FIN = "stock_code string, report_period string, announce_date string, revenue_yoy double, net_profit_yoy double, roe double, gross_margin double, debt_ratio double, operating_cashflow double"


def market(spark, days=(DAY,)):
    return {n: mock.frame(spark, n, list(days)) for n in ("stock_basic", "daily_price", "adj_factor", "daily_basic", "financial", "st_history", "benchmark_price")}


def test_adjusted_price_drops_rows_without_a_factor(spark):
    m = market(spark)
    got = {r.stock_code: r.adj_close for r in clean.adjusted_price(m["daily_price"], m["adj_factor"].where("stock_code <> '600519.SH'")).collect()}
    assert "600519.SH" not in got and got["000002.SZ"] == pytest.approx(mock._price("x", 1, DAY)["close"] * 1.01)


def test_financial_as_of_sees_no_future(spark):
    rows = [("000001.SZ", "2025-12-31", "2026-04-30", 0.01, 0.02, 0.03, 0.2, 0.4, 100.0), ("000001.SZ", "2026-03-31", "2026-06-18", 0.11, 0.12, 0.13, 0.3, 0.5, 200.0), ("000001.SZ", "2026-06-30", "2026-06-20", 9.0, 9.0, 9.0, 9.0, 0.9, 900.0)]
    base = spark.createDataFrame([("000001.SZ", DAY)], "stock_code string, trade_date string")
    fin = spark.createDataFrame(rows, FIN)
    assert clean.financial_as_of(base, fin).first().roe == 0.13
    late = clean.financial_as_of(base, fin.where("roe > 1")).first()
    assert late.stock_code == "000001.SZ" and late.roe is None


def test_st_interval_ends_are_exclusive(spark):
    st = spark.createDataFrame([("000001.SZ", "ST", "2026-01-01", DAY, "u"), ("000002.SZ", "ST", "2026-01-01", None, "u")], "stock_code string, st_type string, start_date string, end_date string, source string")
    base = spark.createDataFrame([(c, DAY) for c in ("000001.SZ", "000002.SZ", "600000.SH")], "stock_code string, trade_date string")
    assert {r.stock_code: r.is_st_on_date for r in clean.st_flags(base, st).collect()} == {"000001.SZ": False, "000002.SZ": True, "600000.SH": False}


def test_risk_reasons(spark):
    cols = "stock_code string, trade_date string, is_st_on_date boolean, is_paused boolean, listed_days long, amount double, roe double, debt_ratio double, report_period string, announce_date string"
    rows = [("a", DAY, False, False, 999, 1e8, None, 0.1, None, None), ("b", DAY, True, True, 10, 1e6, 0.01, 0.9, None, None), ("c", DAY, False, False, 180, None, 0.03, 0.8, None, None)]
    got = {r.stock_code: (r.is_eligible, r.exclude_reasons) for r in universe.risk_filter(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"a": (False, "FINANCIAL_MISSING"), "b": (False, "ST;PAUSED;LISTED_DAYS_LT_MIN;AMOUNT_LT_MIN;ROE_LT_MIN;DEBT_RATIO_GT_MAX"), "c": (True, "")}


def test_trend_closed_forms(spark):
    rows = [("000001.SZ", f"d{i:03d}", 20.0 + i) for i in range(130)]
    got = {r.trade_date: r for r in factors.trend(spark.createDataFrame(rows, "stock_code string, trade_date string, adj_close double")).collect()}
    last = got["d129"]
    assert last.trend_ret_20d == pytest.approx(149 / 129 - 1) and last.trend_ma60 == pytest.approx(sum(range(90, 150)) / 60) and last.trend_price_ma60_ratio == pytest.approx(149 / last.trend_ma60)
    assert got["d009"].trend_ret_20d is None and got["d018"].trend_ma20 is None and got["d019"].trend_ma20 is not None


def test_percentile_relaxed_and_strict(spark):
    rows = [("a", "2026-01-01", 3.0), ("a", "2026-01-02", 2.0), ("b", "2026-01-02", None), ("c", "2020-01-01", 1.0), ("c", "2026-01-02", 9.0)]
    df = spark.createDataFrame(rows, "stock_code string, trade_date string, pe_ttm double").withColumn("pb", F.col("pe_ttm"))
    got = {(r.stock_code, r.trade_date): r.valuation_pe_percentile_3y for r in factors.valuation_percentiles(df).collect()}
    assert got["a", "2026-01-02"] == 0.5 and got["a", "2026-01-01"] == 1.0 and got["b", "2026-01-02"] is None and got["c", "2026-01-02"] == 1.0
    assert all(r.valuation_pe_percentile_3y is None for r in factors.valuation_percentiles(df, strict=True).collect())


def test_total_score_and_levels(spark):
    rows = [(c, DAY, q, g, v, t, i) for c, q, g, v, t, i in (("000001.SZ", 82.0, 76.0, 68.0, 72.0, 70.0), ("600519.SH", 90.0, 88.0, 80.0, 78.0, 82.0))]
    df = spark.createDataFrame(rows, "stock_code string, trade_date string, quality_score double, growth_score double, valuation_score double, trend_score double, industry_score double")
    assert {r.stock_code: r.total_score for r in scoring.total_scores(df).collect()} == {"000001.SZ": 74.9, "600519.SH": 85.1}
    cases = [(80.0, 70.0, 60.0, "", "low"), (65.0, 55.0, 45.0, "", "medium"), (54.0, 80.0, 80.0, "", "high"), (70.0, 39.0, 80.0, "", "high"), (70.0, 80.0, 29.0, "", "high"), (80.0, 70.0, 60.0, "x; FINANCIAL_MISSING", "high"), (80.0, 70.0, 60.0, "is_paused", "high"), (None, 70.0, 60.0, "", "high")]
    levels = spark.createDataFrame(cases, "total_score double, quality_score double, growth_score double, risk_flags string, want string").select(S.risk_level().alias("got"), "want").collect()
    assert all(r.got == r.want for r in levels)
    with pytest.raises(ValueError):
        scoring.ScoringConfig(weights={"quality_score": 0.9})


def test_selection_passes_its_own_rules(spark):
    from quantloom.catalog_queries import Tables

    chosen = Tables(spark, "/root/testdata/sf0.001").selection.persist()
    assert chosen.count() > 0
    quality.validate(chosen, "selection_result")
    assert not any(quality.recomputation_faults(chosen, scoring.ScoringConfig().weights).first())
    with pytest.raises(quality.DataQualityError, match="ranking"):
        quality.validate(chosen.withColumn("rank", F.col("rank") + 1), "selection_result")


def test_snapshot_of_the_mock_market(spark):
    m = market(spark)
    adjusted = clean.adjusted_price(m["daily_price"], m["adj_factor"])
    snap = clean.clean_snapshot(m["daily_price"], adjusted, m["stock_basic"].drop("trade_date"), m["daily_basic"], m["financial"], m["st_history"]).select(*schemas.dataset("clean_daily_snapshot").names)
    quality.validate(snap, "clean_daily_snapshot")
    assert snap.count() == 5 and snap.where("is_st_on_date").first().stock_code == "000002.SZ"
    assert universe.risk_filter(snap).where("is_eligible").first().stock_code == "300750.SZ"


def test_validators_name_the_broken_rules(spark):
    m = market(spark)
    for n, df in m.items():
        quality.validate(df, n)
    bad = m["daily_price"].withColumn("high", F.lit(0.0)).unionByName(m["daily_price"])
    with pytest.raises(quality.DataQualityError, match="high_low.*duplicate_keys"):
        quality.validate(bad, "daily_price")
    with pytest.raises(quality.DataQualityError, match="no rows"):
        quality.validate(m["adj_factor"].limit(0), "adj_factor")
    with pytest.raises(quality.DataQualityError, match="missing index"):
        quality.validate(m["benchmark_price"].limit(1), "benchmark_price")


def test_upserts(spark):
    a = spark.createDataFrame([("x", 1, None), ("y", 2, 2.0), ("z", 3, 3.0)], "k string, o int, v double")
    b = spark.createDataFrame([("x", 1, None), ("y", 2, 5.0), ("n", 9, 1.0)], "k string, o int, v double")
    assert sorted((r.k, r.v) for r in merge.upsert(a, b, ["k"]).collect()) == [("n", 1.0), ("x", None), ("y", 5.0), ("z", 3.0)]
    assert merge.upsert_counts(a, b, ["k"]).first() == Row(inserted=1, updated=1, unchanged=1, kept=1)
    assert merge.fingerprint(a) == merge.fingerprint(a.orderBy(F.desc("k")).select("v", "o", "k")) != merge.fingerprint(b)
    assert merge.fingerprint(a.unionAll(a)) != merge.fingerprint(a)


def test_schedule(spark):
    days = ["2026-01-05", "2026-01-30", "2026-02-02", "2026-02-27", "2026-03-02"]
    df = spark.createDataFrame([(d,) for d in days], "trade_date string")
    assert sorted(map(tuple, backtest.rebalance_schedule(df, "monthly").collect())) == [("2026-01-30", "2026-02-02"), ("2026-02-27", "2026-03-02")]
    assert backtest.rebalance_schedule(df.limit(1), "monthly").count() == 0


def test_execution_vectors(spark):
    rows = [("buy", 100.0, 10.0, 10.0, 11.0, 9.0, False), ("sell", 100.0, 10.0, 10.0, 11.0, 9.0, False), ("buy", 1.0, 10.0, 11.0, 11.0, 9.0, False), ("sell", 1.0, 10.0, 9.0, 11.0, 9.0, False), ("buy", 1.0, 10.0, 10.0, 11.0, 9.0, True), ("buy", 0.0, 10.0, 10.0, 11.0, 9.0, True)]
    df = spark.createDataFrame(rows, "side string, shares double, adj_open double, open double, limit_up double, limit_down double, is_paused boolean")
    got = backtest.execute_orders(df, 0.001, 50, 0.001).collect()
    assert got[0].fill_price == pytest.approx(10.05) and got[0].cash_delta == pytest.approx(-1006.005)
    assert got[1].cash_delta == pytest.approx(993.01) and got[1].stamp_tax == pytest.approx(0.995)
    assert [r.reason for r in got[2:]] == ["LIMIT_UP", "LIMIT_DOWN", "PAUSED", "ZERO_SHARES"]


def test_simulation(spark):
    days = ["2026-01-30", "2026-02-02", "2026-02-27", "2026-03-02"]
    quotes = {"000001.SZ": ([10.0, 10, 11, 12], [10.0, 11, 12, 12.5]), "600519.SH": ([100.0, 100, 101, 102], [100.0, 100, 102, 103])}
    rows = [(c, d, float(o[i]), float(z[i]), float(o[i]), 1e9, 0.0, False) for c, (o, z) in quotes.items() for i, d in enumerate(days)]
    prices = spark.createDataFrame(rows, "stock_code string, trade_date string, adj_open double, adj_close double, open double, limit_up double, limit_down double, is_paused boolean")
    chosen = spark.createDataFrame([("000001.SZ", "2026-01-30", 1), ("600519.SH", "2026-02-27", 1)], "stock_code string, trade_date string, rank long")
    config = backtest.BacktestConfig("t", days[0], days[-1], initial_cash=1000.0, commission_rate=0.0, slippage_bps=0.0, stamp_tax_rate=0.0)
    detail = backtest.simulate(chosen, prices, [config]).persist()
    daily = {r.trade_date: r.total_asset for r in detail.where("record_type = 'portfolio'").collect()}
    assert daily == pytest.approx({days[0]: 1000.0, days[1]: 1100.0, days[2]: 1200.0, days[3]: 1200.0 * 103 / 102})
    assert [(r.side, r.stock_code) for r in detail.where("record_type = 'trade'").collect()] == [("buy", "000001.SZ"), ("sell", "000001.SZ"), ("buy", "600519.SH")]
    m = backtest.metrics(detail).first()
    assert m.total_return == pytest.approx(1.2 * 103 / 102 - 1) and m.max_drawdown == 0 and m.trade_count == 3
    with pytest.raises(ValueError):
        backtest.simulate(chosen, prices, [backtest.BacktestConfig("t", days[0], days[-1], execution_rule="close")])


def test_pause_evidence_is_never_inferred(spark):
    daily = spark.createDataFrame([("a", "d1", 0.0), ("b", "d1", 0.0), ("b", "d2", 0.0)], "stock_code string, trade_date string, volume double")
    none = daily.select("stock_code", "trade_date").limit(0)
    events = spark.createDataFrame([("a", "d1")], "stock_code string, trade_date string")
    covered = spark.createDataFrame([("d1",)], "trade_date string")
    got = {(r.stock_code, r.trade_date): (r.pause_status, r.is_paused_candidate) for r in candidate.candidate_batch(daily, none, none, none, events, covered).collect()}
    assert got == {("a", "d1"): ("true_candidate", True), ("b", "d1"): ("false_candidate", False), ("b", "d2"): ("unknown", None)}
    assert candidate.gap_reason({"missing": [("a", "d1")], "dates": ["d1", "d2"], "codes": ["a"]}) == "DATE_ALIGNMENT_GAP"
    assert candidate.gap_reason({"missing": []}) is None


def test_publication(spark, tmp_path):
    pub = publish.Publisher(spark, f"file://{tmp_path}")
    df = market(spark)["adj_factor"]
    first = pub.publish(df, "adj_factor", DAY, {"run": 1})
    assert pub.publish(df.orderBy(F.desc("stock_code")), "adj_factor", DAY, {"run": 1}) == first
    assert pub.read("adj_factor", DAY).count() == 5
    with pytest.raises(publish.Conflict):
        pub.publish(df.limit(2), "adj_factor", DAY, {"run": 1})
    with pytest.raises(FileNotFoundError):
        pub.read("adj_factor", "2026-06-20")


def test_clean_range_runs_and_resumes(spark, tmp_path):
    m = market(spark)
    m["daily_price"] = m["daily_price"].withColumn("amount", F.lit(1e8))
    m["stock_basic"] = m["stock_basic"].drop("trade_date")
    root = f"file://{tmp_path}"
    assert runners.run_clean_range(spark, root, "r", m, [DAY]).status == "READY_FOR_APPLY"
    assert runners.run_clean_range(spark, root, "r", m, [DAY], apply=True).status == "COMPLETED"
    assert publish.Publisher(spark, root).read("eligible_universe", DAY).count() == 4
    assert runners.run_clean_range(spark, root, "r", m, [DAY], apply=True).status == "COMPLETED"
    with pytest.raises(runners.ScopeChanged):
        runners.run_clean_range(spark, root, "r", m, [DAY, "2026-06-18"])
    gap = runners.run_clean_range(spark, root + "/other", "s", m | {"adj_factor": m["adj_factor"].limit(1)}, [DAY])
    assert gap.status == "BLOCKED" and "coverage" in gap.reasons[DAY]


def test_step_log(spark, tmp_path):
    log, calls = runners.StepLog(spark, f"file://{tmp_path}"), []
    assert log.run(DAY, "s", lambda: calls.append(1)) == "done" and log.run(DAY, "s", lambda: calls.append(1)) == "skipped"
    with pytest.raises(ZeroDivisionError):
        log.run(DAY, "s", lambda: 1 / 0, force=True)
    assert log.run(DAY, "s", lambda: calls.append(1)) == "done" and len(calls) == 2


def test_backfill_estimate_and_plan(spark, tmp_path):
    e = backfill.estimate("2015-01-01", "2024-12-31", 5000)
    assert (e["chunks"], e["provider_calls"], e["canonical_reads"]) == (710, 13_520, 36_557)
    plan = backfill.plan("2015-01-01", "2024-12-31", 5000)
    assert len(plan) == 592
    with pytest.raises(backfill.PlanTooLarge):
        backfill.plan("1900-01-01", "2024-12-31", 5000)
    files, small = publish.Files(spark, f"file://{tmp_path}"), backfill.plan("2024-01-01", "2024-02-10", 10)
    failing = next(c for c in small if c.dataset == "financial")

    def work(c):
        if c == failing:
            raise backfill.BackfillFailure("RATE_LIMITED", "token=abc")
        return {"rows": 1}

    found = backfill.execute(files, "r", small, work)
    assert found["by_dataset"]["financial"] == {"FAILED": 1, "BLOCKED": 1}
    assert backfill.execute(files, "r", small, lambda c: {"rows": 1}, resume=True)["by_state"] == {"COMPLETED": len(small)}


def test_providers(spark):
    got = providers.map_frame(spark, providers.make_provider("mock").fetch("daily_price", DAY), "daily_price")
    quality.validate(got, "daily_price")
    with pytest.raises(providers.CapabilityError):
        providers.make_provider("tushare")
    pages = [[{"k": i} for i in range(3)], [{"k": 3}]]
    rows, proof = providers.fetch_all_pages(lambda o, n: pages[o // n], ["k"], size=3)
    assert len(rows) == 4 and proof.complete
    with pytest.raises(ValueError):
        providers.fetch_all_pages(lambda o, n: pages[0], ["k"], size=3)
    tries = []
    assert providers.retry(lambda: tries.append(1) or (1 / 0 if len(tries) < 3 else 7), sleep=lambda s: None) == 7


def test_storage(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.write(mock.frame(spark, "daily_price", ["2026-06-18", DAY]), "daily_price")
    store.write(mock.frame(spark, "daily_price", [DAY]), "daily_price")
    assert store.read("daily_price", DAY).count() == 5 and store.history("daily_price", DAY).count() == 10 and store.between("daily_price", DAY, DAY).count() == 5
    assert stock_prices(store.history("daily_price", DAY), "000001.SZ", "2026-06-01", DAY).count() == 2
    plan = store.history("daily_price", "2026-06-18")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(trade_date" in plan
    with pytest.raises(FileNotFoundError):
        store.read("daily_price", "2026-06-20")
    with pytest.raises(FileNotFoundError):
        store.read("adj_factor", DAY)


def test_driver_helpers():
    assert D.weekday_count("2026-06-19", "2026-06-25") == 5 and D.date_windows("2026-01-01", "2026-01-05", 2)[-1] == ("2026-01-05", "2026-01-05")
    assert "abc" not in D.redact("token=abc rest") and D.stable_hash({"b": 1, "a": 2}) == D.stable_hash({"a": 2, "b": 1})
    for bad in ("/a", "a/../b", "a\\b", "a//b", ""):
        with pytest.raises(ValueError):
            D.check_key(bad)
    with pytest.raises(ValueError):
        D.check_date("2026-02-30")


def test_scalars(spark):
    df = spark.createDataFrame([("600000",), ("sz000001",), ("000002.sz",), ("830001",)], "c string")
    assert [r[0] for r in df.select(S.normalize_stock_code("c")).collect()] == ["600000.SH", "000001.SZ", "000002.SZ", "830001.BJ"]
    with pytest.raises(Exception, match="invalid stock code"):
        spark.createDataFrame([("999999",)], "c string").select(S.normalize_stock_code("c")).collect()
    assert [r[0] for r in spark.createDataFrame([("20260619",), ("2026-02-30",), ("x",)], "c string").select(S.normalize_date("c")).collect()] == ["2026-06-19", None, None]
    assert [r[0] for r in spark.createDataFrame([(0.0000005,), (0.0000015,), (2.5e-6,)], "x double").select(S.round6("x")).collect()] == [0.0, 2e-6, 2e-6]
    assert spark.range(1).select(S.scale_positive(F.lit(None).cast("double"), 0.0, 1.0)).first()[0] is None


def test_api_checks_parameters(spark):
    t = spark.createDataFrame([("2026-06-19", "monthly", "2"), ("2026-06-18", "daily", "1")], "trade_date string, rebalance_mode string, created_at string")
    assert api.selections(t, 1, 1).first().trade_date == "2026-06-18" and api.selection(t, DAY, "daily").count() == 0
    for call in (lambda: api.selections(t, 0), lambda: api.selections(t, 1, -1), lambda: api.selection(t, "x"), lambda: api.backtest(t, "XYZ")):
        with pytest.raises(api.ApiError):
            call()
    assert api.health(spark).first().ok == 1
