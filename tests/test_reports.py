"""Publication, ranges, streams, single dates, reports and the command line on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom import cli, settings
from quantloom.functions import contracts as T
from quantloom.functions import driver as D
from quantloom.operators import backtest, factors, merge, readiness, scoring
from quantloom.plans import publish, runners
from quantloom.sources import mock, providers
from quantloom.sources.storage import Store
from quantloom.streaming import upsert_stream

DAY, NEXT = "2026-06-18", "2026-06-19"


def market(spark, days=(DAY, NEXT)):
    found = {n: mock.frame(spark, n, list(days)) for n in runners.RAW}
    found["daily_price"] = found["daily_price"].withColumn("amount", F.lit(1e8))
    found["stock_basic"] = found["stock_basic"].drop("trade_date").distinct()
    return found


def test_files_appear_whole_and_once(spark, tmp_path):
    files = publish.Files(spark, f"file://{tmp_path}")
    assert files.write("a/b.json", {"n": 1}, overwrite=False) and not files.write("a/b.json", {"n": 2}, overwrite=False)
    path, fs = files._at("a/c.json")
    draft, _ = files._at("a/.draft")
    out = fs.create(draft, True)
    out.write(bytearray(b"{}"))
    out.close()
    assert files._rename(fs, draft, files._at("a/b.json")[0], False) is False, "a name that another writer took in between is left alone"
    assert files.read("a/b.json") == {"n": 1}
    assert files.write("a/b.json", {"n": 3}, overwrite=True) and files.read("a/b.json") == {"n": 3}
    files.delete("a/.draft")
    assert files.names("a") == ["b.json"], "no drafts are left"
    assert files.read("a/none.json") is None and files.names("none") == []


def test_streams_with_checkpoints_of_their_own_lose_nothing(spark, tmp_path):
    schema = "k string, p string, o int, v double"
    for n, rows in ((1, [("a", "x", 1, 1.0), ("b", "x", 1, 1.0)]), (2, [("a", "x", 2, 2.0), ("c", "y", 1, 3.0)])):
        spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/in{n}")
    for by in (None, "p"):
        target = f"file://{tmp_path}/table-{by}"
        for n in (1, 2, 2):  # the last one is run again
            upsert_stream(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in{n}"), target, ["k", "p"], ["o"], f"file://{tmp_path}/check-{by}-{n}", by=by).awaitTermination()
        table = publish.PointerTable(spark, target, by)
        assert sorted(map(tuple, table.read(schema).collect())) == [("a", "x", 2, 2.0), ("b", "x", 1, 1.0), ("c", "y", 1, 3.0)]
        # a new checkpoint starts at batch 0 again: nothing is dropped, nothing doubled
        upsert_stream(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in1"), target, ["k", "p"], ["o"], f"file://{tmp_path}/check-{by}-new", by=by).awaitTermination()
        assert table.read(schema).count() == 3
        assert len(table.files.names("data")) <= 3, "old versions go"


def test_partitioned_merge_writes_only_what_comes_in(spark, tmp_path):
    table = publish.PointerTable(spark, f"file://{tmp_path}", by="p")
    schema = "k long, p string, v long"
    rows = spark.createDataFrame([(i, f"p{i % 4}", 0) for i in range(40)], schema)
    table.merge(rows, ["k", "p"], ["v"], "one")
    before = table._now()["parts"]
    table.merge(spark.createDataFrame([(1, "p1", 5), (100, "p9", 1)], schema), ["k", "p"], ["v"], "two")
    after = table._now()["parts"]
    assert {p for p in after if after[p] != before.get(p)} == {"p1", "p9"}
    assert table.read(rows.schema).count() == 41 and table.read(rows.schema).where("v = 5").first().k == 1
    with pytest.raises(ValueError):
        publish.PointerTable(spark, f"file://{tmp_path}/x", by="v").merge(rows, ["k"], ["v"], "one")


def test_range_of_dates_is_published_together(spark, tmp_path):
    m, root = market(spark), f"file://{tmp_path}"
    bad = m | {"daily_price": m["daily_price"].withColumn("high", F.when(F.col("trade_date") == NEXT, F.lit(0.0)).otherwise(F.col("high")))}
    report = runners.run_clean_range(spark, root, "r", bad, [DAY, NEXT], apply=True)
    assert report.status == "PARTIAL" and report.dates == {DAY: "COMPLETED", NEXT: "BLOCKED"} and "high_low" in report.reasons[NEXT]
    publisher = publish.Publisher(spark, root)
    assert publisher.committed("eligible_universe") == [DAY] and publisher.read("eligible_universe", DAY).count() == 4
    report = runners.run_clean_range(spark, root, "r2", m, [DAY, NEXT], apply=True)
    assert report.status == "COMPLETED" and publisher.files.read("runs/r2/report.json")["status"] == "COMPLETED"
    assert publisher.files.names("staging") == []
    history = runners.committed_history(spark, root, NEXT, m["benchmark_price"])
    report = runners.run_factor_range(spark, root, "f", history, [DAY, NEXT], apply=True, least=5, strict=False)
    assert report.status == "COMPLETED"
    assert runners.run_factor_range(spark, root, "g", history, [DAY], least=24, strict=False).dates[DAY] == "BLOCKED"
    tables = {n: publisher.read_dates(n, [DAY, NEXT]) for n in ("factor_daily", "eligible_universe", "factor_input_table", "risk_filter")}
    saved = []

    def broken(rows):
        raise OSError("password=abc is wrong")

    report = runners.run_selection_range(spark, root, "s", tables, [DAY, NEXT], "monthly", apply=True, save_summary=broken, least=5)
    assert report.status == "DATABASE_PENDING" and "abc" not in str(report.reasons)
    report = runners.run_selection_range(spark, root, "s2", tables, [DAY, NEXT], "monthly", apply=True, save_summary=lambda rows: saved.append(rows.count()), least=5)
    assert report.status == "COMPLETED" and saved == [2], "only the summary is repaired"
    with pytest.raises(TypeError):  # a bug is no database failure
        runners.run_selection_range(spark, root, "s3", tables, [DAY], "monthly", apply=True, save_summary=lambda: None, least=5)
    commit = publisher.commit_of("factor_daily", DAY)
    publisher.files.write(f"commits/factor_daily/{DAY}.json", commit | {"checksum": "x"}, overwrite=True)
    with pytest.raises(publish.Conflict):
        publisher.read("factor_daily", DAY)


def test_single_date_steps(spark, tmp_path):
    store, log = Store(spark, f"file://{tmp_path}"), runners.StepLog(spark, f"file://{tmp_path}")
    provider = providers.make_provider("mock")
    assert set(runners.update_provider_data(spark, store, log, provider, NEXT).values()) == {"done"}
    assert set(runners.update_provider_data(spark, store, log, provider, NEXT).values()) == {"skipped"}
    assert set(runners.run_date(spark, store, log, NEXT).values()) == {"done"}
    assert set(runners.run_date(spark, store, log, NEXT).values()) == {"skipped"}
    assert [r.stock_code for r in store.read("selection_result", NEXT).collect()] == ["300750.SZ"], "the only one that is liquid enough"


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["plan-backfill", "--start", "2015-01-01", "--end", "2024-12-31", "--codes", "5000"]) == 0
    assert json.loads(capsys.readouterr().out)["chunks"] == 592
    assert cli.main(["plan-backfill", "--start", "2024-01-02", "--end", "2024-01-01", "--codes", "5"]) == 2
    assert cli.main(["nothing"]) == 2
    assert cli.main(["update-data", "--root", f"file://{tmp_path}", "--date", NEXT]) == 0
    assert cli.main(["validate", "--root", f"file://{tmp_path}", "--dataset", "adj_factor", "--date", NEXT]) == 0
    assert cli.main(["validate", "--root", f"file://{tmp_path}", "--dataset", "adj_factor", "--date", DAY]) == 2
    capsys.readouterr()
    assert cli.main(["query", "--path", f"file://{tmp_path}/raw/adj_factor", "--sql", "SELECT count(*) AS n FROM {dataset}"]) == 0
    assert json.loads(capsys.readouterr().out)["rows"] == [{"n": 5}]


@pytest.mark.parametrize("text", ["token=abc", "Token : 'a b'", 'x {"client_secret":"abc", "n": 1}', "Authorization: Bearer abc", "password abc", "bearer abc", "url?access_token=abc&x=1", "api-key = abc"])
def test_credentials_are_masked(text):
    shown = D.redact(text)
    assert "abc" not in shown and "a b" not in shown and "***" in shown


def test_other_words_are_not_masked():
    assert D.redact("rows=5, path a/b: 3 dates; total 7") == "rows=5, path a/b: 3 dates; total 7"


def test_ranks_in_window_match_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        days = np.sort(rng.integers(0, 300, n))
        values = np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, 9, n).astype(float))
        for slice_rows in (1 << 20, 64):
            below, total, first = factors.ranks_in_window(days, values, 90, slice_rows)
            for i in range(n):
                inside = (days >= days[i] - 90) & (days < days[i])
                own = values[inside]
                assert total[i] == (~np.isnan(own)).sum()
                if not np.isnan(values[i]):
                    assert below[i] == (own <= values[i]).sum()
                if inside.any():
                    assert first[i] == days[inside][0]


def test_blocked_orders_keep_shares(spark):
    days = ["2026-01-30", "2026-02-02", "2026-02-27", "2026-03-02", "2026-03-31", "2026-04-01"]
    rows = [(c, d, 10.0, 10.0, 10.0, 11.0 if (c, i) != ("b", 3) else 10.0, 9.0, (c, i) == ("a", 3)) for c in "ab" for i, d in enumerate(days) if (c, i) != ("b", 5)]
    prices = spark.createDataFrame(rows, "stock_code string, trade_date string, adj_open double, adj_close double, open double, limit_up double, limit_down double, is_paused boolean")
    chosen = spark.createDataFrame([("a", days[0], 1), ("b", days[2], 1), ("b", days[4], 1)], "stock_code string, trade_date string, rank long")
    config = backtest.BacktestConfig("t", days[0], days[-1], initial_cash=100.0, commission_rate=0.0, slippage_bps=0.0, stamp_tax_rate=0.0)
    detail = backtest.simulate(chosen, prices, [config, backtest.BacktestConfig("u", days[0], days[-1], "quarterly")])
    mine = detail.where(F.col("run_key") == config.run_key())
    trades = [(r.trade_date, r.stock_code, r.side, r.reason, r.shares) for r in mine.where("record_type = 'trade'").orderBy("trade_date", "side", "stock_code").collect()]
    assert trades == [(days[1], "a", "buy", "", 10.0), (days[3], "b", "buy", "ZERO_SHARES", 0.0), (days[3], "a", "sell", "PAUSED", 10.0), (days[5], "b", "buy", "MISSING_PRICE", 0.0), (days[5], "a", "sell", "", 10.0)]
    assert {r.trade_date: r.total_asset for r in mine.where("record_type = 'portfolio'").collect()} == dict.fromkeys(days, 100.0)
    assert detail.select("run_key").distinct().count() == 2


def test_gates_and_contracts(spark):
    assert T.provider_level("AKShare", "benchmark_price") == ("DQ2", ("benchmark_price",)) and T.provider_level("baostock", "daily_price")[1][0] == "daily_price_raw"
    assert T.batch_promotion(False, False, ["unknown"], False, False, False, "DQ1").status == "BLOCKED_BY_UNRESOLVED_IS_PAUSED"
    assert not T.miss_is_false("FULL_EVENT_COVERAGE", True, True, ["volume"]) and T.miss_is_false("FULL_EVENT_COVERAGE", True, True)
    assert not T.price_coverage([("daily", 0, 0, None)]).ready and T.price_coverage([("daily", 3, 3, None)]).ready
    with pytest.raises(ValueError):
        T.usable_in("other", "DQ3", "daily_price")
    with pytest.raises(readiness.ScopeTooLarge):
        readiness.check_scope(list("abcdef"), ["d"])


def test_settings(tmp_path):
    (tmp_path / "s.yaml").write_text("a:\n  b: 1 # c\n  d: 'x'\ne: null\n")
    assert settings.load(str(tmp_path / "s.yaml")) == {"a": {"b": 1, "d": "x"}, "e": None}
    with pytest.raises(FileNotFoundError):
        settings.load(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        settings.parse("- a: 1")
    with pytest.raises(ValueError):
        settings.scoring_config({"weights": {"luck": 1}})
    assert settings.scoring_config({}) == scoring.ScoringConfig()


def test_ties_in_keep_last_do_not_depend_on_order(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("b", 1, None), ("b", 1, "z")]
    found = [sorted(map(tuple, merge.keep_last(spark.createDataFrame(r, "k string, o int, v string"), ["k"], ["o"]).collect())) for r in (rows, rows[::-1])]
    assert found[0] == found[1]
