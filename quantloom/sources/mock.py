"""A small generated market: five stocks, all raw datasets, one rule for each number."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from ..schemas import dataset

# The five stocks of the mock market.
STOCKS = [("000001.SZ", "银行", "主板"), ("000002.SZ", "房地产", "主板"), ("600000.SH", "银行", "主板"), ("600519.SH", "食品饮料", "主板"), ("300750.SZ", "电力设备", "创业板")]
INDEXES = ("000300.SH", "000905.SH", "000906.SH")


def _price(code: str, i: int, day: str) -> dict:
    before = 10.0 + 8 * i
    close, start = round(before * (1.01 + 0.002 * i), 2), round(before * (1.005 + 0.001 * i), 2)
    volume = 1_000_000 + 120_000 * i
    return dict(
        stock_code=code, trade_date=day, open=start, high=round(max(start, close) * 1.02, 2), low=round(min(start, close) * 0.98, 2), close=close, pre_close=before, volume=float(volume),
        amount=volume * close, pct_chg=round((close / before - 1) * 100, 4), is_paused=False, limit_up=round(before * 1.1, 2), limit_down=round(before * 0.9, 2),
    )


def rows(name: str, day: str) -> list[dict]:
    """Rows of a raw dataset on a day."""
    announced = (date.fromisoformat(day) - timedelta(30)).isoformat()
    numbered = list(enumerate(STOCKS))
    if name == "stock_basic":
        return [dict(stock_code=c, stock_name=f"Mock {i}", exchange="SZSE" if c.endswith("SZ") else "SSE", list_date="2010-01-01", delist_date=None, industry=ind, market_type=m, is_st=i == 1, trade_date=day) for i, (c, ind, m) in numbered]
    if name == "daily_price":
        return [_price(c, i, day) for i, (c, _, _) in numbered]
    if name == "adj_factor":
        return [dict(stock_code=c, trade_date=day, adj_factor=1 + 0.01 * i) for i, (c, _, _) in numbered]
    if name == "daily_basic":
        return [dict(stock_code=c, trade_date=day, pe_ttm=8.0 + 5 * i, pb=0.8 + 0.4 * i, ps_ttm=1.2 + 0.5 * i, total_mv=5e10 + 8e9 * i, circ_mv=4e10 + 6e9 * i, turnover_rate=0.5 + 0.2 * i) for i, (c, _, _) in numbered]
    if name == "financial":
        return [dict(stock_code=c, report_period="2026-03-31", announce_date=announced, revenue_yoy=0.05 + 0.02 * i, net_profit_yoy=0.04 + 0.015 * i, roe=0.06 + 0.015 * i, gross_margin=0.2 + 0.04 * i, debt_ratio=0.35 + 0.05 * i, operating_cashflow=1e9 + 1e8 * i) for i, (c, _, _) in numbered]
    if name == "st_history":
        return [dict(stock_code="000002.SZ", st_type="ST", start_date="2026-01-01", end_date=None, source="mock")]
    if name == "benchmark_price":
        out = []
        for i, c in enumerate(INDEXES):
            before = 4000.0 + 500 * i
            close = before * (1.002 + 0.001 * i)
            out.append(dict(index_code=c, trade_date=day, open=before, high=close * 1.01, low=before * 0.99, close=close, pct_chg=(close / before - 1) * 100))
        return out
    raise ValueError(f"not a raw dataset: {name}")


def frame(spark: SparkSession, name: str, days: list[str]) -> DataFrame:
    names = dataset(name).names
    found = [tuple(r[c] for c in names) for d in days for r in rows(name, d)]
    return spark.createDataFrame(list(dict.fromkeys(found)), dataset(name).schema)
