"""Factors as windows over whole histories.

History is read apart from eligibility, so windows run first and eligibility
filters afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import mean_of, scale_inverse, scale_positive
from ..schemas import FACTORS, SCORES

KEYS = ["stock_code", "trade_date"]
MAIN_INDEX = "000300.SH"
YEARS_3 = 1095
STRICT_ROWS = 720
STRICT_SLACK = 31


def bar_return(value: str, bars: int, window) -> Column:
    """Last over the value ``bars`` rows earlier, less 1; null without it or where it is 0."""
    return F.try_divide(F.col(value), F.lag(value, bars).over(window)) - 1


def moving_average(value: str, bars: int, window) -> Column:
    """Mean of the last ``bars`` rows; null with fewer rows; null values are left out of the mean."""
    frame = window.rowsBetween(-(bars - 1), 0)
    return F.when(F.count(F.lit(1)).over(frame) >= bars, F.avg(value).over(frame))


def trend(adjusted: DataFrame) -> DataFrame:
    """Returns and averages over 20, 60 and 120 bars, and price over the 60-bar average."""
    w = Window.partitionBy("stock_code").orderBy("trade_date")
    out = adjusted.select(
        *KEYS,
        "adj_close",
        *[bar_return("adj_close", n, w).alias(f"trend_ret_{n}d") for n in (20, 60, 120)],
        *[moving_average("adj_close", n, w).alias(f"trend_ma{n}") for n in (20, 60, 120)],
    )
    return out.withColumn("trend_price_ma60_ratio", F.try_divide("adj_close", "trend_ma60"))


def benchmark_returns(benchmark: DataFrame, index: str = MAIN_INDEX) -> DataFrame:
    w = Window.partitionBy("index_code").orderBy("trade_date")
    rows = benchmark.where(F.col("index_code") == index)
    return rows.select("trade_date", *[bar_return("close", n, w).alias(f"benchmark_ret_{n}d") for n in (60, 120)])


def _steady_mean(value: str) -> Column:
    """Mean of the known values of a group, added up in their order of size: the same to the last digit in whatever order rows come."""
    values = F.array_sort(F.collect_list(value))
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def industry(eligible: DataFrame, trends: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Mean return of a date's eligible stocks by industry, and its lead over the index.

    ``eligible``: stock_code, trade_date, industry.  Null returns are left out; a null industry has none.
    """
    rows = eligible.select(*KEYS, "industry").join(trends.select(*KEYS, "trend_ret_60d", "trend_ret_120d"), KEYS, "left")
    means = rows.where("industry is not null").groupBy("trade_date", "industry").agg(_steady_mean("trend_ret_60d").alias("industry_ret_60d"), _steady_mean("trend_ret_120d").alias("industry_ret_120d"))
    lead = means.join(benchmark_returns(benchmark), "trade_date", "left")
    for n in (60, 120):
        lead = lead.withColumn(f"industry_strength_{n}d", F.col(f"industry_ret_{n}d") - F.col(f"benchmark_ret_{n}d"))
    return lead.drop("benchmark_ret_60d", "benchmark_ret_120d")


def ranks_in_window(days, values, span: int, slice_rows: int = 1 << 20):
    """For each row (rows not after it, rows) among the known values of the ``span`` days before its day, and the first of those days.

    ``days`` are sorted; a row's own day is not among them.  Rows are compared
    some at a time, so memory does not grow with the product of rows and window.
    """
    import numpy as np

    n = len(days)
    low, high = np.searchsorted(days, days - span, "left"), np.searchsorted(days, days, "left")
    known = ~np.isnan(values)
    before = np.r_[0, np.cumsum(known)]
    total = before[high] - before[low]
    below = np.zeros(n, np.int64)
    a = 0
    while a < n:
        widest = max(1, int((high[a : a + 4096] - low[a : a + 4096]).max(initial=1)))
        b = min(n, a + max(1, min(4096, slice_rows // widest)))
        reach = int((high[a:b] - low[a:b]).max(initial=0))
        if reach:
            at = low[a:b, None] + np.arange(reach)[None, :]
            inside = at < high[a:b, None]
            with np.errstate(invalid="ignore"):
                below[a:b] = ((values[np.minimum(at, n - 1)] <= values[a:b, None]) & inside).sum(1)
        a = b
    first = np.where(high > low, days[np.minimum(low, n - 1)], days + span)
    return below, total, first


def _percentiles(strict: bool):
    def run(table):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(table.column("trade_date").to_numpy(zero_copy_only=False).astype(str), kind="stable")
        table = table.take(pa.array(order))
        days = table.column("trade_date").to_numpy(zero_copy_only=False).astype("datetime64[D]").astype(np.int64)
        out = [table.column(k) for k in KEYS]
        for name in ("pe_ttm", "pb"):
            values = table.column(name).to_numpy(zero_copy_only=False).astype(float)
            below, total, first = ranks_in_window(days, values, YEARS_3)
            hidden = np.isnan(values)
            if strict:
                hidden |= (total < STRICT_ROWS) | (first > days - (YEARS_3 - STRICT_SLACK))
            out.append(pa.array((below + 1) / (total + 1), mask=hidden))
        return pa.table(dict(zip([*KEYS, "valuation_pe_percentile_3y", "valuation_pb_percentile_3y"], out)))

    return run


def valuation_percentiles(snapshot: DataFrame, strict: bool = False) -> DataFrame:
    """Share of values not above the current one among the last three years and the current value itself, by stock.

    Null for a null current value.  ``strict`` also wants 720 values before it
    and a first row within 31 days of the window's start.  A stock's history, a
    row a trading day, is counted over once; no row carries a list of its window.
    """
    rows = snapshot.select(*KEYS, "pe_ttm", "pb")
    schema = "stock_code string, trade_date string, valuation_pe_percentile_3y double, valuation_pb_percentile_3y double"
    return rows.groupBy("stock_code").applyInArrow(_percentiles(strict), schema)


def factor_scores(factors: DataFrame, neutral: float = 50.0) -> DataFrame:
    """Add the five scores: means of anchored components, clipped; ``neutral`` where all components are missing."""
    parts = {
        "quality_score": [scale_positive("quality_roe", 0.03, 0.20), scale_positive("quality_gross_margin", 0.10, 0.60), scale_inverse("quality_debt_ratio", 0.20, 0.80)],
        "growth_score": [scale_positive("growth_revenue_yoy", -0.20, 0.30), scale_positive("growth_net_profit_yoy", -0.20, 0.30)],
        "valuation_score": [
            scale_inverse("valuation_pe_ttm", 5.0, 60.0),
            scale_inverse("valuation_pb", 0.5, 8.0),
            scale_inverse("valuation_ps_ttm", 0.5, 15.0),
            scale_inverse("valuation_pe_percentile_3y", 0.0, 1.0),
            scale_inverse("valuation_pb_percentile_3y", 0.0, 1.0),
        ],
        "trend_score": [scale_positive("trend_ret_20d", -0.20, 0.40), scale_positive("trend_ret_60d", -0.30, 0.80), scale_positive("trend_ret_120d", -0.40, 1.20), scale_positive("trend_price_ma60_ratio", 0.70, 1.30)],
        "industry_score": [scale_positive("industry_ret_60d", -0.30, 0.80), scale_positive("industry_ret_120d", -0.40, 1.20), scale_positive("industry_strength_60d", -0.20, 0.20), scale_positive("industry_strength_120d", -0.30, 0.30)],
    }
    return factors.withColumns({name: F.coalesce(mean_of(columns), F.lit(neutral)) for name, columns in parts.items()})


_NAMES = {
    "quality_roe": "roe", "quality_gross_margin": "gross_margin", "quality_debt_ratio": "debt_ratio", "growth_revenue_yoy": "revenue_yoy", "growth_net_profit_yoy": "net_profit_yoy",
    "valuation_pe_ttm": "pe_ttm", "valuation_pb": "pb", "valuation_ps_ttm": "ps_ttm", "liquidity_amount": "amount", "liquidity_turnover_rate": "turnover_rate",
}


def factor_frame(rows: DataFrame, trends: DataFrame, benchmark: DataFrame, strict: bool = False, neutral: float = 50.0) -> DataFrame:
    """``factor_daily`` in one pass over classified snapshot rows (those of ``universe.classify``), which are read once.

    The same rows carry eligibility, percentiles, trends and industry means, so
    no table is joined with itself.  Returns the eligible rows with all factors
    and scores, exclude_reasons and risk_flags.
    """
    share = valuation_percentiles(rows, strict)
    base = rows.where("is_eligible").join(share, KEYS, "left").join(trends.drop("adj_close"), KEYS, "left")
    # in the order of the codes: sums are the same to the last digit in whatever order rows come
    group = Window.partitionBy("trade_date", "industry").orderBy("stock_code").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for n in (60, 120):
        base = base.withColumn(f"industry_ret_{n}d", F.when(F.col("industry").isNotNull(), F.avg(f"trend_ret_{n}d").over(group)))
    base = base.join(benchmark_returns(benchmark), "trade_date", "left")
    for n in (60, 120):
        base = base.withColumn(f"industry_strength_{n}d", F.col(f"industry_ret_{n}d") - F.col(f"benchmark_ret_{n}d"))
    base = base.withColumns({k: F.col(v) for k, v in _NAMES.items()} | {"quality_cashflow_profit_ratio": F.lit(None).cast("double")})
    return factor_scores(base, neutral).select(*KEYS, "industry", "market_type", *FACTORS, *SCORES, "exclude_reasons", "risk_flags")


def factor_daily(factor_input: DataFrame, adjusted: DataFrame, snapshot: DataFrame, benchmark: DataFrame, strict: bool = False, neutral: float = 50.0) -> DataFrame:
    """All factors and scores of the eligible stocks; one pass of windows by stock, one small aggregation by industry."""
    trends = trend(adjusted)
    base = factor_input.join(valuation_percentiles(snapshot, strict), KEYS, "left").join(trends.drop("adj_close"), KEYS, "left")
    base = base.join(industry(factor_input, trends, benchmark), ["trade_date", "industry"], "left")
    # net profit is not among the inputs, so the cash flow to profit ratio cannot be computed
    base = base.withColumns({k: F.col(v) for k, v in _NAMES.items()} | {"quality_cashflow_profit_ratio": F.lit(None).cast("double")})
    return factor_scores(base, neutral).select(*KEYS, "industry", "market_type", *FACTORS, *SCORES)
