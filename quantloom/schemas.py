"""Dataset registry: columns, types, keys, emptiness and storage zone of every dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "f": T.DoubleType(), "i": T.LongType(), "b": T.BooleanType()}


@dataclass(frozen=True)
class Dataset:
    name: str
    columns: tuple[tuple[str, str], ...]  # (name, one of s f i b)
    keys: tuple[str, ...]
    nullable: frozenset[str] = frozenset()
    may_be_empty: bool = False
    zone: str = "raw"

    @property
    def names(self) -> list[str]:
        return [c for c, _ in self.columns]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, _TYPES[k]) for c, k in self.columns])

    def numeric(self) -> list[str]:
        return [c for c, k in self.columns if k in "fi"]


def _cols(text: str) -> tuple[tuple[str, str], ...]:
    """``name:type`` words; a type holds until the next one."""
    out, kind = [], "s"
    for word in text.split():
        name, _, k = word.partition(":")
        kind = k or kind
        out.append((name, kind))
    return tuple(out)


_CODE = "stock_code:s trade_date"
_FIN = "revenue_yoy:f net_profit_yoy roe gross_margin debt_ratio operating_cashflow"
_QUOTES = "open:f high low close pre_close volume amount pct_chg is_paused:b limit_up:f limit_down"
_BASIC = "pe_ttm:f pb ps_ttm total_mv circ_mv turnover_rate"
_FIN_NULL = frozenset("report_period announce_date revenue_yoy net_profit_yoy roe gross_margin debt_ratio operating_cashflow".split())
FACTORS = (
    "quality_roe quality_gross_margin quality_debt_ratio quality_cashflow_profit_ratio growth_revenue_yoy growth_net_profit_yoy "
    "valuation_pe_ttm valuation_pb valuation_ps_ttm valuation_pe_percentile_3y valuation_pb_percentile_3y "
    "trend_ret_20d trend_ret_60d trend_ret_120d trend_ma20 trend_ma60 trend_ma120 trend_price_ma60_ratio "
    "industry_ret_60d industry_ret_120d industry_strength_60d industry_strength_120d liquidity_amount liquidity_turnover_rate"
).split()
SCORES = ["quality_score", "growth_score", "valuation_score", "trend_score", "industry_score"]

REGISTRY: dict[str, Dataset] = {
    d.name: d
    for d in (
        Dataset("stock_basic", _cols("stock_code:s stock_name exchange list_date delist_date industry market_type is_st:b trade_date:s"), ("stock_code", "trade_date"), frozenset({"delist_date"})),
        Dataset("daily_price", _cols(f"{_CODE} {_QUOTES}"), ("stock_code", "trade_date")),
        Dataset("adj_factor", _cols(f"{_CODE} adj_factor:f"), ("stock_code", "trade_date")),
        Dataset("daily_basic", _cols(f"{_CODE} {_BASIC}"), ("stock_code", "trade_date")),
        Dataset("financial", _cols(f"stock_code:s report_period announce_date {_FIN}"), ("stock_code", "report_period", "announce_date")),
        Dataset("st_history", _cols("stock_code:s st_type start_date end_date source"), ("stock_code", "st_type", "start_date", "source"), frozenset({"end_date"}), True),
        Dataset("benchmark_price", _cols("index_code:s trade_date open:f high low close pct_chg"), ("index_code", "trade_date")),
        Dataset("adjusted_price", _cols(f"{_CODE} adj_open:f adj_high adj_low adj_close volume amount pct_chg is_paused:b limit_up:f limit_down"), ("stock_code", "trade_date")),
        Dataset(
            "clean_daily_snapshot",
            _cols(f"{_CODE} stock_name industry market_type {_QUOTES} adj_open adj_high adj_low adj_close {_BASIC} report_period:s announce_date {_FIN} is_st_on_date:b listed_days:i"),
            ("stock_code", "trade_date"),
            _FIN_NULL,
        ),
        Dataset(
            "risk_filter",
            _cols(f"{_CODE} is_eligible:b exclude_reasons:s risk_flags is_st_on_date:b is_paused listed_days:i amount:f roe debt_ratio report_period:s announce_date"),
            ("stock_code", "trade_date"),
            frozenset({"roe", "debt_ratio", "report_period", "announce_date"}),
        ),
        Dataset("eligible_universe", _cols(f"{_CODE} stock_name industry market_type listed_days:i amount:f roe debt_ratio"), ("stock_code", "trade_date"), may_be_empty=True),
        Dataset("factor_input_table", _cols(f"{_CODE} industry market_type adj_close:f amount turnover_rate pe_ttm pb ps_ttm total_mv circ_mv {_FIN}"), ("stock_code", "trade_date"), may_be_empty=True),
        Dataset("factor_daily", _cols(f"{_CODE} industry market_type {FACTORS[0]}:f {' '.join(FACTORS[1:])} {' '.join(SCORES)}"), ("stock_code", "trade_date"), frozenset(FACTORS), True),
        Dataset(
            "selection_result",
            _cols(f"{_CODE} industry market_type {SCORES[0]}:f {' '.join(SCORES[1:])} total_score risk_level:s rank:i suggestion:s reason exclude_reasons risk_flags"),
            ("stock_code", "trade_date"),
            zone="processed",
        ),
    )
}


def dataset(name: str) -> Dataset:
    if name not in REGISTRY:
        raise ValueError(f"unknown dataset: {name}")
    return REGISTRY[name]


def conform(df: DataFrame, name: str, *more: str) -> DataFrame:
    """The dataset's columns in order and type, and those of ``more`` as text; a missing column is an error, a further one is dropped."""
    from pyspark.sql import functions as F

    spec = dataset(name)
    missing = [c for c in (*spec.names, *more) if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns: {', '.join(missing)}")
    return df.select(*[F.col(c).cast(_TYPES[k]).alias(c) for c, k in (*spec.columns, *((c, "s") for c in more))])


def check_physical(df: DataFrame, name: str) -> None:
    """Raise unless names, order and types are exactly those of the registry."""
    have = [(f.name, f.dataType) for f in df.schema.fields]
    want = [(c, _TYPES[k]) for c, k in dataset(name).columns]
    if have != want:
        raise ValueError(f"{name}: physical schema differs: {have} instead of {want}")
