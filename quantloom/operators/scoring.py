"""Total score, selection and summaries."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import reason, risk_level, round6, suggestion
from ..schemas import dataset

KEYS = ["stock_code", "trade_date"]


@dataclass(frozen=True)
class ScoringConfig:
    weights: dict = field(default_factory=lambda: {"quality_score": 0.30, "growth_score": 0.25, "valuation_score": 0.20, "industry_score": 0.15, "trend_score": 0.10})
    neutral: float = 50.0
    top_n: int = 50

    def __post_init__(self):
        w = self.weights
        if any(not math.isfinite(x) or x < 0 for x in w.values()) or abs(sum(w.values()) - 1) > 1e-9:
            raise ValueError("weights must be finite, not negative, and sum to 1")
        if isinstance(self.top_n, bool) or not isinstance(self.top_n, int) or self.top_n <= 0:
            raise ValueError("top_n must be a positive integer")


def total_scores(factors: DataFrame, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Weighted sum of the scores, clipped to 0..100 and rounded half to even at six places."""
    total = F.lit(0.0)
    for name, weight in config.weights.items():
        total = total + F.coalesce(F.col(name), F.lit(config.neutral)) * F.lit(weight)
    return factors.withColumn("total_score", round6(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))))


def select_top(factors: DataFrame, eligible: DataFrame, risk: DataFrame, factor_input: DataFrame | None = None, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """The first ``top_n`` of each date by total score, then code, with risk level, texts and rank."""
    rows = factors.join(eligible.select(*KEYS).distinct(), KEYS, "left_semi")
    if factor_input is not None:
        rows = rows.join(factor_input.select(*KEYS).distinct(), KEYS, "left_semi")
    scored = total_scores(rows, config)
    return _ranked(scored, risk.select(*KEYS, "exclude_reasons", "risk_flags").dropDuplicates(KEYS), config)


def select_classified(factors: DataFrame, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """``select_top`` of rows that carry their own exclude_reasons and risk_flags (``factors.factor_frame``): no joins."""
    return _ranked(total_scores(factors, config), None, config)


def _ranked(scored: DataFrame, flags: DataFrame | None, config: ScoringConfig) -> DataFrame:
    order = Window.partitionBy("trade_date").orderBy(F.desc("total_score"), "stock_code")
    top = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= config.top_n)
    full = (top if flags is None else top.join(flags, KEYS, "left")).withColumns({c: F.coalesce(c, F.lit("")) for c in ("exclude_reasons", "risk_flags")})
    full = full.withColumn("risk_level", risk_level()).withColumn("reason", reason()).withColumn("suggestion", suggestion())
    return full.select(*dataset("selection_result").names)


def summarize_selection(selection: DataFrame, top_n: int) -> DataFrame:
    """One row a date: count, mean, greatest and least total score, and the first stocks as structs."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("rank", "stock_code", "total_score"))), 1, top_n)
    return selection.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("stock_count"),
        F.avg("total_score").alias("avg_total_score"),
        F.max("total_score").alias("max_total_score"),
        F.min("total_score").alias("min_total_score"),
        first.alias("top_stocks"),
    )


def score_statistics(selection: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, least, greatest, mean), a row for each score column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]))
    return selection.select(pairs.alias("x")).groupBy("x.column").agg(F.count("x.value").alias("n"), F.min("x.value").alias("least"), F.max("x.value").alias("greatest"), F.avg("x.value").alias("mean"))
