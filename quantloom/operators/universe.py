"""Risk filter, eligible universe and factor input."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import dataset


@dataclass(frozen=True)
class RiskLimits:
    min_listed_days: int = 180
    min_amount: float = 5e7
    min_roe: float = 0.03
    max_debt_ratio: float = 0.80


def exclude_reasons(limits: RiskLimits = RiskLimits()):
    """Reasons in order, joined by ;.  Missing financials end the list; a null measure excludes nobody."""
    missing = F.col("roe").isNull() | F.col("debt_ratio").isNull()
    return F.concat_ws(
        ";",
        F.when(F.col("is_st_on_date"), "ST"),
        F.when(F.col("is_paused"), "PAUSED"),
        F.when(F.col("listed_days") < limits.min_listed_days, "LISTED_DAYS_LT_MIN"),
        F.when(F.col("amount") < limits.min_amount, "AMOUNT_LT_MIN"),
        F.when(missing, "FINANCIAL_MISSING"),
        F.when(~missing & (F.col("roe") < limits.min_roe), "ROE_LT_MIN"),
        F.when(~missing & (F.col("debt_ratio") > limits.max_debt_ratio), "DEBT_RATIO_GT_MAX"),
    )


def classify(snapshot: DataFrame, limits: RiskLimits = RiskLimits()) -> DataFrame:
    """The snapshot's rows with is_eligible, exclude_reasons and risk_flags: one frame that risk, universe and inputs are columns of."""
    found = snapshot.withColumn("exclude_reasons", exclude_reasons(limits)).withColumn("risk_flags", F.col("exclude_reasons"))
    return found.withColumn("is_eligible", F.col("exclude_reasons") == "")


def risk_filter(snapshot: DataFrame, limits: RiskLimits = RiskLimits()) -> DataFrame:
    return classify(snapshot, limits).select(*dataset("risk_filter").names)


def _eligible_keys(risk: DataFrame) -> DataFrame:
    return risk.where("is_eligible").select("stock_code", "trade_date").distinct()


def eligible_universe(snapshot: DataFrame, risk: DataFrame) -> DataFrame:
    return snapshot.join(_eligible_keys(risk), ["stock_code", "trade_date"], "left_semi").select(*dataset("eligible_universe").names)


def factor_input(snapshot: DataFrame, risk: DataFrame) -> DataFrame:
    return snapshot.join(_eligible_keys(risk), ["stock_code", "trade_date"], "left_semi").select(*dataset("factor_input_table").names)
