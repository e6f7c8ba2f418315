"""Backtests as runs: skipped when done, detail by run key, one summary row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest as B
from .publish import Files, PointerTable

SUMMARY_KEYS = ["run_key"]


def write_detail(detail: DataFrame, root: str) -> str:
    """Detail rows below ``backtest/detail/run_key=<16 hex digits>/``; the runs that come in replace their own rows only."""
    path = f"{root.rstrip('/')}/backtest/detail"
    detail.repartition("run_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_key").parquet(path)
    return path


def read_detail(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/backtest/detail").withColumn("run_key", F.col("run_key").cast("string"))


def find_done(spark: SparkSession, root: str, run_key: str) -> bool:
    state = Files(spark, root).read(f"backtest/state/{run_key}.json")
    return bool(state) and state["status"] == "done"


def run_backtest(spark: SparkSession, root: str, selection: DataFrame, prices: DataFrame, benchmark: DataFrame, config: B.BacktestConfig, force: bool = False) -> str:
    """Simulate, write the detail, upsert the summary, mark as done; "skipped" if the run key is done already and not forced."""
    key, files = config.run_key(), Files(spark, root)
    if find_done(spark, root, key) and not force:
        return "skipped"
    files.write(f"backtest/state/{key}.json", {"run_key": key, "status": "running"}, overwrite=True)
    write_detail(B.simulate(selection, prices, [config]), root)
    found = B.summary(read_detail(spark, root).where(F.col("run_key") == key), benchmark, config)
    rows = found.select("run_key", "strategy_name", F.lit("done").alias("status"), F.lit(config.rebalance_mode).alias("rebalance_mode"), F.to_json(F.struct("total_return", "annual_return", "max_drawdown", "turnover", "transaction_cost", "trade_count", "benchmark_returns", "excess_returns")).alias("metrics"), "config")
    PointerTable(spark, f"{root.rstrip('/')}/backtest/summary").upsert(rows, SUMMARY_KEYS)
    files.write(f"backtest/state/{key}.json", {"run_key": key, "status": "done"}, overwrite=True)
    return "done"
