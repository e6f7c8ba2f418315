"""Read-only queries over summary tables, with checked parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.driver import check_date
from .functions.scalars import json_number


@dataclass
class ApiError(Exception):
    """What a caller sees of a bad request: a code, a message, the path; no internals."""

    code: str
    message: str
    path: str = ""


def _page(limit: int, offset: int) -> tuple[int, int]:
    if not 1 <= limit <= 100:
        raise ApiError("INVALID_LIMIT", "limit must be between 1 and 100")
    if offset < 0:
        raise ApiError("INVALID_OFFSET", "offset must not be negative")
    return limit, offset


def _date(text: str) -> str:
    try:
        return check_date(text)
    except ValueError as e:
        raise ApiError("INVALID_DATE", "trade date must be YYYY-MM-DD") from e


def selections(table: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first."""
    limit, offset = _page(limit, offset)
    return table.orderBy(F.desc("trade_date"), F.desc("created_at"), F.desc("rebalance_mode")).offset(offset).limit(limit)


def selection(table: DataFrame, date: str, mode: str | None = None) -> DataFrame:
    """The newest snapshot of a date, of any mode unless one is named."""
    rows = table.where(F.col("trade_date") == _date(date))
    if mode is not None:
        rows = rows.where(F.col("rebalance_mode") == mode)
    return rows.orderBy(F.desc("created_at"), F.desc("rebalance_mode")).limit(1)


def backtests(table: DataFrame, status: str | None = None, mode: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first, with returns read from the metrics JSON."""
    limit, offset = _page(limit, offset)
    rows = table
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if mode is not None:
        rows = rows.where(F.col("rebalance_mode") == mode)
    rows = rows.withColumn("total_return", json_number("metrics", "$.total_return")).withColumn("annual_return", json_number("metrics", "$.annual_return", "$.annualized_return"))
    return rows.orderBy(F.desc("created_at"), F.desc("run_key")).offset(offset).limit(limit)


def backtest(table: DataFrame, run_key: str) -> DataFrame:
    if not re.fullmatch(r"[0-9a-f]{16}", run_key or ""):
        raise ApiError("INVALID_RUN_KEY", "run key must be 16 lower-case hex digits")
    return table.where(F.col("run_key") == run_key).limit(1)


def update_logs(table: DataFrame, date: str) -> DataFrame:
    return table.where(F.col("trade_date") == _date(date)).orderBy("step_name")


def task_logs(table: DataFrame, status: str | None = None, task_type: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    limit, offset = _page(limit, offset)
    rows = table
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if task_type is not None:
        rows = rows.where(F.col("task_type") == task_type)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def sql_rows(spark: SparkSession, table: str, equal: dict[str, str], newest: list[str], limit: int = 20, offset: int = 0) -> DataFrame:
    """Rows of a table or view by SQL: equal columns, newest first, a page; the values are bound, not pasted."""
    limit, offset = _page(limit, offset)
    names = spark.table(table).columns
    for c in (*equal, *newest):
        if c not in names:
            raise ApiError("INVALID_COLUMN", f"no such column: {c}")
    where = " AND ".join(f"`{c}` = :v{i}" for i, c in enumerate(equal)) or "true"
    order = ", ".join(f"`{c}` DESC" for c in newest)
    return spark.sql(f"SELECT * FROM IDENTIFIER(:t) WHERE {where} ORDER BY {order} LIMIT {limit} OFFSET {offset}", args={"t": table} | {f"v{i}": v for i, v in enumerate(equal.values())})


def health(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 1 AS ok")
