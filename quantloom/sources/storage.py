"""Partitioned Parquet datasets: scans with pruning, ad-hoc SQL, atomic partition writes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..functions.driver import check_date, check_key
from ..schemas import conform, dataset

SMOKE = ("daily_price_raw_smoke",)


class Store:
    """Datasets below one root: ``<zone>/<dataset>/trade_date=YYYY-MM-DD/``.

    Partition values stay strings (spark.sql.sources.partitionColumnTypeInference.enabled=false).
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{dataset(name).zone}/{name}"

    def _scan(self, name: str) -> DataFrame:
        """All partitions; a dataset without a date of its own gets the partition's as trade_date."""
        schema = dataset(name).schema
        if "trade_date" not in dataset(name).names:
            schema = schema.add("trade_date", "string")
        try:
            return self.spark.read.schema(schema).parquet(self.path(name))
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(f"{name}: no partition") from e
            raise

    def read(self, name: str, date: str) -> DataFrame:
        """One partition; an absent one is an error."""
        found = self._scan(name).where(f"trade_date = '{check_date(date)}'")
        if found.isEmpty():
            raise FileNotFoundError(f"{name}: no partition {date}")
        return found

    def history(self, name: str, date: str) -> DataFrame:
        """All partitions up to the date."""
        return self._scan(name).where(f"trade_date <= '{check_date(date)}'")

    def between(self, name: str, start: str, end: str) -> DataFrame:
        """Partitions in [start, end]; days without one are simply absent."""
        return self._scan(name).where(f"trade_date between '{check_date(start)}' and '{check_date(end)}'")

    def write(self, df: DataFrame, name: str) -> None:
        """Replace exactly the partitions that ``df`` has rows for."""
        rows = conform(df, name)
        if "trade_date" not in rows.columns:
            rows = conform(df, name, "trade_date")
        rows = rows.repartition("trade_date")  # one file a partition
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date").parquet(self.path(name))

    def write_smoke(self, df: DataFrame, provider: str, name: str) -> str:
        """Raw provider rows, kept apart from the datasets."""
        if name not in SMOKE:
            raise ValueError(f"not a smoke dataset: {name}")
        path = f"{self.root}/smoke/{check_key(provider)}/{name}"
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date").parquet(path)
        return path


def scratch_root(spark: SparkSession) -> str:
    """A new folder that every node sees: below spark.checkpoint.dir, or a local one where one machine runs all of Spark."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quantloom-")
    return f"{found.rstrip('/')}/store-{uuid.uuid4().hex}"


#: Makes Spark delete the shuffle files of a job when the job is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, name: str) -> DataFrame:
    """The rows, stored in a scratch folder and read again; the job's shuffle files go when it is done, so steps do not add up on disk."""
    spark = df.sparkSession
    path, before = f"{scratch_root(spark)}/{name}", spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that ``keep`` returned; nothing may read it afterwards."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def query_parquet(spark: SparkSession, path: str, sql: str | None = None, limit: int | None = None) -> DataFrame:
    """SQL over the files at ``path``, which the text calls ``dataset``; all rows without a text."""
    df = spark.read.parquet(path)
    out = spark.sql(sql, dataset=df) if sql else df
    return out if limit is None else out.limit(limit)


def stock_prices(prices: DataFrame, code: str, start: str, end: str) -> DataFrame:
    """Bars of one stock in order; the values are bound, not pasted."""
    return prices.sparkSession.sql(
        "SELECT * FROM {prices} WHERE stock_code = :code AND trade_date BETWEEN :start AND :end ORDER BY trade_date, stock_code",
        args={"code": code, "start": start, "end": end},
        prices=prices,
    )
