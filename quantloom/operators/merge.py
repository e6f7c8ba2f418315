"""Keyed merges, set comparison and order-free checksums."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``existing`` whose key does not come in, and all that comes in."""
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; ties go by the row's contents, so the outcome does not depend on the rows' order."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    tie = [F.desc(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}))] if rest else []
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order], *tie)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*(order or keys))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert_keep_last(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``upsert`` after keeping the last row of each key on both sides, by ``order``."""
    return upsert(keep_last(existing, keys, order), keep_last(incoming, keys, order), keys)


def replace_scope(existing: DataFrame, incoming: DataFrame, scope: Column) -> DataFrame:
    """Drop what lies in the scope, keep the rest, add what comes in."""
    return existing.where(~F.coalesce(scope, F.lit(False))).unionByName(incoming)


def upsert_counts(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """One row: inserted, updated, unchanged, kept.  Nulls are equal to nulls."""
    values = [c for c in incoming.columns if c not in keys]
    a = existing.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.struct(*values).alias("__old"), F.lit(True).alias("__a"))
    b = incoming.select(*keys, F.struct(*values).alias("__new"), F.lit(True).alias("__b"))
    on = reduce(lambda x, y: x & y, [F.col(f"__k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)])
    both = a.join(b, on, "full_outer")
    same = F.col("__old").eqNullSafe(F.col("__new"))
    here, there = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    return both.agg(F.count_if(~here & there).alias("inserted"), F.count_if(here & there & ~same).alias("updated"), F.count_if(here & there & same).alias("unchanged"), F.count_if(here & ~there).alias("kept"))


def rows_equal(columns: list[str], left: str = "l", right: str = "r") -> Column:
    """Null-safe equality of all columns of two aliased frames."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def concat_history(frames: list[DataFrame], date: str, keys: list[str]) -> DataFrame:
    """Union of partitions; a row after the date or a repeated key raises, found in one job before the union is returned."""
    both = union_all(frames)
    counts = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("trade_date") > date).alias("late"))
    found = counts.agg(F.coalesce(F.sum("late"), F.lit(0)).alias("late"), F.count_if(F.col("n") > 1).alias("twice")).first()
    if found["late"]:
        raise ValueError(f"{found['late']} rows lie after {date}")
    if found["twice"]:
        raise ValueError(f"repeated key: {', '.join(keys)}")
    return both


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side that the other lacks, with the side that has them."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def key_audit(factor: DataFrame, eligible: DataFrame, inputs: DataFrame, risk: DataFrame) -> DataFrame:
    """One row of counts; all zero when the key sets agree and every eligible key is eligible in the risk table."""
    return _key_sets(factor, eligible, inputs, risk).agg(*_key_faults())


def key_audits(factor: DataFrame, eligible: DataFrame, inputs: DataFrame, risk: DataFrame) -> dict[str, dict[str, int]]:
    """``key_audit`` of every date that any of the tables has, in one job."""
    return {r["trade_date"]: {k: v for k, v in r.asDict().items() if k != "trade_date"} for r in _key_sets(factor, eligible, inputs, risk).groupBy("trade_date").agg(*_key_faults()).collect()}


def _key_faults() -> list[Column]:
    has = lambda m: F.array_contains("s", m)
    return [
        F.count_if(has("f") & ~has("e")).alias("factor_not_eligible"),
        F.count_if(has("e") & ~has("f")).alias("eligible_not_factor"),
        F.count_if(has("e") & ~has("i")).alias("eligible_not_input"),
        F.count_if(has("i") & ~has("e")).alias("input_not_eligible"),
        F.count_if(has("e") & ~has("r")).alias("eligible_not_in_risk"),
    ]


def _key_sets(factor: DataFrame, eligible: DataFrame, inputs: DataFrame, risk: DataFrame) -> DataFrame:
    keys = ["stock_code", "trade_date"]
    marks = [("f", factor), ("e", eligible), ("i", inputs)]
    rows = union_all([df.select(*keys).distinct().withColumn("m", F.lit(m)) for m, df in marks] + [risk.where("is_eligible").select(*keys).distinct().withColumn("m", F.lit("r"))])
    return rows.groupBy(*keys).agg(F.collect_set("m").alias("s"))


def _sums(df: DataFrame) -> list[Column]:
    """Number of rows and sums of parts of the rows' hashes: the same in any order of rows and columns."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    return [F.count(F.lit(1)).alias("n"), *[F.sum(F.conv(row.substr(1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"h{i}") for i in range(5)]]


def _checksum(df: DataFrame, found) -> tuple[int, str]:
    text = ";".join([",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(df.schema.fields, key=lambda f: f.name)), str(found["n"]), *[str(found[f"h{i}"]) for i in range(5)]])
    return int(found["n"]), hashlib.sha256(text.encode()).hexdigest()


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """(rows, checksum) of a frame, whatever the order of rows and columns; summed on the executors."""
    return _checksum(df, df.agg(*_sums(df)).first())


def fingerprints(df: DataFrame, by: str) -> dict[str, tuple[int, str]]:
    """``fingerprint`` of the rows of each value of a column, in one job; the driver gets a row for each value."""
    return {r[by]: _checksum(df, r) for r in df.groupBy(by).agg(*_sums(df)).collect()}
