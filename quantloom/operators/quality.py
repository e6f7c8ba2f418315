"""Data-quality rules: each dataset's violations in one aggregation, and audit reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CODE_PATTERN, has_forbidden_word
from ..schemas import FACTORS, SCORES, dataset

INDEXES = ["000300.SH", "000905.SH", "000906.SH"]


class DataQualityError(ValueError):
    """A dataset breaks its rules."""


def _bad_date(c: str) -> Column:
    return F.col(c).isNotNull() & (~F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date(F.col(c), "yyyy-MM-dd").isNull())


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _order(low: str, high: str) -> Column:
    return F.col(low) > F.col(high)


def rules(name: str, date: str | None = None, strict: bool = False) -> dict[str, Column]:
    """Violations by rule name; true breaks the rule.  ``date`` bounds announce dates."""
    spec = dataset(name)
    found: dict[str, Column] = {}
    if "stock_code" in spec.names:
        found["stock_code"] = ~F.coalesce(F.col("stock_code").rlike(CODE_PATTERN), F.lit(False))
    for c in ("trade_date", "list_date", "delist_date", "report_period", "announce_date", "start_date", "end_date"):
        if c in spec.names:
            found[f"date:{c}"] = _bad_date(c) if c in spec.nullable else F.col(c).isNull() | _bad_date(c)
    positive = lambda *cs: _any(*[~(F.col(c) > 0) for c in cs])
    if name == "daily_price":
        found |= {
            "prices_positive": positive("open", "close", *(("high", "low", "pre_close") if strict else ())),
            "high_low": _order("low", "high"),
            "volume_amount": (F.col("volume") < 0) | (F.col("amount") < 0),
            "limits": _order("close", "limit_up") | _order("limit_down", "close"),
        }
        if strict:
            found["ohlc_order"] = _order("open", "high") | _order("close", "high") | _order("low", "open") | _order("low", "close")
    elif name == "stock_basic":
        found |= {"delisted_before_listed": F.col("delist_date") <= F.col("list_date")}
    elif name == "adj_factor":
        found["positive"] = positive("adj_factor")
    elif name == "financial":
        found |= {"roe": F.col("roe").isNull(), "debt_ratio": F.col("debt_ratio").isNull() | ~F.col("debt_ratio").between(0, 1)}
        if date:
            found["visible"] = (F.col("announce_date") > date) | (F.col("report_period") > date)
    elif name == "st_history":
        found["interval"] = F.col("end_date") <= F.col("start_date")
    elif name == "benchmark_price":
        found |= {"prices_positive": positive("open", "high", "low", "close"), "high_low": _order("low", "high")}
    elif name == "adjusted_price":
        found |= {"prices_positive": positive("adj_open", "adj_high", "adj_low", "adj_close"), "high_low": _order("adj_low", "adj_high")}
    elif name == "clean_daily_snapshot":
        found |= {
            "prices_positive": positive("open", "high", "low", "close", "adj_open", "adj_high", "adj_low", "adj_close"),
            "high_low": _order("low", "high") | _order("adj_low", "adj_high"),
            "listed_days": F.col("listed_days") < 0,
            "visible": F.col("announce_date") > F.col("trade_date"),
        }
    elif name == "risk_filter":
        found |= {"text": F.col("exclude_reasons").isNull() | F.col("risk_flags").isNull(), "eligible": F.col("is_eligible") != (F.col("exclude_reasons") == "")}
    elif name == "eligible_universe":
        found["financials"] = F.col("roe").isNull() | F.col("debt_ratio").isNull()
    elif name == "factor_input_table":
        found["adj_close"] = positive("adj_close")
    elif name == "factor_daily":
        infinite = [F.col(c).isNotNull() & (F.isnan(c) | (F.abs(F.col(c)) == float("inf"))) for c in FACTORS]
        found |= {"finite": _any(*infinite), "scores": _any(*[F.col(c).isNull() | ~F.col(c).between(0, 100) for c in SCORES])}
    elif name == "selection_result":
        scores = [*SCORES, "total_score"]
        found |= {
            "scores": _any(*[F.col(c).isNull() | ~F.col(c).between(0, 100) for c in scores]),
            "risk_level": ~F.coalesce(F.col("risk_level").isin("low", "medium", "high"), F.lit(False)),
            "texts": F.coalesce(F.trim("reason"), F.lit("")).eqNullSafe("") | F.coalesce(F.trim("suggestion"), F.lit("")).eqNullSafe(""),
            "forbidden_words": has_forbidden_word("reason") | has_forbidden_word("suggestion"),
        }
    required = [c for c in spec.names if c not in spec.nullable]
    found["nulls"] = _any(*[F.col(c).isNull() for c in required])
    return found


#: Columns that a dataset must not have.
FORBIDDEN = {"factor_daily": ("total_score",)}


def violations(df: DataFrame, name: str, date: str | None = None, strict: bool = False) -> DataFrame:
    """(rule, n) for every rule of a dataset, the number of rows and of surplus rows by key; one aggregation and one for keys."""
    checks = rules(name, date, strict)
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(r) for r, c in checks.items()])
    labels = ["rows", *checks]
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").alias("n")) for r in labels])).alias("x")).select("x.rule", "x.n")
    surplus = df.groupBy(*dataset(name).keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate_keys").alias("rule"), "n")
    return long.unionByName(surplus)


def faults_by_date(df: DataFrame, name: str, dates: list[str], date: str | None = None, strict: bool = False) -> dict[str, list[str]]:
    """Broken rules of each of ``dates`` that has any: one aggregation by date, one by key; no rows count if the dataset may not be empty."""
    rows = df.where(F.col("trade_date").isin(dates))
    checks = rules(name, date, strict)
    if name == "selection_result":
        order = Window.partitionBy("trade_date").orderBy(F.desc("total_score"), "stock_code")
        rows = rows.withColumn("__place", F.row_number().over(order))
        checks["ranking"] = F.col("__place") != F.col("rank")
    counts = rows.groupBy("trade_date").agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(r) for r, c in checks.items()])
    twice = rows.groupBy("trade_date", *[k for k in dataset(name).keys if k != "trade_date"]).count().where("count > 1").groupBy("trade_date").agg(F.sum(F.col("count") - 1).alias("duplicate_keys"))
    found = {r["trade_date"]: r.asDict() for r in counts.join(twice, "trade_date", "left").collect()}
    out = {}
    for d in dates:
        if d not in found:
            broken = [] if dataset(name).may_be_empty else ["no rows"]
        else:
            broken = [f"{rule}: {found[d][rule]} rows" for rule in (*checks, "duplicate_keys") if found[d][rule]]
        if broken:
            out[d] = broken
    return out


def effective_factors(factors: DataFrame) -> dict[str, int]:
    """Number of factors with a value, by date."""
    some = reduce(lambda a, b: a + b, [(F.count(c) > 0).cast("int") for c in FACTORS])
    return {r["trade_date"]: r["n"] for r in factors.groupBy("trade_date").agg(some.alias("n")).collect()}


def validate(df: DataFrame, name: str, date: str | None = None, strict: bool = False, allow_empty: bool | None = None) -> None:
    """Raise DataQualityError with all broken rules."""
    missing = [c for c in dataset(name).names if c not in df.columns]
    if missing:
        raise DataQualityError(f"{name}: missing columns: {', '.join(missing)}")
    extra = [c for c in FORBIDDEN.get(name, ()) if c in df.columns]
    if extra:
        raise DataQualityError(f"{name}: columns that must not be there: {', '.join(extra)}")
    found = {r["rule"]: r["n"] for r in violations(df, name, date, strict).collect()}
    rows = found.pop("rows")
    broken = [f"{rule}: {n} rows" for rule, n in found.items() if n]
    if not rows and not (dataset(name).may_be_empty if allow_empty is None else allow_empty):
        broken.append("no rows")
    if name == "benchmark_price" and rows:
        have = {r[0] for r in df.select("index_code").distinct().collect()}  # a handful of indexes
        broken += [f"missing index {i}" for i in INDEXES if i not in have]
    if name == "selection_result" and rows and ranking_faults(df).first()["n"]:
        broken.append("ranking")
    if broken:
        raise DataQualityError(f"{name}: " + "; ".join(broken))


def ranking_faults(selection: DataFrame) -> DataFrame:
    """n: rows whose rank is not their place by total score, then code."""
    w = Window.partitionBy("trade_date").orderBy(F.desc("total_score"), "stock_code")
    return selection.withColumn("__r", F.row_number().over(w)).agg(F.count_if(F.col("__r") != F.col("rank")).alias("n"))


def exclusion_counts(risk: DataFrame) -> DataFrame:
    """(reason, n) over all rows."""
    parts = F.explode(F.split("exclude_reasons", ";")).alias("reason")
    return risk.where("exclude_reasons <> ''").select(parts).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rate): share of nulls rounded to eight places; 0 for no rows."""
    rates = df.agg(*[F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0)).alias(c) for c in columns])
    return rates.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.rint(F.col(c) * 1e8) / 1e8).alias("rate")) for c in columns])).alias("x")).select("x.column", "x.rate")


def factor_audit(factors: DataFrame, least: int = 15) -> DataFrame:
    """(factor, n, missing_rate, all_null, effective, enough): counts by factor and the gate on effective factors."""
    counts = factors.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in FACTORS])
    effective = reduce(lambda a, b: a + b, [(F.col(c) > 0).cast("long") for c in FACTORS])
    rows = counts.withColumn("effective", effective)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("n")) for c in FACTORS])).alias("x")
    return rows.select("rows", "effective", each).select("x.factor", "x.n", (1 - F.coalesce(F.try_divide("x.n", "rows"), F.lit(0.0))).alias("missing_rate"), (F.col("x.n") == 0).alias("all_null"), "effective", (F.col("effective") >= least).alias("enough"))


def history_coverage(adjusted: DataFrame, snapshot: DataFrame, date: str) -> DataFrame:
    """Per stock: bars, first bar, valuation rows and first, and whether the longest windows are short."""
    price = adjusted.where(F.col("trade_date") <= date).groupBy("stock_code").agg(F.count(F.lit(1)).alias("price_rows"), F.min("trade_date").alias("first_price"))
    value = snapshot.where(F.col("trade_date") < date).groupBy("stock_code").agg(F.count("pe_ttm").alias("valuation_rows"), F.min("trade_date").alias("first_valuation"))
    return price.join(value, "stock_code", "left").withColumn("valuation_rows", F.coalesce("valuation_rows", F.lit(0))).withColumn("short_trend", F.col("price_rows") <= 120).withColumn("short_valuation", F.col("valuation_rows") < 720)


def coverage_gaps(daily: DataFrame, factors: DataFrame, daily_basic: DataFrame, financial: DataFrame, basic: DataFrame, date: str) -> DataFrame:
    """(check, n): members of the date without an input, and priced codes without a master row."""
    from .clean import stock_basic_as_of, visible_financials

    active = stock_basic_as_of(basic, date).select("stock_code").distinct()
    on = lambda df: df.where(F.col("trade_date") == date).select("stock_code").distinct()
    inputs = {"daily_price": on(daily), "adj_factor": on(factors), "daily_basic": on(daily_basic), "financial": visible_financials(financial, date).select("stock_code").distinct()}
    parts = [active.join(codes, "stock_code", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"no_{name}").alias("check"), "n") for name, codes in inputs.items()]
    parts.append(on(daily).join(basic.select("stock_code").distinct(), "stock_code", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("no_master").alias("check"), "n"))
    parts.append(active.agg(F.count(F.lit(1)).alias("n")).select(F.lit("active").alias("check"), "n"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def gaps_by_date(daily: DataFrame, factors: DataFrame, daily_basic: DataFrame, financial: DataFrame, basic: DataFrame, dates: list[str]) -> dict[str, dict[str, int]]:
    """``coverage_gaps`` of several dates in one job: members of each date, those without an input, and priced codes without a master row."""
    from .clean import member_on

    spark = basic.sparkSession
    days = spark.createDataFrame([(d,) for d in dates], "trade_date string")
    # members of a date: as many rows as the dates' snapshots have
    active = basic.select("stock_code", "list_date", "delist_date").distinct().withColumn("trade_date", F.explode(F.array(*[F.lit(d) for d in dates]))).where(member_on()).select("stock_code", "trade_date").distinct()
    keys = ["stock_code", "trade_date"]
    out = active
    for name, df in (("daily_price", daily), ("adj_factor", factors), ("daily_basic", daily_basic)):
        out = out.join(df.where(F.col("trade_date").isin(dates)).select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left")
    known = financial.groupBy("stock_code").agg(F.min(F.greatest("announce_date", "report_period")).alias("known"))
    out = out.join(known, "stock_code", "left").withColumn("financial", F.col("known") <= F.col("trade_date"))
    names = ("daily_price", "adj_factor", "daily_basic", "financial")
    counts = out.groupBy("trade_date").agg(F.count(F.lit(1)).alias("active"), *[F.count_if(~F.coalesce(F.col(n), F.lit(False))).alias(f"no_{n}") for n in names])
    orphans = daily.where(F.col("trade_date").isin(dates)).select(*keys).distinct().join(basic.select("stock_code").distinct(), "stock_code", "left_anti").groupBy("trade_date").agg(F.count(F.lit(1)).alias("no_master"))
    rows = days.join(counts, "trade_date", "left").join(orphans, "trade_date", "left").fillna(0).collect()
    return {r["trade_date"]: {k: v for k, v in r.asDict().items() if k != "trade_date"} for r in rows}


def recomputation_faults(selection: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row: stored scores, risk levels and texts that the row itself does not give again."""
    from ..functions.scalars import reason, risk_level, suggestion

    total = reduce(lambda a, b: a + b, [F.col(c) * F.lit(w) for c, w in weights.items()])
    return selection.agg(
        F.count_if(F.abs(F.col("total_score") - total) > 5e-7).alias("total_score"),
        F.count_if(~F.col("risk_level").eqNullSafe(risk_level())).alias("risk_level"),
        F.count_if(~F.col("reason").eqNullSafe(reason())).alias("reason"),
        F.count_if(~F.col("suggestion").eqNullSafe(suggestion())).alias("suggestion"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys that repeat, and rows in them."""
    return df.groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows"))


def duplicate_examples(df: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """The first keys that repeat, with their number of rows: a short list for a report."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").orderBy(*keys).limit(most)


def index_coverage(benchmark: DataFrame, date: str, least: int = 121) -> DataFrame:
    """Per required index: bars up to the date, the first, and whether they are too few for the longest window."""
    asked = benchmark.sparkSession.createDataFrame([(c,) for c in INDEXES], "index_code string")
    have = benchmark.where(F.col("trade_date") <= date).groupBy("index_code").agg(F.count(F.lit(1)).alias("index_rows"), F.min("trade_date").alias("first_day"))
    return asked.join(have, "index_code", "left").withColumn("index_rows", F.coalesce("index_rows", F.lit(0))).withColumn("short", F.col("index_rows") < least)


def history_minima(coverage: DataFrame) -> DataFrame:
    """One row over ``history_coverage``: least numbers of rows, latest first days, stocks with short windows."""
    return coverage.agg(F.min("price_rows").alias("least_price_rows"), F.min("valuation_rows").alias("least_valuation_rows"), F.max("first_price").alias("latest_first_price"), F.count_if("short_trend").alias("short_trend"), F.count_if("short_valuation").alias("short_valuation"))


def index_change_faults(benchmark: DataFrame, rtol: float = 1e-6, atol: float = 1e-4) -> DataFrame:
    """n: rows whose pct_chg is not the change from pre_close."""
    want = (F.col("close") / F.col("pre_close") - 1) * 100
    bad = F.col("pre_close").isNull() | ~(F.col("pre_close") > 0) | (F.abs(F.col("pct_chg") - want) > atol + rtol * F.abs(want))
    return benchmark.agg(F.count_if(bad).alias("n"))
