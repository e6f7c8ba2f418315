"""What a batch of provider rows must show before anything is written: coverage, evidence, ordered reasons.

Every report is a frame: one row a date, an interface or an input, with its
reasons in the order in which they block.  Verdicts are aggregations over keys,
so a report over all codes and dates costs a join by key and an aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CODE_PATTERN
from .merge import union_all, upsert_keep_last

KEYS = ["stock_code", "trade_date"]
# Names of scopes, states and reasons in the reports.
FULL_MARKET, FULL_UNIVERSE, PARTIAL, UNKNOWN = "DATE_FULL_MARKET_EVENT_SET", "CODE_DATE_EXPLICIT_FULL_UNIVERSE", "PARTIAL", "UNKNOWN"
MARKET_STRATEGY = "by_trade_date_full_market_event_set"
EMPTY_RETRIES, INCOMPLETE = "PROVIDER_EMPTY_AFTER_RETRIES", "PROVIDER_FETCH_INCOMPLETE"
EVENT_REASONS = (
    "SUSPEND_D_QUERY_SCOPE_UNKNOWN", "SUSPEND_D_PARTIAL_UNIVERSE_COVERAGE", "SUSPEND_D_PROVIDER_EMPTY_AFTER_RETRIES", "SUSPEND_D_PROVIDER_FETCH_INCOMPLETE",
    "SUSPEND_D_PROVIDER_FETCH_FAILED", "SUSPEND_D_SCHEMA_INCOMPLETE", "SUSPEND_D_PAGINATION_OR_TRUNCATION_UNKNOWN",
)
COVERAGE_REASONS = {"daily": "INCOMPLETE_DAILY_COVERAGE", "stk_limit": "INCOMPLETE_LIMIT_PRICE_COVERAGE", "adj_factor": "INCOMPLETE_ADJ_FACTOR_COVERAGE", "daily_basic": "INCOMPLETE_DAILY_BASIC_COVERAGE"}
SNAPSHOT_SEMANTICS, INTERVAL_SEMANTICS = "POINT_IN_TIME_HISTORICAL_SNAPSHOT", "HISTORICAL_INTERVAL_SOURCE"


def reason_list(checks: list[tuple[Column, str]]) -> Column:
    """The reasons whose condition holds, in order and without repeats; a null condition does not hold."""
    return F.array_distinct(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in checks]), lambda x: x.isNotNull()))


# --- event evidence ----------------------------------------------------------------


def event_coverage(days: DataFrame, calls: DataFrame, errors: DataFrame, events: DataFrame, universe: DataFrame, schema_missing: bool = False, truncated: bool = False) -> DataFrame:
    """One row a date: query scope, fetch state, meaning of an empty answer, and whether a miss there is a false candidate.

    ``calls``: trade_date, stock_code (null for the whole market), strategy,
    source.  ``errors``: trade_date, reason, fatal.  ``universe``: stock_code.
    """
    asked = calls.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("source") == "provider").alias("provider_calls"),
        F.count_if((F.col("source") == "provider") & (F.col("strategy") == MARKET_STRATEGY) & F.col("stock_code").isNull()).alias("market_calls"),
    )
    coded = calls.where("source = 'provider' and stock_code is not null").select("trade_date", F.upper("stock_code").alias("stock_code")).distinct()
    inside = universe.select("stock_code").distinct().withColumn("__in", F.lit(True))
    coded = coded.join(inside, "stock_code", "left").groupBy("trade_date").agg(F.count("__in").alias("codes_in"), F.count_if(F.col("__in").isNull()).alias("codes_out"))
    size = universe.select("stock_code").distinct().agg(F.count(F.lit(1)).alias("__size"))
    failed = errors.groupBy("trade_date").agg(F.count(F.lit(1)).alias("errors"), F.count_if(F.col("reason") == EMPTY_RETRIES).alias("empties"), F.count_if(F.col("reason") == INCOMPLETE).alias("incompletes"), F.count_if("fatal").alias("fatals"))
    hits = events.groupBy("trade_date").agg(F.count(F.lit(1)).alias("row_count"))
    out = days.select("trade_date").distinct().join(asked, "trade_date", "left").join(coded, "trade_date", "left").join(failed, "trade_date", "left").join(hits, "trade_date", "left")
    out = out.join(F.broadcast(size), F.lit(True)).fillna(0)  # one row
    scope = (
        F.when(F.col("provider_calls") == 0, UNKNOWN)
        .when(F.col("market_calls") > 0, FULL_MARKET)
        .when((F.col("codes_in") == F.col("__size")) & (F.col("codes_out") == 0), FULL_UNIVERSE)
        .when(F.col("codes_in") + F.col("codes_out") > 0, PARTIAL)
        .otherwise(UNKNOWN)
    )
    out = out.withColumn("query_scope_mode", scope)
    holds = [F.col("query_scope_mode") == UNKNOWN, F.col("query_scope_mode") == PARTIAL, F.col("empties") > 0, F.col("incompletes") > 0, F.col("fatals") > 0, F.lit(schema_missing), F.lit(truncated)]
    out = out.withColumn("blocked_reasons", reason_list(list(zip(holds, EVENT_REASONS))))
    full = F.col("query_scope_mode").isin(FULL_MARKET, FULL_UNIVERSE) & (F.size("blocked_reasons") == 0)
    status = F.when((F.col("empties") > 0) | (F.col("incompletes") > 0), "INCOMPLETE").when(F.col("errors") > 0, "FAILED").when(F.col("calls") > 0, "SUCCESS").otherwise(UNKNOWN)
    out = out.withColumn("miss_is_false", full).withColumn("fetch_status", status)
    empty = F.when(F.col("empties") > 0, "EMPTY_AFTER_RETRIES").when(F.col("row_count") > 0, "NOT_EMPTY").when((F.col("fetch_status") == "SUCCESS") & full, "VALID_EMPTY_EVENT_SET").otherwise(UNKNOWN)
    return out.withColumn("empty_semantics", empty).select("trade_date", "query_scope_mode", "fetch_status", "row_count", "empty_semantics", "miss_is_false", "blocked_reasons")


def event_coverage_status(coverage: DataFrame) -> DataFrame:
    """One row: status of all dates, their common scope, dates that confirm a miss."""
    n, ok = F.count(F.lit(1)), F.count_if("miss_is_false")
    broken = F.count_if(F.col("fetch_status").isin("FAILED", "INCOMPLETE"))
    partial = F.count_if(F.array_contains("blocked_reasons", EVENT_REASONS[1]))
    modes = F.collect_set("query_scope_mode")
    status = F.when(n == 0, UNKNOWN).when(ok == n, "CONFIRMED").when(broken > 0, "FAILED").when((ok > 0) | (partial > 0), PARTIAL).otherwise(UNKNOWN)
    scope = F.when(F.size(modes) == 1, F.get(modes, 0)).when((F.size(modes) == 0) | (F.array_contains(modes, UNKNOWN) & ~F.array_contains(modes, PARTIAL)), UNKNOWN).otherwise(PARTIAL)
    return coverage.agg(status.alias("status"), scope.alias("query_scope_mode"), n.alias("dates"), ok.alias("confirmed_dates"))


def pause_resolution(expected: DataFrame, events: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: expected pairs that an event, a confirmed miss or nothing resolves."""
    hits = events.select(*KEYS).distinct().withColumn("__event", F.lit(True))
    sure = coverage.where("miss_is_false").select("trade_date").distinct().withColumn("__whole", F.lit(True))
    rows = expected.select(*KEYS).distinct().join(hits, KEYS, "left").join(sure, "trade_date", "left")
    event, whole = F.col("__event").isNotNull(), F.col("__whole").isNotNull()
    return rows.agg(F.count_if(event).alias("true_candidate"), F.count_if(~event & whole).alias("false_candidate"), F.count_if(~event & ~whole).alias("unknown"))


# --- batches ------------------------------------------------------------------------


def batch_coverage(expected: DataFrame, interfaces: dict[str, DataFrame]) -> DataFrame:
    """(interface, expected, matched, missing, unexpected, surplus_rows): all interfaces in one join by key."""
    rows = [df.select(*KEYS, F.lit(n).alias("interface")) for n, df in interfaces.items()]
    have = union_all(rows).groupBy(*KEYS, "interface").agg(F.count(F.lit(1)).alias("n"))
    names = F.explode(F.array(*[F.lit(n) for n in interfaces]))
    want = expected.select(*KEYS).distinct().withColumn("interface", names).withColumn("e", F.lit(True))
    joined = want.join(have, [*KEYS, "interface"], "full_outer")
    e, o = F.col("e").isNotNull(), F.col("n").isNotNull()
    return joined.groupBy("interface").agg(F.count_if(e).alias("expected"), F.count_if(e & o).alias("matched"), F.count_if(e & ~o).alias("missing"), F.count_if(o & ~e).alias("unexpected"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"))


def _facts(coverage: DataFrame, batch: DataFrame) -> DataFrame:
    """One row of what the gates look at: coverage by interface, surplus rows, unresolved pauses."""
    by = [F.coalesce(F.max(F.when(F.col("interface") == n, F.col("matched") < F.col("expected"))), F.lit(True)).alias(f"short_{n}") for n in COVERAGE_REASONS]
    return coverage.agg(*by, F.coalesce(F.sum("surplus_rows") > 0, F.lit(False)).alias("surplus")).join(F.broadcast(batch.agg(F.count_if(F.col("pause_status") == "unknown").alias("unresolved"))), F.lit(True))


def preflight(coverage: DataFrame, batch: DataFrame, event_status: str, errors: DataFrame, missing_fields: bool = False) -> DataFrame:
    """One row: READY_FOR_PROMOTION_VALIDATOR or BLOCKED, with the reasons in order."""
    failed = errors.agg(F.count(F.lit(1)).alias("errors"), F.count_if(F.col("reason") == EMPTY_RETRIES).alias("empties"))
    checks = [(F.col(f"short_{n}"), r) for n, r in COVERAGE_REASONS.items()]
    checks += [(F.col("empties") > 0, EMPTY_RETRIES), (F.col("errors") > 0, INCOMPLETE), (F.lit(event_status != "CONFIRMED"), "SUSPEND_D_FULL_COVERAGE_NOT_CONFIRMED"), (F.col("unresolved") > 0, "UNRESOLVED_IS_PAUSED"), (F.lit(missing_fields), "CANDIDATE_SCHEMA_INCOMPATIBLE_WITH_DAILY_PRICE_CONTRACT")]
    out = _facts(coverage, batch).join(F.broadcast(failed), F.lit(True)).select(reason_list(checks).alias("blocked_reasons"))
    return out.select(F.when(F.size("blocked_reasons") == 0, "READY_FOR_PROMOTION_VALIDATOR").otherwise("BLOCKED").alias("status"), "blocked_reasons")


def dq3_audit(coverage: DataFrame, batch: DataFrame, full_events: bool, errors: DataFrame, missing_fields: bool = False, truncated: bool = False) -> DataFrame:
    """One row: what keeps a candidate batch from promotion; never ready, since the standard validator is another step."""
    failed = errors.agg(F.count(F.lit(1)).alias("errors"), F.count_if(F.col("reason") == EMPTY_RETRIES).alias("empties"))
    checks = [(F.col(f"short_{n}"), r) for n, r in COVERAGE_REASONS.items()]
    checks += [(F.lit(truncated), "SAMPLE_TRUNCATED"), (F.lit(truncated), INCOMPLETE), (F.col("surplus"), "DUPLICATE_KEYS_FOUND"), (F.lit(missing_fields), "SCHEMA_MISMATCH"), (F.col("empties") > 0, EMPTY_RETRIES), (F.col("errors") > 0, INCOMPLETE)]
    checks += [(F.col("unresolved") > 0, "UNRESOLVED_IS_PAUSED"), (F.lit(not full_events), "INCOMPLETE_OR_UNKNOWN_SUSPEND_D_COVERAGE")]
    later = F.array(F.lit("VALIDATOR_PRECHECK_NOT_RUN"), F.lit("DQ_LEVEL_BELOW_DQ3"))
    out = _facts(coverage, batch).join(F.broadcast(failed), F.lit(True)).withColumn("r", reason_list(checks))
    short = reduce(lambda a, b: a | b, [F.col(f"short_{n}") for n in COVERAGE_REASONS])
    return out.select(F.when(F.size("r") == 0, later).otherwise(F.col("r")).alias("blocked_reasons"), (~short).alias("price_coverage_complete"), F.lit(False).alias("ready_for_dq3_promotion"))


def dry_run_candidate(daily: DataFrame, limits: DataFrame, factors: DataFrame, daily_basic: DataFrame, calendar: DataFrame) -> DataFrame:
    """Quotes with limits, factor and valuation by left joins and the calendar's word on the day; nothing is said about pauses."""
    out = daily
    for side, columns in ((limits, ["limit_up", "limit_down"]), (factors, ["adj_factor"]), (daily_basic, ["pe_ttm", "pb", "turnover_rate"])):
        out = out.join(side.select(*KEYS, *columns), KEYS, "left")
    days = calendar.select(F.col("cal_date").alias("trade_date"), (F.col("is_open").try_cast("int") == 1).alias("is_open")).distinct()
    return out.join(days, "trade_date", "left").withColumn("is_open", F.coalesce("is_open", F.lit(False))).withColumn("is_paused", F.lit(None).cast("boolean"))


def suspension_candidate(expected: DataFrame, events: DataFrame) -> DataFrame:
    """Each expected pair with its event, if it has one: a hit is a true candidate, a miss says nothing."""
    hits = events.select(*KEYS, "suspend_type").dropDuplicates(KEYS)
    out = expected.select(*KEYS).join(hits, KEYS, "left")
    hit = F.col("suspend_type").isNotNull()
    return out.withColumn("pause_status", F.when(hit, "true_candidate").otherwise("unknown")).withColumn("evidence", F.when(hit, "suspend_d_match").otherwise("unresolved_no_event_match"))


def paused_by_event(daily: DataFrame, events: DataFrame) -> DataFrame:
    """Add is_paused: the key is among the events'."""
    hits = events.select(*KEYS).distinct().withColumn("__event", F.lit(True))
    return daily.drop("is_paused").join(hits, KEYS, "left").withColumn("is_paused", F.col("__event").isNotNull()).drop("__event")


class ScopeTooLarge(ValueError):
    """A small batch is larger than its limits."""


def check_scope(codes: list[str], dates: list[str], max_codes: int = 5, max_days: int = 10, max_rows: int = 50) -> None:
    """Refuse a small batch over its limits, before any work."""
    for name, n, most in (("codes", len(set(codes)), max_codes), ("days", len(set(dates)), max_days), ("rows", len(set(codes)) * len(set(dates)), max_rows)):
        if n > most:
            raise ScopeTooLarge(f"{n} {name}, at most {most}")


def small_batch(existing: DataFrame, candidates: DataFrame, codes: list[str], dates: list[str], **limits) -> DataFrame:
    """Promote the candidates of a few codes and dates into ``existing``; everything else stays as it is."""
    from .candidate import promote, scope

    check_scope(codes, dates, **limits)
    return promote(existing, scope(candidates, codes, dates))


# --- standard inputs ------------------------------------------------------------------


def standard_input_faults(daily_basic: DataFrame, financial: DataFrame, codes: list[str], dates: list[str]) -> DataFrame:
    """(dataset, reason, n) of what stops the landing: missing or surplus pairs, disclosures after the scope's start."""
    spark = daily_basic.sparkSession
    want = spark.createDataFrame([(c, d) for c in sorted(set(codes)) for d in sorted(set(dates))], "stock_code string, trade_date string")
    rows = batch_coverage(want, {"daily_basic": daily_basic.where(F.col("trade_date").isin(dates))})
    first = F.lit(min(dates))
    late = financial.where(F.col("stock_code").isin(codes)).agg(F.count_if(F.col("announce_date") > first).alias("late"), F.count_if(~F.col("stock_code").rlike(CODE_PATTERN)).alias("codes"))
    parts = [rows.select(F.lit("daily_basic").alias("dataset"), F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(c).alias("n")) for r, c in (("DAILY_BASIC_MISSING_PAIR", "missing"), ("DAILY_BASIC_UNEXPECTED_PAIR", "unexpected"), ("DAILY_BASIC_DUPLICATE_PAIR", "surplus_rows"))])).alias("x"))]
    parts.append(late.select(F.lit("financial").alias("dataset"), F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(c).alias("n")) for r, c in (("FINANCIAL_ANNOUNCE_DATE_AFTER_SCOPE_START", "late"), ("FINANCIAL_CODE", "codes"))])).alias("x")))
    return union_all(parts).select("dataset", "x.reason", "x.n")


def land_financial(existing: DataFrame, incoming: DataFrame, dates: list[str]) -> DataFrame:
    """For each date the stored disclosures, brought up to date by those announced by then: (as_of, disclosure)."""
    keys = ["as_of", "stock_code", "report_period", "announce_date"]
    each = F.explode(F.array(*[F.lit(d) for d in sorted(set(dates))]))
    upto = lambda df: df.withColumn("as_of", each).where(F.col("announce_date") <= F.col("as_of"))
    order = [c for c in incoming.columns if c not in keys]
    return upsert_keep_last(upto(existing), upto(incoming), keys, order)


def first_source(sources: list[tuple[str, DataFrame]], dates: DataFrame) -> DataFrame:
    """Rows of each date from the first source that has any, with its name as ``source``: staging, then earlier staging, then canonical."""
    rows = union_all([df.withColumn("source", F.lit(n)).withColumn("__rank", F.lit(i)) for i, (n, df) in enumerate(sources)])
    rows = rows.join(dates.select("trade_date").distinct(), "trade_date", "left_semi")
    best = rows.groupBy("trade_date").agg(F.min("__rank").alias("__best"))
    return rows.join(best, "trade_date").where("__rank = __best").drop("__rank", "__best")


def input_readiness(expected: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
    """(input, expected, rows, missing, surplus_rows, ready): inputs by code and date against the pairs that they must have."""
    found = batch_coverage(expected, inputs)
    return found.select(F.col("interface").alias("input"), "expected", F.col("matched").alias("rows"), "missing", "surplus_rows", ((F.col("missing") == 0) & (F.col("surplus_rows") == 0) & (F.col("expected") > 0)).alias("ready"))


def missing_pairs(expected: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
    """(input, stock_code, trade_date) of every pair that an input lacks."""
    want = expected.select(*KEYS).distinct().withColumn("input", F.explode(F.array(*[F.lit(n) for n in inputs])))
    have = union_all([df.select(*KEYS, F.lit(n).alias("input")) for n, df in inputs.items()])
    return want.join(have, [*KEYS, "input"], "left_anti").select("input", *KEYS)


# --- proofs -----------------------------------------------------------------------------


def _counts(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(rule, n) of rows that break each rule."""
    row = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(r) for r, c in checks.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in checks])).alias("x")).select("x.rule", "x.n")


def snapshot_proof_faults(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """(rule, n) of a point-in-time master: its proof columns, membership on the day, and rows that the upstream evidence has otherwise.

    ``rows``: stock_basic with source_snapshot_date, source_object_key and
    source_semantics; ``evidence``: stock_basic as it was read upstream.
    """
    names = [c for c in evidence.columns if c in rows.columns and not c.startswith("source_")]
    differ = rows.select(*names).exceptAll(evidence.select(*names)).unionByName(evidence.select(*names).exceptAll(rows.select(*names)))
    key = F.coalesce(F.trim("source_object_key"), F.lit(""))
    checks = {
        "semantics": ~F.coalesce(F.col("source_semantics") == SNAPSHOT_SEMANTICS, F.lit(False)),
        "snapshot_date": ~F.coalesce(F.col("source_snapshot_date") == F.col("trade_date"), F.lit(False)),
        "source_key": (key == "") | key.rlike(r"(^/)|(\\)|(\.\.)|(^|/)(current|latest)(/|$)"),
        "listed_later": F.col("list_date") > F.col("trade_date"),
        "delisted": F.col("delist_date") <= F.col("trade_date"),
    }
    return _counts(rows, checks).unionByName(differ.agg(F.count(F.lit(1)).alias("n")).select(F.lit("evidence").alias("rule"), "n"))


def interval_proof_faults(rows: DataFrame, start: str, end: str) -> DataFrame:
    """(rule, n) of ST intervals with their coverage columns: nothing of today may stand for history."""
    checks = {
        "semantics": ~F.coalesce(F.col("source_semantics") == INTERVAL_SEMANTICS, F.lit(False)),
        "coverage": ~F.coalesce("coverage_complete", F.lit(False)),
        "coverage_dates": (F.col("coverage_start_date") > start) | (F.col("coverage_end_date") < end),
        "coverage_code": ~F.array_contains(F.transform(F.split("coverage_codes", ","), lambda x: F.trim(x)), F.col("stock_code")),
        "current_source": F.lower("source").rlike("current|latest") | F.upper("st_type").rlike("CURRENT"),
        "interval": F.col("end_date") <= F.col("start_date"),
    }
    keys = ["stock_code", "st_type", "start_date", "source"]
    surplus = rows.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate_keys").alias("rule"), "n")
    return _counts(rows, checks).unionByName(surplus)


def financial_state_faults(financial: DataFrame, date: str) -> DataFrame:
    """(rule, n) of a point-in-time state of disclosures: finite numbers, period <= announcement <= date, one row a key."""
    numbers = [c for c, t in financial.dtypes if t == "double"]
    infinite = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in numbers])
    checks = {"finite": infinite, "period_after_announcement": F.col("report_period") > F.col("announce_date"), "announced_later": F.col("announce_date") > date}
    surplus = financial.groupBy("stock_code", "report_period", "announce_date").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate_keys").alias("rule"), "n")
    return _counts(financial, checks).unionByName(surplus)


def axis_faults(expected: DataFrame, observed: DataFrame, suspended: DataFrame | None = None) -> DataFrame:
    """(fault, stock_code, trade_date): pairs that are missing or surplus against the exact axis, and suspensions outside of it.

    ``suspended``: pairs that quotes leave out because the stock was suspended.
    """
    want = expected.select(*KEYS).distinct()
    have = observed.select(*KEYS).distinct()
    parts = []
    if suspended is not None:
        out = suspended.select(*KEYS).distinct()
        parts.append(out.join(want, KEYS, "left_anti").select(F.lit("suspension_outside").alias("fault"), *KEYS))
        want = want.join(out, KEYS, "left_anti")
    parts.append(want.join(have, KEYS, "left_anti").select(F.lit("missing").alias("fault"), *KEYS))
    parts.append(have.join(want, KEYS, "left_anti").select(F.lit("surplus").alias("fault"), *KEYS))
    return union_all(parts)


def history_faults(stock_basic: DataFrame, financial: DataFrame, st_history: DataFrame, start: str, end: str) -> DataFrame:
    """(rule, n) of provider history: dates of a stock that differ between snapshots, announcements outside the window, intervals out of scope."""
    w = Window.partitionBy("stock_code")
    masters = stock_basic.withColumn("lists", F.size(F.collect_set("list_date").over(w))).withColumn("delists", F.size(F.collect_set("delist_date").over(w)))
    one = _counts(masters, {"list_date_changes": F.col("lists") > 1, "delist_date_changes": F.col("delists") > 1, "delist_before_list": F.col("delist_date") <= F.col("list_date")})
    two = _counts(financial, {"announced_before": F.col("announce_date") < start, "announced_after": F.col("announce_date") > end})
    three = _counts(st_history, {"st_after_scope": F.col("start_date") > end, "st_before_scope": F.col("end_date") <= start})
    return union_all([one, two, three])


def empty_is_proven(dataset: str, *, open_days: int = 0, coverage_complete: bool = False, source_keys: tuple = (), members: int | None = None) -> bool:
    """Whether a provider's empty answer may stand: a closed market, ST intervals or disclosures with complete lineage, or a window without any member."""
    lineage = coverage_complete and bool(source_keys)
    if dataset in ("daily_price", "adj_factor", "daily_basic", "benchmark_price"):
        return open_days == 0
    if dataset in ("st_history", "financial"):
        return lineage
    return dataset == "stock_basic" and lineage and members == 0
