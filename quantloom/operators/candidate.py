"""Candidate batches: joins of provider tables, coverage, pause evidence, promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import keep_first, upsert

KEYS = ["stock_code", "trade_date"]


def project_aliases(df: DataFrame, aliases: dict[str, list[str]], optional: frozenset[str] = frozenset()) -> DataFrame:
    """For each target column the first alias that the frame has; else null, or nothing if it is optional."""
    columns = []
    for target, names in aliases.items():
        found = next((n for n in names if n in df.columns), None)
        if found:
            columns.append(F.col(found).alias(target))
        elif target not in optional:
            columns.append(F.lit(None).alias(target))
    return df.select(*columns)


def scope(df: DataFrame, codes: list[str] | None = None, dates: list[str] | None = None) -> DataFrame:
    if codes is not None:
        df = df.where(F.col("stock_code").isin(codes))
    return df if dates is None else df.where(F.col("trade_date").isin(dates))


def open_dates(calendar: DataFrame) -> DataFrame:
    return calendar.where(F.col("is_open").try_cast("int") == 1).select(F.col("cal_date").alias("trade_date")).distinct()


def expected_axis(basic: DataFrame, dates: DataFrame) -> DataFrame:
    """Members x open dates, by list and delist dates: (stock_code, trade_date)."""
    from .clean import LISTED

    days = [r[0] for r in dates.select("trade_date").distinct().orderBy("trade_date").limit(LISTED + 1).collect()]
    if len(days) > LISTED:
        raise ValueError(f"more than {LISTED} dates")
    # each member goes to the dates of its membership: rows of the output and no others
    each = F.filter(F.array(*[F.lit(d) for d in days]) if days else F.array().cast("array<string>"), lambda d: (F.col("list_date") <= d) & (F.col("delist_date").isNull() | (F.col("delist_date") > d)))
    return basic.select("stock_code", "list_date", "delist_date").distinct().select("stock_code", F.explode(each).alias("trade_date")).distinct()


def candidate_batch(daily: DataFrame, limits: DataFrame, factors: DataFrame, daily_basic: DataFrame, events: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Quotes with limits, factor, valuation and pause evidence, each right side cut to the first row of its key.

    pause_status: true_candidate for an event, false_candidate for none on a
    date that ``covered`` (trade_date) proves whole, else unknown; never
    inferred from quotes.
    """
    order = lambda df: [c for c in df.columns if c not in KEYS]
    out = daily
    for side in (limits, factors, daily_basic):
        out = out.join(keep_first(side, KEYS, order(side)), KEYS, "left")
    hits = events.select(*KEYS).distinct().withColumn("__event", F.lit(True))
    out = out.join(hits, KEYS, "left")
    if covered is None:
        out = out.withColumn("__whole", F.lit(False))
    else:
        out = out.join(covered.select("trade_date").distinct().withColumn("__whole", F.lit(True)), "trade_date", "left")
    status = F.when(F.col("__event"), "true_candidate").when(F.col("__whole"), "false_candidate").otherwise("unknown")
    paused = F.when(F.col("__event"), F.lit(True)).when(F.col("__whole"), F.lit(False))
    return out.withColumn("pause_status", status).withColumn("is_paused_candidate", paused).drop("__event", "__whole")


def coverage(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """One row: expected, matched, missing, unexpected and the rate (0 for nothing expected)."""
    e, o = expected.select(*KEYS).distinct().withColumn("e", F.lit(True)), observed.select(*KEYS).distinct().withColumn("o", F.lit(True))
    counts = e.join(o, KEYS, "full_outer").agg(
        F.count("e").alias("expected"),
        F.count_if(F.col("e") & F.col("o")).alias("matched"),
        F.count_if(F.col("e") & F.col("o").isNull()).alias("missing"),
        F.count_if(F.col("o") & F.col("e").isNull()).alias("unexpected"),
    )
    return counts.withColumn("rate", F.coalesce(F.try_divide("matched", "expected"), F.lit(0.0)))


def missing_keys(expected: DataFrame, observed: DataFrame) -> DataFrame:
    return expected.select(*KEYS).distinct().join(observed.select(*KEYS), KEYS, "left_anti")


def event_intersection(events: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: events in all, in the universe and out of it."""
    inside = universe.select(*KEYS).distinct().withColumn("__in", F.lit(True))
    return events.select(*KEYS).distinct().join(inside, KEYS, "left").agg(F.count(F.lit(1)).alias("events"), F.count("__in").alias("matched"), F.count_if(F.col("__in").isNull()).alias("out_of_universe"))


def pause_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("pause_status").agg(F.count(F.lit(1)).alias("n"))


def spans(df: DataFrame) -> DataFrame:
    """One row: first and last day, number of days and of codes."""
    return df.agg(F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"), F.countDistinct("trade_date").alias("days"), F.countDistinct("stock_code").alias("codes"))


def previous_close_change(quotes: DataFrame, key: str, day: str) -> DataFrame:
    """(key, pct_chg) of a day against the latest earlier close of the same key; a key without one is an error."""
    from ..functions.scalars import pct_change

    upto = quotes.where(F.col("trade_date") <= day)
    found = upto.groupBy(key).agg(F.max_by("close", F.when(F.col("trade_date") < day, F.col("trade_date"))).alias("__p"), F.max(F.when(F.col("trade_date") < day, F.lit(True))).alias("__has"), F.max(F.when(F.col("trade_date") == day, F.col("close"))).alias("__c"))
    found = found.where("__c is not null")
    previous = F.when(F.col("__has"), F.col("__p")).otherwise(F.raise_error(F.concat(F.lit("no earlier close: "), F.col(key))).cast("double"))
    return found.select(key, pct_change("__c", previous).alias("pct_chg"))


def limits_one_to_one(daily: DataFrame, limits: DataFrame) -> DataFrame:
    """Quotes with their limits; a repeated key on either side or a missing limit is an error."""
    for name, df in (("daily", daily), ("limits", limits)):
        if df.groupBy(*KEYS).count().where("count > 1").limit(1).count():
            raise ValueError(f"{name}: repeated keys")
    out = daily.join(limits, KEYS, "left")
    if out.where("limit_up is null or limit_down is null").limit(1).count():
        raise ValueError("a row has no limits")
    return out


def gap_reason(item: dict) -> str | None:
    """First reason for a gap: truncated, schema, duplicates, none, empty after retries, dates, codes, rows.

    ``item``: truncated, missing_fields, duplicate_rows, missing (list of (code, date)), empty_after_retries, codes, dates.
    """
    missing = item.get("missing") or []
    dates, codes = {d for _, d in missing}, {c for c, _ in missing}
    ladder = (
        (item.get("truncated"), "SAMPLE_TRUNCATED"),
        (item.get("missing_fields"), "SCHEMA_MISMATCH"),
        (item.get("duplicate_rows"), "DUPLICATE_KEYS_FOUND"),
        (not missing, None),
        (item.get("empty_after_retries"), "PROVIDER_EMPTY_AFTER_RETRIES"),
        (dates != set(item.get("dates", ())), "DATE_ALIGNMENT_GAP"),
        (codes != set(item.get("codes", ())), "CODE_ALIGNMENT_GAP"),
    )
    return next((name for hit, name in ladder if hit), "MISSING_PROVIDER_ROW")


def promotion_faults(candidates: DataFrame, sources: tuple[str, ...] = ("suspend_d",)) -> DataFrame:
    """(rule, n) of the promotion checks; zero prices pass here, unlike in the canonical check."""
    c = F.col
    checks = {
        "negative_price": (c("open") < 0) | (c("high") < 0) | (c("low") < 0) | (c("close") < 0) | (c("pre_close") < 0),
        "ohlc_order": (c("high") < c("low")) | (c("high") < c("open")) | (c("high") < c("close")) | (c("low") > c("open")) | (c("low") > c("close")),
        "volume_amount": (c("volume") < 0) | (c("amount") < 0),
        "adj_factor": c("adj_factor").isNull() | ~(c("adj_factor") > 0),
        "limits": c("limit_up").isNull() | c("limit_down").isNull(),
        "pause": c("is_paused_candidate").isNull(),
    }
    counts = candidates.agg(*[F.count_if(F.coalesce(x, F.lit(False))).alias(k) for k, x in checks.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in checks])).alias("x")).select("x.rule", "x.n")


def promote(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates as standard rows, with the change from pre_close to six places, upserted by key."""
    from ..functions.scalars import round6
    from ..schemas import dataset

    change = round6((F.col("close") - F.col("pre_close")) / F.col("pre_close") * 100)
    rows = candidates.withColumn("pct_chg", change).withColumn("is_paused", F.col("is_paused_candidate")).select(*dataset("daily_price").names)
    return upsert(existing.select(*rows.columns), rows, KEYS)


def calendar_proof(calendar: DataFrame, start: str, end: str) -> DataFrame:
    """One row: days of the scope that the calendar lacks, repeats, or has beyond it."""
    spark = calendar.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("cal_date"), F.lit(True).alias("want"))
    have = calendar.groupBy("cal_date").agg(F.count(F.lit(1)).alias("n"))
    return days.join(have, "cal_date", "full_outer").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("want").isNull()).alias("outside"))


def pause_agreement(daily: DataFrame, events: DataFrame, omits_suspended: bool) -> DataFrame:
    """n: pauses and events that contradict each other."""
    paused = daily.where("is_paused").select(*KEYS).distinct()
    if omits_suspended:
        return paused.agg(F.count(F.lit(1)).alias("n"))
    keys = events.select(*KEYS).distinct()
    return paused.exceptAll(keys).unionByName(keys.exceptAll(paused)).agg(F.count(F.lit(1)).alias("n"))
