"""Point-in-time cleaning: adjustment, membership, as-of financials, ST intervals, snapshots.

Every operator takes all trade dates at once; one date is a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["stock_code", "trade_date"]
FIN_VALUES = ["revenue_yoy", "net_profit_yoy", "roe", "gross_margin", "debt_ratio", "operating_cashflow"]
FIN_COLUMNS = ["report_period", "announce_date", *FIN_VALUES]


def adjusted_price(daily: DataFrame, factors: DataFrame) -> DataFrame:
    """Prices times factor; a row without a positive factor is dropped; volume and limits stay."""
    positive = factors.where("adj_factor > 0").select(*KEYS, "adj_factor")
    joined = daily.join(positive, KEYS)
    adjusted = [(F.col(c) * F.col("adj_factor")).alias(f"adj_{c}") for c in ("open", "high", "low", "close")]
    return joined.select(*KEYS, *adjusted, "volume", "amount", "pct_chg", "is_paused", "limit_up", "limit_down")


def member_on(date: str = "trade_date") -> Column:
    """Listed on the date: list_date <= date, and not delisted by then."""
    return (F.col("list_date") <= F.col(date)) & (F.col("delist_date").isNull() | (F.col("delist_date") > F.col(date)))


def stock_basic_as_of(basic: DataFrame, date: str) -> DataFrame:
    return basic.withColumn("__d", F.lit(date)).where(member_on("__d")).drop("__d")


def membership_counts(basic: DataFrame, dates: DataFrame) -> DataFrame:
    """(trade_date, reason, n): who is not a member on each date and why; no rows for zero counts.

    Not yet listed is what the total of list dates leaves; a stock delisted by a
    date that is not also listed later counts as delisted.  Both are running
    sums over the days on which something changes, not pairs of dates and stocks.
    """
    begun = basic.where("list_date is not null").select(F.col("list_date").alias("day"), F.lit("L").alias("k"))
    # a stock that is delisted before it is listed is not yet listed until then, and delisted from then on
    gone = basic.where("delist_date is not null").select(F.greatest("delist_date", F.coalesce("list_date", F.lit(""))).alias("day"), F.lit("D").alias("k"))
    changes = begun.unionByName(gone).groupBy("day").agg(F.count_if(F.col("k") == "L").alias("l"), F.count_if(F.col("k") == "D").alias("d"))
    days = dates.select(F.col("trade_date").alias("day")).distinct().withColumn("asked", F.lit(True))
    w = Window.orderBy("day")  # one row a day
    sums = changes.join(days, "day", "full_outer").select("day", "asked", F.sum(F.coalesce("l", F.lit(0))).over(w).alias("l"), F.sum(F.coalesce("d", F.lit(0))).over(w).alias("d"))
    total = basic.agg(F.count("list_date").alias("all"))
    each = F.explode(F.array(F.struct(F.lit("NOT_YET_LISTED").alias("reason"), (F.col("all") - F.col("l")).alias("n")), F.struct(F.lit("DELISTED").alias("reason"), F.col("d").alias("n"))))
    return sums.where("asked").join(F.broadcast(total), F.lit(True)).select(F.col("day").alias("trade_date"), each.alias("x")).select("trade_date", "x.reason", "x.n").where("n > 0")


def visible_financials(financial: DataFrame, date: str) -> DataFrame:
    """Disclosures that are known on the date."""
    return financial.where((F.col("announce_date") <= date) & (F.col("report_period") <= date))


def visibility_counts(financial: DataFrame, date: str) -> DataFrame:
    usable = (F.col("announce_date") <= date) & (F.col("report_period") <= date)
    return financial.agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(usable).alias("usable_rows"),
        F.count_if(~usable).alias("future_rows"),
        F.countDistinct(F.when(usable, F.col("stock_code"))).alias("latest_rows"),
    )


def latest_financials(financial: DataFrame, date: str) -> DataFrame:
    """The last disclosure of each stock by (announce_date, report_period) that is known on the date."""
    order = Window.partitionBy("stock_code").orderBy(F.desc("announce_date"), F.desc("report_period"))
    return visible_financials(financial, date).withColumn("__n", F.row_number().over(order)).where("__n = 1").select("stock_code", *FIN_COLUMNS)


def financial_as_of(base: DataFrame, financial: DataFrame) -> DataFrame:
    """Left as-of join for all dates of ``base``: the greatest (announce_date, report_period) known on the row's date.

    Both sides are sorted once by stock and day, and a running maximum carries
    the disclosure forward, so no range join multiplies rows.  Columns stay
    columns, so those that nobody asks for are not shuffled.
    """
    known = F.greatest("announce_date", "report_period")
    events = financial.select("stock_code", known.alias("__day"), F.struct("announce_date", "report_period", *FIN_VALUES).alias("__fin"))
    keep = [c for c in base.columns if c not in FIN_COLUMNS]
    rows = base.select(*keep, F.col("trade_date").alias("__day"), F.lit(True).alias("__asked"))
    both = rows.unionByName(events, allowMissingColumns=True)
    upto = Window.partitionBy("stock_code").orderBy("__day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__fin", F.max("__fin").over(upto)).where("__asked")
    return found.select(*keep, *[F.col(f"__fin.{c}").alias(c) for c in FIN_COLUMNS])


def st_flags(base: DataFrame, st_history: DataFrame) -> DataFrame:
    """Add is_st_on_date: some interval [start_date, end_date) of the stock holds the date; a null end is open."""
    spans = st_history.select(F.col("stock_code").alias("__c"), "start_date", "end_date").distinct()
    hits = base.select(*KEYS).distinct().join(spans, (F.col("stock_code") == F.col("__c")) & (F.col("start_date") <= F.col("trade_date")) & (F.col("end_date").isNull() | (F.col("end_date") > F.col("trade_date"))), "left_semi")
    return base.join(hits.withColumn("__hit", F.lit(True)), KEYS, "left").withColumn("is_st_on_date", F.coalesce("__hit", F.lit(False))).drop("__hit")


def overlapping(spans: DataFrame, start: str, end: str) -> DataFrame:
    """Intervals that overlap [start, end]."""
    return spans.where((F.col("start_date") <= end) & (F.coalesce("end_date", F.lit("9999-12-31")) > start))


def listed_days(date: str = "trade_date") -> Column:
    return F.datediff(F.to_date(date), F.to_date("list_date")).cast("long")


def clean_snapshot(daily: DataFrame, adjusted: DataFrame, basic: DataFrame, daily_basic: DataFrame, financial: DataFrame, st_history: DataFrame) -> DataFrame:
    """All members' quotes with adjusted prices, valuation, financials known on the day, ST flag and days listed."""
    master = basic.select("stock_code", "stock_name", "industry", "market_type", "list_date", "delist_date")
    quotes = daily.join(master, "stock_code").where(member_on())
    prices = adjusted.select(*KEYS, "adj_open", "adj_high", "adj_low", "adj_close")
    joined = quotes.join(prices, KEYS).join(daily_basic, KEYS, "left").withColumn("listed_days", listed_days()).drop("list_date", "delist_date")
    return st_flags(financial_as_of(joined, financial), st_history)


def carry_financial_state(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Keyed merge of two windows of disclosures: the current one wins."""
    keys = ["stock_code", "report_period", "announce_date"]
    return previous.join(current.select(*keys), keys, "left_anti").unionByName(current)


def carry_chain(frames: list[DataFrame]) -> DataFrame:
    """``carry_financial_state`` over an ordered chain of windows, in one aggregation: of each key the row of the last window that has it."""
    keys = ["stock_code", "report_period", "announce_date"]
    rows = [df.withColumn("__at", F.lit(i)) for i, df in enumerate(frames)]
    last = Window.partitionBy(*keys).orderBy(F.desc("__at"))
    both = rows[0]
    for df in rows[1:]:
        both = both.unionByName(df)
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__at")


#: Dates and master rows up to which a list of either is written into a plan.
LISTED = 10_000


def project_by_date(financial: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows known on each date: (trade_date, disclosure).

    A disclosure goes to the dates after it, found by search in the sorted list
    of dates (a few thousand at most), so the work is that of the output.
    """
    days = [r[0] for r in dates.select("trade_date").distinct().orderBy("trade_date").limit(LISTED + 1).collect()]
    if len(days) > LISTED:
        raise ValueError(f"more than {LISTED} dates")
    known = F.greatest("announce_date", "report_period")
    later = F.filter(F.array(*[F.lit(d) for d in days]) if days else F.array().cast("array<string>"), lambda d: d >= known)
    return financial.where("announce_date is not null and report_period is not null").select(F.explode(later).alias("trade_date"), *financial.columns)
