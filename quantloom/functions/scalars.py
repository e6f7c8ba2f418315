"""Scalar rules as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts, words and flags of the published contract.
FORBIDDEN_WORDS = ["必涨", "稳赚", "必赚", "保证收益", "确定收益", "承诺收益", "满仓", "目标价", "无脑买入", "自动交易", "自动下单"]
SEVERE_FLAGS = ["high_debt_ratio", "negative_roe", "missing_financial", "is_st_on_date", "is_paused", "financial_missing", "debt_ratio_gt_max", "roe_lt_min", "st", "paused"]
REASON_CLAUSES = [
    ("quality_score", "ge", 70, "盈利质量较好"),
    ("growth_score", "ge", 70, "成长表现较稳定"),
    ("valuation_score", "ge", 70, "估值相对合理"),
    ("industry_score", "ge", 70, "行业相对强度较高"),
    ("trend_score", "ge", 70, "中期趋势确认较强"),
    ("valuation_score", "lt", 40, "估值偏高或估值吸引力不足"),
    ("trend_score", "lt", 40, "趋势仍需修复"),
]
DEFAULT_REASON = "综合评分处于中性区间，需继续跟踪基本面、估值和趋势变化"
SUGGESTIONS = ("可作为中长线重点候选", "观察，等待合适买点", "继续观察基本面和趋势确认", "暂不纳入候选")
TRUE_TOKENS, FALSE_TOKENS = ("1", "true", "yes", "y"), ("0", "false", "no", "n")
EXCHANGES = {"SZ": "SZSE", "SH": "SSE", "BJ": "BSE"}
CODE_PATTERN = r"^\d{6}\.(SZ|SH|BJ)$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_if_nan(x) -> Column:
    x = _c(x)
    return F.when(~F.isnan(x), x)


def scale_positive(x, low: float, high: float) -> Column:
    """0 at ``low``, 100 at ``high``, clipped; null stays null."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), (x - F.lit(low)) / F.lit(high - low) * 100)))


def scale_inverse(x, low: float, high: float) -> Column:
    return 100 - scale_positive(x, low, high)


def mean_of(columns: list[Column]) -> Column:
    """Row-wise mean of what is not null; null if all are."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return F.try_divide(total, count)


def round6(x) -> Column:
    """Half to even after scaling, as numpy rounds."""
    return F.rint(_c(x) * F.lit(1e6)) / F.lit(1e6)


def pct_change(close, previous) -> Column:
    return (_c(close) / _c(previous) - 1) * 100


def normalize_stock_code(x) -> Column:
    """``dddddd.EX``, ``EXdddddd`` or six digits; anything else is an error."""
    s = F.upper(F.trim(_c(x)))
    digits = F.regexp_extract(s, r"^(\d{6})$", 1)
    bare = F.when(digits.substr(1, 1) == "6", F.concat(digits, F.lit(".SH"))).when(digits.substr(1, 1).isin("0", "2", "3"), F.concat(digits, F.lit(".SZ"))).when(digits.substr(1, 1).isin("4", "8"), F.concat(digits, F.lit(".BJ")))
    return (
        F.when(s.rlike(CODE_PATTERN), s)
        .when(s.rlike(r"^(SZ|SH|BJ)\d{6}$"), F.concat(s.substr(3, 6), F.lit("."), s.substr(1, 2)))
        .when(bare.isNotNull(), bare)
        .otherwise(F.raise_error(F.concat(F.lit("invalid stock code: "), F.coalesce(s, F.lit("null")))))
    )


def normalize_date(x) -> Column:
    """``YYYYMMDD`` or ``YYYY-MM-DD`` to the latter; an impossible date is null."""
    s = F.trim(_c(x).cast("string"))
    day = F.when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd")).when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))
    return F.date_format(day, "yyyy-MM-dd")


def to_bool(x) -> Column:
    s = F.lower(F.trim(_c(x).cast("string")))
    return F.when(s.isin(*TRUE_TOKENS), F.lit(True)).when(s.isin(*FALSE_TOKENS), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(s, F.lit("null")))).cast("boolean"))


def is_st_name(x) -> Column:
    return F.upper(_c(x)).contains("ST")


def exchange_of(code) -> Column:
    suffix = F.substring_index(_c(code), ".", -1)
    return reduce(lambda acc, kv: acc.when(suffix == kv[0], kv[1]), list(EXCHANGES.items())[1:], F.when(suffix == "SZ", EXCHANGES["SZ"]))


def period_start(date, mode: str) -> Column:
    if mode not in ("monthly", "quarterly"):
        raise ValueError(f"unsupported rebalance_mode: {mode}")
    return F.date_format(F.date_trunc("month" if mode == "monthly" else "quarter", F.to_date(_c(date))), "yyyy-MM-dd")


def parse_flags(x) -> Column:
    """Lower-case set of a text delimited by ; or , without empties."""
    parts = F.transform(F.split(F.coalesce(_c(x), F.lit("")), "[;,]"), lambda v: F.lower(F.trim(v)))
    return F.array_distinct(F.filter(parts, lambda v: v != ""))


def risk_level(total="total_score", quality="quality_score", growth="growth_score", flags="risk_flags") -> Column:
    t, q, g = (F.coalesce(null_if_nan(_c(x).cast("double")), F.lit(0.0)) for x in (total, quality, growth))
    severe = F.arrays_overlap(parse_flags(flags), F.array(*[F.lit(f) for f in SEVERE_FLAGS]))
    return F.when((t < 55) | (q < 40) | (g < 30) | severe, "high").when((t >= 75) & (q >= 60) & (g >= 50), "low").otherwise("medium")


def reason() -> Column:
    """Clauses over the score columns; a null score counts as no number, so it makes no clause."""
    clauses = [F.when(F.col(c) >= n if op == "ge" else F.col(c) < n, F.lit(text)) for c, op, n, text in REASON_CLAUSES]
    joined = F.concat_ws("；", *clauses)
    return F.concat(F.when(joined == "", F.lit(DEFAULT_REASON)).otherwise(joined), F.lit("。"))


def suggestion(total="total_score", level="risk_level") -> Column:
    t, r = F.coalesce(_c(total), F.lit(0.0)), F.coalesce(_c(level), F.lit("high"))
    return F.when((t >= 80) & (r == "low"), SUGGESTIONS[0]).when((t >= 70) & r.isin("low", "medium"), SUGGESTIONS[1]).when(t >= 60, SUGGESTIONS[2]).otherwise(SUGGESTIONS[3])


def has_forbidden_word(x) -> Column:
    return _c(x).rlike("|".join(FORBIDDEN_WORDS))


def weekdays_between(start, end) -> Column:
    """Number of Mondays to Fridays in [start, end]."""
    days = F.sequence(F.to_date(_c(start)), F.to_date(_c(end)))
    return F.size(F.filter(days, lambda d: F.weekday(d) < 5))


def json_number(json, *paths: str) -> Column:
    """First number found at one of the JSON paths; numeric strings count."""
    return F.coalesce(*[F.get_json_object(_c(json), p).try_cast("double") for p in paths])
