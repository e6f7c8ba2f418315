"""Data-quality levels and what each allows: plain predicates over facts that reports have established."""

from __future__ import annotations

from dataclasses import dataclass

# Levels, modes, fields and reasons of the published contract.
LEVELS = ("DQ0", "DQ1", "DQ2", "DQ3", "DQ4")
MODES = {"strict_tradable_required": (("DQ3", "DQ4"), ("daily_price",), True), "price_only_diagnostic": (("DQ2",), ("benchmark_price",), False)}
PRICE_FIELDS = frozenset("stock_code trade_date open high low close pre_close volume amount pct_chg is_paused limit_up limit_down".split())
PROVIDER_LEVELS = {("akshare", "benchmark_price"): "DQ2"}
RAW_SMOKE = ("daily_price", "daily_price_raw", "daily_price_raw_smoke")
#: Evidence that may never stand for a pause.
NO_EVIDENCE = ("volume", "amount", "missing_daily", "unchanged_price")


@dataclass(frozen=True)
class Verdict:
    ready: bool
    status: str
    reasons: tuple[str, ...] = ()


def level(text: str) -> str:
    if text not in LEVELS:
        raise ValueError(f"unknown quality level: {text}")
    return text


def provider_level(provider: str, dataset: str) -> tuple[str, tuple[str, ...]]:
    """(level, datasets that its rows may be stored as); no provider's rows are tradable as they come."""
    key = provider.lower(), dataset.lower()
    if key in PROVIDER_LEVELS:
        return PROVIDER_LEVELS[key], (key[1],)
    if key[0] in ("akshare", "baostock") and key[1] in RAW_SMOKE:
        return "DQ1", RAW_SMOKE[1:]
    return "DQ1", ()


def usable_in(mode: str, dq_level: str, dataset: str, fields=()) -> bool:
    """Whether rows of a level may be used in a backtest mode; strict use also wants all price fields."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    levels, datasets, tradable = MODES[mode]
    return dataset in datasets and level(dq_level) in levels and (not tradable or promotable(dq_level, fields))


def promotable(dq_level: str, fields) -> bool:
    return level(dq_level) in ("DQ3", "DQ4") and PRICE_FIELDS <= set(fields)


def miss_is_false(coverage: str, calendar_valid: bool, schema_valid: bool, used_as_evidence=()) -> bool:
    """A pair without an event was traded only if the event set is whole and nothing else was read as evidence."""
    return coverage == "FULL_EVENT_COVERAGE" and calendar_valid and schema_valid and not set(used_as_evidence) & set(NO_EVIDENCE)


def suspension_promotion(coverage: str, pause_statuses, validator_passed: bool, dq_level: str) -> Verdict:
    unknown = "unknown" in set(pause_statuses)
    checks = (
        (coverage != "FULL_EVENT_COVERAGE", "suspend_d event source coverage is not complete"),
        (unknown, "pause_status contains unresolved unknown rows"),
        (not validator_passed, "suspension_status promotion validator must pass"),
        (level(dq_level) not in ("DQ3", "DQ4"), "dq_level must be DQ3 or DQ4"),
    )
    reasons = tuple(r for hit, r in checks if hit)
    if not reasons:
        return Verdict(True, "READY_FOR_DQ3_PROMOTION")
    if coverage == "SAMPLE_TRUNCATED":
        return Verdict(False, "BLOCKED_BY_INCOMPLETE_SUSPEND_D_COVERAGE", reasons)
    held = coverage in ("COVERAGE_UNKNOWN", "MISSING_INPUT", "SCHEMA_MISMATCH") or unknown
    return Verdict(False, "BLOCKED_BY_UNRESOLVED_IS_PAUSED" if held else "CANDIDATE_AUDIT_COMPLETED_NOT_PROMOTABLE", reasons)


def batch_promotion(fields_complete: bool, coverage_complete: bool, pause_statuses, duplicates_ok: bool, schema_ok: bool, precheck_passed: bool, dq_level: str) -> Verdict:
    unknown = "unknown" in set(pause_statuses)
    checks = (
        (not fields_complete, "candidate batch field completeness is incomplete", "BLOCKED_BY_FIELD_COMPLETENESS"),
        (not coverage_complete, "provider coverage is incomplete or unresolved", "BLOCKED_BY_INCOMPLETE_PROVIDER_COVERAGE"),
        (unknown, "pause_status contains unresolved unknown rows", "BLOCKED_BY_UNRESOLVED_IS_PAUSED"),
        (not duplicates_ok, "duplicate key check must pass", "BLOCKED_BY_SCHEMA_OR_DUPLICATE"),
        (not schema_ok, "schema check must pass", "BLOCKED_BY_SCHEMA_OR_DUPLICATE"),
        (not precheck_passed, "promotion validator precheck must pass", "BLOCKED_BY_VALIDATOR"),
        (level(dq_level) not in ("DQ3", "DQ4"), "dq_level must be DQ3 or DQ4", "BLOCKED_BY_VALIDATOR"),
    )
    hits = [(reason, status) for hit, reason, status in checks if hit]
    if not hits:
        return Verdict(True, "READY_FOR_PROMOTION_VALIDATOR")
    ladder = ("BLOCKED_BY_UNRESOLVED_IS_PAUSED", "BLOCKED_BY_INCOMPLETE_PROVIDER_COVERAGE", "BLOCKED_BY_FIELD_COMPLETENESS", "BLOCKED_BY_SCHEMA_OR_DUPLICATE", "BLOCKED_BY_VALIDATOR")
    return Verdict(False, next(s for s in ladder if s in {status for _, status in hits}), tuple(r for r, _ in hits))


def price_coverage(coverages) -> Verdict:
    """``coverages``: (interface, matched, expected, reason); complete if none is short or empty."""
    short = tuple(reason or "MISSING_PROVIDER_ROW" for _, matched, expected, reason in coverages if expected == 0 or matched != expected)
    return Verdict(not short, "COMPLETE" if not short else "INCOMPLETE", short)
