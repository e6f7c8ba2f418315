"""Backfill planning with hard budgets, and the chunk executor's state machine."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from ..functions.driver import check_range, date_windows, redact, stable_hash, weekday_count
from .publish import Files

# Budgets, dataset axes and failure categories.
MAX_CHUNKS, MAX_PLAN_BYTES, MAX_CALLS, MAX_READS = 25_000, 16 * 1024 * 1024, 215_000, 40_000
MARKET = ("daily_price", "adj_factor", "daily_basic", "benchmark_price")
FAILURES = (
    "EMPTY_RESULT", "RATE_LIMITED", "PERMISSION_DENIED", "SCHEMA_DRIFT", "TRANSIENT_PROVIDER_ERROR", "CONFIGURATION_ERROR",
    "SEMANTIC_SOURCE_UNAVAILABLE", "DQ_FAILED", "WRITE_FAILED", "READBACK_FAILED", "INTERRUPTED", "UNKNOWN",
)
RETRYABLE = frozenset({"RATE_LIMITED", "TRANSIENT_PROVIDER_ERROR", "WRITE_FAILED", "READBACK_FAILED", "UNKNOWN"})


class PlanTooLarge(ValueError):
    """The estimate exceeds a budget."""


class BackfillFailure(RuntimeError):
    def __init__(self, category: str, message: str = ""):
        super().__init__(message or category)
        self.category = category if category in FAILURES else "UNKNOWN"


def estimate(start: str, end: str, code_count: int, date_days: int = 31, announce_days: int = 31) -> dict:
    """Upper bounds of a plan, in constant space."""
    check_range(start, end)
    if min(code_count, date_days, announce_days) <= 0:
        raise ValueError("counts must be positive")
    windows, announces = len(date_windows(start, end, date_days)), len(date_windows(start, end, announce_days))
    days = weekday_count(start, end)
    return {"chunks": 5 * windows + 2 + announces, "provider_calls": 5 * days + 3 * windows + 1 + announces + 2, "canonical_reads": 14 * days + 31, "open_days": days}


@dataclass(frozen=True)
class Chunk:
    chunk_id: str
    dataset: str
    start: str
    end: str
    order: int
    after: str | None = None  # a financial window follows the one before


def plan(start: str, end: str, code_count: int, date_days: int = 31, announce_days: int = 31) -> list[Chunk]:
    """Market windows by dataset, one historical scope for stocks and ST, chained announce windows for financials."""
    found = estimate(start, end, code_count, date_days, announce_days)
    for name, most in (("chunks", MAX_CHUNKS), ("provider_calls", MAX_CALLS), ("canonical_reads", MAX_READS)):
        if found[name] > most:
            raise PlanTooLarge(f"{name}: {found[name]} exceeds {most}")
    out: list[Chunk] = []

    def add(dataset: str, a: str, b: str, after: str | None = None) -> str:
        name = stable_hash([dataset, a, b])[:16]
        out.append(Chunk(name, dataset, a, b, len(out), after))
        return name

    for dataset in ("stock_basic", "st_history"):
        add(dataset, start, end)
    for a, b in date_windows(start, end, date_days):
        for dataset in MARKET:
            add(dataset, a, b)
    last = None
    for a, b in date_windows(start, end, announce_days):
        last = add("financial", a, b, last)
    return out


def fingerprint(chunks: list[Chunk]) -> str:
    return stable_hash([[c.chunk_id, c.dataset, c.start, c.end, c.after] for c in chunks])


def execute(files: Files, run_id: str, chunks: list[Chunk], work: Callable[[Chunk], dict], resume: bool = False) -> dict:
    """Run the chunks in order; the state file of a chunk says RUNNING before any side effect.

    A retryable failure makes a chunk FAILED, another one BLOCKED; later chunks
    go on, but not those that follow it in a chain.
    """
    want = fingerprint(chunks)
    if not files.write(f"backfill/{run_id}/plan.json", {"fingerprint": want}, overwrite=False):
        if files.read(f"backfill/{run_id}/plan.json")["fingerprint"] != want:
            raise ValueError("the plan of a run cannot change")
    done: set[str] = set()
    for c in chunks:
        key = f"backfill/{run_id}/chunks/{c.chunk_id}.json"
        state = files.read(key)
        if state and state["state"] == "COMPLETED" and resume:
            done.add(c.chunk_id)
            continue
        if c.after and c.after not in done:
            files.write(key, {"state": "BLOCKED", "category": "SEMANTIC_SOURCE_UNAVAILABLE", "message": "an earlier window is missing"}, overwrite=True)
            continue
        files.write(key, {"state": "RUNNING"}, overwrite=True)
        try:
            result = work(c)
            files.write(key, {"state": "COMPLETED", "result": result}, overwrite=True)
            done.add(c.chunk_id)
        except Exception as e:
            category = e.category if isinstance(e, BackfillFailure) else "UNKNOWN"
            files.write(key, {"state": "FAILED" if category in RETRYABLE else "BLOCKED", "category": category, "message": redact(e)}, overwrite=True)
    return summarize(files, run_id, chunks)


def summarize(files: Files, run_id: str, chunks: list[Chunk]) -> dict:
    """Every planned chunk once, by state and by dataset; gaps are those not completed."""
    states = {c: (files.read(f"backfill/{run_id}/chunks/{c.chunk_id}.json") or {"state": "PENDING"})["state"] for c in chunks}
    return {"total": len(chunks), "by_state": dict(Counter(states.values())), "by_dataset": {d: dict(Counter(s for c, s in states.items() if c.dataset == d)) for d in sorted({c.dataset for c in chunks})}, "gaps": [c.chunk_id for c, s in states.items() if s != "COMPLETED"]}
