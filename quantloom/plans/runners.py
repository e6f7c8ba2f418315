"""Step log and range runners.

A range is worked out for all its dates at once: the same few jobs check,
write and read back every date, and only verdicts and commit markers, which are
small files, are made date by date.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.driver import check_date, redact, stable_hash
from ..sources.storage import Store
from ..operators import clean, factors, quality, scoring, universe
from ..operators.merge import key_audits
from .publish import Conflict, Files, Publisher


class StepLog:
    """State of (trade_date, step), one small file each; a step that is done is skipped unless forced."""

    def __init__(self, spark: SparkSession, root: str):
        self.files = Files(spark, root)

    def _key(self, date: str, step: str) -> str:
        return f"log/{check_date(date)}/{step}.json"

    def should_run(self, date: str, step: str, force: bool = False) -> bool:
        state = self.files.read(self._key(date, step))
        return force or not state or state["status"] != "done"

    def run(self, date: str, step: str, action: Callable[[], object], force: bool = False) -> str:
        if not self.should_run(date, step, force):
            return "skipped"
        try:
            action()
        except Exception as e:
            self.files.write(self._key(date, step), {"trade_date": date, "step": step, "status": "failed", "message": redact(e)}, overwrite=True)
            raise
        self.files.write(self._key(date, step), {"trade_date": date, "step": step, "status": "done", "message": ""}, overwrite=True)
        return "done"


@dataclass
class RangeReport:
    status: str
    dates: dict[str, str] = field(default_factory=dict)
    reasons: dict[str, str] = field(default_factory=dict)


def fold_status(states: list[str]) -> str:
    """Status of a range from those of its dates."""
    kinds = set(states)
    if not states:
        return "BLOCKED"
    if len(kinds) == 1:
        return states[0]
    if kinds <= {"COMPLETED", "DATABASE_PENDING"}:
        return "DATABASE_PENDING"
    return "PARTIAL" if kinds & {"COMPLETED", "READY_FOR_APPLY", "DATABASE_PENDING"} else "FAILED" if "FAILED" in kinds else "BLOCKED"


class ScopeChanged(ValueError):
    """A run id was used before with another scope."""


def check_plan(files: Files, run_id: str, plan: dict) -> str:
    """Fix the plan of a run; the same id with another plan is an error."""
    print_ = stable_hash(plan)
    if not files.write(f"runs/{run_id}/plan.json", {"fingerprint": print_, "plan": plan}, overwrite=False):
        if files.read(f"runs/{run_id}/plan.json")["fingerprint"] != print_:
            raise ScopeChanged(f"run {run_id} has another scope")
    return print_


class _Range:
    """Verdicts of a range's dates while it runs; a date that is blocked or failed takes no further part."""

    def __init__(self, files: Files, run_id: str, dates: list[str]):
        self.files, self.run_id = files, run_id
        self.report = RangeReport("PENDING", {check_date(d): "PENDING" for d in dates})
        files.write(f"runs/{run_id}/report.json", {"status": "PENDING", "dates": self.report.dates, "reasons": {}}, overwrite=True)

    @property
    def open(self) -> list[str]:
        return [d for d, s in self.report.dates.items() if s == "PENDING"]

    def stop(self, date: str, state: str, reason: str = "") -> None:
        self.report.dates[date] = state
        if reason:
            self.report.reasons[date] = redact(reason)

    def check(self, df: DataFrame, name: str, **bounds) -> None:
        """Block the dates on which a dataset breaks its rules."""
        for d, broken in quality.faults_by_date(df, name, self.open, **bounds).items():
            self.stop(d, "BLOCKED", f"{name}: " + "; ".join(broken))

    def publish(self, publisher: Publisher, df: DataFrame, name: str, inputs: dict, mode: str | None = None, create_only: bool = True) -> None:
        """Publish the open dates together; if a date conflicts, each by itself, so that the others go on."""
        try:
            publisher.publish_dates(df, name, self.open, inputs, mode, create_only)
        except Conflict:
            for d in self.open:
                try:
                    publisher.publish(df, name, d, inputs, mode, create_only)
                except Conflict as e:
                    self.stop(d, "FAILED", str(e))

    def done(self, state: str) -> RangeReport:
        for d in self.open:
            self.stop(d, state)
        self.report.status = fold_status(list(self.report.dates.values()))
        self.files.write(f"runs/{self.run_id}/report.json", {"status": self.report.status, "dates": self.report.dates, "reasons": self.report.reasons}, overwrite=True)
        return self.report


def run_clean_range(spark: SparkSession, root: str, run_id: str, inputs: dict[str, DataFrame], dates: list[str], apply: bool = False, force: bool = False, lineage: dict | None = None) -> RangeReport:
    """Adjusted prices, snapshots and universe of the dates; one plan for all, five commits for each.

    ``lineage``: what ``trusted_lineage`` gave for the dates; the versions of
    the inputs that it names become part of every generation.
    """
    publisher = Publisher(spark, root)
    mark = check_plan(publisher.files, run_id, {"dates": dates} | ({"lineage": lineage} if lineage else {}))
    if lineage is not None and set(lineage["trade_dates"]) != set(dates):
        raise ScopeChanged("the lineage is of other dates")
    names = ["adjusted_price", "clean_daily_snapshot", "risk_filter", "eligible_universe", "factor_input_table"]
    state = _Range(publisher.files, run_id, dates)
    if not force:
        have = [set(publisher.committed(n)) for n in names]
        for d in dates:
            if all(d in c for c in have):
                state.stop(d, "COMPLETED")
    if not state.open:
        return state.done("COMPLETED")
    on = lambda df: df.where(df.trade_date.isin(state.open))
    for d, gaps in quality.gaps_by_date(inputs["daily_price"], inputs["adj_factor"], inputs["daily_basic"], inputs["financial"], inputs["stock_basic"], state.open).items():
        if not gaps.pop("active") or any(gaps.values()):
            state.stop(d, "BLOCKED", f"coverage: {gaps}")
    if not state.open:
        return state.done("BLOCKED")
    adjusted = clean.adjusted_price(on(inputs["daily_price"]), on(inputs["adj_factor"]))
    snapshot = clean.clean_snapshot(on(inputs["daily_price"]), adjusted, inputs["stock_basic"], on(inputs["daily_basic"]), inputs["financial"], inputs["st_history"]).persist()
    try:
        risk = universe.risk_filter(snapshot)
        outputs = dict(zip(names, (adjusted, snapshot, risk, universe.eligible_universe(snapshot, risk), universe.factor_input(snapshot, risk))))
        for n, df in outputs.items():
            state.check(df, n)
        if apply:
            for n, df in outputs.items():
                state.publish(publisher, df, n, {"run": mark}, create_only=not force)
    finally:
        snapshot.unpersist()
    return state.done("COMPLETED" if apply else "READY_FOR_APPLY")


def committed_history(spark: SparkSession, root: str, date: str, benchmark: DataFrame) -> dict[str, DataFrame]:
    """The inputs of factors from all clean dates up to ``date`` that have their commits; a date with only some of them is ambiguous and an error."""
    publisher = Publisher(spark, root)
    names = ["factor_input_table", "adjusted_price", "clean_daily_snapshot"]
    have = {n: {d for d in publisher.committed(n) if d <= check_date(date)} for n in names}
    every, some = set.intersection(*have.values()), set.union(*have.values())
    if every != some:
        raise Conflict(f"ambiguous history: {', '.join(sorted(some - every))}")
    if not every:
        raise FileNotFoundError(f"no committed history up to {date}")
    return {n: publisher.read_dates(n, sorted(every)) for n in names} | {"benchmark_price": benchmark.where(benchmark.trade_date <= date)}


def run_factor_range(spark: SparkSession, root: str, run_id: str, history: dict[str, DataFrame], dates: list[str], apply: bool = False, least: int = 15, strict: bool = True) -> RangeReport:
    """Factors of the dates from committed history; fewer than ``least`` effective factors block a date."""
    publisher = Publisher(spark, root)
    mark = check_plan(publisher.files, run_id, {"dates": dates, "least": least, "strict": strict})
    state = _Range(publisher.files, run_id, dates)
    found = factors.factor_daily(history["factor_input_table"], history["adjusted_price"], history["clean_daily_snapshot"], history["benchmark_price"], strict=strict)
    found = found.where(found.trade_date.isin(dates)).persist()
    try:
        state.check(found, "factor_daily")
        effective = quality.effective_factors(found)
        for d in state.open:
            if effective.get(d, 0) < least:
                state.stop(d, "BLOCKED", f"{effective.get(d, 0)} effective factors")
        if apply:
            state.publish(publisher, found, "factor_daily", {"run": mark, "run_id": run_id})
    finally:
        found.unpersist()
    return state.done("COMPLETED" if apply else "READY_FOR_APPLY")


def run_selection_range(spark: SparkSession, root: str, run_id: str, tables: dict[str, DataFrame], dates: list[str], mode: str, apply: bool = False, config: scoring.ScoringConfig = scoring.ScoringConfig(), save_summary: Callable[[DataFrame], None] | None = None, least: int = 15) -> RangeReport:
    """Selections of the dates: factor gate, key audit, recomputation, create-only commit, then the summary, which alone may be repaired later.

    A date whose commit is there already only has its summary saved again.  A
    generation does not depend on ``run_id``.
    """
    if config.weights != scoring.ScoringConfig().weights:
        raise ValueError("the frozen configuration allows no other weights")
    publisher = Publisher(spark, root)
    state = _Range(publisher.files, run_id, dates)
    known = set(publisher.committed("selection_result", mode))
    fresh = [d for d in state.open if d not in known]
    inputs = {"weights": config.weights, "top_n": config.top_n}
    if fresh:
        day = {n: df.where(df.trade_date.isin(fresh)) for n, df in tables.items()}
        effective = quality.effective_factors(day["factor_daily"])
        audits = key_audits(day["factor_daily"], day["eligible_universe"], day["factor_input_table"], day["risk_filter"])
        for d in fresh:
            if effective.get(d, 0) < least:
                state.stop(d, "BLOCKED", f"{effective.get(d, 0)} effective factors")
            elif any(audits.get(d, {}).values()):
                state.stop(d, "BLOCKED", f"keys: {audits[d]}")
        chosen = scoring.select_top(day["factor_daily"], day["eligible_universe"], day["risk_filter"], day["factor_input_table"], config).persist()
        try:
            waiting = [d for d in state.open if d in fresh]
            for d, broken in quality.faults_by_date(chosen, "selection_result", waiting).items():
                state.stop(d, "BLOCKED", "selection_result: " + "; ".join(broken))
            if any(quality.recomputation_faults(chosen, config.weights).first()):
                for d in [d for d in state.open if d in fresh]:
                    state.stop(d, "BLOCKED", "the selection cannot be recomputed from its rows")
            if apply:
                for_commit = [d for d in state.open if d in fresh]
                held = {d: state.report.dates.pop(d) for d in list(state.report.dates) if d not in for_commit}
                state.publish(publisher, chosen, "selection_result", inputs, mode=mode)
                state.report.dates = {d: held.get(d, state.report.dates.get(d)) for d in dates}
        finally:
            chosen.unpersist()
    if not apply:
        return state.done("READY_FOR_APPLY")
    if save_summary is not None and state.open:
        try:
            save_summary(scoring.summarize_selection(publisher.read_dates("selection_result", state.open, mode), config.top_n))
        except (OSError, RuntimeError, ValueError, PySparkException) as e:  # the summary store is another system
            for d in state.open:
                state.stop(d, "DATABASE_PENDING", str(e))
    return state.done("COMPLETED")


# --- single dates ---------------------------------------------------------------

RAW = ("stock_basic", "daily_price", "adj_factor", "daily_basic", "financial", "st_history", "benchmark_price")


def update_provider_data(spark: SparkSession, store: Store, log: StepLog, provider, date: str, names: tuple[str, ...] = RAW, force: bool = False) -> dict[str, str]:
    """Fetch, map, validate and write raw datasets of a date, each a step of the log; a step that is done is skipped."""
    from ..sources.providers import map_frame, retry

    def step(name: str):
        rows = map_frame(spark, retry(lambda: provider.fetch(name, date)), name)
        quality.validate(rows, name, date)
        store.write(rows if "trade_date" in rows.columns else rows.withColumn("trade_date", F.lit(date)), name)

    return {name: log.run(date, f"fetch-{name}", lambda name=name: step(name), force) for name in names}


def run_date(spark: SparkSession, store: Store, log: StepLog, date: str, force: bool = False, config: scoring.ScoringConfig = scoring.ScoringConfig(), strict: bool = False) -> dict[str, str]:
    """The steps of one date over stored datasets: adjusted prices, snapshot, universe, factors, selection."""
    on = lambda name: store.read(name, date)
    upto = lambda name: store.history(name, date)

    def save(name: str, df: DataFrame) -> None:
        quality.validate(df, name, date if name == "financial" else None)
        store.write(df, name)

    def adjusted():
        save("adjusted_price", clean.adjusted_price(on("daily_price"), on("adj_factor")))

    def snapshot():
        save("clean_daily_snapshot", clean.clean_snapshot(on("daily_price"), on("adjusted_price"), on("stock_basic").drop("trade_date"), on("daily_basic"), upto("financial"), upto("st_history")))

    def universes():
        rows = on("clean_daily_snapshot")
        risk = universe.risk_filter(rows)
        for name, df in (("risk_filter", risk), ("eligible_universe", universe.eligible_universe(rows, risk)), ("factor_input_table", universe.factor_input(rows, risk))):
            save(name, df)

    def factor():
        found = factors.factor_daily(on("factor_input_table"), upto("adjusted_price"), upto("clean_daily_snapshot"), upto("benchmark_price"), strict=strict)
        save("factor_daily", found.where(F.col("trade_date") == date))

    def selection():
        save("selection_result", scoring.select_top(on("factor_daily"), on("eligible_universe"), on("risk_filter"), on("factor_input_table"), config))

    steps = {"adjusted": adjusted, "snapshot": snapshot, "universe": universes, "factors": factor, "selection": selection}
    return {name: log.run(date, name, action, force) for name, action in steps.items()}


# --- receipts -------------------------------------------------------------------


def check_receipt(report: dict, manifest: dict, dates: list[str]) -> list[str]:
    """Reasons against trusting a readiness receipt; none if it may be used."""
    reasons = []
    if manifest.get("report_checksum") != stable_hash(report):
        reasons.append("CHECKSUM_MISMATCH")
    if report.get("status") != "READY":
        reasons.append("NOT_READY")
    if report.get("blockers"):
        reasons.append("HAS_BLOCKERS")
    if not report.get("read_back"):
        reasons.append("NOT_READ_BACK")
    if set(dates) - set(report.get("dates", ())):
        reasons.append("DATE_NOT_COVERED")
    if any(v["scope_rows"] > v["object_rows"] for day in report.get("versions", {}).values() for v in day.values()):
        reasons.append("MORE_ROWS_THAN_THE_OBJECT")
    return reasons


def trusted_lineage(receipts: list[tuple[dict, dict]], dates: list[str]) -> dict:
    """Versions of all inputs by date from receipts (report, manifest); every fault of any receipt is an error.

    All receipts must be of one code scope, each must cover some date and every
    date must be covered; where two cover a date, they must agree.
    """
    dates = sorted(check_date(d) for d in dates)
    if not dates or not receipts:
        raise ValueError("dates and receipts are needed")
    codes, versions = None, {}
    for report, manifest in receipts:
        own = sorted(set(report.get("dates", ())) & set(dates))
        reasons = check_receipt(report, manifest, own)
        if not own:
            reasons.append("NO_DATE_OF_THE_RANGE")
        if codes is not None and sorted(report["codes"]) != codes:
            reasons.append("OTHER_CODES")
        if reasons:
            raise ValueError("receipt: " + ", ".join(reasons))
        codes = sorted(report["codes"])
        for d in own:
            found = report["versions"][d]
            if set(found) != set(RAW):
                raise ValueError(f"receipt: {d} does not name all inputs")
            if versions.setdefault(d, found) != found:
                raise ValueError(f"receipts name different versions for {d}")
    missing = [d for d in dates if d not in versions]
    if missing:
        raise ValueError(f"no receipt covers {', '.join(missing)}")
    return {"trade_dates": dates, "codes": codes, "versions": versions, "receipts": sorted(m["report_checksum"] for _, m in receipts)}
