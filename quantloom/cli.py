"""A thin command line: ``python -m quantloom.cli COMMAND ...``.

Exit codes: 0 done, 2 blocked or bad arguments, 1 failed.  Every command prints
one JSON object.
"""

from __future__ import annotations

import argparse
import json
import sys

from .functions.driver import check_date, check_range, redact


def _range_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--root", required=True)
    p.add_argument("--run-id", required=True)
    p.add_argument("--dates", required=True, help="dates, joined by commas")
    p.add_argument("--apply", action="store_true")
    p.add_argument("--force", action="store_true")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quantloom")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("plan-backfill", help="estimate and plan a backfill")
    p.add_argument("--start", required=True)
    p.add_argument("--end", required=True)
    p.add_argument("--codes", type=int, required=True)
    p = sub.add_parser("update-data", help="fetch, map and store raw datasets of a date")
    p.add_argument("--root", required=True)
    p.add_argument("--date", required=True)
    p.add_argument("--provider", default="mock")
    p.add_argument("--force", action="store_true")
    p = sub.add_parser("run-date", help="all steps of a date over stored datasets")
    p.add_argument("--root", required=True)
    p.add_argument("--date", required=True)
    p.add_argument("--force", action="store_true")
    for name in ("run-clean-range", "run-factor-range", "run-selection-range"):
        _range_options(sub.add_parser(name, help="a committed range"))
    p = sub.add_parser("validate", help="check a stored dataset's rules on a date")
    p.add_argument("--root", required=True)
    p.add_argument("--dataset", required=True)
    p.add_argument("--date", required=True)
    p = sub.add_parser("query", help="SQL over a Parquet path, which the text calls {dataset}")
    p.add_argument("--path", required=True)
    p.add_argument("--sql")
    p.add_argument("--limit", type=int, default=10)
    return top


def _run(args: argparse.Namespace) -> tuple[int, dict]:
    if args.command == "plan-backfill":
        from .plans import backfill

        check_range(args.start, args.end)
        chunks = backfill.plan(args.start, args.end, args.codes)
        return 0, {"estimate": backfill.estimate(args.start, args.end, args.codes), "chunks": len(chunks), "fingerprint": backfill.fingerprint(chunks)}
    from .operators import quality
    from .plans import runners
    from .plans.publish import Publisher
    from .session import build
    from .sources import providers
    from .sources.storage import Store, query_parquet

    spark = build()
    if args.command == "query":
        return 0, {"rows": [r.asDict(True) for r in query_parquet(spark, args.path, args.sql, args.limit).collect()]}
    store = Store(spark, args.root)
    log = runners.StepLog(spark, args.root)
    if args.command == "validate":
        quality.validate(store.read(args.dataset, args.date), args.dataset, check_date(args.date))
        return 0, {"dataset": args.dataset, "date": args.date, "status": "PASS"}
    if args.command == "update-data":
        return 0, runners.update_provider_data(spark, store, log, providers.make_provider(args.provider), check_date(args.date), force=args.force)
    if args.command == "run-date":
        return 0, runners.run_date(spark, store, log, check_date(args.date), args.force)
    dates = [check_date(d) for d in args.dates.split(",")]
    last = max(dates)
    if args.command == "run-clean-range":
        inputs = {n: store.history(n, last) for n in runners.RAW}
        inputs["stock_basic"] = inputs["stock_basic"].where(inputs["stock_basic"].trade_date == last).drop("trade_date")
        report = runners.run_clean_range(spark, args.root, args.run_id, inputs, dates, args.apply, args.force)
    elif args.command == "run-factor-range":
        history = runners.committed_history(spark, args.root, last, store.history("benchmark_price", last))
        report = runners.run_factor_range(spark, args.root, args.run_id, history, dates, args.apply)
    else:
        publisher = Publisher(spark, args.root)
        tables = {n: publisher.read_dates(n, dates) for n in ("factor_daily", "eligible_universe", "factor_input_table", "risk_filter")}
        report = runners.run_selection_range(spark, args.root, args.run_id, tables, dates, "monthly", args.apply)
    return (0 if report.status in ("COMPLETED", "READY_FOR_APPLY") else 2), {"status": report.status, "dates": report.dates, "reasons": report.reasons}


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    try:
        code, out = _run(args)
    except (ValueError, FileNotFoundError) as e:  # bad input or nothing to work on
        code, out = 2, {"status": "BLOCKED", "reason": redact(e)}
    except Exception as e:  # whatever else fails is reported, not shown raw
        code, out = 1, {"status": "FAILED", "reason": redact(f"{type(e).__name__}: {e}")}
    print(json.dumps(out, sort_keys=True, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main())
