"""Connectors for three public data packages over a client object that the caller passes in.

A connector turns a package's answers into rows in the names of the contracts,
and says with a ``CapabilityError`` what the package does not offer.  The
packages themselves are not imported here, so nothing needs a network.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from ..functions.driver import check_date
from .providers import CapabilityError, fetch_all_pages, retry


class FetchError(RuntimeError):
    """A package answered with an error, with nothing, or with values that cannot be read."""


# The packages' symbols, field names, missing fields and error marks.
INDEX_SYMBOLS = {"000300.SH": "sh000300", "000905.SH": "sh000905", "000906.SH": "sh000906"}
SMOKE = "daily_price_raw_smoke"
BAR_FIELDS = {"开盘": "open", "最高": "high", "最低": "low", "收盘": "close", "成交量": "volume", "成交额": "amount", "涨跌幅": "pct_chg"}
BAO_FIELDS = {"open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume", "amount": "amount", "pctChg": "pct_chg"}
BAO_QUERY = "date,code,open,high,low,close,preclose,volume,amount,pctChg"
ENDPOINTS = {
    "stock_basic": "ts_code,name,industry,market,list_date", "daily": "ts_code,trade_date,open,high,low,close,pre_close,pct_chg,vol,amount", "stk_limit": "ts_code,trade_date,up_limit,down_limit",
    "adj_factor": "ts_code,trade_date,adj_factor", "daily_basic": "ts_code,trade_date,pe_ttm,pb,ps_ttm,total_mv,circ_mv,turnover_rate", "trade_cal": "exchange,cal_date,is_open,pretrade_date", "suspend_d": "ts_code,trade_date,suspend_timing,suspend_type",
}
GAPS = {
    "stock_basic": "list_date, industry, market_type, is_st", "daily_price": "limit_up, limit_down, is_paused", "adj_factor": "adj_factor", "daily_basic": "pe_ttm, pb, ps_ttm, total_mv, circ_mv, turnover_rate",
    "financial": "announce_date, report_period, roe, debt_ratio", "st_history": "st_type, start_date, end_date",
}
PERMANENT_MARKS = ("没有接口", "频率超限", "权限")


def records(answer) -> list[dict]:
    """Rows of an answer: a list of dicts, or anything with ``to_dict("records")``; nothing gives no rows."""
    if answer is None:
        return []
    return list(answer) if isinstance(answer, list) else answer.to_dict("records")


def _number(row: dict, field: str) -> float:
    try:
        value = float(row[field])
    except (KeyError, TypeError, ValueError) as e:
        raise FetchError(f"{field} is not a number: {row.get(field)!r}") from e
    if value != value:
        raise FetchError(f"{field} is not a number: nan")
    return value


def _day(value) -> str:
    text = str(value)[:10]
    return f"{text[:4]}-{text[4:6]}-{text[6:8]}" if len(text) == 8 and text.isdigit() else text


def _wanted(rows: list[dict], fields) -> None:
    missing = sorted(set(fields) - set(rows[0])) if rows else []
    if missing:
        raise CapabilityError(f"missing fields: {', '.join(missing)}")


class AkshareConnector:
    """Index bars of three indexes, and raw bars of single stocks that may only be stored as smoke rows."""

    def __init__(self, client, symbols: dict[str, str] | None = None):
        self.client, self.symbols = client, symbols or {"000001.SZ": "000001"}

    def fetch(self, name: str, day: str) -> list[dict]:
        check_date(day)
        if name == "benchmark_price":
            return [self._index(code, symbol, day) for code, symbol in INDEX_SYMBOLS.items()]
        if name == SMOKE:
            return [self._bar(code, symbol, day) for code, symbol in self.symbols.items()]
        raise CapabilityError(f"akshare {name}: missing fields: {GAPS.get(name, 'all')}")

    def _index(self, code: str, symbol: str, day: str) -> dict:
        rows = records(self.client.stock_zh_index_daily(symbol=symbol))
        _wanted(rows, ("date", "open", "high", "low", "close"))
        upto = sorted((r for r in rows if _day(r["date"]) <= day), key=lambda r: _day(r["date"]))
        if not upto or _day(upto[-1]["date"]) != day:
            raise FetchError(f"{symbol}: no row on {day}")
        if len(upto) < 2:
            raise FetchError(f"{symbol}: no close before {day}")
        now, before = upto[-1], upto[-2]
        bar = {c: _number(now, c) for c in ("open", "high", "low", "close")}
        return {"index_code": code, "trade_date": day} | bar | {"pct_chg": (bar["close"] / _number(before, "close") - 1) * 100}

    def _bar(self, code: str, symbol: str, day: str) -> dict:
        compact = day.replace("-", "")
        rows = records(self.client.stock_zh_a_hist(symbol=symbol, period="daily", start_date=compact, end_date=compact, adjust=""))
        _wanted(rows, ("日期", *BAR_FIELDS))
        mine = [r for r in rows if _day(r["日期"]) == day]
        if not mine:
            raise FetchError(f"{symbol}: no row on {day}")
        return {"stock_code": code, "trade_date": day} | {to: _number(mine[-1], c) for c, to in BAR_FIELDS.items()} | {"source_symbol": symbol}


class BaostockConnector:
    """Raw bars of single stocks within a session that is always closed."""

    def __init__(self, client, symbols: dict[str, str] | None = None):
        self.client, self.symbols = client, symbols or {"000001.SZ": "sz.000001"}

    @contextmanager
    def _session(self):
        self._checked(self.client.login(), "login")
        try:
            yield
        finally:
            self.client.logout()

    @staticmethod
    def _checked(answer, what: str):
        if str(getattr(answer, "error_code", "")) != "0":
            raise FetchError(f"baostock {what}: {getattr(answer, 'error_msg', '')}")
        return answer

    def fetch(self, name: str, day: str) -> list[dict]:
        check_date(day)
        if name != SMOKE:
            raise CapabilityError(f"baostock {name}: missing fields: {GAPS.get(name, 'all')}")
        out = []
        with self._session():
            for code, symbol in self.symbols.items():
                answer = self._checked(self.client.query_history_k_data_plus(symbol, BAO_QUERY, start_date=day, end_date=day, frequency="d", adjustflag="3"), symbol)
                rows = []
                while answer.next():
                    rows.append(dict(zip(answer.fields, answer.get_row_data())))
                if not rows or _day(rows[-1]["date"]) != day:
                    raise FetchError(f"{symbol}: no row on {day}")
                out.append({"stock_code": code, "trade_date": day} | {to: _number(rows[-1], c) for c, to in BAO_FIELDS.items()} | {"source_symbol": symbol})
        return out


class TushareConnector:
    """Endpoints by name, with retries except after refusals; whole event sets by pages; no tradable prices, since pauses have no trusted source."""

    def __init__(self, client, attempts: int = 3, wait: float = 2.0, sleep: Callable[[float], None] | None = None):
        self.client, self.attempts, self.wait, self.sleep = client, attempts, wait, sleep

    def endpoint(self, name: str, allow_empty: bool = False, **parameters) -> list[dict]:
        """Rows of an endpoint; no rows are an error unless allowed."""
        if name not in ENDPOINTS:
            raise CapabilityError(f"tushare: no endpoint {name}")

        def call():
            try:
                return records(getattr(self.client, name)(fields=ENDPOINTS[name], **parameters))
            except Exception as e:
                if any(mark in str(e) for mark in PERMANENT_MARKS):
                    raise CapabilityError(f"tushare {name}: refused") from e
                raise

        more = {"sleep": self.sleep} if self.sleep else {}
        try:
            rows = retry(call, self.attempts, self.wait, **more)
        except CapabilityError:
            raise
        except Exception as e:
            raise FetchError(f"tushare {name}: {type(e).__name__}") from e
        if not rows and not allow_empty:
            raise FetchError(f"tushare {name}: no rows")
        return rows

    def events(self, day: str, size: int = 5000, most: int | None = None):
        """All suspensions of a day over the whole market, and the proof that they are all."""
        compact = check_date(day).replace("-", "")
        return fetch_all_pages(lambda at, n: self.endpoint("suspend_d", allow_empty=True, trade_date=compact, offset=at, limit=n), ["ts_code", "trade_date"], size, most)

    def fetch(self, name: str, day: str) -> list[dict]:
        compact = check_date(day).replace("-", "")
        if name == "stock_basic":
            rows = self.endpoint("stock_basic", exchange="", list_status="L")
            places = {".SZ": "SZSE", ".SH": "SSE", ".BJ": "BSE"}
            return [{"ts_code": r["ts_code"], "name": r["name"], "exchange": places.get(str(r["ts_code"]).upper()[-3:], ""), "list_date": r["list_date"], "delist_date": None, "industry": r["industry"], "market_type": r.get("market", ""), "is_st": "ST" in str(r["name"]).upper(), "trade_date": compact} for r in rows]
        if name in ("adj_factor", "daily_basic"):
            return self.endpoint(name, trade_date=compact)
        if name == "daily_price":
            bars = self.endpoint("daily", trade_date=compact)
            limits = {r["ts_code"]: r for r in self.endpoint("stk_limit", trade_date=compact)}
            short = [r["ts_code"] for r in bars if limits.get(r["ts_code"], {}).get("up_limit") is None or limits[r["ts_code"]].get("down_limit") is None]
            raise FetchError(f"no limits for {len(short)} rows") if short else CapabilityError("tushare daily_price: is_paused has no trusted source")
        raise CapabilityError(f"tushare {name}: not offered")
