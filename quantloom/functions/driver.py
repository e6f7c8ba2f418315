"""Small pure functions of the driver: hashes, redaction, keys, dates."""

from __future__ import annotations

import hashlib
import json
import re
from datetime import date, timedelta

#: Names after which a value is a credential, whatever stands around them in a longer name.
_PRIVATE = ("passw", "passphrase", "secret", "token", "credential", "auth", "apikey", "accesskey", "privatekey", "signature", "cookie", "bearer")
_SCHEMES = ("bearer", "basic", "digest", "token", "apikey")
_NAME_CHARS = re.compile(r"[\w.-]+")


def stable_hash(value) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _value_end(text: str, at: int) -> int:
    """Where the value that begins at ``at`` ends: its closing quote, or the next white space or separator."""
    if at < len(text) and text[at] in "\"'":
        close = at + 1
        while close < len(text) and text[close] != text[at]:
            close += 2 if text[close] == "\\" else 1
        return min(close + 1, len(text))
    while at < len(text) and not text[at].isspace() and text[at] not in ",;&}])":
        at += 1
    return at


def redact(message: str, limit: int = 500) -> str:
    """Mask the values of credentials and cap the length.

    One pass over the names of the text: after a private name, what follows a
    ":" or "=", or a blank, is its value; a word for a scheme before the value
    goes with it, and so does a value after a scheme that stands alone.
    """
    text, out, at = str(message), [], 0
    while m := _NAME_CHARS.search(text, at):
        out.append(text[at : m.end()])
        at = m.end()
        name = re.sub(r"[^a-z]", "", m.group().lower())
        if not any(p in name for p in _PRIVATE):
            continue
        begin = at + (text[at : at + 1] in ("'", '"'))
        while begin < len(text) and text[begin] in " \t":
            begin += 1
        marked = begin < len(text) and text[begin] in ":="
        if marked:
            begin += 1
            while begin < len(text) and text[begin] in " \t":
                begin += 1
        scheme = _NAME_CHARS.match(text, begin)
        if scheme and scheme.group().lower() in _SCHEMES and text[scheme.end() : scheme.end() + 1].isspace():
            begin = scheme.end() + 1
            marked = True
        end = _value_end(text, begin)
        if end > begin and (marked or begin > at):
            out.append(text[at:begin] + "***")
            at = end
    return ("".join(out) + text[at:])[:limit]


def check_key(key: str) -> str:
    """A relative, normalised POSIX path without parent steps."""
    parts = key.split("/")
    if not key or key.startswith("/") or "\\" in key or "\0" in key or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"unsafe object key: {key!r}")
    return key


def check_date(text: str) -> str:
    """A strict calendar date YYYY-MM-DD."""
    if not isinstance(text, str) or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"invalid date: {text!r}")
    date.fromisoformat(text)
    return text


def check_range(start: str, end: str) -> tuple[str, str]:
    if check_date(start) > check_date(end):
        raise ValueError("start date is after end date")
    return start, end


def weekday_count(start: str, end: str) -> int:
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    weeks, rest = divmod((b - a).days + 1, 7)
    return weeks * 5 + sum((a.weekday() + i) % 7 < 5 for i in range(rest))


def date_windows(start: str, end: str, days: int) -> list[tuple[str, str]]:
    """Consecutive windows of at most ``days`` days."""
    if days <= 0:
        raise ValueError("days must be positive")
    a, last, out = date.fromisoformat(start), date.fromisoformat(end), []
    while a <= last:
        b = min(last, a + timedelta(days - 1))
        out.append((a.isoformat(), b.isoformat()))
        a = b + timedelta(1)
    return out
