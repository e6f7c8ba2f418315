"""Secret scans: patterns and multipart credential linking.

Patterns give the base spans (assign, access, hex).  A credential often has
parts that mean little alone: an access identifier, a secret, an endpoint.
Weak candidates of each role are gathered with their positions.  A text's scopes
are intervals: the objects in braces, and the runs of lines without a blank
line between.  An interval join finds the scopes of every part: the innermost
object around it and its run of lines.  Candidates are reported only where
complementary roles meet in a scope: an identifier with a secret, or a secret
with an endpoint.  Scopes of one sort do not overlap at a part, so the join is a
search in sorted positions and its work is linear in parts and braces, however
many share a scope.

Kinds of the spans that linking adds: id (client or account identifiers),
key (mixed random strings of 20 or more), endpoint (URLs and host:port).

Defined results: a null or empty text has no spans; positions are code points,
ends exclusive; an added span never overlaps a base one or an earlier added
one; repeated rows are each reported; extra columns are ignored; no rows give
no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

KINDS = ("assign", "access", "hex")
ADDED = ("id", "key", "endpoint")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_ID = re.compile(r"""(?ai:client_?id|account_?id|user_?name|user|login|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""")
_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"(?:https?|ftp|jdbc:[a-z]{2,12}|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@%&+=-]{4,}")
_BLANK = re.compile(r"\n[ \t\r]*(?=\n)")
_BRACE = re.compile(r"[{}]")
_HINT = re.compile(r"://|(?ai:client_?id|account_?id|user|login|key_?id)")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns: leftmost, no overlap within a kind; by start, then kind as listed."""
    out = []
    if "=" in text or ":" in text:
        for m in _ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 6:
                out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                out.append((m.start(), 1, m.end()))
    for m in _HEX.finditer(text):
        out.append((m.start(), 2, m.end()))
    out.sort()
    return [(a, b, KINDS[k]) for a, k, b in out]


def _random_looking(s: str) -> bool:
    """Letters of both cases and digits, and many different characters."""
    return any(c.isdigit() for c in s) and any("a" <= c <= "z" for c in s) and any("A" <= c <= "Z" for c in s) and 2 * len(set(s)) >= min(len(s), 32)


def weak_candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, role) with role as in ADDED, in order of start."""
    out = []
    if _HINT.search(text):
        out += [(m.start(1), m.end(1), 0) for m in _ID.finditer(text)]
        out += [(m.start(), m.end(), 2) for m in _ENDPOINT.finditer(text)]
    out += [(m.start(), m.end(), 1) for m in _KEY.finditer(text) if _random_looking(m.group())]
    return sorted(out)


def scopes(text: str, places) -> list[tuple[int, int]]:
    """(run of lines, innermost object or -1) of each part; ``places``: (start, end) of the parts.

    A part with a brace in it belongs to what lies around the whole of it; a
    brace without its partner is none.
    """
    blanks = [m.end() for m in _BLANK.finditer(text)]
    found, stack = [], []
    if "{" in text:
        for m in _BRACE.finditer(text):
            if m.group() == "{":
                stack.append(m.start())
            elif stack:
                found.append((stack.pop(), m.end()))
    # sweep: at each edge the innermost open object changes
    edges = sorted([(a, 1, i) for i, (a, b) in enumerate(found)] + [(b, 0, i) for i, (a, b) in enumerate(found)])
    order = sorted(range(len(places)), key=lambda i: places[i][0])
    inner, open_, e = [-1] * len(places), [], 0
    for i in order:
        a, b = places[i]
        while e < len(edges) and edges[e][0] <= a:
            _, opens, x = edges[e]
            open_.append(x) if opens else open_.pop()
            e += 1
        around = len(open_) - 1
        while around >= 0 and found[open_[around]][1] < b:
            around -= 1
        inner[i] = open_[around] if around >= 0 else -1
    return [(bisect_right(blanks, a), inner[i]) for i, (a, b) in enumerate(places)]


def link(base, weak, scope_of):
    """Weak candidates that complement another part in one of their scopes.

    An access identifier counts as an identifier, an assigned or hexadecimal
    string as a secret.  ``scope_of``: scopes of ``base`` and then ``weak``.  A
    part that overlaps a candidate is no partner of it.
    """
    role_of = {"assign": 1, "access": 0, "hex": 1}
    parts = [(a, b, role_of[k]) for a, b, k in base] + list(weak)
    held: dict = {}
    for (a, b, r), own in zip(parts, scope_of):
        for sort, scope in enumerate(own):
            if scope >= 0:
                starts, ends = held.setdefault((sort, scope, r), ([], []))
                starts.append(a)
                ends.append(b)
    for starts, ends in held.values():
        starts.sort()
        ends.sort()

    def partner(a, b, key):
        """Some part of the scope and role ends before the candidate or starts after it."""
        starts, ends = held.get(key, ((), ()))
        return bool(starts) and (starts[-1] >= b or ends[0] <= a)

    wants = ((1,), (0, 2), (1,))
    overlaps = overlap_test(base)
    out, free = [], 0
    for (a, b, r), own in sorted(zip(weak, scope_of[len(base) :])):
        if a >= free and not overlaps(a, b) and any(partner(a, b, (sort, scope, w)) for sort, scope in enumerate(own) if scope >= 0 for w in wants[r]):
            out.append((a, b, ADDED[r]))
            free = b
    return out


def overlap_test(spans):
    """A function that tells whether [a, b) overlaps any of ``spans``, which are sorted by start."""
    starts, ends = [], []
    for a, b, _ in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def test(a, b):
        i = bisect_left(starts, b) - 1
        return i >= 0 and ends[i] > a

    return test


def find_spans(text: str):
    """(base spans, all spans)."""
    base = base_spans(text)
    weak = weak_candidates(text)
    added = []
    if weak and len(base) + len(weak) > 1:
        added = link(base, weak, scopes(text, [(a, b) for a, b, _ in (*base, *weak)]))
    order = {k: i for i, k in enumerate((*KINDS, *ADDED))}
    return base, sorted([*base, *added], key=lambda s: (s[0], order[s[2]]))


def join_spans(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts by base kind, base_sha256, spans, n_linked."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                base, spans = find_spans(text.as_py() or "")
                counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
                rows.append((doc_id, *counts, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(spans), len(spans) - len(base)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), schema)
