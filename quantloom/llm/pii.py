"""Personal data by patterns and a semi-Markov conditional random field.

Patterns give the base spans (email, ip, card, phone).  The random field scores
whole segments of one to ``MAX_TOKENS`` tokens: features see a candidate span
at once (its shape, lengths, digit counts, checksum, the word before it), and a
dynamic programme over segments of bounded length chooses boundaries and types
together.  It adds spans that no pattern has, such as a number with blanks and
brackets after "phone", or an address spelt with "(at)"; base spans always stay,
and an added span never overlaps one.

A segment of a type must begin and end with a token that holds a digit or one
of "@", "(at)", "[at]", and a score outside such segments is 0; so only runs of
tokens around them are looked at, which gives the same best path as the whole
text.  The field is trained here, on made-up sentences of a fixed seed, by
stochastic gradient ascent on the conditional likelihood; expectations come
from the forward-backward recursion over segments.

Defined results: a null or empty text has no spans; positions are code points,
ends exclusive; repeated rows are each reported; extra columns are ignored; no
rows give no rows.
"""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal
from .secret_scan import overlap_test

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns, leftmost and without overlap within a kind; by start, then kind as listed."""
    out = []
    if "@" in text:
        free = 0  # where the last match ended
        for m in _AT.finditer(text):
            a = m.start()
            while a > free and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append((a, 0, m.end()))
                free = m.end()
    if "." in text:
        for m in _IP.finditer(text):
            # a part of many zeros is a small number too; a long one need not be turned into an int
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return [(a, b, KINDS[k]) for a, k, b in out]


def join_spans(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# --- the random field -------------------------------------------------------

#: A token is a run without white space; trailing punctuation is no part of a segment.
_TOKEN = re.compile(r"\S+")
_TRIGGER = re.compile(r"[0-9@]|[(\[](?:at|AT)[)\]]")
_TAIL = ".,;:!?\"'*%#$&|<>)]}"
_LEAD = "\"'<[{"
#: A whole address; white space may stand around a spelt-out at sign.
_MAIL = re.compile(r"[\w.%+-]+(?:@|\s?[(\[](?:at|AT)[)\]]\s?)(?:[\w-]+(?:\.|\s?[(\[](?:dot|DOT)[)\]]\s?))+[A-Za-z]{2,}")
_CUES = {
    "mail": 0, "email": 0, "e-mail": 0, "contact": 0, "write": 0,
    "ip": 1, "host": 1, "server": 1, "address": 1,
    "card": 2, "visa": 2, "credit": 2, "number": 2, "mastercard": 2,
    "phone": 3, "tel": 3, "call": 3, "mobile": 3, "fax": 3, "telephone": 3,
}


def tokens_near(text: str):
    """Runs of tokens (start, end) that hold, or stand within MAX_TOKENS of, a trigger; each run with its triggers."""
    if not _TRIGGER.search(text):
        return
    run, marks, last = [], [], None
    for m in _TOKEN.finditer(text):
        hit = bool(_TRIGGER.search(m.group()))
        if hit:
            last = 0
        elif last is not None:
            last += 1
        run.append((m.start(), m.end()))
        marks.append(hit)
        if last is None:
            if len(run) > 2:  # words before a trigger that a feature may look at
                del run[0], marks[0]
        elif last > MAX_TOKENS:
            yield run[:-1], marks[:-1]
            run, marks, last = run[-1:], marks[-1:], None
        elif len(run) >= 512 and not hit and not any(marks[-MAX_TOKENS:]):
            yield run, marks
            run, marks, last = [], [], None
    if any(marks):
        yield run, marks


def segment_features(text: str, a: int, b: int, before: str) -> list[str]:
    """Features of a whole candidate span."""
    s = text[a:b]
    d = _digits(s)
    n = len(d)
    low = s.lower()
    at = "@" in s or "(at)" in low or "[at]" in low
    groups = len(re.findall(r"[0-9]+", s))
    letters = sum(c.isalpha() for c in s)
    dots = s.count(".") + low.count("(dot)") + low.count("[dot]")
    out = [
        f"digits={'mail' if at else min(n, 20)}",
        f"groups={'mail' if at else min(groups, 6)}",
        f"mail={bool(at and _MAIL.fullmatch(s))}",
        f"at={at}",
        f"letters={'none' if not letters else 'few' if letters <= n else 'many'}",
        f"plus={s[0] == '+'}",
        f"brackets={'(' in s and ')' in s and not at}",
        f"dots={min(dots, 2 if at else 4)}|at={at}",
        f"tokens={s.count(' ') + 1}",
        f"odd={bool(re.search(r'[^0-9A-Za-z@.+() _%/:-]|[.][.]', s))}",
    ]
    if 13 <= n <= 19 and not letters:
        out.append(f"luhn={luhn(d)}")
    if groups == 4 and not letters and n <= 12:
        out.append(f"octets={all(int(x) <= 255 for x in re.findall(r'[0-9]+', s))}|dots={dots}")
    cue = _CUES.get(before.lower().strip(_TAIL + "()"))
    out.append(f"cue={cue}")
    return out


class Field:
    """Weights of features by type, and of the types themselves."""

    def __init__(self, weights: dict[tuple[str, int], float] | None = None):
        self.weights = weights or {}

    def lattice(self, text, run, marks):
        """Candidate segments: list of (first token, end token, start, end, features)."""
        out = []
        for i in range(len(run)):
            if not marks[i]:
                continue
            before = text[run[i - 1][0] : run[i - 1][1]] if i else ""
            for j in range(i, min(len(run), i + MAX_TOKENS)):
                if not marks[j]:
                    continue
                a, b = run[i][0], run[j][1]
                while b > a and text[b - 1] in _TAIL:
                    b -= 1
                while a < b and text[a] in _LEAD:
                    a += 1
                if b > a and "\n" not in text[a:b]:
                    out.append((i, j + 1, a, b, segment_features(text, a, b, before)))
        return out

    def score(self, features, kind):
        w = self.weights
        return sum(w.get((f, kind), 0.0) for f in features) + w.get(("bias", kind), 0.0)

    def best(self, text, run, marks):
        """Spans of the best segmentation (Viterbi over segments); ties go to fewer and later types."""
        n = len(run)
        ends: dict[int, list] = {}
        for i, j, a, b, features in self.lattice(text, run, marks):
            ends.setdefault(j, []).append((i, a, b, features))
        top, back = [0.0] * (n + 1), [None] * (n + 1)
        for t in range(1, n + 1):
            top[t] = top[t - 1]
            for i, a, b, features in ends.get(t, ()):
                for kind in range(len(KINDS)):
                    x = top[i] + self.score(features, kind)
                    if x > top[t]:
                        top[t], back[t] = x, (i, a, b, kind)
        out, t = [], n
        while t:
            if back[t] is None:
                t -= 1
            else:
                i, a, b, kind = back[t]
                out.append((a, b, kind))
                t = i
        return out[::-1]

    def learn(self, text, gold, rate):
        """One gradient step of the conditional log-likelihood on a sentence.  ``gold``: {(start, end): kind}."""
        import math

        for run, marks in tokens_near(text):
            n = len(run)
            cells = self.lattice(text, run, marks)
            scores = [[self.score(c[4], k) for k in range(len(KINDS))] for c in cells]
            by_end: dict[int, list[int]] = {}
            by_start: dict[int, list[int]] = {}
            for x, c in enumerate(cells):
                by_end.setdefault(c[1], []).append(x)
                by_start.setdefault(c[0], []).append(x)

            def add(values):
                m = max(values)
                return m + math.log(sum(math.exp(v - m) for v in values))

            forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
            for t in range(1, n + 1):
                forward[t] = add([forward[t - 1]] + [forward[cells[x][0]] + s for x in by_end.get(t, ()) for s in scores[x]])
            for t in range(n - 1, -1, -1):
                backward[t] = add([backward[t + 1]] + [backward[cells[x][1]] + s for x in by_start.get(t, ()) for s in scores[x]])
            for x, (i, j, a, b, features) in enumerate(cells):
                for k in range(len(KINDS)):
                    expected = math.exp(min(0.0, forward[i] + scores[x][k] + backward[j] - forward[n]))
                    g = rate * ((1.0 if gold.get((a, b)) == k else 0.0) - expected)
                    if abs(g) > 1e-6:
                        for f in (*features, "bias"):
                            self.weights[f, k] = self.weights.get((f, k), 0.0) * (1 - 1e-4 * rate) + g


def training_sentences(count: int, seed: int):
    """Made-up sentences with known spans, and with numbers that are none."""
    rng = random.Random(seed)
    plain = ["the", "of", "and", "was", "in", "order", "from", "page", "que", "der", "los", "value", "total", "version", "on", "see"]

    def number(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def name():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))

    def card():
        d = str(rng.randint(3, 6)) + number(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice(["", " ", "-", ".", "  "[:1]])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def entity(kind):
        if kind == 0:
            at = rng.choice(["@", "@", "@", "(at)", "[at]", " (at) "])
            local = name() + rng.choice(["", "." + name(), "." + number(2), "_" + name(), number(2)])
            if at == " (at) ":  # a segment begins and ends with a token that holds a digit or an at sign
                return f"{local}{number(1)} (at) {name()}{number(1)}.com"
            return local + at + "".join(name() + rng.choice(["", "", number(1), "-" + name()]) + "." for _ in range(rng.randint(1, 3))) + rng.choice(["com", "org", "net", "de", "fr", "info"])
        if kind == 1:
            return ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == 2:
            return card()
        shape = rng.randint(0, 4)
        if shape == 0:
            return f"+{rng.randint(1, 99)} {number(3)} {number(3)} {number(4)}"
        if shape == 1:
            return f"({number(3)}) {number(3)}-{number(4)}"
        if shape == 2:
            return f"{number(3)}-{number(3)}-{number(4)}"
        if shape == 3:
            return f"+{rng.randint(1, 99)}-{number(3)}-{number(7)}"
        return f"0{number(3)} {number(7)}"

    def noise():
        shape = rng.randint(0, 8)
        if shape == 0:
            return number(rng.randint(1, 6))
        if shape == 1:
            return f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
        if shape == 2:
            return f"{number(1)}.{number(2)}"
        if shape == 3:
            return number(rng.randint(16, 16))[:-1] + "x"
        if shape == 4:
            return f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 20)}"
        if shape == 5:
            return "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([24, 32, 40])))
        if shape == 6:
            return f"{rng.randint(0, 23)}:{rng.randint(0, 59):02d}"
        if shape == 7:
            return "@" + name()
        d = number(16)
        return d if not luhn(d) else d + "1"

    cues = {k: [w for w, x in _CUES.items() if x == k] for k in range(4)}
    for _ in range(count):
        text, gold = "", {}
        for _ in range(rng.randint(3, 9)):
            roll = rng.random()
            if roll < 0.25:
                kind = rng.randrange(4)
                bare = entity(kind)
                strong = not (kind == 3 and bare[0] != "+")
                if not strong or rng.random() < 0.5:
                    text += rng.choice(cues[kind]) + rng.choice([" ", ": "])
                gold[len(text), len(text) + len(bare)] = kind
                text += bare + rng.choice(["", "", "", ",", ".", ")", "***", "%%%"]) + " "
            elif roll < 0.5:
                text += noise() + rng.choice(["", ","]) + " "
            for _ in range(rng.randint(1, 4)):
                text += rng.choice(plain) + rng.choice(["", "", "", ",", "."]) + " "
        yield text.strip(), gold


def train_field(count: int = 1500, seed: int = 11, epochs: int = 3) -> Field:
    """Fit the field on made-up sentences; a second or two on one core."""
    field = Field()
    sentences = list(training_sentences(count, seed))
    for e in range(epochs):
        for text, gold in sentences:
            field.learn(text, gold, 0.2 / (1 + e))
    field.weights = {k: round(v, 6) for k, v in field.weights.items() if abs(v) > 1e-4}
    return field


def find_spans(text: str, field: Field):
    """(base spans, all spans): the field's spans join the base ones where they overlap none of them."""
    base = base_spans(text)
    out = list(base)
    overlaps = overlap_test(base)
    for run, marks in tokens_near(text):
        for a, b, kind in field.best(text, run, marks):
            if not overlaps(a, b):
                out.append((a, b, KINDS[kind]))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return base, out


def detect_pii(docs: DataFrame, field: Field | None = None, seed: int = 11) -> DataFrame:
    """Per row: doc_id, counts by base kind, base_sha256, spans, n_added."""
    weights = (field or train_field(seed=seed)).weights
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches):
        import pyarrow as pa

        f = Field(shared.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                base, spans = find_spans(text.as_py() or "", f)
                counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
                rows.append((doc_id, *counts, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(spans), len(spans) - len(base)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), schema)
