"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Statistics of a text come from array functions over its words, in one pass and
without a shuffle.  A rule's condition holds the statistics that it needs, so a
CASE expression that stops at the first rule that rejects computes no more than
it must.  Each rule's cost and selectivity is estimated on a sample, and the
rules run in order of rejections per cost.  The order never changes a verdict,
only the work, so an estimate that is off can't change a result.

Defined results: a null or empty text has no words and every count is 0 (the
base rule rejects it); repeated rows are kept; extra columns are kept, but one
that has the name of a result is replaced by it; no rows give no rows.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import other_columns

#: White space between words: 0x20 and 0x09-0x0D.
SPACE = "[ \\t-\\r]+"
#: Rows, about, of the sample on which the rules are estimated, and characters of a text that count there; it decides their order only.
SAMPLE_ROWS = 256
SAMPLE_CHARS = 20_000
#: A rule is timed over the sample so many times over, in so many runs of which the fastest counts.
SAMPLE_TIMES, SAMPLE_RUNS = 4, 3


@dataclass(frozen=True)
class Rule:
    """A name and a condition over the statistics; true rejects."""

    name: str
    rejects: Column


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with a name for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def words_sql(text: str) -> str:
    return f"array_remove(split({text}, '[ \\\\t-\\\\r]+'), '')"


def repeat_words_sql(w: str, named: str = "xxhash64({0}, {1}, {2})") -> str:
    """Words in three-word windows that the array ``w`` holds twice or more.

    A window is named by the hash of its words with the low bits replaced by its
    position, so that one sort of longs brings equal windows together.  Words
    of neighbours with one hash are then compared; only if some differ are the
    windows that share a hash sorted by their words instead.  So the count is
    exact however long the text is.  ``named``: the hash of three words.
    """
    at = f"if(size({w}) >= 3, sequence(0, size({w}) - 3), cast(array() as array<int>))"
    keys = f"sort_array(transform({at}, i -> (shiftleft(shiftright({named.format(*(f'get({w}, i + {n})' for n in range(3)))}, b), b) | i)))"
    place = "cast(get(k, {0}) & (shiftleft(1L, b) - 1) as int)"
    same = "shiftright(get(k, {0}), b) = shiftright(get(k, {1}), b)"
    words_differ = " or ".join(f"get({w}, {place.format('j')} + {i}) <> get({w}, {place.format('j - 1')} + {i})" for i in range(3))
    shared = f"filter({at}, j -> {same.format('j', 'j - 1')} or {same.format('j', 'j + 1')})"
    mixed = f"exists(c, j -> j > 0 and {same.format('j', 'j - 1')} and ({words_differ}))"
    triples = f"sort_array(transform(c, j -> named_struct('x', get({w}, {place.format('j')}), 'y', get({w}, {place.format('j')} + 1), 'z', get({w}, {place.format('j')} + 2), 'p', {place.format('j')})))"
    equal = "(get(t, i).x = get(t, {0}).x and get(t, i).y = get(t, {0}).y and get(t, i).z = get(t, {0}).z)"
    by_words = _let(triples, "t", f"transform(filter(sequence(0, size(t) - 1), i -> {equal.format('i - 1')} or {equal.format('i + 1')}), i -> get(t, i).p)")
    places = _let(shared, "c", f"if({mixed}, {by_words}, transform(c, j -> {place.format('j')}))")
    covered = "aggregate(sort_array({0}), named_struct('end', 0, 'n', 0L), (a, p) -> named_struct('end', p + 3, 'n', a.n + p + 3 - greatest(a.end, p)), a -> a.n)"
    return _let(f"cast(ceil(log2(size({w}) + 2)) as int)", "b", _let(keys, "k", covered.format(places)))


def stats(text: str = "__text", w: str = "__words") -> dict[str, Column]:
    """Statistics over a text without nulls and the array of its words; all long."""
    lines = f"filter(split({text}, '\\n'), x -> x rlike '[^ \\\\t-\\\\r]')"
    found = {
        "n_words": f"size({w})",
        "word_chars": f"length(array_join({w}, ''))",
        "n_symbols": f"length(regexp_replace({text}, '[^#*$%&|<>]+', ''))",
        "n_dup_lines": _let(lines, "l", "size(l) - size(array_distinct(l))"),
        "n_repeat_words": repeat_words_sql(w),
    }
    return {name: F.expr(sql).cast("long") for name, sql in found.items()}


def base_rule(s: dict[str, Column] | None = None) -> Rule:
    s = s or stats()
    return Rule("base", (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"]))


def default_rules(s: dict[str, Column] | None = None) -> list[Rule]:
    """Rules of the method beside the base rule: each rejects only what no prose looks like."""
    s = s or stats()
    text = F.col("__text")
    return [
        Rule("symbols", 10 * s["n_symbols"] > 3 * s["word_chars"]),
        Rule("word_length", (s["word_chars"] > 40 * s["n_words"]) | (s["word_chars"] < s["n_words"])),
        Rule("dup_lines", 10 * s["n_dup_lines"] > 6 * F.greatest(F.size(F.split(text, "\n")), F.lit(1))),
        Rule("digits", 2 * F.length(F.regexp_replace(text, "[^0-9]+", "")) > s["word_chars"]),
        Rule("no_letters", ~text.rlike("\\p{L}")),
    ]


def _prepared(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` in a struct, the text without nulls and its words, which all statistics start from."""
    held = docs.select(F.struct(*docs.columns).alias("__row"), F.coalesce(text, F.lit("")).alias("__text"))
    return held.withColumn("__words", F.expr(words_sql("__text")))


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Texts of about ``rows`` rows drawn from the whole table with equal chances, a long one cut after ``SAMPLE_CHARS`` characters."""
    share = min(1.0, rows / max(1, docs.count()))
    picked = docs.sample(fraction=share, seed=7).select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).collect()
    return docs.sparkSession.createDataFrame([(r["text"],) for r in picked], "text string")


def estimates(sample: DataFrame, rules: list[Rule]) -> dict[str, tuple[int, float]]:
    """(rejected rows, seconds) of each rule over the sample, each with the statistics that it needs and no others."""
    many = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_TIMES)))).select("text")
    prepared = _prepared(many, F.col("text")).select("__text", "__words")

    def timed(condition):
        best, n = None, 0
        for _ in range(SAMPLE_RUNS):
            began = time.perf_counter()
            n = prepared.agg(F.count_if(condition).alias("n")).first()["n"]
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        return n, best

    _, idle = timed(F.size("__words") < 0)  # splitting into words is shared, and so is the job itself
    found = {}
    for rule in rules:
        n, took = timed(rule.rejects)
        found[rule.name] = n // SAMPLE_TIMES, max(took - idle, 1e-4)
    return found


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Sort rules by rejections per second, both measured on a sample.

    Ties, and rules that reject nothing on the sample, are ordered by cost, then name.
    """
    found = estimates(sample_of(docs, sample_rows), rules)
    return sorted(rules, key=lambda r: (-found[r.name][0] / found[r.name][1], found[r.name][1], r.name))


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, else null; later rules are not evaluated for a rejected row."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def verdicts(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add ``rejected_by`` (a rule that rejects the row, or null) and ``kept``, computing no statistic that the verdict does not need.

    The base rule takes its place in the order like any other.
    """
    rules = [base_rule(), *default_rules()] if rules is None else rules
    ordered = order_rules(docs, rules, sample_rows)
    out = _prepared(docs, F.col("text")).select("__row", cascade(ordered).alias("rejected_by"))
    return _unpacked(out, docs, {"rejected_by": F.col("rejected_by"), "kept": F.col("rejected_by").isNull()})


def quality_filter(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics and verdict for every row: ``base_failed``, ``kept`` and ``rejected_by`` (a rule that rejects the row, or null).

    The statistics are wanted for all rows, so rules share them instead of computing them again.
    """
    names = list(stats())
    shared = {n: F.col(f"__{n}") for n in names}
    rules = default_rules() if rules is None else rules
    again = {r.name: r for r in default_rules(shared)}
    ordered = [again.get(r.name, r) for r in order_rules(docs, rules, sample_rows)] if rules else []
    out = _prepared(docs, F.col("text")).select("*", *[c.alias(f"__{n}") for n, c in stats().items()])
    base = base_rule(shared)
    out = out.withColumn("__base", F.coalesce(base.rejects, F.lit(False)))
    out = out.withColumn("__by", F.when(F.col("__base"), F.lit(base.name)).otherwise(cascade(ordered)))
    return _unpacked(out, docs, shared | {"base_failed": F.col("__base"), "rejected_by": F.col("__by"), "kept": F.col("__by").isNull()})


def _unpacked(out: DataFrame, docs: DataFrame, results: dict[str, Column]) -> DataFrame:
    kept = [F.col("__row").getField(c).alias(c) for c in other_columns(docs, results)]
    return out.select(*kept, *[c.alias(n) for n, c in results.items()])
