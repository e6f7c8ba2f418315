"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

1. The index stores a posting (term, key, position) for every occurrence of a
   benchmark word in any document, in the shared folder.  Documents are split
   into words once.
2. The length of every posting list is counted, and the words of each window
   (a run of ``width`` words of an item) are put in order of their lists'
   lengths, rarest first.
3. Lists are intersected from the rarest: its postings, shifted by the word's
   offset, are a window's candidates; those with no posting of the second
   rarest word near enough go; the lists of all words are then intersected with
   what is left.  Joins are on (term, key, stretch of the document), so neither
   a frequent word nor a long document gathers in one task.
4. A candidate is an exact phrase match if every word has a posting at its own
   offset, and a proximity match if every word has one within ``width`` - 1
   words of the rarest word's, in any order.

Defined results: a null text has no words; an item without words has no
windows; an item of fewer words than the window is one window; repeated
documents are each reported; repeated items, or items with the same text, all
count; an item without an id counts but is not named in items_sha256; extra
columns are ignored; no items give no hits, no documents no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII other than letters and digits.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Benchmark words up to which they are held as one set in the plan; more are joined.
MAX_TERMS = 30_000
#: Bytes up to which words or windows of the benchmark are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def word_array(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; other letters stay as they are."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _small(table: DataFrame, weight) -> DataFrame:
    """The table marked for broadcast if its rows weigh ``BROADCAST_BYTES`` or less."""
    return F.broadcast(table) if (table.agg(F.sum(weight).alias("w")).first()["w"] or 0) <= BROADCAST_BYTES else table


def benchmark_windows(items: DataFrame, width: int) -> DataFrame:
    """(wid, window): every different run of ``width`` words, or the whole of a shorter item, with item_ids, the items that have it."""
    if not 1 <= width <= 62:
        raise ValueError("a window has 1 to 62 words")
    words = items.select("item_id", word_array(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    at = F.expr(f"sequence(0, greatest(n - {width}, 0))")
    runs = words.select("item_id", "w", F.explode(at).alias("i")).select("item_id", F.expr(f"slice(w, i + 1, {width})").alias("window"))
    # an item may hold a window, and a window may stand in items, very often: pairs first
    return runs.distinct()


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Positional postings (key, term, position) of ``terms``; the first row of a document, with or without a term, has its doc_id and n_words.

    ``docs``: key, doc_id and the word array w.
    """
    rows = terms.limit(MAX_TERMS + 1).collect()
    first = F.col("position").isNull() | (F.col("position") == 0)
    # words go by one at a time, so no list of postings is ever built for a document
    each = docs.withColumn("n", F.size("w")).select("key", "doc_id", "n", F.posexplode_outer("w").alias("position", "term"))
    if len(rows) <= MAX_TERMS:
        known = F.col("term").isin([r["term"] for r in rows]) if rows else F.lit(False)
    else:
        table = _small(terms.select(F.col("term").alias("__t")), F.octet_length("__t") + 16).withColumn("__known", F.lit(True))
        each = each.join(table, F.col("term") == F.col("__t"), "left")
        known = F.coalesce("__known", F.lit(False))
    each = each.where(first | known)
    return materialize(each.select("key", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("n").cast("long")).alias("n_words"), F.when(known, F.col("term")).alias("term"), "position"), "index")


def plan_windows(windows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(window, wid, words): the words of each window that can occur, rarest first.

    words: structs (n, term, offset) with n the length of the term's list; ties
    go by term, then offset.  A window with a word that no document has is left out.
    """
    flat = windows.select("window").distinct().withColumn("wid", F.monotonically_increasing_id())
    flat = materialize(flat, "windows")
    each = flat.select("wid", F.posexplode("window").alias("offset", "term")).join(lengths, "term", "left")
    words = each.groupBy("wid").agg(F.count_if(F.col("n").isNull()).alias("absent"), F.array_sort(F.collect_list(F.struct("n", "term", "offset"))).alias("words"))
    return flat.join(words.where("absent = 0"), "wid").select("window", "wid", "words")


def intersect(index: DataFrame, plan: DataFrame, width: int) -> DataFrame:
    """(wid, key, start, size, exact) of every place where a window's words all stand near its rarest word.

    ``exact``: they stand at their own offsets, and ``start`` is where the
    phrase begins; otherwise it is the rarest word's place less its offset.
    """
    reach = width - 1
    stretch = max(2 * reach, 1)
    postings = index.where("term is not null").select("key", "term", "position", F.floor(F.col("position") / stretch).cast("int").alias("at"))
    heads = plan.select("wid", F.col("words")[0].alias("x"), F.try_element_at(F.array_distinct(F.transform("words", lambda w: w["term"])), F.lit(2)).alias("next"), F.size("words").alias("size"))
    heads = _small(heads.select("wid", "size", "next", "x.term", "x.offset"), F.octet_length("term") * 2 + 48)
    found = postings.drop("at").join(heads, "term")
    near = F.explode(F.array_distinct(F.array(*[F.floor((F.col("position") + d) / stretch).cast("int") for d in (-reach, reach)])))
    around = found.select("wid", "key", "position", "offset", "size", "next", near.alias("at"))
    seconds = _small(plan.select(F.try_element_at(F.array_distinct(F.transform("words", lambda w: w["term"])), F.lit(2)).alias("term")).where("term is not null").distinct(), F.octet_length("term") + 16)
    second = postings.join(seconds, "term", "left_semi").select(F.col("key").alias("k2"), F.col("term").alias("t2"), F.col("position").alias("p2"), F.col("at").alias("a2"))
    close = F.abs(F.col("p2") - F.col("position")) <= reach
    left = around.where("next is not null").join(second, (F.col("next") == F.col("t2")) & (F.col("key") == F.col("k2")) & (F.col("at") == F.col("a2")) & close, "left_semi")
    left = left.unionByName(around.where("next is null"))  # a window of one word over and over has no second one
    left = materialize(left.select("wid", "key", "position", "offset", "size").distinct(), "candidates")
    # all words of what is left; only its documents' lists are read
    words = plan.select("wid", F.explode("words").alias("x")).select(F.col("wid").alias("w2"), "x.term", F.col("x.offset").alias("o2"))
    first = words.groupBy("w2", "term").agg(F.min("o2").alias("m"))
    words = _small(words.join(first, ["w2", "term"]).select("w2", "term", "o2", "m"), F.octet_length("term") + 24)
    wanted = left.join(words, F.col("wid") == F.col("w2")).select("wid", "key", "position", "offset", "size", "term", "o2", "m", near.alias("at"))
    keys = _small(left.select("key").distinct(), F.lit(16))
    there = postings.join(keys, "key", "left_semi").select("key", "term", "at", F.col("position").alias("p2"))
    met = wanted.join(there, ["key", "term", "at"]).where(close)
    bit = lambda c: F.expr(f"shiftleft(1L, {c})")
    masks = met.groupBy("wid", "key", "position", "offset", "size").agg(
        F.bit_or(bit("m")).alias("near"), F.bit_or(F.when(F.col("p2") - F.col("position") == F.col("o2") - F.col("offset"), bit("o2")).otherwise(F.lit(0).cast("long"))).alias("whole")
    )
    terms = words.groupBy("w2").agg(F.bit_or(bit("m")).alias("all_terms"))
    terms = _small(terms, F.lit(16))
    kept = masks.join(terms, F.col("wid") == F.col("w2")).where("near = all_terms")
    return kept.select("wid", "key", (F.col("position") - F.col("offset")).alias("start"), "size", (F.col("whole") == bit("size") - 1).alias("exact"))


def find_matches(docs: DataFrame, items: DataFrame, width: int = 10):
    """(index, matches): postings with a row for each document, and (key, start, size, exact, item_id) of phrase and proximity matches.

    ``docs``: doc_id and text.
    """
    windows = materialize(benchmark_windows(items.select("item_id", "text"), width), "runs")
    terms = windows.select(F.explode("window").alias("term")).distinct()
    words = docs.select("doc_id", word_array(F.col("text")).alias("w")).withColumn("key", F.monotonically_increasing_id())
    index = build_index(words, terms)
    lengths = index.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    plan = materialize(plan_windows(windows, lengths), "plan")
    places = intersect(index, plan, width)
    owners = _small(windows.join(plan.select("window", "wid"), "window").select("item_id", "wid"), F.lit(32))
    return index, materialize(places.join(owners, "wid").select("key", "start", "size", "exact", "item_id"), "matches")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, tag_col: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near; with ``tag_col``, a long, also tag.

    The first columns are from exact phrases; n_near counts the items with a
    proximity match, those with an exact one included.
    """
    names = ["doc_id", *([tag_col] if tag_col else [])]
    index, found = find_matches(docs.select(F.struct(*names).alias("doc_id"), "text"), items, width)
    counts = index.where("n_words is not null").select("key", "doc_id.*", "n_words")
    spans = found.where("exact").groupBy("key", "start").agg(F.max("size").alias("size"))
    before = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("end", F.col("start") + F.col("size")).withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
    n_hit = spans.groupBy("key").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))).cast("long").alias("n_hit"))
    pairs = found.select("key", F.col("item_id").cast("string").alias("item"), "exact").groupBy("key", "item").agg(F.max("exact").alias("exact"))
    by_item = pairs.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"), F.count_if("exact").alias("n_items"), F.count(F.lit(1)).alias("n_near"))
    joined = counts.join(n_hit, "key", "left").join(by_item, "key", "left")
    items_of = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return joined.select(
        "doc_id",
        *([F.col(tag_col).cast("long").alias("tag")] if tag_col else []),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
