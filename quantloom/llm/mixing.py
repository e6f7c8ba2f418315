"""Mixing sources to target weights by temperature.

Source shares p are raised to an exponent a in [0, 1] and normalised: at 1 the
corpus is as it is, at 0 every source weighs the same.  The exponent is found
by bisection: the smallest at which no source is repeated more often than
``max_repeat`` times, or the one whose weights have ``target_entropy`` of the
way between the entropies at the two ends.  The weights become token budgets,
and each source fills its budget with whole epochs and a part of one: its
documents are dealt into blocks by hash, the blocks of an epoch follow one
another in a hashed order, and the part is cut inside one block only.

So a hot source is never gathered or sorted whole: documents are summed by
block, blocks by ranges of the hashed order, and only the range that holds a
source's cut, and in it the cut block, are put in order.  With as many ranges as
the root of the number of blocks, no task orders more than about that many rows.
What comes out is one row for each source, so the texts are not shuffled unless
``apply_mixture`` is asked for the rows in the order of the permutation.

Defined results: a null source is a source of its own; a null or empty text
has no tokens and is kept once in every whole epoch; identical rows are dealt
alike; extra columns are kept by ``apply_mixture``; no rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Tokens of a block, about.
BLOCK_TOKENS = 20_000
#: Sources whose counts the driver holds (a name and a number each); more raise an error.
MAX_SOURCES = 1_000_000


def weights_at(tokens: list[int], exponent: float) -> list[float]:
    """Normalised weights: shares to the power of the exponent; a source without tokens weighs 0."""
    total = sum(tokens)
    raw = [(t / total) ** exponent if t else 0.0 for t in tokens]
    norm = sum(raw)
    return [x / norm for x in raw]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def repeats_at(tokens: list[int], exponent: float) -> list[float]:
    """How often each source is read so that the least repeated one is read once."""
    w = weights_at(tokens, exponent)
    rate = [x / t if t else 0.0 for x, t in zip(w, tokens)]
    least = min((r for r in rate if r > 0), default=1.0)
    return [r / least if r else 1.0 for r in rate]


def solve_exponent(tokens: list[int], max_repeat: float | None = None, target_entropy: float | None = None, steps: int = 60) -> float:
    """Bisect the exponent.  Repetition falls and entropy falls as it rises, so both have one crossing."""
    if not any(tokens):
        return 1.0
    if target_entropy is not None:
        low, high = entropy(weights_at(tokens, 1.0)), entropy(weights_at(tokens, 0.0))
        goal = low + target_entropy * (high - low)
        fits = lambda a: entropy(weights_at(tokens, a)) <= goal
    else:
        fits = lambda a: max(repeats_at(tokens, a)) <= (max_repeat or 1.0)
    lo, hi = 0.0, 1.0
    if fits(lo):
        return lo
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    return hi


def token_count(text):
    """Words of a text: runs of characters other than 0x20 and 0x09-0x0D."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")


def _hash(seed: int):
    return F.xxhash64("doc_id", "text", F.lit(seed))


def _block(blocks):
    return F.pmod(F.xxhash64(F.col("h"), F.lit("block")), blocks)


def _turn(seed: int):
    """Place of a block in the permutation of its source's blocks; ties follow the block's number."""
    return F.xxhash64(F.col("block"), F.coalesce("source", F.lit("")), F.lit(seed))


def _counted(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"), _hash(seed).alias("h"))


def solve(base: DataFrame, max_repeat: float | None, target_entropy: float | None, seed: int, block_tokens: int) -> DataFrame:
    """One row for each source: its weight, whole epochs, number of blocks, and where its partial epoch ends.

    ``base``: source, n_tokens, h.  The partial epoch has the blocks before
    (cut_turn, cut_block) and of that block the documents up to hash cut_h.
    """
    spark = base.sparkSession
    found = base.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is not None, r["source"] or ""))
    tokens = [r["tokens"] for r in found]
    some = any(tokens)
    exponent = solve_exponent(tokens, max_repeat, target_entropy)
    weights = weights_at(tokens, exponent) if some else [0.0] * len(tokens)
    repeats = repeats_at(tokens, exponent) if some else [1.0] * len(tokens)
    rows = []
    for r, w, x in zip(found, weights, repeats):
        whole = math.floor(x + 1e-9)
        budget = max(0, round((x - whole) * r["tokens"]))
        if budget and budget >= r["tokens"]:  # rounded up to all of it
            whole, budget = whole + 1, 0
        rows.append((r["source"], float(w), float(exponent), int(whole), int(budget), max(1, -(-r["tokens"] // block_tokens))))
    plan = spark.createDataFrame(rows, "source string, weight double, exponent double, whole int, budget long, blocks long")
    ranges = min(1 << 16, math.ceil(math.sqrt(max((r[5] for r in rows), default=1))))
    dealt = _with_plan(base, plan).withColumn("block", _block(F.col("blocks"))).withColumn("turn", _turn(seed))
    # turns are spread evenly over the longs, so a division makes even ranges in their order
    dealt = dealt.withColumn("range", F.shiftright(F.shiftright("turn", 32) * ranges, 32))
    cuts = _cut(dealt.groupBy("source", "range").agg(F.sum("n_tokens").alias("size"), F.max("budget").alias("budget")), ["range"])
    cuts = spark.createDataFrame(cuts.select("source", F.col("range").alias("cut_range"), "before").collect(), "source string, cut_range long, before long")
    dealt = _with_plan(dealt, cuts).where("range = cut_range")
    blocks = dealt.groupBy("source", "block", "turn").agg(F.sum("n_tokens").alias("size"), F.max("budget").alias("budget"), F.max("before").alias("earlier"))
    ends = _cut(blocks, ["turn", "block"], "earlier").select("source", F.col("block").alias("cut_block"), F.col("turn").alias("cut_turn"), "before").collect()
    cuts = spark.createDataFrame([tuple(r) for r in ends], "source string, cut_block long, cut_turn long, before long")
    inside = _with_plan(dealt.drop("before"), cuts).where("block = cut_block")
    # documents with the same hash are copies of one row: all or none of them
    inside = inside.groupBy("source", "h").agg(F.sum("n_tokens").alias("n_tokens"), F.max("budget").alias("budget"), F.max("before").alias("before"))
    reached = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("h").rangeBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("reached", reached).where("before + reached <= budget").groupBy("source").agg(F.max("h").alias("cut_h")).collect()
    cut_h = {r["source"]: r["cut_h"] for r in last}
    end = {r["source"]: (r["cut_turn"], r["cut_block"], cut_h.get(r["source"])) for r in ends}
    full = [(*r, *end.get(r[0], (None, None, None))) for r in rows]
    return spark.createDataFrame(full, "source string, weight double, exponent double, whole int, budget long, blocks long, cut_turn long, cut_block long, cut_h long")


def _cut(parts: DataFrame, order: list[str], earlier: str | None = None) -> DataFrame:
    """The part of each source in which its budget ends, with the tokens before it; ``earlier``: tokens before all of the parts."""
    sum_before = F.sum("size").over(Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(sum_before, F.lit(0)) + (F.col(earlier) if earlier else F.lit(0))
    return parts.withColumn("before", before).where("before <= budget and budget < before + size")


def _with_plan(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Add the columns of a plan, which has one row for each of at most MAX_SOURCES sources."""
    plan = plan.withColumnRenamed("source", "__source")
    return df.join(F.broadcast(plan), df["source"].eqNullSafe(plan["__source"]), "left").drop("__source")


def _copies(df: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Add weight, block, turn and n_copies to rows that have source and h."""
    out = _with_plan(df, plan).withColumn("block", _block(F.col("blocks"))).withColumn("turn", _turn(seed))
    earlier = (F.col("turn") < F.col("cut_turn")) | ((F.col("turn") == F.col("cut_turn")) & (F.col("block") < F.col("cut_block")))
    within = (F.col("block") == F.col("cut_block")) & (F.col("h") <= F.col("cut_h"))
    extra = F.coalesce((earlier | within).cast("int"), F.lit(0))
    return out.withColumn("n_copies", F.col("whole") + extra)


def plan_mixture(docs: DataFrame, max_repeat: float | None = 2.0, target_entropy: float | None = None, seed: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, n_tokens, weight, exponent, block, turn, n_copies.

    A document is read ``n_copies`` times: in every whole epoch, and once more
    if its place in the order of the partial epoch lies within the budget.
    """
    base = materialize(_counted(docs, seed), "mixing")
    plan = solve(base, max_repeat, target_entropy, seed, block_tokens)
    return _copies(base, plan, seed).select("doc_id", "source", "n_tokens", "weight", "exponent", "block", "turn", "n_copies")


def apply_mixture(docs: DataFrame, max_repeat: float | None = 2.0, target_entropy: float | None = None, seed: int = 0, block_tokens: int = BLOCK_TOKENS, ordered: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mixture reads it.

    ``ordered``: epoch by epoch, and in each the blocks of all sources in the
    order of their permutation, which shuffles the texts once; else rows stay
    where they are.
    """
    base = materialize(_counted(docs, seed), "mixing")
    plan = solve(base, max_repeat, target_entropy, seed, block_tokens)
    names = docs.columns
    held = _copies(docs.select(F.struct(*names).alias("__row"), F.col("source"), _hash(seed).alias("h")), plan, seed)
    rows = held.where("n_copies > 0").select("__row", "turn", "block", "h", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("epoch"))
    if ordered:
        rows = rows.repartitionByRange("epoch", "turn", "block", "h").sortWithinPartitions("epoch", "turn", "block", "h")
    return rows.select("__row.*")
