"""A corpus pipeline: toxicity, near duplicates, benchmark passages, source mixture, token files.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
with their columns; the last returns what the token files hold.  A stage begins
by having the executors give back what the stages before it no longer need.

Defined results: rows are told apart by id and text, so of an id with several
texts each is judged by its own; of rows that repeat id and text one stays after
the near duplicates; a row without an id, or without words, is no copy of
another; a null text is an empty one; extra columns are kept, whatever their
names; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import materialize, read_table, settle, sweep, written
from quantloom.llm.decontam import decontaminate
from quantloom.llm.mixing import apply_mixture
from quantloom.llm.ngram_join import ngram_components
from quantloom.llm.token_io import tokenize_and_read
from quantloom.llm.toxicity import fit, score

#: Score from which a document is rejected as toxic.
TOXIC = 0.7
#: Rows up to which a list of dropped documents is broadcast (16 bytes each); a longer one is joined by shuffle.
BROADCAST_ROWS = 500_000


def _tag():
    """What tells rows of one id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.lit(17))


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", _tag().alias("tag"))


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text are not among ``rows`` (doc_id, tag)."""
    rows = materialize(rows.where("doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).distinct(), "dropped")
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    held = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__d"), _tag().alias("__t"))
    return held.join(rows, (F.col("__d") == F.col("__id")) & (F.col("__t") == F.col("__tag")), "left_anti").select("__row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    name = next(f"toxic_{i}" for i in range(len(docs.columns) + 1) if f"toxic_{i}" not in {c.lower() for c in docs.columns})
    return score(docs, model, name).where(F.col(name) < TOXIC).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; of repeated rows one."""
    settle(spark)
    found = ngram_components(_tagged(docs), width=5, percent=80, tag_col="tag").where("doc_id is not null")
    found = materialize(found.select("doc_id", "tag", "group"), "near")
    first = found.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "tag")).alias("x"))
    others = found.join(first, "group").where("x.doc_id <> doc_id or x.tag <> tag")
    kept = _without(docs, others)
    if found.groupBy("doc_id", "tag").count().where("count > 1").limit(1).count():
        name = next(f"tag_{i}" for i in range(len(docs.columns) + 1) if f"tag_{i}" not in {c.lower() for c in docs.columns})
        tagged = kept.withColumn(name, _tag())
        kept = tagged.where("doc_id is null").unionByName(tagged.where("doc_id is not null").dropDuplicates(["doc_id", name])).drop(name)
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    found = decontaminate(_tagged(docs), read_table(spark, sf_dir, "benchmark"), width=10, tag_col="tag")
    return _without(docs, found.where("contaminated"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is read at least once; documents of small sources up to twice."""
    settle(spark)
    return apply_mixture(docs, max_repeat=2.0)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    # other stages share the workers' memory: smaller files and fewer kept pieces than the operator's own
    return tokenize_and_read(docs, public_tokenizers.path("byte_bpe_50k.json"), image_bytes=3 << 18, cache_pieces=160_000)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: The toxicity stage's classifier cannot be written in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; between stages the rows are written to the shared folder and read again."""
    docs, before = read_table(spark, sf_dir, "documents"), written()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
            sweep(spark, before, docs)  # what the stage wrote on the way, and the last one's rows
    return docs
