"""Queries of the ten operators over whole tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .decontam import LOWER, UPPER, decontaminate
from .html_extract import extract_pages
from .mixing import plan_mixture
from .ngram_join import ngram_components
from .pii import detect_pii
from .quality import quality_filter
from .secret_scan import scan_secrets
from .sharding import TABLE_SIZE, assign_shards, fill_table
from .token_io import tokenize_and_read
from .toxicity import detect

SHARDS = [f"shard-{i:03d}" for i in range(64)]
TOKENIZER = "byte_bpe_50k.json"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return assign_shards(docs, "doc_id", SHARDS).select("doc_id", "source", "n_chars", "slot", "shard")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read_table(spark, sf_dir, "documents"), width=4, percent=85)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mixture(read_table(spark, sf_dir, "documents"), max_repeat=2.0)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_pii(read_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_filter(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_and_read(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), width=10)
    # the columns that the SQL has; proximity matches stay with the operator (n_near)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_html_extraction, op2_sharding, op3_ngram_jaccard_join, op4_source_mixing, op5_pii, op6_secret_scan, op7_quality_rules, op8_toxicity, op9_token_ids, op10_decontamination)
    return {f.__name__: f for f in found}


def _words(text: str, pattern: str) -> str:
    return f"[x FOR x IN string_split_regex({text}, '{pattern}') IF x <> '']"


_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

_SHARDING = """
WITH t AS (SELECT string_split('{owners}', ',') AS owner),
     d AS (SELECT doc_id, source, n_chars,
                  CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {size} AS INTEGER) AS slot
           FROM documents)
SELECT doc_id, source, n_chars, slot, 'shard-' || lpad(t.owner[slot + 1], 3, '0') AS shard FROM d, t
"""

_NGRAMS = f"""
WITH RECURSIVE
w AS (SELECT doc_id, {_words(_LOWER, "[ \\t-\\r]+")} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON r.doc_id = l.x),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""

_QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, {_words("text", "[ \\t-\\r]+")} AS w,
             [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^ \\t-\\r]')] AS l FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS c
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
v AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) t(k) WHERE c > 1 GROUP BY r),
s AS (SELECT doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN v ON v.r = w.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * word_chars OR word_chars > 40 * n_words OR word_chars < n_words
            OR 10 * n_dup_lines > 6 * greatest(len(string_split(text, chr(10))), 1)
            OR 2 * length(regexp_replace(text, '[^0-9]+', '', 'g')) > word_chars
            OR NOT regexp_matches(text, '\\p{{L}}')) AS kept
FROM b
"""

_SPLIT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_DECONTAMINATION = f"""
WITH b AS (SELECT item_id, {_words(_LOWER, _SPLIT)} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + 9], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_words(_LOWER, _SPLIT)} AS w FROM documents),
dw AS (SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS g
       FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
m AS (SELECT DISTINCT r, i, dw.size AS size, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.size = bw.size),
h AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest(range(0, size)) AS k FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN t ON t.r = d.r
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express.

    The sharding table is filled by turns, which SQL could only do slot by
    slot; its owners are therefore spelt out, and a test fills them anew.
    """
    owners = ",".join(map(str, fill_table(SHARDS, TABLE_SIZE)))
    return {
        "op2_sharding": _SHARDING.format(owners=owners, size=TABLE_SIZE),
        "op3_ngram_jaccard_join": _NGRAMS,
        "op7_quality_rules": _QUALITY,
        "op10_decontamination": _DECONTAMINATION,
    }


