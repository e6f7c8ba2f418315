"""The corpus pipeline: run() against a brute-force version of every stage, and odd tables."""

import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm.test_llm import brute_components, brute_matches

import corpus_pipeline as P
from quantloom.llm import mixing, toxicity
from quantloom.llm.common import settle

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with null, empty, repeated, long and tied rows, and columns whose names stages use inside."""
    out = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    some = [tuple(r) for r in docs.where("n_chars > 300").orderBy("doc_id").limit(6).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    long = " ".join(f"w{i * 7919 % 5003} x{i % 977}" for i in range(40_000))
    more = [
        (9001, None, None, None, 0), (9002, "", "en", "odd", 0), (9003, " \n ", "en", "odd", 3), (9004, long, "en", "odd", 9), (9005, long + " end", "de", "odd", 9), (9006, "one two", "xx", "odd", 7),
        (None, "no id here at all", "en", "odd", 1), (None, some[0][1], "en", "odd", 1), (9007, f"before {item} after", "en", "odd", 5), (9007, "another text under the same id that is clean and stays", "en", "odd", 5),
        (9008, some[1][1], "en", "odd", 5), (9008, some[1][1], "en", "odd", 5), (9009, "twice the same row of some words", "en", "odd", 2), (9009, "twice the same row of some words", "en", "odd", 2), (9010, "", "en", "odd", 2), (9010, "", "en", "odd", 2),
    ]
    clash = {c: F.lit(-5) for c in ("score", "tag", "group", "h", "block", "turn", "n_copies", "key", "toxic_0", "w", "tag_0")}
    docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumns(clash).write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return out


def naive_scores(model, texts):
    """Probabilities by looping over positions, filters and texts."""
    out = []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        rows, _ = toxicity.token_ids(raw, np.array([0, len(raw)]))
        maxima = []
        for w in toxicity.WIDTHS:
            for f in range(len(model.bias[w])):
                sums = [sum(float(model.filters[w][k][c][f]) for k in range(w) if i + k < len(rows) for c in rows[i + k]) + float(model.bias[w][f]) for i in range(len(rows))]
                maxima.append(max([0.0, *sums]))
        margin = float(np.dot(maxima, model.out)) + model.out_bias
        out.append(1 / (1 + math.exp(-max(-40, min(40, model.scale[0] * margin + model.scale[1])))))
    return out


def naive_mixture(spark, rows):
    """Copies of each row: epochs of the documents of a source in the order of their blocks, until its budget is used up."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, doc_id long, text string, lang string, source string, n_chars long")
    h = {r.i: r.h for r in df.select("i", F.xxhash64("doc_id", "text", F.lit(0)).alias("h")).collect()}
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    sources = sorted({r[3] for r in rows}, key=str)
    total = [sum(n for n, r in zip(size, rows) if r[3] == s) for s in sources]
    times = mixing.repeats_at(total, mixing.solve_exponent(total, max_repeat=2.0))
    copies = [0] * len(rows)
    for s, tokens, x in zip(sources, total, times):
        mine = [i for i, r in enumerate(rows) if r[3] == s]
        blocks = max(1, -(-tokens // mixing.BLOCK_TOKENS))
        pairs = spark.createDataFrame([(i, h[i], blocks) for i in mine], "i int, h long, b long").select("i", F.expr("pmod(xxhash64(h, 'block'), b)").alias("block"))
        block = {r.i: r.block for r in pairs.collect()}
        turns = spark.createDataFrame([(b,) for b in set(block.values())], "block long").select("block", F.xxhash64("block", F.lit(s or ""), F.lit(0)).alias("turn"))
        turn = {r.block: r.turn for r in turns.collect()}
        whole = math.floor(x + 1e-9)
        left = max(0, round((x - whole) * tokens))
        if left and left >= tokens:
            whole, left = whole + 1, 0
        for i in mine:
            copies[i] = whole
        order: dict = {}
        for i in mine:
            order.setdefault((turn[block[i]], block[i], h[i]), []).append(i)
        for key in sorted(order) if tokens else ():  # they stand in the part while it fits; the first that does not ends it
            n = sum(size[i] for i in order[key])
            if n > left:
                break
            left -= n
            for i in order[key]:
                copies[i] += 1
    return [r for r, c in zip(rows, copies) for _ in range(c)]


def brute_run(spark, folder):
    from tokenizers import Tokenizer

    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(*COLUMNS).collect()]
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [r for r, p in zip(rows, naive_scores(model, [r[1] for r in rows])) if p < 0.7]
    # near duplicates: groups over different (id, text); the smallest id stays
    texts = sorted({(r[0], r[1] or "") for r in rows if r[0] is not None})
    tag = {r.t: r.h for r in spark.createDataFrame([(t,) for t in {t for _, t in texts}], "t string").select("t", F.xxhash64("t", F.lit(17)).alias("h")).collect()}
    group = {i: c for i, (_, c) in brute_components([(i, t) for i, (_, t) in enumerate(texts)], 5, 80).items()}
    winner: dict = {}
    for i, (d, t) in enumerate(texts):
        winner.setdefault(group[i], []).append((d, tag[t], t))
    stay = {(min(w)[0], min(w)[2]) for w in winner.values()}
    seen, kept = set(), []
    for r in rows:
        key = (r[0], r[1] or "")
        if r[0] is None or (key in stay and key not in seen):
            kept.append(r)
            seen.add(key)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {key for key in {(r[0], r[1] or "") for r in kept} if key[0] is not None and brute_matches([key], items)[0][5]}
    kept = [r for r in kept if (r[0], r[1] or "") not in bad]
    mixed = naive_mixture(spark, kept)
    order = {r.i: r.h for r in spark.createDataFrame([(i, r[1]) for i, r in enumerate(mixed)], "i int, t string").select("i", F.xxhash64("t").alias("h")).collect()}
    mixed = [mixed[i] for i in sorted(range(len(mixed)), key=lambda i: (mixed[i][0] is not None, mixed[i][0] or 0, order[i]))]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for r in mixed:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        out.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_run_matches_brute_force(spark, folder):
    want = brute_run(spark, folder)
    got = sorted((tuple(r) for r in P.run(spark, folder).collect()), key=lambda r: r[1])
    assert got == want
    ids = {r[0] for r in got}
    assert 9001 in ids and 9007 in ids and 9004 in ids and 9005 not in ids and 9008 not in ids and None in ids
    assert len({r[1] for r in got if r[0] == 9009}) == len({r[1] for r in got if r[0] == 9006}), "a repeated row counts once"


def test_stages_keep_all_columns(spark, folder):
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        after = stage(spark, now, folder)
        assert after.columns == now.columns and after.where("score <> -5 or tag <> -5 or toxic_0 <> -5").count() == 0
    assert P.STAGES[-1][1](spark, now, folder).count() == now.count()


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 9000")
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() > 0, "without labels or items nothing is rejected for them"


def test_ids_that_are_missing_pass(spark):
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (2, "d")], "doc_id long, text string")
    gone = P._tagged(docs.where("text in ('b', 'c')")).select("doc_id", "tag")
    assert sorted(r.text for r in P._without(docs, gone).collect()) == ["a", "b", "d"]


def test_settle_gives_the_heap_back(spark):
    """Java's heap stayed at the most that any stage so far had needed."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    held = spark._jvm.java.nio.ByteBuffer.allocate(1 << 29)
    grown = runtime.totalMemory()
    spark.sparkContext._gateway.detach(held)
    settle(spark)
    assert runtime.totalMemory() < grown


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[name for name, _ in P.STAGES])
def test_every_stage_begins_with_settled_executors(spark, folder, monkeypatch, stage):
    """before it reads anything, whatever stages ran before it."""

    class Settled(Exception):
        pass

    def stop(_):
        raise Settled

    monkeypatch.setattr(P, "settle", stop)
    with pytest.raises(Settled):
        stage(spark, None, folder)
