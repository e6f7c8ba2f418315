"""What the reviewer of round 3 found in the operators: each test of a finding failed before it was settled."""

import numpy as np
from pyspark.sql import functions as F

from quantloom.llm import toxicity


def corpus(spark, n):
    """Documents and labels: a toxic text has a bad word, one in 50 behind 45,000 bytes of others."""
    rows = []
    for i in range(n):
        plain = " ".join(f"word{(i * k * k + k) % 97}" for k in range(1, 20))
        body = "filler " * 6500 if i % 50 == 0 else ""
        rows.append((i, f"{plain} {body} {'vile' if i % 5 == 0 else 'mild'}{i % 3}", "en" if i % 2 else "de"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))


def test_f2_all_labelled_rows_and_whole_texts_are_learnt_from(spark):
    docs = spark.range(6600).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") < 9, F.repeat("text", 9000)).otherwise(F.col("text")))
    labels = docs.select("doc_id", (F.col("doc_id") % 9 == 0).cast("int").alias("toxic"))
    wanted = {r.doc_id: len(r.text) for r in docs.where(~toxicity.held_out(F.col("doc_id"))).collect()}
    assert len(wanted) > 4000 and max(wanted.values()) > 40_000
    assert {r.doc_id: len(r.text) for r in toxicity.training_rows(docs, labels)} == wanted


def test_f2_blocks_hold_every_row_and_learn(spark, monkeypatch):
    docs, labels = corpus(spark, 1500)
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 400)
    seen = {}
    real = toxicity.train_blocks
    monkeypatch.setattr(toxicity, "train_blocks", lambda rows, blocks: seen.update(blocks=blocks, rows=rows.count()) or real(rows, blocks))
    model = toxicity.fit(docs, labels)
    fitted = docs.where(~toxicity.held_out(F.col("doc_id"))).count()
    assert seen == {"blocks": -(-fitted // 400), "rows": fitted} and seen["blocks"] > 1
    again = toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert all((model.filters[w] == again.filters[w]).all() for w in toxicity.WIDTHS) and model.scale == again.scale
    assert set(model.thresholds) == {"de", "en"}
    found = toxicity.score(docs.where(toxicity.held_out(F.col("doc_id"))), model).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 5 == 0) for r in found]) > 0.97


def test_f2_a_block_of_empty_texts_and_of_one_kind(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 2)
    docs = spark.createDataFrame([(i, "" if i < 20 else "bad", None) for i in range(24)], "doc_id long, text string, lang string")
    rows = toxicity.detect(docs, docs.select("doc_id", (F.col("doc_id") >= 20).cast("int").alias("toxic"))).collect()
    assert len(rows) == 24 and all(0 <= r.score <= 1 for r in rows)


def test_pieces_and_gradients(monkeypatch):
    texts = ["a b c d e f g h", "", "x", "b b a q r s t u v w", "one two"]
    ids, first = toxicity._encode([t.encode() for t in texts])
    y, rows = np.array([1, 0, 0, 1, 0], np.float32), np.arange(5)
    state = toxicity._begin(3, 4, 2)
    state["E"] *= 5
    whole, at = toxicity._best(state, ids, first, rows)
    model = toxicity.Model({w: np.stack([state["E"][:-1] @ state[f"F{w}"][k] for k in range(w)]) for w in toxicity.WIDTHS}, {w: state[f"b{w}"] for w in toxicity.WIDTHS})
    assert np.allclose(np.maximum(whole, 0), toxicity._maxima(model, ids.astype(int), first), atol=1e-5)
    monkeypatch.setattr(toxicity, "PIECE", 3)
    pieces, places = toxicity._best(state, ids, first, rows)
    assert np.allclose(whole, pieces, atol=1e-5) and (at == places).all() and (at[1] == -1).all()

    def loss(s):
        p = 1 / (1 + np.exp(-toxicity._margins(s, ids, first, rows)[0].astype(float)))
        return -np.mean(np.where(y > 0, 2.0 * np.log(p), np.log(1 - p)))

    after = {k: v.copy() for k, v in state.items()}
    assert toxicity._pass(after, ids, first, y, rows, 2.0, 0, 0.02) == 1
    for name in ("u", "c", "F1", "F2", "F3", "b1", "b3"):
        for i in np.ndindex(state[name].shape):
            up, down = ({k: v.copy() for k, v in state.items()} for _ in range(2))
            up[name][i] += 1e-2
            down[name][i] -= 1e-2
            assert abs((loss(up) - loss(down)) / 2e-2 - after["m_" + name][i] / 0.1) < 5e-3, (name, i)
    moved = np.flatnonzero((after["E"] != state["E"]).any(1))
    assert len(moved) and set(moved) <= set(ids.ravel().tolist()) and not after["E"][-1].any()
