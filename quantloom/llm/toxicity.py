"""Toxicity by a convolutional text classifier in numpy.

Words, and their first four and six bytes, are hashed to rows of an embedding
table and added up, so that an unseen form of a known stem lies near it; filters
of widths 1, 2 and 3 slide over a text, each keeps its maximum over all positions, and a logistic
unit weighs the maxima.  Training uses every whole text that has a label and is
not held out: rows are dealt to blocks, every epoch is a pass of gradient steps
over each block on the executors, and the blocks' changes are averaged (one
block is trained on the driver).  Scoring runs over every whole text on the
executors.  As a filter is linear, its product with the table is taken once, so
scoring a position is a few look-ups and sums.

Platt scaling on labelled rows kept out of the gradient steps turns margins into
probabilities; ``thresholds`` holds, for each language, the cut at which the
calibration rows' F1 is best.  A language is never an input of a score.

Defined results: a null or empty text scores as a text without words; words
are runs of characters other than 0x20, 0x09-0x0D and ASCII punctuation, A-Z
lower-cased; repeated rows get the same score;
labels that are null, or missing, are not used, nor those of null texts, and
of an id with several texts the smallest is; extra columns are kept, but one that has the name of the
result is replaced by it; no rows give no rows; without labels of both kinds every score is the prior.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, give_back, materialize, other_columns, slices, text_buffers

#: Labelled rows, and bytes of their texts, of about one block of training; all rows are in some block.
BLOCK_ROWS = 4000
BLOCK_BYTES = 32 << 20
#: Labels up to which they are broadcast (16 bytes each) to be joined to the texts; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Words that training multiplies with the filters at once; longer texts go by in pieces.
PIECE = 1 << 13
#: Parts of the table that changes are averaged in.
PARTS = 16
HASH_BITS = 15
WIDTHS = (1, 2, 3)


@dataclass
class Model:
    """Tables of a trained classifier; all arrays."""

    filters: dict = field(default_factory=dict)  # width -> (width, 2**HASH_BITS, filters) products of table and filter
    bias: dict = field(default_factory=dict)  # width -> (filters,)
    out: object = None  # weights of the maxima
    out_bias: float = 0.0
    scale: tuple = (1.0, 0.0)
    thresholds: dict = field(default_factory=dict)


#: First bytes of a word that have a row of the table of their own.
PREFIXES = (4, 6)


def token_ids(data, offsets):
    """((words, 3) table rows of each word and its prefixes, first word of each text and the end)."""
    import numpy as np

    from .wordhash import mix, words

    # punctuation counts as white space, as in "word," or "(word"
    edge = np.zeros(256, bool)
    edge[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
    data = np.where(edge[data], np.uint8(32), data) if len(data) else data
    h, first, *short = words(data, offsets, PREFIXES)
    rows = [mix(x + np.uint64(i)) for i, x in enumerate((h, *short))]
    return np.stack([(x >> np.uint64(64 - HASH_BITS)).astype(np.int64) for x in rows], 1), first


def _maxima(model: Model, ids, first):
    """(texts, filters) maxima after the rectifier; a text without words has zeros."""
    import numpy as np

    docs = len(first) - 1
    counts = np.diff(first)
    some = np.flatnonzero(counts > 0)
    out = []
    for w in WIDTHS:
        table, bias = model.filters[w], model.bias[w]
        best = np.zeros((docs, len(bias)), np.float32)
        if len(ids):
            place = [sum(table[k][ids[:, c]] for c in range(ids.shape[1])) for k in range(w)]
            acc = place[0]
            for k in range(1, w):
                # what stands beyond the end of a text counts as nothing
                inside = np.ones(len(ids), bool)
                for j in range(k):
                    ends = first[1:][counts > j] - 1 - j
                    inside[ends] = False
                at = np.flatnonzero(inside)
                acc[at] += place[k][at + k]
            best[some] = np.maximum(np.maximum.reduceat(acc, first[some], axis=0) + bias, 0)
        out.append(best)
    return np.concatenate(out, axis=1)


def score_texts(model: Model, data, offsets):
    """Probabilities of the texts in one buffer."""
    import numpy as np

    ids, first = token_ids(data, offsets)
    margin = _maxima(model, ids, first) @ model.out + model.out_bias
    a, b = model.scale
    return 1 / (1 + np.exp(-np.clip(a * margin.astype(np.float64) + b, -40, 40)))


def _split(count: int, seed):
    """(rows kept for calibration, a fifth; rows to fit on), both in an order drawn by the seed."""
    import numpy as np

    rows = np.random.default_rng(seed).permutation(count)
    return rows[: max(2, count // 5)], rows[max(2, count // 5) :]


def _begin(seed: int, dim: int, filters: int) -> dict:
    """Parameters and, as m_ and v_, their moments; the table's last row is that of no word, and stays zero."""
    import numpy as np

    rng = np.random.default_rng(seed)
    size = 1 << HASH_BITS
    state = {"E": rng.normal(0, 0.1, (size + 1, dim)).astype(np.float32), "u": rng.normal(0, 0.3, filters * len(WIDTHS)).astype(np.float32), "c": np.zeros(1, np.float32)}
    state["E"][size] = 0
    for w in WIDTHS:
        state[f"F{w}"] = rng.normal(0, (2 / (dim * w)) ** 0.5, (w, dim, filters)).astype(np.float32)
        state[f"b{w}"] = np.zeros(filters, np.float32)
    for k in list(state):
        state["v_" + k] = np.zeros_like(state[k])
        if k != "E":
            state["m_" + k] = np.zeros_like(state[k])
    return state


def _best(state: dict, ids, first, rows):
    """Of every filter, without its bias, the greatest sum in each of ``rows`` and its word (-1 without words); long texts go by in pieces."""
    import numpy as np

    widest = max(WIDTHS)
    filters = len(state["b1"])
    weights = np.concatenate([state[f"F{w}"][k].T for k in range(widest) for w in WIDTHS if w > k])
    none = np.full((widest - 1, ids.shape[1]), 1 << HASH_BITS, ids.dtype)
    top = np.full((len(rows), filters * len(WIDTHS)), -np.inf, np.float32)
    at = np.full(top.shape, -1, np.int64)
    every = np.arange(top.shape[1])
    group, held = [], 0

    def flush():
        parts = []
        for _, a, b, end in group:
            parts += [ids[a : min(end, b + widest - 1)], none[: max(0, b + widest - 1 - end)]]
        x = np.concatenate(parts)
        emb = state["E"][x[:, 0]]
        for c in range(1, x.shape[1]):
            emb += state["E"][x[:, c]]
        out = weights @ emb.T
        acc, row = out[: len(every)], len(every)
        for k in range(1, widest):
            n = filters * sum(w > k for w in WIDTHS)  # the last widths; WIDTHS ascend
            acc[-n:, :-k] += out[row : row + n, k:]
            row += n
        s = 0
        for i, a, b, _ in group:
            part = acc[:, s : s + b - a]
            where = part.argmax(1)
            value = part[every, where]
            better = value > top[i]
            top[i][better] = value[better]
            at[i][better] = a + where[better]
            s += b - a + widest - 1

    for i, d in enumerate(rows.tolist()):
        start, end = int(first[d]), int(first[d + 1])
        for a in range(start, end, PIECE):
            b = min(a + PIECE, end)
            if group and held + b - a > PIECE:
                flush()
                group, held = [], 0
            group.append((i, a, b, end))
            held += b - a
    if group:
        flush()
    return top, at


def _margins(state: dict, ids, first, rows):
    """Margins of some rows, and what they are made of: the maxima and their words."""
    import numpy as np

    top, at = _best(state, ids, first, rows)
    z = np.maximum(top + np.concatenate([state[f"b{w}"] for w in WIDTHS]), 0)
    return z @ state["u"] + state["c"][0], z, at


def _pass(state: dict, ids, first, y, rows, balance: float, step: int, rate: float) -> int:
    """One pass of gradient steps, some 32 of ``rows`` each; changes ``state`` and returns the number of the last step."""
    import numpy as np

    filters = len(state["b1"])
    for chunk in np.array_split(rows, max(1, len(rows) // 32)):
        if not len(chunk):
            continue
        step += 1
        margin, z, at = _margins(state, ids, first, chunk)
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        g = ((p - y[chunk]) * np.where(y[chunk] > 0, balance, 1.0) / len(chunk)).astype(np.float32)
        up = np.where(z > 0, g[:, None] * state["u"], 0).astype(np.float32)
        grad = {"u": z.T @ g, "c": g.sum(keepdims=True)}
        touched, pushed = [], []
        for i, w in enumerate(WIDTHS):
            mine = slice(i * filters, (i + 1) * filters)
            grad[f"b{w}"] = up[:, mine].sum(0)
            grad[f"F{w}"] = np.zeros_like(state[f"F{w}"])
            d, f = np.nonzero(up[:, mine])
            back, place, end = up[:, mine][d, f], at[:, mine][d, f], first[chunk[d] + 1]
            for k in range(w):
                ok = place + k < end  # what stands beyond the end of a text counts as nothing
                x, fk, bk = ids[place[ok] + k], f[ok], back[ok]
                share = np.zeros((len(fk), filters), np.float32)
                share[np.arange(len(fk)), fk] = bk
                grad[f"F{w}"][k] = state["E"][x].sum(1).T @ share
                touched.append(x.ravel())
                pushed.append(np.repeat(bk[:, None] * state[f"F{w}"][k].T[fk], x.shape[1], axis=0))
        for k, v in grad.items():
            m, s = "m_" + k, "v_" + k
            state[m] = 0.9 * state[m] + 0.1 * v
            state[s] = 0.999 * state[s] + 0.001 * v * v
            state[k] = (state[k] - rate * (state[m] / (1 - 0.9**step)) / (np.sqrt(state[s] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        words = np.concatenate(touched)
        if len(words):
            order = np.argsort(words, kind="stable")
            begin = np.flatnonzero(np.diff(words[order].astype(np.int64), prepend=-1))
            rows_e = words[order][begin]
            total = np.add.reduceat(np.concatenate(pushed)[order], begin, axis=0)
            state["v_E"][rows_e] += total * total  # Adagrad: rows are rare
            state["E"][rows_e] -= 0.1 * total / (np.sqrt(state["v_E"][rows_e]) + 1e-8)
    return step


def _balance(pos: float, count: float) -> float:
    """What a toxic row weighs against a clean one."""
    return float((count - pos) / max(1.0, pos))


def _encode(raw: list):
    """(uint16 table rows of the words of texts in UTF-8, first word of each and the end)."""
    import numpy as np

    sizes = np.r_[0, np.cumsum([len(x) for x in raw], dtype=np.int64)]
    ids, counts = [np.zeros((0, 1 + len(PREFIXES)), np.uint16)], [np.zeros(1, np.int64)]
    for a, b in slices(sizes, 1 << 18):  # a part at a time, so that tables by length stay small
        found, first = token_ids(np.frombuffer(b"".join(raw[a:b]), np.uint8), sizes[a : b + 1] - sizes[a])
        ids.append(found.astype(np.uint16))  # HASH_BITS fit
        counts.append(np.diff(first))
    return np.concatenate(ids), np.cumsum(np.concatenate(counts))


def _prior(pos: int, count: int) -> Model:
    """Of labels of one kind, or none: the same score for every text."""
    import numpy as np

    prior = (pos + 1) / (count + 2) if count else 0.5
    flat = {w: np.zeros((w, 1 << HASH_BITS, 1), np.float32) for w in WIDTHS}
    return Model(flat, {w: np.zeros(1, np.float32) for w in WIDTHS}, np.zeros(len(WIDTHS), np.float32), 0.0, (1.0, float(np.log(prior / (1 - prior)))))


def _finish(state: dict, margin, y, langs: list) -> Model:
    """The model of trained parameters, calibrated by the margins of rows that no step has used."""
    import numpy as np

    table = state["E"][:-1]
    model = Model({w: np.stack([table @ state[f"F{w}"][k] for k in range(w)]) for w in WIDTHS}, {w: state[f"b{w}"] for w in WIDTHS}, state["u"], float(state["c"][0]))
    model.scale = _platt(margin.astype(np.float64), y)
    a, b = model.scale
    p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
    names = np.array([x or "" for x in langs])
    for lang in sorted(set(names.tolist())):
        mine = names == lang
        model.thresholds[lang] = best_threshold(p[mine], y[mine])
    return model


def train(texts: list[str], labels: list[int], langs: list[str], seed: int = 7, dim: int = 12, filters: int = 6, epochs: int = 14, rate: float = 0.02) -> Model:
    """Fit on four fifths of the rows with Adam, calibrate on the rest, in this process."""
    import numpy as np

    y = np.array(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        return _prior(int(y.sum()), len(y))
    ids, first = _encode([t.encode() for t in texts])
    held, fitted = _split(len(y), seed)
    state, step = _begin(seed, dim, filters), 0
    balance = _balance(float(y[fitted].sum()), len(fitted))
    for epoch in range(epochs):
        step = _pass(state, ids, first, y, np.random.default_rng([seed, epoch]).permutation(fitted), balance, step, rate)
    return _finish(state, _margins(state, ids, first, held)[0], y[held], [langs[i] for i in held])


# --- training over blocks of rows ---

_BLOCKS = "block int, pos long, fitted long, words binary, ids binary, toxic binary, langs binary"
_CHANGES = "part int, block int, rows binary, change binary"


def _pack(seed: int):
    """Of the labelled rows of a block, by id: words of their texts, labels, languages, and how many of them are fitted."""

    def run(table):
        import json

        import numpy as np
        import pyarrow as pa

        table = table.sort_by("doc_id")
        block = table.column("block")[0].as_py()
        data, offs = text_buffers(table.column("text"))
        ids, first = _encode([data[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:])])
        y = np.array([int(x > 0) for x in table.column("toxic").to_pylist()], np.int8)
        fitted = _split(len(y), [seed, block])[1]
        out = (block, int(y[fitted].sum()), len(fitted), first.astype(np.int64).tobytes(), ids.tobytes(), y.tobytes(), json.dumps(table.column("lang").to_pylist()).encode())
        kinds = (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
        give_back()
        return pa.table({c.split(" ")[0]: pa.array([v], k) for c, v, k in zip(_BLOCKS.split(", "), out, kinds)})

    return run


def _unpacked(batches):
    """(block, ids, first, labels, languages as JSON) of packed blocks."""
    import numpy as np

    for batch in batches:
        for i in range(batch.num_rows):
            block, first, ids, y, langs = (batch.column(c)[i] for c in ("block", "words", "ids", "toxic", "langs"))
            ids = np.frombuffer(ids.as_buffer(), np.uint16).reshape(-1, 1 + len(PREFIXES))
            yield block.as_py(), ids, np.frombuffer(first.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int8).astype(np.float32), langs.as_py()


def _dense(state: dict) -> list:
    """Names of what is averaged as a whole, not row by row."""
    return sorted(k for k in state if k not in ("E", "v_E"))


def _changes(shared, epoch: int, step: int, balance: float, seed: int, rate: float):
    """What one pass over each block changes, beginning at the shared parameters: rows of the table in parts, and all else as part -1."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        start = shared.value
        for block, ids, first, y, _ in _unpacked(batches):
            state = {k: v.copy() for k, v in start.items()}
            fitted = _split(len(y), [seed, block])[1]
            _pass(state, ids, first, y, np.random.default_rng([seed, block, epoch]).permutation(fitted), balance, step, rate)
            change = np.concatenate([state["E"] - start["E"], state["v_E"] - start["v_E"]], 1)
            rows = np.flatnonzero((change != 0).any(1))
            out = [(-1, block, b"", np.concatenate([(state[k] - start[k]).ravel() for k in _dense(start)]).astype(np.float32).tobytes())]
            for part in range(PARTS):
                mine = rows[rows % PARTS == part]
                if len(mine):
                    out.append((part, block, mine.astype(np.int32).tobytes(), change[mine].tobytes()))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], [c.split(" ")[0] for c in _CHANGES.split(", ")])

    return run


def _average(table):
    """Mean changes of a part of the table, each row's over the blocks that changed it, or of all else; summed in the order of blocks."""
    import numpy as np
    import pyarrow as pa

    table = table.sort_by("block")
    part = table.column("part")[0].as_py()
    many = 1 if part < 0 else (1 << HASH_BITS) + 1
    total, count = None, np.zeros(many, np.int64)
    for rows, change in zip(table.column("rows"), table.column("change")):
        at = np.zeros(1, np.int64) if part < 0 else np.frombuffer(rows.as_buffer(), np.int32)
        found = np.frombuffer(change.as_buffer(), np.float32).reshape(len(at), -1)
        total = np.zeros((many, found.shape[1])) if total is None else total
        total[at] += found
        count[at] += 1
    at = np.flatnonzero(count)
    mean = (total[at] / count[at, None]).astype(np.float32)
    out = (part, 0, at.astype(np.int32).tobytes(), mean.tobytes())
    return pa.table({c.split(" ")[0]: pa.array([v], k) for c, v, k in zip(_CHANGES.split(", "), out, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))})


def _held(shared, seed: int):
    """Margins, labels and languages of the rows of each block that no step uses."""

    def run(batches):
        import json

        import numpy as np
        import pyarrow as pa

        for block, ids, first, y, langs in _unpacked(batches):
            held = _split(len(y), [seed, block])[0]
            names = json.loads(langs)
            margin = _margins(shared.value, ids, first, held)[0].astype(np.float32)
            out = (block, margin.tobytes(), y[held].astype(np.int8).tobytes(), json.dumps([names[i] for i in held]).encode())
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, (pa.int32(), *[pa.binary()] * 3))], ["block", "margin", "toxic", "langs"])

    return run


def train_blocks(rows: DataFrame, blocks: int, seed: int = 7, dim: int = 12, filters: int = 6, epochs: int = 14, rate: float = 0.02) -> Model:
    """``train`` over any number of rows (doc_id, text, lang, toxic, with labels of both kinds), dealt to blocks by a hash of their id.

    In every epoch each block makes a pass of gradient steps over all its rows,
    beginning at the same parameters; then the changes are averaged.  The result
    depends on the rows and the number of blocks, not on how they lie in files.
    """
    import json

    import numpy as np

    spark = rows.sparkSession
    dealt = rows.withColumn("block", F.expr(f"cast(pmod(xxhash64(doc_id, 'train'), {int(blocks)}) as int)"))
    # a file for each block, so that as many tasks as there are blocks can read them
    packed = materialize(dealt.groupBy("block").applyInArrow(_pack(seed), _BLOCKS), "blocks", per_file=1)
    sums = packed.agg(F.sum("pos"), F.sum("fitted"), F.max("fitted")).first()
    balance = _balance(float(sums[0]), float(sums[1]))
    state, step = _begin(seed, dim, filters), 0
    for epoch in range(epochs):
        shared = spark.sparkContext.broadcast(state)
        changes = packed.select("block", "words", "ids", "toxic", "langs").mapInArrow(frugal(_changes(shared, epoch, step, balance, seed, rate)), _CHANGES)
        state = {k: v.copy() for k, v in state.items()}
        for r in changes.groupBy("part").applyInArrow(_average, _CHANGES).collect():
            at, mean = np.frombuffer(r["rows"], np.int32), np.frombuffer(r["change"], np.float32)
            if r["part"] < 0:
                for k in _dense(state):
                    state[k] += mean[: state[k].size].reshape(state[k].shape)
                    mean = mean[state[k].size :]
            else:
                mean = mean.reshape(len(at), 2 * dim)
                state["E"][at] += mean[:, :dim]
                state["v_E"][at] += mean[:, dim:]
        shared.destroy()
        step += max(1, sums[2] // 32)
        del changes
        spark._jvm.java.lang.System.gc()  # what the driver's Java has forgotten, Spark's cleaner may delete: the epoch's shuffle files
    shared = spark.sparkContext.broadcast(state)
    found = packed.select("block", "words", "ids", "toxic", "langs").mapInArrow(frugal(_held(shared, seed)), "block int, margin binary, toxic binary, langs binary").collect()
    shared.destroy()
    discard(packed)
    found.sort(key=lambda r: r["block"])
    margin, y = (np.concatenate([np.frombuffer(r[c], t) for r in found]).astype(np.float64) for c, t in (("margin", np.float32), ("toxic", np.int8)))
    return _finish(state, margin, y, [x for r in found for x in json.loads(bytes(r["langs"]))])


def _platt(margin, y):
    """Slope and offset of a logistic fit by Newton's method, on softened targets."""
    import numpy as np

    pos, neg = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * (theta - np.array([1.0, 0.0])))
        theta = theta - np.clip(move, -2, 2)
    return float(max(theta[0], 1e-3)), float(theta[1])


def best_threshold(p, y, default: float = 0.7) -> float:
    """The cut with the best F1, half way between two scores; ``default`` without both kinds of rows."""
    import numpy as np

    if len(y) == 0 or y.min() == y.max():
        return default
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(f1.argmax())
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + below) / 2)


def held_out(doc_id):
    """True where crc32 of the id as text, mod 3, is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang, toxic) of every labelled id outside the held-out third that has a text, whole."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    texts = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull()).join(marks, "doc_id")
    return texts.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("x"), F.max("toxic").alias("toxic")).select("doc_id", "x.text", "x.lang", "toxic")


def training_rows(docs: DataFrame, labels: DataFrame) -> list:
    """All ``labelled`` rows by id, for tables that the driver can hold."""
    return labelled(docs, labels).orderBy("doc_id").collect()


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on every labelled row: in this process if they make one block, else on the executors."""
    rows = materialize(labelled(docs, labels), "labelled")
    size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0))).first()
    blocks = max(-(-size[0] // BLOCK_ROWS), -(-size[1] // BLOCK_BYTES))
    if size[2] in (0, size[0]):
        model = _prior(size[2], size[0])
    elif blocks == 1:
        found = rows.orderBy("doc_id").collect()
        model = train([r["text"] for r in found], [int(r["toxic"] > 0) for r in found], [r["lang"] for r in found])
        del found
    else:
        model = train_blocks(rows, blocks)
    discard(rows)
    give_back()
    return model


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Add the score (double) to every row."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast((model.filters, model.bias, model.out, model.out_bias, model.scale))
    docs = docs.select(*[F.col(f"`{c}`") for c in other_columns(docs, [name])])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        m = Model(*shared.value)
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            for a, b in slices(offs, 1 << 20):
                p = score_texts(m, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(p, pa.float64())], [*rows.schema.names, name])

    return docs.mapInArrow(frugal(run), schema)


def detect(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= ``threshold``) and flagged (score >= the language's own threshold)."""
    model = fit(docs, labels)
    cuts = F.create_map(*[F.lit(x) for kv in (model.thresholds or {"": threshold}).items() for x in kv])
    scored = score(docs.select("doc_id", "lang", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        (F.col("score") >= F.coalesce(F.element_at(cuts, F.coalesce("lang", F.lit(""))), F.lit(threshold))).alias("flagged"),
    )
