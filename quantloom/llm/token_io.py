"""Token ids as binary blocks: Simple-8b word-aligned coding.

A 64-bit word holds a 4-bit selector and as many ids as fit at one width.  A
block has up to ``BLOCK_IDS`` ids and starts at a word of its own; the offsets
of the blocks stand in the header, so blocks decode apart from one another, and
all words of a block, or of many blocks, decode at once in numpy.  An id too
large for a packed width is escaped: a word with selector 0, then the raw id.

File image: magic ``QS8B``, u32 version, u64 documents, u64 ids, u64 blocks,
then u64 arrays: document lengths in ids, first word of each block and the
number of words; then the words.  All little-endian.

Images are written as rows of a Parquet table through Spark's committer, so a
lost executor leaves no half-written file, and any store that Spark writes to
will do; ``export_files`` gives them as plain files.

Defined results of ``encode_documents``/``read_documents``: ids are those of
the library with add_special_tokens=False and its defaults otherwise, so an
added token in a text gets its own id; a null or empty
text has the end id alone; repeated ids follow each other; a null doc_id sorts
first, and documents of one id stand in the order of their texts' hashes; extra
columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, shared_path, slices, text_buffers, worker_state

MAGIC = b"QS8B"
#: Ids in a word and bits of each, by selector; selector 0 is the escape.
COUNTS = (0, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BLOCK_IDS = 4096
#: Bytes of text in one file image.
IMAGE_BYTES = 2 << 20
#: Pieces of text whose ids a worker keeps.  Fewer, and smaller images, take less memory and more time.
CACHE_PIECES = 300_000


def encode(ids, block: int = BLOCK_IDS):
    """(words, first word of each block) of an array of unsigned ids."""
    import numpy as np

    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // block)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bits = np.full(blocks * block, 0, np.uint8)
    big = ids >= np.uint64(1 << 60)
    fine = np.where(big, 0, ids).astype(np.float64)
    exact = np.frexp(fine)[1].astype(np.uint8)  # bit length; an id just under a power of two may round up to it
    exact -= ((ids < (np.uint64(1) << np.maximum(exact, 1).astype(np.uint64) - np.uint64(1))) & (exact > 0)).astype(np.uint8)
    bits[:n] = np.where(big, 64, exact)
    bits = bits.reshape(blocks, block)
    left = np.full(blocks, block, np.int64)
    left[-1] = n - (blocks - 1) * block
    # bits wanted by the next c ids, from maxima over powers of two
    choice = np.zeros((blocks, block), np.uint8)
    tables, span = {1: bits}, 1
    while span * 2 <= min(block, 64):
        t = tables[span]
        x = t.copy()
        x[:, :-span] = np.maximum(t[:, :-span], t[:, span:])
        tables[span * 2] = x
        span *= 2
    column = np.arange(block)
    for s in range(15, 0, -1):  # the densest that fits wins, so it comes last
        c = COUNTS[s]
        if c > block:
            continue
        p = min(1 << (c.bit_length() - 1), span)
        t = tables[p]
        need = t.copy()
        step = p
        while step < c:
            d = min(step, c - p)
            need[:, : block - d] = np.maximum(need[:, : block - d], t[:, d:])
            step += p
        ok = (need <= WIDTHS[s]) & (column[None, :] + c <= left[:, None])
        choice[ok] = s
    # walk all blocks in step
    at = np.zeros(blocks, np.int64)
    live = np.arange(blocks)
    where, chosen = [], []
    counts = np.array(COUNTS, np.int64)
    counts[0] = 1
    while len(live):
        pos = at[live]
        s = choice[live, pos]
        where.append(live * block + pos)
        chosen.append(s)
        at[live] = pos + counts[s]
        live = live[at[live] < left[live]]
    where, chosen = np.concatenate(where), np.concatenate(chosen)
    order = np.argsort(where, kind="stable")
    where, chosen = where[order], chosen[order]
    size = np.where(chosen == 0, 2, 1)
    place = np.r_[0, np.cumsum(size)]
    out = np.zeros(int(place[-1]), np.uint64)
    for s in range(1, 16):
        mine = np.flatnonzero(chosen == s)
        if not len(mine):
            continue
        word = np.full(len(mine), s << 60, np.uint64)
        for k in range(COUNTS[s] if WIDTHS[s] else 0):
            word |= ids[where[mine] + k] << np.uint64(k * WIDTHS[s])
        out[place[mine]] = word
    mine = np.flatnonzero(chosen == 0)
    out[place[mine] + 1] = ids[where[mine]]
    first = place[np.searchsorted(where, np.arange(blocks) * block)]
    return out, first


def decode(words, first):
    """The ids of ``encode``; whole arrays at a time."""
    import numpy as np

    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(n, bool)
    escapes = np.flatnonzero(selector == 0)
    if len(escapes):  # a raw word may look like an escape itself: go through those in turn
        last = -2
        for e in escapes.tolist():
            if e - 1 != last:
                last = e
                raw[e + 1] = True
    counts = np.array(COUNTS, np.int64)[selector]
    counts[raw] = 1
    counts[(selector == 0) & ~raw] = 0
    place = np.r_[0, np.cumsum(counts)]
    out = np.zeros(int(place[-1]), np.uint64)
    for s in range(1, 16):
        mine = np.flatnonzero((selector == s) & ~raw)
        if not len(mine) or not WIDTHS[s]:
            continue
        mask = np.uint64((1 << WIDTHS[s]) - 1)
        for k in range(COUNTS[s]):
            out[place[mine] + k] = (words[mine] >> np.uint64(k * WIDTHS[s])) & mask
    mine = np.flatnonzero(raw)
    out[place[mine]] = words[mine]
    return out


def pack_image(lengths, ids) -> bytes:
    """File image of documents with ``lengths`` ids each."""
    import struct

    import numpy as np

    words, first = encode(ids)
    head = MAGIC + struct.pack("<IQQQ", 1, len(lengths), len(ids), len(first))
    return head + np.asarray(lengths, "<u8").tobytes() + np.r_[first, len(words)].astype("<u8").tobytes() + words.astype("<u8").tobytes()


def unpack_image(image: bytes):
    """(document lengths, ids) of a file image."""
    import struct

    import numpy as np

    if image[:4] != MAGIC:
        raise ValueError("not a token file")
    version, docs, ids, blocks = struct.unpack_from("<IQQQ", image, 4)
    if version != 1:
        raise ValueError(f"unknown version {version}")
    at = 4 + struct.calcsize("<IQQQ")
    lengths = np.frombuffer(image, "<u8", docs, at).astype(np.int64)
    first = np.frombuffer(image, "<u8", blocks + 1, at + 8 * docs)
    words = np.frombuffer(image, "<u8", int(first[-1]), at + 8 * (docs + blocks + 1))
    out = decode(words, first[:-1])
    if len(out) != ids:
        raise ValueError("the file is damaged: a different number of ids")
    return lengths, out


#: New pieces that are given to the tokenizer as one text.
_JOINED = 1000
#: Bytes cut off after an ASCII letter or digit; there a new run of the tokenizer's pattern begins.
_CLOSING = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_classes():
    """Bytes by class, as bits: 1 white space or its lead byte, 2 surely no white space next, 4 letter or digit, 8 closing."""
    import numpy as np

    c = np.full(256, 2, np.uint8)
    c[: 0x21] = 1
    c[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = 1  # all white space beyond ASCII begins with one of these lead bytes
    c[0x80:0xC0] = 0
    c[[*range(48, 58), *range(65, 91), *range(97, 123)]] |= 4
    c[list(_CLOSING)] |= 8
    return c


def _cuts(data, offsets, classes):
    """Where pieces begin: the texts' starts, single blanks and line ends between other characters, closing marks."""
    import numpy as np

    n = len(data)
    begin = np.zeros(n + 2, bool)
    edge = np.zeros(n + 2, bool)
    edge[offsets] = True
    kind = classes[data]
    begin[1:n] = (kind[1:] & 8 != 0) & (kind[:-1] & 4 != 0)
    inner = np.flatnonzero((data == 32) | (data == 10))
    inner = inner[(inner > 1) & (inner < n - 1)]
    inner = inner[~(edge[inner] | edge[inner + 1])]
    before, ahead = data[inner - 1], data[inner - 2]
    # a character of several bytes before it is no white space unless its last but one byte is one of four
    solid = (kind[inner - 1] & 2 != 0) & (before < 0x80)
    solid |= (before >= 0x80) & (ahead != 0xC2) & (ahead != 0x9A) & (ahead != 0x80) & (ahead != 0x81)
    inner = inner[solid & (kind[inner + 1] & 2 != 0)]
    begin[inner] = True
    begin[inner[data[inner] == 10] + 1] = True
    begin[offsets] = True
    return np.flatnonzero(begin[:n]), kind


def _added_tokens(tokenizer):
    """(pattern of the added tokens' bytes or None, whether each occurrence stands for itself, without the text around it)."""
    import re

    added = tokenizer.get_added_tokens_decoder().values()
    marks = sorted((t.content.encode() for t in added if t.content), key=len, reverse=True)
    alone = tokenizer.normalizer is None and not any(t.lstrip or t.rstrip or t.single_word for t in added)
    return re.compile(b"|".join(map(re.escape, marks))) if marks else None, alone


def _whole_spans(raw: bytes, offsets, pattern, alone: bool):
    """(start, end) of what is never cut: occurrences of added tokens, or the texts that hold one if the text around it counts."""
    if pattern is None or not pattern.search(raw):
        return []
    cut = offsets.tolist()
    if alone:
        return [m.span() for a, b in zip(cut[:-1], cut[1:]) for m in pattern.finditer(raw, a, b)]
    return [(a, b) for a, b in zip(cut[:-1], cut[1:]) if pattern.search(raw, a, b)]


def _parts_at_blanks(tokenizer) -> bool:
    """Whether a tokenizer never joins text over the places where ``_cuts`` cuts: byte-level, by the library's own pattern, text unchanged."""
    import json

    spec = json.loads(tokenizer.to_str())
    before = spec.get("pre_tokenizer") or {}
    model = spec.get("model") or {}
    plain = spec.get("normalizer") is None and spec.get("truncation") is None and spec.get("padding") is None and spec.get("post_processor") is None
    plain = plain and model.get("type") == "BPE" and not model.get("dropout")
    return plain and before.get("type") == "ByteLevel" and before.get("use_regex") is True and before.get("add_prefix_space") is False


def _whole_texts(tokenizer, data, offsets):
    """Ids of a buffer of texts, each encoded as a whole by the library."""
    import numpy as np

    raw, cut = data.tobytes(), offsets.tolist()
    found = [e.ids for e in tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(cut[:-1], cut[1:])], add_special_tokens=False)]
    n = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((x for ids in found for x in ids), np.uint32, int(n.sum())), n


def make_tokenizer(path: str, cache_limit: int = CACHE_PIECES, literal: bool = True):
    """A function from a buffer of texts (bytes, offsets) to their ids (uint32) and the number of ids of each text.

    Texts are cut at places over which a byte-level tokenizer never joins text,
    so the ids of the pieces are those of the whole text; with a tokenizer of
    another kind texts are encoded whole.  Equal pieces are found by
    their hash and compared byte for byte.  Pieces are encoded once, many in a
    call, and kept for as long as the worker process lives: a new and an old
    generation, each of up to half of ``cache_limit``; pieces of the old one
    that come again move to the new one.

    ``literal``: added tokens such as an end mark are encoded like any other
    text.  Otherwise they get their own ids, as the library gives by default;
    each occurrence is a piece of its own and parts the text around it.
    """
    import numpy as np
    import pandas as pd
    import tokenizers

    from .wordhash import run_hashes

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    kept = worker_state().setdefault("tokenizers", {})
    name = path, literal
    if name not in kept:
        fresh = tokenizers.Tokenizer.from_file(path)
        added = None, True
        if literal:
            fresh.encode_special_tokens = True
        else:
            added = _added_tokens(fresh)
        size = fresh.get_vocab_size(with_added_tokens=True)
        blank = np.fromiter(((fresh.id_to_token(i) or "").startswith("\u0120") for i in range(size)), bool, size)
        kept[name] = (fresh, blank, _byte_classes(), [{}, {}], added, _parts_at_blanks(fresh))
    tokenizer, blank, classes, generations, (pattern, alone), parted = kept[name]
    if not parted:
        return lambda data, offsets: _whole_texts(tokenizer, data, offsets)
    line_end = np.array(tokenizer.encode("\n", add_special_tokens=False).ids, np.uint32)

    def one_by_one(pieces, cache):
        texts = [x.decode() for x in pieces]
        for x, e in zip(pieces, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            cache[x] = np.array(e.ids, "<u4").tobytes()

    def together(pieces, cache, spaced):
        """Pieces without white space but a leading blank, which all or none have, many as one text; line ends part the latter."""
        for i in range(0, len(pieces), _JOINED):
            some = pieces[i : i + _JOINED]
            joined = (b"" if spaced else b"\n").join(some)
            if pattern is not None and pattern.search(joined):  # an added token across pieces
                one_by_one(some, cache)
                continue
            text = joined.decode()
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            if spaced:
                first = np.flatnonzero(blank[ids])
                last = np.r_[first[1:], len(ids)]
            else:
                cut = np.flatnonzero(ids == line_end[0])
                first, last = np.r_[0, cut + 1], np.r_[cut, len(ids)]
            if len(first) != len(some) or first[0] != 0 or len(line_end) != 1:
                one_by_one(some, cache)
            else:
                raw = ids.tobytes()
                cache.update(zip(some, [raw[x:y] for x, y in zip((4 * first).tolist(), (4 * last).tolist())]))

    def run(data, offsets):
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        cache, old = generations
        if len(cache) > cache_limit // 2:
            cache, old = generations[:] = {}, cache
        raw = data.tobytes()
        whole = np.array(_whole_spans(raw, offsets, pattern, alone), np.int64).reshape(-1, 2)
        edges = np.unique(np.r_[offsets, whole.ravel()]) if len(whole) else offsets
        starts, kind = _cuts(data, edges, classes)
        if len(whole):  # no piece begins within one
            nth = np.searchsorted(whole[:, 0], starts, side="right") - 1
            starts = starts[(nth < 0) | (starts == whole[nth, 0]) | (starts >= whole[nth, 1])]
        sizes = np.diff(starts, append=len(data))
        code, _ = pd.factorize(run_hashes(data, starts))
        first = np.zeros(int(code.max()) + 1, np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        begin, size = starts[first], sizes[first]
        small = np.int32 if len(data) < 1 << 31 else np.int64
        same = np.array_equal(size[code], sizes)
        if same:
            twin = np.repeat((begin[code] - starts).astype(small), sizes)
            twin += np.arange(len(data), dtype=small)
            same = np.array_equal(data[twin], data)
            del twin
        if not same:  # two pieces share a hash: take every piece as its own
            code, begin, size = np.arange(len(starts)), starts, sizes
        pieces = [raw[a:b] for a, b in zip(begin.tolist(), (begin + size).tolist())]
        white = np.zeros(len(data) + 1, small)
        np.cumsum(kind & 1, out=white[1:])
        lead = data[begin] == 32
        odd = (white[begin + size] - white[begin] > lead) | (lead & (size == 1))
        if len(whole):
            odd |= np.isin(begin, whole[:, 0])
        groups = [], [], []
        for x, g in zip(pieces, np.where(odd, 2, ~lead).tolist()):
            if x not in cache:
                if x in old:
                    cache[x] = old[x]
                else:
                    groups[g].append(x)
        together(groups[0], cache, True)
        together(groups[1], cache, False)
        one_by_one(groups[2], cache)
        found = list(map(cache.__getitem__, pieces))
        known = np.frombuffer(b"".join(found), "<u4")
        n_ids = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at, n = (np.cumsum(n_ids) - n_ids)[code], n_ids[code]
        to = np.r_[0, np.cumsum(n)]
        take = np.repeat(at - to[:-1], n)
        take += np.arange(to[-1])
        return known[take], np.diff(to[np.searchsorted(starts, offsets)])

    return run


def _encode_rows(path: str, end_id: int, image_bytes: int, cache_pieces: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        tokenize = make_tokenizer(path, cache_pieces, literal=False)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            for a, b in slices(offs, image_bytes):
                rows = batch.slice(a, b - a)
                ids, lengths = tokenize(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                flat = np.insert(ids, np.cumsum(lengths), end_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()),
                        pa.array([number], pa.int32()),
                        pa.array([before], pa.int64()),
                        pa.array([len(flat)], pa.int64()),
                        pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                        pa.array([pack_image(lengths + 1, flat)], pa.binary()),
                    ],
                    ["part", "number", "before", "n_ids", "doc_ids", "image"],
                )
                number, before = number + 1, before + len(flat)

    return run


IMAGE_SCHEMA = "part int, number int, before long, n_ids long, doc_ids array<bigint>, image binary"


def encode_documents(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 0, image_bytes: int = IMAGE_BYTES, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """Write the ids of every text, in ascending doc_id order, as file images to the folder ``out``; returns the images."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # the text's hash as a second key: an id that repeats very often is dealt to several tasks
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    ordered.mapInArrow(frugal(_encode_rows(tokenizer_path, end_id, image_bytes, cache_pieces)), IMAGE_SCHEMA).write.option("compression", "none").parquet(out)
    return spark.read.schema(IMAGE_SCHEMA).parquet(out)


def _decode_rows(batches):
    import zlib

    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for ids, start, image in zip(batch.column("doc_ids").to_pylist(), batch.column("start").to_pylist(), batch.column("image")):
            lengths, flat = unpack_image(image.as_py())
            raw = memoryview(flat.astype("<u4").tobytes())
            cut = np.r_[0, np.cumsum(lengths)]
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(start + cut[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(images: DataFrame) -> DataFrame:
    """Decode file images: doc_id, start (ids before the document), n_tokens, ids_crc32."""
    spark = images.sparkSession
    totals = images.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one number for each task of the writer
    bases, total = [], 0
    for r in totals:
        bases.append((r["part"], total))
        total += r["n"]
    # an image knows how many ids its own task wrote before it, so only a long for each task is broadcast, and no image is shuffled
    base = spark.createDataFrame(bases, "part int, base long")
    joined = images.join(F.broadcast(base), "part")
    return joined.select("doc_ids", (F.col("base") + F.col("before")).alias("start"), "image").mapInArrow(frugal(_decode_rows), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 0, image_bytes: int = IMAGE_BYTES, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """Encode to the shared folder and read back."""
    spark: SparkSession = docs.sparkSession
    return read_documents(encode_documents(docs, tokenizer_path, shared_path(spark, "tokens"), end_id, image_bytes, cache_pieces))


def export_files(images: DataFrame, folder: str) -> list[str]:
    """Write the images as plain files ``part-number.s8b`` in order; one image at a time passes the driver."""
    os.makedirs(folder, exist_ok=True)
    names = []
    for r in images.orderBy("part", "number").toLocalIterator():
        names.append(os.path.join(folder, f"{r['part']:06d}-{r['number']:06d}.s8b"))
        with open(names[-1], "wb") as f:
            f.write(bytes(r["image"]))
    return names
