"""N-gram Jaccard join: blocked sparse products of the document by n-gram incidence matrix.

Steps, each linear in the shingles it keeps:

1. ``_signatures``: per document the set's size and a 128-bit set hash.  Equal
   sets form one class.
2. ``_postings``: sets of sizes a and b that link differ in at most
   k = (100-p)/(100+p)*(a+b) shingles.  The n-grams are dealt by hash into
   g > k column groups, a third more than k; then at least g - k groups have the same
   shingles in both sets.  A set posts one key for each of its groups: the
   hash of the shingles there.  The postings are cut into blocks by key.
3. ``_families``: agreeing keys are counted, and pairs below the bound that
   their sizes give are left out.  Keys with ``SHORT`` sets or fewer count
   towards all their pairs.  Of the keys with more sets only their number is
   taken off a set's bound.  A set whose bound that leaves at nothing is
   tied to its long keys themselves; two such sets that link meet there, and
   all other links have pairs that pass the bound.  So a key that very many
   sets share gives one row for each set, not all pairs.  Connected components
   of pairs and ties are families: no link crosses families.
4. ``_links``: each family is one row block of the incidence matrix.  The
   product of the block with its transpose accumulates overlap counts; pairs
   outside the size bounds are left out, the others are tested exactly
   (100*inter >= p*union).  A family over ``BLOCK_SHINGLES`` is split into
   chunks and every pair of chunks is a block of its own, so the memory of a
   task is bounded.  Only (member, root) rows are returned.
5. Components of the links, mapped back from classes to documents.

Defined results: a null or empty text, or one of white space only, has size 0
and is linked with nothing; a row with a null doc_id gets the component of the
documents that have the same set, else null; repeated rows are kept, each with
the same result; of an id with several texts each row follows its own text; extra columns are ignored; no rows give no
rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, frugal, materialize, slices, text_buffers
from .graph import connected_components
from .wordhash import mix, shingle_sets

#: Keys that a block of columns holds about.
BLOCK_KEYS = 1 << 19
#: Keys that one shuffled row holds at most.
ROW_KEYS = 1 << 15
#: Shingles of one row block of the product.
BLOCK_SHINGLES = 1 << 20
#: Bytes up to which the list of classes that need an exact test is broadcast, with the names of the blocks that each goes to.
BROADCAST_BYTES = 16 << 20
#: A set that more than this part of all rows have is hot: there are at most as many hot sets as its inverse.
HOT = 1 / 1000


#: Sets up to which a key counts towards every pair of them.
SHORT = 16


def size_classes(percent: int, most: int = 1 << 42):
    """Size classes: sets that link lie in the same class or in neighbouring ones.

    Returns arrays (largest size of each class, differences k, column groups
    g): of two linked sets, the larger one in class i, at most k[i] shingles
    are in one only, so at least g[i] - k[i] groups agree.
    """
    import numpy as np

    rows, low = [], 1
    while low <= most:
        top = low * 100 // percent
        differ = (100 - percent) * 2 * top // (100 + percent)
        rows.append((top, differ, differ + 1 + max(1, differ // 3)))
        low = top + 1
    return tuple(np.array(x, np.int64) for x in zip(*rows))


def _set_hashes(sets):
    """(n, s1, s2) of each set as int64 arrays: sums of its hashes, mixed in two ways."""
    import numpy as np

    n = np.array([len(s) for s in sets], np.int64)
    if not n.sum():
        return n, np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    flat = np.concatenate(sets)
    with np.errstate(over="ignore"):
        x = (flat ^ (flat >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        cut = np.r_[0, np.cumsum(n)]
        sums = [np.r_[np.uint64(0), np.cumsum(v, dtype=np.uint64)] for v in (flat, x)]
        one, two = (v[cut[1:]] - v[cut[:-1]] for v in sums)
        one = one + n.astype(np.uint64)
    return n, one.astype(np.int64), two.astype(np.int64)


def _signatures(width: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            ids, tags = batch.column("doc_id"), batch.column("tag")
            for a, b in slices(offs):
                n, s1, s2 = _set_hashes(shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], width))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), tags.slice(a, b - a), pa.array(n), pa.array(s1), pa.array(s2)], ["doc_id", "tag", "n", "s1", "s2"])

    return run


def group_keys(sets, percent: int, classes=None):
    """Keys of many sets: (key hashes, index of the set of each key, bound of each set).

    A set in class i posts under the groupings of classes i and i + 1, one for
    links to sets no larger in class, one for larger ones.  The bound is how
    many keys it shares at least with any set that it links to.
    """
    import numpy as np

    tops, k, g = size_classes(percent) if classes is None else classes
    n = np.array([len(s) for s in sets], np.int64)
    bound = np.full(len(sets), 1 << 30, np.int64)
    keep = np.flatnonzero(n)
    if not len(keep):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), bound
    flat = np.concatenate([sets[i] for i in keep])
    owner = np.repeat(keep, n[keep])
    own_class = np.searchsorted(tops, n)
    keys, owners = [], []

    def post(sums, columns, sets_of, classes_of):
        tag = mix(columns + (classes_of.astype(np.uint64) << np.uint64(40)) + np.uint64(1))
        keys.append(mix(sums ^ tag))
        owners.append(sets_of)

    with np.errstate(over="ignore"):
        for up in (0, 1):
            grouping = own_class + up
            groups, agree = g[grouping], (g - k)[grouping]
            column = ((flat >> np.uint64(32)) * groups[owner].astype(np.uint64)) >> np.uint64(32)
            new = np.ones(len(flat), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (column[1:] != column[:-1])
            at = np.flatnonzero(new)
            o, c = owner[at], column[at]
            # two sets without room for a difference are equal, and equal sets are one class already
            use = (n > 0) & (k[grouping] > 0)
            left = agree - (groups - np.bincount(o, minlength=len(n)))
            # a set with so many empty groups that only those need agree posts them too; its partner
            # does so only if bare itself, and else shares with it at least the one key that the partner needs
            bare = use & (left < 1)
            bound = np.where(use, np.minimum(bound, np.where(bare, 1, left)), bound)
            fine = use[o]
            post(np.add.reduceat(flat, at)[fine], c[fine], o[fine], grouping[o[fine]])
            for i in np.flatnonzero(bare).tolist():
                empty = np.setdiff1d(np.arange(groups[i]), c[o == i].astype(np.int64)).astype(np.uint64)
                post(np.zeros(len(empty), np.uint64), empty, np.full(len(empty), i, np.int64), np.full(len(empty), grouping[i]))
    return np.concatenate(keys), np.concatenate(owners), bound


def _runs(key):
    """(first of each run of equal keys, length of each run) of a sorted array."""
    import numpy as np

    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return at, np.diff(np.r_[at, len(key)])


def _postings(width: int, percent: int, blocks: int):
    """Map side: postings of the task's sets by block, packed.

    Rows (block, kind, x, y, z).  kind 0: 40 bits of each key in x, the place of
    its set in y, and the names of the sets in z; place -1 marks a key as long.
    kind 1: sets (x) of a key that is long in this task already, and the keys
    (y).  kind 2: bounds (y) of sets (x).
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        classes = size_classes(percent)
        seen: set = set()
        held, many, number = [], 0, 0

        def flush():
            key, node = (np.concatenate([x[i] for x in held]) for i in range(2))
            names, first = np.unique(np.concatenate([x[2] for x in held]), return_index=True)
            bounds = np.concatenate([x[3] for x in held])[first]
            rows = [(number % blocks, 2, names[i : i + ROW_KEYS].tobytes(), bounds[i : i + ROW_KEYS].tobytes(), b"") for i in range(0, len(names), ROW_KEYS)]
            order = np.argsort(key, kind="stable")
            key, node = key[order], node[order]
            at, length = _runs(key)
            long = np.repeat(length > SHORT, length)
            if long.any():
                held_by, named = node[long], _short_key(key[long], blocks)
                rows += [(number % blocks, 1, held_by[i : i + ROW_KEYS].tobytes(), named[i : i + ROW_KEYS].tobytes(), b"") for i in range(0, len(named), ROW_KEYS)]
                marks = key[at[length > SHORT]]
                key, node, mark = np.r_[key[~long], marks], np.r_[node[~long], np.zeros(len(marks), np.int64)], np.r_[np.zeros(int((~long).sum()), bool), np.ones(len(marks), bool)]
            else:
                mark = np.zeros(len(key), bool)
            block = (key % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            key, node, block, mark = key[order], node[order], block[order], mark[order]
            at, length = _runs(block)
            for i, j in zip(at.tolist(), (at + length).tolist()):
                own, place = np.unique(node[i:j], return_inverse=True)
                small = key[i:j].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:]
                place = np.where(mark[i:j], -1, place).astype(np.int16 if len(own) < 32768 else np.int32)
                rows.append((int(block[i]), 0, small.tobytes(), place.tobytes(), own.tobytes()))
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(5)], ["block", "kind", "x", "y", "z"])

        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            for a, b in slices(offs):
                sets = shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], width)
                _, s1, _ = _set_hashes(sets)
                if len(seen) > 1 << 20:  # it saves work only: a set that comes again is found on the other side
                    seen.clear()
                for i, x in enumerate(s1.tolist()):
                    if x in seen:
                        sets[i] = sets[i][:0]
                    seen.add(x)
                key, owner, bound = group_keys(sets, percent, classes)
                posting = np.unique(owner)
                held.append((key, s1[owner], s1[posting], bound[posting]))
                many += len(key)
                if many >= BLOCK_KEYS:
                    yield flush()
                    held, many, number = [], 0, number + 1
        if many:
            yield flush()

    return run


def _short_key(key, blocks: int):
    """A name of a key that can be had from its block and its last 40 bits."""
    import numpy as np

    with np.errstate(over="ignore"):
        return mix((key >> np.uint64(24)) + (key % np.uint64(blocks)) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)


def _count_pairs(blocks: int):
    """Reduce side of the blocks.  Rows (kind, a, b, n): pairs with the keys that they share, long keys of sets, bounds."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(kind, a, b, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(n)], ["kind", "a", "b", "n"])

        parts: dict = {}
        for batch in batches:
            for block, kind, x, y, z in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "x", "y", "z"))):
                if kind:
                    x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                    yield out(1, x, y, np.ones(len(x), np.int64)) if kind == 1 else out(2, x, x, y)
                    continue
                small = np.zeros((len(x) // 5, 8), np.uint8)
                small[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
                names = np.frombuffer(z, np.int64)
                place = np.frombuffer(y, np.int16 if len(names) < 32768 else np.int32).astype(np.int64)
                parts.setdefault(block, []).append((small.view("<u8").ravel(), np.where(place < 0, 0, names[place]), place < 0))
        for block in list(parts):
            key, node, mark = (np.concatenate([p[i] for p in parts[block]]) for i in range(3))
            del parts[block]
            order = np.lexsort((node, key))
            key, node, mark = key[order], node[order], mark[order]
            again = np.zeros(len(key), bool)  # the same set from several tasks
            again[1:] = (key[1:] == key[:-1]) & (node[1:] == node[:-1]) & (mark[1:] == mark[:-1])
            key, node, mark = key[~again], node[~again], mark[~again]
            at, length = _runs(key)
            marked = np.add.reduceat(mark.astype(np.int64), at) > 0 if len(at) else np.zeros(0, bool)
            long = np.repeat((length > SHORT) | marked, length)
            if long.any():
                real = long & ~mark
                names = mix(key[real] + np.uint64(block) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)
                yield out(1, node[real], names, np.ones(len(names), np.int64))
            few = np.repeat(length > 1, length) & ~long
            key, node = key[few], node[few]
            pairs = []
            for d in range(1, SHORT):
                same = np.flatnonzero(key[d:] == key[:-d]) if len(key) > d else np.zeros(0, np.int64)
                if not len(same):
                    break
                pairs.append(np.stack([node[same], node[same + d]], 1))
            if pairs:
                p = np.concatenate(pairs)
                p = p[np.lexsort((p[:, 1], p[:, 0]))]
                first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]).any(1)])
                yield out(0, p[first, 0], p[first, 1], np.diff(np.r_[first, len(p)]))

    return run


def _families(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Classes (cid, rep, n, s1, s2, family) that may link to another one; sets go by their hash s1."""
    shingles = int(classes.agg(F.sum("n").alias("x")).first()["x"] or 0)
    keys = shingles * (100 - percent) * 6 / (100 + percent)  # about
    blocks = max(1, math.ceil(keys / BLOCK_KEYS))
    packed = docs.select("text").mapInArrow(frugal(_postings(width, percent, blocks)), "block int, kind int, x binary, y binary, z binary")
    counted = packed.repartition(blocks, "block").mapInArrow(frugal(_count_pairs(blocks)), "kind int, a long, b long, n long")
    counted = materialize(counted, "counted")
    long = counted.where("kind = 1").select("a", "b").distinct()
    bounds = counted.where("kind = 2").groupBy("a").agg(F.max("n").alias("n"))
    bounds = bounds.join(long.groupBy("a").agg(F.count(F.lit(1)).alias("long")), "a", "left").select("a", (F.col("n") - F.coalesce("long", F.lit(0))).alias("bound"))
    bounds = materialize(bounds, "bounds")
    pairs = counted.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = pairs.join(bounds, "a").where("n >= bound").drop("bound").join(bounds.withColumnRenamed("a", "b"), "b").where("n >= bound")
    heavy = long.join(bounds.where("bound < 1").select("a"), "a", "left_semi")
    found = connected_components(pairs.select("a", "b").unionAll(heavy.select("a", "b")))
    joined = found.join(classes, found["node"] == classes["s1"])
    members = materialize(joined.select("cid", "rep", "n", "s1", "s2", F.col("component").alias("family")), "members")
    discard(counted)
    return members


def _family_sets(width: int):
    """Shingle sets of the documents that stand for the classes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            for a, b in slices(offs):
                sets = shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], width)
                part = batch.slice(a, b - a)
                _, s1, s2 = _set_hashes(sets)  # where an id repeats, only the text with the class's own set counts
                mask = pa.array((s1 == part.column("s1").to_numpy()) & (s2 == part.column("s2").to_numpy()))
                columns = [part.column("cid"), part.column("family"), part.column("bins"), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([c.filter(mask) for c in columns], ["cid", "family", "bins", "items"])

    return run


def forest(cids, sets, percent: int):
    """(member, root) for the components of the links among sets, by products of the incidence with its transpose.

    Rows of the product are made one at a time, and only against rows that no
    component has yet: what is already connected needs no further test.
    """
    import numpy as np

    g = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if g == 2:
        inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(cids[1], cids[0])] if 100 * inter >= percent * (int(size.sum()) - inter) else []
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(g), size)
    first = np.r_[0, np.cumsum(size)]
    free = np.ones(g, bool)

    def index():
        """Postings of the rows that no component has yet, by column."""
        live = free[row]
        c, r = column[live], row[live]
        order = np.argsort(c, kind="stable")
        return r[order], np.r_[0, np.cumsum(np.bincount(c, minlength=int(column.max()) + 1))]

    postings, starts = index()
    indexed = g
    out = []
    for seed in range(g):
        if not free[seed]:
            continue
        free[seed] = False
        queue = [seed]
        while queue:
            left = int(free.sum())
            if not left:
                return out
            if left * 2 < indexed:
                (postings, starts), indexed = index(), left
            x = queue.pop()
            cols = column[first[x] : first[x + 1]]
            lo, n = starts[cols], starts[cols + 1] - starts[cols]
            at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
            inter = np.bincount(postings[at], minlength=g)
            may = free & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
            for y in np.flatnonzero(may & (100 * inter >= percent * (size + size[x] - inter))).tolist():
                free[y] = False
                out.append((cids[y], cids[seed]))
                queue.append(y)
    return out


def _product(percent: int):
    def run(table):
        import numpy as np
        import pyarrow as pa

        fam = table.column("family").to_numpy()
        order = np.argsort(fam, kind="stable")
        cids, raw = table.column("cid").to_pylist(), table.column("items").to_pylist()
        cut = np.flatnonzero(np.r_[True, fam[order][1:] != fam[order][:-1]]).tolist() + [len(order)]
        links = []
        for i, j in zip(cut[:-1], cut[1:]):
            held = {cids[o]: raw[o] for o in order[i:j].tolist()}  # a repeated document counts once
            if len(held) > 1:
                links += forest(list(held), [np.frombuffer(x, np.uint64) for x in held.values()], percent)
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return run


def _links(docs: DataFrame, members: DataFrame, width: int, percent: int):
    """Spanning forest of the links between classes, as (a, b), and whether any family was split."""
    weights = members.groupBy("family").agg(F.sum("n").alias("w"))
    stats = weights.agg(F.sum("w").alias("w"), F.max("w").alias("most"), F.count(F.lit(1)).alias("f")).first()
    if not stats["f"]:
        return None, False
    bins = max(1, -(-int(stats["w"]) // (BLOCK_SHINGLES // 16)))
    split = int(stats["most"]) > BLOCK_SHINGLES
    k = F.ceil(F.col("w") / (BLOCK_SHINGLES // 2)).cast("int")
    jobs = members.join(weights, "family").withColumn("k", F.when(F.col("w") > BLOCK_SHINGLES, k).otherwise(1))
    jobs = jobs.withColumn("c", F.pmod(F.xxhash64("cid"), F.col("k")))
    pairs = F.when(F.col("k") == 1, F.array(F.concat(F.lit("s"), F.pmod(F.xxhash64("family"), F.lit(bins))))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.concat_ws(":", F.col("family"), F.least(F.col("c"), o), F.greatest(F.col("c"), o)))
    )
    jobs = jobs.select("cid", "rep", "s1", "s2", "family", pairs.alias("bins"))
    weight = jobs.agg(F.sum(F.lit(64) + F.aggregate("bins", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16)).alias("w")).first()["w"] or 0
    if weight <= BROADCAST_BYTES:
        jobs = F.broadcast(jobs)
    text = docs.select(F.col("doc_id").alias("rep"), "text")
    sets = text.join(jobs, "rep").select("cid", "family", "bins", "s1", "s2", "text").mapInArrow(frugal(_family_sets(width)), "cid long, family long, bins array<string>, items binary")
    tasks = sets.select("cid", "family", F.explode("bins").alias("bin"), "items")
    return materialize(tasks.groupBy("bin").applyInArrow(_product(percent), "a long, b long"), "links"), split


def ngram_components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", tag_col: str | None = None) -> DataFrame:
    """Components of documents whose sets of word shingles have a Jaccard similarity of ``percent``/100 or more.

    Returns (doc_id, n_shingles, component_id) for every row of ``docs``.  With
    ``tag_col``, a long, also ``tag``, which tells rows of one id apart, and
    ``group``, the component's own number: components of different texts that
    share an id may have one component_id, but not one group.  It is null for a
    set without words, and where no row of the set has an id.
    """
    tag = F.col(tag_col).cast("long") if tag_col else F.lit(None).cast("long")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), tag.alias("tag"))
    signed = materialize(docs.mapInArrow(frugal(_signatures(width)), "doc_id long, tag long, n long, s1 long, s2 long"), "signatures")
    classes = signed.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    classes = classes.where("rep is not null")
    classes = materialize(classes.withColumn("cid", F.col("rep")), "classes")
    if classes.groupBy("rep").count().where("count > 1").limit(1).count():  # an id with several texts: further classes stand under negative numbers
        nth = F.row_number().over(Window.partitionBy("rep").orderBy("s1", "s2"))
        classes = materialize(classes.withColumn("nth", nth).withColumn("cid", F.when(F.col("nth") == 1, F.col("rep")).otherwise(F.expr("s1 | shiftleft(1L, 63)"))).drop("nth"), "classes")
    links, split = _links(docs, _families(docs, classes, width, percent), width, percent)
    rows = signed.select("doc_id", "tag", "n", "s1", "s2")
    if links is None:
        labelled = classes.select("s1", "s2", "rows", F.col("rep").alias("least"), F.col("cid").alias("group"))
    else:
        comp = connected_components(links) if split else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        labels = classes.select("s1", "s2", "rows", "cid", "rep").join(comp, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
        labels = materialize(labels.select("s1", "s2", "rows", "rep", "component"), "labels")
        labelled = labels.join(labels.groupBy("component").agg(F.min("rep").alias("least")), "component").select("s1", "s2", "rows", "least", F.col("component").alias("group"))
    # copies of one text stand under one key: sets that very many rows have are looked up, so that no key gathers them
    total = classes.agg(F.sum("rows").alias("n")).first()["n"] or 0
    hot = F.broadcast(labelled.where(F.col("rows") > max(1000, total * HOT)).select("s1", "s2", F.col("least").alias("l"), F.col("group").alias("g"), F.lit(True).alias("hot")))
    looked = rows.join(hot, ["s1", "s2"], "left")
    cold = looked.where("hot is null").drop("l", "g", "hot").join(labelled.drop("rows"), ["s1", "s2"], "left")
    joined = cold.unionByName(looked.where("hot").select(*rows.columns, F.col("l").alias("least"), F.col("g").alias("group")))
    out = ["doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")]
    return joined.select(*out, *(["tag", F.when(F.col("n") > 0, F.col("group")).alias("group")] if tag_col else []))
