"""Vectorised 64-bit hashes of the words of many texts at once, in numpy.

A word's hash is a polynomial over its bytes, read off prefix sums, then mixed.
Bytes go through a random 64-bit table first.  Equal words have equal hashes;
different ones differ but for about one pair in 2**64.
"""

from __future__ import annotations

from .common import worker_state

#: Length of the tables that a worker keeps: a little more than a slice of texts, or a small token file, has bytes.
KEPT = (3 << 18) + (1 << 16)


def mix(x):
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(length: int):
    """Tables of powers up to a length, and of bytes; those for up to ``KEPT`` are kept for the next call."""
    import numpy as np

    state = worker_state().setdefault("wordhash", {})
    if "bytes" not in state:
        with np.errstate(over="ignore"):
            state["bytes"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        white = np.zeros(256, bool)
        white[[32, 9, 10, 11, 12, 13]] = True
        state["white"] = white
    if len(state.get("up", ())) < length:
        base = 0xD6E8FEB86659FD93
        down = pow(base, -1, 1 << 64)
        found = dict(state) if length > KEPT else state
        for name, b in (("up", base), ("down", down)):
            powers = np.full(length if length > KEPT else KEPT, b, np.uint64)
            powers[0] = 1
            found[name] = np.multiply.accumulate(powers)
        return found
    return state


def words(data, offsets, prefixes=()):
    """Words of texts in one buffer: maximal runs of bytes other than white space (0x20, 0x09-0x0D), A-Z lower-cased.

    Returns (hash of each word, index of the first word of each text and the
    end), and for each of ``prefixes`` the hashes of the words' first so many bytes.
    """
    import numpy as np

    n = len(data)
    docs = len(offsets) - 1
    if n == 0:
        none = np.zeros(0, np.uint64)
        return (none, np.zeros(docs + 1, np.int64), *[none for _ in prefixes])
    t = _tables(n + 1)
    upper = (data >= 65) & (data <= 90)
    low = np.where(upper, data + np.uint8(32), data)
    solid = ~t["white"][low]
    edge = np.zeros(n + 1, bool)  # where a text begins
    edge[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(t["bytes"][low] * t["up"][:n], out=sums[1:])
        down = t["down"][starts]

        def hashed(stops):
            h = (sums[stops + 1] - sums[starts]) * down
            return mix(h + (stops - starts + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

        h = hashed(ends)
        short = [hashed(np.minimum(ends, starts + p - 1)) for p in prefixes]
    return (h, np.searchsorted(starts, offsets), *short)


def run_hashes(data, starts):
    """Hashes of the runs of bytes that begin at ``starts`` and together make up ``data``."""
    import numpy as np

    n = len(data)
    t = _tables(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.take(t["bytes"], data, out=sums[1:], mode="clip")
        sums[1:] *= t["up"][:n]
        np.cumsum(sums[1:], out=sums[1:])
        at = sums[np.r_[starts, n]]
        return mix((at[1:] - at[:-1]) * t["down"][starts] + np.diff(starts, append=n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(data, offsets, width: int):
    """For each text, the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words, but not none, has its whole sequence as one shingle.
    """
    import numpy as np

    h, first = words(data, offsets)
    out = []
    with np.errstate(over="ignore"):
        k = np.uint64(0xD1342543DE82EF95)
        m = len(h) - width + 1
        if m > 0:
            acc = h[:m].copy()
            for i in range(1, width):
                acc = acc * k + h[i : i + m]
            acc = mix(acc + np.uint64(width))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                out.append(np.unique(acc[a : b - width + 1]))
            elif b > a:
                x = h[a]
                for i in range(a + 1, b):
                    x = x * k + h[i]
                out.append(mix(np.array([x + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
