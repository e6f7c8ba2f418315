"""Sharding by a permutation-filled lookup table, in DataFrame operations only.

Every shard has a preference order over the slots of a table of prime size: it
starts at one hash of its name and steps by another.  The shards take turns, as
often as their weights say, and claim the next slot of their order that is
free, until the table is full.  A row's key is hashed to a slot, and the table
(of fixed size) is broadcast, so that placing a row takes constant time.  When
a shard leaves, most other slots keep their shard.

Defined results: a null key is placed by the empty string; repeated keys go to
the same shard; extra columns are kept, but one that has the name of a result
(slot, shard) is replaced by it; no rows give no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import other_columns

#: Slots: a prime well above a hundred for each shard.  4 + 4 bytes each, so the broadcast is about half a MB.
TABLE_SIZE = 65_537


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """Index of the owning shard for every slot.  ``weights``: turns a round, 1 unless given."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and not empty")
    if not _prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime that is not below the number of shards")
    start = [_hash(s, "offset") % size for s in shards]
    step = [_hash(s, "skip") % (size - 1) + 1 for s in shards]
    turns = [max(1, int((weights or {}).get(s, 1))) for s in shards]
    at, owner, left = [0] * len(shards), [-1] * size, size
    while left:
        for i in range(len(shards)):
            for _ in range(turns[i]):
                while True:
                    slot = (start[i] + at[i] * step[i]) % size
                    at[i] += 1
                    if owner[slot] < 0:
                        break
                owner[slot] = i
                left -= 1
                if not left:
                    return owner
    return owner


def slot_of(key, size: int = TABLE_SIZE):
    """Slot of a key: the first 60 bits of its MD5, as other engines can compute them too."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def assign_shards(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """Add ``slot`` (int) and ``shard`` (string) to every row of ``df``."""
    owner = fill_table(shards, size, weights)
    cells = F.split(F.lit(",".join(map(str, owner))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    table = df.sparkSession.range(1).select(F.posexplode(cells).alias("slot", "i")).select("slot", F.get(names, F.col("i").cast("int")).alias("shard"))
    placed = df.select(*[F.col(f"`{c}`") for c in other_columns(df, ("slot", "shard"))], slot_of(F.col(key), size).alias("slot"))
    return placed.join(F.broadcast(table), "slot").select(*placed.columns, "shard")
