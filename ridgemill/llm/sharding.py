"""Consistent placement by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a table of prime
size, a permutation given by two hashes of its name; shards take turns claiming
their next free slot until the table is full. A key's slot is its hash modulo
the table's size. Shards get nearly equal shares, and a shard that comes or
goes moves few keys beyond its own share.

The table has a fixed size whatever the data, and is broadcast; placing a key
is one hash and one lookup, without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgemill.llm.shared import unused

#: A prime; over 100 slots per shard keep shares within about 1 %.
SLOTS = 65_537


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (as a place in `shards`) of each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, each once")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table's size must be a prime, no smaller than the number of shards")
    hashed = [hashlib.sha256(name.encode()).digest() for name in shards]
    offset = [int.from_bytes(h[:8], "little") % slots for h in hashed]
    skip = [int.from_bytes(h[8:16], "little") % (slots - 1) + 1 for h in hashed]
    table, free = [-1] * slots, slots
    while free:
        for shard in range(len(shards)):
            while table[offset[shard]] >= 0:
                offset[shard] = (offset[shard] + skip[shard]) % slots
            table[offset[shard]] = shard
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text, modulo the size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(slots))


def assign(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """`rows` with the columns slot and shard added (replaced where they exist).

    Equal keys get equal shards, wherever they stand; a null key counts as an
    empty text. All other columns pass through, whatever their names. No rows
    give no rows.
    """
    names = F.array(*[F.lit(s) for s in shards])
    place = unused("place", rows)
    table = rows.sparkSession.createDataFrame(list(enumerate(fill(shards, slots))), f"slot bigint, {place} int")
    kept = [c for c in rows.columns if c not in ("slot", "shard")]
    placed = rows.select(*kept, slot_of(F.col(key), slots).alias("slot"))
    return placed.join(F.broadcast(table), "slot").select(*kept, "slot", F.element_at(names, F.col(place) + 1).alias("shard"))


def write_shards(rows: DataFrame, key: str, shards: list[str], path: str, split: int = 16) -> None:
    """Write `rows` as Parquet under ``shard=NAME``. A shard's rows go to `split`
    tasks by a hash of the whole row, so a hot key does not make one task."""
    placed, salt = assign(rows, key, shards), unused("salt", rows)
    placed.withColumn(salt, F.pmod(F.xxhash64(*rows.columns), F.lit(split))).repartition("shard", salt).drop(salt).write.partitionBy("shard").parquet(path)
