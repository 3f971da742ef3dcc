"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime
size. Shards take turns, by weight, claiming their next free preferred slot,
until the table is full. A key's hash picks a slot, the slot its shard: one
array access, with a table of bounded size in every task. When a shard joins or
leaves, few slots change hands.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 32
#: Slots of the table; a prime, and the bound of what tasks hold.
TABLE_SIZE = 4093


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """The shard index of every slot; a shard of weight w claims w slots in its turn."""
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime")
    if not shards or len(shards) > size or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, at least one and no more than slots")
    start = [_number(f"start:{s}") % size for s in shards]
    step = [_number(f"step:{s}") % (size - 1) + 1 for s in shards]
    turns = [(weights or {}).get(s, 1) for s in shards]
    if min(turns) < 1:
        raise ValueError("weights must be positive")
    table, claimed, asked = [-1] * size, 0, [0] * len(shards)
    while True:
        for i in range(len(shards)):
            for _ in range(turns[i]):
                while True:
                    slot = (start[i] + asked[i] * step[i]) % size
                    asked[i] += 1
                    if table[slot] < 0:
                        break
                table[slot] = i
                claimed += 1
                if claimed == size:
                    return table


def slot_of(key: str, size: int = TABLE_SIZE) -> Column:
    """Slot of a key's text; a null key has the slot of the empty text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % size


def sharded(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; columns of these names are replaced.

    Equal keys, null included, always share a shard. No shuffle: the table is an
    array literal of at most ``size`` numbers.
    """
    table = lookup_table(shards, size, weights)
    held = F.lit(table)
    slotted = df.withColumn("slot", slot_of(key, size))
    return slotted.withColumn("shard", F.element_at(F.lit(shards), (F.element_at(held, (F.col("slot") + 1).cast("int")) + 1)))
