"""Sharding by a permutation-filled lookup table, with DataFrame functions only.

Every shard has its own permutation of the slots of a table of prime size: offset + j * skip modulo the size,
from two hashes of its name. The shards take turns; in its turn a shard claims the first free slot of its
permutation. Shares are even to within one turn and few slots change hands when a shard comes or goes. A
row's slot is a hash of its key modulo the size; the table, whose size is checked, is broadcast, so that
placing a row takes constant time and no shuffle.

Defined results: a null key hashes as the empty string; equal keys, however long, share a shard; repeated rows stay;
ties: a slot that two shards want goes to the one whose turn it is; an empty table gives no rows; columns named as the
slot or the shard are replaced, all others come through; without shards, or with more shards than slots, a ValueError.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 4099
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))
#: The table is broadcast; this bounds it at a few MB.
MOST_SLOTS = 655_373


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(seed: str, name: str) -> int:
    return int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:15], 16)


def fill(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard number of every slot. A table's size doesn't depend on the data, so it is filled on the driver."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots or slots > MOST_SLOTS or not _is_prime(slots):
        raise ValueError("distinct shards, no more than slots, and a prime number of slots are needed")
    offset = [_hash("offset", s) % slots for s in shards]
    skip = [_hash("skip", s) % (slots - 1) + 1 for s in shards]
    tried = [0] * len(shards)
    table, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while True:
                slot = (offset[i] + tried[i] * skip[i]) % slots
                tried[i] += 1
                if table[slot] < 0:
                    break
            table[slot] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """60 bits of the key's md5, modulo the table's size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots))


def lookup(spark: SparkSession, shards: tuple[str, ...], slots: int, slot: str, shard: str) -> DataFrame:
    """(slot, shard) of every slot, from one literal."""
    listed = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    rows = spark.range(1).select(F.posexplode(listed).alias("p", "i"))
    return rows.select(F.col("p").cast("long").alias(slot), F.element_at(names, F.col("i").cast("int") + 1).alias(shard))


def place(rows: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """rows with two more columns, the slot and the shard of each row's key; columns of those names are replaced."""
    rows = rows.drop(*[c for c in (slot, shard) if c != key])
    table = lookup(rows.sparkSession, shards, slots, "_slot", "_shard")
    placed = rows.withColumn("_at", slot_of(rows[key], slots)).join(F.broadcast(table), F.col("_at") == F.col("_slot"))
    return placed.select(*rows.columns, F.col("_at").alias(slot), F.col("_shard").alias(shard))


def write_shards(rows: DataFrame, key: str, path: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> None:
    """One folder per shard. Rows are dealt by slot and by where they come from, so that a key with very many rows is
    written by several tasks; a task can hold parts of several slots and shards."""
    placed = place(rows, key, shards, slots)
    placed.repartition("slot", F.spark_partition_id() % 8).write.partitionBy("shard").parquet(path)
