"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table whose size
is a prime. The shards take turns; at its turn a shard claims the first free
slot of its order. Shards so get equal numbers of slots, give or take one turn,
and when a shard comes or goes few slots change hands. A document's key is
hashed to a slot, and the broadcast table gives its shard in constant time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table. It bounds what is broadcast: about 1 MB.
SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % p for p in range(2, int(n**0.5) + 1))


def _number(label: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{label}".encode()).digest()[:8], "big")


def fill_table(shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> list[int]:
    """The shard index that owns each slot.

    slots must be a prime: then a preference order (offset + j * skip) mod
    slots visits every slot. A shard of weight w claims w slots at its turn.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, and at least one")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime and no less than the number of shards")
    weights = list(weights or [1] * len(shards))
    if len(weights) != len(shards) or min(weights) < 0 or not any(weights):
        raise ValueError("weights must be non-negative, one a shard, and not all 0")
    at = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    free = slots
    while free:
        for k, w in enumerate(weights):
            for _ in range(min(w, free)):
                while owner[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % slots
                owner[at[k]] = k
                free -= 1
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of its text, modulo slots. Null counts as its own key."""
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(slots)).cast("int")


def assign_shards(
    docs: DataFrame,
    key: str = "doc_id",
    shards: Sequence[str] = tuple(f"shard-{i:03d}" for i in range(64)),
    slots: int = SLOTS,
    weights: Sequence[int] | None = None,
    names: tuple[str, str, str] = ("slot", "shard", "shard_name"),
) -> DataFrame:
    """docs with the slot, index and name of each row's shard.

    Rows with equal keys share a shard; null keys are placed like one key more,
    so one key can fill a shard, but the placement itself moves no row. An
    empty table gives an empty result. Columns of docs that are called like a
    new column are replaced. Texts are not read.
    """
    spark = docs.sparkSession
    owner = fill_table(shards, slots, weights)
    names_of = F.from_json(F.lit("[" + ",".join('"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"' for s in shards) + "]"), "array<string>")
    lookup = spark.range(1, numPartitions=1).select(F.posexplode(F.from_json(F.lit(str(owner)), "array<int>")).alias(names[0], names[1]))
    kept = docs.drop(*[n for n in names if n != key]).withColumn(names[0], slot_of(F.col(key), slots))
    placed = kept.join(F.broadcast(lookup), names[0])
    return placed.withColumn(names[2], F.element_at(names_of, F.col(names[1]) + 1)).select(*[c for c in kept.columns if c != names[0]], *names)


def sql(shards: Sequence[str], slots: int = SLOTS, relation: str = "documents", key: str = "doc_id") -> str:
    """The placement in DuckDB's SQL, with the table as a list."""
    owner = fill_table(shards, slots)
    slot = f"CAST(CAST('0x' || substr(md5(coalesce('k' || CAST({key} AS VARCHAR), 'null')), 1, 15) AS BIGINT) % {slots} AS INTEGER)"
    return f"""WITH t AS (SELECT {owner} AS owner, {list(shards)} AS shards),
    k AS (SELECT {key}, {slot} AS slot FROM {relation})
    SELECT {key}, slot, CAST(owner[slot + 1] AS INTEGER) AS shard, shards[owner[slot + 1] + 1] AS shard_name FROM k, t"""
