"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: slot
offset + j * skip (mod size) is its j-th choice. Shards take turns claiming the
first free slot of their order until the table is full, so slots are divided
evenly (counts differ by one at most) and a change of the shard list moves few
of them. A row's key is hashed to a slot, and the table gives its shard.

The table has as many rows as slots, a parameter, so its broadcast is bounded
whatever the data's size. Placement is a map: no shuffle, and no key is hot. A
writer that wants files by shard spreads every shard over several files
(`write_shards`), so a shard with a third of all rows is no single task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import read

#: 32 shards; a prime number of slots, over a hundred for each shard.
SHARDS = tuple(f"shard-{n:03d}" for n in range(32))
SLOTS = 4099


def _number(text: str, digits: int = 12) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard number of every slot."""
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct, at least one and at most one a slot")
    offsets = [_number("offset:" + s) % slots for s in shards]
    skips = [_number("skip:" + s) % (slots - 1) + 1 for s in shards]
    table, tried, free = [-1] * slots, [0] * len(shards), slots
    while free:
        for k in range(len(shards)):
            if not free:
                break
            while table[slot := (offsets[k] + tried[k] * skips[k]) % slots] >= 0:
                tried[k] += 1
            table[slot], free = k, free - 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key; null counts as the empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with `slot` and `shard`; columns of these names in df are replaced.

    Rows with equal keys get equal shards; null and empty keys get the same one.
    An empty table stays empty.
    """
    table = df.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(lookup_table(shards, slots))], "__slot int, shard string")
    kept = df.withColumn("__slot", slot_of(F.col(key), slots)).drop("slot", "shard")
    # slots rows, a parameter: the broadcast doesn't grow with the data
    return kept.join(F.broadcast(table), "__slot").withColumnRenamed("__slot", "slot")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS, files: int = 8) -> None:
    """Writes placed rows as path/shard=.../*.parquet, each shard in `files` files at most."""
    placed = place(df, key, shards, slots)
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c not in ("slot", "shard")]), F.lit(files))
    placed.repartition("shard", spread).write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return place(docs).select("doc_id", "n_bytes", "slot", "shard")
