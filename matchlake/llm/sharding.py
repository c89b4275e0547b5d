"""7. Sharding by a lookup table that permutations fill.

Each shard prefers the slots of a prime-sized table in an order of its own: hashes of its name give a first slot and a step. Shards
take turns; each claims the first slot of its order that is free, until none is. So slots are spread evenly, and when a shard leaves,
few slots other than its own change hands. The table has `slots` rows whatever the data, so it is broadcast, and a key finds its shard
by one hash and one lookup.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A prime, at least a hundred times as large as the number of shards.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(256))


def preference(name: str, slots: int) -> tuple[int, int]:
    """The first slot and the step of a shard's order."""
    h = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1


def fill(shards: tuple[str, ...], slots: int = SLOTS) -> np.ndarray:
    """The number of the shard in each slot."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("distinct shards, at most as many as slots, and a prime number of slots")
    out = np.full(slots, -1)
    at, step = (list(x) for x in zip(*(preference(s, slots) for s in shards), strict=True))
    free = slots
    while free:
        for i in range(len(shards)):
            while out[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            out[at[i]] = i
            free -= 1
            if not free:
                break
    return out


def slot_of(key: Column, slots: int = SLOTS, without: tuple[Column, ...] = ()) -> Column:
    """A key's slot. Rows with a null key are dealt by these other columns, so they don't all share a slot."""
    return F.pmod(F.when(key.isNotNull() | F.lit(not without), F.xxhash64(key)).otherwise(F.xxhash64(*without or (key,))), F.lit(slots))


def placed(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, columns: tuple[str, str] = ("slot", "shard"), spread: tuple[str, ...] | None = None) -> DataFrame:
    """df with the slot and shard of each row's key. Equal keys share a shard, so key should identify rows (a hot source would fill one
    shard; ids don't). Rows with a null key are dealt by the columns of spread, or all others but maps: only whole copies share a shard.
    No rows, no rows; extra columns stay, whatever their names."""
    if spread is None:
        spread = tuple(c for c, kind in df.dtypes if "map<" not in kind and kind != "variant")
    lookup = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(fill(tuple(shards), slots).tolist())], "number long, shard string")
    out = df.select(F.struct("*").alias("row"), slot_of(F.col(f"`{key}`"), slots, tuple(F.col(f"`{c}`") for c in spread)).alias("slot")).join(F.broadcast(lookup), F.col("slot") == F.col("number"))
    return out.select("row.*", F.col("slot").alias(columns[0]), F.col("shard").alias(columns[1]))


def write_shards(df: DataFrame, key: str, path: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, files: int = 4) -> None:
    """df as Parquet in a folder for each shard, of `files` files each."""
    if "shard" in df.columns:
        raise ValueError("the column shard names the folders")
    at = placed(df.select(F.struct("*").alias("row"), F.col(f"`{key}`").alias("key")), "key", shards, slots)
    at.repartition(len(shards) * files, "shard", F.pmod("slot", F.lit(files))).select("row.*", "shard").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: slot, shard, its text's length, and where it goes when the last shard leaves."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("text_chars"))
    now = placed(docs, "doc_id", spread=("text_chars",))
    return placed(now, "doc_id", SHARDS[:-1], SLOTS, ("_again", "shard_after"), ("text_chars",)).drop("_again")
