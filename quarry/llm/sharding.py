"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable key goes to a shard by a short chain of pseudo-random jumps; no ring or table is kept, and
appending a shard moves only the rows that land in the new one (1/(n+1) of them on average).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import map_text, materialise


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard 0..shards-1 of each unsigned 64-bit key."""
    key = keys.astype(np.uint64).copy()
    shard, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    open_ = np.arange(len(key))
    while len(open_):
        shard[open_] = ahead[open_]
        key[open_] = key[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (shard[open_] + 1).astype(np.float64) * (float(1 << 31) / ((key[open_] >> np.uint64(33)).astype(np.float64) + 1.0))
        ahead[open_] = step.astype(np.int64)
        open_ = open_[ahead[open_] < shards]
    return shard


def shard_column(df: DataFrame, key: str, counts: dict[str, int]) -> DataFrame:
    """Add one int column per entry of ``counts`` (column name: number of shards), by the key's jump hash.

    A null key counts as 0. Integers are their own keys; of other types the text form is hashed. Columns of
    those names are replaced.
    """
    df = df.drop(*counts)

    def keys_of(column: pa.Array) -> np.ndarray:
        if pa.types.is_integer(column.type):
            return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
        return np.array([0 if x is None else xxhash.xxh64_intdigest(str(x)) for x in column.to_pylist()], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = keys_of(b.column(b.schema.get_field_index(key)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(jump_hash(keys, n), pa.int32()) for n in counts.values())], names=[*b.schema.names, *counts])

    return map_text(df, run, T.StructType([*df.schema.fields, *(T.StructField(c, T.IntegerType()) for c in counts)]))


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shard, slot and grown shard of every document.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law = 'key', shard, slot (gapless from 0 in each
    shard) and grown_shard (its shard among ``shards + 1``). Null text counts as empty, a null doc_id as
    key 0; rows with equal ids share a shard and get slots of their own; an empty table gives no rows.
    Only ids, sizes and checksums leave the scan. Slots come from ranks inside (shard, stored partition)
    plus that partition's offset, so no task ever holds a whole shard.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shard_column(slim, "doc_id", {"shard": shards, "grown_shard": shards + 1})
    # stored, so that partition numbers and their rows are the same whenever they are read again
    placed = materialise(placed).withColumn("part", F.spark_partition_id())
    held = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    ranked = placed.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(held, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("rank")).alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, folder: str, shards: int = 8) -> None:
    """Write the rows of ``docs`` into ``folder/shard=<n>/``; every column is kept, a clashing ``shard`` is replaced."""
    shard_column(docs, "doc_id", {"shard": shards}).write.partitionBy("shard").parquet(folder)
