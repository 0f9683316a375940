"""Sharding by jump consistent hashing."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from downfield.operators.numbering import running
from downfield.session import materialise


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key. Every key walks the shard counts at which it moved; with one shard more, a
    key either stays or moves to the new shard."""
    state = keys.astype(np.uint64).copy()
    at, following = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    walking = np.arange(len(state))
    while len(walking):
        at[walking] = following[walking]
        with np.errstate(over="ignore"):
            state[walking] = state[walking] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((state[walking] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        following[walking] = ((at[walking] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        walking = walking[following[walking] < shards]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards - 1`` for a key of type long; a null key is a key of its own."""
    if shards < 1:
        raise ValueError("shards must be positive")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    # The stable hash spreads neighbouring ids; it is never null.
    return place(F.xxhash64(F.coalesce(key.cast("string"), F.lit("null"))))


def written_order(docs: DataFrame) -> list[Column]:
    """The place of each row in the Parquet files that ``docs`` reads, as they were numbered when written; none if it reads no
    files."""
    order = [F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long"), F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        docs.select(*order).schema
    except AnalysisException:
        return []
    return order


def shard(docs: DataFrame, shards: int, order: Sequence[Column] = ()) -> DataFrame:
    """Place every row of ``docs`` by its doc_id.

    Returns doc_id, size (UTF-8 bytes of the text plus 1, a null text has none), text_crc32, shard, slot (gapless from
    0 in each shard, in the given ``order``, then by doc_id, checksum and size) and grown_shard, the place with one shard more.
    Whole texts count, however long; repeated rows keep one slot each, a null doc_id is placed as one key and comes first, an empty
    table gives no rows, other columns are ignored."""
    body = F.coalesce(F.col("text"), F.lit(""))
    places = [f"place{i}" for i in range(len(order))]
    thin = docs.select("doc_id", (F.octet_length(body).cast("long") + 1).alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"), *[c.alias(n) for c, n in zip(order, places)])
    placed = materialise(thin.select("*", jump_shard(F.col("doc_id"), shards).alias("shard"),
                                     jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard")))
    by = [*map(F.col, places), F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    ranked = running(placed.withColumn("one", F.lit(1)), ["shard"], by, "one")
    return ranked.select("doc_id", "size", "text_crc32", "shard", F.col("rank").cast("long").alias("slot"), "grown_shard")
