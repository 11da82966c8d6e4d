"""Sharding: a seeded Feistel permutation over global row numbers deals rows to shards.

Every row gets a row number 0..n-1 (ascending id, then size and checksum of the text). A Feistel network over the
smallest power of two that holds n permutes the numbers; results of n or more walk the cycle on until they are
below n, which keeps the map a bijection on 0..n-1. Position p goes to shard p mod k, slot p div k. So shards
differ by at most one row, slots have no gaps, and both can be computed from a row number (and back) without data.

Null or empty texts have size 1. Null ids come first. Rows that repeat in id and text are interchangeable and get
different slots. An empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, table, with_row_number

ROUNDS = 6
_M32 = np.uint64(0xFFFFFFFF)
# The multipliers of the public murmur3 32-bit finaliser, and the 32-bit golden ratio.
_MULTIPLIERS = (0x85EBCA6B, 0xC2B2AE35)
_GOLDEN = 0x9E3779B9


def _round(half: np.ndarray, seed: int, number: int) -> np.ndarray:
    """A 32-bit hash of one half under the key of a round."""
    key = (seed * _MULTIPLIERS[0] + (number + 1) * _GOLDEN) & 0xFFFFFFFF
    x = (half ^ np.uint64(key)) & _M32
    x = (x ^ (x >> np.uint64(16))) * np.uint64(_MULTIPLIERS[0]) & _M32
    x = (x ^ (x >> np.uint64(13))) * np.uint64(_MULTIPLIERS[1]) & _M32
    return x ^ (x >> np.uint64(16))


def _network(x: np.ndarray, bits: int, seed: int, back: bool) -> np.ndarray:
    low_bits = bits - bits // 2
    shift, low_mask, high_mask = np.uint64(low_bits), np.uint64((1 << low_bits) - 1), np.uint64((1 << bits // 2) - 1)
    high, low = x >> shift, x & low_mask
    for number in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if number % 2:
            low = low ^ (_round(high, seed, number) & low_mask)
        else:
            high = high ^ (_round(low, seed, number) & high_mask)
    return high << shift | low


def permute(rows: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """Where each row number of 0..n-1 goes (back: which row number came there)."""
    out = np.asarray(rows, np.uint64).copy()
    if n < 2:
        return out.astype(np.int64)
    bits = max(2, (n - 1).bit_length())
    walk = np.arange(len(out))
    while len(walk):
        out[walk] = _network(out[walk], bits, seed, back)
        walk = walk[out[walk] >= np.uint64(n)]
    return out.astype(np.int64)


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that lies in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def shard_rows(df: DataFrame, shards: int, seed: int = 20240, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_no, shard, slot for every row of df."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = id_and_text(df, id_col, text_col).select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    numbered, n = with_row_number(sized, ["doc_id", "size", "text_crc32"])

    @F.arrow_udf("long")
    def position(rows: pa.Array) -> pa.Array:
        return pa.array(permute(rows.to_numpy(), n, seed))

    at = numbered.withColumn("__position", position("row_no"))
    return at.select("doc_id", "size", "text_crc32", "row_no", (F.col("__position") % shards).cast("int").alias("shard"), F.floor(F.col("__position") / shards).cast("long").alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_rows(table(spark, sf_dir, "documents"), shards=16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")
