"""Packing: vector bin packing of token pieces by the dot-product heuristic.

Every text is tokenised and closed with an end id, and cut where a piece would pass the limit on tokens or that on
loss-bearing tokens. A piece has a demand in three dimensions: tokens, segments (one) and loss-bearing tokens. Sequences are
filled one at a time: of the open pieces that fit in every dimension the one whose demand has the largest dot
product with what is left of the sequence, both measured in capacities and weighted by the mean demand, goes in; if
none fits the sequence is closed. So large pieces go first and a dimension that runs short counts more.

Pieces are packed in blocks of `block` consecutive ones (by row number in id order), so a block's memory is fixed,
no key can make one large, and the result does not depend on partitions. At most the last sequences of a block stay
part empty. Null texts count as empty and still give their end id. Null ids come first; repeated rows are packed
each. An empty table gives an empty result. Other columns are not carried.

`documents` has no loss mask, so the query states one: the first PROMPT ids of a document are its prompt and bear no
loss. With LOSS loss-bearing tokens to a sequence, the later pieces of long documents are closed by that limit and
filled up with prompts and short documents; SEGMENTS closes sequences of many tiny documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, col, small, small_batches, table, with_row_number
from .tokens import SLICE_BYTES, encoder, vocabulary

#: The query's limits: ids of a prompt, and loss-bearing tokens and segments of a sequence.
PROMPT, LOSS, SEGMENTS = 64, 4032, 128

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long"


def pack_vectors(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The bin of each row of demand, numbered from 0; every row fits an empty bin."""
    share = demand / limits
    weight = share.mean(axis=0) if len(share) else share.sum(axis=0)
    order = np.argsort(-share.max(axis=1), kind="stable")
    share, open_, out, bin_ = share[order], np.arange(len(order)), np.full(len(order), -1), 0
    while len(open_):
        left, alive = np.ones(share.shape[1]), np.ones(len(open_), bool)
        own = share[open_]
        while True:
            alive &= (own <= left + 1e-12).all(axis=1)
            if not alive.any():
                break
            best = int(np.argmax(np.where(alive, own @ (weight * left), -1.0)))
            out[order[open_[best]]], alive[best] = bin_, False
            left = left - own[best]
        open_, bin_ = open_[out[order[open_]] < 0], bin_ + 1
    return out


def token_pieces(df: DataFrame, capacity: int, end_id: int, vocab: str, id_col: str = "doc_id", text_col: str = "text", prompt: str | int = 0, max_loss: int | None = None) -> DataFrame:
    """Pieces of at most `capacity` ids and max_loss loss-bearing ones. prompt: how many first ids of a document bear no loss, a number or a column (null: none)."""
    small_batches(df.sparkSession)
    first = F.greatest(F.coalesce(col(prompt).cast("long"), F.lit(0)), F.lit(0)) if isinstance(prompt, str) else F.lit(prompt).cast("long")
    base = df.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"), first.alias("prompt"))
    most = capacity if max_loss is None else max_loss

    def cut(batches):
        enc = encoder(vocab)
        for b in small(batches, limit=SLICE_BYTES):
            rows = []
            for doc, prompt, ids in zip(b.column("doc_id").to_pylist(), b.column("prompt").to_pylist(), enc.encode(b.column("text"))):
                raw, n = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes(), len(ids) + 1
                start = 0
                while start < n:
                    length = min(capacity, n - start, max(0, prompt - start) + most)
                    rows.append((doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n, min(length, max(0, start + length - prompt))))
                    start += length
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss"])

    return base.mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int = 4096, max_segments: int = 256, max_loss: int = 4096, block: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces; no sequence passes any of the three limits."""
    numbered, _ = with_row_number(checkpointed(pieces), ["doc_id", "start", "length", "ids_crc32"], "__row")
    limits = np.array([capacity, max_segments, max_loss], float)

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by("__row")
        length = group.column("length").to_numpy()
        demand = np.column_stack([length, np.ones(len(length)), group.column("loss").to_numpy()]).astype(float)
        bin_ = pack_vectors(demand, limits)
        order = np.argsort(bin_, kind="stable")
        ends = np.cumsum(length[order])
        first = np.nonzero(np.append(True, np.diff(bin_[order]) > 0))[0]
        offset = np.empty(len(length), np.int64)
        offset[order] = ends - length[order] - np.repeat((ends - length[order])[first], np.diff(np.append(first, len(length))))
        sequence = (group.column("__row").to_numpy() // block) * block + bin_
        return group.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    blocks = numbered.withColumn("__block", F.floor(F.col("__row") / block))
    return blocks.groupBy("__block").applyInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(df: DataFrame, capacity: int = 4096, end_id: int = 2, vocab: str | None = None, prompt: str | int = PROMPT, max_segments: int = SEGMENTS, max_loss: int = LOSS, block: int = 4096) -> DataFrame:
    return pack(token_pieces(df, capacity, end_id, vocab or vocabulary(), prompt=prompt, max_loss=max_loss), capacity, max_segments, max_loss, block)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
