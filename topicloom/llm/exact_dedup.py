"""Exact dedup: sorted runs of digests are merged along a tree.

Every text, A-Z lower-cased, becomes a key: SHA-256, and for verification its length and a second hash; rows are
merged only where all three agree. Each partition makes sorted runs in which a key occurs once, with the row that
stays and how many rows it stands for. Runs are cut by digest into slices, whose number follows from the number of
keys, so that a slice stays small however large the table is. In each binomial round the runs of a slice are
exchanged in groups of `fan_in`, still sorted, and merged two by two until one is left; the row that stays is settled
again at every level, so copies shrink before they travel. After log(runs) rounds one run is left for each slice. A
large group of copies is one entry of each run.

The row that stays is the one with the largest id (keep="smallest": the smallest); of rows that repeat the id the one
whose text, as it is, has the largest (smallest) hash, so the order of rows changes nothing; of rows that repeat in id
and text one stays, in drop_exact_duplicates the one with the smallest hash of all columns. Null ids count as smaller (for "smallest": larger) than any. Null texts count as empty. An empty
table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_AZ, NO_ID, bytes_of, checkpointed, id_and_text, join_classes, keep_rows, partitions, table

#: A key is SHA-256 (32 bytes), length and second hash (8 bytes each).
KEY_BYTES = 48
#: A partition closes a run when it has so many rows.
RUN_ROWS = 1 << 20
#: Keys of a slice, about.
SLICE_KEYS = 1 << 18
_NONE = {"largest": -(1 << 63), "smallest": (1 << 63) - 1}


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (unique), raw (hash of the text as it is) and the key of every row."""

    def compute(batches):
        for b in batches:
            texts = bytes_of(b.column("text"))
            raw = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in texts), np.uint64, len(texts)).view(np.int64)
            texts = [t.translate(LOWER_AZ) for t in texts]
            keys = [hashlib.sha256(t).digest() + len(t).to_bytes(8, "big") + xxhash.xxh64_digest(t, 7) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(raw), pa.array(keys, pa.binary())], ["doc_id", "row", "raw", "key"])

    rows = id_and_text(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(compute, "doc_id long, row long, raw long, key binary")


class Run:
    """Entries sorted by key, one for each: keys (bytes) and values (id, raw hash and row that stay, number of rows)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    @staticmethod
    def of(keys: np.ndarray, ids: np.ndarray, raws: np.ndarray, rows: np.ndarray, largest: bool) -> Run:
        """A run of unsorted rows."""
        order = np.argsort(keys, kind="stable")
        return Run(keys[order], np.column_stack([ids, raws, rows, np.ones(len(ids), np.int64)])[order]).settled(largest)

    def settled(self, largest: bool) -> Run:
        """Neighbours with equal keys become one entry: the row that stays, and the sum of their numbers."""
        if not len(self.keys):
            return self
        first = np.nonzero(np.append(True, self.keys[1:] != self.keys[:-1]))[0]
        if len(first) == len(self.keys):
            return self
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(self.keys))))
        order = np.lexsort((self.values[:, 2], self.values[:, 1], self.values[:, 0], group))
        at = np.append(first[1:], len(self.keys)) - 1 if largest else first
        values = self.values[order[at]]
        values[:, 3] = np.add.reduceat(self.values[:, 3], first)
        return Run(self.keys[first], values)

    def merged(self, other: Run, largest: bool) -> Run:
        """Two sorted runs merged without sorting again: each entry of the other has its place found in this one."""
        place = np.searchsorted(self.keys, other.keys, "right") + np.arange(len(other.keys))
        own = np.ones(len(self.keys) + len(other.keys), bool)
        own[place] = False
        keys, values = np.empty(len(own), self.keys.dtype), np.empty((len(own), 4), np.int64)
        keys[place], values[place], keys[own], values[own] = other.keys, other.values, self.keys, self.values
        return Run(keys, values).settled(largest)

    def packed(self) -> tuple[bytes, bytes]:
        return self.keys.tobytes(), np.ascontiguousarray(self.values).tobytes()

    @staticmethod
    def unpacked(keys: bytes, values: bytes) -> Run:
        return Run(np.frombuffer(keys, f"S{KEY_BYTES}"), np.frombuffer(values, np.int64).reshape(-1, 4))


def merge_runs(runs: list[Run], largest: bool) -> Run:
    """One run of several, merged two by two, neighbours first."""
    while len(runs) > 1:
        runs = [runs[i].merged(runs[i + 1], largest) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def tree_merge(marked: DataFrame, keep: str = "largest", fan_in: int = 8, slice_keys: int = SLICE_KEYS) -> DataFrame:
    """key, keep, keep_raw, keep_row and n for each distinct key. marked: doc_id, raw, row, key."""
    largest, none = keep == "largest", _NONE[keep]
    slices = max(partitions(marked.sparkSession), -(-marked.count() // slice_keys))
    blob = "run long, slice int, keys binary, entries binary"

    def first_runs(batches):
        """The sorted runs of a partition, cut where the slices of digests begin."""
        held, size, closed, part = [], 0, 0, 0

        def cut():
            run = merge_runs(held, largest)
            top = np.frombuffer(run.keys.tobytes(), np.uint8).reshape(-1, KEY_BYTES)[:, :4].copy().view(">u4").ravel()
            of = (top.astype(np.uint64) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)  # ascends with the keys
            bounds = np.searchsorted(of, np.arange(slices + 1)) if slices < len(of) else np.append(np.nonzero(np.append(True, of[1:] != of[:-1]))[0], len(of))
            rows = [(part + closed, int(of[a]), *Run(run.keys[a:b], run.values[a:b]).packed()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if b > a]
            for i in range(0, len(rows), 4096):
                columns = zip(*rows[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["run", "slice", "keys", "entries"])

        for b in batches:
            if not b.num_rows:
                continue
            if not held and not closed:
                part = b.column("part")[0].as_py() << 20
            keys = np.array(b.column("key").to_pylist(), f"S{KEY_BYTES}")
            held.append(Run.of(keys, *(b.column(c).to_numpy() for c in ("id", "raw", "row")), largest))
            size += b.num_rows
            if size >= RUN_ROWS:
                yield from cut()
                held, size, closed = [], 0, closed + 1
        if held:
            yield from cut()

    numbered = marked.select("key", F.coalesce("doc_id", F.lit(none)).alias("id"), "raw", "row", F.spark_partition_id().cast("long").alias("part"))
    runs = checkpointed(numbered.mapInArrow(first_runs, blob))
    part, again = F.shiftright("run", 20), F.col("run").bitwiseAND(F.lit((1 << 20) - 1))
    parts, times = (1 + (x if x is not None else -1) for x in runs.agg(F.max(part), F.max(again)).first())
    runs, left = runs.withColumn("run", again * parts + part), parts * times

    def one_run(group: pa.Table) -> Run:
        order = np.argsort(group.column("run").to_numpy())
        keys, entries = group.column("keys"), group.column("entries")
        return merge_runs([Run.unpacked(keys[i].as_py(), entries[i].as_py()) for i in order.tolist()], largest)

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        k, v = one_run(group).packed()
        return pa.table({"run": pa.array([key[1].as_py()], pa.int64()), "slice": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([k], pa.binary()), "entries": pa.array([v], pa.binary())})

    def columns(run: Run) -> dict[str, pa.Array]:
        flat = pa.Array.from_buffers(pa.binary(KEY_BYTES), len(run.keys), [None, pa.py_buffer(run.keys.tobytes())]).cast(pa.binary())
        return {"key": flat} | {name: pa.array(np.ascontiguousarray(run.values[:, k])) for k, name in enumerate(("keep", "keep_raw", "keep_row", "n"))}

    def entries(batches):
        for b in batches:
            for keys, values in zip(b.column("keys"), b.column("entries")):
                yield pa.RecordBatch.from_pydict(columns(Run.unpacked(keys.as_py(), values.as_py())))

    settled = "key binary, keep long, keep_raw long, keep_row long, n long"
    while left > fan_in:
        runs = runs.withColumn("into", F.floor(F.col("run") / fan_in)).groupBy("slice", "into").applyInArrow(merge, blob)
        left = -(-left // fan_in)
    if left > 1:  # the last round gives the entries, so that no second Python worker stands behind its task
        return runs.groupBy("slice").applyInArrow(lambda group: pa.table(columns(one_run(group))), settled)
    return runs.select("keys", "entries").mapInArrow(entries, settled)


def exact_duplicates(df: DataFrame, keep: str = "largest", fan_in: int = 8, id_col: str = "doc_id", text_col: str = "text", slice_keys: int = SLICE_KEYS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and raw for every row of df."""
    marked = checkpointed(digests(df, id_col, text_col))
    settled = checkpointed(tree_merge(marked, keep, fan_in, slice_keys))
    joined = join_classes(marked, settled, ["key"])
    keep_id = F.when(F.col("keep") != _NONE[keep], F.col("keep"))
    return joined.select("doc_id", keep_id.alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"), "raw")


def drop_exact_duplicates(df: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, that stay."""
    found = exact_duplicates(df, keep, id_col=id_col, text_col=text_col).filter("kept")
    return keep_rows(df, found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("raw").alias("__raw")), id_col, text_col)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest").drop("raw")


OP8_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
