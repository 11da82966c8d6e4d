"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.numbering import with_row_number  # noqa: F401  operators take it from here
from topicloom.plans.checkpoints import checkpointed, shared_dir  # noqa: F401  and these

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Table for bytes.translate() that lower-cases A-Z only.
LOWER_AZ = bytes.maketrans(_UPPER.encode(), _UPPER.lower().encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col(f"`{name}`")


#: Rows go to Python workers in batches of at most so many bytes.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's limit on Arrow batches, whose buffers exist in the JVM and in Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on, under fixed names, so that other columns cannot clash."""
    small_batches(df.sparkSession)
    return df.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: There are fewer keys than this that hold more than the HOT_KEYS-th part of all rows.
HOT_KEYS = 10_000
#: Keys of up to so many rows are never hot.
HOT_ROWS = 10_000


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows joined with classes, which have each key once and in `n` how many rows it has.

    Keys of very many rows would meet in one task each. Those with more than the larger of hot_rows and the HOT_KEYS-th
    part of all rows are fewer than HOT_KEYS, so they are joined by broadcast; the others by a shuffle.
    """
    total, most = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    hot_rows = max(hot_rows, total // HOT_KEYS)
    if most <= hot_rows:
        return rows.join(classes.hint("merge"), keys)
    hot, cold = classes.filter(F.col("n") > hot_rows), classes.filter(F.col("n") <= hot_rows)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return others.join(cold.hint("merge"), keys).unionByName(rows.join(F.broadcast(hot), keys))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Stands for a null id where keys are compared.
NO_ID = -(1 << 63)


def row_key(id_: Column, text: Column) -> tuple[Column, Column]:
    """Tells the rows of a table apart by id and text: columns __id and __raw."""
    return F.coalesce(id_.cast("long"), F.lit(NO_ID)).alias("__id"), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias("__raw")


def packed(df: DataFrame, name: str) -> Column:
    """All columns of df as one struct, in which their names cannot clash with an operator's own."""
    return F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(df.columns)]).alias(name)


def unpacked(name: str, columns: list[str]) -> list[Column]:
    return [F.col(f"{name}.c{i}").alias(c) for i, c in enumerate(columns)]


def keep_rows(df: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose row_key is in kept(__id, __raw); of rows that repeat in id and text the one with the smallest hash of all columns."""
    rows = df.select(packed(df, "__row"), *row_key(col(id_col), col(text_col)))
    keyed = rows.groupBy("__id", "__raw").agg(F.min_by("__row", F.struct(F.xxhash64("__row"), F.hash("__row"))).alias("__row"))  # repeats go before the shuffle
    found = keyed.join(kept.hint("merge"), ["__id", "__raw"], "left_semi")
    return found.select(*unpacked("__row", df.columns))


def small(batches, column: str = "text", limit: int = 2 << 20):
    """The batches cut to at most about `limit` bytes of a string column (a longer row comes alone), so that what is derived from a batch stays small. After the last one Arrow gives back what it holds for reuse, as workers outlive their tasks."""
    for b in batches:
        _, at = flat_utf8(b.column(column))
        start = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield b.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()


def bytes_of(array: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def flat_utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the offset of each row in them (one more than rows); null as empty."""
    array = array.fill_null("")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(array) else np.empty(0, np.uint8)
    return flat, at - at[0]
