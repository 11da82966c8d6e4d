"""Pairing two relations: products, and joins whose keys may hold very many rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A side of at most so many rows may be broadcast; larger ones are dealt in blocks.
BROADCAST_ROWS = 20_000
#: The most rows of either side that meet in one block.
BLOCK_ROWS = 10_000
#: Keys that are cut into blocks are fewer than this, so their list may be broadcast.
HOT_KEYS = 10_000
#: The most partitions that a join with a bound on pairs is dealt to.
MOST_PARTS = 4096


def _dealt(left: DataFrame, right: DataFrame, by: list[str], i: Column, j: Column, parts: int | None = None) -> DataFrame:
    """left and right joined on `by` in a grid: left in i blocks, each sent to the j blocks of right, and the other way about. parts: so many tasks, however few bytes they get."""
    block = lambda df, n: F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns if not c.startswith("__"))), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    a = left.withColumn("__i", block(left, i)).withColumn("__j", every(j)).drop("__left", "__right")
    b = right.withColumn("__j", block(right, j)).withColumn("__i", every(i)).drop("__left", "__right")
    keys = [*by, "__i", "__j"]
    if parts:
        a, b = a.repartition(parts, *keys), b.repartition(parts, *keys)
    return a.join(b, keys).drop("__i", "__j")


def all_pairs(left: DataFrame, right: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every row of left with every row of right, or with every one that agrees in `by`, which has few values; other column names must differ.

    Topic vocabularies and attribute lists are short, so the right side is counted and broadcast. If it is longer, both
    sides are dealt into blocks of at most about BLOCK_ROWS rows, fewer where that leaves cores idle, and each pair of
    blocks is a key of its own: a task holds two blocks, never a whole side.
    """
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), by) if by else left.crossJoin(F.broadcast(right))
    n, m = left.count(), right.count()
    size = max(1, min(BLOCK_ROWS, math.ceil(math.sqrt(n * m / (3 * left.sparkSession.sparkContext.defaultParallelism)))))
    i, j = max(1, -(-n // size)), max(1, -(-m // size))
    return _dealt(left, right, by or [], F.lit(i), F.lit(j))


def salted_join(left: DataFrame, right: DataFrame, by: list[str], most_pairs: int | None = None) -> DataFrame:
    """left joined with right on `by`. Keys with very many rows on a side are cut into blocks of rows, so that they meet in many tasks.

    most_pairs: so are keys with more pairs than this, and there is a task for about as many pairs.
    """
    sizes = left.groupBy(*by).agg(F.count("*").alias("__left")).join(right.groupBy(*by).agg(F.count("*").alias("__right")), by)
    count = lambda f, c: F.coalesce(f(c), F.lit(0))
    product = F.col("__left") * F.col("__right")
    rows, longest, pairs, widest = sizes.agg(count(F.sum, F.col("__left") + F.col("__right")), count(F.max, F.greatest("__left", "__right")), count(F.sum, product), count(F.max, product)).first()
    size = max(BLOCK_ROWS, -(-rows // HOT_KEYS))  # fewer than HOT_KEYS keys have more rows than this
    bound = max(most_pairs, -(-pairs // HOT_KEYS)) if most_pairs else max(pairs, 1)  # nor more pairs than this
    if longest <= size and widest <= bound:
        return left.join(right, by)
    hot = sizes.filter((F.greatest("__left", "__right") > size) | (product > bound))
    marked = lambda df: df.join(F.broadcast(hot), by, "left")
    # A block has up to `size` rows, and up to the root of `bound` unless the other side is too short to need that.
    side = lambda other: F.least(F.lit(float(size)), F.greatest(F.lit(math.sqrt(bound)), bound / F.col(other)))
    blocks = lambda own, other: F.coalesce(F.ceil(F.col(own) / side(other)), F.lit(1))
    parts = min(MOST_PARTS, max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // bound))) if most_pairs else None
    return _dealt(marked(left), marked(right), by, blocks("__left", "__right"), blocks("__right", "__left"), parts)


def in_cells(left: DataFrame, right: DataFrame, by: tuple[str, str], i: int, j: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What `work` gives for each pair of blocks, left dealt into i blocks and right into j by the columns `by`. A task holds two blocks; what it passes on should be few rows, as pairs themselves are not."""
    block = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    renamed = lambda df, side: [F.col(f"`{c}`").alias(f"{side}{k}") for k, c in enumerate(df.columns)]
    a = left.select(*renamed(left, "l"), block(by[0], i).alias("i"), every(j).alias("j")).repartition(i * j, "i", "j")
    b = right.select(*renamed(right, "r"), block(by[1], j).alias("j"), every(i).alias("i")).repartition(i * j, "i", "j")
    names, shape = (left.columns, right.columns), to_arrow_schema(T.StructType.fromDDL(schema))

    def both(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return shape.empty_table()
        own = [t.select([f"{side}{k}" for k in range(len(n))]).rename_columns(n) for t, side, n in ((x, "l", names[0]), (y, "r", names[1]))]
        return work(*own).cast(shape)

    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(both, schema)
