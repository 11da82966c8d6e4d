"""Gapless row numbers without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.plans.checkpoints import checkpointed


def with_row_number(df: DataFrame, order: list[str], name: str = "row_no") -> tuple[DataFrame, int]:
    """Adds gapless numbers 0..n-1 in ascending order of the given columns, and returns n too.

    One range shuffle, no single-task sort: each range partition counts its rows, the driver adds up one number per
    partition. Rows that tie in all order columns get distinct neighbouring numbers; so that a hot value can be split
    over partitions, the place in the input is the last range key.
    """
    spark = df.sparkSession
    keyed = df.withColumn("__place", F.monotonically_increasing_id())
    sort = [F.col(f"`{c}`").asc_nulls_first() for c in order] + [F.col("__place").asc()]
    ranged = checkpointed(keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *sort).sortWithinPartitions(*sort).drop("__place"))
    placed = ranged.withColumn("__at", F.monotonically_increasing_id())
    counts = {r[0]: r[1] for r in placed.groupBy(F.shiftright("__at", 33).alias("p")).count().collect()}
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append((p, total))
        total += counts.get(p, 0)
    offsets = spark.createDataFrame(starts or [(0, 0)], "__p long, __start long")
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(F.broadcast(offsets), F.shiftright("__at", 33) == F.col("__p"))  # one row per partition
    return numbered.withColumn(name, F.col("__start") + within).drop("__at", "__p", "__start"), total


def with_position(df: DataFrame, by: str, order: str, name: str = "pos", size: str = "n") -> DataFrame:
    """Adds each row's place 0, 1, ... within its group, and the group's number of rows. Groups of any size are spread over tasks."""
    numbered, _ = with_row_number(df, [by, order], "__row")
    groups = numbered.groupBy(by).agg(F.min("__row").alias("__first"), F.count("*").alias(size))
    joined = numbered.join(groups, numbered[by].eqNullSafe(groups[by])).drop(groups[by])
    return joined.withColumn(name, F.col("__row") - F.col("__first")).drop("__row", "__first")


def running_sums(df: DataFrame, by: str, order: str, sums: dict[str, Column]) -> DataFrame:
    """Adds running sums (each row's own included) over the rows of a group in order; groups of any size are spread over tasks.

    Rows are dealt by ranges of group and order. Each range adds up its part of each group, these few sums are added up
    over the ranges before, and within a range the sums run on from there.
    """
    sort = [F.col(by).asc_nulls_first(), F.col(order).asc_nulls_first()]
    valued = df.withColumns({f"__v{i}": c for i, c in enumerate(sums.values())})
    ranged = checkpointed(valued.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *sort).sortWithinPartitions(*sort))
    placed = ranged.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    parts = placed.groupBy(F.col(by).alias("__by"), "__part").agg(*(F.sum(f"__v{i}").alias(f"__s{i}") for i in range(len(sums))))
    earlier = Window.partitionBy("__by").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = parts.select("__by", F.col("__part").alias("__p"), *(F.coalesce(F.sum(f"__s{i}").over(earlier), F.lit(0)).alias(f"__b{i}") for i in range(len(sums))))
    within = Window.partitionBy(by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = placed.join(before, (placed["__part"] == before["__p"]) & placed[by].eqNullSafe(before["__by"]))
    added = joined.withColumns({name: F.col(f"__b{i}") + F.coalesce(F.sum(f"__v{i}").over(within), F.lit(0)) for i, name in enumerate(sums)})
    return added.select(*df.columns, *sums)
