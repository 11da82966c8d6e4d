"""Evaluation of topic assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_recall(ground: DataFrame, labelings: DataFrame) -> DataFrame:
    """Correct, precision, recall of labelings (labeling, item, label) against ground (item, label).

    Correct are the distinct pairs of any labelling that are in the ground truth; precision divides by the size of the
    largest labelling, recall by the size of the ground truth; sizes of 0 count as -1.
    """
    correct = labelings.select("item", "label").distinct().join(ground.select("item", "label").distinct(), ["item", "label"], "left_semi").agg(F.count("*").alias("correct"))
    largest = labelings.groupBy("labeling").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    size = ground.agg(F.count("*").alias("size"))
    one = correct.crossJoin(largest).crossJoin(size)  # a row each
    safe = lambda c: F.when(F.col(c) == 0, -1).otherwise(F.col(c))
    return one.select("correct", (F.col("correct") / safe("largest")).alias("precision"), (F.col("correct") / safe("size")).alias("recall"))


def new_topics(predicted: DataFrame, original: DataFrame, tables: DataFrame) -> DataFrame:
    """The number of predicted (dataset, topic) pairs that are not original, and its average over tables."""
    fresh = predicted.select("dataset", "topic").distinct().join(original.select("dataset", "topic"), ["dataset", "topic"], "left_anti").agg(F.count("*").alias("n_new"))
    count = tables.agg(F.count("*").alias("n_tables"))
    return fresh.crossJoin(count).select("n_new", F.when(F.col("n_tables") > 0, F.col("n_new") / F.col("n_tables")).otherwise(0.0).alias("average_new"))


def cluster_topics(kb_cluster: DataFrame) -> DataFrame:
    """Dataset, topic: the names of the attributes that share a cluster with a dataset's."""
    names = kb_cluster.select("concept", F.col("src_dataset").alias("dataset"), F.col("src_attr").alias("attr")).unionAll(kb_cluster.select("concept", F.col("tar_dataset").alias("dataset"), F.col("tar_attr").alias("attr"))).distinct()
    return names.select("concept", "dataset").distinct().join(names.select("concept", F.col("attr").alias("topic")).distinct(), "concept").select("dataset", "topic").distinct()


def learned_topics(mapping: DataFrame, guiding: str) -> DataFrame:
    """Dataset, topic: the attributes and topics of a learned mapping (attr, topic)."""
    return mapping.select(F.col("attr").alias("topic")).unionAll(mapping.select("topic")).distinct().select(F.lit(guiding).alias("dataset"), "topic")


def evaluate_runs(predicted: DataFrame, ground: DataFrame, original: DataFrame) -> DataFrame:
    """E5: method, plan, precision, recall, new_topics of every method on every plan, all runs in one plan.

    predicted: method, plan, dataset, topic; ground and original: plan, dataset, topic; a plan's tables are those that
    its ground truth names. Sizes of 0 count as -1, as in precision_recall; new topics are counted by table.
    """
    pairs = predicted.select("method", "plan", "dataset", "topic").distinct()
    true = ground.select("plan", "dataset", "topic").distinct()
    tables = true.groupBy("plan").agg(F.count("*").alias("size"), F.count_distinct("dataset").alias("tables"))
    right = true.withColumn("right", F.lit(1))
    had = original.select("plan", "dataset", "topic").distinct().withColumn("had", F.lit(1))
    scope = true.select("plan", "dataset").distinct().withColumn("scope", F.lit(1))
    marked = pairs.join(right, ["plan", "dataset", "topic"], "left").join(had, ["plan", "dataset", "topic"], "left").join(scope, ["plan", "dataset"], "left")
    counted = marked.groupBy("method", "plan").agg(F.count("*").alias("n"), F.count("right").alias("correct"), F.sum((F.col("scope").isNotNull() & F.col("had").isNull()).cast("long")).alias("fresh")).join(tables, "plan", "left")
    return counted.select("method", "plan", (F.col("correct") / F.col("n")).alias("precision"), (F.col("correct") / F.coalesce("size", F.lit(-1))).alias("recall"), F.coalesce(F.col("fresh") / F.col("tables"), F.lit(0.0)).alias("new_topics"))


def run_averages(runs: DataFrame, by: list[str]) -> DataFrame:
    """Mean precision, recall and new topics by method and plan."""
    return runs.groupBy(*by).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("new_topics").alias("new_topics"), F.count("*").alias("runs"))


def coverage(schema_cover: DataFrame, entity_cover: DataFrame) -> DataFrame:
    """Mean over datasets of half the schema coverage plus half the entity coverage (dataset, covered 0/1 each)."""
    joined = schema_cover.select("dataset", F.col("covered").alias("s")).join(entity_cover.select("dataset", F.col("covered").alias("e")), "dataset", "full")
    return joined.agg(F.avg(0.5 * F.coalesce("s", F.lit(0)) + 0.5 * F.coalesce("e", F.lit(0))).alias("coverage"))
