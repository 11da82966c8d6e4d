"""Iterative concept discovery: profile, initial match, instance match, clusters, split, merge, new concepts, to a fix-point (entry A; K4-K6, K14, K15, K21, K22)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.similarity import name_similarity
from topicloom.functions.text import is_int
from topicloom.operators import cluster, kb, profile, select
from topicloom.operators.pairs import all_pairs

from .checkpoints import checkpointed
from .params import Params


@dataclass
class KnowledgeBase:
    match: DataFrame
    cluster: DataFrame


def initialize(topics: DataFrame, attrs: DataFrame, stats: DataFrame) -> DataFrame:
    """K4: kb_match of topics (dataset, topic) against their tables' attributes (dataset, name, ordinal, data_type, domain, coded_values)."""
    pairs = topics.select("dataset", "topic").distinct().join(attrs.select("dataset", F.col("name").alias("attribute"), "ordinal"), "dataset")
    best = select.best_attribute(pairs.withColumn("score", name_similarity(F.col("topic"), F.col("attribute"))))
    chosen = best.select("dataset", F.col("attribute").alias("name")).distinct()  # values are listed for these alone
    known, held = attrs.join(chosen, ["dataset", "name"], "left_semi"), stats.join(chosen.withColumnRenamed("name", "attr"), ["dataset", "attr"], "left_semi")
    examples = profile.example_values(best, profile.coded_values(known, held))
    return examples.select(F.col("topic").alias("concept"), "dataset", "attribute", F.col("score").alias("match_score"), "example_values", "data_type")


def perform_matching(kb_match: DataFrame, values: DataFrame, stats: DataFrame, attrs: DataFrame, p: Params) -> DataFrame:
    """K5: sim(concept, src_dataset, src_attr, tar_dataset, tar_attr, ordinal, score) of all concepts against all other tables, in one plan.

    values: dataset, attr, ordinal, value. Pairs are pruned by type group before any value is compared.
    """
    group = profile.type_group(F.col("data_type"))
    types = attrs.select("dataset", F.col("name").alias("attr"), F.col("ordinal").alias("attr_ordinal"), group.alias("group"))
    key = F.concat_ws("|", "dataset", "attr")
    keyed = values.join(types, ["dataset", "attr"]).withColumn("key", key)
    sampled = profile.head_sample(keyed, ["dataset", "attr"], "ordinal", p.sample_ratio, p.sample_least, p.sample_most)
    usable = sampled.filter(F.col("value").isNotNull() & (F.col("value") != "None")).withColumn("ints", is_int(F.col("value")))
    counted = usable.groupBy("dataset", "attr", "attr_ordinal", "group", "ints", "value").agg(F.count("*").alias("n"))
    sources = kb_match.filter(F.col("attribute").isNotNull()).select("concept", F.col("dataset").alias("src_dataset"), F.col("attribute").alias("src_attr"))
    left = sources.join(counted.select(F.col("dataset").alias("src_dataset"), F.col("attr").alias("src_attr"), "group", "ints", F.col("value").alias("u"), F.col("n").alias("nu")), ["src_dataset", "src_attr"])
    right = counted.join(stats, ["dataset", "attr", "value"]).select(F.col("dataset").alias("tar_dataset"), F.col("attr").alias("tar_attr"), F.col("attr_ordinal").alias("ordinal"), "group", "ints", F.col("value").alias("v"), F.col("n").alias("nv"), "cnt")
    alike = all_pairs(left.select("u", "group", "ints").distinct(), right.select("v", "group", "ints").distinct(), ["group", "ints"]).select("u", "v").distinct().withColumn("s", name_similarity(F.col("u"), F.col("v"))).filter(F.col("s") > p.match_threshold)
    hits = left.join(alike, "u").join(right, ["v", "group", "ints"]).filter("src_dataset <> tar_dataset")
    sums = hits.groupBy("concept", "src_dataset", "src_attr", "tar_dataset", "tar_attr", "ordinal").agg(F.sum(F.col("s") * F.col("cnt") * F.col("nu") * F.col("nv")).alias("score"))
    if p.parity:
        return sums
    # The name's share of a composite is added to the count-weighted sum, whose scale the threshold is made for.
    named = name_similarity(F.col("src_attr"), F.col("tar_attr"))
    return sums.withColumn("score", (p.weights[0] * F.col("score") + p.weights[1] * named) / sum(p.weights))


def members_of(mappings: DataFrame) -> DataFrame:
    """concept, key, source, member of flat mappings, for split and merge."""
    source = F.concat_ws(".", "src_dataset", "src_attr")
    return mappings.select("concept", F.concat_ws("|", "concept", "src_dataset", "src_attr").alias("key"), source.alias("source"), F.concat_ws(".", "tar_dataset", "tar_attr").alias("member"), "src_dataset", "src_attr")


def _moved(base: KnowledgeBase, moves: DataFrame) -> KnowledgeBase:
    """The base with (concept, src_dataset) under new names."""
    to = moves.select("concept", "src_dataset", "new_concept").distinct()
    match = base.match.join(to.withColumnRenamed("src_dataset", "dataset"), ["concept", "dataset"], "left").withColumn("concept", F.coalesce("new_concept", "concept")).drop("new_concept")
    found = base.cluster.join(to, ["concept", "src_dataset"], "left").withColumn("concept", F.coalesce("new_concept", "concept")).drop("new_concept")
    # Concepts that held the same mapping hold it once when they are joined.
    found = select.best_per(found, ["concept", "src_dataset", "src_attr", "tar_dataset", "tar_attr"], "tar_attr", "score")
    return KnowledgeBase(checkpointed(select.best_per(match, ["concept", "dataset", "attribute"], "data_type", "match_score")), checkpointed(found))


def _empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def split(base: KnowledgeBase, threshold: float) -> KnowledgeBase:
    """K10 over the base; without a concept that falls apart it stays as it is."""
    members = checkpointed(members_of(kb.flatten(base.match, base.cluster)))
    parts = checkpointed(cluster.split_concepts(members.select("concept", "key", "member"), threshold).filter("new_concept <> concept"))
    return base if _empty(parts) else _moved(base, members.select("key", "src_dataset").distinct().join(parts, "key"))


def merge(base: KnowledgeBase, threshold: float) -> KnowledgeBase:
    """K11 over the base; without sources that are close it stays as it is."""
    members = checkpointed(members_of(kb.flatten(base.match, base.cluster)))
    pairs = checkpointed(cluster.merge_pairs(members.select("key", "source", "member"), threshold))
    if _empty(pairs):
        return base
    merged = cluster.merge_concepts(members.select("concept", "key", "source", "member"), threshold, pairs).filter("new_concept <> ''")
    return _moved(base, members.select("key", "src_dataset").distinct().join(merged, "key"))


def discover(topics: DataFrame, vocabulary: DataFrame, attrs: DataFrame, values: DataFrame, stats: DataFrame, p: Params = Params()) -> KnowledgeBase:
    """The whole loop. topics: dataset, topic to begin with; vocabulary: dataset, topic of all tables. Each round is checkpointed; it ends when no new concept has a table."""
    stats, values, attrs = checkpointed(stats), checkpointed(values), checkpointed(attrs)
    base = KnowledgeBase(checkpointed(initialize(topics, attrs, stats)), None)
    base.cluster = topics.sparkSession.createDataFrame([], "concept string, src_dataset string, src_attr string, tar_dataset string, tar_attr string, score double")
    fresh_match = base.match  # concepts of earlier rounds have their mappings already
    for _ in range(p.rounds):
        sim = perform_matching(fresh_match, values, stats, attrs, p)
        found = kb.clusters_from_matrices(sim, p.cluster_score)
        base.cluster = checkpointed(kb.add_to_clusters(base.cluster, found, base.match).select(*base.cluster.columns))
        base = merge(split(base, p.split_threshold), p.merge_threshold)
        concepts = base.match.select("concept").distinct()
        fresh = vocabulary.select("topic").distinct()
        scores = all_pairs(fresh, concepts).withColumn("score", name_similarity(F.col("topic"), F.col("concept")))
        new = kb.select_new_concepts(vocabulary, concepts, scores, p.new_concepts)
        owned = checkpointed(kb.in_scope(vocabulary.join(new.select("topic"), "topic", "left_semi"), vocabulary, attrs.select("dataset")).select("dataset", "topic").distinct())
        if _empty(owned):
            break
        fresh_match = checkpointed(initialize(owned, attrs, stats))
        base.match = checkpointed(kb.upsert(base.match, fresh_match, ["concept", "dataset"]))
    return base


def single_topic(topics: DataFrame, topic: str, attrs: DataFrame, values: DataFrame, stats: DataFrame, p: Params = Params(sample_least=20)) -> DataFrame:
    """One topic in all tables that have it, matched with all other tables once; samples take 20 rows at least."""
    base = checkpointed(initialize(topics.filter(F.col("topic") == topic), attrs, stats))
    return perform_matching(base, values, stats, attrs, p)


def toy_run(scores: DataFrame, attrs: DataFrame, values: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Topics against a schema (dataset, row, column, score), the potential matches with their coded values."""
    found = select.potential_matches(scores, "topic", "attribute", threshold)
    return profile.example_values(found.join(scores.select("dataset", "topic", "attribute"), ["topic", "attribute"]), attrs).select("dataset", "topic", "attribute", "score", "example_values")


