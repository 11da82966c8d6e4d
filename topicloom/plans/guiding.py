"""Expansion from one guiding table (entry B; G7, K17, K18, B4-B9)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.similarity import name_similarity
from topicloom.operators import kb, lexicon, matchers, select
from topicloom.operators.pairs import all_pairs

from .checkpoints import checkpointed
from .params import Params


@dataclass
class Catalogue:
    """topics(dataset, topic), attrs(dataset, attr, ordinal), contexts of both (dataset, name, synset, overlap) and the hypernym closure; contexts may be left out."""

    topics: DataFrame
    attrs: DataFrame
    topic_contexts: DataFrame | None = None
    attr_contexts: DataFrame | None = None
    closure: DataFrame | None = None


def attribute_scores(c: Catalogue, every_topic: bool, p: Params) -> DataFrame:
    """Dataset, attribute, topic, ordinal, ngram, wordnet, overlap of attributes with their own table's topics, or with all topics."""
    attrs = c.attrs.select("dataset", F.col("attr").alias("attribute"), "ordinal")
    pairs = all_pairs(attrs, c.topics.select("topic").distinct()) if every_topic else attrs.join(c.topics.select("dataset", "topic").distinct(), "dataset")
    scored = pairs.withColumn("ngram", name_similarity(F.col("topic"), F.col("attribute")))
    if c.closure is None:
        return scored.withColumn("wordnet", F.lit(0.0)).withColumn("overlap", F.lit(1.0))
    meaning = lexicon.context_similarity(c.attr_contexts, c.topic_contexts, c.closure).select("dataset", "attribute", "topic", F.col("score").alias("wordnet"))
    shared = lexicon.context_overlap(c.attr_contexts, c.topic_contexts, p.parity).select(F.col("left_name").alias("attribute"), F.col("right_name").alias("topic"), F.greatest(F.col("score"), F.lit(1)).alias("overlap"))
    joined = scored.join(meaning, ["dataset", "attribute", "topic"], "left").join(shared.dropDuplicates(["attribute", "topic"]), ["attribute", "topic"], "left")
    return joined.na.fill({"wordnet": 0.0, "overlap": 1})


def local_mapping(c: Catalogue, p: Params = Params(), every_topic: bool = True, done: DataFrame | None = None) -> DataFrame:
    """kb2 of each table's attributes; tables that `done` (dataset) has are left out."""
    if done is not None:
        c = Catalogue(c.topics, c.attrs.join(done, "dataset", "left_anti"), c.topic_contexts, c.attr_contexts, c.closure)
    scores = attribute_scores(c, every_topic, p)
    fused = select.fused_weighted(scores, {"ngram": 0.4, "wordnet": 0.6}, p.topic_to_attr, p.topics_per_attr) if every_topic else select.fused_winner(scores, "ngram", "wordnet", "overlap", p.topic_to_attr, p.topics_per_attr)
    return fused.select("dataset", F.col("topic").alias("concept"), "attribute", F.col("score").alias("match_score"), F.array().cast("array<string>").alias("source_dataset"))


def frames(pairs: DataFrame, row_contexts: DataFrame | None, col_contexts: DataFrame | None, closure: DataFrame | None) -> DataFrame:
    """The frames of pairs (dataset, row_topic, col_topic) for matchers.table_scores: frame 1 by names, frame 0 by meanings.

    row_contexts: dataset, row_topic, a; col_contexts: dataset, col_topic, b: the synsets of both in each table.
    """
    named = pairs.withColumn("score", name_similarity(F.col("row_topic"), F.col("col_topic"))).withColumn("frame", F.lit(1))
    shown = ["dataset", "frame", "row_topic", "col_topic", "score"]
    if closure is None:
        return named.select(shown).withColumn("row_ordinal", F.col("row_topic"))
    met = pairs.join(row_contexts, ["dataset", "row_topic"]).join(col_contexts, ["dataset", "col_topic"])
    meant = met.join(lexicon.path_similarity(closure, met.select("a", "b").distinct()), ["a", "b"]).groupBy("dataset", "row_topic", "col_topic").agg(F.max("score").alias("score")).withColumn("frame", F.lit(0))
    return named.select(shown).unionByName(meant.select(shown)).withColumn("row_ordinal", F.col("row_topic"))


def _synsets(contexts: DataFrame | None, name: str, synset: str) -> DataFrame | None:
    return None if contexts is None else contexts.select("dataset", F.col("name").alias(name), F.col("synset").alias(synset)).distinct()


def composed_contexts(contexts: DataFrame, shown: DataFrame, added: DataFrame, guiding: str) -> DataFrame:
    """Topic, a: the guiding table's synsets of each topic that it shows, or where it has none those of the tables that gave the topic."""
    own = contexts.filter(F.col("dataset") == guiding).select(F.col("name").alias("topic"), F.col("synset").alias("a")).join(shown, "topic", "left_semi")
    given = contexts.select("dataset", F.col("name").alias("topic"), F.col("synset").alias("a")).join(added, ["dataset", "topic"], "left_semi").select("topic", "a").join(shown, "topic", "left_semi")
    return own.unionByName(given.join(own, "topic", "left_anti")).distinct()


def expand(c: Catalogue, guiding: str, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(kb2, dataset_topics) after at most p.rounds rounds, fewer if no topic is close any more.

    A round compares the topics that the guiding table shows with those that each other table still shows, transfers
    close ones, maps the guiding table's open attributes to other tables' topics that came near (coverage) and the other
    tables' open attributes to the topics shown (importance), and takes topics that were added from their tables.
    """
    spark = c.topics.sparkSession
    base = checkpointed(local_mapping(c, p, every_topic=True))
    topics = checkpointed(c.topics.select("dataset", "topic").distinct())
    shown = checkpointed(topics.filter(F.col("dataset") == guiding).select("topic"))
    exposed = topics.filter(F.col("dataset") != guiding)
    added = spark.createDataFrame([], "dataset string, topic string")
    groups = spark.createDataFrame([], "topic string, dataset string, member_topic string")
    attrs = c.attrs.select("dataset", F.col("attr").alias("col_topic")).distinct()
    foreign = attrs.filter(F.col("dataset") != guiding)
    tables = foreign.select("dataset").unionByName(exposed.select("dataset")).distinct()
    topic_synsets, attr_synsets = _synsets(c.topic_contexts, "col_topic", "b"), _synsets(c.attr_contexts, "col_topic", "b")

    def guiding_synsets() -> DataFrame | None:
        if c.closure is None:
            return None
        return all_pairs(composed_contexts(c.topic_contexts, shown, added, guiding).withColumnRenamed("topic", "row_topic"), tables)

    def best(found: DataFrame) -> DataFrame:
        return select.consumed(found.withColumn("ordinal", F.col("row_topic")), ["dataset", "col_topic"], p.transfer).drop("ordinal")

    def entries(found: DataFrame, concept: str, attribute: str, source: str | None) -> DataFrame:
        """Mappings of the guiding table; of equal ones from several tables the best."""
        given = found.select(F.lit(guiding).alias("dataset"), F.col(concept).alias("concept"), F.col(attribute).alias("attribute"), F.col("score").alias("match_score"), F.array(F.col("dataset") if source is None else F.lit(source)).alias("source_dataset"), F.col("dataset").alias("__from"))
        return select.best_per(given, ["dataset", "concept", "attribute"], "__from", "match_score").drop("__from")

    for _ in range(p.rounds):
        rows = shown.select(F.col("topic").alias("row_topic"))
        near = checkpointed(matchers.table_scores(frames(all_pairs(exposed.select("dataset", F.col("topic").alias("col_topic")), rows), guiding_synsets(), topic_synsets, c.closure), p.table_similarity))
        transfers = checkpointed(best(near).select("dataset", F.col("row_topic").alias("guiding_topic"), F.col("col_topic").alias("topic")))
        if transfers.isEmpty():
            break
        base = checkpointed(kb.transfer_topics(base, guiding, transfers)[0])
        added = checkpointed(added.unionByName(transfers.select("dataset", "topic")).distinct())
        groups = checkpointed(groups.unionByName(transfers.select(F.col("guiding_topic").alias("topic"), "dataset", F.col("topic").alias("member_topic"))).distinct())
        shown = checkpointed(shown.unionByName(transfers.select("topic")).distinct())
        # Coverage: topics that came near in some frame and are not shown yet.
        fresh = near.filter("score > 0").select("dataset", F.col("col_topic").alias("row_topic")).distinct().join(shown.withColumnRenamed("topic", "row_topic"), "row_topic", "left_anti")
        open_ = kb.unmapped_attributes(c.attrs.filter(F.col("dataset") == guiding), base).select(F.col("attr").alias("col_topic"))
        own = None if c.closure is None else all_pairs(attr_synsets.filter(F.col("dataset") == guiding).drop("dataset"), tables)
        cover = best(matchers.table_scores(frames(all_pairs(fresh, open_), _synsets(c.topic_contexts, "row_topic", "a"), own, c.closure), p.table_similarity))
        covered = checkpointed(cover)
        base = checkpointed(kb.upsert(base, entries(covered, "row_topic", "col_topic", None), ["dataset", "concept", "attribute"]))
        added = checkpointed(added.unionByName(covered.select("dataset", F.col("row_topic").alias("topic"))).distinct())
        # Importance: attributes of other tables that the guiding table's base does not have from them.
        had = base.filter(F.col("dataset") == guiding).select(F.col("attribute").alias("col_topic"), F.explode("source_dataset").alias("dataset"))
        rows = shown.select(F.col("topic").alias("row_topic"))
        matters = checkpointed(best(matchers.table_scores(frames(all_pairs(foreign.join(had, ["dataset", "col_topic"], "left_anti"), rows), guiding_synsets(), attr_synsets, c.closure), p.table_similarity)))
        base = checkpointed(kb.upsert(base, entries(matters, "row_topic", "col_topic", guiding), ["dataset", "concept", "attribute"]))
        groups = checkpointed(groups.unionByName(matters.select(F.col("row_topic").alias("topic"), "dataset", F.lit(None).cast("string").alias("member_topic"))).distinct())
        exposed = checkpointed(exposed.join(added, ["dataset", "topic"], "left_anti"))
        shown = checkpointed(shown.unionByName(groups.select("topic")).distinct())
    own = kb.dataset_topics(base.filter(F.col("dataset") == guiding), guiding)
    return base, own.unionByName(kb.propagate_groups(groups, guiding)).distinct()
