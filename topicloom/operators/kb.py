"""The knowledge base as relations (K1-K20) and its growth from a guiding table.

kb_match(concept, dataset, attribute, match_score, example_values, data_type), kb_cluster(concept, src_dataset, src_attr,
tar_dataset, tar_attr, score), kb_datasource(concept, dataset), kb2(dataset, concept, attribute, match_score,
source_dataset).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pairs import all_pairs
from .select import best_per


def add_datasources(kb: DataFrame, more: DataFrame) -> DataFrame:
    """K1: more datasources of concepts; repeats are kept."""
    return kb.unionByName(more)


def upsert(kb: DataFrame, entries: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Entries replace rows with their keys; of several entries with equal keys the last in `order` counts."""
    if order is not None:
        latest = Window.partitionBy(*keys).orderBy(F.desc(order))
        entries = entries.withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n", order)
    return kb.join(entries, keys, "left_anti").unionByName(entries)


def find_datasources(topics: DataFrame, scope: DataFrame) -> DataFrame:
    """K3: dataset, topics: the topics (topic, sources) of each dataset in scope."""
    owned = topics.select("topic", F.explode("sources").alias("dataset"))
    return owned.join(scope.select("dataset").distinct(), "dataset", "left_semi").groupBy("dataset").agg(F.sort_array(F.collect_set("topic")).alias("topics"))


def clusters_from_matrices(sim: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Of each source attribute and target table the best target attribute over the threshold. sim: concept, src_dataset, src_attr, tar_dataset, tar_attr, ordinal, score."""
    best = best_per(sim, ["concept", "src_dataset", "src_attr", "tar_dataset"], "ordinal")
    return best.filter(F.col("score") > threshold).drop("ordinal")


def add_to_clusters(cluster: DataFrame, found: DataFrame, kb_match: DataFrame) -> DataFrame:
    """K7: found rows whose concept and source are known, upserted by concept, source and target table; the source attribute takes the concept's name for it."""
    known = kb_match.select("concept", F.col("dataset").alias("src_dataset"), F.col("attribute").alias("__attr"))
    renamed = found.join(known, ["concept", "src_dataset"]).withColumn("src_attr", F.col("__attr")).drop("__attr")
    return upsert(cluster, renamed, ["concept", "src_dataset", "tar_dataset"])


def flatten(kb_match: DataFrame, kb_cluster: DataFrame) -> DataFrame:
    """K8: concept, src_dataset, tar_dataset, src_attr, tar_attr, score of all mappings."""
    sources = kb_match.select("concept", F.col("dataset").alias("src_dataset"), F.col("attribute").alias("src_attr"))
    targets = kb_cluster.select("concept", "src_dataset", "tar_dataset", "tar_attr", "score")
    return sources.join(targets, ["concept", "src_dataset"]).select("concept", "src_dataset", "tar_dataset", "src_attr", "tar_attr", "score")


def mappings_of(mappings: DataFrame, dataset: str) -> DataFrame:
    """K9: mappings that touch a dataset as source or target."""
    return mappings.filter((F.col("src_dataset") == dataset) | (F.col("tar_dataset") == dataset))


def new_concepts(declared: DataFrame, mapped: DataFrame) -> DataFrame:
    """Attr, datasets: (dataset, attr) pairs declared or mapped but not both."""
    a, b = declared.select("dataset", "attr").distinct(), mapped.select("dataset", "attr").distinct()
    apart = a.exceptAll(b).unionAll(b.exceptAll(a))
    return apart.groupBy("attr").agg(F.sort_array(F.collect_set("dataset")).alias("datasets"))


def select_new_concepts(vocabulary: DataFrame, kb_concepts: DataFrame, scores: DataFrame, n: int = 5) -> DataFrame:
    """The n topics outside the base with the highest mean similarity to its concepts. scores: topic, concept, score."""
    fresh = vocabulary.select("topic").distinct().join(kb_concepts.select(F.col("concept").alias("topic")), "topic", "left_anti")
    return scores.join(fresh, "topic", "left_semi").groupBy("topic").agg(F.avg("score").alias("mean")).orderBy(F.desc("mean"), "topic").limit(n)


def in_scope(new: DataFrame, owned: DataFrame, scope: DataFrame) -> DataFrame:
    """New topics that a table in scope has; none ends the iteration. owned: topic, dataset."""
    return new.join(owned.join(scope.select("dataset").distinct(), "dataset", "left_semi"), "topic", "left_semi")


def concept_datasets(kb_match: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concept -> dataset and dataset -> topic."""
    pairs = kb_match.select("concept", "dataset").distinct()
    return pairs, pairs.select("dataset", F.col("concept").alias("topic"))


def dataset_topics(kb2: DataFrame, guiding: str) -> DataFrame:
    """Dataset, topic: an attribute's topics belong to its source datasets, else to the guiding table."""
    sources = F.when(F.size(F.coalesce("source_dataset", F.array().cast("array<string>"))) > 0, F.col("source_dataset")).otherwise(F.array(F.lit(guiding)))
    return kb2.select(F.explode(sources).alias("dataset"), F.col("concept").alias("topic")).distinct()


def triples(kb_match: DataFrame) -> DataFrame:
    """s, p, o: the base as triples."""
    named = F.replace("attribute", F.lit(" "), F.lit("-"))
    return kb_match.select(F.explode(F.array(F.struct(F.col("concept").alias("s"), F.lit("foaf:name").alias("p"), named.alias("o")), F.struct(named.alias("s"), F.lit("rdf:type").alias("p"), F.col("dataset").alias("o")), F.struct(F.col("dataset").alias("s"), F.lit("rdfs:label").alias("p"), F.col("match_score").cast("string").alias("o")))).alias("t")).select("t.*")


def transfer_topics(kb2: DataFrame, guiding: str, transfers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G1: the base and added(dataset, topic) after topics of other tables were put under the guiding table's. transfers: dataset, guiding_topic, topic.

    The other topic's attributes are copied under the guiding topic with their table as source; then the other topic's
    name stands for the whole group too.
    """
    t = transfers.select("dataset", "guiding_topic", "topic").distinct()
    copied = kb2.alias("k").join(t.alias("t"), (F.col("k.dataset") == F.col("t.dataset")) & (F.col("k.concept") == F.col("t.topic")))
    moved = copied.select(F.lit(guiding).alias("dataset"), F.col("t.guiding_topic").alias("concept"), "attribute", "match_score", F.array_distinct(F.concat(F.coalesce("source_dataset", F.array().cast("array<string>")), F.array(F.col("t.dataset")))).alias("source_dataset"))
    first = best_per(moved.withColumn("__o", F.concat_ws(",", "source_dataset")), ["dataset", "concept", "attribute"], "__o", "match_score").drop("__o")
    merged = upsert(kb2, first, ["dataset", "concept", "attribute"])
    group = merged.filter(F.col("dataset") == guiding).join(t.select(F.col("guiding_topic").alias("concept"), "topic").filter("concept <> topic").distinct(), "concept")
    aliased = group.select("dataset", F.col("topic").alias("concept"), "attribute", "match_score", "source_dataset")
    aliased = best_per(aliased.withColumn("__o", F.concat_ws(",", "source_dataset")), ["dataset", "concept", "attribute"], "__o", "match_score").drop("__o")
    return upsert(merged, aliased, ["dataset", "concept", "attribute"]), t.select("dataset", "topic").distinct()


def unmapped_attributes(attrs: DataFrame, kb2: DataFrame) -> DataFrame:
    """Dataset, attr without any topic."""
    return attrs.select("dataset", "attr").distinct().join(kb2.select("dataset", F.col("attribute").alias("attr")), ["dataset", "attr"], "left_anti")


def coverage_candidates(attrs: DataFrame, kb2: DataFrame, exposed: DataFrame, owned: DataFrame, guiding: str) -> DataFrame:
    """Attr, dataset, topic: unmapped attributes of the guiding table with topics of other tables that it has not shown."""
    open_ = unmapped_attributes(attrs.filter(F.col("dataset") == guiding), kb2).select("attr")
    fresh = owned.filter(F.col("dataset") != guiding).join(exposed.filter(F.col("dataset") == guiding).select("topic"), "topic", "left_anti")
    return all_pairs(open_, fresh.select("dataset", "topic").distinct())


def importance_candidates(attrs: DataFrame, kb2: DataFrame, exposed: DataFrame, guiding: str) -> DataFrame:
    """Dataset, attr, topic: unmapped attributes of other tables with the guiding table's topics."""
    open_ = unmapped_attributes(attrs.filter(F.col("dataset") != guiding), kb2)
    return all_pairs(open_, exposed.filter(F.col("dataset") == guiding).select("topic").distinct())


def topic_sources(added: DataFrame, topic: str) -> DataFrame:
    """Datasets that gave a topic."""
    return added.filter(F.col("topic") == topic).select("dataset").distinct()


def propagate_groups(groups: DataFrame, guiding: str) -> DataFrame:
    """Dataset, topic: every dataset of a group, and the guiding table, gets the group's name and all its topics. groups: topic, dataset, member_topic (null: the dataset brings none)."""
    datasets = groups.select("topic", "dataset").unionAll(groups.select("topic", F.lit(guiding).alias("dataset"))).distinct()
    topics = groups.filter("member_topic is not null").select("topic", F.col("member_topic").alias("given")).unionAll(groups.select("topic", F.col("topic").alias("given"))).distinct()
    return datasets.join(topics, "topic").select("dataset", F.col("given").alias("topic")).distinct()
