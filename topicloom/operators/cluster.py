"""Clusters and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.plans.checkpoints import checkpointed

from .linkage import close_rows, close_vectors, inconsistent_groups, split_parts  # noqa: F401
from .numbering import running_sums
from .pairs import salted_join


def connected(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Node, root: the smallest node of each component of links (a, b). Labels are lowered along links and then along the labels' own labels, so long chains take few rounds."""
    both = checkpointed(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lowered = labels.join(near, "node").select("node", F.least("root", "near").alias("root"))
        jumped = lowered.join(lowered.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left")
        new = checkpointed(jumped.select("node", F.least("root", F.coalesce("up", "root")).alias("root")))
        changed = new.join(labels.withColumnRenamed("root", "old"), "node").filter("root <> old").limit(1).count()
        labels = new
        if not changed:
            return labels
    raise ArithmeticError("components did not settle")


def linkage(features: DataFrame, threshold: float) -> DataFrame:
    """Id, group: single linkage by cosine distance, cut at a distance, that is, components of pairs within it. features: id, vec. Groups are named by their smallest id; fewer than two rows give none."""
    return _groups(features.select("id"), close_vectors(features, threshold))


def _groups(ids: DataFrame, links: DataFrame) -> DataFrame:
    if ids.limit(2).count() < 2:
        return ids.select("id", F.col("id").alias("group")).limit(0)
    named = ids.join(connected(links).withColumnRenamed("node", "id"), "id", "left")
    return named.select("id", F.coalesce("root", "id").alias("group"))


def shared_members(members: DataFrame) -> DataFrame:
    """concept, a, b (a < b), shared: how many members sources (key) of a concept share. Pairs meet by an equi-join on concept and member, of which common ones are cut into blocks; those that share none have no row."""
    own = members.select("concept", "key", "member").distinct()
    a, b = own.withColumnRenamed("key", "a"), own.withColumnRenamed("key", "b")
    return salted_join(a, b, ["concept", "member"]).filter("a < b").groupBy("concept", "a", "b").agg(F.count("*").alias("shared"))


def _sized(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(sizes.select("concept", *(F.col(c).alias(f"{c}_{side}") for c in ("key", "n", "all"))).withColumnRenamed(f"key_{side}", side), ["concept", side])
    return pairs


def _split_distance(bound: float) -> Column:
    distance = (F.col("n_a") + F.col("n_b") - 2 * F.coalesce("shared", F.lit(0))) / (F.col("all_a") + F.col("all_b"))
    return F.when(distance > bound, distance).otherwise(0.0)


def split_distances(members: DataFrame, bound: float = 0.5) -> DataFrame:
    """Concept, a, b, distance of all pairs of sources (key) of a concept: |A symmetric difference B| / (nA + nB), 0 up to the bound. members: concept, key, member. Computed from the numbers of shared members, without lists of them."""
    sizes = checkpointed(members.groupBy("concept", "key").agg(F.count_distinct("member").alias("n"), F.count("member").alias("all")))
    every = salted_join(sizes.select("concept", F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("all").alias("all_a")), sizes.select("concept", F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("all").alias("all_b")), ["concept"]).filter("a < b")
    return every.join(shared_members(members), ["concept", "a", "b"], "left").select("concept", "a", "b", _split_distance(bound).alias("distance"))


def split_concepts(members: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Concept, key, new_concept: sources in other groups than the first move to temp_<concept>_<group>. All of a group's members are kept; a member that repeats counts once.

    Only pairs of sources that share a member are made (split_parts).
    """
    own = checkpointed(members.select("concept", "key", "member").distinct())
    sizes = own.groupBy("concept", "key").agg(F.count("*").alias("n")).withColumn("all", F.col("n"))
    edges = _sized(shared_members(own), sizes).select("concept", "a", "b", _split_distance(threshold).alias("w"))
    parts = split_parts(own.select("concept", "key").distinct(), edges, threshold)
    moved = F.concat(F.lit("temp_"), F.col("concept"), F.lit("_"), F.col("part").cast("string"))
    return parts.select("concept", "key", F.when(F.col("part") == 1, F.col("concept")).otherwise(moved).alias("new_concept"))


def merge_pairs(members: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Pairs of sources (a, b, cosine) over all concepts whose member sets, the source itself included, have a cosine distance of at most the threshold. Pairs meet by an equi-join on members, of which common ones are cut into blocks."""
    own = members.select("key", "member").unionByName(members.select("key", F.col("source").alias("member"))).distinct()
    sizes = own.groupBy("key").agg(F.count("*").alias("n"))
    a, b = own.withColumnRenamed("key", "a"), own.withColumnRenamed("key", "b")
    both = salted_join(a, b, ["member"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    scored = both.join(sizes.select(F.col("key").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b")
    cosine = F.col("shared") / F.sqrt(F.col("na") * F.col("nb"))
    return scored.select("a", "b", cosine.alias("cosine")).filter(1 - F.col("cosine") <= threshold + 1e-12)


def merge_concepts(members: DataFrame, threshold: float = 0.1, pairs: DataFrame | None = None) -> DataFrame:
    """Key, concept, new_concept: joined sources move to '+a+b', the concepts' names in order without temporary ones. members: concept, key, source, member."""
    roots = connected(merge_pairs(members, threshold) if pairs is None else pairs)
    named = members.select("concept", "key").distinct().join(roots.withColumnRenamed("node", "key"), "key")
    concepts = F.transform(F.filter(F.array_sort(F.collect_set(F.struct("key", "concept"))), lambda s: ~s["concept"].contains("temp")), lambda s: F.concat(F.lit("+"), s["concept"]))
    merged = named.groupBy("root").agg(F.array_join(concepts, "").alias("new_concept"))
    return named.join(merged, "root").select("key", "concept", "new_concept")


def topic_pairs(scores: DataFrame, threshold: float = 0.34) -> DataFrame:
    """Similar topics, rounded to four places and mirrored. scores: a, b (a <= b), score."""
    kept = scores.filter(F.col("score") >= threshold).select("a", "b", F.round("score", 4).alias("score"))
    return kept.unionAll(kept.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))


def topic_groups(matrix: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Group, topics: linkage over the rows of a topic similarity matrix (a, b, score), for a distance below 1."""
    groups = _groups(matrix.select(F.col("a").alias("id")).distinct(), close_rows(matrix, threshold))
    return groups.groupBy("group").agg(F.sort_array(F.collect_list("id")).alias("topics"))


def two_means(values: DataFrame, rounds: int = 1000) -> DataFrame:
    """K-means with k = 2 on one number: id, value, cluster (0 is the lower one). Each round is one grouped average; a cut that has not settled after so many is an error."""
    low, high = values.agg(F.min("value"), F.max("value")).first()
    if low is None:
        return values.withColumn("cluster", F.lit(None).cast("int"))
    for _ in range(rounds):
        cut = (low + high) / 2
        means = values.agg(F.avg(F.when(F.col("value") <= cut, F.col("value"))), F.avg(F.when(F.col("value") > cut, F.col("value")))).first()
        new = (low if means[0] is None else means[0], high if means[1] is None else means[1])
        if new == (low, high):
            break
        low, high = new
    else:
        raise ArithmeticError("the means did not settle")
    return values.withColumn("cluster", (F.col("value") > (low + high) / 2).cast("int"))


def pooled_tags(scores: DataFrame, tags: DataFrame, threshold: float) -> DataFrame:
    """Dataset, tags: each dataset gets the tags of all tables in the clusters around source attributes it is in. scores: src_dataset, src_attr, tar_dataset, tar_attr, score; tags: dataset, tag."""
    close = scores.filter(F.col("score") > threshold)
    members = close.select("src_dataset", "src_attr", F.col("tar_dataset").alias("dataset")).unionAll(close.select("src_dataset", "src_attr", F.col("src_dataset").alias("dataset"))).distinct()
    pooled = members.join(tags, "dataset").select("src_dataset", "src_attr", "tag").distinct()
    return members.join(pooled, ["src_dataset", "src_attr"]).groupBy("dataset").agg(F.sort_array(F.collect_set("tag")).alias("tags"))


def one_to_one(candidates: DataFrame, every: int = 4) -> DataFrame:
    """Table, choice (map topic -> attribute, null for none): all ways to give each topic one candidate or none without using an attribute twice. candidates: table, topic, attr.

    Folds topic by topic and prunes on the way; the lineage is cut after every `every` topics. As the result lists all
    ways, it grows by the number of candidates with each topic of a table.
    """
    topics = [r[0] for r in candidates.select("topic").distinct().orderBy("topic").collect()]  # the vocabulary of the mapping
    state = candidates.select("table").distinct().withColumn("used", F.array().cast("array<string>")).withColumn("choice", F.array().cast("array<struct<topic:string,attr:string>>"))
    for done, topic in enumerate(topics, 1):
        options = candidates.filter(F.col("topic") == topic).groupBy("table").agg(F.sort_array(F.collect_set("attr")).alias("attrs"))
        joined = state.join(options, "table", "left").withColumn("pick", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("attrs", F.array().cast("array<string>")))))
        free = joined.filter(F.col("pick").isNull() | ~F.array_contains("used", F.col("pick")))
        state = free.select("table", F.when(F.col("pick").isNull(), F.col("used")).otherwise(F.concat("used", F.array("pick"))).alias("used"), F.concat("choice", F.array(F.struct(F.lit(topic).alias("topic"), F.col("pick").alias("attr")))).alias("choice"))
        if done % every == 0:
            state = checkpointed(state)
    return state.select("table", F.map_from_entries("choice").alias("choice"))


def table_topics(choices: DataFrame) -> DataFrame:
    """Table, topic: topics that some choice gives an attribute."""
    entries = choices.select("table", F.explode(F.map_entries("choice")).alias("e"))
    return entries.filter(F.col("e.value").isNotNull()).select("table", F.col("e.key").alias("topic")).distinct()


def running_sections(lines: DataFrame, start: str, end: str) -> DataFrame:
    """File, line_no, value, section of the lines between start and end markers. lines: file, line_no, value. A file of any length is read by many tasks (numbering.running_sums)."""
    marks = {"section": (F.col("value") == start).cast("long"), "ended": (F.col("value") == end).cast("long")}
    marked = running_sums(lines.select("file", "line_no", "value"), "file", "line_no", marks)
    return marked.filter((F.col("section") > F.col("ended")) & (F.col("value") != start)).select("file", "line_no", "value", "section")
