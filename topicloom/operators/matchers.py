"""Pairwise matchers (M2-M5, M16-M18, M22, M26-M28, M31, M34) in long form: one row for each pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.similarity import array_cosine, character_cosine, composite, name_similarity
from topicloom.functions.text import is_int
from topicloom.plans.checkpoints import checkpointed

from .names import similar_names
from .pairs import all_pairs, in_cells, salted_join
from .profile import head_limit, head_sample, term_frequencies

#: Pairs of items that a task of shared_topics writes.
TASK_PAIRS = 1 << 21


def name_matrix(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """M2, M3: left x right with `score`, the 2-gram similarity of two name columns (argument order kept)."""
    return all_pairs(left, right).withColumn("score", name_similarity(F.col(left_name), F.col(right_name)))


def value_matrix_simple(source: DataFrame, target: DataFrame) -> DataFrame:
    """M4: sums of the similarities of all value pairs of two columns; 'None' and null count 0."""
    left = source.select(F.col("attr").alias("src_attr"), F.col("value").alias("u")).groupBy("src_attr", "u").agg(F.count("*").alias("nu"))
    right = target.select(F.col("attr").alias("tar_attr"), F.col("value").alias("v")).groupBy("tar_attr", "v").agg(F.count("*").alias("nv"))
    none = F.coalesce(F.col("u"), F.lit("None")).eqNullSafe("None") | F.coalesce(F.col("v"), F.lit("None")).eqNullSafe("None")
    pairs = all_pairs(left, right)
    scored = pairs.filter(~none).withColumn("s", name_similarity(F.col("u"), F.col("v")) * F.col("nu") * F.col("nv"))
    sums = scored.groupBy("src_attr", "tar_attr").agg(F.sum("s").alias("score"))
    return _filled(source, target, sums)


def _filled(source: DataFrame, target: DataFrame, sums: DataFrame) -> DataFrame:
    every = all_pairs(source.select(F.col("attr").alias("src_attr")).distinct(), target.select(F.col("attr").alias("tar_attr")).distinct())
    return every.join(sums, ["src_attr", "tar_attr"], "left").select("src_attr", "tar_attr", F.coalesce("score", F.lit(0.0)).alias("score"))


def instance_matrix(source: DataFrame, target: DataFrame, stats: DataFrame, threshold: float = 0.6, ratio: float = 0.01, least: int = 10, most: int = 100) -> DataFrame:
    """M5: src_attr, tar_attr, score over sampled values (attr, ordinal, value).

    Value pairs count if neither is 'None', both or neither are integers, and their similarity passes the threshold;
    each adds similarity times the target value's count in its column. Equal pairs are compared once and multiplied, and
    only values that share enough bigrams are (names.similar_names).
    """

    def side(df: DataFrame, attr: str, value: str, n: str) -> DataFrame:
        sampled = head_sample(df, ["attr"], "ordinal", ratio, least, most)
        kept = sampled.filter(F.col("value").isNotNull() & (F.col("value") != "None"))
        return kept.groupBy(F.col("attr").alias(attr), F.col("value").alias(value)).agg(F.count("*").alias(n)).withColumn("ints", is_int(F.col(value)))

    counted = side(target, "tar_attr", "v", "nv").join(stats.select(F.col("attr").alias("tar_attr"), F.col("value").alias("v"), "cnt"), ["tar_attr", "v"])
    alike = similar_names(side(source, "src_attr", "u", "nu").select(F.col("u").alias("a")), counted.select(F.col("v").alias("b")), threshold).select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("score").alias("s"))
    hits = alike.filter(is_int(F.col("u")) == is_int(F.col("v"))).join(side(source, "src_attr", "u", "nu").drop("ints"), "u").join(counted.drop("ints"), "v")
    sums = hits.groupBy("src_attr", "tar_attr").agg(F.sum(F.col("s") * F.col("cnt") * F.col("nu") * F.col("nv")).alias("score"))
    return _filled(source, target, sums)


def confidence(rows_source: int, rows_target: int, ratio: float = 0.01, least: int = 10, most: int = 100) -> float:
    """The share of value pairs that a head sample compares; 0 without rows."""
    if not rows_source * rows_target:
        return 0.0
    taken = [min(max(int(ratio * n), least), most) for n in (rows_source, rows_target)]
    return taken[0] * taken[1] / (rows_source * rows_target)


def confidence_column(rows_source: Column, rows_target: Column, ratio: float = 0.01, least: int = 10, most: int = 100) -> Column:
    """A17 for columns of row counts."""
    taken = head_limit(rows_source, ratio, least, most) * head_limit(rows_target, ratio, least, most)
    return F.when(rows_source * rows_target > 0, taken / (rows_source * rows_target)).otherwise(0.0)


def document_cosine(left: DataFrame, right: DataFrame, factor: float = 2.0) -> DataFrame:
    """left_id, right_id, score: cosine of term frequencies; shared words count `factor` times in both.

    Only pairs that share a word have rows. Words meet by an equi-join in which common ones are cut into blocks; a
    pair's norm is its documents' own norm plus what the boost of shared words adds, so no vector is laid out.
    """
    a, b = term_frequencies(left, "id", "text"), term_frequencies(right, "id", "text")
    norms = lambda t, name: t.groupBy("id").agg(F.sum(F.col("tf") * F.col("tf")).alias(name))
    shared = salted_join(a.select(F.col("id").alias("left_id"), "word", F.col("tf").alias("x")), b.select(F.col("id").alias("right_id"), "word", F.col("tf").alias("y")), ["word"])
    more = factor * factor - 1
    sums = shared.groupBy("left_id", "right_id").agg((F.sum(F.col("x") * F.col("y")) * factor * factor).alias("dot"), (F.sum(F.col("x") * F.col("x")) * more).alias("dx"), (F.sum(F.col("y") * F.col("y")) * more).alias("dy"))
    joined = sums.join(norms(a, "nx").withColumnRenamed("id", "left_id"), "left_id").join(norms(b, "ny").withColumnRenamed("id", "right_id"), "right_id")
    return joined.select("left_id", "right_id", (F.col("dot") / (F.sqrt(F.col("nx") + F.col("dx")) * F.sqrt(F.col("ny") + F.col("dy")))).alias("score"))


def attribute_graph(attrs: DataFrame) -> DataFrame:
    """Edges (a, b, score) of the complete graph over attributes (id, name), by character cosine."""
    a, b = attrs.select(F.col("id").alias("a"), F.col("name").alias("a_name")), attrs.select(F.col("id").alias("b"), F.col("name").alias("b_name"))
    return all_pairs(a, b).filter("a < b").select("a", "b", character_cosine(F.col("a_name"), F.col("b_name")).alias("score"))


def pre_clusters(source: DataFrame, target: DataFrame, weights: tuple[float, float] = (0.0, 1.0), statistic: DataFrame | None = None) -> DataFrame:
    """Attribute pairs of the same guessed type scored by w0 min(U, 1) + w1 name similarity. `statistic` brings U(src_attr, tar_attr, u)."""
    left = source.select(F.col("attr").alias("src_attr"), F.col("guess"))
    right = target.select(F.col("attr").alias("tar_attr"), F.col("guess"))
    pairs = all_pairs(left, right, ["guess"]).withColumn("name_score", name_similarity(F.col("src_attr"), F.col("tar_attr")))
    pairs = pairs.withColumn("u", F.lit(0.0)) if statistic is None else pairs.join(statistic, ["src_attr", "tar_attr"], "left")
    return pairs.select("src_attr", "tar_attr", (weights[0] * F.least(F.coalesce("u", F.lit(0.0)), F.lit(1.0)) + weights[1] * F.col("name_score")).alias("score"))


def table_scores(frames: DataFrame, gate: float = 0.4) -> DataFrame:
    """The best row of each column in each frame, for datasets whose best score of all passes the gate. frames: dataset, frame, row_topic, row_ordinal, col_topic, score."""
    best = Window.partitionBy("dataset", "frame", "col_topic").orderBy(F.desc("score"), "row_ordinal")
    picked = frames.withColumn("n", F.row_number().over(best)).filter("n = 1")
    passing = frames.groupBy("dataset").agg(F.max("score").alias("top")).filter(F.col("top") > gate)
    return picked.join(passing.select("dataset"), "dataset", "left_semi").select("dataset", "frame", "row_topic", "col_topic", "score")


def shared_topics(pairs: DataFrame, item: str, topic: str, least: int = 1, most: int | None = None) -> DataFrame:
    """Item pairs (a <> b) with the number of topics both have, ranked for each a. Pairs with fewer than `least` shared topics, and all but the best `most` of each a, are left out if that is asked for.

    Items that have the same topics are one class. Classes meet on topics, and each class ranks all items once; its members
    take over that list without themselves. So the pairs of items are only written, never counted, sorted or shuffled.
    """
    own = pairs.select(F.col(item).alias("b"), F.col(topic).alias("topic")).dropna().distinct()
    sets = checkpointed(own.groupBy("b").agg(F.sort_array(F.collect_set("topic")).alias("topics")))
    classes = sets.groupBy("topics").agg(F.min("b").alias("kind"))
    members = checkpointed(sets.join(classes, "topics").select("b", "kind"))
    held = checkpointed(classes.select("kind", F.explode("topics").alias("topic")))
    counts = salted_join(held.withColumnRenamed("kind", "of"), held, ["topic"]).groupBy("of", "kind").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
    order = Window.partitionBy("of").orderBy(F.desc("shared"), "b")
    ranked = counts.join(members, "kind").withColumn("place", F.row_number().over(order))
    if most is not None:
        ranked = ranked.filter(F.col("place") <= most + 1)  # one more, for the member itself
    ranked = checkpointed(ranked)
    self_ = ranked.filter(F.col("kind") == F.col("of")).select(F.col("b").alias("a"), F.col("place").alias("own"))
    lists = ranked.select("of", "b", "shared", "place")
    takers = members.select(F.col("b").alias("a"), F.col("kind").alias("of")).join(self_, "a", "left")
    found = salted_join(lists, takers, ["of"], most_pairs=TASK_PAIRS).filter("a <> b")
    out = found.select("a", "b", "shared", (F.col("place") - F.when(F.col("own") < F.col("place"), 1).otherwise(0)).alias("rank"))
    return out if most is None else out.filter(F.col("rank") <= most)


def combined_scores(first: DataFrame, second: DataFrame, keys: list[str], weights: tuple[float, float] = (0.8, 0.2), parity: bool = False) -> DataFrame:
    """M34, matrix form: composite of two matrices. parity=True gives the first one unchanged, as was observed of the original."""
    joined = first.select(*keys, F.col("score").alias("s1")).join(second.select(*keys, F.col("score").alias("s2")), keys, "full")
    return joined.select(*keys, (F.col("s1") if parity else composite([F.col("s1"), F.col("s2")], list(weights))).alias("score"))


#: The most numbers in a block of items and of queries, and the scores that a task holds at once.
ITEM_NUMBERS, QUERY_NUMBERS, SCORES = 1 << 22, 1 << 20, 1 << 22


def vector_neighbours(queries: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """M9: the k most similar items (id, vec) of each query (query_id, query_vec), itself excluded; equal to nine digits: the smaller id first.

    Blocks of queries and items meet as matrices; a pair of blocks passes on each query's best k alone. Vectors without length,
    with a null or of another number of dimensions have no score.
    """
    usable = lambda df, id_, vec: df.filter(F.col(id_).isNotNull() & F.col(vec).isNotNull() & ~F.exists(vec, F.isnull)).select(id_, F.col(vec).cast("array<double>").alias(vec))
    asked, held = usable(queries, "query_id", "query_vec"), usable(items, "id", "vec")
    cores = items.sparkSession.sparkContext.defaultParallelism
    numbers = lambda df, vec: df.agg(F.coalesce(F.sum(F.size(vec)), F.lit(0))).first()[0]
    i = max(1, -(-numbers(asked, "query_vec") // QUERY_NUMBERS))
    j = max(1, -(-numbers(held, "vec") // ITEM_NUMBERS), -(-3 * cores // i))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (items, "id"))]
    scored = in_cells(asked, held, ("query_id", "id"), i, j, lambda left, right: _nearest(left, right, k), f"query_id {kinds[0]}, id {kinds[1]}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _nearest(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """Of each query the items that may be among its best k: scores from a product of matrices choose, with room for what rounds alike, and are then added up in order like array_cosine."""
    right = right.sort_by("id")  # so that places are in the order of ids
    out_q, out_i, out_s = [], [], []

    def matrices(table: pa.Table, vec: str) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By number of dimensions: places, vectors and lengths, if they have any."""
        sizes = np.asarray(pc.list_value_length(table.column(vec)))
        flat = np.asarray(pc.list_flatten(table.column(vec)), np.float64)
        start, found = np.cumsum(sizes) - sizes, {}
        for n in np.unique(sizes[sizes > 0]):
            places = np.nonzero(sizes == n)[0]
            x = flat[start[places][:, None] + np.arange(n)]
            length = np.sqrt(np.cumsum(x * x, axis=1)[:, -1])  # one after the other, as array_cosine adds
            some = ~(length == 0)
            found[int(n)] = places[some], x[some], length[some]
        return found

    itself = np.asarray(pc.index_in(left.column("query_id"), right.column("id").combine_chunks()).fill_null(-1))
    items = matrices(right, "vec")
    with np.errstate(all="ignore"):
        for n, (asked, q, q_length) in matrices(left, "query_vec").items():
            held, x, x_length = items.get(n, (np.empty(0, np.int64), q[:0], q_length[:0]))
            step = max(1, SCORES // max(1, len(held)))
            for at in range(0, len(asked) if len(held) else 0, step):
                scores = (q[at : at + step] / q_length[at : at + step, None]) @ (x / x_length[:, None]).T
                scores[np.isnan(scores)] = np.inf  # not a number ranks first
                for y, own in enumerate(scores, at):
                    own[held == itself[asked[y]]] = -np.inf
                    bound = np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else -2.0
                    near = np.nonzero((own >= bound - 1e-8) & (own > -np.inf))[0]
                    exact = np.cumsum(q[y] * x[near], axis=1)[:, -1] / (q_length[y] * x_length[near])
                    down = -np.where(np.isnan(exact), np.inf, exact)
                    order = np.lexsort((near, down))
                    first = np.searchsorted(down[order], down[order])  # of equal scores only k matter
                    order = order[np.arange(len(order)) - first < k]
                    out_q.append(np.full(len(order), asked[y])), out_i.append(held[near[order]]), out_s.append(exact[order])
    join = lambda x, kind: np.concatenate([*x, np.empty(0, kind)]).astype(kind)
    return pa.table({"query_id": left.column("query_id").take(pa.array(join(out_q, np.int64))), "id": right.column("id").take(pa.array(join(out_i, np.int64))), "score": pa.array(join(out_s, np.float64))})


def phrase_similarity(left: DataFrame, right: DataFrame, vectors: DataFrame) -> DataFrame:
    """left_id, right_id, score: highest cosine of any single words or adjacent-word pairs that have vectors (word, vec); 0 if none has.

    left and right: id, text.
    """

    def terms(df: DataFrame, id_: str, term: str, vec: str) -> DataFrame:
        words = F.split(F.lower("text"), " ", -1)
        two = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))).otherwise(F.array().cast("array<string>"))
        exploded = df.select(F.col("id").alias(id_), F.explode(F.concat(words, two)).alias("word")).distinct()
        return exploded.join(vectors, "word").select(id_, F.col("word").alias(term), F.col("vec").alias(vec))

    a, b = terms(left, "left_id", "wa", "va"), terms(right, "right_id", "wb", "vb")
    best = all_pairs(a, b).groupBy("left_id", "right_id").agg(F.max(array_cosine(F.col("va"), F.col("vb"))).alias("best"))
    every = all_pairs(left.select(F.col("id").alias("left_id")), right.select(F.col("id").alias("right_id")))
    return every.join(best, ["left_id", "right_id"], "left").select("left_id", "right_id", F.coalesce("best", F.lit(0.0)).alias("score"))
