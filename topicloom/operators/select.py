"""Selection from scored pairs (W1-W15). Ties are settled by explicit ordinals, and where those tie too by the other columns, so that no result depends on how rows lie."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions.drawing import Drawing
from topicloom.plans.checkpoints import checkpointed

from .pairs import in_cells


def others(df: DataFrame, *used: str) -> list[Column]:
    """The plain columns of df but for the used ones, in name order: what settles a tie at last."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return [F.col(f"`{f.name}`") for f in sorted(df.schema, key=lambda f: f.name) if f.name not in used and not isinstance(f.dataType, nested)]


def best_per(df: DataFrame, by: list[str], order: str, score: str = "score", above: float | None = None) -> DataFrame:
    """The best row of each group, the first in `order` of equals; only scores above a bound count."""
    scored = df if above is None else df.filter(F.col(score) > above)
    ranked = Window.partitionBy(*by).orderBy(F.desc(score), order, *others(scored, score, order, *by))
    return scored.withColumn("__n", F.row_number().over(ranked)).filter("__n = 1").drop("__n")


def best_attribute(scores: DataFrame) -> DataFrame:
    """Dataset, topic, attribute and score; a topic without any positive score has a null attribute and score 0."""
    found = best_per(scores, ["dataset", "topic"], "ordinal", above=0.0).select("dataset", "topic", "attribute", "score")
    return scores.select("dataset", "topic").distinct().join(found, ["dataset", "topic"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def potential_matches(scores: DataFrame, row: str, column: str, threshold: float = 2.0, least: float = 0.5) -> DataFrame:
    """All columns that reach a row's maximum, if every other is below maximum / threshold (none is: a row of equal scores) or the maximum is at least 0.5."""
    by_row = Window.partitionBy(row)
    top = scores.withColumn("top", F.max("score").over(by_row))
    others = top.withColumn("next", F.max(F.when(F.col("score") < F.col("top"), F.col("score"))).over(by_row))
    fine = (F.col("top") >= least) | F.coalesce(F.col("next") < F.col("top") / threshold, F.lit(True))
    return others.filter((F.col("score") == F.col("top")) & fine).select(row, column, "score")


def fused_weighted(scores: DataFrame, weights: dict[str, float], bound: float = 0.5, most: int = 4) -> DataFrame:
    """By (dataset, attribute, topic) the weighted sum of matcher scores, named after the highest component; over the bound, at most 4 topics of an attribute (equals: the last first). scores: dataset, attribute, topic, ordinal and a column for each matcher."""
    parts = [(F.coalesce(F.col(m), F.lit(0.0)) * w) for m, w in weights.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    names = list(weights)
    top = F.greatest(*parts) if len(parts) > 1 else parts[0]
    name = F.when(parts[0] == top, names[0])
    for m, p in zip(names[1:], parts[1:]):
        name = name.when(p == top, m)
    return _over(scores.withColumn("score", total).withColumn("score_name", name), bound, most)


def fused_winner(scores: DataFrame, first: str, second: str, multiplier: str, bound: float = 0.5, most: int = 4) -> DataFrame:
    """The first matcher's score if it is at least the second's, else the second's times the multiplier, at most 1; bound and number as in W4."""
    s1, s2 = F.col(first), F.col(second)
    score = F.when(s1 >= s2, s1).otherwise(F.least(s2 * F.col(multiplier), F.lit(1.0)))
    return _over(scores.withColumn("score", score).withColumn("score_name", F.when(s1 >= s2, first).otherwise(second)), bound, most)


def _over(scores: DataFrame, bound: float, most: int) -> DataFrame:
    order = Window.partitionBy("dataset", "attribute").orderBy(F.desc("score"), F.desc("ordinal"), "topic", "score_name")
    passing = scores.filter(F.col("score") > bound)
    return passing.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("dataset", "attribute", "topic", "score", "score_name", "rank")


def consumed(scores: DataFrame, keys: list[str], bound: float = 0.5) -> DataFrame:
    """Scores of at least the bound in descending order, the last one of a key winning."""
    order = Window.partitionBy(*keys).orderBy("score", "ordinal", *others(scores, "score", "ordinal", *keys))
    return scores.filter(F.col("score") >= bound).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def top_n(df: DataFrame, score: str, order: str, n: int = 5) -> DataFrame:
    """The n best rows."""
    return df.orderBy(F.desc(score), order).limit(n)


def ranked_by_overlap(contexts: DataFrame) -> DataFrame:
    """Contexts (dataset, name, synset, overlap) ranked by the size of the overlap."""
    return contexts.withColumn("rank", F.row_number().over(Window.partitionBy("dataset", "name").orderBy(F.desc(F.size("overlap")), "synset")))


#: The most tables on each side of a cell of table_mixes, and the topic hits that it counts at once.
CELL_TABLES, CELL_HITS = 1 << 16, 1 << 22


def table_mixes(owned: DataFrame, size: int, positives: int, seed: int = 3) -> DataFrame:
    """For each guiding table, one that shares a topic with another, its k best overlapping tables (equals: the smaller first) and size - k others that share none, drawn by the MD5 of seed:a:b. owned: item, topic.

    Tables are dealt into blocks, and each pair of blocks is a cell: one task that counts overlaps and draws among its
    own pairs, and passes on at most `size` rows for each of its guides. No pair is shuffled or stored. Every pair is
    hashed, so the work grows with the square of the number of tables.
    """
    spark, drawn = owned.sparkSession, size - positives
    lists = checkpointed(owned.filter("item IS NOT NULL").groupBy("item").agg(F.collect_set("topic").alias("topics")).withColumn("name", F.col("item").cast("string")))
    n, cores = lists.count(), spark.sparkContext.defaultParallelism
    j = max(1, -(-n // CELL_TABLES))
    i = min(max(j, -(-3 * cores // j)), max(1, n))
    kind = lists.schema["item"].dataType.simpleString()
    cells = in_cells(lists, lists, ("item", "item"), i, j, lambda left, right: _cell(left, right, positives, drawn, seed), f"a {kind}, b {kind}, shared long, digest string")
    order = Window.partitionBy("a", F.col("digest").isNull()).orderBy(F.desc("shared"), "digest", "b")
    ranked = cells.withColumn("n", F.row_number().over(order)).withColumn("guide", F.max("shared").over(Window.partitionBy("a")) > 0)
    positive = F.col("digest").isNull()
    return ranked.filter(F.col("guide") & (F.col("n") <= F.when(positive, positives).otherwise(drawn))).select("a", "b", positive.alias("positive"))


def _cell(left: pa.Table, right: pa.Table, positives: int, drawn: int, seed: int) -> pa.Table:
    """Of each table of left the `positives` best overlapping ones of right, and the `drawn` first of those that share nothing."""
    right = right.sort_by("item")  # places in right are in the order of items
    n, m = right.num_rows, left.num_rows
    sizes = [np.asarray(pc.list_value_length(x.column("topics")).fill_null(0)) for x in (left, right)]
    flat = [pc.list_flatten(x.column("topics")) for x in (left, right)]
    codes = pa.chunked_array([c for x in flat for c in x.chunks], flat[0].type).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    mine, theirs = codes[: len(flat[0])], codes[len(flat[0]) :]
    by_topic = np.argsort(theirs, kind="stable")
    holder, many = np.repeat(np.arange(n), sizes[1])[by_topic], np.bincount(theirs, minlength=int(codes.max(initial=0)) + 1)
    first = np.cumsum(many) - many
    self_ = np.asarray(pc.index_in(left.column("item"), right.column("item").combine_chunks()).fill_null(-1))
    names, draw = left.column("name").to_pylist(), Drawing(right.column("name").to_pylist())
    at, hits = np.concatenate([[0], np.cumsum(sizes[0])]), np.concatenate([[0], np.cumsum(many[mine])])  # by table; by topic
    out_a, out_b, out_n, out_d, start = [], [], [], [], 0
    while start < m:
        stop = max(start + 1, int(np.searchsorted(hits[at], hits[at[start]] + CELL_HITS, "right")) - 1)
        stop = min(stop, m)
        own = mine[at[start] : at[stop]]
        k = many[own]
        met = holder[np.repeat(first[own] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
        who = np.repeat(np.repeat(np.arange(stop - start), sizes[0][start:stop]), k)
        pair, shared = np.unique(who * n + met, return_counts=True)
        who, met = pair // n, pair % n
        others = met != self_[start:stop][who]
        who, met, shared = who[others], met[others], shared[others]
        best = np.lexsort((met, -shared, who))
        begins = np.searchsorted(who, np.arange(stop - start + 1))
        best = best[np.arange(len(best)) - begins[who[best]] < positives]
        out_a.append(who[best] + start), out_b.append(met[best]), out_n.append(shared[best]), out_d.append([None] * len(best))
        for x in range(start, stop):
            free = np.ones(n, bool)
            free[met[begins[x - start] : begins[x - start + 1]]] = False
            if self_[x] >= 0:
                free[self_[x]] = False
            place, digests = draw.first(f"{seed}:{names[x]}:".encode(), free, drawn)
            out_a.append(np.full(len(place), x)), out_b.append(place), out_n.append(np.zeros(len(place), np.int64)), out_d.append(digests)
        start = stop
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)
    return pa.table({"a": left.column("item").take(pa.array(join(out_a))), "b": right.column("item").take(pa.array(join(out_b))), "shared": pa.array(join(out_n)), "digest": pa.array([d for own in out_d for d in own], pa.string())})
