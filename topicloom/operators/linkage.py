"""Single linkage at any size (C1-C3, K10): spanning forests merged along a tree, the inconsistent cut replayed from them, and exact range joins by cosine distance."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.plans.checkpoints import checkpointed

from .pairs import salted_join

#: Edges that one task spans at a time.
BLOCK_EDGES = 1 << 18


def forest(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges (first[k], second[k]) between n nodes, taken in order, join two trees."""
    root, taken = list(range(n)), np.zeros(len(first), bool)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, (i, j) in enumerate(zip(first.tolist(), second.tolist())):
        a, b = top(i), top(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            taken[k] = True
    return taken


def inconsistent_cut(n: int, edges: list[tuple[float, int, int]], threshold: float) -> np.ndarray:
    """Flat clusters of n nodes from the n - 1 edges (height, i, j) of their minimum spanning tree: a merge and all below it stay together if their inconsistency over two levels is at most the threshold. Numbered from 1 by smallest member.

    Edges are replayed by height, then i, then j; nothing but the tree is needed.
    """
    root = list(range(n))
    merge_of: list[int | None] = [None] * n  # the last merge of the tree with this root
    height, most = [], []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first, second = [], []
    for h, i, j in sorted(edges):
        a, b = top(i), top(j)
        below = [m for m in (merge_of[a], merge_of[b]) if m is not None]
        heights = [h, *(height[m] for m in below)]
        mean = sum(heights) / len(heights)
        spread = math.sqrt(sum((x - mean) ** 2 for x in heights) / (len(heights) - 1)) if len(heights) > 1 else 0.0
        own = (h - mean) / spread if spread > 0 else 0.0
        height.append(h)
        most.append(max([own, *(most[m] for m in below)]))
        first.append(i)
        second.append(j)
        root[max(a, b)] = min(a, b)
        merge_of[min(a, b)] = len(height) - 1
    # A merge that stays together has only such below it, so its edges join its members.
    together = list(range(n))

    def same(i: int) -> int:
        while together[i] != i:
            together[i] = together[together[i]]
            i = together[i]
        return i

    for k, (i, j) in enumerate(zip(first, second)):
        if most[k] <= threshold:
            a, b = same(i), same(j)
            together[max(a, b)] = min(a, b)
    return np.unique([same(i) for i in range(n)], return_inverse=True)[1] + 1


def inconsistent_groups(distance: np.ndarray, threshold: float) -> np.ndarray:
    """C2 from a whole matrix of distances, for small sets."""
    n = len(distance)
    if n < 2:
        return np.ones(n, int)
    i, j = np.triu_indices(n, 1)
    order = np.lexsort((j, i, distance[i, j]))
    i, j = i[order], j[order]
    kept = forest(i, j, n)
    return inconsistent_cut(n, list(zip(distance[i, j][kept].tolist(), i[kept].tolist(), j[kept].tolist())), threshold)


def _nodes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct names in ascending order, and the edges as places in them."""
    names = np.unique(np.array(a.to_pylist() + [x for x in b.to_pylist() if x is not None], object))
    place = {x: k for k, x in enumerate(names.tolist())}
    return names, np.array([place[x] for x in a.to_pylist()], np.int64), np.array([place.get(x, -1) for x in b.to_pylist()], np.int64)


def spanning_forest(edges: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """group, a, b, w: the edges (group, a, b, w) of each group's minimum spanning forest, ties by a and then b.

    A group's edges are dealt into parts, each part keeps its own forest, and what is left is dealt again: an edge that
    some part leaves out is the heaviest of a cycle, so the forest of the remainder is that of all. After some rounds a
    group is one part, of at most its number of nodes in edges; no matrix is built.
    """

    def span(table: pa.Table) -> pa.Table:
        names, i, j = _nodes(table.column("a"), table.column("b"))
        order = np.lexsort((j, i, table.column("w").to_numpy()))
        kept = order[forest(i[order], j[order], len(names))]
        return table.take(pa.array(np.sort(kept)))

    edges = checkpointed(edges.select("group", "a", "b", "w"))
    while True:
        sizes = edges.groupBy("group").agg(F.count("*").alias("m"))
        most = sizes.agg(F.max("m")).first()[0] or 0
        parts = -(-most // block_edges)
        part = F.pmod(F.xxhash64("a", "b"), F.lit(max(1, parts)))
        kept = checkpointed(edges.withColumn("part", part).groupBy("group", "part").applyInArrow(lambda table: span(table.drop(["part"])), edges.schema))
        left = kept.count() if parts > 1 else 0
        if parts <= 1:
            return kept
        if left > 0.7 * edges.count():  # trees as large as a part: wider parts are needed, of some edges for each node
            block_edges *= 2
        edges = kept


def split_parts(keys: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """concept, key, part: the inconsistent cut of each concept's sources. keys: concept, key; edges: concept, a, b, w of the sources that share members, all others being 1 apart.

    A concept's tree, one edge for each source, is replayed in one task. Trees that share nothing are joined at 1 (at 0
    if the threshold is 1 or more), the first source's with the others' smallest.
    """
    apart = 1.0 if threshold < 1 else 0.0
    tree = spanning_forest(edges.withColumnRenamed("concept", "group"))
    rows = tree.withColumnRenamed("group", "concept").unionByName(keys.select("concept", F.col("key").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("w")))

    def cut(table: pa.Table) -> pa.Table:
        names, i, j = _nodes(table.column("a"), table.column("b"))
        real, w = j >= 0, table.column("w").to_numpy()
        i, j, w = i[real], j[real], w[real]
        root = np.arange(len(names))
        while True:  # the smallest node of each tree
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            low = low[low]
            if (low == root).all():
                break
            root = low
        others = np.unique(root)[1:]
        found = inconsistent_cut(len(names), [*zip(w.tolist(), i.tolist(), j.tolist()), *((apart, 0, int(k)) for k in others)], threshold)
        return pa.table({"concept": pa.array([table.column("concept")[0].as_py()] * len(names), pa.string()), "key": pa.array(names.tolist(), pa.string()), "part": pa.array(found.astype(np.int32))})

    return rows.groupBy("concept").applyInArrow(cut, "concept string, key string, part int")


#: Cells of the range join have so many rows at most on a side of a task.
CELL_ROWS = 2048


def close_vectors(features: DataFrame, threshold: float, pivots: int = 48, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) that join all vectors (id, vec) whose cosine distance is at most the threshold to the same components as all close pairs would.

    Equal vectors are compared once. Angles obey the triangle inequality: with the angle t of the threshold, a vector
    at angle x from a pivot can only be close to vectors of that pivot's cell if x is at most the cell's largest angle
    and t, and within the cell only to vectors whose angle to the pivot is within t of x. So each vector lives in the
    cell of its nearest pivot, in a band of angles, and visits the bands it may reach of its own and lower cells; other
    cells and bands are never compared. A full band is cut into blocks on both sides. Links come as stars, one for each
    component of a task, so an all-alike group gives no pairs.

    Vectors without length are close to none; `pivots` distinct vectors are drawn by hash and sent to all tasks.
    """
    unit = features.select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec")).filter(F.exists("vec", lambda x: x != 0))
    once = checkpointed(unit.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    equal = unit.join(once.filter("n > 1").select("vec", F.col("id").alias("first")), "vec").filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    drawn = [r[0] for r in once.orderBy(F.xxhash64("vec")).limit(pivots).select("vec").collect()]
    links = once.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    if not drawn:
        return links
    centre = np.array(drawn)
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    reach = math.acos(max(-1.0, min(1.0, 1 - threshold))) + 1e-9
    kind = features.schema["id"].dataType

    def angles(b: pa.RecordBatch) -> np.ndarray:
        x = np.array(b.column("vec").to_pylist()).reshape(b.num_rows, -1)
        return np.arccos(np.clip(x / np.linalg.norm(x, axis=1, keepdims=True) @ centre.T, -1, 1))

    def home(batches):
        for b in batches:
            if b.num_rows:
                all_ = angles(b)
                cell = all_.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(cell.astype(np.int32)), pa.array(all_[np.arange(len(cell)), cell])], ["id", "vec", "cell", "angle"])

    id_type = kind.simpleString()
    homes = checkpointed(once.select("id", "vec").mapInArrow(home, f"id {id_type}, vec array<double>, cell int, angle double"))
    radius = {r[0]: r[1] for r in homes.groupBy("cell").agg(F.max("angle")).collect()}  # a number for each pivot

    width = max(reach, 1e-3)

    def visits(batches):
        """Each vector once for each band that it may reach, its own first."""
        for b in batches:
            if not b.num_rows:
                continue
            all_, cell = angles(b), b.column("cell").to_numpy()
            rows, cells, bands = [], [], []
            for c, r in radius.items():
                near = np.nonzero((all_[:, c] <= r + reach + 1e-9) & (cell >= c))[0]
                low, high = np.floor(np.maximum(all_[near, c] - reach - 1e-9, 0) / width), np.floor(np.minimum(all_[near, c] + reach + 1e-9, r) / width)
                many = np.maximum(high - low + 1, 0).astype(np.int64)
                rows.append(np.repeat(near, many))
                cells.append(np.full(int(many.sum()), c))
                bands.append(np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
            row = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), b.column("vec").take(pa.array(row)), pa.array(np.concatenate(cells).astype(np.int32)), pa.array(np.concatenate(bands).astype(np.int32))], ["id", "vec", "cell", "band"])

    targets = homes.select("id", "vec", "cell", F.floor(F.col("angle") / width).cast("int").alias("band"))
    guests = homes.mapInArrow(visits, f"id {id_type}, vec array<double>, cell int, band int")
    keys = ["cell", "band"]
    sizes = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / cell_rows).cast("int").alias(name))
    guests = checkpointed(guests)
    grid = F.broadcast(sizes(targets, "rows").join(sizes(guests, "columns"), keys))  # a row for each pivot and band
    block = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = targets.join(grid, keys).withColumn("i", block(F.col("rows"))).withColumn("j", every("columns")).withColumn("guest", F.lit(False))
    come = guests.join(grid, keys).withColumn("j", block(F.col("columns"))).withColumn("i", every("rows")).withColumn("guest", F.lit(True))

    def link(table: pa.Table) -> pa.Table:
        guest = table.column("guest").to_numpy()
        x = np.array(table.column("vec").to_pylist())
        size = np.linalg.norm(x, axis=1)
        mine, theirs = np.nonzero(~guest)[0], np.nonzero(guest)[0]
        p, q = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for start in range(0, len(mine), 512):
            one = mine[start : start + 512]
            distance = 1 - (x[one] @ x[theirs].T) / (size[one, None] * size[None, theirs])
            i, j = np.nonzero(distance <= threshold + 1e-9)
            doubtful = np.abs(distance[i, j] - threshold) <= 1e-9  # settled as the column function does
            good = np.ones(len(i), bool)
            for k in np.nonzero(doubtful)[0].tolist():
                u, v = x[one[i[k]]].tolist(), x[theirs[j[k]]].tolist()
                dot = lambda a, b: sum(s * t for s, t in zip(a, b))
                good[k] = 1 - dot(u, v) / (math.sqrt(dot(u, u)) * math.sqrt(dot(v, v))) <= threshold
            p.append(one[i[good]])
            q.append(theirs[j[good]])
        names, number = np.unique(np.array(table.column("id").to_pylist(), object), return_inverse=True)
        p, q = number[np.concatenate(p)], number[np.concatenate(q)]
        kept = forest(p, q, len(names))
        return pa.table({"a": pa.array(names[p[kept]].tolist(), table.schema.field("id").type), "b": pa.array(names[q[kept]].tolist(), table.schema.field("id").type)})

    met = own.unionByName(come).select("cell", "band", "i", "j", "guest", "id", "vec")
    found = met.groupBy("cell", "band", "i", "j").applyInArrow(link, f"a {id_type}, b {id_type}")
    return equal.unionByName(found)


def close_rows(matrix: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of the rows of a sparse matrix (a, b, score) within a cosine distance below 1: rows that share no column are 1 apart, so only those that meet in one are summed up."""
    if threshold >= 1:
        raise ValueError("at 1 and more all rows are close")
    cells = matrix.filter(F.col("score") != 0).groupBy("a", "b").agg(F.sum("score").alias("score"))
    norms = cells.groupBy("a").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    x, y = cells.select(F.col("a").alias("p"), "b", F.col("score").alias("x")), cells.select(F.col("a").alias("q"), "b", F.col("score").alias("y"))
    dots = salted_join(x, y, ["b"]).filter("p < q").groupBy("p", "q").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    both = dots.join(norms.select(F.col("a").alias("p"), F.col("norm").alias("np")), "p").join(norms.select(F.col("a").alias("q"), F.col("norm").alias("nq")), "q")
    return both.filter(1 - F.col("dot") / (F.col("np") * F.col("nq")) <= threshold + 1e-12).select(F.col("p").alias("a"), F.col("q").alias("b"))
