"""Names that are alike: a join at a threshold of the 2-gram similarity, and the nearest by edit distance, that compare few pairs.

A sound bound for the distance D of names a (m characters) and b (n), as functions.similarity computes it over a table
with a column for each character of b:

* A path through the table enters every column of b. It does so for nothing only on a diagonal whose bigram of b, the
  column's character and the one before, also occurs in a (in the first column: if both names begin alike). Every other
  way into a column costs 0.5 or more; the step that skips a column costs 1 for two of them. So with c columns whose
  bigram occurs in a, D >= (n - c) / 2.
* The last row is m rows below the first, a column moves down by one row at most, and each other step down costs 1. So if
  m > n, D >= (m - n) + (n - c) / 2.

Similarity 1 - D / max(m, n) over t therefore needs c > n - 2 ((1 - t) max(m, n) - max(m - n, 0)). From t = 0.5 on that
is at least one column, so a name meets only names that hold one of its rarest bigrams: of n columns that need c shared
ones, one of any n - c + 1 is among them. Names of one character are compared by place, not by bigrams, and are few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.similarity import bigram_similarity, name_similarity

from .pairs import all_pairs

#: Bits of a name's signature, in words of 64.
WORDS = 4
#: Names with one bigram that meet in one cell; more are dealt into several.
CELL_NAMES = 4096
#: Pairs of a tile.
TILE = 1 << 20


def needed(m, n, threshold: float):
    """How many columns of b (length n) must have a bigram that occurs in a (length m) for a similarity over the threshold: more than this less one."""
    longest, extra = np.maximum(m, n), np.maximum(m - n, 0)
    return np.floor(n - 2 * ((1 - threshold) * longest - extra) - 1e-9).astype(np.int64) + 1


def bigrams(name: str) -> list[str]:
    """One for each column: the first character alone, then pairs of neighbours."""
    return [name[:1], *(name[i : i + 2] for i in range(len(name) - 1))]


def _bigrams(name: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.when(i == 1, F.substring(name, F.lit(1), F.lit(1))).otherwise(F.substring(name, i - 1, F.lit(2))))


class _Coded:
    """Names with the bigrams of their columns as numbers (one row each, -1 behind the end) and as bits."""

    def __init__(self, names: list[str]):
        self.size = np.fromiter(map(len, names), np.int64, len(names))
        codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        before = np.concatenate([np.zeros(1, np.int64), codes[:-1]]) if len(codes) else codes
        start = np.cumsum(self.size) - self.size
        before[start[self.size > 0]] = 0  # the first column
        owner = np.repeat(np.arange(len(names)), self.size)
        self.columns = np.full((len(names), int(self.size.max(initial=0))), -1, np.int64)
        self.columns[owner, np.arange(len(owner)) - start[owner]] = before << 21 | codes
        bit = (before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + codes.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
        flags = np.zeros((len(names), 64 * WORDS), bool)
        flags[owner, (bit % np.uint64(64 * WORDS)).astype(np.int64)] = True
        self.bits = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
        self.more = self.size - flags.sum(axis=1)  # columns that are not told apart by bits


def _candidates(own: _Coded, others: _Coded, early: np.ndarray, threshold: float):
    """Places of pairs with enough shared columns, none of which is among the `early` ones of the right name."""
    step = max(1, TILE // len(own.size))
    for start in range(0, len(others.size), step):
        part = slice(start, start + step)
        shared = others.more[part][None, :] + sum(np.bitwise_count(own.bits[:, w : w + 1] & others.bits[None, part, w]).astype(np.int64) for w in range(WORDS))
        i, j = np.nonzero(shared >= needed(own.size[:, None], others.size[None, part], threshold))
        j += start
        few = max(1, TILE // max(1, own.columns.shape[1] * others.columns.shape[1]))
        for k in range(0, len(i), few):
            x, y = i[k : k + few], j[k : k + few]
            m, n = int(own.size[x].max()), int(others.size[y].max())
            held = (own.columns[x, :m, None] == others.columns[y, None, :n]).any(axis=1) & (others.columns[y, :n] >= 0)
            good = (held.sum(axis=1) >= needed(own.size[x], others.size[y], threshold)) & ~(held & early[y, :n]).any(axis=1)
            if good.any():
                yield x[good], y[good]


def similar_names(left: DataFrame, right: DataFrame, threshold: float, cell_names: int = CELL_NAMES, compared: Accumulator | None = None) -> DataFrame:
    """a, b, score of all pairs of names in left (a) and right (b) whose 2-gram similarity, a before b, is over the threshold.

    Both are counted once, however often a name occurs. Bigrams of very many names are dealt into cells of about
    cell_names on the left, to each of which the right names go, so no task holds all names of a common one. `compared`
    counts the pairs that reach the exact similarity. Null counts as 'None'. Below 0.5 no bound holds and all pairs are
    compared.
    """
    a, b = (df.select(F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c)).distinct() for df, c in ((left, "a"), (right, "b")))
    if threshold < 0.5:
        return all_pairs(a, b).withColumn("score", name_similarity(F.col("a"), F.col("b"))).filter(F.col("score") > threshold)
    short = lambda c: F.length(c) == 1
    # Names of one character: few on one side, and most pairs with them are alike by the definition.
    one = all_pairs(b, a.filter(short("a"))).unionByName(all_pairs(a.filter(F.length("a") > 1), b.filter(short("b"))))
    brief = one.withColumn("score", name_similarity(F.col("a"), F.col("b"))).filter(F.col("score") > threshold).select("a", "b", "score")
    brief = brief.unionByName(a.filter("a = ''").join(b, F.col("a") == F.col("b")).select("a", "b", F.lit(1.0).alias("score")))
    held = a.filter(F.length("a") > 1).select("a", F.explode(F.array_distinct(_bigrams(F.col("a")))).alias("gram"))
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    cells = counts.select("gram", "n", F.ceil(F.col("n") / cell_names).cast("int").alias("cells"))
    # A column's bigram that no left name has cannot be shared: it is rarest and leads to no cell.
    columns = b.filter(F.length("b") > 1).select("b", F.posexplode(_bigrams(F.col("b"))).alias("i", "gram")).join(cells, "gram", "left")
    ordered = columns.groupBy("b").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "i", F.coalesce("cells", F.lit(0)).alias("cells")))).alias("columns"))
    n = F.length("b")
    least = F.floor(n - 2 * (1 - threshold) * n - 1e-9) + 1  # the least over all lengths of a
    early = ordered.select("b", F.slice("columns", F.lit(1), F.greatest(n - least + 1, F.lit(0)).cast("int")).alias("columns"))
    sent = early.select("b", F.posexplode("columns").alias("k", "x"), F.transform("columns", lambda x: x["i"]).alias("places"))
    sent = sent.filter("x.cells > 0").select(F.col("x.gram").alias("gram"), F.explode(F.sequence(F.lit(0), F.col("x.cells") - 1)).alias("cell"), F.lit(True).alias("right"), F.col("b").alias("name"), F.slice("places", F.lit(1), F.col("k")).alias("before"))
    placed = held.join(cells, "gram").select("gram", F.pmod(F.xxhash64("a"), "cells").cast("int").alias("cell"), F.lit(False).alias("right"), F.col("a").alias("name"), F.array().cast("array<int>").alias("before"))
    met = sent.unionByName(placed).withColumn("group", F.pmod(F.xxhash64("gram", "cell"), F.lit(1 << 12)))

    def search(batches):
        """The cells of a partition, one after the other."""
        for cell in _cells(batches):
            own, others = ([x for x, r in zip(cell["name"], cell["right"]) if r == side] for side in (False, True))
            if not own or not others:
                continue
            mine, theirs = _Coded(own), _Coded(others)
            early = np.zeros(theirs.columns.shape, bool)
            for y, places in enumerate(g for g, r in zip(cell["before"], cell["right"]) if r):
                early[y, places] = True
            for x, y in _candidates(mine, theirs, early, threshold):
                if compared is not None:
                    compared.add(len(x))
                p, q = [own[i] for i in x.tolist()], [others[i] for i in y.tolist()]
                score = bigram_similarity(p, q)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(q, pa.string()), pa.array(score, pa.float64())], ["a", "b", "score"]).filter(pa.array(score > threshold))

    dealt = met.repartition("group").sortWithinPartitions("group", "gram", "cell", "right")
    return dealt.drop("group").mapInArrow(search, "a string, b string, score double").unionByName(brief)


def _cells(batches):
    """Lists of the columns of each cell; rows come sorted by cell and may go over the ends of batches."""
    now, held = None, {"name": [], "before": [], "right": []}
    for b in batches:
        for gram, cell, *row in zip(*(b.column(c).to_pylist() for c in ("gram", "cell", "name", "before", "right"))):
            if (gram, cell) != now:
                if held["name"]:
                    yield held
                now, held = (gram, cell), {"name": [], "before": [], "right": []}
            for c, x in zip(held, row):
                held[c].append(x)
    if held["name"]:
        yield held


#: Rows of either side of a task of nearest_names, and characters told apart by its bound.
NEAR_ROWS, KINDS = 2048, 64


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each kind of character occurs in each text (kinds are characters by number), and lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    cell = np.repeat(np.arange(len(texts)), size) * KINDS + codes % KINDS
    return np.bincount(cell, minlength=len(texts) * KINDS).reshape(-1, KINDS).astype(np.int16), size


def edit_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs, by one table of each pair, all pairs at once."""
    pad = max(map(len, [*left, *right]), default=0)
    grid = lambda xs: np.array([np.pad(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.int32), (0, pad - len(x)), constant_values=-1) for x in xs]).reshape(len(xs), pad)
    m, n = (np.fromiter(map(len, xs), np.int64, len(xs)) for xs in (left, right))
    a, b = grid(left), grid(right)
    row = np.tile(np.arange(pad + 1), (len(m), 1))
    out = np.where(m == 0, n, 0)
    out[n == 0] = m[n == 0]
    for i in range(1, pad + 1):
        now = np.empty_like(row)
        now[:, 0] = i
        best = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i - 1 : i] != b))
        # now[j] = min over k <= j of best[k] + (j - k): one running minimum instead of a step for each column
        shifted = np.concatenate([now[:, :1], best], axis=1) - np.arange(pad + 1)
        now = np.minimum.accumulate(shifted, axis=1) + np.arange(pad + 1)
        done = (m == i) & (n > 0)
        out[done] = now[done, n[done]]
        row = now
    return out


def _nearest(names: list[str], known: list[str], k: int):
    """For each name the k known ones nearest by edit distance, ties by name: (places of names, places of known, distances, pairs compared). known comes sorted.

    Two names differ in at least as many edits as either has characters that the other lacks. Known names are compared
    in order of that bound, a few for all open names at a time, until the k-th distance found is below the next bound.
    """
    (x, m), (y, n) = _counted(names), _counted(known)
    bound = np.empty((len(names), len(known)), np.int32)
    for i in range(len(names)):
        more = np.maximum(x[i] - y, 0).sum(axis=1)
        bound[i] = np.maximum(more, more + n - m[i])
    order = np.argsort(bound, axis=1, kind="stable")
    best, open_, at, step, compared = [[] for _ in names], np.arange(len(names)), 0, max(4, 2 * k), 0
    while len(open_) and at < len(known):
        places = order[open_, at : at + step]
        p, q = np.repeat(open_, places.shape[1]), places.ravel()
        compared += len(p)
        for i, j, d in zip(p.tolist(), q.tolist(), edit_distances([names[i] for i in p.tolist()], [known[j] for j in q.tolist()]).tolist()):
            best[i].append((d, j))
        at += step
        going = []
        for i in open_.tolist():
            best[i] = sorted(best[i])[:k]
            if len(best[i]) < k or at < len(known) and bound[i, order[i, at]] <= best[i][-1][0]:
                going.append(i)
        open_ = np.array(going, np.int64)
    found = [(i, j, d) for i, own in enumerate(best) for d, j in own]
    return found, compared


def nearest_names(names: DataFrame, known: DataFrame, k: int, rows: int = NEAR_ROWS, compared: Accumulator | None = None) -> DataFrame:
    """Name, known, distance: for each name the k nearest known names by edit distance, ties by name. `compared` counts the pairs whose distance was computed.

    Both sides are dealt into blocks of about `rows`; a task compares two blocks behind the bound of _nearest and sends
    k rows for each name.
    """
    a, b = names.select("name").distinct(), known.select("known").distinct()
    i, j = (max(1, -(-df.count() // rows)) for df in (a, b))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = a.select(F.col("name").alias("text"), F.lit(False).alias("is_known"), block("name", i).alias("i"), every(j).alias("j"))
    right = b.select(F.col("known").alias("text"), F.lit(True).alias("is_known"), block("known", j).alias("j"), every(i).alias("i"))

    def search(table: pa.Table) -> pa.Table:
        own = [[], []]
        for text, side in zip(table.column("text").to_pylist(), table.column("is_known").to_pylist()):
            own[side].append(text)
        ours, theirs = own[0], sorted(own[1], key=lambda t: t.encode())
        found, pairs = _nearest(ours, theirs, k) if theirs else ([], 0)
        if compared is not None:
            compared.add(pairs)
        return pa.table({"name": pa.array([ours[p] for p, _, _ in found], pa.string()), "known": pa.array([theirs[q] for _, q, _ in found], pa.string()), "distance": pa.array([d for _, _, d in found], pa.int32())})

    met = left.unionByName(right).filter("text IS NOT NULL").groupBy("i", "j").applyInArrow(search, "name string, known string, distance int")
    order = Window.partitionBy("name").orderBy("distance", "known")
    return met.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= k).drop("__n")
