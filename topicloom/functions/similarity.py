"""Similarity of names, values and texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Cells of a row of all tables that are filled together: at most some 8 MB for each of a few arrays.
CELLS = 1 << 20


def _padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), int(size.max()) if len(size) else 0), -1, np.int32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    return out, size


def _distances(left: list[str], right: list[str]) -> np.ndarray:
    """2-gram distances of pairs that both have two characters or more: one table of each pair, all pairs at once."""
    a, m = _padded(left)
    b, n = _padded(right)
    rows = np.arange(len(m))
    row = np.tile(np.arange(a.shape[1] + 1, dtype=float), (len(m), 1))
    last_of_a, end_before = a[rows, m - 1], np.zeros(len(m))
    out = np.empty(len(m))
    for j in range(1, b.shape[1] + 1):
        now = np.empty_like(row)
        end = row[rows, m]
        wrapped = np.where((last_of_a == b[:, j - 2]) if j > 1 else False, 0.5, 1.0)
        now[:, 0] = np.minimum(np.minimum(end_before + 1, row[:, 0] + 1), end + wrapped)
        for i in range(1, a.shape[1] + 1):
            other = (a[:, i - 1] != b[:, j - 1]).astype(float)
            if i == 1 and j == 1:
                cost = other
            else:
                cost = 0.5 * other + 0.5 * ((a[:, i - 2] != b[:, j - 2]) if i > 1 and j > 1 else 1.0)
            now[:, i] = np.minimum(np.minimum(now[:, i - 1] + 1, row[:, i] + 1), row[:, i - 1] + cost)
        done = n == j
        out[done] = now[rows[done], m[done]]
        end_before, row = end, now
    return out / np.maximum(m, n)


def bigram_similarity(left: list[str | None], right: list[str | None]) -> np.ndarray:
    """1 - 2-gram distance of each pair; not symmetric. Null counts as 'None'."""
    a, b = (["None" if x is None else x for x in side] for side in (left, right))
    out = np.empty(len(a))
    tables: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b)):
        if x == y:
            out[i] = 1.0
        elif not x or not y:
            out[i] = 0.0
        elif len(x) < 2 or len(y) < 2:
            out[i] = 1.0 - sum(p == q for p, q in zip(x, y)) / max(len(x), len(y))
        else:
            tables.setdefault((len(x).bit_length(), len(y).bit_length()), []).append(i)
    for (_, longest), rows in tables.items():
        # Of a class's pairs so many at once that the rows of their tables stay within CELLS.
        rows.sort(key=lambda i: len(a[i]))
        step = max(1, CELLS >> max(longest, max(len(a[i]) for i in rows).bit_length()))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            out[part] = 1.0 - _distances([a[i] for i in part], [b[i] for i in part])
    return out


@F.pandas_udf(T.DoubleType())
def _bigram_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    pairs = pd.DataFrame({"a": left, "b": right})
    distinct = pairs.drop_duplicates()
    scores = bigram_similarity(distinct["a"].tolist(), distinct["b"].tolist())
    return pairs.merge(distinct.assign(s=scores), on=["a", "b"], how="left")["s"]


def name_similarity(left: Column, right: Column) -> Column:
    """Vectorised 2-gram similarity for many pairs."""
    return _bigram_udf(F.coalesce(left, F.lit("None")), F.coalesce(right, F.lit("None")))


def name_similarity_native(left: Column, right: Column) -> Column:
    """The same by higher-order functions, for small matrices: no Python on the executors."""
    a, b = F.coalesce(left, F.lit("None")), F.coalesce(right, F.lit("None"))
    m, n = F.length(a), F.length(b)

    def at(text: Column, i: Column) -> Column:
        return F.substring(text, i, F.lit(1))

    def differ(x: Column, y: Column) -> Column:
        return F.when(x == y, F.lit(0.0)).otherwise(F.lit(1.0))

    def next_row(state: Column, j: Column) -> Column:
        row, end = state["row"], F.element_at(state["row"], -1)
        wrapped = F.when((j > 1) & (at(a, m) == at(b, j - 1)), 0.5).otherwise(1.0)
        zero = F.least(state["end"] + 1, F.element_at(row, 1) + 1, end + wrapped)

        def cell(done: Column, i: Column) -> Column:
            here = differ(at(a, i), at(b, j))
            before = F.when((i > 1) & (j > 1), differ(at(a, i - 1), at(b, j - 1))).otherwise(1.0)
            cost = F.when((i == 1) & (j == 1), here).otherwise(0.5 * here + 0.5 * before)
            return F.concat(done, F.array(F.least(F.element_at(done, -1) + 1, F.element_at(row, i + 1) + 1, F.element_at(row, i) + cost)))

        return F.struct(end.alias("end"), F.aggregate(F.sequence(F.lit(1), m), F.array(zero), cell).alias("row"))

    first = F.struct(F.lit(0.0).alias("end"), F.transform(F.sequence(F.lit(0), m), lambda i: i.cast("double")).alias("row"))
    table = F.element_at(F.aggregate(F.sequence(F.lit(1), n), first, next_row)["row"], -1)
    equal = F.aggregate(F.sequence(F.lit(1), F.least(m, n)), F.lit(0.0), lambda s, i: s + 1 - differ(at(a, i), at(b, i)))
    longest = F.greatest(m, n)
    return F.when(a == b, 1.0).when((m == 0) | (n == 0), 0.0).when((m < 2) | (n < 2), 1 - equal / longest).otherwise(1 - table / longest)


def array_cosine(x: Column, y: Column) -> Column:
    """Cosine of two arrays of numbers; null if either has no length."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norms > 0, dot(x, y) / norms)


def character_cosine(left: Column, right: Column) -> Column:
    """Cosine of the character counts of two strings."""

    def counts(text: Column, alphabet: Column) -> Column:
        return F.transform(alphabet, lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))

    alphabet = F.array_distinct(F.filter(F.split(F.concat(left, right), "", -1), lambda c: c != ""))
    return F.coalesce(array_cosine(counts(left, alphabet), counts(right, alphabet)), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def composite(scores: list[Column], weights: list[float], squash: bool = True) -> Column:
    """Weighted mean of the scores that are there, through a sigmoid; null if none is."""
    there = [F.when(s.isNotNull(), F.lit(float(w))).otherwise(0.0) for s, w in zip(scores, weights)]
    total, weight = F.lit(0.0), F.lit(0.0)
    for s, w, t in zip(scores, weights, there):
        total, weight = total + F.coalesce(s, F.lit(0.0)) * t, weight + t
    mean = F.when(weight > 0, total / weight)
    return sigmoid(mean) if squash else mean


#: Matchers that SQL can call, as bodies over their parameters' names; all run inside Spark's own functions.
SQL_MATCHERS = {
    "vector_cosine": ("x ARRAY<DOUBLE>, y ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(x, y, (p, q) -> p * q), 0D, (s, v) -> s + v) / nullif(sqrt(aggregate(x, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(y, 0D, (s, v) -> s + v * v)), 0D)"),
    "character_cosine": (
        "l STRING, r STRING", "DOUBLE",
        "coalesce(vector_cosine(transform(array_distinct(filter(split(concat(l, r), '', -1), c -> c <> '')), c -> CAST(length(l) - length(replace(l, c, '')) AS DOUBLE)), transform(array_distinct(filter(split(concat(l, r), '', -1), c -> c <> '')), c -> CAST(length(r) - length(replace(r, c, '')) AS DOUBLE))), 0D)",
    ),
    "composite_score": ("first DOUBLE, second DOUBLE, w1 DOUBLE, w2 DOUBLE", "DOUBLE", "1D / (1D + exp(-(coalesce(first * w1, 0D) + coalesce(second * w2, 0D)) / nullif(nvl2(first, w1, 0D) + nvl2(second, w2, 0D), 0D)))"),
    "text_cosine": (
        "l STRING, r STRING, boost DOUBLE", "DOUBLE",
        "coalesce(vector_cosine(transform(array_distinct(filter(split(concat(l, ' ', r), ' ', -1), w -> w <> '')), w -> CAST(size(filter(split(l, ' ', -1), v -> v = w)) AS DOUBLE) / nullif(size(filter(split(l, ' ', -1), v -> v <> '')), 0) * if(array_contains(split(l, ' ', -1), w) AND array_contains(split(r, ' ', -1), w), boost, 1D)), transform(array_distinct(filter(split(concat(l, ' ', r), ' ', -1), w -> w <> '')), w -> CAST(size(filter(split(r, ' ', -1), v -> v = w)) AS DOUBLE) / nullif(size(filter(split(r, ' ', -1), v -> v <> '')), 0) * if(array_contains(split(l, ' ', -1), w) AND array_contains(split(r, ' ', -1), w), boost, 1D))), 0D)",
    ),
}


def register_matchers(spark: SparkSession) -> None:
    """Makes matchers callable from SQL: name_similarity(a, b) (M1), vector_cosine(x, y) (M9), character_cosine(l, r) (M22), composite_score(first, second, w1, w2) (M34) and text_cosine(l, r, boost) (M16-M18). All but the first are SQL functions without Python, which the optimiser sees through."""
    spark.udf.register("name_similarity", _bigram_udf)
    for name, (parameters, kind, body) in SQL_MATCHERS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
