"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of every text (character classes, word lengths, repetition, lines) are computed in one pass. From a
bounded sample of labelled rows, small trees are boosted; each path from a root to a node is a rule, a conjunction of
thresholds. A lasso logistic regression weighs the rules and sets most to zero. The rest are compiled into one Spark
column expression over the statistics, the score.

The sample: labelled rows that are not held out (crc32 of the id as text mod 5 is not 0), in hash order of the id, at
most `sample_rows`; it alone is broadcast and fitted on the driver. Of an id with several labels the lowest counts.
Null labels and rows with a null id are no examples. Without examples of both labels every text scores the share of
label 1 (0.5 without any). Empty and null texts have statistics of zero and are scored like others. Repeated rows are
scored alike. An empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, col, id_and_text, packed, small_batches, table, unpacked

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5
STATISTICS = [
    "log_bytes", "upper", "lower", "digit", "sign", "space", "non_ascii", "hash_percent", "dollar_star", "bang", "pipe", "dot_comma",
    "log_words", "word_bytes", "longest_word", "distinct_words", "repeated_next", "shouted_words", "signed_words", "log_lines", "line_bytes", "repeated_lines", "short_lines",
]
_END_SIGNS = frozenset(b"#%&$*!|")


def statistics(text: bytes) -> list[float]:
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    m = max(1, len(words))
    distinct = len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:]))
    shouted = sum(w.isupper() and len(w) > 1 for w in words)
    signed = sum(w[-1] in _END_SIGNS for w in words)
    size = sum(map(len, words))
    k = max(1, len(lines))
    upper, lower, digit, space = int(c[65:91].sum()), int(c[97:123].sum()), int(c[48:58].sum()), int(c[9:14].sum() + c[32])
    return [
        np.log1p(n), upper / n, lower / n, digit / n, (int(c[33:127].sum()) - upper - lower - digit) / n, space / n, int(c[128:].sum()) / n, int(c[35] + c[37] + c[38]) / n, int(c[36] + c[42]) / n, int(c[33]) / n, int(c[124]) / n, int(c[46] + c[44]) / n,
        np.log1p(len(words)), size / m, max(map(len, words), default=0), distinct / m, again / m, shouted / m, signed / m, np.log1p(len(lines)), n / k, 1 - len(set(lines)) / k, sum(len(x) < 20 for x in lines) / k,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS for rows (doc_id, text)."""

    def compute(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_columns(b.column("text"))], ["doc_id", *STATISTICS])

    return docs.select("doc_id", "text").mapInArrow(compute, T.StructType([T.StructField("doc_id", T.LongType()), *_FIELDS]))


_FIELDS = [T.StructField(x, T.DoubleType()) for x in STATISTICS]


def _columns(texts: pa.Array) -> list[pa.Array]:
    values = np.array([statistics(t) for t in bytes_of(texts)], float).reshape(-1, len(STATISTICS))
    return [pa.array(np.ascontiguousarray(values[:, k])) for k in range(len(STATISTICS))]


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether above, threshold), and its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, t in self.terms:
            out &= (x[:, k] > t) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, above, t in self.terms:
            out = out & ((F.col(STATISTICS[k]) > t) if above else (F.col(STATISTICS[k]) <= t))
        return F.when(out, self.weight).otherwise(0.0)


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((r.weight * r.holds(x) for r in self.rules), np.zeros(len(x))))))

    def column(self) -> Column:
        """The score as a Spark expression over STATISTICS."""
        total = F.lit(self.intercept)
        for r in self.rules:
            total = total + r.column()
        return 1.0 / (1.0 + F.exp(-total))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, depth: int, path: tuple, paths: list) -> list[tuple[np.ndarray, float]]:
    """Leaves (rows, value) of a tree that fits gradients; every node's path goes to paths."""
    if path:
        paths.append(path)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 20:
        for k, points in enumerate(cuts):
            if not len(points):
                continue
            place = np.searchsorted(points, x[rows, k], "left")  # rows with place <= i are not above points[i]
            gs, hs, ns = (np.bincount(place, w, len(points) + 1).cumsum()[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            gain[(ns < 5) | (len(rows) - ns < 5)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], k, float(points[i]))
    if best[1] is None:
        return [(rows, -total_g / (total_h + 1))]
    _, k, t = best
    above = x[rows, k] > t
    return [leaf for side in (False, True) for leaf in _grow(x, g, h, cuts, rows[above == side], depth - 1, (*path, (k, side, t)), paths)]


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, seed: int = 5) -> list[Rule]:
    """The distinct paths of boosted trees, each on half of the rows."""
    rng, paths = np.random.default_rng(seed), []
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 49))) for k in range(x.shape[1])]
    margin = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.permutation(len(y))[: max(2, len(y) // 2)])
        own: list = []
        leaves = _grow(x, p - y, p * (1 - p), cuts, rows, depth, (), own)
        paths += own
        for terms, value in zip([q for q in own if not any(o != q and o[: len(q)] == q for o in own)], [v for _, v in leaves]):
            margin = margin + rate * value * Rule(terms).holds(x)
    return [Rule(p) for p in dict.fromkeys(paths)]


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient steps."""
    n, m = z.shape
    mean = z.mean(axis=0)
    z = z - mean
    step = 4 * n / max(1e-9, np.linalg.norm(z, 2) ** 2 + n)
    w, b, v, c, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        w2 = v - step * (z.T @ r) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = c - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b - float(mean @ w), w


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> RuleEnsemble:
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return RuleEnsemble(float(np.log((share + 1e-6) / (1 - share + 1e-6))), ())
    rules = extract_rules(x, y)
    held = np.column_stack([r.holds(x) for r in rules]).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    b, w = lasso_logistic(held, y.astype(np.float32), penalty)
    return RuleEnsemble(float(b), tuple(Rule(r.terms, float(v)) for r, v in zip(rules, w) if v))


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, label_col: str = "quality") -> RuleEnsemble:
    """docs: doc_id, text; labels: doc_id and the label."""
    known = labels.select(col("doc_id").cast("long").alias("doc_id"), col(label_col).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = docs.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")  # at most sample_rows ids
    seen = with_statistics(chosen).dropDuplicates(["doc_id"]).join(sample, "doc_id").orderBy("doc_id").toPandas()  # at most sample_rows rows
    return fit(seen[STATISTICS].to_numpy(float), seen["label"].to_numpy(float))


def score_quality(df: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for every row of df."""
    return with_statistics(id_and_text(df, id_col, text_col)).select("doc_id", model.column().alias("score"))


def keep_good(df: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, that score at least the threshold."""
    small_batches(df.sparkSession)
    carried = df.select(packed(df, "row"))
    text = f"c{df.columns.index(text_col)}"

    def compute(batches):
        for b in batches:
            row = b.column("row")
            yield pa.RecordBatch.from_arrays([row, *_columns(row.field(text).cast(pa.string()))], ["row", *STATISTICS])

    marked = carried.mapInArrow(compute, T.StructType([carried.schema["row"], *_FIELDS]))
    return marked.filter(model.column() >= threshold).select(*unpacked("row", df.columns))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train(id_and_text(docs, "doc_id", "text"), table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
