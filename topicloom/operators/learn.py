"""Learned matching by stacking (F1-F14, M32, W12), on pyspark.ml.

A base classifier turns rows (row_id, name, value) into scores (row_id, class, score). The meta-learner fits one
balanced logistic regression for each class on the base scores; its coefficients weigh the classifiers.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.functions.similarity import name_similarity
from topicloom.functions.text import character_features
from topicloom.plans.checkpoints import checkpointed

from .lexicon import path_similarity
from .matchers import phrase_similarity
from .names import nearest_names
from .numbering import with_position
from .pairs import all_pairs
from .profile import hashed_sample, rarest_values


class Classifier(Protocol):
    """what a user brings."""

    def fit(self, rows: DataFrame) -> None: ...

    def predict(self, rows: DataFrame) -> DataFrame: ...


def training_data(tables: dict[str, DataFrame], mapping: DataFrame, sample: int = 100) -> DataFrame:
    """row_id, name, value, class: sampled rows of tables, melted, labelled by mapping (dataset, attr, topic); null values are 'NA'.

    At most `sample` rows of a table, in the order of a hash of all their values; every cell of a row that is taken
    counts, repeated ones too.
    """
    parts = []
    for name, df in tables.items():
        shown = F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])
        taken = df.withColumn("__shown", shown).orderBy(F.xxhash64("__shown"), "__shown").limit(sample)
        placed = taken.withColumn("__row", F.row_number().over(Window.orderBy(F.xxhash64("__shown"), "__shown")))  # of the sample alone
        cells = F.posexplode(F.arrays_zip(F.array(*map(F.lit, df.columns)).alias("attr"), F.col("__shown").alias("value"))).alias("ordinal", "cell")
        parts.append(placed.select(F.lit(name).alias("dataset"), "__row", cells).select("dataset", "__row", "ordinal", "cell.attr", "cell.value"))
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    labelled = cells.join(mapping.select("dataset", "attr", F.col("topic").alias("class")), ["dataset", "attr"])
    return labelled.select(F.xxhash64("dataset", "__row", "ordinal").alias("row_id"), F.col("attr").alias("name"), F.coalesce("value", F.lit("NA")).alias("value"), "class")


def training_frame(stats: DataFrame, k: int = 5) -> DataFrame:
    """dataset, attr, row, value: a column's frame: its name as row 0 and its k rarest values, filled up with the first."""
    values = rarest_values(stats, k)
    return values.select("dataset", "attr", F.posexplode(F.concat(F.array("attr"), "vals")).alias("row", "value"))


def folds(rows: DataFrame, k: int = 2, by: str = "class", order: str = "row_id") -> DataFrame:
    """`fold`: contiguous k-th parts of each class, in order."""
    placed = with_position(rows, by, order, "__pos", "__n")
    small, larger = F.floor(F.col("__n") / k), F.col("__n") % k  # the first `larger` folds have a row more
    early = larger * (small + 1)
    fold = F.when(F.col("__pos") < early, F.floor(F.col("__pos") / (small + 1))).otherwise(larger + F.floor((F.col("__pos") - early) / F.greatest(small, F.lit(1))))
    return placed.withColumn("fold", (fold + 1).cast("int")).drop("__pos", "__n")


def out_of_fold(make, rows: DataFrame, k: int = 2) -> DataFrame:
    """row_id, class, score: each fold scored by a classifier fitted on the others."""
    dealt, parts = folds(rows, k).cache(), []
    for fold in range(1, k + 1):
        model: Classifier = make()
        model.fit(dealt.filter(F.col("fold") != fold).drop("fold"))
        parts.append(model.predict(dealt.filter(F.col("fold") == fold).drop("class", "fold")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class NameClassifier:
    """the 2-gram similarity of the column name and each class; nothing is learned."""

    def fit(self, rows: DataFrame) -> None:
        self.classes = rows.select("class").distinct()

    def predict(self, rows: DataFrame) -> DataFrame:
        names = all_pairs(rows.select("name").distinct(), self.classes).withColumn("score", name_similarity(F.col("name"), F.col("class")))
        return rows.select("row_id", "name").join(names, "name").select("row_id", "class", "score")


class ContextClassifier:
    """Any lookup of scores (name, class, score) made beforehand by a context or vector matcher; 0 where it has none."""

    def __init__(self, scores: DataFrame):
        self.scores = scores

    def fit(self, rows: DataFrame) -> None:
        self.classes = rows.select("class").distinct()

    def predict(self, rows: DataFrame) -> DataFrame:
        every = all_pairs(rows.select("row_id", "name"), self.classes)
        return every.join(self.scores.select("name", "class", "score"), ["name", "class"], "left").select("row_id", "class", F.coalesce("score", F.lit(0.0)).alias("score"))


class WordNetClassifier(ContextClassifier):
    """F8: the highest path similarity of the synsets of a name and of a class. names: name, synset; classes: class, synset; closure as of lexicon.ancestors."""

    def __init__(self, names: DataFrame, classes: DataFrame, closure: DataFrame):
        a, b = names.select("name", F.col("synset").alias("a")).distinct(), classes.select("class", F.col("synset").alias("b")).distinct()
        met = all_pairs(a, b)
        scored = met.join(path_similarity(closure, met.select("a", "b").distinct()), ["a", "b"])
        super().__init__(scored.groupBy("name", "class").agg(F.max("score").alias("score")))


class VectorClassifier(ContextClassifier):
    """the highest cosine of the word vectors (word, vec) of a name and of a class."""

    def __init__(self, names: DataFrame, classes: DataFrame, vectors: DataFrame):
        one = lambda df, c: df.select(F.col(c).alias("id"), F.col(c).alias("text")).distinct()
        scored = phrase_similarity(one(names, "name"), one(classes, "class"), vectors)
        super().__init__(scored.select(F.col("left_id").alias("name"), F.col("right_id").alias("class"), "score"))


class NeighbourClassifier:
    """The three training names nearest by Levenshtein distance vote with a third each."""

    def __init__(self, k: int = 3):
        self.k = k

    def fit(self, rows: DataFrame) -> None:
        self.known = rows.select(F.col("name").alias("known"), "class").distinct()

    def predict(self, rows: DataFrame) -> DataFrame:
        votes = neighbour_votes(rows.select("name").distinct(), self.known, self.k)
        return rows.select("row_id", "name").join(votes, "name").select("row_id", "class", "score")


def neighbour_votes(names: DataFrame, known: DataFrame, k: int = 3) -> DataFrame:
    """name, class, score: 1/k for each of the k nearest (known, class); ties by known and class. The nearest names are found behind a bound (names.nearest_names)."""
    near = Window.partitionBy("name").orderBy("distance", "known", "class")
    entries = nearest_names(names, known, k).join(known.select("known", "class"), "known")  # k names have k entries or more
    voted = entries.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k)
    return voted.groupBy("name", "class").agg((F.count("*") / F.lit(k)).alias("score"))


class _Logistic:
    """A logistic regression over features that a subclass makes of name or value."""

    def features(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit(self, rows: DataFrame) -> None:
        classes = [r[0] for r in rows.select("class").distinct().orderBy("class").collect()]  # the topics
        self.classes = classes
        label = F.array_position(F.array(*map(F.lit, classes)), F.col("class")) - 1
        made = self.features(rows).withColumn("label", label.cast("double"))
        self.model: LogisticRegressionModel = LogisticRegression(maxIter=50, regParam=0.01, family="multinomial").fit(made)

    def predict(self, rows: DataFrame) -> DataFrame:
        scored = self.model.transform(self.features(rows)).withColumn("p", vector_to_array("probability"))
        by_class = F.arrays_zip(F.array(*map(F.lit, self.classes)).alias("class"), F.slice("p", 1, len(self.classes)).alias("score"))
        return scored.select("row_id", F.explode(by_class).alias("s")).select("row_id", "s.class", "s.score")


class CharacterClassifier(_Logistic):
    """counts and shares of kinds of characters of the value."""

    def features(self, rows: DataFrame) -> DataFrame:
        made = {f"f_{k}": c.cast("double") for k, c in character_features(F.col("value")).items()}
        return VectorAssembler(inputCols=list(made), outputCol="features").transform(rows.withColumns(made))


class NgramClassifier(_Logistic):
    """counts of character n-grams (or words) of the value, by vocabulary or by hash."""

    def __init__(self, n: int = 2, words: bool = False, hashed: bool = False, size: int = 200):
        self.n, self.words, self.hashed, self.size, self.counter = n, words, hashed, size, None

    def features(self, rows: DataFrame) -> DataFrame:
        tokens = RegexTokenizer(inputCol="value", outputCol="tokens", pattern=r"\W+" if self.words else "").transform(rows)
        grams = NGram(n=1 if self.words else self.n, inputCol="tokens", outputCol="grams").transform(tokens)
        if self.hashed:
            return HashingTF(numFeatures=self.size, inputCol="grams", outputCol="features").transform(grams)
        if self.counter is None:
            self.counter = CountVectorizer(vocabSize=self.size, inputCol="grams", outputCol="features").fit(grams)
        return self.counter.transform(grams)


def logistic_weights(rows: DataFrame, features: list[str], most_steps: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """class, feature, weight and intercept of one balanced, regularised logistic regression for each class. rows: class, label (0 or 1) and the features.

    Minimises the mean of the weighted losses plus |weights|^2 / 2n (n rows of the class; the intercept is free; rows
    weigh n / 2 of their label's number). All classes are fitted at once: in each Newton step one grouped job sums up
    every class's loss, gradient and Hessian, combined before the shuffle, and the driver solves one small system for
    each class that has not settled. A step that does not lower the loss is halved. Classes with one label get 0.
    """
    spark, k = rows.sparkSession, len(features)
    names = [f"x{i}" for i in range(k)]
    x = [*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(features, names)), F.lit(1.0).alias(f"x{k}")]
    given = checkpointed(rows.select("class", F.col("label").cast("double").alias("y"), *x).groupBy("class", "y", *names, f"x{k}").agg(F.count("*").alias("many")))
    counts = {r["class"]: (r["n"], r["pos"]) for r in given.groupBy("class").agg(F.sum("many").alias("n"), F.sum(F.col("many") * F.col("y")).alias("pos")).collect()}  # a row for each topic
    state = {c: {"beta": np.zeros(k + 1), "step": None, "loss": np.inf} for c, (n, pos) in counts.items() if 0 < pos < n}
    columns = [f"x{i}" for i in range(k + 1)]
    names_ = ["class", "n", "pos", *(f"b{i}" for i in range(k + 1))]
    open_ = set(state)
    for _ in range(most_steps):
        if not open_:
            break
        order = sorted(open_)
        sizes = [[float(counts[c][i]) for c in order] for i in (0, 1)]
        tried = spark.createDataFrame(pa.table([pa.array(order, pa.string()), *map(pa.array, sizes), *(pa.array([float(state[c]["beta"][i]) for c in order]) for i in range(k + 1))], names=names_))  # a local relation, broadcast while it is small
        z = sum((F.col(f"b{i}") * F.col(x) for i, x in enumerate(columns)), F.lit(0.0))
        weighed = given.join(tried, "class").withColumn("z", z).withColumn("p", 1 / (1 + F.exp(-F.col("z")))).withColumn("w", F.col("many") * F.when(F.col("y") == 1, F.col("n") / (2 * F.col("pos"))).otherwise(F.col("n") / (2 * (F.col("n") - F.col("pos")))))
        loss = F.col("w") * (F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("y") * F.col("z"))
        first = [F.sum(F.col("w") * (F.col("p") - F.col("y")) * F.col(x)).alias(f"g{i}") for i, x in enumerate(columns)]
        second = [F.sum(F.col("w") * F.col("p") * (1 - F.col("p")) * F.col(x) * F.col(columns[j])).alias(f"h{i}_{j}") for i, x in enumerate(columns) for j in range(i + 1)]
        for r in weighed.groupBy("class").agg(F.sum(loss).alias("loss"), *first, *second).collect():
            s, n = state[r["class"]], counts[r["class"]][0]
            own = s["beta"].copy()
            own[k] = 0.0
            now = r["loss"] / n + own @ own / (2 * n)
            if now > s["loss"] + 1e-13 and s["step"] is not None:
                s["step"] /= 2
                s["beta"] = s["beta"] - s["step"]  # back by half
                if np.abs(s["step"]).max() < tolerance:
                    open_.discard(r["class"])
                continue
            gradient = np.array([r[f"g{i}"] for i in range(k + 1)]) / n + own / n
            hessian = np.zeros((k + 1, k + 1))
            for i in range(k + 1):
                for j in range(i + 1):
                    hessian[i, j] = hessian[j, i] = r[f"h{i}_{j}"] / n
            hessian[np.arange(k), np.arange(k)] += 1 / n
            step = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            s["loss"], s["step"] = now, step
            if np.abs(step).max() < tolerance:
                open_.discard(r["class"])
            s["beta"] = s["beta"] + step
    if open_:
        raise ArithmeticError(f"the weights of {sorted(open_)[:3]} did not settle")
    done = [(c, f, float(state[c]["beta"][i]) if c in state else 0.0, float(state[c]["beta"][k]) if c in state else 0.0) for c in sorted(counts) for i, f in enumerate(features)]
    return spark.createDataFrame(done, "class string, feature string, weight double, intercept double")


def meta_weights(scores: DataFrame, truth: DataFrame, classifiers: list[str]) -> DataFrame:
    """Class, classifier, weight. scores: row_id, class and a column for each classifier; truth: row_id, class.

    For each class a balanced logistic regression (logistic_weights) tells rows of the class from others by the base
    scores for it.
    """
    own = truth.select("row_id", F.col("class").alias("truth"))
    labelled = scores.join(own, "row_id").withColumn("label", (F.col("class") == F.col("truth")).cast("double"))
    return logistic_weights(labelled, classifiers).select("class", F.col("feature").alias("classifier"), "weight")


def save_weights(weights: DataFrame, path: str) -> None:
    """keeps learned weights (class, classifier, weight) as a table."""
    weights.write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    """weights as they were saved."""
    return spark.read.schema("class string, classifier string, weight double").parquet(path)


def predicted_mapping(rows: DataFrame, scores: DataFrame, weights: DataFrame, most: int = 100) -> DataFrame:
    """Name, class: the best class of each column by the mean over at most 100 rows of weighted scores. scores: row_id, class, classifier, score."""
    taken = hashed_sample(rows.select("row_id", "name"), ["name"], "row_id", most)
    summed = taken.join(scores, "row_id").join(weights, ["class", "classifier"]).groupBy("name", "class", "row_id").agg(F.sum(F.col("score") * F.col("weight")).alias("s"))
    means = summed.groupBy("name", "class").agg(F.avg("s").alias("score"))
    order = Window.partitionBy("name").orderBy(F.desc("score"), "class")
    return means.withColumn("n", F.row_number().over(order)).filter("n = 1").select("name", "class", "score")
