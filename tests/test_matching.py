"""Threshold join of names, closures, meetings of contexts, learned weights and transfers, against plain computations."""

import random

import numpy as np
import pytest

from topicloom.functions.similarity import bigram_similarity
from topicloom.operators import kb, learn, lexicon, names


def test_shared_bigrams_bound():
    """No pair over a threshold has fewer shared columns than `needed` says."""
    rng = random.Random(1)
    found = 0
    for letters in ("ab", "abc", "abcde"):
        a, b = ([("".join(rng.choice(letters) for _ in range(rng.randrange(2, 14)))) for _ in range(8000)] for _ in range(2))
        a += b[:500]
        b += [x[:-1] + "b" for x in b[:500]]
        for x, y, score in zip(a, b, bigram_similarity(a, b)):
            own = set(names.bigrams(x))
            shared = sum(g in own for g in names.bigrams(y))
            for t in (0.5, 0.6, 0.7, 0.85, 0.95):
                if score > t:
                    found += 1
                    assert shared >= names.needed(len(x), len(y), t)
    assert found > 3000


def words(rng, n):
    parts = ["park", "school", "road", "id", "name", "type", "zone", "area", "date", "owner", "é1", "b", "", "x", "aa", "aaaa"]
    return ["".join(rng.choice(parts) + rng.choice(["", "_", "s"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)] + [None, "", "a", "b", "ab"]


@pytest.mark.parametrize("threshold,cell,most", [(0.3, 4096, 1.0), (0.5, 4096, 0.5), (0.6, 7, 0.35), (0.85, 4096, 0.08)])
def test_similar_names(spark, threshold, cell, most):
    """The same rows as all pairs, of which only a share is compared; nulls, empty names and names of one character too; cells of few names."""
    rng = random.Random(2)
    a, b = words(rng, 300), words(rng, 350)
    shown = lambda xs: sorted({"None" if x is None else x for x in xs})
    pairs = [(x, y) for x in shown(a) for y in shown(b)]
    want = sorted((x, y, round(float(s), 9)) for (x, y), s in zip(pairs, bigram_similarity(*map(list, zip(*pairs)))) if s > threshold)
    compared = spark.sparkContext.accumulator(0)
    left, right = (spark.createDataFrame([(x,) for x in xs], f"{c} string").repartition(3) for xs, c in ((a, "a"), (b, "b")))
    assert sorted((r["a"], r["b"], round(r["score"], 9)) for r in names.similar_names(left, right, threshold, cell, compared).collect()) == want
    assert compared.value <= most * len(pairs)


def test_similar_names_of_empty_sides(spark):
    some, none = spark.createDataFrame([("park",)], "a string"), spark.createDataFrame([], "b string")
    assert names.similar_names(some, none, 0.6).count() == 0
    assert names.similar_names(none.withColumnRenamed("b", "a"), some.withColumnRenamed("a", "b"), 0.6).count() == 0


def test_ancestors_of_any_depth(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(60)] + [("n0", "n7"), ("x", "n58"), ("x", "y"), ("y", "n60")]
    got = {(r["synset"], r["ancestor"]): r["distance"] for r in lexicon.ancestors(spark.createDataFrame(chain, "child string, parent string").repartition(3)).collect()}
    up = {}
    for c, p in chain:
        up.setdefault(c, set()).add(p)
    want = {}
    for s in {x for e in chain for x in e}:
        front, d = {s}, 0
        while front:
            for x in front:
                want.setdefault((s, x), d)
            front, d = {p for x in front for p in up.get(x, ()) if (s, p) not in want}, d + 1
    assert got == want and max(got.values()) == 59
    with pytest.raises(ValueError):
        lexicon.ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string"))
    assert lexicon.ancestors(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_context_similarity_meets_like_all_pairs(spark):
    rng = random.Random(4)
    tree = spark.createDataFrame([(f"s{i}", f"s{rng.randrange(i)}") for i in range(1, 40)] + [("u1", "u0")], "child string, parent string")
    closure = lexicon.ancestors(tree).cache()
    up = {}
    for r in closure.collect():
        up.setdefault(r["synset"], {})[r["ancestor"]] = r["distance"]
    senses = [f"s{i}" for i in range(40)] + ["u0", "u1", "unknown"]
    side = lambda k: sorted({(f"d{rng.randrange(3)}", f"{k}{rng.randrange(8)}", rng.choice(senses)) for _ in range(60)})
    a, b = side("a"), side("t")
    best = {}
    for own, attribute, x in a:
        for owner, topic, y in b:
            ways = [d + up[y][z] for z, d in up.get(x, {}).items() if z in up.get(y, {})]
            if ways:
                key = (own, attribute, topic)
                best[key] = min(best.get(key, (99,)), (min(ways), own != owner, owner, x, y))
    frame = lambda rows: spark.createDataFrame(rows, "dataset string, name string, synset string").repartition(3)
    got = {(r["dataset"], r["attribute"], r["topic"]): (r["score"], r["owner"], r["a"], r["b"]) for r in lexicon.context_similarity(frame(a), frame(b), closure).collect()}
    assert got == {k: (1 / (1 + v[0]), *v[2:]) for k, v in best.items()}


def test_context_overlap_by_words(spark):
    rng = random.Random(5)
    side = lambda: [(f"n{rng.randrange(6)}", [rng.choice("abcdefgh") for _ in range(rng.randrange(5))]) for _ in range(20)]
    a, b = side(), side()
    want = {}
    for x, v in a:
        for y, w in b:
            want[x, y] = max(want.get((x, y), 0), len(set(v) & set(w)))
    frame = lambda rows: spark.createDataFrame(rows, "name string, overlap array<string>")
    got = {(r["left_name"], r["right_name"]): r["score"] for r in lexicon.context_overlap(frame(a), frame(b)).collect()}
    assert got == want
    assert {r["score"] for r in lexicon.context_overlap(frame(a), frame(b), parity=True).collect()} == {0}


def plain_logistic(x, y, weight, penalty):
    """Newton steps by numpy on one class."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, ridge = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, penalty), 0)
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (weight * (p - y)) / weight.sum() + ridge * beta
        hessian = (x.T * (weight * p * (1 - p))) @ x / weight.sum() + np.diag(ridge)
        beta = beta - 0.5 * np.linalg.solve(hessian, gradient)
    return beta


def test_logistic_weights_of_all_classes(spark):
    """Balanced, separable and lopsided classes at once, one label only, nulls; weights as MLlib gives them."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    rng, rows = random.Random(1), []
    for c, share in (("even", 0.5), ("rare", 0.04), ("apart", 0.2)):
        for _ in range(200):
            y = float(rng.random() < share)
            rows.append((c, y, y if c == "apart" else rng.random() + 0.3 * y, rng.choice([0.0, 0.5, rng.random()]), rng.random() / 5))
    rows += [("single", 0.0, 0.1, 0.2, 0.3)] * 5 + [("even", 1.0, None, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "class string, label double, p double, q double, r double").repartition(3)
    got = {}
    for r in learn.logistic_weights(df, ["p", "q", "r"]).collect():
        got.setdefault(r["class"], []).append(r["weight"])
    assert got["single"] == [0, 0, 0] and len(got) == 4
    for c in ("even", "rare", "apart"):
        own = np.array([[v or 0.0 for v in r[1:]] for r in rows if r[0] == c])
        n, pos = len(own), own[:, 0].sum()
        weight = np.where(own[:, 0] == 1, n / (2 * pos), n / (2 * (n - pos)))
        assert np.abs(plain_logistic(own[:, 1:], own[:, 0], weight, 1 / n)[:3] - got[c]).max() < 1e-6
    n, pos = df.filter("class = 'rare'").agg(F.count("*"), F.sum("label")).first()
    part = VectorAssembler(inputCols=["p", "q", "r"], outputCol="features").transform(df.filter("class = 'rare'").withColumn("w", F.when(F.col("label") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos)))))
    model = LogisticRegression(weightCol="w", regParam=1 / n, standardization=False, maxIter=500, tol=1e-14).fit(part)
    assert np.abs(np.array(got["rare"]) - model.coefficients.toArray()).max() < 1e-6


def test_meta_weights_of_hand_made_scores(spark):
    rng = random.Random(3)
    truth = [(i, f"c{i % 3}") for i in range(90)]
    scores = [(i, f"c{k}", (0.9 if t == f"c{k}" else 0.2) + rng.random() / 10, rng.random()) for i, t in truth for k in range(3)]
    got = {(r["class"], r["classifier"]): r["weight"] for r in learn.meta_weights(spark.createDataFrame(scores, "row_id long, class string, good double, noise double"), spark.createDataFrame(truth, "row_id long, class string"), ["good", "noise"]).collect()}
    for k in range(3):
        own = [(float(truth[i][1] == c), g, e) for i, c, g, e in scores if c == f"c{k}"]
        x, y = np.array([r[1:] for r in own]), np.array([r[0] for r in own])
        beta = plain_logistic(x, y, np.where(y == 1, 90 / 60, 90 / 120), 1 / 90)
        assert abs(got[f"c{k}", "good"] - beta[0]) < 1e-6 and abs(got[f"c{k}", "noise"] - beta[1]) < 1e-6
        assert got[f"c{k}", "good"] > 5 * abs(got[f"c{k}", "noise"])


def test_transfer_in_any_order_of_rows(spark):
    """One alias of two guiding topics: the higher score stays, however rows lie."""
    schema = "dataset string, concept string, attribute string, match_score double, source_dataset array<string>"
    base = [("g", "trees", "x", 1.0, None), ("g", "plants", "x", 2.0, None), ("o", "oaks", "y", 0.5, None)]
    transfers = spark.createDataFrame([("o", "trees", "oaks"), ("o", "plants", "oaks")], "dataset string, guiding_topic string, topic string")
    found = []
    for rows in (base, base[::-1]):
        out, added = kb.transfer_topics(spark.createDataFrame(rows, schema).coalesce(1), "g", transfers)
        found.append(sorted(map(str, out.collect())))
        assert [tuple(r) for r in added.collect()] == [("o", "oaks")]
        assert {(r["concept"], r["attribute"]): r["match_score"] for r in out.filter("dataset = 'g'").collect()}["oaks", "x"] == 2.0
    assert found[0] == found[1]


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(now[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_edit_distances():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcé😀") for _ in range(rng.randrange(9))) for _ in range(300)]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(600)]
    assert names.edit_distances(*map(list, zip(*pairs))).tolist() == [plain_edits(a, b) for a, b in pairs]


@pytest.mark.parametrize("rows,k", [(2048, 3), (25, 1), (25, 5)])
def test_nearest_names(spark, rows, k):
    rng = random.Random(rows + k)
    a, b = ([x for x in words(rng, 160) if x is not None] for _ in range(2))
    compared = spark.sparkContext.accumulator(0)
    left, right = spark.createDataFrame([(x,) for x in a + [None]], "name string"), spark.createDataFrame([(x,) for x in b + [None]], "known string")
    got = {}
    for r in names.nearest_names(left, right, k, rows, compared).collect():
        got.setdefault(r["name"], []).append((r["distance"], r["known"]))
    known = sorted(set(b), key=lambda x: x.encode())
    for x in set(a):
        assert sorted(got[x]) == sorted((plain_edits(x, y), y) for y in known)[:k]
    assert rows < 2048 or compared.value < 0.3 * len(set(a)) * len(known)
    assert names.nearest_names(left, right.limit(0), k).count() == 0
