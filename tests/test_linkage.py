"""Single linkage: spanning forests, the inconsistent cut, and range joins, against plain computations on random inputs."""

import math
import random

import numpy as np
import pytest

from topicloom.operators import cluster, linkage


def plain_cut(distance, threshold):
    """Merges the two nearest clusters again and again (ties by the smallest pair of members), and cuts as scipy's documentation of `inconsistent` states."""
    n = len(distance)
    clusters = [({i}, None) for i in range(n)]
    pairs = sorted((distance[i][j], i, j) for i in range(n) for j in range(i + 1, n))
    for h, i, j in pairs:
        x, y = (next(c for c in clusters if k in c[0]) for k in (i, j))
        if x is y:
            continue
        below = [c[1] for c in (x, y) if c[1]]
        heights = [h, *(m["h"] for m in below)]
        spread = np.std(heights, ddof=1) if len(heights) > 1 else 0
        own = (h - np.mean(heights)) / spread if spread > 1e-15 else 0
        merge = {"h": h, "most": max([own, *(m["most"] for m in below)]), "below": below, "members": x[0] | y[0]}
        clusters = [c for c in clusters if c is not x and c is not y] + [(x[0] | y[0], merge)]
    groups = [{i} for i in range(n)]

    def cut(m):
        if m["most"] <= threshold:
            groups[:] = [g for g in groups if not g & m["members"]] + [m["members"]]
        else:
            for b in m["below"]:
                cut(b)

    for _, m in clusters:
        if m:
            cut(m)
    order = sorted(groups, key=min)
    return [next(k for k, g in enumerate(order, 1) if i in g) for i in range(n)]


def test_inconsistent_groups_of_random_matrices():
    rng = np.random.default_rng(4)
    for _ in range(150):
        n = int(rng.integers(2, 14))
        d = rng.integers(0, int(rng.integers(2, 9)), (n, n)) / 8
        d = np.triu(d, 1) + np.triu(d, 1).T
        for threshold in (0.3, 0.5, 0.71, 1.1):
            assert linkage.inconsistent_groups(d, threshold).tolist() == plain_cut(d.tolist(), threshold)


@pytest.mark.parametrize("block", [linkage.BLOCK_EDGES, 7])
def test_spanning_forest(spark, block):
    rng = random.Random(block)
    edges, want = [], []
    for g in range(5):
        n = rng.randrange(2, 25)
        own = [(f"g{g}", f"n{i:02}", f"n{j:02}", rng.randrange(5) / 4) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]
        edges += own
        root = {f"n{i:02}": f"n{i:02}" for i in range(n)}

        def top(x, root=root):
            return x if root[x] == x else top(root[x])

        for e in sorted(own, key=lambda e: (e[3], e[1], e[2])):
            if top(e[1]) != top(e[2]):
                root[top(e[1])] = top(e[2])
                want.append(e)
    df = spark.createDataFrame(edges, "`group` string, a string, b string, w double").repartition(3)
    assert sorted(tuple(r) for r in linkage.spanning_forest(df, block).collect()) == sorted(want)


def plain_split(members, threshold):
    out = {}
    for concept in {c for c, _, _ in members}:
        own = {}
        for c, k, m in members:
            if c == concept:
                own.setdefault(k, set()).add(m)
        keys = sorted(own)
        d = np.zeros((len(keys), len(keys)))
        for i, a in enumerate(keys):
            for j, b in enumerate(keys):
                x = len(own[a] ^ own[b]) / (len(own[a]) + len(own[b]))
                d[i, j] = x if x > threshold and i != j else 0
        for k, part in zip(keys, plain_cut(d.tolist(), threshold)):
            out[concept, k] = concept if part == 1 else f"temp_{concept}_{part}"
    return out


@pytest.mark.parametrize("threshold", [0.2, 0.5, 1.0])
def test_split_of_random_concepts(spark, threshold):
    """Sources that share many, few or no members; a source alone; repeated rows."""
    rng = random.Random(int(threshold * 10))
    members = [(f"c{c}", f"k{k:02}", f"m{rng.randrange(8 + 6 * c)}") for c in range(5) for k in range(1 + 4 * c) for _ in range(rng.randrange(1, 6))]
    members += [("alone", "k", "m"), ("two", "k1", "m"), ("two", "k2", "n")]
    got = {(r["concept"], r["key"]): r["new_concept"] for r in cluster.split_concepts(spark.createDataFrame(members + members[:20], "concept string, key string, member string"), threshold).collect()}
    assert got == plain_split(members, threshold)
    assert threshold > 0.9 or any(v.startswith("temp_") for v in got.values())


def test_split_of_a_concept_of_many_sources(spark):
    """20,000 sources in one concept: chains of neighbours that share a member, far fewer edges than pairs."""
    n = 20_000
    members = spark.range(n).selectExpr("'c' AS concept", "lpad(string(id), 6, '0') AS key", "explode(array(string(id div 2), 'own' || id div 4)) AS member")
    parts = cluster.split_concepts(members, 0.3)
    assert parts.count() == n and parts.select("new_concept").distinct().count() > 1
    assert cluster.shared_members(members).count() < 3 * n


def plain_groups(ids, close):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in close:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("threshold,cell", [(1e-9, linkage.CELL_ROWS), (0.02, 5), (0.1, linkage.CELL_ROWS), (0.45, 5), (1.0, linkage.CELL_ROWS), (1.6, 5)])
def test_linkage_by_pivots(spark, threshold, cell, monkeypatch):
    """Equal, scaled, opposite and zero vectors, bundles of several widths, cells of many blocks."""
    rng = np.random.default_rng(int(threshold * 100) + cell)
    rows = []
    for k in range(9):
        axis = rng.normal(size=6)
        rows += [axis + rng.normal(size=6) * rng.choice([0, 0.05, 0.3, 0.8]) for _ in range(16)]
    rows += [rows[0], rows[0] * 3, -rows[0], np.zeros(6), np.zeros(6)]
    features = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    df = spark.createDataFrame(features, "id int, vec array<double>").repartition(3)
    dot = lambda u, v: sum(a * b for a, b in zip(u, v))
    close = [(a, b) for a, u in features for b, v in features if a < b and any(u) and any(v) and 1 - dot(u, v) / (math.sqrt(dot(u, u)) * math.sqrt(dot(v, v))) <= threshold]
    links = linkage.close_vectors(df, threshold, pivots=7, cell_rows=cell)
    got = plain_groups([i for i, _ in features], [tuple(r) for r in links.collect()])
    assert got == plain_groups([i for i, _ in features], close)
    if cell == 5:
        return
    assert {r["id"]: r["group"] for r in cluster.linkage(df, threshold).collect()} == got


def test_equal_vectors_give_no_pairs(spark):
    df = spark.range(3000).selectExpr("id", "array(1.0D, double(id div 1500)) AS vec")
    assert linkage.close_vectors(df, 0.1).count() < 3010
    assert cluster.linkage(df, 0.1).select("group").distinct().count() == 2
    assert cluster.linkage(df.limit(0), 0.1).count() == 0 and cluster.linkage(df.limit(1), 0.1).count() == 0


@pytest.mark.parametrize("threshold", [0.1, 0.45, 0.9])
def test_topic_groups_of_sparse_rows(spark, threshold):
    rng = random.Random(7)
    cells = {}
    for _ in range(160):
        cells[f"t{rng.randrange(40):02}", f"t{rng.randrange(40):02}"] = rng.randrange(1, 9) / 8
    matrix = [(a, b, s) for (a, b), s in cells.items()]
    vectors = {a: {b: s for (x, b), s in cells.items() if x == a} for a, _ in cells}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    close = [(a, b) for a in vectors for b in vectors if a < b and 1 - sum(x * vectors[b].get(k, 0) for k, x in vectors[a].items()) / (norm(vectors[a]) * norm(vectors[b])) <= threshold]
    want = {}
    for k, g in plain_groups(list(vectors), close).items():
        want.setdefault(g, []).append(k)
    got = {r["group"]: r["topics"] for r in cluster.topic_groups(spark.createDataFrame(matrix, "a string, b string, score double"), threshold).collect()}
    assert got == {g: sorted(t) for g, t in want.items()}
