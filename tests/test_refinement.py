"""Split and merge of a whole knowledge base against plain Python, on random bases in which both act, and a registered run that merges."""

import random

import pytest

from test_linkage import plain_cut
from topicloom.plans import iterative
from topicloom.plans.queries import QUERIES

MATCH = "concept string, dataset string, attribute string, match_score double, example_values array<string>, data_type string"
CLUSTER = "concept string, src_dataset string, src_attr string, tar_dataset string, tar_attr string, score double"


def random_base(rng):
    """match {(concept, dataset): attribute} and cluster rows, scores unique."""
    match, cluster = {}, []
    for c in range(rng.randrange(2, 6)):
        for d in rng.sample(range(9), rng.randrange(1, 7)):
            match[f"c{c}", f"d{d}"] = f"a{rng.randrange(3)}"
            cluster += [(f"c{c}", f"d{d}", match[f"c{c}", f"d{d}"], f"t{k}", f"x{rng.randrange(2)}", rng.random()) for k in rng.sample(range(8), rng.randrange(1, 6))]
    return match, cluster


def members(match, cluster):
    out = {}
    for c, s, _, t, x, _ in cluster:
        out.setdefault((c, s, match[c, s]), set()).add(f"{t}.{x}")
    return out


def moved(match, cluster, moves):
    """(concept, dataset) under new names; what then coincides is kept once, with the higher score."""
    to = lambda c, d: moves.get((c, d), c)
    found = {}
    for c, s, a, t, x, score in cluster:
        key = (to(c, s), s, a, t, x)
        found[key] = max(found.get(key, 0), score)
    return {(to(c, d), d, a) for (c, d), a in match.items()}, found


def plain_split(match, cluster, threshold):
    own, moves = members(match, cluster), {}
    for concept in {k[0] for k in own}:
        keys = sorted((k for k in own if k[0] == concept), key=lambda k: "|".join(k))
        d = [[0.0] * len(keys) for _ in keys]
        for i, a in enumerate(keys):
            for j, b in enumerate(keys):
                x = len(own[a] ^ own[b]) / (len(own[a]) + len(own[b]))
                d[i][j] = x if i != j and x > threshold else 0.0
        for k, part in zip(keys, plain_cut(d, threshold)):
            if part > 1:
                moves[k[0], k[1]] = f"temp_{concept}_{part}"
    return moved(match, cluster, moves)


def plain_merge(match, cluster, threshold):
    own = {k: m | {f"{k[1]}.{k[2]}"} for k, m in members(match, cluster).items()}
    root = {k: k for k in own}

    def top(k):
        return k if root[k] == k else top(root[k])

    for a in own:
        for b in own:
            if a < b and 1 - len(own[a] & own[b]) / (len(own[a]) * len(own[b])) ** 0.5 <= threshold + 1e-12:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    groups, moves = {}, {}
    for k in own:
        groups.setdefault(top(k), []).append(k)
    for group in groups.values():
        if len(group) > 1:
            name = "".join("+" + k[0] for k in sorted(group, key=lambda k: "|".join(k)) if "temp" not in k[0])
            moves |= {(k[0], k[1]): name for k in group if name}
    return moved(match, cluster, moves)


@pytest.mark.parametrize("step", ["split", "merge"])
def test_refinement_of_random_bases(spark, step):
    rng, acted = random.Random(11), 0
    for _ in range(4):
        match, cluster = random_base(rng)
        base = iterative.KnowledgeBase(spark.createDataFrame([(c, d, a, 1.0, [], "s") for (c, d), a in match.items()], MATCH), spark.createDataFrame(cluster, CLUSTER))
        threshold = {"split": 0.5, "merge": 0.4}[step]
        got = getattr(iterative, step)(base, threshold)
        want = {"split": plain_split, "merge": plain_merge}[step](match, cluster, threshold)
        assert {(r["concept"], r["dataset"], r["attribute"]) for r in got.match.collect()} == want[0]
        rows = [tuple(r) for r in got.cluster.select("concept", "src_dataset", "src_attr", "tar_dataset", "tar_attr", "score").collect()]
        assert len(rows) == len(want[1]) and {r[:5]: r[5] for r in rows} == want[1]
        acted += want[0] != {(c, d, a) for (c, d), a in match.items()}
    assert acted >= 2


def test_merging_discovery(spark, data):
    """Concepts are joined, each mapping is there once, and all scores pass."""
    rows = [tuple(r) for r in QUERIES["merging_discovery"](spark, data).collect()]
    assert len(rows) == len({r[:5] for r in rows}) > 10 and all(r[5] > 10 for r in rows)
    assert {"+custkey+key", "+name+name"} <= {r[0] for r in rows}
