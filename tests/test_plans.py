"""The two drivers' registered queries against plain Python over dictionaries."""

import numpy as np
import pytest

from topicloom.functions.similarity import bigram_similarity
from topicloom.operators import cluster
from topicloom.plans.queries import QUERIES, TABLES
from topicloom.plans.relation_queries import MEANT, TAGS

GUIDE = "customer"


def name_score(a, b):
    return float(bigram_similarity([a], [b])[0])


@pytest.fixture(scope="module")
def world(spark, data):
    """columns(dataset, attr, ordinal), tags, and the path similarity of two words of part."""
    columns = [(n, c.partition("_")[2], i) for n in (*TABLES, "nation") for i, c in enumerate(spark.read.parquet(f"{data}/{n}.parquet").columns)]
    words = [r[0].split() for r in spark.read.parquet(f"{data}/part.parquet").select("p_name").distinct().collect()]
    kinds = {w: k for pair in words for w, k in zip(pair, ("quality", "thing"))}

    def path(a, b):
        if a not in kinds or b not in kinds:
            return None
        return 1.0 if a == b else 1 / 3 if kinds[a] == kinds[b] else 1 / 5

    return columns, path


def local(world, every):
    columns, path = world
    out = {}
    for d, attr, _ in columns:
        found = []
        for topic in {t for e, t, _ in TAGS if every or e == d}:
            ngram = name_score(topic, attr)
            meanings = [path(MEANT[attr], m) for _, t, m in TAGS if t == topic] if attr in MEANT else []
            word = max([x for x in meanings if x is not None], default=0.0)
            if every:
                score = 0.4 * ngram + 0.6 * word
            else:
                shared = [len({MEANT[a], a} & {m, topic.split()[0]}) for e, a, _ in columns if a == attr and a in MEANT for _, t, m in TAGS if t == topic]
                score = ngram if ngram >= word else min(word * max([1, *shared]), 1.0)
            if score > 0.5:
                found.append((-score, topic))
        for score, topic in sorted(found)[:4]:
            out[d, topic, attr] = -score
    return out


@pytest.mark.parametrize("name", ["local_topics", "own_topics"])
def test_local_mappings(spark, data, world, name):
    got = {(r["dataset"], r["concept"], r["attribute"]): r["match_score"] for r in QUERIES[name](spark, data).collect()}
    want = local(world, name == "local_topics")
    assert got and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def expanded(world, rounds=5):
    """dataset_topics of the guiding table's expansion."""
    columns, path = world
    base = {k: (score, []) for k, score in local(world, True).items()}
    meanings = {}
    for d, topic, m in TAGS:
        meanings.setdefault((d, topic), set()).add(m)
    shown = {t for d, t, _ in TAGS if d == GUIDE}
    exposed = {(d, t) for d, t, _ in TAGS if d != GUIDE}
    added, groups = set(), set()
    tables = {d for d, _, _ in columns if d != GUIDE} | {d for d, _ in exposed}

    def rows(pairs, row_words, col_words):
        """Best row of each (dataset, frame, column) over the gate: (dataset, row, column, score)."""
        frames = {}
        for d, r, c in pairs:
            frames.setdefault((d, 1, c), []).append((name_score(r, c), r))
            meant = [x for a in row_words(d, r) for b in col_words(d, c) if (x := path(a, b)) is not None]
            if meant:
                frames.setdefault((d, 0, c), []).append((max(meant), r))
        best = {k: min((-s, r) for s, r in v) for k, v in frames.items()}
        top = {}
        for (d, _, _), v in frames.items():
            top[d] = max([top.get(d, 0), *(s for s, _ in v)])
        return [(d, r, c, -s, f) for (d, f, c), (s, r) in best.items() if top[d] > 0.4]

    def last(found):
        """Of a column's rows with 0.5 or more the one with the lowest score."""
        kept = {}
        for d, r, c, s, f in found:
            if s >= 0.5:
                kept[d, c] = min(kept.get((d, c), (9,)), (s, r, f))
        return [(d, r, c, s) for (d, c), (s, r, _) in kept.items()]

    def guide_words(_, topic):
        return meanings.get((GUIDE, topic)) or set().union(*(meanings.get((d, t), set()) for d, t in added if t == topic))

    def put(found, source):
        best = {}
        for d, concept, attr, s in found:
            best[GUIDE, concept, attr] = min(best.get((GUIDE, concept, attr), (9,)), (-s, d))
        base.update({k: (-s, [source or d]) for k, (s, d) in best.items()})

    attr_words = lambda d, a: {MEANT[a]} if a in MEANT else set()
    for _ in range(rounds):
        near = rows([(d, r, t) for d, t in exposed for r in shown], guide_words, lambda d, t: meanings.get((d, t), set()))
        transfers = last(near)
        if not transfers:
            break
        moved = {}
        for d, r, t, _ in transfers:
            for (e, concept, attr), (s, source) in base.items():
                if (e, concept) == (d, t):
                    new = list(dict.fromkeys([*source, d]))
                    moved[GUIDE, r, attr] = min(moved.get((GUIDE, r, attr), (9,)), (-s, ",".join(new), new))
        base.update({k: (-s, new) for k, (s, _, new) in moved.items()})
        aliased = {}
        for d, r, t, _ in transfers:
            if r != t:
                aliased |= {(GUIDE, t, attr): v for (e, concept, attr), v in base.items() if (e, concept) == (GUIDE, r)}
        base.update(aliased)
        added |= {(d, t) for d, _, t, _ in transfers}
        groups |= {(r, d, t) for d, r, t, _ in transfers}
        shown |= {t for _, _, t, _ in transfers}
        fresh = {(d, t) for d, _, t, s, _ in near if s > 0 and t not in shown}
        mapped = {attr for d, _, attr in base if d == GUIDE}
        covered = last(rows([(d, t, a) for d, t in fresh for e, a, _ in columns if e == GUIDE and a not in mapped], lambda d, t: meanings.get((d, t), set()), attr_words))
        put(covered, None)
        added |= {(d, t) for d, t, _, _ in covered}
        had = {(d, attr) for (e, _, attr), (_, source) in base.items() if e == GUIDE for d in source}
        matters = last(rows([(d, t, a) for d, a, _ in columns if d != GUIDE and (d, a) not in had for t in shown], guide_words, attr_words))
        put(matters, GUIDE)
        groups |= {(t, d, None) for d, t, _, _ in matters}
        exposed -= added
        shown |= {g for g, _, _ in groups}
    out = {(s, concept) for (d, concept, _), (_, source) in base.items() if d == GUIDE for s in (source or [GUIDE])}
    for g in {g for g, _, _ in groups}:
        given = {g} | {t for h, _, t in groups if h == g and t}
        out |= {(d, t) for d in {GUIDE} | {d for h, d, _ in groups if h == g} for t in given}
    assert tables
    return out


def test_guiding_expansion(spark, data, world):
    got = {(r["dataset"], r["topic"]) for r in QUERIES["guiding_expansion"](spark, data).collect()}
    want = expanded(world)
    assert len(want) > 8 and got == want


def naive_groups(d, threshold):
    """Flat groups by inconsistency, from clusters merged one pair at a time."""
    clusters = {i: ([i], None, ()) for i in range(len(d))}
    nodes, most, heights = dict(clusters), {}, {}
    for k in range(len(d) - 1):
        height, a, b = min((min(d[i, j] for i in clusters[x][0] for j in clusters[y][0]), x, y) for x in clusters for y in clusters if x < y)
        name = len(d) + k
        below = [heights[x] for x in (a, b) if x in heights]
        all_ = [height, *below]
        spread = np.std(all_, ddof=1) if len(all_) > 1 else 0
        most[name] = max([(height - np.mean(all_)) / spread if spread > 0 else 0.0, *(most[x] for x in (a, b) if x in most)])
        heights[name] = height
        nodes[name] = clusters[name] = (clusters[a][0] + clusters[b][0], height, (a, b))
        del clusters[a], clusters[b]
    group = list(range(len(d)))
    for name in sorted(most):
        if most[name] <= threshold:
            for i in nodes[name][0]:
                group[i] = min(nodes[name][0])
    return [sorted(set(group)).index(g) + 1 for g in group]


@pytest.mark.parametrize("seed", range(5))
def test_inconsistent_groups_against_naive(seed):
    rng = np.random.default_rng(seed)
    points = rng.random((12, 2)) + (rng.integers(0, 3, (12, 1)) * 3)
    d = np.sqrt(((points[:, None] - points[None, :]) ** 2).sum(axis=2))
    assert cluster.inconsistent_groups(d, 0.8).tolist() == naive_groups(d, 0.8)


def discovered(spark, data):
    """iterative_discovery's clusters by plain Python: (concept, src_dataset, src_attr, tar_dataset, tar_attr) -> score."""
    from collections import Counter

    from topicloom.plans.queries import PROFILED

    cells, kind = {}, {}
    for d, names in PROFILED.items():
        df = spark.read.parquet(f"{data}/{d}.parquet")
        rows = sorted(df.selectExpr(names[0], *(f"cast({c} as string)" for c in names)).collect(), key=lambda r: r[0])
        for i, c in enumerate(names):
            cells[d, c], kind[d, c] = [r[i + 1] for r in rows], dict(df.dtypes)[c] == "string"
    order = {k: PROFILED[k[0]].index(k[1]) for k in cells}
    sample = {k: Counter(v[: min(max(int(len(v) * 0.01), 10), 100)]) for k, v in cells.items()}
    every = {k: Counter(v) for k, v in cells.items()}
    whole = lambda v: v.lstrip("+-").isdigit()
    known = {}

    def alike(u, v):
        if (u, v) not in known:
            known[u, v] = name_score(u, v)
        return known[u, v]

    def begin(topics):
        out = {}
        for d, topic in topics:
            score, _, attr = min((-name_score(topic, c), i, c) for i, c in enumerate(PROFILED[d]))
            out[topic, d] = attr if score < 0 else None
        return out

    vocabulary = [("nation", "name"), ("customer", "segment"), ("part", "brand"), ("part", "size")]
    match, clusters = begin(vocabulary[:3]), {}
    fresh = dict(match)
    for _ in range(5):
        for (concept, d), attr in fresh.items():
            best = {}
            for tar in cells if attr else ():
                if tar[0] == d or kind[tar] != kind[d, attr]:
                    continue
                sums = [alike(u, v) * every[tar][v] * nu * nv for u, nu in sample[d, attr].items() for v, nv in sample[tar].items() if "None" not in (u, v) and whole(u) == whole(v) and alike(u, v) > 0.6]
                if sums:
                    score = 0.8 * sum(sums) + 0.2 * name_score(attr, tar[1])
                    best[tar[0]] = min(best.get(tar[0], (0,)), (-score, order[tar], tar[1]))
            for t, (score, _, tar) in best.items():
                if -score > 10:
                    clusters[concept, d, t] = (attr, tar, -score)
        keys = {(c, d) for c, d, _ in clusters}
        for c in {c for c, _ in keys}:  # no concept has sources in two tables here, so none is split
            assert len([k for k in keys if k[0] == c]) <= 1
        own = {k: {f"{t}.{v[1]}" for (c, d, t), v in clusters.items() if (c, d) == k} | {f"{k[1]}.{match[k]}"} for k in keys}
        assert all(len(own[a] & own[b]) / (len(own[a]) * len(own[b])) ** 0.5 < 0.9 for a in keys for b in keys if a < b)  # nor are any merged
        concepts = {c for c, _ in match}
        mean = {t: np.mean([name_score(t, c) for c in concepts]) for _, t in vocabulary if t not in concepts}
        new = sorted(mean, key=lambda t: (-mean[t], t))[:5]
        fresh = begin([(d, t) for d, t in vocabulary if t in new])
        if not fresh:
            break
        match |= fresh
    return {(c, d, attr, t, tar): s for (c, d, t), (attr, tar, s) in clusters.items()}


def test_iterative_discovery(spark, data):
    got = {tuple(r)[:5]: r["score"] for r in QUERIES["iterative_discovery"](spark, data).collect()}
    want = discovered(spark, data)
    assert want and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-3 for k in got)
