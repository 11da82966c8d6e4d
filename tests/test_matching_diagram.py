"""Decision diagrams of correspondences and running sums over ranges, against plain listings."""

import itertools
import random
import time

import pytest

from topicloom.operators import cluster, matching, numbering


def plain_ways(own):
    topics = sorted(own)
    for pick in itertools.product(*([None, *sorted(own[t])] for t in topics)):
        given = [x for x in pick if x is not None]
        if len(set(given)) == len(given):
            yield dict(zip(topics, pick))


def test_diagram_against_listing(spark):
    rng = random.Random(1)
    rows, tables = [], {}
    for k in range(12):
        own = {f"t{i}": {rng.choice("abcde") for _ in range(rng.randrange(1, 4))} for i in range(rng.randrange(1, 6))}
        tables[f"x{k}"] = own
        rows += [(t, f"x{k}", a) for t, attrs in own.items() for a in attrs]
    df = spark.createDataFrame(rows + rows[:5] + [("t0", "x0", None)], "topic string, `table` string, attr string").repartition(3)
    diagram = matching.matching_diagram(df).cache()
    counts = {r["table"]: int(r["ways"]) for r in matching.matching_counts(diagram).collect()}
    ways = {x: list(plain_ways(own)) for x, own in tables.items()}
    assert counts == {x: len(w) for x, w in ways.items()}
    shares = {(r["table"], r["topic"], r["attr"]): int(r["ways"]) for r in matching.topic_shares(diagram).collect()}
    want = {}
    for x, listed in ways.items():
        for w in listed:
            for t, a in w.items():
                want[x, t, a] = want.get((x, t, a), 0) + 1
    assert shares == want
    for k in (0, 1, 7, 40):
        got = {}
        for r in matching.kth_matching(diagram, k).collect():
            got.setdefault(r["table"], {})[r["topic"]] = r["attr"]
        assert got == {x: w[k] for x, w in ways.items() if k < len(w)}


def test_diagram_of_many_topics(spark):
    """40 topics of 5 candidates each, of which neighbours share some: counted in seconds where a listing has over 10^25 rows."""
    rows = [(f"t{i:02}", "wide", f"a{3 * i + k:03}") for i in range(40) for k in range(5)]
    df = spark.createDataFrame(rows, "topic string, `table` string, attr string")
    began = time.time()
    diagram = matching.matching_diagram(df)
    ways = int(matching.matching_counts(diagram).first()["ways"])
    assert ways > 10**25 and time.time() - began < 30
    # A transfer matrix over which of the two shared candidates the topic before has taken.
    state = {frozenset(): 1}
    for i in range(40):
        new = {}
        for used, n in state.items():
            for a in [None, *range(3 * i, 3 * i + 5)]:
                if a not in used:
                    to = frozenset(x for x in used | ({a} if a is not None else set()) if x >= 3 * i + 3)
                    new[to] = new.get(to, 0) + n
        state = new
    assert ways == sum(state.values())
    last = {r["topic"]: r["attr"] for r in matching.kth_matching(diagram, ways - 1).collect()}
    assert len(last) == 40 and last["t00"] == "a004"
    with pytest.raises(Exception, match="states"):
        matching.matching_diagram(df, max_states=10).count()
    assert matching.matching_diagram(df.limit(0)).count() == 0


def test_running_sums_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i, rng.choice(["start", "end", "x", "y", None])) for i in range(700)]
    df = spark.createDataFrame(rows, "file string, line_no int, value string").repartition(5)
    got = numbering.running_sums(df, "file", "line_no", {"n": numbering.F.lit(1), "starts": (numbering.F.col("value") == "start").cast("long")})
    sums, want = {}, {}
    for f, i, v in rows:
        n, s = sums.get(f, (0, 0))
        sums[f] = want[f, i] = (n + 1, s + (v == "start"))
    assert {(r["file"], r["line_no"]): (r["n"], r["starts"]) for r in got.collect()} == want and got.columns == ["file", "line_no", "value", "n", "starts"]


def test_sections_of_one_long_file(spark):
    """One file's lines are marked by many tasks, none of which holds them all."""
    lines = spark.range(20_000).selectExpr("'f' AS file", "id AS line_no", "CASE WHEN id % 100 = 10 THEN 'begin' WHEN id % 100 = 60 THEN 'end' ELSE concat('v', id) END AS value")
    got = cluster.running_sections(lines.repartition(7), "begin", "end")
    rows = got.selectExpr("count(*) AS n", "min(section) AS low", "max(section) AS high", "sum(CASE WHEN line_no % 100 > 10 AND line_no % 100 < 60 THEN 0 ELSE 1 END) AS wrong").first()
    assert tuple(rows) == (200 * 49, 1, 200, 0)
    assert cluster.running_sections(lines.limit(0), "begin", "end").count() == 0
