"""One-to-one correspondences of topics and attributes as a decision diagram for each table (C8): counted and picked without listing them."""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of one table's diagram; more are an error.
MAX_STATES = 1 << 20
_WAYS = pa.decimal128(38, 0)


def matching_diagram(candidates: DataFrame, max_states: int = MAX_STATES) -> DataFrame:
    """table, level, topic, node, attr, to, ways: one arc for each choice of a topic in a state of a table.

    candidates: table, topic, attr. Topics come one after the other, in order of their names; a topic takes one of its
    candidates that is still free, or none (attr null). A state is the set of used attributes that a later topic could
    still want, so states that differ in the past alone are one node, and the diagram stays small where the list of
    ways is exponential. `ways` counts the ways from the arc's end to the last topic. A table's candidates and states
    (max_states at most) are in one task.
    """

    def build(table: pa.Table) -> pa.Table:
        wanted: dict[str, list[str]] = {}
        for topic, attr in sorted(set(zip(table.column("topic").to_pylist(), table.column("attr").to_pylist()))):
            wanted.setdefault(topic, []).append(attr)
        topics, later = sorted(wanted), set()
        after = []  # what topics behind each one can want
        for topic in reversed(topics):
            after.append(frozenset(later))
            later |= set(wanted[topic])
        after.reverse()
        levels, arcs, states = [{frozenset(): 0}], [], 1
        for topic, still in zip(topics, after):
            nodes: dict[frozenset, int] = {}
            own = []
            for used, node in levels[-1].items():
                for attr in [None, *(x for x in wanted[topic] if x not in used)]:
                    to = (used | {attr} if attr is not None else used) & still
                    own.append((node, attr, nodes.setdefault(to, len(nodes))))
            states += len(nodes)
            if states > max_states:
                raise OverflowError(f"the diagram has over {max_states} states")
            arcs.append(own)
            levels.append(nodes)
        ways, rows = {k: 1 for k in levels[-1].values()}, []
        for level in range(len(topics) - 1, -1, -1):
            before: dict[int, int] = {}
            for node, attr, to in arcs[level]:
                rows.append((level, topics[level], node, attr, to, Decimal(ways[to])))
                before[node] = before.get(node, 0) + ways[to]
            ways = before
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), _WAYS)
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
        return pa.table([pa.array([table.column("table")[0].as_py()] * len(rows), pa.string()), *columns], names=["table", "level", "topic", "node", "attr", "to", "ways"])

    named = candidates.select("table", "topic", "attr").filter("topic IS NOT NULL AND attr IS NOT NULL")
    return named.groupBy("table").applyInArrow(build, "table string, level int, topic string, node int, attr string, to int, ways decimal(38,0)")


def matching_counts(diagram: DataFrame) -> DataFrame:
    """table, ways: how many one-to-one correspondences a table has, the empty one included."""
    return diagram.filter("level = 0").groupBy("table").agg(F.sum("ways").cast("decimal(38,0)").alias("ways"))


def topic_shares(diagram: DataFrame) -> DataFrame:
    """table, topic, attr, ways: in how many of a table's correspondences a topic takes an attribute (null: none). One pass down the levels for each table."""

    def share(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("level", "node", "topic", "attr", "to", "ways"))), key=lambda r: r[:2])
        reached, found = {(0, 0): 1}, {}
        for level, node, topic, attr, to, ways in rows:
            here = reached[level, node]
            reached[level + 1, to] = reached.get((level + 1, to), 0) + here
            found[topic, attr] = found.get((topic, attr), 0) + here * int(ways)
        names = list(found)
        return pa.table([pa.array([table.column("table")[0].as_py()] * len(names), pa.string()), pa.array([t for t, _ in names], pa.string()), pa.array([a for _, a in names], pa.string()), pa.array([Decimal(found[x]) for x in names], _WAYS)], names=["table", "topic", "attr", "ways"])

    return diagram.groupBy("table").applyInArrow(share, "table string, topic string, attr string, ways decimal(38,0)")


def kth_matching(diagram: DataFrame, k: int) -> DataFrame:
    """table, topic, attr of each table's correspondence number k (from 0) in order of its topics' choices, none first, then attributes by name; tables with fewer have no rows."""

    def walk(table: pa.Table) -> pa.Table:
        arcs: dict[tuple[int, int], list] = {}
        for level, node, topic, attr, to, ways in zip(*(table.column(c).to_pylist() for c in ("level", "node", "topic", "attr", "to", "ways"))):
            arcs.setdefault((level, node), []).append((attr is not None, attr or "", to, int(ways), topic))
        left, at, out = k, (0, 0), []
        if k >= sum(a[3] for a in arcs[at]):
            arcs = {}
        while at in arcs:
            for given, attr, to, ways, topic in sorted(arcs[at]):
                if left < ways:
                    out.append((topic, attr if given else None))
                    at = (at[0] + 1, to)
                    break
                left -= ways
        return pa.table([pa.array([table.column("table")[0].as_py()] * len(out), pa.string()), pa.array([t for t, _ in out], pa.string()), pa.array([a for _, a in out], pa.string())], names=["table", "topic", "attr"])

    return diagram.groupBy("table").applyInArrow(walk, "table string, topic string, attr string")
