"""Merkle manifest of a dataset: a forest of one tree for each group of rows, a tree over their roots, and a witness for every row.

A leaf is the digest of a row's columns. Leaves of a group ascend by id; every ARITY consecutive nodes become the digest
of their hexadecimal digests, level by level, until one node is left. The groups' roots, ordered by group, form the top
tree in the same way.

Witnesses are made incrementally. A group's leaves are cut into aligned blocks of ARITY ** LEVELS. A block's leaves come
as a stream of appends: subtrees that are still open hold, for each level, their nodes so far and the partial witnesses
of the leaves below; the sibling that completes a run extends all witnesses below it and the run's digest is appended
one level up. A block ends with its root and the witnesses of its leaves up to that root. The block roots are then
appended as leaves of the same kind, in blocks again, and a leaf's witness is continued by that of its block's root. A
group that holds most of all rows is many blocks, and what the next round appends is 729 times smaller.

A witness is, for each level, one byte (place in the run * 16 + size of the run) and the siblings' digests. `folded`
computes a root from a leaf and its witness.

Null ids come first; rows that repeat an id are ordered by their leaf, so equal rows may share neighbours but never
change a digest. Null groups form a group of their own, the first. A null value is hashed as `-`. An empty table gives an
empty result. Other columns are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_ROWS, checkpointed, col, join_classes, partitions, table, with_row_number

ARITY = 3
#: Levels of a block.
LEVELS = 6
#: The manifest's columns.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: list[Column]) -> Column:
    """The digest of a row: each value as its length in bytes, a colon and itself, or `-` if it is null."""
    fields = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in (v.cast("string") for v in values)]
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def digest(nodes: list[bytes]) -> bytes:
    """Of a run of nodes; their digests count as hexadecimal text."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


class Appender:
    """One block: leaves are appended in order; closed() gives the root and each leaf's witness."""

    def __init__(self, levels: int = LEVELS):
        self.levels, self.open, self.witnesses = levels, [[] for _ in range(levels + 1)], []

    def append(self, node: bytes) -> None:
        self.witnesses.append([])
        self._put(0, node, len(self.witnesses) - 1)

    def _put(self, level: int, node: bytes, first: int) -> None:
        """A subtree whose leaves begin with `first` is complete."""
        run = self.open[level]
        run.append((node, first))
        if len(run) == ARITY and level < self.levels:
            self._complete(level, len(self.witnesses))

    def _complete(self, level: int, end: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes, ends = [n for n, _ in run], [f for _, f in run[1:]] + [end]
        for k, (_, first) in enumerate(run):
            step = bytes([k << 4 | len(run)]) + b"".join(nodes[:k] + nodes[k + 1 :])
            for w in self.witnesses[first : ends[k]]:
                w.append(step)
        self._put(level + 1, digest(nodes), run[0][1])

    def closed(self, alone: bool) -> tuple[bytes, list[bytes]]:
        """alone: no other block belongs to the tree, so it ends where one node is left; else at the block's full height."""
        for level in range(self.levels):
            above = any(self.open[level + 1 :])
            if self.open[level] and (above or not alone or len(self.open[level]) > 1):
                self._complete(level, len(self.witnesses))
        (root, _), = (x for run in self.open for x in run)
        return root, [b"".join(w) for w in self.witnesses]


def steps(witness: bytes):
    """(place, siblings) of each level of a witness."""
    at = 0
    while at < len(witness):
        place, size = witness[at] >> 4, witness[at] & 15
        yield place, [witness[at + 1 + 32 * i : at + 33 + 32 * i] for i in range(size - 1)]
        at += 1 + 32 * (size - 1)


def folded(node: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness give."""
    for place, siblings in steps(witness):
        node = digest(siblings[:place] + [node] + siblings[place:])
    return node


def siblings(witness: bytes) -> bytes:
    """All siblings of a witness, from the leaf upwards, left to right."""
    return b"".join(x for _, own in steps(witness) for x in own)


_APPENDED = "tree binary, block long, pos long, node binary, witness binary, block_root binary"


def append_blocks(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """nodes: tree, pos (gapless from 0 in each tree), node. Adds block (pos / ARITY ** levels), the node's witness up to its block's root, and that root."""
    size = ARITY**levels

    def stream(batches):
        """Blocks come one after the other, each in order of pos; a block may go over the ends of batches."""
        now, appender, rows = None, None, []

        def close():
            root, witnesses = appender.closed(alone=now[1] == 0 and len(rows) < size)
            made = [(now[0], now[1], pos, node, w, root) for (pos, node), w in zip(rows, witnesses)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["tree", "block", "pos", "node", "witness", "block_root"])

        for b in batches:
            for tree, block, pos, node in zip(*(b.column(c).to_pylist() for c in ("tree", "block", "pos", "node"))):
                if (tree, block) != now:
                    if now is not None:
                        yield close()
                    now, appender, rows = (tree, block), Appender(levels), []
                appender.append(node)
                rows.append((pos, node))
        if now is not None:
            yield close()

    cut = nodes.select("tree", F.floor(F.col("pos") / size).alias("block"), "pos", "node")
    dealt = cut.repartition(partitions(nodes.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "pos")
    return dealt.mapInArrow(stream, _APPENDED)


def grown(nodes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(tree, pos, witness up to the tree's root) of every node, and (tree, root) of every tree. nodes: tree, pos, node."""
    rounds, size = [checkpointed(append_blocks(nodes, levels))], ARITY**levels
    while (rounds[-1].agg(F.max("block")).first()[0] or 0) > 0:
        roots = rounds[-1].filter(F.col("pos") % size == 0).select("tree", F.col("block").alias("pos"), F.col("block_root").alias("node"))
        rounds.append(checkpointed(append_blocks(roots, levels)))
    roots = rounds[-1].filter("pos = 0").select("tree", F.col("block_root").alias("root"))
    above = rounds.pop().select("tree", "pos", "witness")
    for below in reversed(rounds):
        upper = above.select("tree", F.col("pos").alias("block"), F.col("witness").alias("upper"))
        above = below.join(upper, ["tree", "block"]).select("tree", "pos", F.concat("witness", "upper").alias("witness"))
    return above, roots


def positions(rows: DataFrame, by: str, order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds pos: the row's place 0, 1, ... in its group, in this order. One range shuffle; groups of very many rows get their first row's number by broadcast."""
    numbered, _ = with_row_number(rows, [by, *order], "m_row")
    first = checkpointed(numbered.groupBy(by).agg(F.min("m_row").alias("m_first"), F.count("*").alias("n")))
    return join_classes(numbered, first, [by], hot_rows).withColumn("pos", F.col("m_row") - F.col("m_first")).drop("m_row", "m_first", "n")


def manifest(df: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", levels: int = LEVELS, hot_rows: int = HOT_ROWS, **others: Column) -> DataFrame:
    """m_id, m_group, leaf, witness, subroot and root for every row; others: more columns to carry, such as other versions of the leaf."""
    group = col(group_col).cast("string")
    # The group's key sorts as its bytes do, null first, and tells null from empty text.
    rows = df.select(col(id_col).cast("long").alias("m_id"), group.alias("m_group"), F.when(group.isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), group.cast("binary"))).alias("tree"), leaf([col(c) for c in columns]).alias("node"), *(c.alias(n) for n, c in others.items()))
    # Kept before it is dealt by ranges, as their bounds are drawn in a pass of its own that would compute all digests again.
    placed = checkpointed(positions(checkpointed(rows), "tree", ["m_id", "node"], hot_rows))
    local, subroots = grown(placed.select("tree", "pos", "node"), levels)
    ranked, _ = with_row_number(subroots, ["tree"], "rank")
    ranked = checkpointed(ranked)
    top, root = grown(ranked.select(F.lit(b"").alias("tree"), F.col("rank").alias("pos"), F.col("root").alias("node")), levels)
    only = root.first()
    groups = ranked.join(top.select(F.col("pos").alias("rank"), F.col("witness").alias("upper")), "rank").join(placed.groupBy("tree").agg(F.count("*").alias("n")), "tree")
    groups = checkpointed(groups.select("tree", F.col("root").alias("subroot"), "upper", "n"))
    joined = join_classes(placed.join(local, ["tree", "pos"]), groups, ["tree"], hot_rows)
    return joined.select("m_id", "m_group", F.col("node").alias("leaf"), F.concat("witness", "upper").alias("witness"), "subroot", F.lit(bytes(only["root"]) if only else None).cast("binary").alias("root"), *others)


def audited(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. rows: a manifest with `seen`, the leaf that is to be verified (null: the leaf itself)."""

    def fold(batches):
        for b in batches:
            leaves, roots, witnesses = (b.column(c).to_pylist() for c in ("leaf", "root", "witness"))
            found = [folded(s or n, w) for s, n, w in zip(b.column("seen").to_pylist(), leaves, witnesses)]
            hexed = [[x.hex() for x in c] for c in (leaves, b.column("subroot").to_pylist(), roots)]
            proofs = [hashlib.sha256(siblings(w).hex().encode()).hexdigest() for w in witnesses]
            columns = [*hexed, proofs, [x.hex() for x in found]]
            yield pa.RecordBatch.from_arrays([b.column("m_id"), *(pa.array(c, pa.string()) for c in columns), pa.array([f == r for f, r in zip(found, roots)], pa.bool_())], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return rows.mapInArrow(fold, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id has an even crc32 are tampered with: their texts lose their line feeds."""
    docs = table(spark, sf_dir, "documents")
    cut = {c: F.col(c) for c in COLUMNS} | {"text": F.translate("text", "\n", "")}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return audited(manifest(docs, seen=F.when(tampered, leaf([cut[c] for c in COLUMNS]))))


#: crc32 of decimal digits, bit by bit; the constant is the polynomial of CRC-32.
_CRC = "xor(list_reduce([4294967295::UBIGINT] || [ord(x)::UBIGINT FOR x IN string_split(CAST(doc_id AS VARCHAR), '')], lambda a, b: list_reduce([xor(a, b)] || [0::UBIGINT FOR k IN range(8)], lambda c, k: xor(c >> 1, 3988292384::UBIGINT * (c & 1)))), 4294967295::UBIGINT)"
_OWN = "list_reduce([CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END FOR x IN [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), {}]], lambda a, b: a || b)"
_NEXT = "SELECT {t} level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3) FROM {name} WHERE n > 1 GROUP BY {t} level, pos // 3"
OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, sha256({_OWN.format("text")}) AS leaf, sha256({_OWN.format("replace(text, chr(10), '')")}) AS cut, {_CRC} % 2 = 0 AS tampered FROM documents),
leaves AS (SELECT doc_id, leaf, CASE WHEN tampered THEN cut ELSE leaf END AS seen, coalesce('1' || source, '0') AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
tree AS (SELECT t, 0 AS level, pos, leaf AS node, n FROM leaves UNION ALL {_NEXT.format(t="t,", name="tree")}),
sub AS (SELECT t, level AS height, node, row_number() OVER (ORDER BY encode(t)) - 1 AS rank, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, rank AS pos, node, n FROM sub UNION ALL {_NEXT.format(t="", name="top")}),
runs AS (SELECT t, level, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM tree WHERE n > 1 GROUP BY ALL UNION ALL SELECT NULL, level, pos // 3, list(node ORDER BY pos) FROM top WHERE n > 1 GROUP BY ALL),
path AS (
  SELECT doc_id, leaf, sub.node AS subroot, t, rank, height, 0 AS level, CASE WHEN height = 0 THEN rank ELSE pos END AS pos, seen AS node, '' AS proof FROM leaves JOIN sub USING (t)
  UNION ALL
  SELECT doc_id, leaf, subroot, p.t, rank, height, p.level + 1, CASE WHEN p.level + 1 = height THEN rank ELSE pos // 3 END, sha256(array_to_string(nodes[:pos % 3] || [node] || nodes[pos % 3 + 2:], '')), proof || array_to_string(nodes[:pos % 3] || nodes[pos % 3 + 2:], '')
  FROM path p JOIN runs r ON r.t IS NOT DISTINCT FROM (CASE WHEN p.level < height THEN p.t END) AND r.level = p.level - CASE WHEN p.level < height THEN 0 ELSE height END AND r.run = pos // 3),
root AS (SELECT node AS root, level AS high FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM path, root WHERE level = height + high
"""
