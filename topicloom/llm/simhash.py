"""SimHash near-duplicates: exact comparison of all fingerprints, tile by tile, with exclusive-or and bit counts.

A text's fingerprint has one bit for each bit of its shingles' hashes: 1 if set in over half of them. Equal
fingerprints are one node. Nodes are ordered by population count and cut into groups; two
groups are compared only if their population counts come within the radius of each other. Inside a pair of groups
nodes lie in cells by the population counts of their 16-bit quarters, and tiles of cells whose counts differ by more
than the radius in sum are skipped, as such fingerprints differ in more bits. All other tiles are compared exactly
by numpy. Of the links found in a pair of groups a spanning forest is passed on (never all pairs), which keeps every
connection; components of the forests then give every document the smallest document id it can reach.

distinct=True counts each shingle of a text once. With fingerprint_words=2 a second 64-bit fingerprint (other seed) is appended, and the radius counts over both.

drop_near_duplicates takes fingerprints as candidate search only: texts link if the Jaccard similarity of their shingle
sets reaches a bound. Sets that are so similar share one of their smallest hashes, so fingerprints are compared only
where sets do (near_set_links); those that share a hash with very many go through the tiles. Candidates' components are cut into blocks of shingle sets, and every pair of blocks of a
component is counted exactly; again only spanning links are passed on. Shingles are compared by 64-bit hashes.

Null and empty texts have fingerprint zero and link like any other. Null ids are reached but never the smallest id,
unless a component has no other. Repeated rows are returned each. An empty table gives an empty result. Other
columns are not carried. In near_duplicates the number of comparisons grows with the square of the number of distinct
fingerprints.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_AZ, NO_ID, bytes_of, checkpointed, id_and_text, join_classes, keep_rows, partitions, row_key, small, table
from .components import components
from .url_filter import bounded_filter

SEED = 42
_LANES = np.uint64(0x0101010101010101)
_BLOCK = 255  # so many set bits fit a byte


def shingle_hashes(text: bytes, shingle_words: int, seed: int) -> list[int]:
    words = text.translate(LOWER_AZ).split()  # at ASCII white space
    if not words:
        return []
    joined, at, starts, ends = b" ".join(words), 0, [], []
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return [digest(joined, seed)]
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle_words - 1 :])]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """The fingerprint of each list of hashes."""
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    return _majority(np.fromiter((h for own in hashes for h in own), np.uint64, int(sizes.sum())), sizes)


def _majority(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes, which lie end to end."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.nonzero(sizes)[0]
    if not len(full):
        return out
    n = sizes[full]
    starts = np.cumsum(n) - n
    blocks = -(-n // _BLOCK)
    first = np.cumsum(blocks) - blocks
    within = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    cuts = np.repeat(starts, blocks) + within * _BLOCK
    for bit in range(8):  # counts of bits bit, bit + 8, ... in the eight bytes of a word
        lanes = np.add.reduceat((flat >> np.uint64(bit)) & _LANES, cuts)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[full] |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints(df: DataFrame, shingle_words: int, fingerprint_words: int = 1, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, raw (hash of the text as it is), f0 and f1 (0 if there is one word) for every row."""

    def compute(batches):
        for b in batches:
            texts = bytes_of(b.column("text"))
            pick = (lambda h: list(set(h))) if distinct else (lambda h: h)
            words = [majority([pick(shingle_hashes(t, shingle_words, SEED + k)) for t in texts]) if k < fingerprint_words else np.zeros(len(texts), np.uint64) for k in range(2)]
            raw = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(w.view(np.int64)) for w in (raw, *words))], ["doc_id", "raw", "f0", "f1"])

    return id_and_text(df, id_col, text_col).mapInArrow(compute, "doc_id long, raw long, f0 long, f1 long")


def _quarters(words: np.ndarray) -> np.ndarray:
    """Population counts of the 16-bit quarters of fingerprints."""
    return np.bitwise_count(np.ascontiguousarray(words).view(np.uint16).reshape(len(words), -1)).astype(np.int16)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, over links a[i]-b[i] of nodes 0..n-1."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def tile_forest(left: np.ndarray, right: np.ndarray | None, radius: int, tile: int = 512) -> np.ndarray:
    """Spanning links, as row numbers of left followed by right, between fingerprints (rows of two words or more); right None: within left."""
    both = left if right is None else np.concatenate([left, right])
    split = 0 if right is None else len(left)
    root = np.arange(len(both))

    def cells(rows: np.ndarray, base: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Rows by the population counts of their quarters."""
        kinds, which = np.unique(_quarters(rows), axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        return kinds, [x + base for x in np.split(order, np.cumsum(np.bincount(which.ravel()))[:-1])]

    def spans(rows: np.ndarray, base: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Tiles of rows in the order of their population counts, with the least and most of each."""
        count = np.bitwise_count(rows).sum(axis=1).astype(np.int16)
        order = np.argsort(count, kind="stable")
        cut = [order[i : i + tile] for i in range(0, len(order), tile)]
        return np.array([[count[c].min(), count[c].max()] for c in cut], np.int16), [c + base for c in cut]

    pooled = radius >= 8  # so wide a radius leaves almost no two cells apart
    arrange = spans if pooled else cells
    kinds, members = arrange(left, 0)
    kinds2, members2 = (kinds, members) if right is None else arrange(right, split)
    for i, own in enumerate(members):
        if pooled:
            near = np.nonzero((kinds2[:, 0] <= kinds[i, 1] + radius) & (kinds2[:, 1] >= kinds[i, 0] - radius))[0]
        else:
            near = np.nonzero(np.abs(kinds2 - kinds[i]).sum(axis=1) <= radius)[0]
        if right is None:
            near = near[near >= i]
        others = np.concatenate([members2[j] for j in near]) if len(near) else np.empty(0, np.int64)
        for p in range(0, len(own), tile):
            for q in range(0, len(others), 4 * tile):
                x, y = own[p : p + tile], others[q : q + 4 * tile]
                differ = np.bitwise_count(both[x, 0][:, None] ^ both[y, 0][None, :])
                for k in range(1, both.shape[1]):
                    if both[x, k].any() or both[y, k].any():
                        differ += np.bitwise_count(both[x, k][:, None] ^ both[y, k][None, :])  # all 256 bits of four words wrap to 0: only a needless candidate
                s, t = np.nonzero(differ <= radius)
                s, t = x[s], y[t]
                fresh = root[s] != root[t]
                if fresh.any():
                    root = forest(root[s[fresh]], root[t[fresh]], len(both))[root]
    inner = np.nonzero(root != np.arange(len(both)))[0]
    return np.column_stack([inner, root[inner]])


def _groups(counts: dict[int, int], group_size: int) -> tuple[list[tuple[int, int, int, int]], dict[int, tuple[int, int]]]:
    """Groups (number, lowest and highest population count, last group within reach: filled in later), and for each count its first group and how many share it."""
    groups, of, pending, held = [], {}, [], 0

    def close() -> None:
        nonlocal pending, held
        if pending:
            number, many = len(groups), max(1, -(-held // group_size))
            groups.extend((number + k, min(pending), max(pending), 0) for k in range(many))
            of.update({p: (number, many) for p in pending})
        pending, held = [], 0

    for p in sorted(counts):
        if held and held + counts[p] > group_size:
            close()
        pending.append(p)
        held += counts[p]
    close()
    return groups, of


#: The most fingerprints of a group; a task compares two groups.
GROUP = 1 << 19


def near_duplicate_links(nodes: DataFrame, radius: int, group_size: int = GROUP) -> DataFrame:
    """A forest of links (a0, a1, ..., b0, b1, ...) between distinct fingerprints (f0, f1, ...) that differ in at most radius bits.

    Groups are as many as give every core a few pairs of them to compare, more only beyond group_size fingerprints
    each. A group travels once to each of its pairs, and each pair is one task.
    """
    spark, words = nodes.sparkSession, nodes.columns
    counted = nodes.withColumn("bits", sum((F.bit_count(w) for w in words), F.lit(0)).cast("int"))
    histogram = {r["bits"]: r["count"] for r in counted.groupBy("bits").count().collect()}  # one row for each count of bits
    side = math.ceil(math.sqrt(6 * spark.sparkContext.defaultParallelism))
    groups, of = _groups(histogram, min(group_size, max(1024, -(-sum(histogram.values()) // side))))
    reach = [max(g[0] for g in groups if g[1] <= hi + radius) for _, _, hi, _ in groups]
    base = F.create_map(*[F.lit(x) for p, (g, _) in sorted(of.items()) for x in (p, g)]) if of else F.create_map(F.lit(0), F.lit(0))
    many = F.create_map(*[F.lit(x) for p, (_, k) in sorted(of.items()) for x in (p, k)]) if of else F.create_map(F.lit(0), F.lit(1))
    grouped = counted.withColumn("g", (F.element_at(base, F.col("bits")) + F.pmod(F.xxhash64(*words), F.element_at(many, F.col("bits")))).cast("int"))

    def blob(key: tuple, group: pa.Table) -> pa.Table:
        rows = np.column_stack([group.column(w).to_numpy() for w in words]).astype(np.int64)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "rows": pa.array([rows.tobytes()], pa.binary())})

    blobs = checkpointed(grouped.repartition(max(1, len(groups)), "g").groupBy("g").applyInArrow(blob, "g int, rows binary"))
    pairs = [(a, b) for a, last in enumerate(reach) for b in range(a, last + 1)]
    taking: dict[int, list[int]] = {}
    for number, (a, b) in enumerate(pairs):
        for g in {a, b}:
            taking.setdefault(g, []).append(number)
    dealt = spark.createDataFrame(sorted(taking.items()) or [(0, [0])], "g int, pairs array<int>")  # one row for each group
    sent = blobs.join(dealt.hint("merge"), "g").select("g", "rows", F.explode("pairs").alias("pair"))
    names = [f"{p}{k}" for p in "ab" for k in range(len(words))]

    def compare(group: pa.Table) -> pa.Table:
        two = sorted(zip(group.column("g").to_pylist(), group.column("rows")), key=lambda x: x[0])
        sides = [np.frombuffer(x.as_py(), np.uint64).reshape(-1, len(words)) for _, x in two]
        links = tile_forest(sides[0], sides[1] if len(sides) > 1 else None, radius)
        both = np.concatenate(sides)
        p, q = both[links[:, 0]].view(np.int64), both[links[:, 1]].view(np.int64)
        return pa.table([pa.array(np.ascontiguousarray(c)) for c in (*p.T, *q.T)], names=names)

    return sent.repartition(max(1, len(pairs)), "pair").groupBy("pair").applyInArrow(compare, ", ".join(f"{n} long" for n in names))


#: The share of similar pairs that may be missed for want of a common smallest hash.
MISSED = 1e-11
#: Sets that share a hash are compared pair by pair if they are no more than this; entries of a task.
BUCKET, ENTRIES = 2048, 1 << 19


def lows_of(similarity: float) -> int:
    """So many smallest hashes of each set are enough: the smallest ones of the union of two sets are in both with chance `similarity` each."""
    return 1 if similarity >= 1 else math.ceil(math.log(MISSED) / math.log(1 - similarity))


def bucket_forest(keys: np.ndarray, prints: np.ndarray, radius: int, bucket: int = BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (rows of two places) between fingerprints (rows of words) of equal keys within the radius, and the places of keys of more than `bucket` rows, which are not compared."""
    order = np.lexsort((prints[:, 0], keys)) if len(keys) else np.empty(0, np.int64)
    _, first, many = np.unique(keys[order], return_index=True, return_counts=True)
    hot = order[np.repeat(many > bucket, many)]
    end = np.repeat(np.where(many > bucket, 0, first + many), many)  # where a place's bucket ends
    root, links, held = np.arange(len(order)), [], 0

    def joined() -> np.ndarray:
        a, b = (np.concatenate(x) for x in zip(*links))
        return forest(root[a], root[b], len(root))[root]

    near, step = np.arange(len(order)), 1
    while len(near := near[near + step < end[near]]):
        for s in np.split(near, range(1 << 18, len(near), 1 << 18)):
            s = s[root[s] != root[s + step]]
            differ = np.bitwise_count(prints[order[s]] ^ prints[order[s + step]]).sum(axis=1, dtype=np.int64)
            s = s[differ <= radius]
            links.append((s, s + step))
            held += len(s)
        if held > 1 << 20:
            root, links, held = joined(), [], 0
        step += 1
    root = joined() if links else root
    inner = np.nonzero(root != np.arange(len(root)))[0]
    return np.column_stack([order[inner], order[root[inner]]]), hot


def near_set_links(sets: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a0, a1, ..., b0, b1, ...) between fingerprints within the radius of sets (f0, f1, ..., lows) that share one of their smallest hashes: a forest for each hash. The fingerprints of all hashes of more than `bucket` sets are compared by near_duplicate_links."""
    words = [c for c in sets.columns if c != "lows"]
    entries = sets.select(F.explode("lows").alias("key"), *words)
    parts = max(partitions(sets.sparkSession), -(-(sets.agg(F.coalesce(F.sum(F.size("lows")), F.lit(0))).first()[0]) // ENTRIES))
    names = [f"{p}{k}" for p in "ab" for k in range(len(words))]

    def search(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        prints = np.column_stack([whole.column(w).to_numpy() for w in words]).view(np.uint64)
        links, hot = bucket_forest(whole.column("key").to_numpy(), prints, radius, bucket)
        hot = np.unique(prints[hot], axis=0)
        a, b = (np.concatenate([prints[links[:, k]], hot]).view(np.int64) for k in range(2))
        for at in range(0, len(a), 1 << 16):
            columns = [pa.array(np.ascontiguousarray(c)) for c in (*a[at : at + (1 << 16)].T, *b[at : at + (1 << 16)].T)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(at, at + len(columns[0])) >= len(links))], [*names, "hot"])

    found = checkpointed(entries.repartition(parts, "key").mapInArrow(search, ", ".join(f"{n} long" for n in names) + ", hot boolean"))
    links = found.filter("NOT hot").select(*names).distinct()
    hot = found.filter("hot").select(*(F.col(f"a{k}").alias(w) for k, w in enumerate(words))).distinct()
    return links if hot.isEmpty() else links.unionAll(near_duplicate_links(checkpointed(hot), radius).select(*names))


def near_duplicates(df: DataFrame, radius: int = 2, shingle_words: int = 3, fingerprint_words: int = 1, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, raw, f0, f1, component_id and root (a fingerprint that names the component) for every row of df."""
    marked = checkpointed(fingerprints(df, shingle_words, fingerprint_words, distinct, id_col, text_col))
    nodes = checkpointed(marked.groupBy("f0", "f1").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    links = near_duplicate_links(nodes.select("f0", "f1"), radius)
    name = lambda p: F.struct(F.col(f"{p}0").alias("f0"), F.col(f"{p}1").alias("f1"))
    found = components(links.select(name("a").alias("a"), name("b").alias("b")))
    linked = found.select(F.col("node.f0").alias("f0"), F.col("node.f1").alias("f1"), "root").join(nodes, ["f0", "f1"])
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    in_groups = join_classes(linked.drop("n"), smallest, ["root"]).select("f0", "f1", "component_id", "root")
    classes = nodes.join(in_groups, ["f0", "f1"], "left").select("f0", "f1", "n", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", F.struct("f0", "f1")).alias("root"))
    return join_classes(marked, checkpointed(classes), ["f0", "f1"]).select("doc_id", "raw", "f0", "f1", "component_id", "root")


#: Words of the candidate search's fingerprint, and its radius. A pair at Jaccard 0.8 differs in 39 of 256 bits on
#: average (deviation 5.7), sets of 4 and 5 shingles in 48 (6.2); unrelated texts in 128 (8).
WORDS, RADIUS = 4, 76
#: Shingles in a block of sets.
BLOCK_SHINGLES = 1 << 18
#: The most bytes of the filter that tells which texts are involved; beyond some millions of texts it lets more others through, which cost a shuffle of their sets.
FILTER_BYTES = 8 << 20


def shingle_set(text: bytes, shingle_words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.array(shingle_hashes(text, shingle_words, SEED), np.uint64))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of independent hashes made from a hash (the finaliser of SplitMix64)."""
    h = h + np.uint64((k * 0x9E3779B97F4A7C15) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def set_prints(df: DataFrame, shingle_words: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, raw, s0 and s1 (a 128-bit hash of the shingle set), n (its size), fingerprint words f0, f1, ... and lows for every row.

    lows: the smallest hashes of the set, lows_of(similarity) or all that a set so similar must meet: of n hashes the first
    n - ceil(similarity n) + 1.
    """
    most = lows_of(similarity)

    def compute(batches):
        for b in small(batches):
            texts = bytes_of(b.column("text"))
            sets = [shingle_set(t, shingle_words) for t in texts]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            words = [_majority(_mixed(flat, k) if k else flat, sizes) for k in range(WORDS)]
            raw = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in texts), np.uint64, len(texts))
            of_set = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            taken = np.where(sizes > 0, np.minimum(most, sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1), 0)
            lows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(taken)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *(x[:k] for x, k in zip(sets, taken))]).view(np.int64)))
            longs = [np.ascontiguousarray(x) for x in (raw.view(np.int64), of_set[:, 0], of_set[:, 1], sizes, *(w.view(np.int64) for w in words))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, longs), lows], ["doc_id", "raw", "s0", "s1", "n", *(f"f{k}" for k in range(WORDS)), "lows"])

    return id_and_text(df, id_col, text_col).mapInArrow(compute, "doc_id long, raw long, s0 long, s1 long, n long, " + ", ".join(f"f{k} long" for k in range(WORDS)) + ", lows array<long>")


def jaccard_forest(sets: list[np.ndarray], similarity: float, split: int = 0) -> np.ndarray:
    """Links (rows of two places) that span the sets (sorted, of distinct values) whose Jaccard similarity is at least `similarity`; split: only between the first `split` sets and the others.

    Sets that are so similar share one of their rarest values: of n values, rarest first, the first n - ceil(similarity
    n) + 1. So only sets that meet there are counted, and those that are not joined yet.
    """
    m = len(sets)
    size = np.fromiter(map(len, sets), np.int64, m)
    flat = np.concatenate(sets) if m else np.empty(0, np.uint64)
    values, code, shared = np.unique(flat, return_inverse=True, return_counts=True)  # codes ascend within each set too
    owner, start = np.repeat(np.arange(m), size), np.cumsum(size) - size
    rare = code[np.lexsort((code, shared[code], owner))]
    early = np.where(size > 0, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, 0)
    place = np.arange(len(flat)) - np.repeat(start, size)
    held = np.nonzero((place < np.repeat(early, size)) & (owner >= split))[0]
    held = held[np.argsort(rare[held], kind="stable")]
    count = np.bincount(rare[held], minlength=len(values))
    first, holder = np.cumsum(count) - count, owner[held]
    root, links = np.arange(m), []

    def runs(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    for i in range(split or m):
        own = rare[start[i] : start[i] + early[i]]
        near = np.unique(holder[runs(first[own], count[own])])
        fits = np.minimum(size[near], size[i]) >= similarity * np.maximum(size[near], size[i]) - 1e-6
        near = near[fits & (root[near] != root[i]) & (near > i)]
        if not len(near):
            continue
        mine, theirs = code[start[i] : start[i] + size[i]], code[runs(start[near], size[near])]
        hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        common = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[near]) - size[near])
        alike = near[common / (size[near] + size[i] - common) >= similarity]
        _, one = np.unique(root[alike], return_index=True)  # one link for each component reached
        links += [(i, int(j)) for j in alike[one]]
        if len(alike):
            joined = np.append(root[alike], root[i])
            root[np.isin(root, joined)] = joined.min()
    return np.array(links, np.int64).reshape(-1, 2)


def _verified(df: DataFrame, involved: DataFrame, similarity: float, shingle_words: int, id_col: str, text_col: str) -> DataFrame:
    """Links (blocks, a0, a1, b0, b1) from shingle sets of involved(__id, __raw, comp, block, blocks, s0, s1) to the first set they reach in a pair of blocks of their comp."""
    spark = df.sparkSession
    keys = involved.select(F.xxhash64("__id", "__raw").alias("h1"), F.xxhash64("__raw", "__id").alias("h2"))
    wanted = spark.sparkContext.broadcast(bounded_filter(keys, FILTER_BYTES))
    keyed = id_and_text(df, id_col, text_col).select("text", *row_key(F.col("doc_id"), F.col("text")))
    hashed = keyed.select("__id", "__raw", F.xxhash64("__id", "__raw").alias("h1"), F.xxhash64("__raw", "__id").alias("h2"), "text")

    def sets(batches):
        """The shingle sets of rows that are involved, or seem to be: few texts leave their partition."""
        level = wanted.value
        for b in batches:
            if level is None or not b.num_rows:
                continue
            near = b.filter(pa.array(level.lets_through(b.column("h1").to_numpy(), b.column("h2").to_numpy(), 0)))
            for part in small([near]):
                own = [shingle_set(t, shingle_words).tobytes() for t in bytes_of(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__raw"), pa.array(own, pa.binary())], ["__id", "__raw", "own"])

    def blob(key: tuple, group: pa.Table) -> pa.Table:
        names = np.column_stack([group.column(c).to_numpy() for c in ("s0", "s1")]).astype(np.int64)
        _, one = np.unique(names, axis=0, return_index=True)
        own = group.column("own").take(pa.array(one)).to_pylist()
        columns = [pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), pa.array([group.column("blocks")[0].as_py()], pa.int32())]
        return pa.table([*columns, *(pa.array([x], pa.binary()) for x in (names[one].tobytes(), np.array(list(map(len, own)), np.int64).tobytes(), b"".join(own)))], names=["comp", "block", "blocks", "names", "sizes", "own"])

    made = hashed.mapInArrow(sets, "__id long, __raw long, own binary").join(involved.hint("merge"), ["__id", "__raw"]).select("comp", "block", "blocks", "s0", "s1", "own")
    blobs = checkpointed(made.groupBy("comp", "block").applyInArrow(blob, "comp long, block int, blocks int, names binary, sizes binary, own binary"))
    # Each block travels once to each pair of blocks that it is part of, itself included.
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("p"), F.greatest("block", k).alias("q")))
    sent = blobs.withColumn("pair", F.explode(others)).select("comp", "pair.p", "pair.q", "block", "blocks", "names", "sizes", "own")

    def compare(group: pa.Table) -> pa.Table:
        names, lists, ends = [], [], [0]
        for _, name, size, own in sorted(zip(group.column("block").to_pylist(), *(group.column(c) for c in ("names", "sizes", "own"))), key=lambda x: x[0]):
            names.append(np.frombuffer(name.as_py(), np.int64).reshape(-1, 2))
            cuts = np.cumsum(np.frombuffer(size.as_py(), np.int64) // 8)
            lists += np.split(np.frombuffer(own.as_py(), np.uint64), cuts[:-1])
            ends.append(len(lists))
        names, links = np.concatenate(names), jaccard_forest(lists, similarity, ends[1] if len(ends) > 2 else 0)
        root = forest(links[:, 0], links[:, 1], len(names))
        inner = np.nonzero(root != np.arange(len(names)))[0]
        p, q = names[inner], names[root[inner]]
        return pa.table([pa.array(np.full(len(inner), group.column("blocks")[0].as_py(), np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in (*p.T, *q.T))], names=["blocks", "a0", "a1", "b0", "b1"])

    return sent.repartition(partitions(spark), "comp", "p", "q").groupBy("comp", "p", "q").applyInArrow(compare, "blocks int, a0 long, a1 long, b0 long, b1 long")


def drop_near_duplicates(df: DataFrame, similarity: float = 0.8, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row of df, all columns, of each component: the one with the smallest id.

    Texts link if the Jaccard similarity of their sets of shingles is at least `similarity`, counted exactly. Candidates
    share one of their smallest hashes, which a pair at `similarity` fails to do once in 10^11 (sets of up to some 75
    shingles at 0.8 never), and have fingerprints within RADIUS, made for 0.8 and more: at 0.8 a pair lies beyond it once in 10^10, of sets of 4 and
    5 shingles once in 400,000; other texts cost counting but never link. Texts of so few
    shingles that one more is too many link only if their sets are equal; so do texts without a word.
    """
    prints = checkpointed(set_prints(df, shingle_words, similarity, id_col, text_col))
    words = [f"f{k}" for k in range(WORDS)]
    nodes = checkpointed(prints.groupBy("s0", "s1", "n", *words).agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "raw", "doc_id")).alias("first"), F.min("lows").alias("lows")))
    searched = nodes.filter(F.col("n") / (F.col("n") + 1) >= similarity)  # a smaller set is like no other, and its fingerprint lies near too many
    links = near_set_links(searched.select(*words, "lows"), RADIUS)
    found = components(links.select(F.xxhash64(*(f"a{k}" for k in range(WORDS))).alias("a"), F.xxhash64(*(f"b{k}" for k in range(WORDS))).alias("b")))  # equal hashes only cost counting
    near = searched.withColumn("node", F.xxhash64(*words)).join(found, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    several = near.groupBy("comp").agg(F.count("*").alias("many"), F.sum("n").alias("shingles")).filter("many > 1").select("comp", F.ceil(F.col("shingles") / block_shingles).cast("int").alias("blocks"))
    involved = checkpointed(near.join(several.hint("merge"), "comp").select(F.coalesce("first.doc_id", F.lit(NO_ID)).alias("__id"), F.col("first.raw").alias("__raw"), "comp", F.pmod(F.xxhash64("s0", "s1"), "blocks").cast("int").alias("block"), "blocks", "s0", "s1"))
    alike = checkpointed(_verified(df, involved, similarity, shingle_words, id_col, text_col).select("blocks", *(F.struct(F.col(f"{p}0").alias("s0"), F.col(f"{p}1").alias("s1")).alias(p) for p in "ab")))
    rootless = alike.filter("blocks > 1")  # only what took several blocks is left to join up
    roots = alike.filter("blocks = 1").select(F.col("a").alias("node"), F.col("b").alias("root"))
    if not rootless.isEmpty():
        roots = roots.unionAll(components(rootless.select("a", "b")))
    rooted = nodes.join(roots.select("node.s0", "node.s1", "root"), ["s0", "s1"], "left")
    first = rooted.groupBy(F.coalesce("root", F.struct("s0", "s1")).alias("root")).agg(F.min("first").alias("first"))
    return keep_rows(df, first.select(F.coalesce("first.doc_id", F.lit(NO_ID)).alias("__id"), F.col("first.raw").alias("__raw")), id_col, text_col)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), radius=2, shingle_words=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")
