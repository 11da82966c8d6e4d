"""Merkle manifest, periodic runs and repeated bytes against brute force, on given tables, random texts and messy rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from topicloom.llm import factors, merkle, periodic, queries, suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30000
ROWS = [
    (1, "Hello World of words", "en", "src0", 5), (None, None, None, None, None), (3, "", "", "", 0), (4, LONG, "de", "src1", 9), (4, LONG, "de", "src1", 9),
    (5, "é😀\x00 \t\n", "fr", "weird.source", 1), (6, None, "en", None, 2), (None, "no id here", None, "src2", 3), (5, "same id, other text", "fr", "src3", 4), (7, "x" * 70000, "en", "src0", 7),
]
CLASHING = ["tree", "node", "pos", "block", "witness", "root", "runs", "spans", "own", "h1", "__raw", "kept", "leaf"]


def messy(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumns({c: F.lit(f"x{i}") for i, c in enumerate(CLASHING)})


def documents(data, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{data}/documents.parquet' ORDER BY doc_id").fetchall()


# -- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """(root, for each leaf a list of levels, each the run's nodes and the own place)."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for k, p in enumerate(paths):
            p.append((runs[at[k] // 3], at[k] % 3))
        level, at = [h(*r) for r in runs], [x // 3 for x in at]
    return level[0], paths


def plain_manifest(rows):
    """doc_id, leaf, subroot, root and path of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order]
    root, tops = plain_tree([t[0] for t in trees])
    out = []
    for g, (subroot, paths), top in zip(order, trees, tops):
        for (_, _, leaf, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), paths):
            out.append((r, leaf, subroot, root, path + top))
    return out


def plain_fold(node, path):
    for run, k in path:
        node = h(*run[:k], node, *run[k + 1 :])
    return node


def plain_op11(rows):
    out = []
    for r, leaf, subroot, root, path in plain_manifest(rows):
        seen = plain_leaf((*r[:4], None if r[4] is None else r[4].replace("\n", ""))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else leaf
        end = plain_fold(seen, path)
        out.append((r[0], leaf, subroot, root, h(*(x for run, k in path for i, x in enumerate(run) if i != k)), end, end == root))
    return sorted(out, key=str)


def test_op11(spark, data):
    got = sorted((tuple(r) for r in queries.QUERIES["op11_merkle"](spark, data).collect()), key=str)
    assert got == plain_op11(documents(data, "doc_id, source, lang, n_chars, text"))
    assert {r[-1] for r in got} == {True, False}


def manifest_rows(df, **kw):
    return sorted(((r["m_id"], r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(), bytes(r["witness"])) for r in merkle.manifest(df, **kw).collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_of_several_rounds(spark, levels):
    """Blocks of 3 or 9 leaves, so that a group takes several rounds of appends; one group holds most rows, groups of 1 to 28."""
    rng = random.Random(levels)
    rows = [(i, rng.choice(["hot"] * 5 + ["a", "b", None, ""]), None, i % 3, rng.choice(["x", "y\nz", None])) for i in range(170)]
    rows += [(1000 + 100 * n + i, f"g{n}", "l", 1, "t") for n in (1, 2, 3, 4, 9, 10, 27, 28) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = {x[0]: x for x in manifest_rows(df, levels=levels, hot_rows=10)}
    want = plain_manifest(rows)
    assert len(got) == len(want)
    for r, leaf, subroot, root, path in want:
        assert got[r[0]][1:4] == (leaf, subroot, root)
        witness = got[r[0]][4]
        assert [(k, [s.hex() for s in own]) for k, own in merkle.steps(witness)] == [(k, run[:k] + run[k + 1 :]) for run, k in path]
        assert merkle.folded(bytes.fromhex(leaf), witness).hex() == root
        assert not path or merkle.folded(bytes(32), witness).hex() != root


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27])
def test_appender(n):
    """Witnesses made append by append equal those of the finished tree."""
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    a = merkle.Appender(3)
    for x in leaves:
        a.append(x)
    root, witnesses = a.closed(alone=True)
    want, paths = plain_tree([x.hex() for x in leaves])
    assert root.hex() == want and [len(list(merkle.steps(w))) for w in witnesses] == [len(p) for p in paths]
    assert all(merkle.folded(x, w) == root for x, w in zip(leaves, witnesses))


def test_manifest_of_messy_rows(spark):
    got = manifest_rows(messy(spark))
    want = sorted((r[0], leaf, subroot, root) for r, leaf, subroot, root, _ in plain_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in ROWS]) if r[0] is not None)
    assert sorted(x[:4] for x in got if x[0] is not None) == want and len(got) == len(ROWS)
    assert merkle.audited(merkle.manifest(messy(spark).limit(0), seen=merkle.F.lit(None).cast("binary"))).count() == 0


# -- periodic runs


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def plain_runs(w, least=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q) and smallest_period(w[i : j + q]) == q:
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_op12(doc_id, text):
    words = words_of(text)
    n, crc = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and crc % 10 == 0 and n:
        g = crc // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in dropped))


def test_op12(spark, data):
    got = {r[0]: tuple(r) for r in queries.QUERIES["op12_periodic"](spark, data).collect()}
    want = [plain_op12(*r) for r in documents(data, "doc_id, text") if len(words_of(r[1])) < 3000]
    assert len(got) == len(documents(data, "doc_id")) and len(want) > 150
    for w in want:
        assert got[w[0]] == w
    assert sum(w[1] > 0 for w in want) > 15


def test_find_runs():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randrange(1, 4)):
            own = []
            while len(own) < rng.choice([0, 5, 6, 24, 90]):
                own += [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(1, 9))] * rng.choice([1, 2, 4, 5, 8])
                own = own[: len(own) - rng.randrange(3)] or [0]
            texts.append(own)
        bounds = np.cumsum([0, *map(len, texts)])
        got = periodic.find_runs(np.array([k << 32 | x for k, own in enumerate(texts) for x in own], np.int64), bounds)
        want = [(s + b, s + n + b, q) for own, b in zip(texts, bounds.tolist()) for s, n, q in plain_runs(own)]
        assert [tuple(r) for r in got.tolist()] == want
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(9, np.int64), np.array([0, 9]), exponent=3)


def test_periodic_runs_of_messy_rows(spark):
    got = periodic.periodic_runs(messy(spark)).collect()
    assert len(got) == len(ROWS)
    long = [r for r in got if r["doc_id"] == 4]
    assert len(long) == 2 and all([tuple(x) for x in r["runs"]] == [(0, 30000, 1)] and r["collapsed"] == "word" for r in long)
    assert all(not r["runs"] for r in got if r["doc_id"] != 4)
    assert sorted(r["collapsed"] for r in got if r["doc_id"] in (1, 3, 6, None)) == sorted(["Hello World of words", "", "", "", "no id here"])
    assert periodic.periodic_runs(messy(spark).limit(0)).count() == 0
    mixed = periodic.periodic_runs(spark.createDataFrame([(1, "a b a b a b a b c é é é é é é")], "doc_id long, text string")).first()
    assert [tuple(x) for x in mixed["runs"]] == [(0, 8, 2), (9, 6, 1)] and mixed["collapsed"] == "a b c é"


# -- repeated bytes


def plain_repeats(rows, width=100):
    """n_bytes, n_removed, n_spans and digest of what is kept, for each row; rows with an id more than once must be alike."""
    first, out = {}, {}
    for i, text in sorted(((-1 << 70 if i is None else i), (t or "").encode()) for i, t in rows):
        marks, last = bytearray(len(text)), 0
        for p in range(len(text) - width + 1):
            w = text[p : p + width]
            if first.setdefault(w, (i, p)) != (i, p):
                a = max(p, last)
                marks[a : p + width] = b"\1" * (p + width - a)
                last = p + width
        spans = sum(m and not (k and marks[k - 1]) for k, m in enumerate(marks))
        out[i] = (len(text), sum(marks), spans, hashlib.sha256(bytes(c for c, m in zip(text, marks) if not m)).hexdigest())
    return sorted(((i, *out[-1 << 70 if i is None else i]) for i, _ in rows), key=str)


def removed(df, **kw):
    return sorted((tuple(r) for r in suffix.remove_repeats(df, keep_text=False, **kw).collect()), key=str)


def test_op13(spark, data):
    got = sorted((tuple(r) for r in queries.QUERIES["op13_suffix_dedup"](spark, data).collect()), key=str)
    want = plain_repeats(documents(data, "doc_id, text"))
    assert got == want and sum(w[2] for w in want) > 10_000


@pytest.mark.parametrize("limits", [{}, {"hot_segments": 3, "block_bytes": 3000, "slice_bytes": 5000}])
@pytest.mark.parametrize("run_hot", [256, 2])
def test_repeats_of_random_texts(spark, monkeypatch, limits, run_hot):
    """Pieces of a few texts, periodic stretches, several slices and blocks, hot anchors in a run and over all."""
    monkeypatch.setattr(suffix, "RUN_HOT", run_hot)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd ") for _ in range(400)) for _ in range(6)]
    rows = []
    for k in range(240):
        text = ""
        while rng.random() < 0.8:
            b, i = rng.choice(base), rng.randrange(300)
            text += b[i : i + rng.randrange(20, 260)] + rng.choice(["", "x", "é" * rng.randrange(30), "z" * rng.randrange(900), "ab" * rng.randrange(90)])
        rows.append((k, rng.choice([text, text, text, None, "short"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_repeats(rows)
    assert removed(df, **limits) == want and sum(w[2] for w in want) > 20_000


def test_common_line_in_new_surroundings(spark):
    """A line too short to be removed, but an anchor of very many segments; and one that is removed."""
    rng = random.Random(8)
    fresh = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(k, fresh(150) + "= this line of sixty bytes stands in each text once or twice =" + fresh(rng.randrange(30, 150)) + ("-" * 130 if k % 3 == 0 else "")) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert removed(df, hot_segments=20) == plain_repeats(rows) == removed(df)


def test_repeats_of_messy_rows(spark):
    got = removed(messy(spark))
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r)
    assert len(got) == len(ROWS) and len(by[None]) == 2 and len(by[5]) == 2
    assert by[4] == [plain_repeats([(4, LONG)])[0]] * 2  # rows that repeat id and text are the same document
    assert by[7] == plain_repeats([(7, "x" * 70000)]) and by[7][0][2] == 69999
    assert removed(messy(spark).limit(0)) == []
    kept = {r["doc_id"]: r["kept"] for r in suffix.remove_repeats(spark.createDataFrame([(2, "ab" * 60 + "q"), (1, "ab" * 60), (3, None)], "doc_id long, text string")).collect()}
    assert kept == {1: "ab", 2: "q", 3: ""}
    same_id = [(1, "a" * 60 + "b" * 90), (1, "b" * 90 + "a" * 60 + "b" * 90), (2, "a" * 60 + "b" * 90)]
    one = removed(spark.createDataFrame(same_id, "doc_id long, text string"))
    assert one == removed(spark.createDataFrame(same_id[::-1], "doc_id long, text string")) and one[-1][2] == 150


def test_longest_previous_factor():
    rng = random.Random(2)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))) for _ in range(4)]
        flat = b"".join(texts)
        rest = np.concatenate([np.arange(len(t), 0, -1) for t in texts])
        order = np.array(rng.sample(range(len(flat)), len(flat)))
        length, source = suffix.longest_previous_factor(np.frombuffer(flat, np.uint8), rest, np.arange(len(flat)), order)
        for i in range(len(flat)):
            alike = lambda j, i=i: next((k for k in range(min(rest[i], rest[j])) if flat[i + k] != flat[j + k]), min(rest[i], rest[j]))
            assert length[i] == max((alike(j) for j in range(len(flat)) if order[j] < order[i]), default=0)
            assert length[i] == 0 or (order[source[i]] < order[i] and alike(source[i]) == length[i])


def test_segments_hold_each_window_once():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(400))) for _ in range(30)] + ["z" * 2000]
    flat, at = suffix.flat_utf8(pa.array(texts))
    anchor, start, stop, again = suffix.segments(flat, at)
    windows = sorted(p for a, z in zip(start, stop) for p in range(a, z - 99))
    assert windows == [at[k] + i for k, t in enumerate(texts) for i in range(len(t) - 99)]
    assert (stop - start).max() <= suffix.SEGMENT_WINDOWS + 99 and again[-1]


def test_factor_numbers():
    symbols = np.array([1, 2, 1, 2, 1, 3, 1, 2])
    names = factors.repeated_factors(symbols, np.arange(8, 0, -1))
    assert names[0][0] == names[0][2] >= 0 and names[0][5] == -1 and names[1][0] == names[1][2] == names[1][6] >= 0
    assert factors.common_extension(names, np.array([0, 0]), np.array([2, 6])).tolist() == [3, 2]
