"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, and clashing extra columns, for every operator and pipeline stage."""


import pytest

import corpus_pipeline
from topicloom.llm import exact_dedup, gif, mixing, packing, quality, queries, repair, secrets, sharding, simhash, tokens, url_filter

LONG = "word " * 30000
ROWS = [
    (1, "Hello World of words", "en", "src0", 5), (2, "hello world of WORDS", "en", "src0", 5), (None, None, None, None, None), (3, "", "", "", 0), (4, LONG, "de", "src1", 9), (4, LONG, "de", "src1", 9),
    (5, "é😀\x00 \t\n", "fr", "weird.source", 1), (6, None, "en", None, 2), (None, "no id here", None, "src2", 3), (5, "same id, other text", "fr", "src3", 4), (7, "x" * 70000, "en", "src0", 7),
]
#: Names that operators use for columns of their own.
CLASHING = ["row", "size", "shard", "slot", "key", "f0", "raw", "keep", "n", "upper", "m_tokens", "tokens", "weight", "base", "media", "bits", "part", "c0", "__id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def messy(spark, extra=True):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"x{i}") for i, c in enumerate(CLASHING)}) if extra else df


VOCAB = tokens.vocabulary()
OPERATORS = {
    "sharding": lambda df: sharding.shard_rows(df, 4),
    "packing": lambda df: packing.pack_documents(df),
    "token_files": lambda df: repair.read_documents(repair.write_shards(df, VOCAB, 1)),
    "simhash": lambda df: simhash.near_duplicates(df),
    "mixing": lambda df: mixing.mix(df),
    "quality": lambda df: quality.score_quality(df, quality.fit(*_examples())),
    "exact_dedup": lambda df: exact_dedup.exact_duplicates(df),
    "gif": lambda df: gif.described(gif.stored_frames(gif.store_texts(df))),
    "secrets": lambda df: secrets.scan_secrets(df),
}


def _examples():
    import numpy as np

    x = np.random.default_rng(0).random((60, len(quality.STATISTICS)))
    return x, (x[:, 0] > 0.5).astype(float)


@pytest.mark.parametrize("name", OPERATORS)
def test_messy_and_empty(spark, name):
    rows = OPERATORS[name](messy(spark)).toPandas()
    assert OPERATORS[name](messy(spark).limit(0)).count() == 0
    if name == "packing":
        assert rows.groupby(rows["doc_id"].fillna(-1))["length"].sum().min() >= 1 and rows["length"].max() == 4096
    else:
        assert len(rows) == len(ROWS)
        rows = rows.rename(columns={"m_id": "doc_id"})
        assert sorted(rows["doc_id"].fillna(-1).tolist()) == sorted(-1 if r[0] is None else r[0] for r in ROWS)
    if name == "exact_dedup":
        assert rows["kept"].sum() == 7  # 1 = 2, three empty texts, one repeated row
        assert rows[rows["doc_id"] == 1]["keep_id"].tolist() == [2]
    if name == "simhash":
        empty = rows[rows["f0"] == 0]
        assert set(empty["component_id"]) == {3} and len(empty) == 3
    if name == "token_files":
        assert rows["n_tokens"].min() == 1 and rows["start"].is_unique
    if name == "sharding":
        assert rows["row_no"].tolist() and sorted(rows["row_no"]) == list(range(len(ROWS)))


def test_urls(spark):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://EXAMPLE.com/en/x?q#f"), (5, "http://EXAMPLE.com/en/x?q#f"), (None, "x://a.b.NET/fr/"), (6, "http://www.example.com/en/"), (7, "http://notexample.com/en/"), (8, "http://com"), (9, "a://b://c/d"), (10, "http://example.com" + "/en/" + "y" * 50000), (11, "http://x.net?/es/")]
    df = spark.createDataFrame([(*u, "h", "p") for u in urls], "page_id long, url string, host string, path string")
    got = {(r["page_id"], r["url"]): r for r in url_filter.filter_urls(df).join(df.select("page_id", "url"), "page_id", "left").collect()}
    assert url_filter.filter_urls(df).count() == len(urls) and url_filter.filter_urls(df.limit(0)).count() == 0
    flat = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert flat[1] == flat[2] == flat[3] == flat[4] == ("", None, "allow") and got
    assert flat[5] == ("example.com", "example.com/en/", "block") and flat[None] == ("a.b.net", "net/fr/", "block")
    assert flat[6] == ("www.example.com", "www.example.com/en/", "allow") and flat[7] == ("notexample.com", "com/", "allow")
    assert flat[8] == ("com", None, "allow") and flat[9] == ("b:", None, "allow") and flat[10][2] == "block" and flat[11] == ("x.net", None, "allow")


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, data, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    df = messy(spark)
    out = f(spark, df, data)
    if stage != "packing":
        assert out.columns == df.columns
        assert all(out.filter(f"`{c}` <> 'x{i}'").count() == 0 for i, c in enumerate(CLASHING[:4]))
    rows = out.collect()
    assert f(spark, df.limit(0), data).count() == 0
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows)
    if stage == "exact_dedup":
        assert ids == [-1, 2, 4, 5, 5, 6, 7]
    if stage == "near_dedup":
        assert 3 in ids and 6 not in ids and ids.count(4) == 1
    if stage == "quality":
        from test_corpus_operators import plain_score

        model = fitted_on(spark, df, data)
        assert ids == sorted(-1 if r[0] is None else r[0] for r in ROWS if plain_score(model, r[1]) >= 0.3)
    if stage == "mixing":
        assert set(ids) <= {-1 if r[0] is None else r[0] for r in ROWS} and sum(len((r["text"] or "").encode()) // 4 + 1 for r in rows) <= 0.8 * sum(len((r[1] or "").encode()) // 4 + 1 for r in ROWS)
        assert ids.count(4) in (0, 2) and ids.count(5) in (0, 1, 2)  # rows that repeat an id in a leaf go together
    if stage == "packing":
        assert {-1 if r[0] is None else r[0] for r in ROWS} == set(ids)
        want = sorted(len(x) + 1 for x in tokens.encoder(VOCAB).encode(__import__("pyarrow").array([r[1] for r in ROWS])))
        assert sum(want) == sum(r["length"] for r in rows) and sorted(r["doc_tokens"] for r in rows if r["start"] == 0) == want


def fitted_on(spark, df, data):
    return quality.train(quality.id_and_text(df, "doc_id", "text"), spark.read.parquet(f"{data}/labels.parquet"))


def test_labels_missing(spark):
    docs = messy(spark, extra=False)
    none = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, none).rules == ()
    assert quality.score_quality(docs, quality.train(docs, none.limit(0))).count() == len(ROWS)


def mixed_by_hand(docs, plan):
    """The ids that the mixing stage takes of docs (doc_id: text, lang, source): budgets shared out by exact fractions, level by level, then prefixes."""
    import hashlib
    from fractions import Fraction

    tokens = {d: len((t or "").encode()) // 4 + 1 for d, (t, _, _) in docs.items()}
    leaf = {d: (f"domain{int(s[3:]) % 4}" if s and s[:3] == "src" and s[3:].isdigit() else "other", lang or "", s or "") for d, (_, lang, s) in docs.items()}
    capacity = {}
    for d, path in leaf.items():
        for k in (1, 2, 3):
            capacity[path[:k]] = capacity.get(path[:k], 0) + tokens[d] * plan.max_epochs

    def share(parent, budget, weights):
        open_ = {p: weights.get(p[-1], plan.default) for p in capacity if len(p) == len(parent) + 1 and p[: len(parent)] == parent}
        parts = {}
        while open_:
            level = budget / sum(open_.values())
            full = [p for p, w in open_.items() if capacity[p] <= level * w]
            if not full:
                return parts | {p: level * w for p, w in open_.items()}
            for p in full:
                parts[p] = Fraction(capacity[p])
                budget -= capacity[p]
                del open_[p]
        return parts

    taken = {}
    total = int(sum(tokens.values()) * plan.share)
    for domain, own in share((), Fraction(total), plan.domains).items():
        for lang, below in share(domain, own, plan.languages).items():
            for path, budget in share(lang, below, plan.sources).items():
                mine = [d for d in leaf if leaf[d] == path]
                whole = min(int(budget) // sum(tokens[d] for d in mine), plan.max_epochs)
                rest = int(budget) - whole * sum(tokens[d] for d in mine) if whole < plan.max_epochs else 0
                used = 0
                for d in sorted(mine, key=lambda d: hashlib.md5(f"{plan.seed}:{whole}:{d}".encode()).hexdigest()):
                    used += tokens[d]
                    taken[d] = whole + (used <= rest)
    return taken


def test_pipeline_against_brute_force(spark, data):
    """Every stage's result on the whole small corpus is computed again by hand from its own input."""
    import duckdb
    import numpy as np
    import pyarrow as pa
    from test_corpus_operators import fitted, library_ids, plain_score

    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    held = {r["doc_id"]: r for r in docs.collect()}
    low = lambda s: (s or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    def step(name, want):
        nonlocal docs, held
        docs = corpus_pipeline.stored(stages[name](spark, docs, data), "by-hand")
        got = docs.collect()
        assert docs.columns == names and sorted(r["doc_id"] for r in got) == sorted(want), name
        assert all(r == held[r["doc_id"]] for r in got)
        assert 0 < len(want) < len(held), name
        held = {r["doc_id"]: r for r in got}

    model = fitted(spark, data)
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{data}/labels.parquet'").fetchall())
    step("quality", [d for d, r in held.items() if plain_score(model, r["text"]) >= 0.3])
    assert all(labels.get(d, 1) for d in held)
    last = {}
    for d in sorted(held):
        last[low(held[d]["text"])] = d
    step("exact_dedup", list(last.values()))
    step("near_dedup", list(_first_of_components({d: r["text"] for d, r in held.items()})))
    step("mixing", [d for d, n in mixed_by_hand({d: (r["text"], r["lang"], r["source"]) for d, r in held.items()}, corpus_pipeline.MIX).items() if n])

    out = stages["packing"](spark, docs, data).toPandas()
    ids = dict(zip(held, library_ids([r["text"] or "" for r in held.values()], 2)))
    for d, own in out.sort_values("start").groupby("doc_id"):
        cuts = np.append(own["start"].to_numpy(), len(ids[d]))
        assert cuts[0] == 0 and own["length"].tolist() == np.diff(cuts).tolist()
        assert own["ids_crc32"].tolist() == [__import__("zlib").crc32(ids[d][a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
    assert set(out["doc_id"]) == set(ids) and pa.array(out["sequence_id"]).null_count == 0
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 4096
        assert len(own) <= packing.SEGMENTS and own["loss"].sum() <= packing.LOSS
    run = corpus_pipeline.run(spark, data).toPandas()
    key = ["doc_id", "start"]
    assert run.sort_values(key, ignore_index=True).equals(out.sort_values(key, ignore_index=True))


def test_registered_queries_read_all(spark, data):
    assert list(queries.QUERIES) == ["op1_sharding", "op2_url_filter", "op3_packing", "op4_token_files", "op5_simhash", "op6_mixing", "op7_quality", "op8_exact_dedup", "op9_gif", "op10_secrets", "op11_merkle", "op12_periodic", "op13_suffix_dedup"]


def _shingle_set(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _first_of_components(texts):
    """The smallest id of each component of texts whose shingle sets have a Jaccard similarity of 0.8 or more."""
    sets = {i: _shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return set(root.values())


def _edited(rng):
    """Texts of 60 to 300 words and copies with some words in a row replaced: similarities from 0.6 to 1."""
    texts = {}
    for k in range(25):
        words = [f"w{rng.integers(5000)}" for _ in range(int(rng.integers(60, 300)))]
        for copy in range(8):
            n = int(len(words) * rng.uniform(0, 0.22)) if copy else 0
            at = int(rng.integers(0, len(words) - n))
            texts[10 * k + copy] = " ".join([*words[:at], *(f"z{rng.integers(5000)}" for _ in range(n)), *words[at + n :]])
    return texts


@pytest.mark.parametrize("block", [simhash.BLOCK_SHINGLES, 500] if hasattr(simhash, "BLOCK_SHINGLES") else [None])
def test_near_dedup_drops_by_jaccard(spark, data, block):
    """Neither misses nor wrong drops at 0.8, also where a component takes several blocks."""
    import duckdb
    import numpy as np

    texts = _edited(np.random.default_rng(1))
    texts |= {1000 + i: t for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    out = simhash.drop_near_duplicates(docs, block_shingles=block) if block == 500 else corpus_pipeline.near_dedup(spark, docs, data)
    kept = [r["doc_id"] for r in out.collect()]
    assert len(set(kept)) == len(kept) and set(kept) == _first_of_components(texts)


def test_near_dedup_of_short_texts(spark, data):
    """Unrelated texts of 0, 1, 2 and 4 shingles stay apart, also beside an empty one; of 4 and 5 shingles those at 0.8 meet."""
    import numpy as np

    rng = np.random.default_rng(2)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    texts = dict(enumerate([words(n) for n in [5] * 50 + [6] * 400 + [8] * 300]))
    texts |= {1000 + i: f"{texts[450 + i]} more" for i in range(100)} | {2000: "", 2001: None, 2002: " \n"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, data).collect())
    assert kept == [*range(750), 2000]
