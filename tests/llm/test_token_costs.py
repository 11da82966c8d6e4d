"""What tokens and token files cost: only open places are looked at, and known pieces take little room."""

import numpy as np
import pyarrow as pa

from topicloom.llm import exact_dedup, repair, tokens


def _most_frequent(symbols, last):
    """How often the most frequent pair of neighbours can be replaced."""
    counts, overlaps = {}, False
    for a, b, end in zip(symbols[:-1].tolist(), symbols[1:].tolist(), last[:-1].tolist()):
        if end or (a == b and overlaps):
            overlaps = False
            continue
        overlaps = a == b
        counts[a, b] = counts.get((a, b), 0) + 1
    return max(counts.values(), default=0)


def test_repair_looks_at_open_places_only(monkeypatch):
    rng, looked = np.random.default_rng(3), []
    slots = repair._slots
    monkeypatch.setattr(repair, "_slots", lambda pairs, bits: (looked.append(len(pairs)), slots(pairs, bits))[1])
    n = 60_000
    phrases = [rng.integers(0, 5000, int(rng.integers(2, 9))) for _ in range(4000)]
    ids = np.concatenate([phrases[k] for k in np.minimum(rng.zipf(1.4, n // 2), 4000) - 1])[:n].astype(np.uint32)
    n = len(ids)
    ends = np.arange(n) % 500 == 499
    symbols, rounds, last = repair.compress(ids, ends)
    assert len(rounds) > 8 and sum(looked) < 0.6 * n * len(rounds)
    assert _most_frequent(symbols, last) < repair.LEAST


def test_repair_ends_when_no_pair_is_left():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, least = int(rng.integers(1, 300)), int(rng.integers(2, 9))
        ids, ends = rng.integers(0, int(rng.integers(1, 6)), n).astype(np.uint32), rng.random(n) < 0.05
        ends[-1] = True
        symbols, _, last = repair.compress(ids, ends, least)
        assert _most_frequent(symbols, last) < least and last.sum() == ends.sum()
        docs = np.split(ids, np.nonzero(ends)[0][:-1] + 1)
        shard = repair.Shard(repair.pack_shard(list(range(len(docs))), docs))
        assert (shard.all_tokens() == ids).all() and shard.doc_tokens.tolist() == list(map(len, docs))


def test_repair_groups_a_place_again_only_where_its_pair_changes(monkeypatch):
    rng, looked = np.random.default_rng(4), []
    slots = repair._slots
    monkeypatch.setattr(repair, "_slots", lambda pairs, bits: (looked.append(len(pairs)), slots(pairs, bits))[1])
    n = 60_000
    phrases = [rng.integers(0, 5000, int(rng.integers(2, 9))) for _ in range(4000)]
    ids = np.concatenate([phrases[k] for k in np.minimum(rng.zipf(1.4, n // 2), 4000) - 1])[:n].astype(np.uint32)
    ends = np.arange(n) % 500 == 499
    symbols, rounds, _ = repair.compress(ids, ends)
    # All places once, some places of what is left again, and two for each symbol that a replacement takes away.
    assert sum(looked) < n + 4 * len(symbols) + 2 * (n - len(symbols)) < len(rounds) * n / 2


def _expand(symbols, rounds, base):
    rules = np.concatenate([np.empty((0, 2), np.uint32), *rounds]).tolist()
    out, stack = [], symbols.tolist()[::-1]
    while stack:
        s = stack.pop()
        if s < base:
            out.append(s)
        else:
            stack += rules[s - base][::-1]
    return out


def test_repair_of_ids_too_wide_for_exact_slots(monkeypatch):
    slots, rng = repair._slots, np.random.default_rng(5)
    few = lambda pairs, bits: ((slots(pairs, bits)[0] % 7), False)  # noqa: E731  pairs that share slots
    for patched in (slots, few):
        monkeypatch.setattr(repair, "_slots", patched)
        for kinds in (1, 2, 5, 30):
            n, base = int(rng.integers(2000, 4000)), (1 << 32) - (1 << 20)
            ids = (base - 1 - rng.integers(0, kinds, n)).astype(np.uint32)
            ids[0] = base - 1
            ends = rng.random(n) < 0.02
            ends[-1] = True
            symbols, rounds, last = repair.compress(ids, ends, 3)
            assert _expand(symbols, rounds, base) == ids.tolist() and last.sum() == ends.sum()
            assert _most_frequent(symbols, last) < 3
            rules = np.concatenate(rounds)
            assert len(np.unique(rules, axis=0)) == len(rules)


def test_known_pieces_take_little_room(monkeypatch):
    enc, rng = tokens.Encoder(tokens.vocabulary()), np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghijklmnopé"), int(rng.integers(3, 22)))) for _ in range(40_000)]
    enc.encode(pa.array([" ".join(words)]))
    held = enc.low.nbytes + enc.high.nbytes + enc.span.nbytes + enc.flat.nbytes
    assert held < 250 * len(set(words)) and len(enc.long) < 0.5 * len(words)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 1000)
    monkeypatch.setattr(tokens, "CHUNK_PIECES", 700)  # starts anew in the midst of a text
    texts = [" ".join(words[i : i + 900]) + " x1 it'sİ éÈ" for i in range(0, 9000, 900)]
    want = enc.tokenizer.encode_batch(texts, add_special_tokens=False)
    plain = [" ".join(words[i : i + 900]) for i in range(0, 9000, 900)]
    for got, right in ((enc.encode(pa.array(texts)), want), (enc.encode(pa.array(plain)), enc.tokenizer.encode_batch(plain, add_special_tokens=False))):
        assert [x.tolist() for x in got] == [x.ids for x in right]
    assert enc.kept < 4000


def test_one_python_worker_behind_a_task(spark):
    """The last round of the merge gives the entries itself: a second Python operator in its stage would hold a second worker for each core."""
    df = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id long, text string").repartition(4)
    marked = exact_dedup.checkpointed(exact_dedup.digests(df))
    settled = exact_dedup.tree_merge(marked, fan_in=2)
    assert "MapInArrow" not in settled._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["n"] for r in settled.collect()) == [5, 5, 6, 6, 6, 6, 6]
