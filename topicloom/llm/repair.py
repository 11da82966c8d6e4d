"""Token files: Re-Pair grammar compression of token ids, shard by shard, with random access.

A shard holds the ids of consecutive documents in id order, at most about `shard_tokens` of them. It is compressed in
rounds: the pairs of neighbouring symbols are counted over the whole shard, those at least about a quarter as frequent
as the most frequent one become nonterminals together, and their occurrences are replaced, the more frequent pair's
first where two overlap. Rounds go on until no pair occurs LEAST times; a rule for rarer ones takes more room than it
saves, as it also widens the numbers of all symbols. No rule crosses the end of a document. Later rounds also pair
nonterminals, so rules nest. A shard stores

    magic, counts | rules of each round | rules (left, right) | expansion length of every nonterminal
    | documents (id, symbols, ids) | symbols

all little-endian, rules and symbols in as many bits as the largest symbol needs. From the documents' lengths a reader
finds the documents that cover a token position, and from the expansion lengths the symbols in them, without reading or
expanding what lies before (`Shard.tokens`).

Shards are rows of a Parquet table in the shared folder, so a task that is lost and run again leaves no half file.
Null texts count as empty and keep their end id. Null ids come first; rows that repeat an id are ordered by a hash of
the text. An empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

import struct
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, partitions, small, stored, table
from .tokens import SLICE_BYTES, encoder, vocabulary

MAGIC = b"RPAIR2\0\0"
_HEAD = struct.Struct("<8sIIIIII")
SHARD = "part int, first_token long, n_tokens long, n_documents int, payload binary"
#: Pairs that occur less often get no rule: files are smallest so (README).
LEAST = 8
#: Pairs that are up to so many times rarer than the most frequent one are replaced with it.
STEP = 4


def _slots(pairs: np.ndarray, bits: int) -> tuple[np.ndarray, bool]:
    """A number of `bits` bits for every pair, and whether different pairs have different ones: the pair itself where it fits, else a hash."""
    if int(pairs.max(initial=0)) >> bits == 0:
        return pairs.view(np.int64), True
    return (pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64), False


def _grouped(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs, equal pairs together and ascending within, and how many each kind of pair has."""
    low = max(1, len(pairs).bit_length())
    slots, differ = _slots(pairs, 63 - low)
    keys = np.sort(slots << low | np.arange(len(pairs)))
    order, ends = keys & (1 << low) - 1, (keys[1:] ^ keys[:-1]) >> low != 0
    if not differ:
        own = pairs[order]
        if np.count_nonzero(own[1:] != own[:-1]) > np.count_nonzero(ends):  # two kinds share a slot
            order = np.argsort(pairs, kind="stable")
            own = pairs[order]
            ends = own[1:] != own[:-1]
    return order, np.diff(np.concatenate([[-1], np.nonzero(ends)[0], [len(pairs) - 1]]))


class _Groups:
    """Places by the pair that begins there. Only pairs that occur `least` times have a group; group 0 holds nothing.

    A group's places are listed when it is made. It only loses places, so a listed place may be in another one by now.
    A pair is a number, its right symbol in the `width` lowest bits.
    """

    def __init__(self, n: int, least: int, width: int):
        self.least, self.width, self.of, self.listed = least, np.uint64(width), np.zeros(n + 1, np.int64), np.empty(2 * n + 1, np.int64)
        self.clear()

    def clear(self) -> None:
        self.of[:] = 0
        self.held, self.pair, self.first, self.size, self.used = np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64), 0

    def add(self, at: np.ndarray, pairs: np.ndarray, following: np.ndarray) -> None:
        """Makes groups of places (ascending) that are in none."""
        if not len(at):
            return
        order, size = _grouped(pairs)
        often = size >= self.least
        order, size = order[np.repeat(often, size)], size[often]
        pair = pairs[order[np.cumsum(size) - size]]
        group, places = np.repeat(np.arange(len(size)), size), at[order]
        left, right = self.symbols(pair)
        same = np.nonzero((left == right)[group])[0]
        if len(same):  # such a pair overlaps itself: of a run every other one can be replaced
            begins = np.append(True, places[same[1:]] != following[order[same[:-1]]])
            fits = np.ones(len(places), bool)
            fits[same[(np.arange(len(same)) - np.nonzero(begins)[0][np.cumsum(begins) - 1]) % 2 == 1]] = False
            group, places = group[fits], places[fits]
            size = np.bincount(group, minlength=len(size))
        self.of[places] = len(self.held) + group
        while self.used + len(places) > len(self.listed):
            self.listed = np.resize(self.listed, 2 * len(self.listed))
        self.listed[self.used : self.used + len(places)] = places
        self.first = np.concatenate([self.first, self.used + np.cumsum(size) - size])
        self.held, self.size, self.pair, self.used = np.concatenate([self.held, size]), np.concatenate([self.size, size]), np.concatenate([self.pair, pair]), self.used + len(places)

    def symbols(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return pairs >> self.width, pairs & ((np.uint64(1) << self.width) - np.uint64(1))

    def overlap(self, places: np.ndarray) -> bool:
        """Whether any of the places is in a group whose pair overlaps itself."""
        left, right = self.symbols(self.pair)
        return bool((left == right)[self.of[places]][self.of[places] > 0].any())

    def drop(self, places: np.ndarray) -> None:
        self.held -= np.bincount(self.of[places], minlength=len(self.held))
        self.held[0] = 0
        self.of[places] = 0

    def frequent(self) -> np.ndarray:
        """Groups with at least a STEP-th as many places as the fullest one, and `least`, the fullest first. Of a pair that has several the others wait."""
        chosen = np.nonzero(self.held >= max(self.least, int(self.held.max()) // STEP))[0]
        chosen = chosen[np.lexsort((self.pair[chosen], -self.held[chosen]))]
        return chosen[np.sort(np.unique(self.pair[chosen], return_index=True)[1])]

    def places(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of some groups, ascending, and which of these groups each is in."""
        size = self.size[groups]
        ends, which = np.cumsum(size), np.repeat(np.arange(len(groups)), size)
        at = self.listed[np.repeat(self.first[groups] - ends + size, size) + np.arange(ends[-1])]
        mine = self.of[at] == groups[which]
        low = len(groups).bit_length()
        keys = np.sort(at[mine] << low | which[mine])
        return keys >> low, keys & (1 << low) - 1


def compress(ids: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(symbols, rules of each round, whether a symbol ends a document) of the ids; ends: True at the last id of each document.

    Symbols stay where they are and name the places of their neighbours in the document (n: none). A round looks only
    at the places of the most frequent pairs and beside them: pairs that a replacement makes are grouped among
    themselves. When no group is left, all places are grouped once more, unless since the last time no rule was used
    again and no run of equal symbols was cut: other pairs are whole in their groups, or made rarer.
    """
    n, names = len(ids), int(ids.max()) + 1 if len(ids) else 1
    symbols, rounds = np.append(ids, 0).astype(np.uint32), []
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[:n][ends] = n
    before[1:][ends] = n
    before[:1] = n
    kept, groups, whole = np.arange(n + 1) < n, _Groups(n, least, min(32, (names + n).bit_length())), False
    known, named = np.empty(0, np.uint64), np.empty(0, np.int64)  # pairs that have a rule, ascending, and their nonterminals

    def group(at):
        following = after[at]
        groups.add(at, symbols[at].astype(np.uint64) << groups.width | symbols[following], following)

    while True:
        chosen = groups.frequent()
        if not len(chosen):
            if whole:
                break
            groups.clear()
            group(np.nonzero(kept & (after < n))[0])
            whole = True
            continue
        # The more frequent pair goes first where two overlap.
        where, rule = groups.places(chosen)
        close = where[1:] == after[where[:-1]]
        taken = np.ones(len(where), bool)
        taken[1:] &= ~close | (rule[1:] < rule[:-1])
        taken[:-1] &= ~close | (rule[:-1] < rule[1:])
        where, rule = where[taken], rule[taken]
        often = np.bincount(rule, minlength=len(chosen)) >= least  # pairs that lost too many places to others wait; the most frequent loses none
        where, rule, pairs = where[often[rule]], (np.cumsum(often) - 1)[rule[often[rule]]], groups.pair[chosen[often]]
        place = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
        old = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
        number = names + np.cumsum(~old) - 1
        number[old] = named[place[old]]
        gone, beside = after[where], before[where]
        kept[gone] = False
        beside = beside[kept[beside]]
        changed = np.concatenate([where, beside])
        whole = whole and not old.any() and not groups.overlap(np.concatenate([beside, gone]))
        groups.drop(np.concatenate([changed, gone]))
        symbols[where] = number[rule].astype(np.uint32)
        after[where] = after[gone]
        before[after[where]] = where
        group(np.sort(changed[after[changed] < n]))
        new = pairs[~old]
        if len(new):
            own = np.concatenate([known, new])
            order = np.argsort(own, kind="stable")
            known, named = own[order], np.concatenate([named, number[~old]])[order]
            rounds.append(np.column_stack(groups.symbols(new)).astype(np.uint32))
            names += len(new)
    left = np.nonzero(kept)[0]
    return symbols[left], rounds, after[left] == n


def _bits(values: np.ndarray, width: int) -> bytes:
    """Numbers of `width` bits end to end, lowest bit first: of 64 numbers `width` words are made."""
    v = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    v[: len(values)] = values
    v = np.ascontiguousarray(v.reshape(-1, 64).T)
    out = np.zeros((width, v.shape[1]), np.uint64)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        out[word] |= v[k] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= v[k] >> np.uint64(64 - shift)
    return out.T.astype("<u8").tobytes()[: -(-len(values) * width // 8)]


def _numbers(packed: np.ndarray, width: int, first: int, count: int) -> np.ndarray:
    """`count` numbers of `width` bits (32 at most), from number `first` on."""
    bit = (first + np.arange(count, dtype=np.int64)) * width
    byte, out = bit >> 3, np.zeros(count, np.uint64)
    for k in range((width + 14) // 8):
        out |= packed[np.minimum(byte + k, len(packed) - 1)].astype(np.uint64) << np.uint64(8 * k)
    return (out >> (bit & 7).astype(np.uint64) & np.uint64((1 << width) - 1)).astype(np.int64)


def pack_shard(docs: list[int | None], ids: list[np.ndarray]) -> bytes:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    ends = np.zeros(len(flat), bool)
    ends[np.cumsum(sizes) - 1] = True
    symbols, rounds, last = compress(flat, ends)
    base = int(flat.max()) + 1 if len(flat) else 1
    lengths = np.ones(base, np.uint32)
    for rules in rounds:  # a rule names symbols of earlier rounds only
        lengths = np.concatenate([lengths, lengths[rules[:, 0]] + lengths[rules[:, 1]]])
    rules = np.concatenate([np.empty((0, 2), np.uint32), *rounds])
    width = max(1, (base + len(rules) - 1).bit_length())
    per_doc = np.diff(np.concatenate([[-1], np.nonzero(last)[0]])).astype("<u4")
    names = np.array([d if d is not None else 0 for d in docs], "<i8").tobytes() + bytes(d is None for d in docs)
    head = _HEAD.pack(MAGIC, base, len(rounds), len(rules), len(docs), len(symbols), width)
    return b"".join([head, np.array([len(r) for r in rounds], "<u4").tobytes(), _bits(rules.ravel(), width), lengths[base:].astype("<u4").tobytes(), names, per_doc.tobytes(), sizes.astype("<u4").tobytes(), _bits(symbols, width)])


class Shard:
    """A stored shard, opened for reading. Only what is asked for is decoded."""

    def __init__(self, payload: bytes):
        magic, self.base, n_rounds, n_rules, n_docs, self.n_symbols, self.width = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("this is no shard")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out

        self.rounds = take("<u4", n_rounds).astype(np.int64)
        self._rules = take("u1", -(-2 * n_rules * self.width // 8))
        self.lengths = take("<u4", n_rules)
        names, missing = take("<i8", n_docs), take("u1", n_docs)
        self.docs = [None if m else d for d, m in zip(names.tolist(), missing.tolist())]
        self.doc_symbols, self.doc_tokens = take("<u4", n_docs).astype(np.int64), take("<u4", n_docs).astype(np.int64)
        self._symbols = take("u1", -(-self.n_symbols * self.width // 8))
        self._first_symbol, self._first_token = (np.concatenate([[0], np.cumsum(x)]) for x in (self.doc_symbols, self.doc_tokens))

    @cached_property
    def rules(self) -> np.ndarray:
        return _numbers(self._rules, self.width, 0, 2 * len(self.lengths)).reshape(-1, 2) if len(self.lengths) else np.empty((0, 2), np.int64)

    @cached_property
    def _grammar(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The length of every symbol's expansion, where it starts in the text of all expansions, and that text."""
        lengths = np.concatenate([np.ones(self.base, np.int64), self.lengths.astype(np.int64)])
        starts = np.cumsum(lengths) - lengths
        text, done = np.arange(self.base, dtype=np.uint32), 0
        for n in self.rounds.tolist():
            own = self.rules[done : done + n].ravel()
            text, done = np.concatenate([text, _expanded(own, lengths, starts, text)]), done + n
        return lengths, starts, text

    def symbols(self, first: int, stop: int) -> np.ndarray:
        return _numbers(self._symbols, self.width, first, stop - first) if stop > first else np.empty(0, np.int64)

    def all_tokens(self) -> np.ndarray:
        return _expanded(self.symbols(0, self.n_symbols), *self._grammar)

    def document(self, i: int) -> np.ndarray:
        return _expanded(self.symbols(int(self._first_symbol[i]), int(self._first_symbol[i + 1])), *self._grammar)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1 of the shard: only the documents that cover them are looked at, and only the symbols in reach expanded."""
        stop = min(stop, int(self._first_token[-1]))
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = int(np.searchsorted(self._first_token, start, "right")) - 1, int(np.searchsorted(self._first_token, stop, "left"))
        symbols, skipped = self.symbols(int(self._first_symbol[a]), int(self._first_symbol[b])), int(self._first_token[a])
        ends = skipped + np.cumsum(self._grammar[0][symbols])
        p, q = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skipped = int(ends[p - 1]) if p else skipped
        return _expanded(symbols[p:q], *self._grammar)[start - skipped : stop - skipped]


def _expanded(symbols: np.ndarray, lengths: np.ndarray, starts: np.ndarray, text: np.ndarray) -> np.ndarray:
    if not len(symbols):
        return np.empty(0, np.uint32)
    n = lengths[symbols]
    ends = np.cumsum(n)
    return text[np.repeat(starts[symbols] - ends + n, n) + np.arange(ends[-1])]


def write_shards(df: DataFrame, vocab: str, end_id: int, shard_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of shards, stored and reread. Its parts ascend by id; first_token counts within a part."""
    # A range key is sampled to the driver, so the tie is no text; the place lets repeated rows be split over partitions.
    docs = id_and_text(df, id_col, text_col).withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc(), F.col("place").asc()]
    parts = docs.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def encode(batches):
        enc, names, ids, held, first, part = encoder(vocab), [], [], 0, 0, 0

        def shard():
            return pa.RecordBatch.from_pylist([{"part": part, "first_token": first, "n_tokens": held, "n_documents": len(names), "payload": pack_shard(names, ids)}], schema=pa.schema([("part", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("n_documents", pa.int32()), ("payload", pa.binary())]))

        for b in small(batches, limit=SLICE_BYTES):
            part = b.column("part")[0].as_py() if b.num_rows else part
            for doc, own in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text"))):
                names.append(doc)
                ids.append(np.append(own, np.uint32(end_id)))
                held += len(own) + 1
                if held >= shard_tokens:
                    yield shard()
                    names, ids, first, held = [], [], first + held, 0
        if names:
            yield shard()

    return stored(parts.mapInArrow(encode, SHARD), "token-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in stored shards."""
    spark, starts, total = shards.sparkSession, [], 0
    for part, n in sorted(shards.groupBy("part").agg(F.sum("n_tokens")).collect()):  # one row for each partition
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts or [(0, 0)], "part int, before long")

    def decode(batches):
        for b in batches:
            rows: list = []
            for before, first, payload in zip(b.column("before").to_pylist(), b.column("first_token").to_pylist(), b.column("payload")):
                shard = Shard(payload.as_py())
                raw, at = shard.all_tokens().astype("<u4", copy=False).tobytes(), 0
                for doc, n in zip(shard.docs, shard.doc_tokens.tolist()):
                    rows.append((doc, before + first + at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])))
                    at += n
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = shards.join(F.broadcast(offsets), "part").select("before", "first_token", "payload")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(table(spark, sf_dir, "documents"), vocabulary(), end_id=1))
