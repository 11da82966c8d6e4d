"""Removal of repeated byte strings by longest-previous-factor arrays, over all texts of a table.

A string of `width` bytes counts as a copy if it also starts earlier: in a row with a smaller id, or sooner in the same
row. Every byte that such a copy covers is removed. Matches never go from one text into the next.

All windows of `width` bytes are dealt out so that equal ones meet: a window's anchor is the smallest hash among its
substrings of ANCHOR bytes, and neighbouring windows with the same anchor form one segment. Equal windows have equal
anchors wherever they are, so only segments of one anchor need comparing.

1. Each task cuts its texts into segments and keeps of equal ones (128 bits of hashes agree) the earliest, so copies shrink before they travel;
   anchors that very many of its segments share are set aside at once (see 3). What travels is some 38 bytes for each
   35 bytes of text, packed by slice of the anchors.
2. A slice settles equal segments: all but the earliest are copies as a whole. Anchors with one segment are done, unless
   the anchor occurs in it twice.
3. Only segments that share their anchor with a different one (or repeat it) are cut out of their texts, dealt to blocks by anchor, and
   searched. Windows whose hash occurs once in the block are passed over; the suffixes at the others are sorted by doubling, and for every suffix the nearest
   ones before and after it in suffix order that lie earlier in the table give the longest previous factor. Where it is
   `width` or longer its bytes are copies. Segments of an anchor that more than HOT_SEGMENTS share (a short common line
   in ever new surroundings) are cut into single windows, dealt by their content, so that no block grows with one anchor.
4. The spans of each row are united and cut out of its text. Rows without a candidate never leave their partition.

Rows are ordered by id, null first; of rows that repeat an id, the one whose text has the smaller hash comes first; rows
that repeat id and text count as the same document and get the same result each. Null texts count as empty. An empty
table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, bytes_of, checkpointed, flat_utf8, id_and_text, join_classes, partitions, row_key, small, stored, table
from .factors import common_extension
from .url_filter import bounded_filter

WIDTH = 100
#: Bytes of the substrings whose smallest hash names a window.
ANCHOR = 32
#: A segment has at most so many windows (a text of one repeated byte would be one segment).
SEGMENT_WINDOWS = 512
#: A task packs its segments when it has so many.
RUN_SEGMENTS = 1 << 17
#: Anchors of more segments than this in one run go the way of hot ones without being counted.
RUN_HOT = 256
#: Anchors of more different segments are cut into windows.
HOT_SEGMENTS = 4096
#: Text for each slice, and bytes of segments for each block.
SLICE_BYTES, BLOCK_BYTES = 16 << 20, 1 << 20
#: Of the filter that tells rows with candidates.
FILTER_BYTES = 16 << 20
_ENTRY = np.dtype([("anchor", "<u8"), ("seg", "<u8"), ("id", "<i8"), ("raw", "<i8"), ("start", "<u4"), ("len", "<u2"), ("more", "?")])
_COPY, _CONTESTED = 0, 1
_SPANS = "__id long, __raw long, anchor long, start long, len int, kind int"


def _hashes(flat: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes (a power of two) from each place on, made from those of both halves."""
    now, factor, step = flat.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while step < size:
        now = now[:-step] * np.uint64(factor) + now[step:] if len(now) > step else now[:0]
        factor, step = (factor * factor * 0xD6E8FEB86659FD93 | 1) % (1 << 64), 2 * step
    now ^= now >> np.uint64(32)
    now *= np.uint64(0xD6E8FEB86659FD93)
    now ^= now >> np.uint64(29)
    return now


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest of `size` neighbours from each place on."""
    step = 1
    while 2 * step <= size:
        values, step = np.minimum(values[:-step], values[step:]), 2 * step
    return np.minimum(values[: len(values) - (size - step)], values[size - step :]) if size > step else values


def segments(flat: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, stop, again) of the segments of texts that lie end to end in flat, text k from at[k] to at[k + 1]; each window of each text begins in one, and ends in it too. again: the anchor occurs twice, so a window may."""
    none = np.empty(0, np.int64)
    if len(flat) < width:
        return none.astype(np.uint64), none, none, none.astype(bool)
    hashes, reach = _hashes(flat, ANCHOR), width - ANCHOR + 1
    anchor = _least(hashes, reach)  # of the window at each place
    inside = np.zeros(len(flat) + 1, np.int64)
    first, last = at[:-1], at[1:] - width + 1
    long = last > first
    np.add.at(inside, first[long], 1)
    np.add.at(inside, last[long], -1)
    inside = np.cumsum(inside)[: len(anchor)] > 0  # windows that go over a text's end are none
    begin = inside.copy()
    begin[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    begin[first[long]] = True
    start = np.nonzero(begin)[0]
    ends = inside.copy()
    ends[:-1] &= begin[1:] | ~inside[1:]
    end = np.nonzero(ends)[0] + 1  # the window after the last
    pieces = -(-(end - start) // SEGMENT_WINDOWS)
    if len(pieces) and pieces.max() > 1:
        place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        last = np.repeat(end, pieces)
        start = np.repeat(start, pieces) + place * SEGMENT_WINDOWS
        end = np.minimum(start + SEGMENT_WINDOWS, last)
    of = anchor[start]
    # A place whose hash is the anchor of a window that holds it: the anchors of its windows are at most its hash.
    anchor[~inside] = 0
    around = np.concatenate([np.zeros(reach - 1, np.uint64), anchor, np.zeros(reach - 1, np.uint64)])
    places = np.nonzero(~_least(~around, reach) == hashes)[0]
    low, high = np.searchsorted(places, start), np.searchsorted(places, end + width - ANCHOR)
    many = high - low
    owner = np.repeat(np.arange(len(start)), many)
    near = places[np.arange(len(owner)) + np.repeat(low - (np.cumsum(many) - many), many)]
    times = np.bincount(owner[hashes[near] == of[owner]], minlength=len(start))
    of = of * np.uint64(0x9E3779B97F4A7C15)  # smallest hashes are small: spread again, as slices go by them
    return of ^ of >> np.uint64(32), start, end + width - 1, times > 1


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, -1 if there is none. All places jump along the pointers found so far, so rounds are few."""
    p = np.arange(len(values)) - 1
    open_ = np.nonzero(p >= 0)[0]
    while len(open_):
        open_ = open_[values[p[open_]] >= values[open_]]
        p[open_] = p[p[open_]]
        open_ = open_[p[open_] >= 0]
    return p


def suffix_ranks(flat: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rank of the suffix at each place (equal for equal suffixes), and the numbers of the factors of each power of two. rest: bytes from a place to the end of its text."""
    n, size, names = len(flat), 1, []
    rank = flat.astype(np.int64) + 1
    while True:
        names.append(np.where(rest >= size, rank, -1))
        if not n or size >= rest.max():
            return rank, names
        after = np.zeros(n, np.int64)
        after[: n - size] = rank[size:]
        after[rest <= size] = 0  # an ended suffix comes first
        if size < 4:
            rank = rank << (9 * size) | after  # a byte and its end fit in 9 bits
        else:
            rank = _dense(rank, after)
            if not ((np.bincount(rank)[rank] > 1) & (rest >= 2 * size)).any():
                return rank, names  # no factor of this length occurs again, so no longer one does
        size *= 2
        if size == 4:
            rank = _dense(rank)


def _dense(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Ranks from 1 of numbers, or of pairs of ranks. Up to 2^21 of them are sorted together with their places in one number."""
    n = len(first)
    code = first if second is None else first << (21 if n < 1 << 21 else 32) | second
    if n >= 1 << 21:
        return np.unique(code, return_inverse=True)[1] + 1
    placed = code << 21 | np.arange(n)
    placed.sort()
    code = placed >> 21
    rank = np.empty(n, np.int64)
    rank[placed & ((1 << 21) - 1)] = np.cumsum(np.append(True, code[1:] != code[:-1])[:n])
    return rank


def longest_previous_factor(flat: np.ndarray, rest: np.ndarray, places: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the suffixes at `places` the length of the longest factor that also begins at another of them with a smaller `order`, and which (-1: none).

    It begins at one of two places: the nearest before and the nearest after in suffix order that come earlier.
    """
    rank, names = suffix_ranks(flat, rest)
    sa = np.lexsort((order, rank[places]))
    own = order[sa]
    before = previous_smaller(own)
    after = len(own) - 1 - previous_smaller(own[::-1])[::-1]
    length, source = np.zeros(len(places), np.int64), np.full(len(places), -1)
    for found in (before, after):
        have = np.nonzero((found >= 0) & (found < len(own)))[0]
        one, other = sa[have], sa[found[have]]
        common = np.minimum(common_extension(names, places[one], places[other]), np.minimum(rest[places[one]], rest[places[other]]))  # behind a text's end another begins
        more = common > length[one]
        length[one[more]], source[one[more]] = common[more], other[more]
    return length, source


def _batch(ids, raws, anchors, starts, lens, kind: int) -> pa.RecordBatch:
    n = len(starts)
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (ids, raws, anchors)), pa.array(np.asarray(starts, np.int64)), pa.array(np.asarray(lens, np.int32)), pa.array(np.full(n, kind, np.int32))], ["__id", "__raw", "anchor", "start", "len", "kind"])


def _sort_earliest(e: np.ndarray) -> np.ndarray:
    """Entries by anchor and segment, each one's earliest first."""
    return e[np.lexsort((e["start"], e["raw"], e["id"], e["seg"], e["anchor"]))]


def _firsts(e: np.ndarray) -> np.ndarray:
    return np.append(True, (e["anchor"][1:] != e["anchor"][:-1]) | (e["seg"][1:] != e["seg"][:-1]))[: len(e)]


def _copies(e: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The entries that lie later than their segment's first (rows that repeat id and text lie at the same place)."""
    head = e[np.nonzero(first)[0]][np.cumsum(first) - 1]
    return e[(e["id"] != head["id"]) | (e["raw"] != head["raw"]) | (e["start"] != head["start"])]


def _found(df: DataFrame, width: int, slice_bytes: int) -> DataFrame:
    """Rows (_SPANS) of copies, whole segments that occur earlier, and of contested segments, whose anchor other segments share."""
    spark = df.sparkSession
    total = df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(partitions(spark), -(-total // slice_bytes))

    def cut(batches):
        held, size = [], 0

        def pack():
            e = _sort_earliest(np.concatenate(held))
            first = _firsts(e)
            gone, e = _copies(e, first), e[first]
            new = np.append(True, e["anchor"][1:] != e["anchor"][:-1])
            begin = np.nonzero(new)[0]
            many = np.diff(np.append(begin, len(e)))
            hot = np.repeat(many > RUN_HOT, many)
            # A hot anchor leaves one entry, so that its segments elsewhere are known as contested.
            rest = e[~hot | new]
            rest["more"] |= hot[~hot | new]
            of = (rest["anchor"] >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
            bounds = np.searchsorted(of, np.arange(slices + 1, dtype=np.uint64)) if slices < len(of) else np.append(np.nonzero(np.append(True, of[1:] != of[:-1]))[0], len(of))
            out = [(int(of[a]), rest[a:b].tobytes(), b"", b"") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if b > a]
            own = int(xxhash.xxh64_intdigest(e[:1].tobytes(), 3))  # what is settled goes through any slices, in small pieces
            for place, part in ((2, gone), (3, e[hot & ~new])):
                for i in range(0, len(part), 1024):
                    own += 1
                    out.append((own % slices, *(part[i : i + 1024].tobytes() if k == place else b"" for k in (1, 2, 3))))
            for i in range(0, len(out), 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 16]), (pa.int64(), *[pa.binary()] * 3))], ["slice", "entries", "gone", "contested"])

        for whole in batches:
            for b in small([whole], limit=1 << 20):
                flat, at = flat_utf8(b.column("text"))
                anchor, start, stop, again = segments(flat, at, width)
                if not len(start):
                    continue
                view, digest = memoryview(np.ascontiguousarray(flat)), xxhash.xxh3_64_intdigest
                row = np.searchsorted(at, start, "right") - 1
                raw = np.array([xxhash.xxh64_intdigest(view[a:z], 42) for a, z in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64).view(np.int64)
                e = np.empty(len(start), _ENTRY)
                e["anchor"], e["start"], e["len"], e["more"] = anchor, start - at[row], stop - start, again
                e["seg"] = np.fromiter((digest(view[a:z]) for a, z in zip(start.tolist(), stop.tolist())), np.uint64, len(start))
                e["id"], e["raw"] = b.column("doc_id").to_numpy()[row], raw[row]
                held.append(e)
                size += len(e)
                if size >= RUN_SEGMENTS:
                    yield from pack()
                    held, size = [], 0
        if held:
            yield from pack()

    def settle(group: pa.Table) -> pa.Table:
        read = lambda name: np.frombuffer(b"".join(group.column(name).to_pylist()), _ENTRY)
        e = _sort_earliest(read("entries"))
        first = _firsts(e)
        gone = _copies(e, first)
        begin = np.nonzero(np.append(True, e["anchor"][1:] != e["anchor"][:-1])[: len(e)])[0]
        of = np.cumsum(np.bincount(begin, minlength=len(e))[: len(e)]) - 1  # which anchor an entry has
        shared = (np.bincount(of[first], minlength=len(begin)) > 1) | (np.bincount(of[e["more"]], minlength=len(begin)) > 0)
        e = e[first & shared[of]]
        out = []
        for part, kind in ((gone, _COPY), (read("gone"), _COPY), (e, _CONTESTED), (read("contested"), _CONTESTED)):
            for i in range(0, max(1, len(part)), 1 << 15):
                some = part[i : i + (1 << 15)]
                out.append(_batch(some["id"], some["raw"], some["anchor"], some["start"], some["len"], kind))
        return pa.Table.from_batches(out)

    packed = df.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text").mapInArrow(cut, "slice long, entries binary, gone binary, contested binary")
    return packed.groupBy("slice").applyInArrow(settle, _SPANS)


def _repeating(own: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all segments end to end, and the stretches of them (segment, start, length) whose windows' hashes all occur more than once: the suffixes of other windows have no factor of `width` bytes in common with any."""
    size = np.fromiter(map(len, own), np.int64, len(own))
    flat, begin = np.frombuffer(b"".join(own), np.uint8), np.cumsum(size) - size
    half = 1 << (width.bit_length() - 1)
    hashes = _hashes(flat, half)
    windows = size - width + 1
    piece = np.repeat(np.arange(len(own)), windows)
    place = begin[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    hashes = hashes[place] * np.uint64(0x9E3779B97F4A7C15) + hashes[place + width - half]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    again = np.zeros(len(place), bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    kept = np.nonzero(again)[0]
    first = np.append(True, (np.diff(kept) > 1) | (np.diff(piece[kept]) > 0))[: len(kept)]
    first = np.nonzero(first)[0]
    many = np.diff(np.append(first, len(kept)))
    return flat, piece[kept[first]], place[kept[first]], many + width - 1


def _taken(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of flat end to end."""
    return flat[np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)]


def _filter_of(rows: DataFrame):
    """A broadcast filter of the rows (__id, __raw), bounded in size; None without rows."""
    return rows.sparkSession.sparkContext.broadcast(bounded_filter(rows.select(F.xxhash64("__id", "__raw").alias("h1"), F.xxhash64("__raw", "__id").alias("h2")), FILTER_BYTES))


def _hashed(df: DataFrame) -> DataFrame:
    keyed = df.select("doc_id", "text", *row_key(F.col("doc_id"), F.col("text")))
    return keyed.select("doc_id", "__id", "__raw", F.xxhash64("__id", "__raw").alias("h1"), F.xxhash64("__raw", "__id").alias("h2"), "text")


def _passes(level, b: pa.RecordBatch) -> np.ndarray:
    return level.lets_through(b.column("h1").to_numpy(), b.column("h2").to_numpy(), 0) if level is not None and b.num_rows else np.zeros(b.num_rows, bool)


def _previous(df: DataFrame, contested: DataFrame, width: int, hot_segments: int, block_bytes: int) -> DataFrame:
    """Spans (__id, __raw, start, len) of what lies in contested segments and also begins earlier."""
    counts = checkpointed(contested.groupBy("anchor").agg(F.count("*").alias("n")))
    if (counts.agg(F.max("n")).first()[0] or 0) > hot_segments:
        contested = join_classes(contested, counts, ["anchor"]).withColumn("hot", F.col("n") > hot_segments)
    else:
        contested = contested.withColumn("hot", F.lit(False))
    own = F.struct("anchor", "start", "len", "hot")
    wanted = stored(contested.groupBy("__id", "__raw").agg(F.collect_list(own).alias("own"), F.sum(F.when(F.col("hot"), (F.col("len") - (width - 1)) * width).otherwise(F.col("len"))).alias("bytes")), "contested")
    blocks = max(1, -(-(wanted.agg(F.sum("bytes")).first()[0] or 0) // block_bytes))
    level = _filter_of(wanted)

    def involved(batches):
        for b in batches:
            yield b.filter(pa.array(_passes(level.value, b))).select(["__id", "__raw", "text"])

    def cut(batches):
        """The bytes of contested segments; of hot anchors' each window that is the first of its content here, the others as known copies (no bytes)."""
        known: dict = {}
        for whole in batches:
            for b in small([whole], limit=1 << 20):
                rows = []
                for id_, raw, text, own in zip(b.column("__id").to_pylist(), b.column("__raw").to_pylist(), bytes_of(b.column("text")), b.column("own").to_pylist()):
                    for x in own:
                        start, stop = x["start"], x["start"] + x["len"]
                        if not x["hot"]:
                            rows.append((x["anchor"], id_, raw, start, text[start:stop]))
                            continue
                        for at in range(start, stop - width + 1):
                            window = text[at : at + width]
                            key, place = xxhash.xxh3_128_digest(window), (id_, raw, at)
                            seen = known.get(key)
                            if seen is not None and seen <= place:
                                if seen < place:
                                    rows.append((x["anchor"], *place, None))
                                continue
                            if len(known) < RUN_SEGMENTS:  # what is not remembered is settled in its block
                                known[key] = place
                            rows.append((int.from_bytes(key[:8], "little", signed=True), *place, window))
                for i in range(0, len(rows), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 8192]), (*[pa.int64()] * 4, pa.binary()))], ["key", "__id", "__raw", "start", "own"])

    # A row that repeats id and text is needed once.
    texts = _hashed(df).mapInArrow(involved, "__id long, __raw long, text string").join(wanted.drop("bytes"), ["__id", "__raw"]).select("__id", "__raw", "text", "own")
    pieces = texts.mapInArrow(cut, "key long, __id long, __raw long, start long, own binary").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))

    def search(group: pa.Table) -> pa.Table:
        known = group.filter(pa.compute.is_null(group.column("own")))
        group = group.filter(pa.compute.is_valid(group.column("own")))
        own = group.column("own").to_pylist()
        flat, row, at, size = _repeating(own, width)
        id_, raw, start = (group.column(c).to_numpy()[row] for c in ("__id", "__raw", "start"))
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        start = start + at - (np.cumsum(sizes) - sizes)[row]
        flat, at = _taken(flat, at, size), np.cumsum(size) - size
        windows = size - width + 1
        piece = np.repeat(np.arange(len(size)), windows)
        offset = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
        place = start[piece] + offset
        by = np.lexsort((place, raw[piece], id_[piece]))
        new = np.append(False, (np.diff(id_[piece][by]) != 0) | (np.diff(raw[piece][by]) != 0) | (np.diff(place[by]) != 0))[: len(by)]
        order = np.empty(len(by), np.int64)
        order[by] = np.cumsum(new)
        length, _ = longest_previous_factor(flat, np.repeat(at + size, size) - np.arange(len(flat)), at[piece] + offset, order)
        hit = np.nonzero(length >= width)[0]
        begin = np.nonzero(np.append(True, (np.diff(hit) > 1) | (np.diff(piece[hit]) > 0)))[0] if len(hit) else hit
        stop = np.maximum.reduceat(place[hit] + length[hit], begin) if len(hit) else hit
        one = hit[begin]
        columns = [np.concatenate([known.column(c).to_numpy(), x]) for c, x in (("__id", id_[piece[one]]), ("__raw", raw[piece[one]]), ("start", place[one]), ("start", stop))]
        columns[3][: known.num_rows] += width
        return pa.table({"__id": columns[0], "__raw": columns[1], "start": columns[2], "len": (columns[3] - columns[2]).astype(np.int32)})

    return pieces.groupBy("block").applyInArrow(search, "__id long, __raw long, start long, len int")


def copied_spans(df: DataFrame, width: int = WIDTH, slice_bytes: int = SLICE_BYTES, hot_segments: int = HOT_SEGMENTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """__id, __raw (common.row_key) and spans (start, stop; they may overlap) of each row of df(doc_id, text) that has copies."""
    if width < ANCHOR:
        raise ValueError(f"strings must have {ANCHOR} bytes or more")
    found = stored(_found(df, width, slice_bytes), "segments")
    inner = stored(_previous(df, found.filter(F.col("kind") == _CONTESTED).drop("kind"), width, hot_segments, block_bytes), "previous")
    spans = found.filter(F.col("kind") == _COPY).select("__id", "__raw", "start", "len").unionByName(inner)
    return spans.groupBy("__id", "__raw").agg(F.collect_list(F.struct("start", "len")).alias("spans"))


def united(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of overlapping or touching ones."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.append(True, starts[1:] > stops[:-1])
    return starts[new], stops[np.append(np.nonzero(new)[0][1:] - 1, len(stops) - 1)]


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def remove_repeats(df: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, **limits: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, unless keep_text is False, the kept text of every row (bytes that are cut apart within a character are replaced there, not in the digest)."""
    rows = id_and_text(df, id_col, text_col)
    spans = stored(copied_spans(rows, width, **limits), "spans")
    level = _filter_of(spans)

    def whole(batches):
        """Rows that surely have no copies are settled at once; only the others' texts travel."""
        for b in batches:
            maybe = _passes(level.value, b)
            texts = bytes_of(b.column("text"))
            done = [None if m else hashlib.sha256(t).hexdigest() for m, t in zip(maybe.tolist(), texts)]
            text = pa.array([t if m or keep_text else None for m, t in zip(maybe.tolist(), texts)], pa.binary())
            key = [pa.array(np.where(maybe, b.column(c).to_numpy(), b.column("h2").to_numpy())) for c in ("__id", "__raw")]  # settled rows are dealt evenly
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *key, pa.array(list(map(len, texts)), pa.int64()), pa.array(done, pa.string()), text], ["doc_id", "__id", "__raw", "n_bytes", "done", "text"])

    def cut(batches):
        for b in batches:
            out = []
            for id_, n, done, text, spans in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "done", "text", "spans"))):
                text, kept, removed, several = text or b"", text, 0, 0
                if done is None:
                    if spans:
                        start = np.array([x["start"] for x in spans])
                        starts, stops = united(start, start + np.array([x["len"] for x in spans]))
                        removed, several = int((stops - starts).sum()), len(starts)
                        kept = b"".join(text[a:z] for a, z in zip([0, *stops.tolist()], [*starts.tolist(), len(text)]))
                    done = hashlib.sha256(kept or b"").hexdigest()
                out.append((id_, n, removed, several, done, (kept or b"").decode(errors="replace") if keep_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (*[pa.int64()] * 4, pa.string(), pa.string()))] if out else [pa.array([], t) for t in (*[pa.int64()] * 4, pa.string(), pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    first = _hashed(rows).mapInArrow(whole, "doc_id long, __id long, __raw long, n_bytes long, done string, text binary")
    done = first.join(spans, ["__id", "__raw"], "left").select("doc_id", "n_bytes", "done", "text", "spans").mapInArrow(cut, _KEPT)
    return done if keep_text else done.drop("kept")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
