"""GIF media columns: a writer for byte payloads, and a decoder for code streams, palettes, disposal and transparency.

The decoder reads any GIF87a/89a: frames with local or global palettes, interlacing, graphic control extensions
(delay, transparent index, disposal 0-3), clear and deferred-clear LZW streams. Code streams of many images are
decoded together with numpy: all codes between clears have known widths, so they are read at once; a code's string is
its parent entry's string and one more byte, so lengths and first bytes come by pointer jumping, and bytes are
written from the ends of all strings inwards.

A text is stored as 8-bit samples, 64 to a row, up to 1024 rows to a frame, each frame shown for `delay` hundredths
of a second. A sample's colour holds its bits (three of red, three of green, two of blue); sample 0, with which
payloads are filled up, is transparent, and each frame is cleared before the next. So a payload is read back through
palette, transparency and disposal. `stored_frames` decodes stored images once and keeps, beside digests of what they
hold, their timed frames with colour-histogram columns in a table. Null texts count as empty. Repeated rows are
stored each. An empty table gives an empty result. Other columns are not carried.

`gif_frames` gives timed frames with pixels and colour histograms for any binary column. A null image gives nothing, a
broken one, or one whose canvas or frames take over `max_pixels` pixels (so that memory has a bound), one row with an
error and no frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, col, id_and_text, stored, table

WIDTH, FRAME_ROWS, DELAY = 64, 1024, 10
FULL = 4096
#: The most pixels of an image's canvas, and of its frames together.
MAX_PIXELS = 1 << 26
#: Payload bytes that are decoded together.
TOGETHER = 4 << 20


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of counts, end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _widths(codes: int, least: int) -> np.ndarray:
    """Bits of the first, second, ... code after a clear, for a minimum code size."""
    table_size = (1 << least) + 1 + np.arange(codes)
    return np.minimum(12, np.maximum(least + 1, np.floor(np.log2(table_size)).astype(np.int64) + 1))


def lzw_codes(data: bytes) -> list[int]:
    """Codes of 8-bit samples, without the first clear and the end; 256 where the table starts anew."""
    known: dict[int, int] = {}
    get, out, free = known.get, [], 258
    put = out.append
    word = data[0]
    for byte in data[1:]:
        pair = word << 8 | byte
        code = get(pair)
        if code is not None:
            word = code
        else:
            put(word)
            word = byte
            if free < FULL:
                known[pair] = free
                free += 1
            else:
                put(256)
                known.clear()
                free = 258
    put(word)
    return out


def pack_codes(streams: list[list[int]]) -> list[bytes]:
    """The bytes of 8-bit code streams, each with its first clear and its end."""
    sizes = np.fromiter((len(s) + 2 for s in streams), np.int64, len(streams))
    codes = np.fromiter((c for s in streams for c in (256, *s, 257)), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    fresh = np.zeros(len(codes) + 1, bool)  # where counting starts: at each stream and after each clear
    fresh[starts] = True
    fresh[np.nonzero(codes == 256)[0] + 1] = True
    at = np.nonzero(fresh[:-1])[0]
    since = np.arange(len(codes)) - np.repeat(at, np.diff(np.append(at, len(codes))))
    width = _widths(int(since.max()) + 1, 8)[since]
    bit = np.cumsum(width) - width
    own = np.repeat(bit[starts], sizes)
    n_bytes = (np.add.reduceat(width, starts) + 7) // 8
    base = np.cumsum(n_bytes) - n_bytes
    place = np.repeat(base * 8, sizes) + bit - own
    value, byte = codes << (place & 7), place >> 3
    out = np.zeros(int(n_bytes.sum()) + 3, np.int64)
    for k in range(3):
        out[: len(out)] += np.bincount(byte + k, (value >> (8 * k)) & 255, len(out)).astype(np.int64)
    raw = out.astype(np.uint8).tobytes()
    return [raw[a : a + n] for a, n in zip(base.tolist(), n_bytes.tolist())]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


#: The colour of each sample: its bits as red, green and blue in full range.
_COLOURS = bytes(v for i in range(256) for v in ((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 255 // 3))


def write_gifs(payloads: list[bytes], delay: int = DELAY) -> list[bytes]:
    """A GIF for each payload, whose length is a positive multiple of WIDTH."""
    step = WIDTH * FRAME_ROWS
    frames = [[p[i : i + step] for i in range(0, len(p), step)] for p in payloads]
    packed = iter(pack_codes([lzw_codes(f) for own in frames for f in own]) if frames else [])
    control = b"\x21\xf9\x04\x09" + struct.pack("<H", delay) + b"\0\0"  # disposal 2: the frame is cleared; sample 0 is transparent
    out = []
    for own in frames:
        parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, max(len(f) for f in own) // WIDTH, 0xF7, 0, 0), _COLOURS]
        for f in own:
            parts += [control, b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(f) // WIDTH, 0), b"\x08", _blocks(next(packed))]
        out.append(b"".join([*parts, b"\x3b"]))
    return out


@dataclass
class Image:
    """One image of a GIF as it is stored."""

    left: int
    top: int
    width: int
    height: int
    palette: np.ndarray
    interlaced: bool
    least: int
    codes: bytes
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None
    samples: np.ndarray | None = None


@dataclass
class Gif:
    width: int
    height: int
    images: list[Image] = field(default_factory=list)


def parse_gif(data: bytes) -> Gif:
    """The parts of a GIF; code streams are not decoded yet."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, np.zeros((0, 3), np.uint8)

    def palette(bits: int) -> np.ndarray:
        nonlocal at
        n = 2 << bits
        out = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return out

    def chain() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            if at + 1 + n >= len(data):
                raise ValueError("a block is cut short")
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(parts)

    if flags & 0x80:
        shared = palette(flags & 7)
    gif, control = Gif(width, height), (0, 0, None)
    try:
        while data[at] != 0x3B:
            kind, at = data[at], at + 1
            if kind == 0x21:
                label, at = data[at], at + 1
                body = chain()
                if label == 0xF9:
                    how, delay, index = struct.unpack_from("<BHB", body)
                    control = (delay, how >> 2 & 7, index if how & 1 else None)
            elif kind == 0x2C:
                left, top, w, h, how = struct.unpack_from("<HHHHB", data, at)
                at += 9
                own = palette(how & 7) if how & 0x80 else shared
                least, at = data[at], at + 1
                if not 2 <= least <= 8:
                    raise ValueError("a code size is out of range")
                gif.images.append(Image(left, top, w, h, own, bool(how & 0x40), least, chain(), *control))
                control = (0, 0, None)
            else:
                raise ValueError("an unknown block")
    except (IndexError, struct.error) as e:
        raise ValueError("the file is cut short") from e
    return gif


def _read_codes(data: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all streams end to end in the order of the streams, the place of the segment each belongs to, and codes of each stream."""
    clear = 1 << least
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.frombuffer(b"".join(data) + b"\0\0\0\0", np.uint8).astype(np.uint32)
    base = (np.cumsum(sizes) - sizes) * 8
    ends = base + sizes * 8
    most = int(sizes.max()) * 8 // (least + 1) + 1
    width = _widths(most, least)
    upto = np.concatenate([[0], np.cumsum(width)])
    at, live, pieces = base.copy(), np.arange(len(data)), []
    while len(live):
        count = np.searchsorted(upto[1:], ends[live] - at[live], "right")  # whole codes left
        live, count = live[count > 0], count[count > 0]
        if not len(live):
            break
        # A table holds 4096 codes; few streams go on longer without a clear, so this many are read first.
        count = np.minimum(count, 2 * FULL)
        j = _ragged(count)
        row = np.repeat(np.arange(len(live)), count)
        place = at[live][row] + upto[j]
        byte = place >> 3
        value = (flat[byte] | flat[byte + 1] << np.uint32(8) | flat[byte + 2] << np.uint32(16)) >> (place & 7).astype(np.uint32)
        codes = (value & ((1 << width[j]) - 1).astype(np.uint32)).astype(np.int64)
        stop = np.where((codes == clear) | (codes == clear + 1), j, most + 1)
        starts = np.cumsum(count) - count
        first = np.minimum.reduceat(stop, starts)
        if ((first > most) & (count == 2 * FULL)).any():  # a deferred clear: read these streams to their end
            raise _Deferred
        kept = np.minimum(first, count)
        use = j < kept[row]
        pieces.append((live[row[use]], codes[use], j[use]))
        ended = first > most
        last = np.where(ended, clear + 1, codes[np.minimum(starts + first, len(codes) - 1)])
        at[live] += upto[np.minimum(first + 1, len(upto) - 1)]
        live = live[last == clear]
    owner = np.concatenate([p[0] for p in pieces]) if pieces else np.empty(0, np.int64)
    order = np.argsort(owner, kind="stable")
    codes, j = (np.concatenate([p[k] for p in pieces])[order] if pieces else np.empty(0, np.int64) for k in (1, 2))
    return codes, np.arange(len(codes)) - j, np.bincount(owner, minlength=len(data))


class _Deferred(Exception):
    pass


def _sequential(data: bytes, least: int) -> np.ndarray:
    """One stream, code by code: for streams that keep a full table."""
    clear, bits, held, out = 1 << least, 0, 0, bytearray()
    entries: list[bytes] = []
    width, before = least + 1, None
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code, held, bits = held & ((1 << width) - 1), held >> width, bits - width
            if code == clear:
                entries, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], least + 1, None
                continue
            if code == clear + 1:
                return np.frombuffer(bytes(out), np.uint8)
            if not entries:
                entries = [bytes([i]) for i in range(clear)] + [b"", b""]
            if code > len(entries) or before is None and code >= clear:
                raise ValueError("a code comes before its entry")
            if before is None:
                word = entries[code]
            else:
                word = entries[code] if code < len(entries) else before + before[:1]
                if len(entries) < FULL:
                    entries.append(before + word[:1])
            out += word
            before = word
            if len(entries) == 1 << width and width < 12:
                width += 1
    return np.frombuffer(bytes(out), np.uint8)


def lzw_decode(data: list[bytes], least: int) -> list[np.ndarray]:
    """The samples of each code stream."""
    if not data or not max(map(len, data)):
        return [np.empty(0, np.uint8) for _ in data]
    try:
        codes, segment, per = _read_codes(data, least)
    except _Deferred:
        return [_sequential(d, least) for d in data]
    clear = 1 << least
    n = len(codes)
    literal = codes < clear
    parent = np.where(literal, np.arange(n), segment + codes - clear - 2)
    if (parent > np.arange(n)).any() or (~literal & (parent == np.arange(n))).any():
        raise ValueError("a code comes before its entry")
    hops, root = (~literal).astype(np.int64), parent.copy()
    while True:
        nxt = root[root]
        if (nxt == root).all():
            break
        hops, root = hops + hops[root], nxt
    first = codes[root].astype(np.uint8)
    length = hops + 1
    final = np.where(literal, first, first[np.minimum(parent + 1, n - 1)]).astype(np.uint8)  # the byte that an entry adds
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    current, place = np.arange(n), ends - 1
    while len(current):
        out[place] = final[current]
        more = ~literal[current]
        current, place = parent[current[more]], place[more] - 1
    cut = np.concatenate([[0], ends])[np.cumsum(per)]
    return np.split(out, cut[:-1]) if len(cut) else []


def samples_of(rgba: np.ndarray) -> bytes:
    """The samples that write_gifs stored, from the pixels of a frame as shown."""
    p = rgba.reshape(-1, 4)
    return (p[:, 0] >> 5 << 5 | p[:, 1] >> 5 << 2 | p[:, 2] >> 6).tobytes()  # a transparent pixel is black


def decode_samples(gifs: list[Gif], max_pixels: int | None = None) -> None:
    """Decodes the code streams of all images of all GIFs, together by code size."""
    if max_pixels is not None and any(max(g.width * g.height, sum(im.width * im.height for im in g.images)) > max_pixels for g in gifs):
        raise ValueError("an image is too large")
    by: dict[int, list[Image]] = {}
    for g in gifs:
        for im in g.images:
            by.setdefault(im.least, []).append(im)
    for least, images in by.items():
        for im, samples in zip(images, lzw_decode([im.codes for im in images], least)):
            need = im.width * im.height
            if len(samples) < need:
                raise ValueError("an image is cut short")
            rows = samples[:need].reshape(im.height, im.width)
            if im.interlaced:
                order = np.concatenate([np.arange(a, im.height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(rows)
                straight[order] = rows
                rows = straight
            im.samples = rows


def composed(gif: Gif):
    """(image, canvas) for each frame as shown: RGBA, after palettes, transparency and the disposal of earlier frames."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for im in gif.images:
        before = canvas.copy() if im.disposal == 3 else None
        palette = np.full((256, 4), 255, np.uint8)
        palette[:, :3] = 0
        palette[: len(im.palette), :3] = im.palette
        h, w = max(0, min(im.height, gif.height - im.top)), max(0, min(im.width, gif.width - im.left))
        area, samples = canvas[im.top : im.top + h, im.left : im.left + w], im.samples[:h, :w]
        if im.transparent is None:
            area[...] = palette[samples]
        else:
            shown = samples != im.transparent
            area[shown] = palette[samples[shown]]
        yield im, canvas
        if im.disposal == 2:
            area[...] = 0
        elif im.disposal == 3:
            canvas = before


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Opaque pixels in 64 colours: two bits each of red, green and blue."""
    p = rgba.reshape(-1, 4)
    p = p[p[:, 3] > 0]
    return np.bincount((p[:, 0] >> 6 << 4) | (p[:, 1] >> 6 << 2) | p[:, 2] >> 6, minlength=64)


def gif_frames(df: DataFrame, id_col: str, media_col: str, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """doc_id, frame, start_ms, delay_ms, width, height, pixels (RGBA), colours (64 counts) and error, one row a frame."""
    schema = "doc_id long, frame int, start_ms long, delay_ms long, width int, height int, pixels binary, colours array<long>, error string"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]

    def decode(batches):
        for b in batches:
            for doc, media in zip(b.column(0).to_pylist(), b.column(1)):
                if not media.is_valid:
                    continue
                rows, at = [], 0
                try:
                    gif = parse_gif(media.as_py())
                    decode_samples([gif], max_pixels)
                    for k, (im, canvas) in enumerate(composed(gif)):
                        rows.append((doc, k, at, im.delay * 10, gif.width, gif.height, canvas.tobytes(), histogram(canvas).tolist(), None))
                        at += im.delay * 10
                except ValueError as e:
                    rows = [(doc, None, None, None, None, None, None, None, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return df.select(col(id_col).cast("long").alias("doc_id"), col(media_col).alias("media")).mapInArrow(decode, schema)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media of every row, written to the shared folder and reread."""

    def write(batches):
        for b in batches:
            texts = bytes_of(b.column("text"))
            size, start = 0, 0
            for i in range(len(texts) + 1):
                if i == len(texts) or size >= TOGETHER:
                    own = texts[start:i]
                    media = write_gifs([t + bytes(WIDTH * max(1, -(-len(t) // WIDTH)) - len(t)) for t in own])
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(start, i - start), pa.array(map(len, own), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                    size, start = 0, i
                if i < len(texts):
                    size += len(texts[i])

    return stored(id_and_text(df, id_col, text_col).mapInArrow(write, "doc_id long, n_bytes long, media binary"), "gif-media")


FRAME = "struct<frame:int,start_ms:long,delay_ms:long,width:int,height:int,colours:array<long>>"
_FRAME = pa.struct([("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("colours", pa.list_(pa.int64()))])


def stored_frames(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digests of what the stored media hold, and `frames`, their timed frames with colour histograms: written to the shared folder and reread."""
    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames array<{FRAME}>"
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames"]
    types = [*[pa.int64()] * 3, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(_FRAME)]

    def rows(ids, sizes, media):
        gifs = [parse_gif(m) for m in media]
        decode_samples(gifs)
        for doc, n, m, gif in zip(ids, sizes, media, gifs):
            payload, frames, at = [], [], 0
            for k, (im, canvas) in enumerate(composed(gif)):
                shown = np.ascontiguousarray(canvas[im.top : im.top + im.height, im.left : im.left + im.width])
                payload.append(samples_of(shown))
                frames.append({"frame": k, "start_ms": at, "delay_ms": 10 * im.delay, "width": im.width, "height": im.height, "colours": histogram(shown)})
                at += 10 * im.delay
            data = b"".join(payload)
            yield doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(m), hashlib.sha256(m).hexdigest(), frames

    def read(batches):
        for b in batches:
            ids, sizes, media = (b.column(k).to_pylist() for k in range(3))
            start, held = 0, 0
            for i in range(len(ids) + 1):
                if i == len(ids) or held >= TOGETHER:
                    if i > start:
                        columns = zip(*rows(ids[start:i], sizes[start:i], media[start:i]))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
                    start, held = i, 0
                if i < len(ids):
                    held += sizes[i] + WIDTH

    return stored(media.select("doc_id", "n_bytes", "media").mapInArrow(read, schema), "gif-frames")


def described(frames: DataFrame) -> DataFrame:
    """The digests of stored_frames, and `feature`: the number of frames, how long they show, and all their colours that occur (number:pixels)."""
    colours = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), 64), lambda held, f: F.zip_with(held, f["colours"], lambda a, b: a + b))
    listed = F.filter(F.transform(colours, lambda n, k: F.when(n > 0, F.concat_ws(":", k.cast("string"), n.cast("string")))), lambda x: x.isNotNull())
    shown = F.aggregate("frames", F.lit(0).cast("long"), lambda at, f: F.greatest(at, f["start_ms"] + f["delay_ms"]))
    return frames.withColumn("feature", F.concat(F.lit("frames="), F.size("frames").cast("string"), F.lit(";ms="), shown.cast("string"), F.lit(";colours="), F.array_join(listed, ","))).drop("frames")


def op9_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(stored_frames(store_texts(table(spark, sf_dir, "documents"))))
