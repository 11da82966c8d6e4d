"""Broken and random LZW code streams: an error or the same samples from both decoders, never another exception."""

import random
import struct

import numpy as np
import pytest

from topicloom.llm import gif


def stream(codes, least):
    """Codes end to end in the widths that a decoder's table gives them; entries grow by one with each code after the first."""
    clear, bits, held, out = 1 << least, 0, 0, bytearray()
    size, width, first = clear + 2, least + 1, True
    for code in codes:
        held |= (code & ((1 << width) - 1)) << bits
        bits += width
        while bits >= 8:
            out.append(held & 255)
            held, bits = held >> 8, bits - 8
        if code == clear:
            size, width, first = clear + 2, least + 1, True
            continue
        if not first and size < 4096:
            size += 1
        first = False
        if size == 1 << width and width < 12:
            width += 1
    return bytes(out) + bytes([held & 255, 0])


def file_of(data, least, width, height):
    blocks = b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255))
    return b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF7, 0, 0) + bytes(768) + b"," + struct.pack("<HHHHB", 0, 0, width, height, 0) + bytes([least]) + blocks + b"\0;"


def decoded(data, least):
    try:
        return gif.lzw_decode([data], least)[0].tobytes()
    except ValueError:
        return "error"


def test_long_streams_without_a_clear():
    rng = random.Random(1)
    good = [rng.randrange(256) for _ in range(9000)]
    assert decoded(stream([256, *good, 257], 8), 8) == bytes(good)
    for bad in ([256, 3000, *good, 257], [3000, *good], [256, *good[:3], 3000, *good, 257], [256, *good[:500], 4000, *good]):
        assert decoded(stream(bad, 8), 8) == "error"


@pytest.mark.parametrize("least", [2, 4, 8])
def test_cut_and_random_streams_decode_alike(least):
    rng = random.Random(least)
    clear, errors = 1 << least, 0
    for _ in range(300):
        codes = [clear]
        size = clear + 2
        for _ in range(rng.randrange(1, 60)):
            codes.append(rng.choice([rng.randrange(clear), rng.randrange(clear), rng.randrange(size + 2)]))
            size += 1
        data = stream([*codes, clear + 1], least)
        data = data[: rng.randrange(1, len(data) + 1)]
        try:
            alone = gif._sequential(data, least).tobytes()
        except ValueError:
            alone = "error"
        errors += alone == "error"
        assert decoded(data, least) == alone
    assert 0 < errors < 280


def test_broken_streams_give_error_rows(spark):
    rng = random.Random(3)
    good = [rng.randrange(256) for _ in range(9000)]
    files = [stream([256, *good, 257], 8), stream([256, 3000, *good, 257], 8), stream([256, *good[:3], 3000, *good], 8), bytes(rng.randrange(256) for _ in range(20000))]
    df = spark.createDataFrame([(i, bytearray(file_of(f, 8, 100, 90))) for i, f in enumerate(files)], "doc_id long, media binary")
    rows = {r["doc_id"]: r for r in gif.gif_frames(df, "doc_id", "media").collect()}
    assert rows[0]["error"] is None and len(rows[0]["pixels"]) == 36000
    assert all(rows[i]["error"] and rows[i]["pixels"] is None for i in (1, 2))
    assert len(rows) == 4 and (rows[3]["error"] is None) == (rows[3]["pixels"] is not None)
    assert np.frombuffer(bytes(rows[0]["pixels"]), np.uint8).reshape(-1, 4)[:, 3].min() == 255
