"""Batch encoding with the tokenizers library and a per-worker cache of the pieces between words.

The word_bpe vocabulary has no token across white space, between a letter and a following ASCII sign, or between an
ASCII sign other than an apostrophe and a following letter; so a text may be cut there, each distinct piece be
encoded once by the library, and the ids be put together again with numpy. Texts with characters from U+0280 on,
with `<|` (special tokens), or with a capital whose small form has another length go to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import flat_utf8

#: Distinct pieces a worker keeps; beyond them it starts anew. Each takes some 60 bytes.
CACHE_PIECES = 1_000_000
#: Pieces that are looked up at once.
CHUNK_PIECES = 1 << 17
#: Texts are encoded in slices of about so many bytes, for each of which arrays of some 30 bytes are held.
SLICE_BYTES = 1 << 19

_byte = np.arange(256)
_ASCII_LETTER = ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122))
_SPACE = np.isin(_byte, [9, 10, 13, 32])
OTHER, SPACE, LETTER, SIGN, QUOTE = range(5)
#: What each byte of UTF-8 is: white space, letter (ASCII, or first byte of a two-byte one), other ASCII sign, apostrophe.
_KIND = np.select([_SPACE, _ASCII_LETTER | ((_byte >= 0xC3) & (_byte <= 0xC9)), _byte == 39, _byte < 128], [SPACE, LETTER, QUOTE, SIGN], OTHER).astype(np.uint8).tobytes()
_LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8).tobytes()
_was, _is = _byte >> 3, _byte & 7
#: For the kinds of a byte and the one before (times 8): 1 where a piece begins, 2 where white space begins.
BEGINS, ENDS = 1, 2
_MARK = np.select([(_is == SPACE) & (_was != SPACE), (_is != SPACE) & ((_was == SPACE) | ((_was == LETTER) & ((_is == SIGN) | (_is == QUOTE))) | ((_was == SIGN) & (_is == LETTER)))], [ENDS, BEGINS], 0).astype(np.uint8).tobytes()
#: A key is up to 15 bytes of a piece and its length, in two words; longer pieces are kept in a dictionary.
KEY_BYTES = 15
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


#: Pairs of bytes that send a text to the library whole: `<|`, U+0130, U+023A, U+023E.
_WHOLE = ((60, 124), (0xC4, 0xB0), (0xC8, 0xBA), (0xC8, 0xBE))


def _byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself if printable Latin-1, else the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.characters = _byte_characters()
        self._reset()

    def _reset(self) -> None:
        self.long: dict[bytes, int] = {}
        self.kept, self.used, self.flat = 0, 0, np.empty(1 << 18, np.uint32)
        self._room(1 << 17)

    def _room(self, slots: int) -> None:
        """An empty table of keys, and of where in `flat` their ids lie (start * 2^32 + number)."""
        self.low, self.high, self.span = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int64)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. One of letters only is a word by itself, so the library's model takes it without normaliser and splitter."""
        out: list = [None] * len(pieces)
        tokenize, rest = self.tokenizer.model.tokenize, []
        for i, piece in enumerate(pieces):
            if piece.isalpha():
                out[i] = [t.id for t in tokenize(piece.decode().lower())]
            elif (text := piece.decode()).isalpha() and max(text) < "\u0250" and "\u0130" not in text:
                out[i] = [t.id for t in tokenize("".join(map(self.characters.__getitem__, text.lower().encode())))]
            else:
                rest.append(i)
        for i, ids in zip(rest, self._library([pieces[i].decode() for i in rest])):
            out[i] = ids
        return out

    def _places(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of every key, and the slots that were free until now. Keys whose slot is taken by another try the next."""
        slots, new = len(self.high), []
        mixed = (low ^ high * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        at, out, open_ = (mixed >> np.uint64(65 - slots.bit_length())).view(np.int64), np.empty(len(low), np.int64), np.arange(len(low))
        while len(open_):
            own, a, b = at[open_], low[open_], high[open_]
            free = np.nonzero(self.high[own] == 0)[0]
            if len(free):
                self.low[own[free]], self.high[own[free]] = a[free], b[free]  # of several the last one takes it
                new.append(np.unique(own[free]))
            found = (self.low[own] == a) & (self.high[own] == b)
            out[open_[found]] = own[found]
            open_ = open_[~found]
            at[open_] = (at[open_] + 1) & (slots - 1)
        return out, np.concatenate(new) if new else np.empty(0, np.int64)

    def _spans(self, pieces: list[bytes]) -> np.ndarray:
        """Encodes distinct pieces, and where in `flat` their ids are put."""
        ids = self._pieces(pieces)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        more = int(sizes.sum())
        while self.used + more > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + more] = np.fromiter(chain.from_iterable(ids), np.uint32, more)
        starts = self.used + np.cumsum(sizes) - sizes
        self.used, self.kept = self.used + more, self.kept + len(pieces)
        return starts << 32 | sizes

    def _ids(self, text: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some pieces end to end, and how many each has. text: 16 bytes longer than the last piece."""
        if self.kept > CACHE_PIECES:
            self._reset()
        while 3 * (self.kept + len(begins)) > 2 * len(self.high):
            low, high, span = self.low, self.high, self.span
            self._room(2 * len(high))
            held = np.nonzero(high)[0]
            self.span[self._places(low[held], high[held])[0]] = span[held]
        sizes, spans = ends - begins, np.empty(len(begins), np.int64)
        short = sizes <= KEY_BYTES
        at, n = begins[short], sizes[short]
        words = np.ndarray(len(text) - 7, "<u8", text, 0, (1,))
        low, high = words[at] & _FIRST[np.minimum(n, 8)], words[at + 8] & _FIRST[np.maximum(n - 8, 0)] | n.astype(np.uint64) << np.uint64(56)
        where, new = self._places(low, high)
        if len(new):
            raw = np.column_stack([self.low[new], self.high[new]]).astype("<u8").tobytes()
            self.span[new] = self._spans([raw[i : i + raw[i + KEY_BYTES]] for i in range(0, len(raw), 16)])
        spans[short] = self.span[where]
        rest = np.nonzero(~short)[0]
        if len(rest):
            own = [text[a:b] for a, b in zip(begins[rest].tolist(), ends[rest].tolist())]
            new = [p for p in dict.fromkeys(own) if p not in self.long]
            self.long.update(zip(new, self._spans(new).tolist()))
            spans[rest] = [self.long[p] for p in own]
        counts = spans & 0xFFFFFFFF
        stops = np.cumsum(counts)
        return self.flat[np.repeat((spans >> 32) - stops + counts, counts) + np.arange(stops[-1])], counts

    def _plain(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids start (one more than texts)."""
        raw = buf.tobytes()
        kind = np.frombuffer(bytearray(raw.translate(_KIND)), np.uint8)
        lead = np.nonzero(buf >= 0xC3)[0]
        following = buf[lead + 1]
        none = (buf[lead] == 0xC3) & ((following == 0x97) | (following == 0xB7))  # the signs for times and divided by
        kind[lead[none]] = OTHER
        kind[lead[~none] + 1] = LETTER
        pairs = kind.copy()
        pairs[1:] |= kind[:-1] << 3
        mark = np.frombuffer(bytearray(pairs.tobytes().translate(_MARK)), np.uint8)
        firsts = at[:-1][at[:-1] < len(buf)]
        mark[firsts[kind[firsts] != SPACE]] = BEGINS
        marks = np.nonzero(mark)[0]
        begin = mark[marks] == BEGINS
        begins, ends = marks[begin], np.append(marks[1:], len(buf))[begin]
        if not len(begins):
            return np.empty(0, np.uint32), np.zeros(len(at), np.int64)
        text = raw.translate(_LOWER) + bytes(16)
        parts = [self._ids(text, begins[i : i + CHUNK_PIECES], ends[i : i + CHUNK_PIECES]) for i in range(0, len(begins), CHUNK_PIECES)]
        ids, counts = (np.concatenate(x) for x in zip(*parts))
        return ids, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(begins, at)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, null as empty."""
        buf, at = flat_utf8(texts)
        special = np.zeros(len(buf) + 1, np.int64)
        if len(buf):
            odd = buf >= 0xCA
            for first, second in _WHOLE:
                odd[:-1] |= (buf[:-1] == first) & (buf[1:] == second)
            special[1:] = np.cumsum(odd)
        whole = np.nonzero(special[at[1:]] > special[at[:-1]])[0]
        if len(whole):
            texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
            direct = self._library(texts.take(pa.array(whole)).to_pylist())
            mask = np.ones(len(at) - 1, bool)
            mask[whole] = False
            sizes = np.where(mask, np.diff(at), 0)
            buf, at = buf[np.repeat(mask, np.diff(at))], np.concatenate([[0], np.cumsum(sizes)])
        ids, where = self._plain(buf, at)
        out = [ids[a:b] for a, b in zip(where[:-1].tolist(), where[1:].tolist())]
        for i, x in zip(whole.tolist(), direct if len(whole) else []):
            out[i] = np.array(x, np.uint32)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    return Encoder(path)
