"""Vectorised work on the bytes of an Arrow column of texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: 0 white space, 1 other bytes, 2 ASCII letters, 3 ASCII digits, 4 ASCII signs but the apostrophe, 1 again for it.
_KIND = np.ones(256, dtype=np.uint8)
_KIND[33:127] = 4
_KIND[[*range(65, 91), *range(97, 123)]] = 2
_KIND[48:58] = 3
_KIND[39] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are hashed at once.
PIECE = 1 << 19
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, U64(base))
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers[0], _powers[1]


def text_column(column: pa.Array) -> pa.Array:
    """Texts with null as the empty text, as large strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large string column and the n + 1 offsets of its texts in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.empty(0, np.uint8), offsets - (offsets[0] if len(offsets) else 0)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``most`` bytes: first and last + 1."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def _cuts(data: np.ndarray) -> list[int]:
    """Places to cut one very long text: at white space, about PIECE bytes apart."""
    at, out = 0, [0]
    while len(data) - at > PIECE:
        step = at + PIECE
        while step < len(data):
            found = np.flatnonzero(_SPACE[data[step : step + 65536]])
            if len(found):
                step += int(found[0])
                break
            step = min(len(data), step + 65536)
        out.append(step)
        at = step
    return [*out, len(data)] if out[-1] < len(data) or len(out) == 1 else out


@lru_cache(maxsize=1)
def _lower_pairs() -> np.ndarray:
    """For two bytes of one character, first byte times 256 plus the second, those of its small letter."""
    out = np.arange(1 << 16, dtype=np.uint16)
    for c in range(0x80, 0x800):
        a, b = chr(c).encode(), chr(c).lower().encode()
        if len(b) == 2:
            out[int.from_bytes(a, "big")] = int.from_bytes(b, "big")
    return out


def _letters(data: np.ndarray, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in lower case, capitals of Latin-1 included, and which of them belong to letters or digits: not
    ASCII signs, U+00A0 to U+00BF and U+2000 to U+207F. ``wide``: capitals of all characters below U+0800, so
    Greek and Cyrillic ones, become small."""
    low, solid = _LOWER[data], _LETTER[data]
    if wide:
        two = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xDF))
        pair = _lower_pairs()[(data[two].astype(np.uint16) << 8) | data[two + 1]]
        low[two], low[two + 1] = pair >> 8, pair & 255
    else:
        two = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))
        low[two + 1] += 32
    sign = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] >= 0xA0) & (data[1:] <= 0xBF))
    solid[sign] = solid[sign + 1] = False
    sign = np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] == 0x80) | (data[1:-1] == 0x81)))
    solid[sign] = solid[sign + 1] = solid[sign + 2] = False
    return low, solid


def _words_of_piece(data: np.ndarray, starts_at: np.ndarray, lower: bool, letters: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and ends of the words of ``data``; a text begins at each of ``starts_at``."""
    n = len(data)
    if not n:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    if letters:
        data, solid = _letters(data, wide=True)
    else:
        solid = ~_SPACE[data]
    begin = np.empty(n, bool)
    begin[0] = solid[0]
    np.logical_and(solid[1:], ~solid[:-1], out=begin[1:])
    end = np.empty(n + 1, bool)
    end[0], end[n] = False, solid[-1]
    np.logical_and(solid[:-1], ~solid[1:], out=end[1:n])
    inner = starts_at[(starts_at > 0) & (starts_at < n)]
    begin[inner] |= solid[inner]
    end[inner] |= solid[inner - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end)
    return hash_spans(_LOWER[data] if lower and not letters else data, s, e), s, e


class RunningHash:
    """Hashes of any spans of some bytes, by differences of one running sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power_tables(len(data) + 1)
        self.total = np.zeros(len(data) + 1, U64)
        values = data.astype(U64)
        values += U64(1)
        values *= up[: len(data)]
        np.cumsum(values, out=self.total[1:])

    def spans(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """64-bit hashes of the bytes from s to e - 1."""
        return mix((self.total[e] - self.total[s]) * self.down[s] + (e - s).astype(U64))


def hash_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return RunningHash(data).spans(s, e)


def _plain_parts(data: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    low, _ = _letters(data)
    kind = _KIND[data]
    wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kind[wide] = kind[wide + 1] = 2
    cut = np.zeros(n + 1, bool)
    a, b = kind[:-1], kind[1:]
    cut[1:n] = ((a == 0) != (b == 0)) | (a == 3) | (b == 3) | ((a == 2) & (b == 4)) | ((a == 4) & (b == 2))
    cut[starts_at[(starts_at >= 0) & (starts_at < n)]] = True
    cut[0] = cut[n] = True
    at = np.flatnonzero(cut)
    s, e = at[:-1], at[1:]
    full = kind[s] != 0
    s, e = s[full], e[full]
    return hash_spans(low, s, e), s, e


def plain_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words cut further where plain letters (ASCII, Latin-1) meet ASCII signs other than the apostrophe, and
    around ASCII digits: hashes in lower case, text, first byte and end of each part."""
    parts, cuts = [], _cuts(data) if len(data) > 2 * PIECE else [0, len(data)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        h, s, e = _plain_parts(data[a:b], offsets[:-1] - a)
        parts.append((h, s + a, e + a))
    h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, np.searchsorted(offsets, s, side="right") - 1, s, e


class HashTable:
    """Places 0, 1, 2, ... of 64-bit hashes, in open addressing, looked up many at a time."""

    def __init__(self, most: int):
        """``most``: keys it can hold."""
        self.most, self.n = most, 0
        size = 1 << (2 * most).bit_length()
        self.mask = U64(size - 1)
        self.keys, self.values = np.zeros(size, U64), np.full(size, -1, np.int32)

    def get(self, h: np.ndarray) -> np.ndarray:
        """The places, -1 where missing."""
        slot = (h & self.mask).astype(np.int64)
        out = self.values[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            out[open_] = self.values[slot[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[slot[open_]] != h[open_])]
        return out

    def add(self, h: np.ndarray) -> None:
        """Give distinct new hashes the next places."""
        slot, rest = (h & self.mask).astype(np.int64), np.arange(len(h))
        while len(rest):
            free = rest[self.values[slot[rest]] < 0]
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[won]], self.values[slot[won]] = h[won], self.n + won
            rest = rest[self.keys[slot[rest]] != h[rest]]
            slot[rest] = (slot[rest] + 1) & int(self.mask)
        self.n += len(h)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts (A-Z lower-cased unless told
    otherwise), the text each is in, and its first byte and end in ``data``. ``letters``: words are runs of
    letters and digits in lower case instead (capitals up to U+07FF)."""
    if len(data) <= 2 * PIECE:
        h, s, e = _words_of_piece(data, offsets[:-1], lower, letters)
    else:
        parts = []
        cuts = _cuts(data)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            h, s, e = _words_of_piece(data[a:b], offsets[:-1] - a, lower, letters)
            parts.append((h, s + a, e + a))
        h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, np.searchsorted(offsets, s, side="right") - 1, s, e


def shingle_sets(hashes: np.ndarray, owner: np.ndarray, n_texts: int, k: int) -> list[np.ndarray]:
    """For each text the ascending distinct hashes of its k-word shingles; with fewer words the whole
    sequence as one; without words none."""
    first = np.searchsorted(owner, np.arange(n_texts + 1))
    rolled = np.zeros(max(0, len(hashes) - k + 1), U64)
    for j in range(k if len(rolled) else 0):
        rolled = mix(rolled * U64(0xD6E8FEB86659FD93) + hashes[j : j + len(rolled)])
    out = []
    for t in range(n_texts):
        a, b = first[t], first[t + 1]
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            x = np.full(1, U64(b - a))
            for j in range(a, b):
                x = mix(x * U64(0xD6E8FEB86659FD93) + hashes[j : j + 1])
            out.append(x)
        else:
            out.append(np.empty(0, U64))
    return out
