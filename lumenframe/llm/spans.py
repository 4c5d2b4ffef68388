"""Vectorised work on batches of texts held as one flat UTF-8 byte array.

The operators that need Python work on Arrow batches: a batch's strings are one byte buffer with offsets, and words,
shingles and lines are pairs of numpy arrays (start, end) into it. Nothing here loops over characters in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled by one numpy pass; a text longer than this is a pass of its own.
CHUNK_BYTES = 1 << 20


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (n + 1) of a string array; a null is an empty text."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts whose bytes stay near `most`; every text is in exactly one run."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def text_chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) over the rows of a batch."""
    raw, at = flat(batch.column(batch.schema.get_field_index(column)))
    for i, j in chunks(at, most):
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes, those of other letters too, stay."""
    return raw + ((raw - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)


def space_bytes(raw: np.ndarray) -> np.ndarray:
    """True where the byte is white space of the word rule (0x20, 0x09 to 0x0D)."""
    return (raw == 32) | ((raw - np.uint8(9)) < 5)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words `[^\\x20\\x09-\\x0D]+` of each text; no word crosses two texts."""
    inside = ~space_bytes(raw)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def spaced(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one after another with a single space between each two: bytes, starts and ends there."""
    size = ends - starts
    to = np.cumsum(size + 1) - size - 1
    keep = ~space_bytes(raw)
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    put = np.ones(len(out), bool)
    put[to[1:] - 1] = False
    if len(put):
        put[-1] = False
    out[put] = raw[keep]
    return out, to, to + size


_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))


def powers(n: int, base: np.uint64 = _B) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any spans of a byte array in constant time each: prefix sums of byte * base^i modulo 2^64, mixed.

    Equal spans have equal hashes; unequal spans may clash, so whoever must be exact compares the spans after it.
    """

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(n), out=self.sums[1:])
        self.back = powers(n + 1, _B_INV)

    def spans(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit follows every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of raw[start:end] for each span, in numpy: spans of like lane counts go through the rounds together."""
    pad = np.concatenate((raw, np.zeros(8, np.uint8)))
    at8 = np.ndarray((len(raw) + 1,), np.uint64, pad, strides=(1,))
    at4 = np.ndarray((len(raw) + 1,), np.uint32, pad, strides=(1,))
    n = (ends - starts).astype(np.int64)
    pos = starts.astype(np.int64).copy()
    s = np.uint64(seed)
    h = np.full(len(n), s + _P5, np.uint64)
    big = np.flatnonzero(n >= 32)
    if len(big):
        v = [np.full(len(big), x, np.uint64) for x in ((seed + int(_P1) + int(_P2)) % 2**64, (seed + int(_P2)) % 2**64, seed, (seed - int(_P1)) % 2**64)]
        left = n[big] // 32
        live = np.arange(len(big))
        while len(live):
            p = pos[big[live]]
            for k in range(4):
                v[k][live] = _round(v[k][live], at8[p + 8 * k])
            pos[big[live]] += 32
            left[live] -= 1
            live = live[left[live] > 0]
        x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for k in range(4):
            x = (x ^ _round(np.zeros(len(big), np.uint64), v[k])) * _P1 + _P4
        h[big] = x
    h += n.astype(np.uint64)
    end = ends.astype(np.int64)
    for _ in range(3):
        live = np.flatnonzero(end - pos >= 8)
        if not len(live):
            break
        x = h[live] ^ _round(np.zeros(len(live), np.uint64), at8[pos[live]])
        h[live] = _rotl(x, 27) * _P1 + _P4
        pos[live] += 8
    live = np.flatnonzero(end - pos >= 4)
    x = h[live] ^ (at4[pos[live]].astype(np.uint64) * _P1)
    h[live] = _rotl(x, 23) * _P2 + _P3
    pos[live] += 4
    for _ in range(3):
        live = np.flatnonzero(end > pos)
        if not len(live):
            break
        x = h[live] ^ (pad[pos[live]].astype(np.uint64) * _P5)
        h[live] = _rotl(x, 11) * _P1
        pos[live] += 1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    return h ^ (h >> np.uint64(32))
