"""Byte-level BPE: pre-tokenisation by codepoint classes and a scan of transition functions, merges cached by piece.

The splitting pattern is a small automaton: whether a character begins a piece depends on its class, the class after it and
the state before it. A character is a function from states to states; composing functions is associative, and the few
functions that arise are numbered, so that a prefix scan is a table look-up per step. Rows of a block of text are scanned
side by side and joined by their totals. No regular expression is used.
"""

from __future__ import annotations

import base64
import heapq
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import spans
from lumenframe.llm.runtime import small_batches

#: Fixed value: the pattern whose matches the splitter finds; a test holds it against the tokenizer's own.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose tokens a worker remembers before it starts anew; a bound on its memory (some 80 MB).
CACHED = 300_000
#: A longer piece is merged with a heap, the others side by side in numpy.
LONG_PIECE = 48

# Symbols: letter, number, other, space, other white space; white space with a non-space after it; apostrophe before s, t, m, d
# and before re, ve, ll; the start of a text.
_L, _N, _O, _SP, _WS, _SPX, _WSX, _Q1, _Q2 = range(9)
# States: what the character before was part of. _CAN: a lone space that takes what follows; _ONE, _TWO: a contraction that
# lacks so many letters; _CUT: after it the next character begins a piece.
_START, _LET, _NUM, _OTH, _SPACE, _CAN, _ONE, _TWO, _CUT = range(9)


@cache
def classes() -> np.ndarray:
    """Class of each code point: letter, number, other, space or white space."""
    out = np.full(sys.maxunicode + 1, _O, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = _L if kind == "L" else _N
    out[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _WS
    out[32] = _SP
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """State after the symbol, and whether the symbol begins a piece."""
    if state in (_ONE, _TWO):
        return (_CUT, False) if state == _ONE else (_ONE, False)
    joined = state == _CAN
    if symbol in (_Q1, _Q2):
        if joined or state == _OTH:
            return _OTH, not joined and state != _OTH
        return (_ONE if symbol == _Q1 else _TWO), True
    if symbol in (_L, _N, _O):
        to = {_L: _LET, _N: _NUM, _O: _OTH}[symbol]
        return to, not joined and state != to
    begins = state != _SPACE or symbol in (_SPX, _WSX)
    return {_SPX: _CAN, _WSX: _CUT}.get(symbol, _SPACE), begins


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """product[f, g] (first f, then g), image[f, state], number of each symbol's function, begins[state, symbol].

    The functions of nine further symbols are those of a text's first character: whatever was before, they start anew.
    """
    states = range(9)
    plain = [tuple(_step(s, x)[0] for s in states) for x in range(9)]
    plain += [(_step(_START, x)[0],) * 9 for x in range(9)]
    known: dict[tuple, int] = {}
    for f in (tuple(states), *plain):
        known.setdefault(f, len(known))
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in plain:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    every = list(known)
    product = np.array([[known.get(tuple(g[s] for s in f), 0) for g in every] for f in every], np.uint16)
    begins = np.array([[_step(s, x)[1] for x in range(9)] for s in states])
    return product, np.array(every, np.uint8), np.array([known[f] for f in plain], np.uint16), begins


def boundaries(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a piece begins; `code` are the code points of texts one after another, `first` marks each text's first."""
    n = len(code)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[code]
    blank = (kind == _SP) | (kind == _WS)
    nxt = np.concatenate((code[1:], [0, 0])).astype(np.uint32)
    end = np.concatenate((first[1:], [True, True]))
    symbol = kind.copy()
    solid_next = np.concatenate((~blank[1:], [False])) & ~end[:n]
    symbol[blank & solid_next] += _SPX - _SP
    mark = np.flatnonzero(code == 39)
    if len(mark):
        a, b = nxt[mark], nxt[mark + 1]
        one = ~end[mark]
        two = one & ~end[mark + 1]
        symbol[mark[one & np.isin(a, [115, 116, 109, 100])]] = _Q1
        symbol[mark[two & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))]] = _Q2
    product, image, number, begins = monoid()
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    step = np.zeros(rows * width, np.uint16)
    step[:n] = number[symbol + np.uint8(9) * first]
    step = np.ascontiguousarray(step.reshape(rows, width).T)
    for k in range(1, width):
        step[k] = product[step[k - 1], step[k]]
    enter = np.zeros(rows, np.uint8)
    for r in range(1, rows):
        enter[r] = image[step[-1, r - 1], enter[r - 1]]
    after = image[step, enter[None, :]].T.reshape(-1)[:n]
    before = np.concatenate(([np.uint8(_START)], after[:-1]))
    out = begins[before, symbol]
    return out | first


class Vocabulary:
    """Ranks of a byte-level vocabulary: merges, a cache of merged pieces, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, k in self.ranks.items():
            tokens[k] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, k in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = k
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.none = np.int64(size)
        self.forget()

    def forget(self) -> None:
        self.slots = {token: i for i, token in enumerate(self.ranks)}
        self.tokens = [np.fromiter(self.ranks.values(), np.int32, len(self.ranks))]
        self.slot_len = [np.ones(len(self.ranks), np.int32)]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair merges to; `none` where it doesn't."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], self.none)

    def merge_long(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost of equals, by a heap over linked neighbours."""
        ids = [int(self.byte[b]) for b in piece]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(k, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (k := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            k, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = k, -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if (x := self.pairs.get(k << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (x, i, k, ids[after[i]]))
            if (p := before[i]) >= 0 and (x := self.pairs.get(ids[p] << 32 | k)) is not None:
                heapq.heappush(heap, (x, p, ids[p], k))
        return [x for x in ids if x >= 0]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of short pieces one after another, and how many each has: in a round every piece makes its best merge."""
        size = np.array([len(p) for p in pieces], np.int64)
        ids = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        of = np.repeat(np.arange(len(pieces)), size)
        out_ids, out_of = [], []
        while True:
            pair = np.full(len(ids), self.none)
            same = of[1:] == of[:-1] if len(ids) else np.zeros(0, bool)
            if not out_of and not same.any():
                out_ids.append(ids)
                out_of.append(of)
                break
            at = np.flatnonzero(same)
            pair[at] = self.rank(ids[at], ids[at + 1])
            break
        if not out_of:
            while len(ids):
                head = np.flatnonzero(np.diff(of, prepend=-1))
                least = np.minimum.reduceat(pair, head)
                tail = np.append(head[1:], len(ids))
                live = least < self.none
                if not live.all():
                    done = np.repeat(~live, tail - head)
                    out_ids.append(ids[done])
                    out_of.append(of[done])
                    ids, of, pair = ids[~done], of[~done], pair[~done]
                    if not len(ids):
                        break
                    head = np.flatnonzero(np.diff(of, prepend=-1))
                    least = least[live]
                    tail = np.append(head[1:], len(ids))
                best = np.flatnonzero(pair == np.repeat(least, tail - head))
                best = best[np.flatnonzero(np.diff(of[best], prepend=-1))]
                ids[best] = pair[best]
                keep = np.ones(len(ids), bool)
                keep[best + 1] = False
                place = np.cumsum(keep) - 1
                ids, of, pair = ids[keep], of[keep], pair[keep]
                at = place[best]
                pair[at] = self.none
                right = at[np.append(of[1:] == of[:-1], False)[at]]
                pair[right] = self.rank(ids[right], ids[right + 1])
                left = at[at > 0] - 1
                left = left[of[left] == of[left + 1]]
                pair[left] = self.rank(ids[left], ids[left + 1])
        ids, of = np.concatenate(out_ids) if out_ids else ids, np.concatenate(out_of) if out_of else of
        order = np.argsort(of, kind="stable")
        return ids[order].astype(np.int32), np.bincount(of, minlength=len(pieces)).astype(np.int32)

    def learn(self, pieces: list[bytes]) -> None:
        """Put the tokens of new pieces into the cache."""
        short = [p for p in pieces if len(p) <= LONG_PIECE]
        long = [p for p in pieces if len(p) > LONG_PIECE]
        for p in short:
            self.slots[p] = len(self.slots)
        if short:
            ids, count = self.merge(short)
            self.tokens.append(ids)
            self.slot_len.append(count)
        for p in long:
            self.slots[p] = len(self.slots)
            ids = self.merge_long(p)
            self.tokens.append(np.array(ids, np.int32))
            self.slot_len.append(np.array([len(ids)], np.int32))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        whole = "".join(texts)
        chars = np.array([len(t) for t in texts], np.int64)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.zeros(len(code) + 1, bool)
        begin = np.cumsum(chars) - chars
        first[begin] = True
        starts = np.flatnonzero(boundaries(code, first[:-1]))
        width = 1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000)
        byte_at = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        raw = whole.encode("utf-8", "surrogatepass")
        cuts = byte_at[np.append(starts, len(code))].tolist()
        pieces = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        if len(self.slots) > CACHED:
            self.forget()
        new = {p for p in pieces if p not in self.slots}
        if new:
            self.learn(list(new))
        self.tokens, self.slot_len = [np.concatenate(self.tokens)], [np.concatenate(self.slot_len)]
        count = self.slot_len[0]
        start = np.cumsum(count, dtype=np.int64) - count
        slot = np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))
        many = count[slot].astype(np.int64)
        at = np.repeat(start[slot] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        bounds = np.searchsorted(starts, np.append(begin, len(code)))
        upto = np.concatenate(([0], np.cumsum(many)))
        return self.tokens[0][at], np.diff(upto[bounds])

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of the ids, and the end of each id's bytes in them."""
        size = self.length[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return self.bytes[at].tobytes(), ends


@cache
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process and file."""
    return Vocabulary(path)


def default_path() -> str:
    """The rank file used where no path is given."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _each(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    words = vocabulary(path)
    for batch in batches:
        _, offsets = spans.flat(batch.column(1))
        for i, j in spans.chunks(offsets):
            part = batch.slice(i, j - i)
            yield part, *words.encode([t or "" for t in part.column(1).to_pylist()])


def _input(docs: DataFrame, id_col: str, text_col: str, path: str) -> tuple[DataFrame, str]:
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), docs.schema[id_col].dataType.simpleString()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids, ends) of each row: the token ids of the whole text, and where each token's bytes end in its UTF-8.

    A null or empty text has no ids. The rank file must lie at `path` on every executor.
    """
    file = path or default_path()
    rows, kind = _input(docs, id_col, text_col, file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, count in _each(batches, file):
            at = np.concatenate(([0], np.cumsum(count)))
            ends = np.cumsum(vocabulary(file).length[ids])
            ends -= np.repeat(np.concatenate(([0], ends))[at[:-1]], count)
            cut = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(cut, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(ends, pa.int64()))], ["doc_id", "ids", "ends"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, ends array<bigint>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, bytes) from (doc_id, ids): the exact bytes; null ids give no bytes."""
    file = path or default_path()
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [vocabulary(file).decode(np.array(x or [], np.int64))[0] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, bytes binary")


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, lossless) of each row; lossless says that decoding the ids gave the text's exact bytes."""
    file = path or default_path()
    rows, kind = _input(docs, id_col, text_col, file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, count in _each(batches, file):
            at = np.concatenate(([0], np.cumsum(count)))
            raw, ends = vocabulary(file).decode(ids)
            byte = np.concatenate(([0], ends))[at].tolist()
            same = [raw[i:j] == (t or "").encode("utf-8", "surrogatepass") for i, j, t in zip(byte, byte[1:], part.column(1).to_pylist())]
            cut = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count, pa.int64()), pa.ListArray.from_arrays(cut, pa.array(ids, pa.int32())), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "lossless"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids array<int>, lossless boolean")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode what was encoded, keeping only digests."""
    file = path or default_path()
    rows, kind = _input(docs, id_col, text_col, file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, count in _each(batches, file):
            raw, ends = vocabulary(file).decode(ids)
            numbers = list(map(str, ids.tolist()))
            at = np.concatenate(([0], np.cumsum(count))).tolist()
            byte = np.concatenate(([0], ends))[at].tolist()
            a = [sha256(" ".join(numbers[i:j]).encode()).hexdigest() for i, j in zip(at, at[1:])]
            b = [sha256(raw[i:j]).hexdigest() for i, j in zip(byte, byte[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
