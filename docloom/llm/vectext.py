"""Vectorised text primitives: words, shingles and pre-tokens of many texts at once as numpy arrays."""

from __future__ import annotations

import copy
import ctypes
import hashlib
import sys
import unicodedata
from collections.abc import Callable, Hashable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step holds; a longer text makes a step of its own.
STEP_BYTES = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


#: The one large thing that a worker process holds from task to task.
_kept: dict = {}


def kept[T](key: Hashable, make: Callable[[], T]) -> T:
    """What make gives, held by the worker process until another thing is asked for or a step begins that uses none."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES, keeps: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches' rows, cut so that a step's texts take at most limit bytes or are one row.

    keeps: the caller uses what the worker holds (`kept`); else that is dropped first, as it belongs to a step before.
    After the last one the worker's free memory goes back to the machine: the next task may run in another worker.
    """
    if not keeps:
        _kept.clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, base = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at, base = to, int(ends[to - 1])
    _give_back()


def gives_back(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step that doesn't cut its batches by `steps`, after which the worker's free memory goes back to the machine all the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _kept.clear()
        yield from step(batches)
        _give_back()

    return run


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    _trim()


@lru_cache(1)
def _libc():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library keeps its own counsel
        return lambda _: 0


def _trim() -> None:
    _libc()(0)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end, and the n + 1 offsets of the texts in them; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of texts with A-Z lower-cased: two hashes, text number, start and end byte."""

    def __init__(self, texts: pa.Array) -> None:
        raw, self.offsets = utf8(texts)
        self.bytes = _LOWER[raw]
        n, space = len(raw), _SPACE[raw]
        begin = ~space
        if n:
            begin[1:] &= space[:-1]
            edge = self.offsets[:-1][self.offsets[:-1] < n]
            begin[edge] |= ~space[edge]
            last = np.empty(n, bool)
            last[:-1] = begin[1:] | space[1:]
            last[-1] = True
            last &= ~space
            self.start, self.end = np.flatnonzero(begin), np.flatnonzero(last) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.text = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.hash, self.check = span_hash(self.bytes, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)


#: Bytes that span_hash reads eight at a time; longer spans go to a digest of their own.
_LANED = 256
_K1, _K2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each of the spans values[start:end] of bytes, 128 bits in all.

    Every eight bytes pass through a scramble that is not linear before the next eight are taken in, so no
    strings collide by their form. Only the span's bytes and length count, not where it lies.
    """
    length = (end - start).astype(np.int64)
    h, g = length.astype(np.uint64) * _M1, length.astype(np.uint64) * _M2
    if not len(start):
        return h, g
    padded = np.concatenate([values, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(values) + 1,), "<u8", padded, strides=(1,))
    big = np.flatnonzero(length > _LANED)
    at, left, live = start.astype(np.int64), length, np.flatnonzero((length > 0) & (length <= _LANED))
    at, left = at[live], left[live]
    while len(live):
        lane = eight[at] & _MASK[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ lane) * _K1)
        other = (g[live] + lane) * _K2
        other ^= other >> np.uint64(29)
        g[live] = other * _M1 ^ other >> np.uint64(32)
        more = left > 8
        at, left, live = at[more] + 8, left[more] - 8, live[more]
    for i in big.tolist():
        digest = hashlib.blake2b(values[start[i] : end[i]].tobytes(), digest_size=16).digest()
        h[i], g[i] = np.frombuffer(digest, np.uint64)
    return h, mix(g)


def _then(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The hash of a sequence that goes on with h."""
    return (before ^ before >> np.uint64(31)) * _M1 + h


def shingles(words: Words, size: int, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of size words, or of a shorter text's whole sequence; sorted and distinct."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    count = np.bincount(words.text, minlength=n_texts)
    h = words.hash.copy()
    n = len(h)
    out_text, out_hash = [], []
    if n >= size:
        rolled = h[: n - size + 1].copy()
        for i in range(1, size):
            rolled = _then(rolled, h[i : n - size + 1 + i])
        same = words.text[: n - size + 1] == words.text[size - 1 :]
        out_text.append(words.text[: n - size + 1][same])
        out_hash.append(mix(rolled[same]))
    few = np.flatnonzero((count > 0) & (count < size))
    if few.size:
        first = np.concatenate([[0], np.cumsum(count)[:-1]])[few]
        rolled = h[first]
        for i in range(1, size - 1):
            more = count[few] > i
            rolled[more] = _then(rolled[more], h[first[more] + i])
        out_text.append(few)
        out_hash.append(mix(rolled + count[few].astype(np.uint64)))
    text, value = np.concatenate(out_text), np.concatenate(out_hash)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[keep], value[keep]


@lru_cache(1)
def char_classes() -> np.ndarray:
    """For each code point: 1 letter, 2 number, 3 white space, 0 other."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        table[c] = 1 if kind == "L" else 2 if kind == "N" else 0
    # White_Space of the Unicode character database
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    return table


class PreTokens:
    """Byte-level BPE's pre-tokens of texts: text number, start and end code point, start and end byte, two hashes.

    The rule is 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ .
    """

    def __init__(self, texts: list[str]) -> None:
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.bytes = joined.encode()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(size)])
        n = len(codes)
        kind = char_classes()[codes]
        begin = np.zeros(n + 1, bool)
        begin[self.offsets] = True
        edge = begin.copy()
        change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        begin[change] = True
        # A run of white space before something else leaves its last character: a plain space goes to what follows.
        ahead = change[kind[change - 1] == 3]
        ahead = ahead[~edge[ahead]]
        begin[ahead - 1] = True
        begin[ahead[codes[ahead - 1] == 0x20]] = False
        # Contractions: an apostrophe that starts a match, and so doesn't follow a plain space.
        mark = np.flatnonzero(codes == 0x27)
        mark = mark[begin[mark]]
        if mark.size:
            pad = np.concatenate([codes, np.zeros(3, np.uint32)])
            one, two = pad[mark + 1], pad[mark + 2]
            room = self.offsets[np.searchsorted(self.offsets, mark, side="right")] - mark
            short = np.isin(one, [ord(c) for c in "stmd"]) & (room >= 2)
            long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & (room >= 3)
            for hit, width in ((mark[short], 2), (mark[long & ~short], 3)):
                begin[hit + 1] = False
                begin[hit + width] = True
        start = np.flatnonzero(begin[:-1])
        self.start, self.end = start, np.concatenate([start[1:], [n]]) if len(start) else start
        self.text = np.searchsorted(self.offsets, start, side="right") - 1
        self.first, self.last = self.start, self.end
        if len(self.bytes) > n:
            wide = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000), dtype=np.int64)])
            self.first, self.last = wide[self.start], wide[self.end]
        self.hash, self.check = span_hash(np.frombuffer(self.bytes, np.uint8), self.first, self.last)

    def take(self, which: np.ndarray) -> PreTokens:
        """Some of the pre-tokens."""
        part = copy.copy(self)
        for name in ("start", "end", "first", "last", "text", "hash", "check"):
            setattr(part, name, getattr(self, name)[which])
        return part

    def words(self, which: np.ndarray) -> list[bytes]:
        """The bytes of some pre-tokens."""
        return [self.bytes[a:b] for a, b in zip(self.first[which].tolist(), self.last[which].tolist(), strict=True)]
