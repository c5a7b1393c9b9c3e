"""Vectorised word hashing over Arrow string columns, shared by the operators of this subpackage.

A *word* is a maximal run of letters and digits: ASCII letters and digits, and any character outside
ASCII except the Latin-1 signs (U+0080-U+00BF), the general punctuation block (U+2000-U+203F) and the
CJK punctuation block (U+3000-U+303F).  Words are compared without regard to case.  All work is done
by numpy over the raw UTF-8 bytes, in chunks of bounded size, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that one chunk holds, unless a single text is longer.
CHUNK_BYTES = 1 << 20
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_GRAM = U64(0xC2B2AE3D27D4EB4F)
_GRAM_INV = U64(pow(int(_GRAM), -1, 1 << 64))
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)

_WORD = np.zeros(256, dtype=bool)
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True
_WORD[ord("A") : ord("Z") + 1] = True
_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit of ``x`` over the result."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64; kept and grown between calls."""
    key = (int(base), 0)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.ones(size, dtype=np.uint64)
        have[1:] = base
        have = np.multiply.accumulate(have)
        _powers[key] = have
    return have[:n]


@dataclass
class Words:
    """The words of some consecutive texts.

    ``hash`` has one 64-bit value per word, ``start``/``end`` their byte offsets in the text they belong
    to, ``ptr`` the first word of each text (one more entry than texts), ``first`` the row of the first text.
    """

    first: int
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.ptr) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts())


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls (nulls become empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _fold(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Case-folded bytes, and which of them belong to words."""
    low, word = _LOWER[raw], _WORD[raw]
    lead = raw >= 0xC2
    if lead.any():
        # Latin-1 capitals: C3 80 - C3 9E, without the multiplication sign
        c3 = np.flatnonzero(raw[:-1] == 0xC3) + 1
        nxt = raw[c3]
        up = c3[(nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)]
        low[up] += 32
        c2 = np.flatnonzero(raw == 0xC2)
        for k in (0, 1):
            word[np.minimum(c2 + k, len(raw) - 1)] = False
        if len(raw) > 2:
            e2 = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x80))
            e3 = np.flatnonzero((raw[:-2] == 0xE3) & (raw[1:-1] == 0x80))
            for k in (0, 1, 2):
                word[e2 + k] = False
                word[e3 + k] = False
    return low, word


def _needs_unicode_fold(raw: np.ndarray) -> bool:
    """Whether cased letters beyond Latin-1 may occur."""
    lead = np.bincount(raw, minlength=256)[0xC4:0xF5]
    return bool(lead.any())


def _lower_same_length(text: str) -> str:
    low = text.lower()
    if len(low.encode()) == len(text.encode()):
        return low
    return "".join(y if len((y := c.lower()).encode()) == len(c.encode()) else c for c in text)


def words(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """Word hashes of ``texts``, some texts at a time; a null text has no words."""
    raw_all, off = _buffers(texts)
    n = len(off) - 1
    at = 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + chunk_bytes, side="right")) - 1
        to = min(n, max(to, at + 1))
        raw = raw_all[off[at] : off[to]]
        o = off[at : to + 1] - off[at]
        if len(raw) and _needs_unicode_fold(raw):
            part = texts.slice(at, to - at).to_pylist()
            raw = np.frombuffer("".join(_lower_same_length(t or "") for t in part).encode(), dtype=np.uint8)
        yield _hash(raw, o, at)
        at = to


def _hash(raw: np.ndarray, off: np.ndarray, first: int) -> Words:
    size = len(raw)
    if size == 0:
        z = np.zeros(0, np.int64)
        return Words(first, np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64))
    low, word = _fold(raw)
    before = np.empty(size, bool)
    before[0] = False
    before[1:] = word[:-1]
    inner = off[:-1][off[:-1] < size]
    before[inner] = False
    begin = np.flatnonzero(word & ~before)
    after = np.empty(size, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = off[1:][off[1:] > 0] - 1
    after[ends] = False
    end = np.flatnonzero(word & ~after) + 1
    sums = np.empty(size + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[low] * powers(_BASE, size), out=sums[1:])
    h = mix((sums[end] - sums[begin]) * powers(_BASE_INV, size)[begin])
    ptr = np.searchsorted(begin, off).astype(np.int64)
    base = np.repeat(off[:-1], np.diff(ptr))
    return Words(first, h, begin - base, end - base, ptr)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all ``n``-word windows, in order, and the first window of each text.

    A text of fewer than ``n`` words, but some, has one window: all its words.
    """
    total, counts = len(w.hash), w.counts()
    windows = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    ptr = np.concatenate([[0], np.cumsum(windows)]).astype(np.int64)
    if total == 0:
        return np.zeros(0, np.uint64), ptr
    at = np.repeat(w.ptr[:-1] - ptr[:-1], windows) + np.arange(ptr[-1])
    stop = np.minimum(at + n, np.repeat(w.ptr[1:], windows))
    return window_hash(w.hash, at, stop), ptr


def window_hash(h: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the runs ``h[at:stop]``."""
    sums = np.empty(len(h) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(h * powers(_GRAM, len(h)), out=sums[1:])
    length = (stop - at).astype(np.uint64)
    return mix((sums[stop] - sums[at]) * powers(_GRAM_INV, len(h) + 1)[at] + length)


def byte_to_char(text: str | None, positions: np.ndarray) -> np.ndarray:
    """Character offsets of byte offsets in one text."""
    if not text or text.isascii():
        return positions
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return chars[positions]
