"""Shape statistics of texts, from raw bytes, shared by the quality operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import textops as T

#: Names of the statistics, as shares that are shrunk towards a typical value the more the shorter the text.
NAMES = ("symbols", "marks", "capitals", "word_chars", "again", "distinct", "lines")
#: Typical values, and of how many words the prior of a text is worth.
TYPICAL = np.array([0.002, 0.03, 0.04, 0.83, 0.004, 0.75, 0.03])
PRIOR_WORDS = 40

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*|<>{}[]^~\\`"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Least standard deviation of each statistic (transformed): smaller differences mean nothing.
FLOOR = np.array([0.08, 0.01, 0.08, 0.006, 0.08, 0.08, 0.08])


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (c[off[1:]] - c[off[:-1]]).astype(np.float64)


def statistics(texts: pa.Array) -> Iterator[tuple[T.Words, np.ndarray, np.ndarray]]:
    """(words, number of words, statistics) of some texts at a time; statistics has a row per text."""
    raw, off = T._buffers(texts)
    for w in T.words(texts):
        a, z = off[w.first], off[w.first + w.n_docs]
        part, o = raw[a:z], off[w.first : w.first + w.n_docs + 1] - a
        n_bytes = np.diff(o).astype(np.float64)
        n = w.counts().astype(np.float64)
        row = w.doc_of_word()
        inside = np.bincount(row, weights=w.end - w.start, minlength=w.n_docs)
        same = np.zeros(len(w.hash), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
        key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24)))
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=w.n_docs).astype(np.float64)
        # the share of distinct words falls with length: that of a typical text of n words is n ** -0.15
        distinct = distinct / np.maximum(n, 1) ** 0.85
        lines = _sums(part == 10, o)
        prior_bytes = PRIOR_WORDS * 6.0
        share = lambda x, base, prior, k: (x + k * prior) / (base + k)
        x = np.stack(
            [
                share(_sums(_SYMBOL[part], o), n_bytes, TYPICAL[0], prior_bytes),
                share(_sums(_MARK[part], o), n_bytes, TYPICAL[1], prior_bytes),
                share(_sums(_UPPER[part], o), n_bytes, TYPICAL[2], prior_bytes),
                share(inside, n_bytes, TYPICAL[3], prior_bytes),
                share(np.bincount(row, weights=same, minlength=w.n_docs), n, TYPICAL[4], PRIOR_WORDS),
                share(distinct * n, n, TYPICAL[5], PRIOR_WORDS),
                share(lines, n, TYPICAL[6], PRIOR_WORDS),
            ],
            axis=1,
        )
        yield w, n, x


def transformed(x: np.ndarray) -> np.ndarray:
    """The statistics on scales on which those of ordinary prose are about normal."""
    log = np.log
    return np.stack([log(x[:, 0] + 0.01), np.sqrt(x[:, 1]), log(x[:, 2] + 0.02), x[:, 3], log(x[:, 4] + 0.02), x[:, 5], log(x[:, 6] + 0.02)], axis=1)
