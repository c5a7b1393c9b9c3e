"""Benchmark decontamination: an FM-index over every training shard, searched for the test phrases.

A shard is some megabytes of documents within a task.  Its words become symbols; a word that no phrase has
can be part of no match, so stretches of other words are cut to separators before the index is built (exact).
Phrases are searched backward, all at once, by ranks in a wavelet matrix; occurrences are located by walking to
sampled suffix positions; overlapping and touching occurrences become one removal span.  Nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from . import textops as T
from .common import columns, drop_written, fresh, slices, written

#: Words of a phrase; items of fewer words, but at least LEAST_WORDS, are one phrase each: shorter ones are everyday speech.
PHRASE_WORDS, LEAST_WORDS = 8, 5
#: Bytes of text a shard has, bytes of benchmark text searched in one pass (its phrases take some ten times that in the
#: driver and in a task), distance of suffix samples.
SHARD_BYTES, PASS_BYTES, SAMPLE = 8 << 20, 16 << 20, 16


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffix array of ``codes``, which end in 0; every 0 is a separator of its own, smaller than all symbols."""
    n = len(codes)
    sep = codes == 0
    first = np.where(sep, np.cumsum(sep) - 1, codes.astype(np.int64) + int(sep.sum()))
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)

    def rename(at: np.ndarray, sfx: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Ranks for suffixes that lie at the places ``at`` of the order; which of them are still tied."""
        new = np.concatenate([[True], key[1:] != key[:-1]])
        begin = np.flatnonzero(new)
        rank[sfx] = at[begin[np.cumsum(new) - 1]]
        return np.repeat(np.diff(np.concatenate([begin, [len(key)]])) > 1, np.diff(np.concatenate([begin, [len(key)]])))

    open_ = np.flatnonzero(rename(np.arange(n), order, first[order]))
    k = 1
    while len(open_):
        sfx = order[open_]
        key = rank[sfx] * n + rank[sfx + k]
        o = np.argsort(key, kind="stable")
        order[open_] = sfx = sfx[o]
        open_ = open_[rename(open_, sfx, key[o])]
        k *= 2
    return order


class FMIndex:
    """Counts and locates symbol strings in ``codes`` (0 separates texts and ends the last)."""

    def __init__(self, codes: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        self.n = len(codes)
        sa = suffix_array(codes)
        self.bwt = np.where(sa > 0, codes[sa - 1], 0)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=n_symbols + 1))]).astype(np.int64)
        self.levels, now = [], self.bwt
        for bit in range(max(1, int(n_symbols).bit_length()) - 1, -1, -1):
            one = (now >> bit) & 1
            ones = np.concatenate([[0], np.cumsum(one, dtype=np.int32)]).astype(np.int32)
            self.levels.append((bit, ones, self.n - int(ones[-1])))
            now = np.concatenate([now[one == 0], now[one == 1]])
        held = (sa % sample == 0) | (self.bwt == 0)
        self.held, self.before, self.samples = held, np.cumsum(held) - held, sa[held]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol ``c`` occurs in the first ``i`` places of the BWT."""
        lo = np.zeros_like(i)
        for bit, ones, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            a, b = ones[lo], ones[i]
            lo, i = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, i - b)
        return i - lo

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each row of ``patterns``."""
        c = patterns[:, -1]
        lo, hi = self.first[c], self.first[c + 1]
        for j in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[:, j]
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array."""
        out, steps, todo = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            got = self.held[rows]
            out[todo[got]] = self.samples[self.before[rows[got]]] + steps
            todo, rows = todo[~got], rows[~got]
            c = self.bwt[rows]
            rows = self.first[c] + self.rank(c, rows)
            steps += 1
        return out


@dataclass
class Phrases:
    """Test phrases: word hashes in order as symbols 1.., and per length the distinct phrases, and where the items of each (rows of ``ids``)
    begin in a list."""

    vocab: np.ndarray
    by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    ids: list[int | None]

    @property
    def shortest(self) -> int:
        return min((p.shape[1] for p, *_ in self.by_length), default=0)

    @property
    def mark(self) -> np.ndarray:
        bits = np.zeros(1 << 20, bool)
        bits[(self.vocab >> np.uint64(44)).astype(np.int64)] = True
        return bits


def phrases(items: list[tuple[int, str]], n: int = PHRASE_WORDS, least: int = LEAST_WORDS) -> Phrases:
    """All ``n``-word windows of the items; an item of fewer words, but ``least``, is one phrase."""
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for w in T.words(pa.array([t for _, t in items], pa.large_string())):
        for d in np.flatnonzero(w.counts() >= max(1, least)).tolist():
            h = w.hash[w.ptr[d] : w.ptr[d + 1]]
            windows = np.lib.stride_tricks.sliding_window_view(h, min(n, len(h)))
            found.setdefault(windows.shape[1], []).append((windows, np.full(len(windows), w.first + d)))
    vocab = np.unique(np.concatenate([x.ravel() for parts in found.values() for x, _ in parts])) if found else np.zeros(0, np.uint64)
    by = []
    for _, parts in sorted(found.items()):
        code = np.concatenate([np.searchsorted(vocab, x).astype(np.int32) + 1 for x, _ in parts])
        owner = np.concatenate([o for _, o in parts])
        distinct, of = np.unique(code, axis=0, return_inverse=True)
        order = np.argsort(of.ravel(), kind="stable")
        by.append((distinct.astype(np.int64), np.searchsorted(of.ravel()[order], np.arange(len(distinct) + 1)), owner[order]))
    return Phrases(vocab, by, [i for i, _ in items])


def _coded(h: np.ndarray, vocab: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Symbols of word hashes; 0 for words that no phrase has."""
    out = np.zeros(len(h), np.int64)
    maybe = np.flatnonzero(mark[(h >> np.uint64(44)).astype(np.int64)])
    at = np.searchsorted(vocab, h[maybe])
    ok = vocab[np.minimum(at, len(vocab) - 1)] == h[maybe]
    out[maybe[ok]] = at[ok] + 1
    return out


def spans_of(texts: pa.Array, ph: Phrases, mark: np.ndarray) -> list[tuple[int, int, int, int, int, list[int]]]:
    """(row, first word, first char, end char, words, items) of every removal span in the shard ``texts``."""
    if not len(ph.vocab):
        return []
    parts = list(T.words(texts))
    code = np.concatenate([_coded(w.hash, ph.vocab, mark) for w in parts]) if parts else np.zeros(0, np.int64)
    row = np.concatenate([w.first + w.doc_of_word() for w in parts]) if parts else np.zeros(0, np.int64)
    if not len(code):
        return []
    # stretches of one text whose words all occur in phrases, as long as the shortest phrase
    known = code > 0
    cut = np.concatenate([[True], (known[1:] != known[:-1]) | (row[1:] != row[:-1])])
    begin = np.flatnonzero(cut)
    length = np.diff(np.concatenate([begin, [len(code)]]))
    ok = known[begin] & (length >= ph.shortest)
    begin, length = begin[ok], length[ok]
    if not len(begin):
        return []
    # word of each symbol, with a separator after each stretch
    size = length + 1
    origin = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    codes = code[np.minimum(origin, len(code) - 1)]
    codes[np.cumsum(size) - 1] = 0
    index = FMIndex(codes, len(ph.vocab))
    edge = np.zeros(len(code) + 1, np.int32)
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for pats, first, owner in ph.by_length:
        lo, hi = index.search(pats)
        n = hi - lo
        which = np.repeat(np.arange(len(pats)), n)
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        at = origin[index.locate(rows)]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + pats.shape[1], -1)
        hits.append((at, which, first, owner))
    covered = np.cumsum(edge[:-1]) > 0
    cut = np.concatenate([[True], (covered[1:] != covered[:-1]) | (row[1:] != row[:-1])])
    begin = np.flatnonzero(cut)
    end = np.concatenate([begin[1:], [len(code)]])
    begin, end = begin[covered[begin]], end[covered[begin]]
    named: list[set] = [set() for _ in begin]
    for at, which, first, owner in hits:
        for s, k in set(zip((np.searchsorted(begin, at, side="right") - 1).tolist(), which.tolist())):
            named[s].update(ph.ids[i] for i in owner[first[k] : first[k + 1]].tolist())
    start_b, end_b = np.concatenate([w.start for w in parts]), np.concatenate([w.end for w in parts])
    out = []
    for s, (b, e) in enumerate(zip(begin.tolist(), end.tolist())):
        r = int(row[b])
        a, z = T.byte_to_char(texts[r].as_py(), np.array([start_b[b], end_b[e - 1]])).tolist()
        out.append((r, b - int(np.searchsorted(row, r)), a, z, e - b, sorted(x for x in named[s] if x is not None)))
    return out


def _passes(benchmark: DataFrame, n: int, least: int, most: int) -> Iterator[tuple[Broadcast, bool]]:
    """The phrases, in as many parts as their size needs, and which part is the last.

    A part exists in the driver only until it is handed out, so that is bounded by ``most`` here as in a task."""
    items = columns(benchmark, item_id="long", text="string").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // most))
    part = F.pmod(F.xxhash64("text", "item_id"), F.lit(parts))
    for k in range(parts):
        rows = (items.where(part == k) if parts > 1 else items).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(phrases([(r[0], r[1]) for r in rows], n, least)), k == parts - 1


def _merged(spans: list[tuple]) -> list[tuple[int, int, int, int, list[int]]]:
    """Spans (first word, first char, end char, words, items) of one text: those that overlap or touch become one."""
    out: list[list] = []
    for k, a, z, w, items in sorted(spans):
        if out and k <= out[-1][0] + out[-1][3]:
            last = out[-1]
            if k + w > last[0] + last[3]:
                last[2], last[3] = z, k + w - last[0]
            last[4] = sorted({*last[4], *items})
        else:
            out.append([k, a, z, w, items])
    return [tuple(x) for x in out]


def _searched(docs: DataFrame, text: str, passes: Iterator[tuple[Broadcast, bool]], last: Callable, schema) -> DataFrame:
    """``docs`` through all passes, each over the original text.  ``last`` makes the resulting batch of a batch without
    the carried spans and the merged spans by row; what the passes before the last found is carried in a column.  Between
    passes rows are written, so that a task holds the phrases of one only."""
    carry = fresh("qw_spans", docs.columns)
    names = docs.columns

    def run(part: Broadcast, first: bool, final: bool):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ph = part.value
            mark = ph.mark
            for batch in slices(batches, text, SHARD_BYTES):
                by: dict[int, list] = {}
                if not first:
                    for r, held in enumerate(batch.column(len(names)).to_pylist()):
                        if held is not None:
                            by[r] = [tuple(x) for x in json.loads(held)]
                for r, *span in spans_of(batch.column(names.index(text)), ph, mark):
                    by.setdefault(r, []).append(tuple(span))
                if final:
                    bare = pa.RecordBatch.from_arrays(batch.columns[: len(names)], schema=pa.schema(list(batch.schema)[: len(names)]))
                    yield from last(bare, {r: _merged(x) for r, x in sorted(by.items())})
                else:
                    held = pa.array([json.dumps(by[r]) if r in by else None for r in range(batch.num_rows)], pa.string())
                    yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], held], names=[*names, carry])

        return each

    carried = T_.StructType([*docs.schema, T_.StructField(carry, T_.StringType())])
    for k, (part, final) in enumerate(passes):
        if final:
            return docs.mapInArrow(run(part, k == 0, True), schema)
        then = written(docs.mapInArrow(run(part, k == 0, False), carried), "spans")
        if k:
            drop_written(docs)
        docs = then


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = PHRASE_WORDS, most: int = PASS_BYTES, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, span_start, span_end, n_words, items): where documents hold phrases of the benchmark.

    A phrase is ``n`` consecutive words of an item, or all words of an item that has fewer, but ``least`` (items of still fewer words are not
    searched; 1 searches all); case and what stands between words don't count.  Offsets are characters, the end exclusive; items are the ids of the
    items met, in order, joined by commas (an item without id counts, but isn't named).  A document without
    phrases has no row.  Null and empty texts have none; texts of any length are searched whole; a null doc_id stays null; repeated
    rows each have their spans; items of equal text are all named.  Other columns are not looked at.  A benchmark beyond ``most`` bytes is
    searched in several passes, with the same result; an empty one, or an empty table, gives an empty result.
    """
    src = columns(docs, doc_id="long", text="string")
    fields = pa.schema([("doc_id", pa.int64()), ("span_start", pa.int64()), ("span_end", pa.int64()), ("n_words", pa.int64()), ("items", pa.string())])

    def rows(batch: pa.RecordBatch, spans: dict[int, list]) -> Iterator[pa.RecordBatch]:
        found = [(r, a, z, w, ",".join(map(str, items))) for r, of in spans.items() for _, a, z, w, items in of]
        if found:
            at, a, z, w, items = zip(*found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(a, pa.int64()), pa.array(z, pa.int64()), pa.array(w, pa.int64()), pa.array(items)], schema=fields)

    return _searched(src, "text", _passes(benchmark, n, least, most), rows, "doc_id long, span_start long, span_end long, n_words long, items string")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = PHRASE_WORDS, most: int = PASS_BYTES, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the spans of :func:`leaks` cut out of ``text`` and ``n_chars`` (if there) set anew.

    A document of which no word is left goes; one that nothing is cut from stays as it was, null and empty
    texts and rows without doc_id too.  Repeated rows are cut alike and all stay; texts of any length are searched whole, and nothing depends on an order, so ties can't
    occur.  All columns come back, whatever their names (of several that differ from ``text`` in case only the first is it).  A benchmark of several passes cuts the same spans, once;
    an empty one cuts nothing, and an empty table stays empty.
    """
    names = docs.columns
    text_at = next(i for i, c in enumerate(names) if c.lower() == "text")
    size_at = next((i for i, c in enumerate(names) if c.lower() == "n_chars"), None)

    def cut(batch: pa.RecordBatch, spans: dict[int, list]) -> Iterator[pa.RecordBatch]:
        if not spans:
            yield batch
            return
        texts = batch.column(text_at).to_pylist()
        stay = np.ones(len(texts), bool)
        sizes = batch.column(size_at).to_pylist() if size_at is not None else None
        for r, of in spans.items():
            t, at, left = texts[r], 0, []
            for _, a, z, *_ in of:
                left.append(t[at:a])
                at = z
            texts[r] = "".join([*left, t[at:]])
            stay[r] = any(c.isalnum() for c in texts[r])
            if sizes is not None:
                sizes[r] = len(texts[r])
        cols = list(batch.columns)
        cols[text_at] = pa.array(texts, batch.column(text_at).type)
        if sizes is not None:
            cols[size_at] = pa.array(sizes, batch.column(size_at).type)
        yield pa.RecordBatch.from_arrays(cols, schema=batch.schema).filter(pa.array(stay))

    return _searched(docs, names[text_at], _passes(benchmark, n, least, most), cut, docs.schema)


_W = "[0-9a-zA-Z\\x{C0}-\\x{1FFF}\\x{2040}-\\x{2FFF}\\x{3040}-\\x{10FFFF}]"
SQL = f"""
WITH t AS (SELECT doc_id, unnest(x) AS tok, unnest(range(len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_W}+|[^{_W[1:]}+') AS x FROM documents)),
o AS (SELECT *, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM t),
w AS (SELECT doc_id, e - length(tok) AS s, e, lower(tok) AS word, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o WHERE regexp_matches(tok, '^{_W}')),
x AS (SELECT doc_id, list(word ORDER BY k) AS x FROM w GROUP BY doc_id),
b AS (SELECT item_id, regexp_extract_all(lower(text), '{_W}+') AS x FROM benchmark),
z AS (SELECT item_id, x, least(len(x), {PHRASE_WORDS}) AS m FROM b WHERE len(x) >= {LEAST_WORDS}),
p AS (SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(x) - m + 2), lambda i: array_to_string(x[i:i + m - 1], ' '))) AS gram FROM z),
g AS (SELECT doc_id, m, unnest(list_transform(range(1, len(x) - m + 2), lambda i: array_to_string(x[i:i + m - 1], ' '))) AS gram,
        unnest(range(1, len(x) - m + 2)) AS k FROM x, (SELECT DISTINCT m FROM p) WHERE len(x) >= m),
h AS (SELECT doc_id, k, m, item_id FROM g JOIN p USING (gram, m)),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + m)) AS k FROM h),
i AS (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS island FROM c),
r AS (SELECT doc_id, min(k) AS a, max(k) AS z FROM i GROUP BY doc_id, island),
n AS (SELECT r.doc_id, a, z, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items
      FROM r JOIN (SELECT DISTINCT doc_id, k, item_id FROM h) h ON h.doc_id = r.doc_id AND h.k BETWEEN a AND z GROUP BY ALL)
SELECT n.doc_id, CAST(u.s AS BIGINT) AS span_start, CAST(v.e AS BIGINT) AS span_end, CAST(z - a + 1 AS BIGINT) AS n_words, items
FROM n JOIN w u ON u.doc_id = n.doc_id AND u.k = a JOIN w v ON v.doc_id = n.doc_id AND v.k = z
"""
