"""Substring dedup by recompression: equal substrings get equal interior symbols, at every level.

The words of each text are compressed in rounds.  A round replaces maximal runs of one symbol, then disjoint pairs
(left, right), where a round's seeded coin says of every symbol whether it is a left or a right one.  Names are 64-bit
hashes of what they stand for, so the same run or pair has the same name in every document and task: naming is global
without a shuffle.  Whether two neighbours merge depends on them alone, so two occurrences of a passage differ
in a few symbols at their ends only.  A symbol that has grown to SYMBOL_WORDS words stays as it is.

Symbols of that size which several documents have reveal candidate regions.  They are verified by the hash of every
window of ``min_words`` words in the regions; windows that occur in several documents are merged to spans.
Both rounds shuffle packed columns (hash, document, place), and each partition is settled by one sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import bin_of, columns, ints, n_partitions, slices

#: Words a repeat must have, words from which a symbol stays, rounds.
MIN_WORDS, SYMBOL_WORDS, ROUNDS = 50, 6, 14
#: Bytes of text whose symbols one partition of hashes holds.
PART_BYTES = 128 << 20
_U = np.uint64
_COIN = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64)
_RUN, _PAIR, _LONG = _U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25), _U(0xD6E8FEB86659FD93)


def symbols(h: np.ndarray, ptr: np.ndarray, least: int = SYMBOL_WORDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, first words, words) of the symbols of ``least`` words or more of the texts ``h[ptr[i]:ptr[i + 1]]``.

    A run that reaches ``least`` words goes by what it repeats, however often: runs cut by
    the end of a passage stay alike."""
    at = np.arange(len(h))
    size = np.ones(len(h), np.int64)
    last = np.zeros(len(h), bool)
    ends = ptr[1:][np.diff(ptr) > 0] - 1
    last[ends] = True
    name = h
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for r in range(rounds):
        if len(name) == 0:
            break
        # runs; symbols that stay are no part of any
        done = size >= least
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | last[:-1] | done[1:] | done[:-1]
        if not new.all():
            begin = np.flatnonzero(new)
            times = np.diff(np.concatenate([begin, [len(name)]]))
            total = np.add.reduceat(size, begin)
            base, last = name[begin], last[begin + times - 1]
            many = times > 1
            long = many & (total >= least)
            name = np.where(many, T.mix(base * _RUN + times.astype(np.uint64)), base)
            name[long] = T.mix(base[long] ^ _LONG)
            at, size = at[begin], total
            done = size >= least
        # pairs
        right = (T.mix(name ^ _COIN[r]) >> _U(63)).astype(bool)
        joins = np.zeros(len(name), bool)
        joins[:-1] = ~right[:-1] & right[1:] & ~last[:-1] & ~done[:-1] & ~done[1:]
        k = np.flatnonzero(joins)
        name, size, last = name.copy(), size.copy(), last.copy()
        name[k] = T.mix(T.mix(name[k]) * _PAIR + name[k + 1])
        size[k] += size[k + 1]
        last[k] = last[k + 1]
        stay = np.ones(len(name), bool)
        stay[k + 1] = False
        name, at, size, last = name[stay], at[stay], size[stay], last[stay]
        # symbols between two that stay can't grow: leave out those that stay but keep what parts their neighbours
        done = size >= least
        if done.any():
            out.append((name[done], at[done], size[done]))
            apart = np.zeros(len(name), bool)
            apart[:-1] = done[1:]
            last = last | apart
            name, at, size, last = name[~done], at[~done], size[~done], last[~done]
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _packed(h: np.ndarray, doc: np.ndarray, places: list[np.ndarray], n_parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, n, blob): the entries of each range of hashes, column after column."""
    if len(h) == 0:
        return
    part = bin_of(h, n_parts)
    order = np.argsort(part, kind="stable")
    h, doc, places, part = h[order], doc[order], [p[order].astype(np.int32) for p in places], part[order]
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    end = np.concatenate([begin[1:], [len(h)]])
    blobs = [b"".join(x[a:b].tobytes() for x in (h, doc, *places)) for a, b in zip(begin.tolist(), end.tolist())]
    yield pa.RecordBatch.from_arrays([pa.array(part[begin]), pa.array(end - begin, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "n", "blob"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the packed entries of a partition, the places of hashes that several documents have, by document."""
    hs, ds, ps = [], [], []
    for batch in batches:
        for n, blob in zip(batch.column(1).to_pylist(), batch.column(2)):
            raw = blob.as_buffer()
            hs.append(np.frombuffer(raw, np.uint64, n))
            ds.append(np.frombuffer(raw, np.int64, n, 8 * n))
            ps.append(np.frombuffer(raw, np.int32, 2 * n, 16 * n).reshape(2, n))
    if not hs:
        return
    h, d, p = np.concatenate(hs), np.concatenate(ds), np.concatenate(ps, axis=1)
    del hs, ds, ps
    order = np.argsort(h)
    h, d = h[order], d[order]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    several = np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin)
    ok = np.repeat(several, np.diff(np.concatenate([begin, [len(h)]])))
    d, p = d[ok], p[:, order[ok]]
    order = np.argsort(d, kind="stable")
    d, p = d[order], p[:, order]
    if len(d) == 0:
        return
    begin = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    end = np.concatenate([begin[1:], [len(d)]])
    step = 20_000
    for k in range(0, len(begin), step):
        cut = list(zip(begin[k : k + step].tolist(), end[k : k + step].tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(d[begin[k : k + step]]), pa.array([np.ascontiguousarray(p[:, a:b]).tobytes() for a, b in cut], pa.binary())], names=["doc_id", "places"])


def _name(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 32 << 20):
            ids = ints(batch, "doc_id")
            parts = []
            for w in T.words(batch.column(1)):
                name, at, size = symbols(w.hash, w.ptr)
                row = np.searchsorted(w.ptr, at, side="right") - 1
                parts.append((name, ids[w.first + row], at - w.ptr[row], size))
            if parts:
                h, d, p, s = (np.concatenate(x) for x in zip(*parts))
                yield from _packed(h, d, [p, s], n_parts)

    return run


def _windows(n_parts: int, min_words: int):
    """Hashes of the windows that hold a shared symbol, with the characters they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            ids, texts, places = ints(batch, "doc_id"), batch.column(1), batch.column(2)
            parts = []
            for w in T.words(texts):
                edge = np.zeros(len(w.hash) + 1, np.int32)
                for d in range(w.n_docs):
                    n = int(w.ptr[d + 1] - w.ptr[d])
                    if n >= min_words:
                        at, size = np.concatenate([np.frombuffer(x.as_buffer(), np.int32).reshape(2, -1) for x in places[w.first + d].values], axis=1)
                        # windows with SYMBOL_WORDS words of the symbol at least: of a long run they needn't hold all
                        a = np.maximum(0, at + SYMBOL_WORDS - min_words)
                        z = np.minimum(at + size - SYMBOL_WORDS, n - min_words)
                        ok = a <= z
                        np.add.at(edge, w.ptr[d] + a[ok], 1)
                        np.add.at(edge, w.ptr[d] + z[ok] + 1, -1)
                at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                if not len(at):
                    continue
                row = np.searchsorted(w.ptr, at, side="right") - 1
                start, end = w.start[at].copy(), w.end[at + min_words - 1].copy()
                begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(row)]):
                    text = texts[w.first + int(row[a])].as_py()
                    if not text.isascii():
                        start[a:b], end[a:b] = T.byte_to_char(text, start[a:b]), T.byte_to_char(text, end[a:b])
                parts.append((T.window_hash(w.hash, at, at + min_words), ids[w.first + row], start, end))
            if parts:
                h, d, s, e = (np.concatenate(x) for x in zip(*parts))
                yield from _packed(h, d, [s, e], n_parts)

    return run


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping intervals as one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] >= end[:-1]])
    begin = np.flatnonzero(new)
    return start[begin], end[np.concatenate([begin[1:], [len(start)]]) - 1]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, a, z = [], [], []
        for doc, places in zip(batch.column(0).to_pylist(), batch.column(1)):
            both = np.concatenate([np.frombuffer(x.as_buffer(), np.int32).reshape(2, -1) for x in places.values], axis=1)
            s, e = merged(both[0].astype(np.int64), both[1].astype(np.int64))
            ids += [doc] * len(s)
            a.append(s)
            z.append(e)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(a)), pa.array(np.concatenate(z))], names=["doc_id", "span_start", "span_end"])


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, span_start, span_end): the characters of each document that lie in a passage of ``min_words`` words or
    more which another document has too, the end exclusive.

    Words are compared without regard to case and to what stands between them.  Passages that
    overlap are one span.  Documents without such a passage, null, empty and short texts have no row.  Rows
    without doc_id are left out.  Rows that share a doc_id count as one document: what only they have in common is
    no repeat, and their spans are merged.  Other columns are not looked at; an empty table gives an empty
    result.  A passage is found if one of its symbols is shared; at 50 words all but about one in a
    thousand are, longer ones practically always.  What is found is exact but for collisions of 64-bit hashes.  Texts of any length are
    taken whole; nothing is ranked, so ties can't occur.
    """
    if min_words < 4 * SYMBOL_WORDS:
        raise ValueError(f"min_words must be {4 * SYMBOL_WORDS} at least: shorter passages needn't hold a whole symbol")
    src = columns(docs, doc_id="long", text="string").where("doc_id is not null and text is not null")
    # a partition of hashes is sorted in one task: as many as the size of the texts needs
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(n_partitions(docs.sparkSession), -(-size // PART_BYTES))
    named = src.mapInArrow(_name(n), "part int, n long, blob binary").repartitionById(n, F.col("part"))
    shared = named.mapInArrow(_shared, "doc_id long, places binary").groupBy("doc_id").agg(F.collect_list("places").alias("places"))
    regions = src.join(shared.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "places")
    windows = regions.mapInArrow(_windows(n, min_words), "part int, n long, blob binary").repartitionById(n, F.col("part"))
    found = windows.mapInArrow(_shared, "doc_id long, places binary").groupBy("doc_id").agg(F.collect_list("places").alias("places"))
    return found.mapInArrow(_spans, "doc_id long, span_start long, span_end long")


_W = "[0-9a-zA-Z\\x{C0}-\\x{1FFF}\\x{2040}-\\x{2FFF}\\x{3040}-\\x{10FFFF}]"
SQL = f"""
WITH t AS (SELECT doc_id, unnest(x) AS tok, unnest(range(len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_W}+|[^{_W[1:]}+') AS x FROM documents)),
o AS (SELECT *, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM t),
w AS (SELECT doc_id, e - length(tok) AS s, e, lower(tok) AS word, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o WHERE regexp_matches(tok, '^{_W}')),
x AS (SELECT doc_id, list(word ORDER BY k) AS x FROM w GROUP BY doc_id),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(x) - {MIN_WORDS} + 2), lambda i: md5(array_to_string(x[i:i + {MIN_WORDS - 1}], ' ')))) AS gram,
        unnest(range(1, len(x) - {MIN_WORDS} + 2)) AS k FROM x),
h AS (SELECT gram FROM g GROUP BY gram HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT g.doc_id, k FROM g SEMI JOIN h USING (gram)),
p AS (SELECT r.doc_id, a.s, b.e FROM r JOIN w a ON a.doc_id = r.doc_id AND a.k = r.k JOIN w b ON b.doc_id = r.doc_id AND b.k = r.k + {MIN_WORDS - 1}),
m AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM p),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM m)
SELECT doc_id, CAST(min(s) AS BIGINT) AS span_start, CAST(max(e) AS BIGINT) AS span_end FROM i GROUP BY doc_id, run
"""
