"""Line dedup: the first occurrence of every line stays, told by one compressed bitmap per document.

Lines are hashed next to the text; the 96-bit hashes are range-partitioned and sorted by (hash, document,
position), so that one streaming pass sees every line's first occurrence first.  What comes back is a run
length encoded bitmap of each document's lines, never text.

Two occurrences in the same input batch are settled there, so a line that occurs a billion times sends one
row a batch to its range, not a billion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bin_of, columns, n_partitions

_SCHEMA = "part int, h1 long, h2 int, doc_id long, th long, pos int, gone boolean"
_FIELDS = pa.schema([("part", pa.int32()), ("h1", pa.int64()), ("h2", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("gone", pa.bool_())])
_BLANK = " \t\r"
_NULL = np.iinfo(np.int64).min


def _repeats(h1, h2, doc, null, th, pos, carry=None):
    """Which rows, sorted by all of these, are not the first occurrence of their hash.

    A row that is the same in everything as the first (a repeated row of the table) is no repeat.
    ``carry``: the first occurrence of the hash that ended the rows before these."""
    n = len(h1)
    new = np.ones(n, bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    if carry is not None and n and (h1[0], h2[0]) == carry[:2]:
        new[0] = False
    group = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    own = [np.where(group >= 0, x[at[np.maximum(group, 0)]] if len(at) else 0, c) for x, c in zip((doc, null, th, pos), carry[2:] if carry else (0, 0, 0, 0))]
    same = np.logical_and.reduce([x == o for x, o in zip((doc, null, th, pos), own)])
    last = (h1[-1], h2[-1], *(o[-1] for o in own)) if n else carry
    return ~same, last


def _hash_lines(n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, strip = xxhash.xxh3_128_digest, str.strip
        for batch in batches:
            raw, doc_of, pos, n_lines, ths = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    n_lines.append(0)
                    ths.append(0)
                    continue
                lines = text.split("\n")
                n_lines.append(len(lines))
                ths.append(xxhash.xxh3_64_intdigest(text))
                for j, line in enumerate(lines):
                    if line := strip(line, _BLANK):
                        raw.append(digest(line))
                        doc_of.append(i)
                        pos.append(j)
            ids = batch.column(0)
            null = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(_NULL))
            ths = np.array(ths, np.uint64).view(np.int64)
            # one row per document tells how many lines it has: pos = -1 - lines
            heads = (bin_of(ths.view(np.uint64), n_parts), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int32), ids, null, ths, -1 - np.array(n_lines, np.int32), np.ones(len(ids), bool))
            h = np.frombuffer(b"".join(raw), dtype=[("a", "<i8"), ("b", "<i4"), ("c", "<i4")])
            i, pos = np.array(doc_of, np.int64), np.array(pos, np.int32)
            order = np.lexsort((pos, ths[i], ids[i], ~null[i], h["b"], h["a"]))
            h1, h2, i, pos = h["a"][order], h["b"][order], i[order], pos[order]
            gone, _ = _repeats(h1, h2, ids[i], null[i], ths[i], pos)
            part = bin_of(np.where(gone, ths[i], h1).view(np.uint64), n_parts)
            part, h1, h2, doc, no_id, th, pos, gone = (np.concatenate(x) for x in zip(heads, (part, h1, h2, ids[i], null[i], ths[i], pos, gone)))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(h1), pa.array(h2), pa.array(doc, mask=no_id), pa.array(th), pa.array(pos.astype(np.int32)), pa.array(gone)], schema=_FIELDS)

    return run


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    carry = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        null = np.asarray(batch.column(3).is_null())
        doc = np.asarray(batch.column(3).fill_null(_NULL))
        h1, h2, th, pos, gone = (np.asarray(batch.column(k)) for k in (1, 2, 4, 5, 6))
        live = ~gone
        again = gone.copy()
        again[live], carry = _repeats(h1[live], h2[live], doc[live], null[live], th[live], pos[live], carry)
        yield pa.RecordBatch.from_arrays([pa.array(doc[again], mask=null[again]), pa.array(th[again]), pa.array(pos[again])], names=["doc_id", "th", "pos"])


def encode(keep: np.ndarray) -> str:
    """Run lengths of a bitmap, the first of kept lines (``0`` if the first line is dropped): ``12,1,4``."""
    if len(keep) == 0:
        return ""
    cuts = np.flatnonzero(np.diff(keep)) + 1
    runs = np.diff(np.concatenate([[0], cuts, [len(keep)]])).tolist()
    return ",".join(map(str, runs if keep[0] else [0, *runs]))


def decode(runs: str) -> np.ndarray:
    """The bitmap of :func:`encode`."""
    if not runs:
        return np.zeros(0, bool)
    n = np.array(runs.split(","), np.int64)
    return np.repeat(np.arange(len(n)) % 2 == 0, n)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, total, out = [], [], []
        for pos in batch.column(1):
            pos = np.unique(np.asarray(pos.values))
            n = -1 - int(pos[0])
            keep = np.ones(n, bool)
            keep[pos[1:]] = False
            total.append(n)
            kept.append(int(keep.sum()))
            out.append(encode(keep))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(kept, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_lines", "n_kept", "keep_runs"])


def line_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_kept, keep_runs): which lines of each document stay.

    A line is what newlines separate; spaces, tabs and carriage returns around it don't count.  Of equal lines
    the one of the smallest doc_id stays (null first), then of the first position.  Blank lines always stay.
    A null text has no lines, an empty one a single blank line.  Rows alike in doc_id and text count
    as one document with one row in the result; rows of one doc_id with different texts have a row each.
    Other columns are not looked at.  An empty table gives an empty result.
    """
    n = n_partitions(docs.sparkSession)
    rows = columns(docs, doc_id="long", text="string").mapInArrow(_hash_lines(n), _SCHEMA)
    ordered = rows.repartitionById(n, F.col("part")).sortWithinPartitions("h1", "h2", F.asc_nulls_first("doc_id"), "th", "pos")
    gone = ordered.mapInArrow(_stream, "doc_id long, th long, pos int")
    lists = gone.groupBy("doc_id", "th").agg(F.collect_list("pos").alias("pos")).select("doc_id", "pos")
    return lists.mapInArrow(_bitmaps, "doc_id long, n_lines long, n_kept long, keep_runs string")


def apply_bitmap(text: str | None, runs: str) -> str | None:
    """The text without the lines that its bitmap drops."""
    if text is None:
        return None
    return "\n".join(x for x, k in zip(text.split("\n"), decode(runs)) if k)


SQL = """
WITH l AS (
  SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
t AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS line FROM l),
k AS (SELECT doc_id, pos, line = '' OR row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) = 1 AS keep FROM t),
c AS (SELECT *, CASE WHEN keep = lag(keep, 1, true) OVER w THEN 0 ELSE 1 END AS turn FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c),
g AS (SELECT doc_id, run, count(*) AS n, min(pos) AS pos FROM r GROUP BY doc_id, run),
s AS (SELECT doc_id, CASE WHEN min(run) = 1 THEN '0,' ELSE '' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY pos) AS keep_runs FROM g GROUP BY doc_id)
SELECT s.doc_id, a.n_lines, a.n_kept, s.keep_runs
FROM s JOIN (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (keep) AS BIGINT) AS n_kept FROM k GROUP BY doc_id) a USING (doc_id)
"""
