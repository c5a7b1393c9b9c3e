"""Sharding along a Hilbert curve: documents alike in several metadata columns lie in the same files.

Each column is quantised to a few bits, the cell's index along the curve comes from a state table (one step a bit,
inside generated code), and the curve is cut to runs of a target size.  The cut needs only the sizes of the cells;
texts move once, to the partition that is their shard.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, fresh, written

#: Bits a dimension, and characters that a shard should hold.
BITS, SHARD_CHARS = 5, 64 << 20
DIMENSIONS = ("lang", "source", "n_chars", "doc_id")


def hilbert_index(coords: list[int], bits: int) -> int:
    """Index of a cell of the n-dimensional Hilbert curve (transpose form, after Skilling 2004)."""
    x, n = list(coords), len(coords)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> b) & 1
    return out


@lru_cache
def state_table(n: int) -> tuple[list[int], list[int]]:
    """(digit, next state) of each state and corner of the ``n``-dimensional curve, read from the curve itself.

    A state is how the sub-curve of a corner runs, told by the order in which it visits its own corners.
    State 0 is the start."""
    corners = [[(c >> (n - 1 - i)) & 1 for i in range(n)] for c in range(1 << n)]

    def order(path: tuple[int, ...], depth: int) -> tuple[int, ...]:
        """Digits of the corners below the cell that ``path`` (corners from the top) names."""
        bits = len(path) + depth
        base = [sum(corners[c][i] << (bits - 1 - k) for k, c in enumerate(path)) for i in range(n)]
        low = [hilbert_index([b + sum(corners[e][i] << (depth - 1 - k) for k, e in enumerate(rest)) for i, b in enumerate(base)], bits) for rest in _tuples(1 << n, depth)]
        return tuple(v & ((1 << n * depth) - 1) for v in low)

    # two levels tell orientations apart, for the digits of one level may agree in two of them
    seen, todo = {order((), 2): 0}, [()]
    digit, step = [], []
    for path in todo:
        own = order(path, 1)
        for c in range(1 << n):
            key = order((*path, c), 2)
            if key not in seen:
                seen[key] = len(seen)
                todo.append((*path, c))
            digit.append(own[c])
            step.append(seen[key])
    return digit, step


def _tuples(k: int, depth: int) -> list[tuple[int, ...]]:
    out: list[tuple[int, ...]] = [()]
    for _ in range(depth):
        out = [(*t, c) for t in out for c in range(k)]
    return out


def hilbert(coords: list[Column], bits: int = BITS) -> Column:
    """Hilbert index of quantised columns, as one built-in expression."""
    n = len(coords)
    digit, step = state_table(n)
    digits = F.array(*[F.lit(v) for v in digit])
    states = F.array(*[F.lit(v << n) for v in step])
    at, out = F.lit(0), F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        corner = F.lit(0)
        for c in coords:
            corner = corner * 2 + F.shiftright(c.cast("int"), b).bitwiseAND(1)
        place = at + corner
        out = F.shiftleft(out, n) + F.get(digits, place)
        at = F.get(states, place)
    return out


#: Cells that a range of ids is counted by: of all ids, and of each range that a cut falls into.
_CELLS, _FINER = 1 << 16, 1 << 12


def cuts(ids: DataFrame, parts: int, cells: int = _CELLS, finer: int = _FINER) -> list[int]:
    """The least id of each of the parts 1, 2, .. that the ids (one column of longs without nulls) fall into: an id's part is parts * rows of lesser ids
    // rows.  Where parts are empty their cuts are equal.

    Exact, by counts in ever narrower ranges around the cuts, so what comes to the driver is bounded by the cells."""
    c = ids.columns[0]
    n, lo, hi = ids.agg(F.count(c), F.min(c), F.max(c)).first()
    if not n:
        return []
    out: dict[int, int] = {}
    # (first id, last id, rows of lesser ids, parts begun before) of the ranges looked at, as Python integers: spans may exceed a long
    ranges = [(lo, hi, 0, 0)]
    level = cells
    while ranges:
        widths = [max(1, -(-(b - a + 1) // level)) for a, b, *_ in ranges]
        at = F.lit(None).cast("struct<r:int,c:int>")
        for r, ((a, b, *_), w) in enumerate(zip(ranges, widths)):
            # differences as decimals, for those of longs needn't be longs
            cell = F.expr(f"cast((cast(`{c}` as decimal(20, 0)) - {a}BD) div {w}BD as int)") if abs(a) >= 1 << 62 or abs(b) >= 1 << 62 else F.expr(f"cast((`{c}` - {a}L) div {w}L as int)")
            at = F.when(F.col(c).between(a, b), F.struct(F.lit(r).alias("r"), cell.alias("c"))).otherwise(at)
        counts: list[list[tuple[int, int]]] = [[] for _ in ranges]
        for row in ids.select(at.alias("at")).where("at is not null").groupBy("at").count().collect():
            counts[row[0][0]].append((row[0][1], row[1]))
        narrower = []
        for (a, b, before, told), w, found in zip(ranges, widths, counts):
            for cell, rows in sorted(found):
                first, last = a + cell * w, min(b, a + cell * w + w - 1)
                low, high = parts * before // n, parts * (before + rows - 1) // n
                if first == last:
                    high = low
                if high > low:
                    narrower.append((first, last, before, told))
                else:
                    for p in range(told, low + 1):
                        out[p] = min(out.get(p, first), first)
                told = max(told, low)
                before += rows
        ranges, level = narrower, finer
    return [out.get(p, hi + 1) for p in range(1, parts)]


def _at_least(c: Column, starts: list[int]) -> Column:
    """How many of the (rising) starts an id has reached."""
    out = F.lit(0)
    for v in starts:
        if v < 1 << 63:
            out = out + (c >= F.lit(v).cast("long")).cast("int")
    return out


def _quantised(docs: DataFrame, bits: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with a column of ``bits`` bits for each dimension."""
    top = 1 << bits
    names = [fresh(f"qw_{c}", docs.columns) for c in DIMENSIONS]
    meta = columns(docs, lang="string", source="string", n_chars="long", doc_id="long", text="string")
    starts = cuts(meta.where("doc_id is not null").select("doc_id"), top)

    def coded(c: str) -> DataFrame:
        # values in order of name, spread over the range by rank
        seen = meta.select(F.coalesce(c, F.lit("")).alias("v")).distinct()
        rank = F.row_number().over(Window.orderBy("v")) - 1
        return seen.select("v", rank.alias("r"), F.count("*").over(Window.partitionBy()).alias("k")).select("v", F.expr(f"cast(r * {top} div greatest(k, {top}) as int)").alias("q"))

    have = {c.lower(): c for c in docs.columns}
    col = lambda c: F.col(f"`{have[c]}`") if c in have else F.lit(None)
    # length of the binary form of the size: a quantised logarithm without floating point
    length = F.least(F.length(F.bin(_chars(docs))), F.lit(top - 1))
    doc = F.coalesce(_at_least(col("doc_id").cast("long"), starts), F.lit(0))
    out = docs.withColumn(names[2], length.cast("int")).withColumn(names[3], doc.cast("int"))
    for c, q in ((DIMENSIONS[0], names[0]), (DIMENSIONS[1], names[1])):
        v = fresh("qw_v", out.columns)
        # written, so that its size is known: Spark broadcasts it if it is small, and else joins by shuffle
        codes = written(coded(c).select(F.col("v").alias(v), F.col("q").alias(q)), "codes")
        out = out.join(codes, F.coalesce(col(c).cast("string"), F.lit("")) == F.col(v), "left").drop(v)
    return out, names


def _chars(docs: DataFrame) -> Column:
    """Characters of a row as told by n_chars, else by its text; below 0 counts as 0."""
    have = {c.lower(): c for c in docs.columns}
    col = lambda c: F.col(f"`{have[c]}`") if c in have else F.lit(None)
    return F.greatest(F.coalesce(col("n_chars").cast("long"), F.length(col("text")), F.lit(0)), F.lit(0)).cast("long")


def assign(docs: DataFrame, bits: int = BITS, shard_chars: int = SHARD_CHARS) -> tuple[DataFrame, int]:
    """``docs`` with ``hilbert`` and ``shard`` (names that are taken get underscores before them), not moved yet, and the number of shards."""
    taken = docs.columns
    q, dims = _quantised(docs, bits)
    h, shard, size = fresh("hilbert", taken), fresh("shard", taken), fresh("qw_size", taken)
    have = {c.lower(): c for c in taken}
    col = lambda c: F.col(f"`{have[c]}`") if c in have else F.lit(None)
    keyed = q.withColumn(h, hilbert([F.col(d) for d in dims], bits)).drop(*dims)
    cells = keyed.select(F.col(h).alias("h"), _chars(docs).alias(size)).groupBy("h").agg(F.sum(F.col(size).cast("decimal(38,0)")).alias("c"))
    # at most 2 ** (bits * dimensions) cells, whatever the size of the input.  A run is the cells that begin within one stretch of
    # shard_chars; a cell of two shards or more is a run of its own, dealt to as many shards as it fills
    before = F.sum("c").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    large = F.col("c") >= 2 * shard_chars
    runs = cells.select("h", "c", large.alias("large"), F.floor(before / shard_chars).alias("run")).groupBy("run", "large").agg(F.min("h").alias("start"), F.sum("c").alias("c"))
    runs = [(r["start"], int(r["c"] // shard_chars) if r["large"] else 1) for r in runs.orderBy("start").collect()]
    starts = np.array([r[0] for r in runs], np.int64)
    parts = np.array([r[1] for r in runs], np.int64)
    base = np.concatenate([[0], np.cumsum(parts)])[:-1] if len(parts) else np.zeros(0, np.int64)

    @F.pandas_udf("long")
    def place(cell: pd.Series, doc: pd.Series) -> pd.Series:
        at = np.maximum(np.searchsorted(starts, cell.to_numpy(), side="right") - 1, 0)
        if not len(starts):
            return pd.Series(np.zeros(len(cell), np.int64))
        return pd.Series(base[at] + np.mod(doc.to_numpy(), parts[at]))

    # rows without doc_id are dealt by their text
    deal = F.coalesce(col("doc_id").cast("long"), F.xxhash64(col("text")))
    return keyed.withColumn(shard, place(F.col(h), deal)), int(parts.sum())


def shards(docs: DataFrame, bits: int = BITS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``docs`` in shards: all columns, and ``hilbert`` and ``shard``; each shard is one partition (one file when
    written), sorted by (hilbert, doc_id).

    Dimensions are lang and source (by rank of their names), n_chars (bits of its binary form; the
    length of the text where null) and doc_id (2 ** bits parts of equally many rows, whatever ids there are).  A null lang or source counts as empty,
    a null doc_id as the least, a missing column as null.  The curve is cut to runs of about ``shard_chars``; a cell of two shards or
    more is dealt by doc_id to as many shards as it fills, rows without doc_id by their text, so shards still are stretches of the curve.  A text longer than a shard
    is a row like others and is never cut.  Rows alike in all of these, repeated rows too, share a shard; their order in it is not defined.  An empty table gives an
    empty result.
    """
    out, n = assign(docs, bits, shard_chars)
    h, shard = out.columns[-2:]
    order = [h] + [f"`{c}`" for c in out.columns if c.lower() == "doc_id"]
    return out.repartitionById(max(1, n), F.col(shard).cast("int")).sortWithinPartitions(*order)


def _sql() -> str:
    top, n = 1 << BITS, len(DIMENSIONS)
    digit, step = state_table(n)
    place = "state + " + " + ".join(f"((({c} >> {{b}}) & 1) << {n - 1 - i})" for i, c in enumerate("abcd"))
    ctes, last = [], "q"
    for b in range(BITS - 1, -1, -1):
        p = place.format(b=b)
        ctes.append(f"s{b} AS (SELECT doc_id, lang, source, n_chars, text, a, b, c, d, (h << {n}) + ds[{p} + 1] AS h, ss[{p} + 1] AS state, ds, ss FROM {last})")
        last = f"s{b}"
    return f"""
WITH l AS (SELECT v, (row_number() OVER (ORDER BY v) - 1) * {top} // greatest(count(*) OVER (), {top}) AS q FROM (SELECT DISTINCT lang AS v FROM documents)),
s AS (SELECT v, (row_number() OVER (ORDER BY v) - 1) * {top} // greatest(count(*) OVER (), {top}) AS q FROM (SELECT DISTINCT source AS v FROM documents)),
m AS (SELECT doc_id, (rank() OVER (ORDER BY doc_id) - 1) * {top} // count(*) OVER () AS d FROM documents),
q AS (SELECT x.*, l.q::INT AS a, s.q::INT AS b, least(length(bin(n_chars)), {top - 1})::INT AS c, m.d::INT AS d,
  0::BIGINT AS h, 0 AS state, {digit} AS ds, {[v << n for v in step]} AS ss
  FROM documents x JOIN l ON l.v = lang JOIN s ON s.v = source JOIN (SELECT DISTINCT * FROM m) m ON m.doc_id = x.doc_id),
{", ".join(ctes)},
cell AS (SELECT h, sum(n_chars)::BIGINT AS c FROM {last} GROUP BY h),
r AS (SELECT h, c, (sum(c) OVER (ORDER BY h) - c)::BIGINT // {SHARD_CHARS} AS run, c >= {2 * SHARD_CHARS} AS large FROM cell),
g AS (SELECT run, large, min(h) AS start, CASE WHEN large THEN sum(c)::BIGINT // {SHARD_CHARS} ELSE 1 END AS parts FROM r GROUP BY run, large),
b AS (SELECT *, sum(parts) OVER (ORDER BY start) - parts AS base FROM g)
SELECT doc_id, text, lang, source, n_chars, x.h AS hilbert, CAST(base + doc_id % parts AS BIGINT) AS shard
FROM {last} x JOIN r ON r.h = x.h JOIN b ON b.run = r.run AND b.large = r.large
"""


SQL = _sql()
