"""N-gram Jaccard join by MinHash banding, every candidate verified on its full n-gram sets.

1. One pass hashes the word n-grams of each text and keeps minima; texts of the same word sequence share a
   64-bit fingerprint and go on as one node.
2. Rows (band hash, node) are shuffled on the band hash.  Within a bucket nodes whose sketches (a byte of each of 64 minima) agree as
   texts at the threshold would are tied together; a bucket of more than BUCKET rows ties all its nodes to its least one.  So
   nodes that share a band by chance part again, and components are groups of texts that look alike.
3. Each node's full set is sent once to its component, where all pairs are intersected exactly.  A component
   too large for one task is cut into blocks and every pair of blocks is a task, so no pair is left out
   however many copies there are.  A task returns a row per node, how many documents it is linked to and the least node it
   reaches, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T
from .common import columns, drop_written, fresh, hash_side, text_hash, written
from .graph import components

#: Words of a gram, Jaccard similarity from which two texts are linked (that of a text and its copy with a tenth of the words
#: changed is 0.57 in the mean, 0.53 if the changes are spread evenly), recall that banding aims at there, and how many hashes
#: it may take to have more than one row a band.
N, THRESHOLD, RECALL, MOST_HASHES = 3, 0.5, 0.98, 256
#: Grams and texts of one block of a component; rows of a bucket whose sketches are compared with each other.
BLOCK_GRAMS, BLOCK_NODES, BUCKET = 2_000_000, 2_000, 512
#: Pairs of texts that are counted at a time; pairs in a matrix product that cost as much as one by itself.
CELLS, DENSE = 1 << 21, 200
#: Bytes of a sketch, and deviations that its agreement may fall short of the threshold.
SKETCH, SIGMAS = 64, 4.0
_U = np.uint64


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and summands of ``n`` hash functions."""
    rng = np.random.default_rng(7)
    both = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
    return both[:, 0] | _U(1), both[:, 1]


def choose_bands(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands find a pair at ``threshold`` with ``recall``, within ``most``
    hashes; one row a band if even that takes more.  Values outside (0, 1) are ValueErrors (a threshold may be 1)."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold and recall must lie between 0 and 1")
    best = None
    for rows in range(1, max(1, most) + 1):
        p = threshold**rows
        if best and p < 1e-9:
            break
        bands = 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-p)))
        if best is None or bands * rows <= most:
            best = (bands, rows)
    return best


def least_agreement(threshold: float) -> int:
    """Of SKETCH bytes, how many agree in all but a few in 100 000 pairs of texts at the threshold."""
    return math.ceil(SKETCH * threshold - SIGMAS * math.sqrt(SKETCH * threshold * (1 - threshold)))


def sequence_hash(w: T.Words) -> np.ndarray:
    """One hash per text of its words in order."""
    return T.window_hash(w.hash, w.ptr[:-1], w.ptr[1:]) if len(w.hash) else np.zeros(w.n_docs, np.uint64)


def _signatures(n: int, bands: int, rows: int):
    mul, add = _constants(max(bands * rows, SKETCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, th, texts = (batch.column(k) for k in range(3))
            for w in T.words(texts):
                g, ptr = T.grams(w, n)
                some = np.flatnonzero(np.diff(ptr) > 0)
                sig, sketch = np.empty((len(some), bands), np.int64), np.empty((len(some), SKETCH), np.uint8)
                if len(some):
                    at = ptr[:-1][some]
                    for k in range(len(mul)):
                        least = np.minimum.reduceat((g * mul[k] + add[k]) >> _U(16), at)
                        if k < SKETCH:
                            sketch[:, k] = T.mix(least).astype(np.uint8)
                        b, row = divmod(k, rows)
                        if b < bands:
                            h = T.mix((h if row else np.full(len(some), b, np.uint64)) ^ least)
                            sig[:, b] = h.view(np.int64)
                take = pa.array(w.first + some)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [doc_id.take(take), th.take(take), pa.array(sequence_hash(w)[some].view(np.int64)), pa.array([x.tobytes() for x in sketch], pa.binary()), flat],
                    names=["doc_id", "th", "node", "sketch", "sig"],
                )

    return run


def tied(sketches: np.ndarray, least: int) -> np.ndarray:
    """For buckets (bucket, node, byte): the first node of its bucket that each reaches by agreeing sketches."""
    m = sketches.shape[1]
    alike = (sketches[:, :, None, :] == sketches[:, None, :, :]).sum(axis=3, dtype=np.int32) >= least
    label = np.tile(np.arange(m), (len(sketches), 1))
    while True:
        now = np.minimum(label, np.where(alike, label[:, None, :], m).min(axis=2))
        if (now == label).all():
            return label
        label = now


def _plausible(least: int):
    """Edges (a, b) within buckets: rows (h, node, sketch) come sorted by h."""

    def edges(h: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.concatenate([begin, [len(h)]]))
        for m in np.unique(size[size > 1]).tolist():
            of = begin[size == m]
            step = max(1, (1 << 24) // (m * m * SKETCH))
            for k in range(0, len(of), step):
                at = of[k : k + step, None] + np.arange(m)
                label = tied(sketch[at], least)
                to = np.take_along_axis(at, label, 1)
                moved = at != to
                if moved.any():
                    yield pa.RecordBatch.from_arrays([pa.array(node[at[moved]]), pa.array(node[to[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, SKETCH), np.uint8))
        for batch in batches:
            if not batch.num_rows:
                continue
            new = (np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, SKETCH))
            h, node, sketch = (np.concatenate(x) for x in zip(held, new))
            cut = int(np.searchsorted(h, h[-1]))  # the last bucket may go on
            if cut:
                yield from edges(h[:cut], node[:cut], sketch[:cut])
            held = (h[cut:], node[cut:], sketch[cut:])
        if len(held[0]):
            yield from edges(*held)

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, comp, docs, texts = (batch.column(k) for k in range(4))
            for w in T.words(texts):
                g, ptr = T.grams(w, n)
                sets = [np.unique(g[a:b]) for a, b in zip(ptr[:-1], ptr[1:])]
                own = [c.slice(w.first, w.n_docs) for c in (node, comp, docs)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "comp", "docs", "size", "grams"])

    return run


def _numbered(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the gram, set) of the grams that several sets have, in the order of the sets, and how many such grams there are."""
    gram = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(gram):
        return np.zeros(0, np.int64), owner, 0
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    run = np.cumsum(np.concatenate([[True], gram[1:] != gram[:-1]])) - 1
    shared = np.bincount(run) > 1
    number = np.empty(len(gram), np.int64)
    number[order] = np.where(shared, np.cumsum(shared) - 1, -1)[run]
    keep = number >= 0
    return number[keep], owner[keep], int(shared.sum())


def _in_common(gl: np.ndarray, x: np.ndarray, gr: np.ndarray, y: np.ndarray, rows: int, cols: int, total: int, kind: type = np.float32) -> np.ndarray:
    """How many of ``total`` grams each row has in common with each column, from (gl, x) of the rows and (gr, y) of the columns."""
    out = np.zeros((rows, cols), kind)
    nl, nr = np.bincount(gl, minlength=total), np.bincount(gr, minlength=total)
    pairs = nl * nr
    hot = pairs * DENSE > rows * cols
    # grams of many pairs: products of 0/1 matrices, some grams at a time
    place = np.where(hot, np.cumsum(hot) - 1, -1)
    sides = []
    for g, at in ((gl, x), (gr, y)):
        k = place[g]
        at, k = at[k >= 0], k[k >= 0]
        order = np.argsort(k, kind="stable")
        sides.append((k[order], at[order]))
    n, step = int(hot.sum()), max(64, min(4096, 2 * CELLS // (rows + cols)))
    for first in range(0, n, step):
        wide, m = min(step, n - first), []
        for (k, at), size in zip(sides, (rows, cols)):
            lo, hi = np.searchsorted(k, (first, first + wide))
            m.append(np.zeros((size, wide), kind))
            m[-1][at[lo:hi], k[lo:hi] - first] = 1
        out += m[0] @ m[1].T
    # grams of few pairs: the pairs themselves
    cold = (pairs > 0) & ~hot
    if cold.any():
        begin = np.cumsum(np.where(cold, nr, 0)) - nr
        gl, x, gr, y = gl[cold[gl]], x[cold[gl]], gr[cold[gr]], y[cold[gr]]
        y, each = y[np.argsort(gr, kind="stable")], nr[gl]
        upto = np.cumsum(each)
        a = 0
        while a < len(gl):
            done = upto[a] - each[a]
            b = max(a + 1, int(np.searchsorted(upto, done + CELLS, side="right")))
            at = np.repeat(begin[gl[a:b]] - (upto[a:b] - each[a:b] - done), each[a:b]) + np.arange(upto[b - 1] - done)
            out += np.bincount(np.repeat(x[a:b] * cols, each[a:b]) + y[at], minlength=rows * cols).reshape(rows, cols).astype(kind)
            a = b
    return out


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every set of ``left`` with every one of ``right`` (indices)."""
    gram, owner, total = _numbered(sets)
    parts = []
    for of in (left, right):
        at = np.full(len(sets), -1)
        at[of] = np.arange(len(of))
        k = at[owner]
        parts += [gram[k >= 0], k[k >= 0]]
    return _in_common(*parts, len(left), len(right), total)


def merged(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``label``, a number below its length for each node, with the groups joined that links (x, y) between nodes connect."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return label
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def linked_pairs(sets: list[np.ndarray], n_left: int | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (x, y) of the sets whose Jaccard similarity is at least ``threshold``, some at a time, each pair once: of the first ``n_left``
    sets with the others, or if it is None, of all with each other.  Either part comes sorted by size."""
    size = np.array([len(s) for s in sets], np.int64)
    same = n_left is None
    n_left, start = (len(sets), 0) if same else (n_left, n_left)
    gram, owner, total = _numbered(sets)
    ptr = np.searchsorted(owner, np.arange(len(sets) + 1))
    kind = np.float32 if size.max(initial=0) < 1 << 24 else np.float64
    step = max(1, CELLS // max(1, len(sets) - start))
    for a in range(0, n_left, step):
        b = min(n_left, a + step)
        # sets of other sizes can't be as similar
        c = start + int(np.searchsorted(size[start:], size[a] * threshold * (1 - 1e-9)))
        d = start + int(np.searchsorted(size[start:], size[b - 1] / threshold * (1 + 1e-9), side="right"))
        c = max(c, a) if same else c
        if c >= d:
            continue
        rows, cols = slice(ptr[a], ptr[b]), slice(ptr[c], ptr[d])
        both = _in_common(gram[rows], owner[rows] - a, gram[cols], owner[cols] - c, b - a, d - c, total, kind)
        least = threshold / (1 + threshold) * (1 - 1e-5)
        x, y = np.nonzero(both >= (size[a:b] * least).astype(kind)[:, None] + (size[c:d] * least).astype(kind)[None, :])
        n = both[x, y].astype(np.float64)
        x, y = x + a, y + c
        ok = n / (size[x] + size[y] - n) >= threshold - 1e-12
        if same:
            ok &= x < y
        yield x[ok], y[ok]


def _verify(threshold: float):
    """Rows (node, links, label) of the nodes of one or two blocks: linked documents, and the least node reached by links."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        right, size = np.asarray(t["block"]) != key[1].as_py(), np.asarray(t["size"])
        order = np.lexsort((size, right))
        node, docs = np.asarray(t["node"])[order], np.asarray(t["docs"])[order]
        grams = t["grams"].to_pylist()
        sets = [np.frombuffer(grams[k], np.uint64) for k in order.tolist()]
        links, label = np.zeros(len(node)), np.arange(len(node))
        # of two blocks one may be empty
        for x, y in linked_pairs(sets, None if key[1] == key[2] else int((~right).sum()), threshold):
            links += np.bincount(x, weights=docs[y], minlength=len(node)) + np.bincount(y, weights=docs[x], minlength=len(node))
            label = merged(label, x, y)
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, label, node)
        return pa.table({"node": pa.array(node), "links": pa.array(links.astype(np.int64)), "label": pa.array(least[label])})

    return run


def _linked(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, node) of every row that has words, and (node, links, label) of the nodes that have links to others: links counts
    documents, one label stands for all nodes linked directly or through others."""
    bands, rows = choose_bands(threshold, recall)
    src = columns(docs, doc_id="long", text="string").withColumn("th", text_hash()).select("doc_id", "th", "text")
    sig = written(src.mapInArrow(_signatures(n, bands, rows), "doc_id long, th long, node long, sketch binary, sig array<long>"), "signatures")
    members = written(sig.select("doc_id", "th", "node"), "members")
    hit = sig.select(F.explode("sig").alias("h"), "node")
    # least and greatest node of a bucket combine on the map side, however hot it is
    buckets = written(hit.groupBy("h").agg(F.min("node").alias("hub"), F.max("node").alias("other"), F.count("*").alias("rows")).where("hub <> other"), "buckets")
    # two rows are the two nodes; of more, all are fetched
    pairs = buckets.where("rows = 2").select(F.col("hub").alias("node"), "h").union(buckets.where("rows = 2").select("other", "h"))
    more = hit.join(buckets.where(f"rows > 2 and rows <= {BUCKET}").select("h"), "h", "left_semi").select("node", "h")
    sketches = sig.groupBy("node").agg(F.first("sketch").alias("sketch"))
    compared = pairs.union(more.distinct()).join(sketches, "node").select("h", "node", "sketch").repartition("h").sortWithinPartitions("h", "node")
    edges = compared.mapInArrow(_plausible(least_agreement(threshold)), "a long, b long")
    crowded = hit.join(buckets.where(f"rows > {BUCKET}").select("h", "hub"), "h").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    comp = written(components(edges.union(crowded)), "components")
    # of the texts that share a node one stands for all
    weight = members.select("doc_id", "node").distinct().groupBy("node").agg(F.count("*").alias("docs"))
    chosen = members.join(comp, "node", "left_semi").groupBy("node").agg(F.min(F.struct("th", "doc_id")).alias("k"))
    chosen = chosen.join(comp, "node").join(weight, "node").select("node", "comp", "docs", F.col("k.th").alias("th"), F.col("k.doc_id").alias("doc_id"))
    chosen = written(chosen, "chosen")
    texts = src.alias("s").join(hash_side(chosen, 80).alias("c"), F.expr("s.th = c.th and s.doc_id <=> c.doc_id")).select("c.node", "c.comp", "c.docs", "s.text")
    sets = written(texts.mapInArrow(_sets(n), "node long, comp long, docs long, size long, grams binary").dropDuplicates(["node"]), "sets")
    size = sets.groupBy("comp").agg(F.sum("size").alias("grams"), F.count("*").alias("nodes")).where("nodes > 1")
    blocks = size.select("comp", F.greatest(F.ceil(F.col("grams") / BLOCK_GRAMS), F.ceil(F.col("nodes") / BLOCK_NODES)).cast("int").alias("nb"))
    placed = sets.join(blocks, "comp").withColumn("block", F.expr("cast(pmod(xxhash64(node), nb) as int)"))
    sent = placed.select("comp", "node", "docs", "size", "block", "grams", F.explode(F.expr("sequence(0, nb - 1)")).alias("o"))
    sent = sent.select("comp", F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj"), "node", "docs", "size", "block", "grams")
    found = sent.groupBy("comp", "bi", "bj").applyInArrow(_verify(threshold), "node long, links long, label long").where("links > 0")
    found = written(found, "found")
    # labels of different tasks meet where a component has several blocks
    joined = components(found.select("node", "label"))
    total = found.groupBy("node").agg(F.sum("links").alias("links"), F.min("label").alias("label"))
    linked = written(total.join(joined, "node", "left").select("node", "links", F.coalesce("comp", "label").alias("label")), "linked")
    for done in (sig, buckets, comp, chosen, sets, found):
        drop_written(done)
    return members, linked


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, links): every document that is linked to another, a row each.

    A document is a doc_id with a text; rows that repeat both are one document, rows of one doc_id with different words are
    different ones.  Two documents are linked if their sets of word ``n``-grams have a Jaccard similarity of at least
    ``threshold``; links is to how many others.  class_id is the least doc_id of all documents linked directly or through
    others.  A text of fewer than ``n`` words has one gram, all its words; one without words (null and empty texts too) is
    linked to none.  A document without links has no row.  Rows without doc_id count like others and have a null doc_id (class_id is null only if all
    of a class are).  Texts of the same words in the same order (64-bit hashes of them) are equal; ties can't occur, as nothing is ranked.  Texts of any
    length are taken whole.  Other columns are not looked at; an empty table gives an empty result.  Banding finds a
    link at the threshold with a probability of ``recall``, a closer one with a higher; those found are verified exactly.
    """
    members, linked = _linked(docs, n, threshold, recall)
    named = members.select("doc_id", "node").distinct()
    own = named.groupBy("node").agg(F.count("*").alias("docs"), F.min("doc_id").alias("least"))
    known = own.join(linked, "node", "left").select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("links"), F.coalesce("label", "node").alias("label")).where("links > 0")
    known = written(known, "classes")
    least = known.groupBy("label").agg(F.min("least").alias("class_id"))
    return named.join(known.join(least, "label").select("node", "class_id", "links"), "node").select("doc_id", "class_id", "links")


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` without near copies: of each class of :func:`jaccard_join` the row of the smallest
    (doc_id, text hash) stays, null doc_id last; of rows equal in doc_id and text one stays.  Texts without words (null and empty ones too) all
    stay.  Texts of any length are taken whole.  All columns come back, whatever their names; an empty table gives an empty result.
    """
    members, linked = _linked(docs, n, threshold, recall)
    grouped = members.join(linked, "node", "left").select("doc_id", "th", F.coalesce("label", "node").alias("g"))
    first = grouped.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")).alias("k"), F.count("*").alias("n")).where("n > 1")
    judged = grouped.join(first, "g")
    lost = judged.where(~(F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("th") == F.col("k.th")))).select("doc_id", "th").distinct()
    again = judged.groupBy("doc_id", "th").count().where("count > 1").select("doc_id", "th")
    th, key, rn = (fresh(x, docs.columns) for x in ("qw_text", "qw_key", "qw_row"))
    x, y = fresh("qw_a", docs.columns), fresh("qw_b", docs.columns)
    drop = written(lost.select(F.col("doc_id").alias(x), F.col("th").alias(y)).distinct(), "lost")
    rows = docs.withColumn(th, text_hash())
    on = (F.col(th) == F.col(y)) & F.col("`doc_id`").eqNullSafe(F.col(x))
    rows = rows.join(hash_side(drop, 60), on, "left_anti")
    twice = written(again.join(lost, ["doc_id", "th"], "left_anti").select(F.col("doc_id").alias(x), F.col("th").alias(y)), "twice")
    if twice.isEmpty():
        return rows.drop(th)
    # rows repeated in doc_id and text, if any, are few: only they are ranked
    single = rows.join(twice, on, "left_anti")
    w = Window.partitionBy("`doc_id`", th).orderBy(F.hash(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    repeated = rows.join(twice, on, "left_semi").withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1).drop(rn)
    return single.union(repeated).drop(th)


_WORD = "[0-9a-zA-Z\\x{C0}-\\x{1FFF}\\x{2040}-\\x{2FFF}\\x{3040}-\\x{10FFFF}]+"
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS x FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(x) = 0 THEN [] WHEN len(x) < {N} THEN [array_to_string(x, ' ')]
        ELSE list_transform(range(1, len(x) - {N} + 2), lambda i: array_to_string(x[i:i + {N - 1}], ' ')) END) AS gram FROM w),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE p.n::DOUBLE / (x.n + y.n - p.n) >= {THRESHOLD}),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT r.a AS doc_id, min(r.b) AS class_id, any_value(links) AS links FROM r JOIN c ON c.a = r.a GROUP BY r.a
"""
