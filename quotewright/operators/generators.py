"""Candidate generators: DataFrames of query and source segments in, (query_id, source_id, rank, candidate_score) out.

All take keyword arguments that they don't know, as pipelines hand theirs to every part."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotewright.functions import text as tx
from quotewright.functions.stopwords import CONTEXTUAL

_ORDER = ("row_id", "pos")
#: Rows of a block of vectors that one task multiplies; queries whose exact neighbours set the bucket length of approximate search.
BLOCK, SAMPLED = 65_536, 64
#: Queries and sources of a block that are multiplied at a time; candidates of these queries beyond which they are cut exactly.
STEP, MOST_CANDIDATES = (512, 4096), 1_000_000
#: Segments of a block whose words are compared.
QUERY_TEXTS, SOURCE_TEXTS = 256, 512


def _side(segments: DataFrame, side: str, *more: str) -> DataFrame:
    place = F.struct(F.coalesce("row_id", F.lit(0)).alias("r"), F.col("pos").alias("p"))
    return segments.select(F.col("seg_id").alias(f"{side}_id"), place.alias(f"{side}_order"), *more)


def ranked_rows(scored: DataFrame, top_k: int | None) -> DataFrame:
    """Rows (query_id, source_id, source_order, candidate_score) by falling score, ties in source order, cut at ``top_k``; all columns."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("candidate_score"), "source_order", "source_id"))
    out = scored.withColumn("rank", rank)
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def ranked(scored: DataFrame, top_k: int | None) -> DataFrame:
    """:func:`ranked_rows` as candidates."""
    return ranked_rows(scored, top_k).select("query_id", "source_id", "rank", "candidate_score")


def exhaustive(query: DataFrame, source: DataFrame, **_: object) -> DataFrame:
    """All pairs with score 1, in source order.  The result has |query| x |source| rows by definition."""
    q, s = _side(query, "query").drop("query_order"), _side(source, "source")
    # the rank depends on the source alone
    s = s.withColumn("rank", F.row_number().over(Window.orderBy("source_order", "source_id"))).drop("source_order")
    return q.crossJoin(s).withColumn("candidate_score", F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """Vector of length 1; a zero vector stays."""
    v = F.transform(vector, lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def _vector_side(segments: DataFrame, side: str, vector: str, name: str) -> DataFrame:
    """Unit vectors of a side; rows without a vector are left out."""
    return _side(segments, side, unit(F.col(vector)).alias(name)).where(F.col(name).isNotNull())


def embedding(query: DataFrame, source: DataFrame, *, top_k: int | None = 100, vector: str = "embedding", digits: int | None = None, **_: object) -> DataFrame:
    """Cosine of the column ``vector`` of both sides, exact; the ``top_k`` nearest of each query.

    Both sides are dealt to blocks of BLOCK rows at most or so, and every pair of blocks is a task, which passes on each query's ``top_k``
    best.  Products in single precision tell which may be among these; only they are scored, in double precision.  With ``digits`` scores are rounded before they are ranked.  Rows without a vector are
    left out; a zero vector scores 0.  Without ``top_k`` the result has |query| x |source| rows by definition."""
    if top_k is None:
        q, s = _vector_side(query, "query", vector, "v").drop("query_order"), _vector_side(source, "source", vector, "u")
        scored = q.crossJoin(s).select("query_id", "source_id", "source_order", dot(F.col("v"), F.col("u")).alias("candidate_score"))
    else:
        side = lambda d, name, v: _side(d, name, F.col(vector).alias(v)).where(F.col(v).isNotNull())
        scored = exact_scores(side(query, "query", "v").drop("query_order"), side(source, "source", "u"), top_k, digits)
    if digits is not None:
        scored = scored.withColumn("candidate_score", F.round("candidate_score", digits))
    return ranked(scored, top_k)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return np.asarray(flat).reshape(len(column), -1)


_SCORED = pa.schema([("query_id", pa.string()), ("source_id", pa.string()), ("r", pa.int64()), ("p", pa.int64()), ("candidate_score", pa.float64())])


Scores = Callable[[pa.Table, pa.Table], Iterator[tuple[int, np.ndarray]]]
Rate = Callable[[np.ndarray], np.ndarray]


def _units(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    m = m.astype(np.float64)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=m, where=n > 0)


def _nearest_of_block(k: int, digits: int | None):
    """The ``k`` sources of each query with the greatest cosines, rounded if asked for, ties in source order."""

    def best(v: np.ndarray, u: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = np.concatenate([np.einsum("ij,ij->i", v[i[x : x + 65_536]], u[j[x : x + 65_536]]) for x in range(0, len(i), 65_536)])
        rated = score if digits is None else np.round(score, digits)
        order = np.lexsort((j, -rated, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i)
        kept = np.arange(len(i)) - first < k
        return i[kept], j[kept], score[kept]

    def run(q: pa.Table, s: pa.Table) -> pa.Table:
        if not q.num_rows or not s.num_rows:
            return _SCORED.empty_table()
        s = s.sort_by([("r", "ascending"), ("p", "ascending"), ("source_id", "ascending")])
        v, u = _units(_matrix(q["v"])), _units(_matrix(s["u"]))
        v4, u4 = v.astype(np.float32), u.astype(np.float32)
        # what single precision and rounding may change, of both values that are compared
        margin = np.float32(2 * (v.shape[1] + 4) * 1.2e-7 + (0 if digits is None else 10.0**-digits))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(v), STEP[0]):
            mine, few = v4[at : at + STEP[0]], v[at : at + STEP[0]]
            least = np.full(len(mine), -np.inf, np.float32)
            held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
            for x in range(0, len(u), STEP[1]):
                near = mine @ u4[x : x + STEP[1]].T
                n = near.shape[1]
                if not x and n > k:
                    least = np.partition(near, n - k, axis=1)[:, n - k] - margin
                hit = np.flatnonzero(near >= least[:, None])
                if not len(hit):
                    continue
                i, j, c = (np.concatenate(y) for y in zip(held, (hit // n, hit % n + x, near.ravel()[hit])))
                if len(i) > MOST_CANDIDATES:
                    i, j, c = best(few, u, i, j)
                    c = c.astype(np.float32)
                order = np.lexsort((-c, i))
                i, j, c = i[order], j[order], c[order]
                last = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) == k - 1)
                least[i[last]] = c[last] - margin
                kept = c >= least[i]
                held = i[kept], j[kept], c[kept]
            if len(held[0]):
                i, j, c = best(few, u, *held[:2])
                found.append((i + at, j, c))
        if not found:
            return _SCORED.empty_table()
        i, j, c = (np.concatenate(x) for x in zip(*found))
        i, j = pa.array(i), pa.array(j)
        return pa.table([q["query_id"].take(i), *[s[n].take(j) for n in ("source_id", "r", "p")], pa.array(c)], schema=_SCORED)

    return run


def _best_of_block(k: int, scores: Scores, rate: Rate):
    """The ``k`` best sources of each query by ``rate`` of its scores, ties in source order."""

    def run(q: pa.Table, s: pa.Table) -> pa.Table:
        if not q.num_rows or not s.num_rows:
            return _SCORED.empty_table()
        s = s.sort_by([("r", "ascending"), ("p", "ascending"), ("source_id", "ascending")])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at, score in scores(q, s):
            rated, n = rate(score), score.shape[1]
            if n > k:
                pick = np.argpartition(-rated, k - 1, axis=1)[:, :k]
                least = np.take_along_axis(rated, pick, 1).min(axis=1)
                for i in np.flatnonzero((rated >= least[:, None]).sum(axis=1) > k):
                    above, same = np.flatnonzero(rated[i] > least[i]), np.flatnonzero(rated[i] == least[i])
                    pick[i] = np.concatenate([above, same[: k - len(above)]])
            else:
                pick = np.tile(np.arange(n), (len(score), 1))
            found.append((np.repeat(np.arange(at, at + len(score)), pick.shape[1]), pick.ravel(), np.take_along_axis(score, pick, 1).ravel()))
        if not found:
            return _SCORED.empty_table()
        i, j, c = (np.concatenate(x) for x in zip(*found))
        i, j = pa.array(i), pa.array(j)
        return pa.table([q["query_id"].take(i), *[s[n].take(j) for n in ("source_id", "r", "p")], pa.array(c)], schema=_SCORED)

    return run


def _in_blocks(q: DataFrame, s: DataFrame, best: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """The best of each query in each block: sides (.., at) paired where ``at`` is equal."""
    s = s.select("source_id", F.col("source_order.r").cast("long").alias("r"), F.col("source_order.p").cast("long").alias("p"), *[c for c in s.columns if c not in ("source_id", "source_order")])
    rows = q.groupBy("at").cogroup(s.groupBy("at")).applyInArrow(best, "query_id string, source_id string, r long, p long, candidate_score double")
    return rows.select("query_id", "source_id", F.struct("r", "p").alias("source_order"), "candidate_score")


def _block_scores(q: DataFrame, s: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The same for vectors: sides (.., at, v) and (.., at, u)."""
    return _in_blocks(q.select("query_id", "at", "v"), s.select("source_id", "source_order", "at", "u"), _nearest_of_block(k, digits))


def blocked(q: DataFrame, s: DataFrame, q_rows: int = BLOCK, s_rows: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``at``: each query block meets each source block in one group.  Smaller sides have smaller blocks, for more tasks."""
    parts = lambda n, most: max(1, -(-n // most), min(4, -(-n // (most // 16))))
    nq, ns = parts(q.count(), q_rows), parts(s.count(), s_rows)
    own = lambda d, key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = q.withColumn("x", own(q, "query_id", nq)).withColumn("y", each(ns)).withColumn("at", F.struct("x", "y")).drop("x", "y")
    b = s.withColumn("y", own(s, "source_id", ns)).withColumn("x", each(nq)).withColumn("at", F.struct("x", "y")).drop("x", "y")
    return a, b


def exact_scores(q: DataFrame, s: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The ``k`` best sources of each query in every block, among them its ``k`` best of all."""
    return _block_scores(*blocked(q, s), k, digits)


def _bucket_for(distances: list[float], dim: int, tables: int, recall: float) -> float:
    """Bucket length by which pairs at these distances share one of ``tables`` buckets at the mean rate ``recall``."""
    d = np.maximum(np.array(distances), 1e-6) / math.sqrt(dim)  # projected, a distance spreads like a normal variable of this deviation

    def shared(w: float) -> float:
        t = w / d
        p = np.array([math.erf(x / math.sqrt(2)) for x in t]) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - np.exp(-(t**2) / 2))
        return float(np.mean(1 - (1 - np.clip(p, 0, 1)) ** tables))

    lo, hi = 1e-9, 100.0
    for _ in range(60):
        lo, hi = ((lo + hi) / 2, hi) if shared((lo + hi) / 2) < recall else (lo, (lo + hi) / 2)
    return hi


def embedding_lsh(query: DataFrame, source: DataFrame, *, top_k: int = 100, vector: str = "embedding", bucket: float | None = None, tables: int = 12, seed: int = 42, recall: float = 0.95, **_: object) -> DataFrame:
    """The same approximately, by random projections: only pairs that share a bucket are scored, however far apart they are.

    Without ``bucket`` its length is set so that the ``top_k``-th neighbour, as some queries' exact ones lie, shares a
    bucket at the rate ``recall``; nearer ones do more often.  A query with fewer than ``top_k`` candidates is scored
    against every source.  Null vectors are left out.  Blocks of a bucket have at most BLOCK sources or so."""
    q, s = _vector_side(query, "query", vector, "v"), _vector_side(source, "source", vector, "u")
    n, dim = s.agg(F.count("*"), F.max(F.size("u"))).first()
    k, parts = min(top_k, n), max(1, -(-n // BLOCK))
    part = F.pmod(F.xxhash64("source_id"), F.lit(parts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    if not k:
        return ranked(q.join(s, F.lit(False)).select("query_id", "source_id", "source_order", F.lit(0.0).alias("candidate_score")), top_k)
    if bucket is None:
        some = q.orderBy(F.xxhash64("query_id", F.lit(seed)), "query_id").limit(SAMPLED)
        kth = ranked(exact_scores(some, s, k), k).where(F.col("rank") == k).collect()
        bucket = _bucket_for([math.sqrt(max(0.0, 2 - 2 * r["candidate_score"])) for r in kth] or [1.0], dim, tables, recall)
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(tables, max(1, dim)))
    planes /= np.linalg.norm(planes, axis=1, keepdims=True)
    shifts = rng.uniform(0, bucket, tables)

    @F.pandas_udf("array<long>")
    def places(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.floor((np.stack(v.to_numpy()) @ planes.T + shifts) / bucket).astype(np.int64))) if len(v) else pd.Series([], dtype=object)

    at = F.struct("table", "bucket", "part")
    a = q.select("query_id", "v", F.posexplode(places("v")).alias("table", "bucket")).withColumn("part", every).withColumn("at", at)
    b = s.select("*", F.posexplode(places("u")).alias("table", "bucket")).withColumn("part", part).withColumn("at", at)
    near = ranked_rows(_block_scores(a, b, k).dropDuplicates(["query_id", "source_id"]), k).persist()
    short = q.join(near.where(F.col("rank") == k).select("query_id"), "query_id", "left_anti")
    near = near.join(short.select("query_id"), "query_id", "left_anti").drop("rank")
    return ranked(near.unionByName(exact_scores(short, s, k)), top_k)


def bigrams(tokens: Column, interval: int = 0) -> Column:
    """Pairs of tokens at most ``interval`` tokens apart, distinct."""
    n = F.size(tokens)
    at = lambda i: F.transform(F.sequence(i + 1, F.least(n - 1, i + interval + 1)), lambda j: F.struct(F.get(tokens, i).alias("a"), F.get(tokens, j).alias("b")))
    return F.when(n >= 2, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n - 2), at)))).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def _cells(words: np.ndarray, interval: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second words of the pairs of neighbours at most ``interval`` words apart."""
    pairs = [(words[: len(words) - k], words[k:]) for k in range(1, interval + 2) if len(words) > k]
    return tuple(np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _bigram_scores(interval: int) -> Scores:
    """Rows of a side are segments (id, tokens) and, without id, the words of the block (word, vector)."""

    def vocabulary(t: pa.Table, key: str) -> tuple[dict[str, int], np.ndarray, pa.Table]:
        known = t.filter(pc.is_null(t[key]))
        return {w: i for i, w in enumerate(known["word"].to_pylist())}, _matrix(known["vector"]), t.filter(pc.is_valid(t[key]))

    def mean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), y, np.where(np.isnan(y), x, (x + y) / 2))

    def run(q: pa.Table, s: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        (qv, v, q), (sv, u, s) = vocabulary(q, "query_id"), vocabulary(s, "source_id")
        # similarities of the words of both blocks, with a row and a column of NaN for words without a vector
        sim = np.full((len(qv) + 1, len(sv) + 1), np.nan)
        if len(qv) and len(sv):
            sim[:-1, :-1] = np.clip((v @ u.T + 1) / 2, 0, 1)
        pairs = [_cells(np.array([sv.get(w, len(sv)) for w in x], np.int64), interval) for x in s["tokens"].to_pylist()]
        size = np.array([len(c) for c, _ in pairs], np.int64)
        code = np.concatenate([c * (len(sv) + 1) + d for c, d in pairs]) if size.sum() else np.zeros(0, np.int64)
        code, back = np.unique(code, return_inverse=True)
        c, d = np.divmod(code, len(sv) + 1)
        first, some = np.concatenate([[0], np.cumsum(size)[:-1]]), size > 0
        for i, words in enumerate(q["tokens"].to_pylist()):
            a, b = _cells(np.array([qv.get(w, len(qv)) for w in words], np.int64), interval)
            best = np.full(len(code), np.nan)
            for x, y in set(zip(a.tolist(), b.tolist())):
                best = np.fmax(best, np.fmax(mean(sim[x, c], sim[y, d]), mean(sim[x, d], sim[y, c])))
            row = np.zeros(len(size))
            if some.any():
                row[some] = np.nan_to_num(np.fmax.reduceat(best[back], first[some]))
            yield i, row[None]

    return run


def bigram(query: DataFrame, source: DataFrame, vectors: DataFrame, *, interval: int = 0, order_free: bool = True, top_k: int = 100, digits: int | None = None, **_: object) -> DataFrame:
    """Best similarity of a bigram of the query and one of the source, by word vectors.

    Two bigrams score the better of the mean of (first, first) and (second, second) and of the crossed mean; a word
    without a vector is left out of its mean.  A query without bigrams has no candidates, a source without any
    scores 0.  ``order_free`` can't change a score, as crossing is symmetric.  Both sides are dealt to blocks, and every pair of
    blocks is a task: it gets the vectors of its words once, compares distinct bigrams, and passes on each query's ``top_k``."""
    k = max(1, int(top_k))
    known = vectors.select("word", unit(F.col("vector")).alias("vector"))
    tokens = tx.latin_tokens(F.col("text"))
    q = _side(query, "query", tokens.alias("tokens")).where(F.size("tokens") > 1).drop("query_order")
    q, s = blocked(q, _side(source, "source", tokens.alias("tokens")), QUERY_TEXTS, SOURCE_TEXTS)

    def with_words(side: DataFrame) -> DataFrame:
        words = side.select("at", F.explode("tokens").alias("word")).distinct().join(known, "word")
        return side.unionByName(words, allowMissingColumns=True)

    rate = (lambda x: x) if digits is None else (lambda x: np.round(x, digits))
    scored = _in_blocks(with_words(q), with_words(s), _best_of_block(k, _bigram_scores(interval), rate))
    return ranked(scored if digits is None else scored.withColumn("candidate_score", F.round("candidate_score", digits)), k)


def content_words(text: Column, *, min_length: int = 2, stopwords: frozenset[str] | None = CONTEXTUAL) -> Column:
    """Runs of ASCII letters, long enough and no stopwords."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), 0)
    return F.filter(words, lambda t: (F.length(t) >= min_length) & (~F.lower(t).isin(*sorted(stopwords)) if stopwords else F.lit(True)))


def _word_scores(q: pa.Table, s: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Best product of a vector of the query and one of the source; 0 where a side has none."""

    def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        lists = pa.concat_arrays([c for c in column.chunks])
        size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        inner = lists.flatten()
        return np.asarray(inner.flatten()).reshape(len(inner), -1) if len(inner) else np.zeros((0, 0)), np.concatenate([[0], np.cumsum(size)])

    (v, vp), (u, up) = flat(q["v"]), flat(s["u"])
    some = np.diff(up) > 0
    for i in range(q.num_rows):
        row = np.zeros(s.num_rows)
        if vp[i + 1] > vp[i] and len(u):
            mine = v[vp[i] : vp[i + 1]]
            best = np.concatenate([(mine @ u[k : k + 50_000].T).max(axis=0) for k in range(0, len(u), 50_000)])
            row[some] = np.maximum.reduceat(best, up[:-1][some])
        yield i, row[None]


def contextual(query_vectors: DataFrame, source_vectors: DataFrame, query: DataFrame, source: DataFrame, *, top_k: int = 100, digits: int | None = None, **_: object) -> DataFrame:
    """Best cosine of a word of the query and a word of the source in context, as (cosine + 1) / 2; 0.5 (a cosine of 0) where a side has no
    words.  ``*_vectors``: (seg_id, vector), a row a word; zero vectors are left out.

    Equal vectors of a segment count once.  Both sides are dealt to blocks, and every pair of blocks is a task that
    multiplies the vectors of its words and passes on each query's ``top_k``."""
    k = max(1, int(top_k))

    def side(segments: DataFrame, vectors: DataFrame, name: str, v: str) -> DataFrame:
        rows = vectors.select(F.col("seg_id").alias(f"{name}_id"), unit(F.col("vector")).alias(v)).where(F.exists(v, lambda x: x != 0))
        return _side(segments, name).join(rows.groupBy(f"{name}_id").agg(F.collect_set(v).alias(v)), f"{name}_id", "left")

    q, s = blocked(side(query, query_vectors, "query", "v").drop("query_order"), side(source, source_vectors, "source", "u"), QUERY_TEXTS, SOURCE_TEXTS)
    value = lambda c: np.clip((c + 1) / 2, 0, 1)
    scored = _in_blocks(q, s, _best_of_block(k, _word_scores, value if digits is None else lambda c: np.round(value(c), digits)))
    score = tx.clamped_cosine(F.col("candidate_score"))
    return ranked(scored.withColumn("candidate_score", score if digits is None else F.round(score, digits)), k)
