"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates per language and source.

Every text becomes a vector of transformed shape statistics.  Languages with sources, languages, and all documents are three
levels of groups, estimated at once.  From several starts (medians and quartiles, all rows, two small random draws) each
group is concentrated: distances, the share HALF of smallest distances, mean and covariance of those, and again; the start
that gives the least determinant after FIRST steps goes on until no determinant falls any more.  A small group's estimate
is drawn towards that of its language, and that one's towards all, by how few rows it has.

Estimates stay tables, a row a group: a step is two aggregates over the table of vectors in the JVM, cuts come from
histograms of distances, and nothing but a count reaches the driver.  A hot group combines on the map side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, drop_written, fresh, hash_side, text_hash, written
from .textstats import FLOOR, NAMES, statistics, transformed

D = len(NAMES)
#: Share of a group that an estimate rests on, steps from every start, most steps of the best one, least fall of a
#: log-determinant that counts, and how many rows the estimate above a group is worth to it.
HALF, FIRST, MOST_STEPS, SETTLED, WORTH = 0.75, 2, 30, 0.01, 50
#: Rows of a random start, and bins of distances for a factor e.
DRAWN, _BINS = 2 * D, 64
#: Share of the documents of a normal group that lie beyond the cut: so few that a corpus of any size loses none by chance.
TAIL = 1e-12
_X = [f"x{i}" for i in range(D)]
_PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
_ESTIMATE = "g string, s int, n long, ld double, m array<double>, c array<double>, p array<double>"


def chi_squared(x: float, k: int) -> float:
    """Distribution function of chi-squared with ``k`` degrees of freedom."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    i = a
    while term > 1e-16 * total:
        i += 1
        term *= x / i
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0


def chi_squared_at(share: float, k: int) -> float:
    """Its quantile."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        lo, hi = ((lo + hi) / 2, hi) if chi_squared((lo + hi) / 2, k) < share else (lo, (lo + hi) / 2)
    return hi


#: What the covariance of the nearest HALF falls short of that of all rows of a normal group; median distance of one.
CONSISTENT = HALF / chi_squared(chi_squared_at(HALF, D), D + 2)
_MEDIAN = chi_squared_at(0.5, D)
CUTOFF = chi_squared_at(1 - TAIL, D)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w, n, x in statistics(batch.column(2)):
            x = transformed(x)
            part = batch.slice(w.first, w.n_docs)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), part.column(4), *[pa.array(np.ascontiguousarray(x[:, i])) for i in range(D)]], names=["doc_id", "th", "lang", "source", *_X])


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, th, lang, source, x0..): the vectors of all rows, written to the shared folder."""
    src = columns(docs, doc_id="long", text="string", lang="string", source="string")
    src = src.select("doc_id", text_hash().alias("th"), "text", "lang", "source")
    return written(src.mapInArrow(_vectors, "doc_id long, th long, lang string, source string, " + ", ".join(f"{x} double" for x in _X)), "vectors")


def _keys() -> list[Column]:
    """Names of the groups of a row, from all documents down to its language and source."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return [F.lit("*"), name("lang"), F.concat_ws("\x01", name("lang"), name("source"))]


def _squared() -> Column:
    """Squared Mahalanobis distance of a row (x0.., m, p)."""
    c = [F.col(x) - F.col("m")[i] for i, x in enumerate(_X)]
    terms = [c[i] * c[j] * F.col("p")[k] * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(_PAIRS)]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def _bin(d2: Column) -> Column:
    return F.floor(F.log(d2 + 1e-9) * _BINS).cast("int")


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, sums, products): what means and covariances are made of."""
    x = [F.col(c) for c in _X]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in x]).alias("sums"), F.array(*[F.sum(x[i] * x[j]) for i, j in _PAIRS]).alias("products"))


def _full(c: np.ndarray) -> np.ndarray:
    out = np.zeros((D, D))
    for k, (i, j) in enumerate(_PAIRS):
        out[i, j] = out[j, i] = c[k]
    return out


def _upper(c: np.ndarray) -> list[float]:
    return [float(c[i, j]) for i, j in _PAIRS]


def inverse(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """Precision and log-determinant of a covariance; no statistic varies less than its FLOOR."""
    cov = cov + np.diag(FLOOR**2)
    return np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def _estimates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums as estimates.  Rounded, for sums of floats depend on their order in the last digits."""
    for f in frames:
        out = []
        for g, s, n, a, b in zip(f["g"], f["s"], f["n"], f["sums"], f["products"]):
            mu = np.array(a) / n
            cov = np.round(_full(np.array(b) / n) - np.outer(mu, mu), 9)
            p, ld = inverse(cov)
            out.append((g, s, n, ld, np.round(mu, 9).tolist(), _upper(cov), _upper(p)))
        yield pd.DataFrame(out, columns=["g", "s", "n", "ld", "m", "c", "p"])


def _reached(hist: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, cut): the bin in which ``share`` of the rows of each histogram (keys, bin, rows) is reached."""
    by = Window.partitionBy(*keys)
    c = hist.select(*keys, "bin", F.sum("rows").over(by.orderBy("bin")).alias("below"), F.sum("rows").over(by).alias("all"))
    return c.where(F.col("below") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(F.min("bin").alias("cut"))


def _starts(rows: DataFrame) -> DataFrame:
    """Estimates to start from: 0 medians and quartiles, 1 all rows, 2 and 3 a few rows each."""
    q = rows.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias(x) for x in _X])

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                a = np.array([list(r[x]) for x in _X])
                cov = np.diag(((a[:, 2] - a[:, 0]) / 1.349) ** 2)
                p, ld = inverse(cov)
                out.append((r["g"], 0, r["n"], ld, a[:, 1].tolist(), _upper(cov), _upper(p)))
            yield pd.DataFrame(out, columns=["g", "s", "n", "ld", "m", "c", "p"])

    all_rows = _sums(rows, "g").withColumn("s", F.lit(1))
    for k in (2, 3):
        rank = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("th", "doc_id", F.lit(k)), *_X))
        drawn = _sums(rows.withColumn("rn", rank).where(F.col("rn") <= DRAWN), "g").withColumn("s", F.lit(k))
        all_rows = all_rows.union(drawn)
    return q.mapInPandas(spread, _ESTIMATE).union(all_rows.select("g", "s", "n", "sums", "products").mapInPandas(_estimates, _ESTIMATE))


def _concentrated(rows: DataFrame, now: DataFrame) -> DataFrame:
    """Estimates from the share HALF of each group that lies nearest by the estimates ``now``."""
    rated = rows.join(now.select("g", "s", "m", "p"), "g").select("g", "s", *_X, _bin(_squared()).alias("bin"))
    # written, so that its size is known and it is broadcast if small: rows of a hot group stay where they are
    cuts = written(_reached(rated.groupBy("g", "s", "bin").agg(F.count("*").alias("rows")), ["g", "s"], HALF), "cuts")
    inner = rated.join(cuts, ["g", "s"]).where("bin <= cut")
    return _sums(inner, "g", "s").mapInPandas(_estimates, _ESTIMATE)


def estimates(rows: DataFrame) -> DataFrame:
    """(g, s, n, ld, m, c, p): of each group of ``rows`` (g, th, doc_id, x0..) mean, covariance and precision of least determinant."""
    now = written(_starts(rows), "starts")
    for _ in range(FIRST):
        then = written(_concentrated(rows, now), "steps")
        drop_written(now)
        now = then
    names = ["s", "n", "ld", "m", "c", "p"]
    best = written(now.groupBy("g").agg(F.min_by(F.struct(*names), F.struct("ld", "s")).alias("e")).select("g", *[F.col(f"e.{c}").alias(c) for c in names]), "best")
    drop_written(now)
    state = best.withColumn("moved", F.lit(True))
    for _ in range(MOST_STEPS):
        # groups whose determinant fell go on; the others have settled
        new = _concentrated(rows, state.where("moved")).select("g", F.struct(*names).alias("e"))
        fell = F.coalesce(F.col("e.ld") < F.col("ld") - SETTLED, F.lit(False))
        either = state.join(new, "g", "left").select("g", F.when(fell, F.col("e")).otherwise(F.struct(*names)).alias("k"), fell.alias("moved"))
        then = written(either.select("g", *[F.col(f"k.{c}").alias(c) for c in names], "moved"), "steps")
        drop_written(state)
        state = then
        if state.where("moved").isEmpty():
            break
    return state


def _drawn_up(names: DataFrame, best: DataFrame) -> DataFrame:
    """(g, m, p) of each language and source, by the estimates and sizes of the levels above it as well."""
    e = best.select("g", "m", "c")
    sized = names
    for k in range(3):
        sized = sized.join(e.select(F.col("g").alias(f"g{k}"), F.col("m").alias(f"m{k}"), F.col("c").alias(f"c{k}")), f"g{k}")

    def combined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                mu, cov = np.array(r["m0"]), _full(np.array(r["c0"]))
                for k in (1, 2):
                    t = r[f"n{k}"] / (r[f"n{k}"] + WORTH)
                    m, c = np.array(r[f"m{k}"]), _full(np.array(r[f"c{k}"]))
                    mu, cov = t * m + (1 - t) * mu, t * c + (1 - t) * cov
                p, _ = inverse(CONSISTENT * cov)
                out.append((r["g2"], np.round(mu, 9).tolist(), np.round(_upper(p), 9).tolist()))
            yield pd.DataFrame(out, columns=["g", "m", "p"])

    return sized.mapInPandas(combined, "g string, m array<double>, p array<double>")


def distances(docs: DataFrame) -> DataFrame:
    """(doc_id, th, lang, source, distance): squared robust distance of every row from its language and source.

    Estimates of a group of n rows count n to WORTH against that of its language, that one's likewise against all rows.  Null
    names are values like others.  Null, empty and word-less texts have the typical vector of no words; texts of any
    length are taken whole.  Repeated rows count and come back each, with equal distances; rows at the same distance are all within a cut or all
    beyond it.  A statistic never counts as varying less than its FLOOR, so groups of equal texts have
    distances too.  Columns other than doc_id, text, lang and source are not looked at; an empty table gives an empty result.
    """
    v = vectors(docs)
    k0, k1, k2 = _keys()
    levels = v.select("doc_id", "th", *_X, F.explode(F.array(k0, k1, k2)).alias("g"))
    best = estimates(levels)
    n = v.groupBy("lang", "source").agg(F.count("*").alias("n2"))
    n = n.select(k0.alias("g0"), k1.alias("g1"), k2.alias("g2"), F.sum("n2").over(Window.partitionBy("lang")).alias("n1"), "n2")
    names = written(n, "groups")
    final = written(_drawn_up(names, best), "estimates")
    rated = v.withColumn("g", k2).join(final, "g").select("g", k1.alias("g1"), "doc_id", "th", "lang", "source", _squared().alias("d2"))
    # the median distance of a group is at least that of chi-squared; of few rows it is drawn up in the same way
    hist = rated.select(F.explode(F.array(F.lit("*"), "g1", "g")).alias("k"), _bin(F.col("d2")).alias("bin")).groupBy("k", "bin").agg(F.count("*").alias("rows"))
    off = written(_reached(hist, ["k"], 0.5).select("k", ((F.col("cut") + 1) / _BINS - math.log(_MEDIAN)).alias("off")), "medians")
    scale = names
    for i in range(3):
        scale = scale.join(off.select(F.col("k").alias(f"g{i}"), F.col("off").alias(f"o{i}")), f"g{i}")
    t1, t2 = (F.col(f"n{i}") / (F.col(f"n{i}") + WORTH) for i in (1, 2))
    scale = scale.select(F.col("g2").alias("g"), F.greatest(F.exp(t2 * F.col("o2") + (1 - t2) * (t1 * F.col("o1") + (1 - t1) * F.col("o0"))), F.lit(1.0)).alias("scale"))
    scale = written(scale, "scales")
    for done in (best, names, off):
        drop_written(done)
    return rated.join(scale, "g").select("doc_id", "th", "lang", "source", F.round(F.col("d2") / F.col("scale"), 6).alias("distance"))


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, lang, source, distance) of the documents that stay: those whose squared distance doesn't exceed ``cutoff``.

    Nulls, empty and very long texts, ties, repeated rows, clashing names and empty tables: see :func:`distances`; a distance
    equal to ``cutoff`` stays."""
    return distances(docs).where(F.col("distance") <= cutoff).select("doc_id", "lang", "source", "distance")


def keep_inliers(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` without those that :func:`quality_rules` rejects, all columns, whatever their names.

    Rows alike in doc_id, text, language and source (null equals null) share their fate, so repeated rows all stay or all
    go.  Null and empty texts stay where texts of no words are no outliers; texts of any length are taken whole; an empty table stays empty."""
    out = distances(docs).where(F.col("distance") > cutoff)
    k = [fresh(f"qw_{c}", docs.columns) for c in ("doc_id", "th", "lang", "source")]
    have = {c.lower(): F.col(f"`{c}`") for c in docs.columns}
    get = lambda c, t: have[c].cast(t) if c in have else F.lit(None).cast(t)
    gone = written(out.select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "th", "lang", "source"), k)]).distinct(), "gone")
    th = fresh("qw_text", docs.columns)
    rows = docs.withColumn(th, F.when(get("text", "string").isNotNull(), F.xxhash64(get("text", "string"))))
    on = F.col(th).eqNullSafe(F.col(k[1])) & get("doc_id", "long").eqNullSafe(F.col(k[0])) & get("lang", "string").eqNullSafe(F.col(k[2])) & get("source", "string").eqNullSafe(F.col(k[3]))
    return rows.join(hash_side(gone, 100), on, "left_anti").drop(th)
