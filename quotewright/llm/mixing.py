"""Mixing sources to target weights by hierarchical budgets.

Documents are the leaves of a tree domain → language → source.  A budget of tokens flows down by the weights of the
nodes; where a subtree holds less than its share, the rest goes to its siblings first, by their weights, and only what
they all can't take reaches the next ancestor.  This is water filling, level by level: a node gets min(capacity,
weight x level), the level found by sorting.  Each leaf then takes a prefix of its documents in the seeded order of each epoch.

The order is that of md5 hashes.  A leaf's cut is found from counts per bucket of hashes; only the bucket in which the
budget ends is ordered, so no leaf, however hot, is ever sorted as a whole.  Texts are not shuffled at all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, fresh, written

DOMAINS = ("web", "reference", "other")


@dataclass(frozen=True)
class Mix:
    """Targets.  Weights that aren't given are 1; they count relative to siblings.

    ``budget``: share of all tokens to draw.  ``epochs``: how often a document may be drawn at most.
    ``domains``: domain → regular expression of its sources, the first that matches; others are ``other``."""

    domains: dict[str, str] = field(default_factory=lambda: {"web": "^src[0-9]$", "reference": "^src1[0-9]$"})
    domain_weights: dict[str, float] = field(default_factory=lambda: {"web": 3, "reference": 2})
    lang_weights: dict[str, float] = field(default_factory=lambda: {"en": 4, "de": 1, "fr": 1, "es": 1})
    source_weights: dict[str, float] = field(default_factory=dict)
    budget: float = 0.8
    epochs: int = 2
    seed: int = 17


def _cases(value: Column, of: dict, otherwise) -> Column:
    out = F.lit(otherwise)
    for k, v in reversed(list(of.items())):
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def _leaf(source: Column, lang: Column, mix: Mix) -> list[Column]:
    domain = F.lit("other")
    for name, pattern in reversed(list(mix.domains.items())):
        domain = F.when(source.rlike(pattern), F.lit(name)).otherwise(domain)
    return [F.when(source.isNull(), F.lit("other")).otherwise(domain), F.coalesce(lang, F.lit("")), F.coalesce(source, F.lit(""))]


def _tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("\\S+")), F.lit(0)).cast("long")


def _order(epoch: int, doc_id: Column, text: Column, mix: Mix) -> Column:
    """Place of a document in the seeded order of an epoch; a row without doc_id goes by its text."""
    return F.md5(F.concat(F.lit(f"{mix.seed}:{epoch}:"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))).cast("binary"))


def fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``share`` of each node of (*parent, budget, capacity, weight): min(capacity, weight * level), level such
    that the shares of one parent's nodes add up to its budget, or to all their capacity."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    # by capacity for weight: nodes that fill up come first; a node of weight 0 gets only what no other takes
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    o = by.orderBy("ratio", "capacity", "weight").rowsBetween(Window.unboundedPreceding, -1)
    x = nodes.withColumn("ratio", ratio).withColumn("cap_before", F.coalesce(F.sum("capacity").over(o), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("weight").over(o), F.lit(0.0))).withColumn("w_all", F.sum("weight").over(by))
    level = (F.col("budget") - F.col("cap_before")) / F.nullif(F.col("w_all") - F.col("w_before"), F.lit(0.0))
    # the first node that its level does not fill sets that of the rest; after it levels only fall
    x = x.withColumn("level", F.when((F.col("weight") > 0) & (level < F.col("ratio")), level)).withColumn("level", F.max("level").over(by))
    rest = F.greatest(F.col("budget") - F.sum(F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0)).over(by), F.lit(0.0))
    spare = F.sum(F.when(F.col("weight") > 0, 0.0).otherwise(F.col("capacity"))).over(by)
    share = F.when(F.col("weight") <= 0, F.when(spare > 0, F.col("capacity") * F.least(F.lit(1.0), rest / spare)).otherwise(0.0)).otherwise(F.least("capacity", F.coalesce(F.when(F.col("level").isNotNull(), F.greatest(F.col("level"), F.lit(0.0)) * F.col("weight")), F.col("capacity"))))
    return x.withColumn("share", share).drop("ratio", "cap_before", "w_before", "w_all", "level")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens) → the same with ``budget``, the whole tokens each leaf shall give."""
    c = leaves.withColumn("capacity", F.col("tokens") * float(mix.epochs))
    total = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * mix.budget).alias("budget"))
    up = lambda *k: c.groupBy(*k).agg(F.sum("capacity").alias("capacity"))
    d = fill(up("domain").crossJoin(total).withColumn("weight", _cases(F.col("domain"), mix.domain_weights, 1.0).cast("double")), [])
    d = d.select("domain", F.col("share").alias("budget"))
    la = fill(up("domain", "lang").join(d, "domain").withColumn("weight", _cases(F.col("lang"), mix.lang_weights, 1.0).cast("double")), ["domain"])
    la = la.select("domain", "lang", F.col("share").alias("budget"))
    s = fill(up("domain", "lang", "source").join(la, ["domain", "lang"]).withColumn("weight", _cases(F.col("source"), mix.source_weights, 1.0).cast("double")), ["domain", "lang"])
    s = s.select("domain", "lang", "source", F.floor(F.col("share") + 1e-6).cast("long").alias("budget"))
    return leaves.join(s, ["domain", "lang", "source"])


def _cuts(rows: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, full, cut): whole epochs that each leaf gives, and the last hash of the one after."""
    key = ["domain", "lang", "source"]
    leaves = rows.groupBy(*key).agg(F.sum("tokens").alias("tokens"))
    plan = written(budgets(leaves, mix).select(*key, "tokens", "budget", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(mix.epochs)).cast("int").alias("full")).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")), "budgets")
    on = rows.join(plan.select(*key, "full", "rest"), key)
    order = F.lit(None).cast("string")
    for e in range(mix.epochs):
        order = F.when(F.col("full") == e, F.col(f"o{e}")).otherwise(order)
    part = written(on.where(F.col("full") < mix.epochs).select(*key, "rest", order.alias("o"), "tokens"), "order")
    bucket = F.substring("o", 1, 3)
    w = Window.partitionBy(*key).orderBy("bucket")
    sums = part.groupBy(*key, "rest", bucket.alias("bucket")).agg(F.sum("tokens").alias("t")).withColumn("upto", F.sum("t").over(w))
    ends = sums.where("upto > rest").groupBy(*key).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("t")).alias("before"))).alias("e")).select(*key, F.col("e.bucket").alias("bucket"), F.col("e.before").alias("before"))
    inside = part.join(ends, key).where(F.substring("o", 1, 3) == F.col("bucket")).withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy(*key).orderBy("o")))
    last = inside.where("upto <= rest").groupBy(*key).agg(F.max("o").alias("last"))
    # nothing of that bucket fits: the cut lies before it
    ends = ends.join(last, key, "left").select(*key, F.coalesce("last", F.concat(F.col("bucket"), F.lit(""))).alias("cut"))
    return plan.select(*key, "full").join(ends, key, "left")


def mix_sources(docs: DataFrame, mix: Mix = Mix(), epoch_column: bool = True) -> DataFrame:
    """``docs`` as drawn: a row for each epoch that draws it, all columns, and ``epoch`` (with underscores before it if taken).

    Tokens are runs of non-space characters.  A null lang or source counts as an empty name; null and empty texts
    have no tokens and are drawn with the prefix that they fall in.  A leaf draws in order as long as its budget isn't exceeded; rows that
    tie in the order (equal doc_id) are drawn together or not at all.  An empty table gives an empty result.
    """
    src = columns(docs, doc_id="long", text="string", lang="string", source="string")
    d, la, s = _leaf(F.col("source"), F.col("lang"), mix)
    orders = [_order(e, F.col("doc_id"), F.col("text"), mix).alias(f"o{e}") for e in range(mix.epochs)]
    rows = src.select(d.alias("domain"), la.alias("lang"), s.alias("source"), _tokens(F.col("text")).alias("tokens"), *orders)
    cuts = written(_cuts(written(rows, "tokens"), mix), "cuts")
    taken = docs.columns
    k = [fresh(x, taken) for x in ("qw_domain", "qw_lang", "qw_source", "qw_full", "qw_cut")]
    epoch = fresh("epoch", taken)
    have = {c.lower(): F.col(f"`{c}`") for c in taken}
    get = lambda c, t: have[c].cast(t) if c in have else F.lit(None).cast(t)
    leaf = _leaf(get("source", "string"), get("lang", "string"), mix)
    cuts = cuts.toDF(*k)
    on = docs.join(cuts, [a == F.col(b) for a, b in zip(leaf, k)])
    drawn = [F.when((F.col(k[3]) > e) | ((F.col(k[3]) == e) & (F.col(k[4]).isNull() | (_order(e, get("doc_id", "long"), get("text", "string"), mix) <= F.col(k[4])))), F.lit(e)) for e in range(mix.epochs)]
    out = on.withColumn(epoch, F.explode(F.array_compact(F.array(*drawn)))).drop(*k)
    return out if epoch_column else out.drop(epoch)


def _sql(mix: Mix = Mix()) -> str:
    case = lambda v, of: "CASE " + " ".join(f"WHEN {v} = '{k}' THEN {float(w)}" for k, w in of.items()) + " ELSE 1.0 END" if of else "1.0"
    domain = "CASE " + " ".join(f"WHEN regexp_matches(source, '{p}') THEN '{k}'" for k, p in mix.domains.items()) + " ELSE 'other' END"

    def level(name: str, src: str, key: str, parent: str, budget: str, weight: str) -> str:
        part = f"PARTITION BY {parent}" if parent else ""
        return f"""
{name}0 AS (SELECT {key}, sum(capacity)::DOUBLE AS capacity FROM leaf GROUP BY ALL),
{name}1 AS (SELECT c.*, b.budget, ({weight})::DOUBLE AS weight FROM {name}0 c {budget}),
{name}2 AS (SELECT *, capacity / weight AS ratio, sum(weight) OVER ({part}) AS w_all,
  coalesce(sum(capacity) OVER ({part} ORDER BY capacity / weight, capacity, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
  coalesce(sum(weight) OVER ({part} ORDER BY capacity / weight, capacity, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb FROM {name}1),
{name}3 AS (SELECT *, max(CASE WHEN (budget - cb) / (w_all - wb) < ratio THEN (budget - cb) / (w_all - wb) END) OVER ({part}) AS level FROM {name}2),
{name} AS (SELECT {key}, least(capacity, coalesce(CASE WHEN level IS NOT NULL THEN greatest(level, 0) * weight END, capacity)) AS budget FROM {name}3)"""

    md5 = lambda e: f"md5('{mix.seed}:' || {e} || ':' || doc_id)"
    return f"""
WITH t AS (SELECT *, {domain} AS domain, len(regexp_extract_all(text, '\\S+'))::BIGINT AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE * {float(mix.epochs)} AS capacity FROM t GROUP BY ALL),
{level("d", "leaf", "domain", "", f", (SELECT sum(tokens)::DOUBLE * {mix.budget} AS budget FROM leaf) b", case("domain", mix.domain_weights))},
{level("l", "leaf", "domain, lang", "domain", "JOIN d b USING (domain)", case("lang", mix.lang_weights))},
{level("s", "leaf", "domain, lang, source", "domain, lang", "JOIN l b USING (domain, lang)", case("source", mix.source_weights))},
p AS (SELECT domain, lang, source, floor(s.budget + 1e-6)::BIGINT AS budget, leaf.tokens AS total FROM s JOIN leaf USING (domain, lang, source)),
e AS (SELECT t.*, epoch, budget, total, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('{mix.seed}:' || epoch || ':' || doc_id)) AS upto
      FROM t JOIN p USING (domain, lang, source), (SELECT unnest(range({mix.epochs}))::INT AS epoch))
SELECT doc_id, text, lang, source, n_chars, epoch FROM e WHERE epoch * total + upto <= budget
"""


SQL = _sql()
