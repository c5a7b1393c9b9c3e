"""Queries over the test tables, and SQL for DuckDB that says the same.

``benchmark`` items are query segments and ``documents`` source segments of lexical matching; ``embeddings`` are both
sides of vector matching, and vectors of one label are the gold pairs; turns of ``conversations`` are segments of
documents.  All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.functions import text as tx
from quotewright.functions.stopwords import CONTEXTUAL, LEXICAL
from quotewright.operators import evaluate as ev
from quotewright.operators import generators, judges, models, rules, segments
from quotewright.sources import segments as src
from quotewright.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return src.of_table(_table(spark, d, "benchmark"), "item_id")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return src.of_table(_table(spark, d, "documents"), "doc_id")


# --- segments -------------------------------------------------------------------------------------------------------


@query("SELECT CAST(doc_id AS VARCHAR) AS seg_id, text, doc_id AS pos FROM documents")
def segments_scan(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("seg_id", "text", "pos")


@query("SELECT CAST(doc_id AS VARCHAR) AS seg_id, text FROM documents ORDER BY doc_id LIMIT 5")
def segments_head(spark: SparkSession, d: str) -> DataFrame:
    return segments.head(_docs(spark, d)).select("seg_id", "text")


@query("SELECT CAST(doc_id AS VARCHAR) AS seg_id, text FROM documents WHERE CAST(doc_id AS VARCHAR) = '7'")
def segment_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(F.col("seg_id") == "7").select("seg_id", "text")


_WORDS = "len(regexp_extract_all(text, '\\S+'))"
_STATS = f"""CAST(count(*) AS BIGINT) AS num_segments, CAST(sum(length(text)) AS BIGINT) AS total_chars, CAST(sum({_WORDS}) AS BIGINT) AS total_words,
  round(avg(length(text)), 2) AS avg_chars, round(avg({_WORDS}), 2) AS avg_words, min(length(text))::BIGINT AS min_chars, max(length(text))::BIGINT AS max_chars"""


@query(f"SELECT {_STATS} FROM documents")
def segment_statistics(spark: SparkSession, d: str) -> DataFrame:
    return segments.statistics(_docs(spark, d))


@query(f"SELECT lang, {_STATS} FROM documents GROUP BY lang")
def statistics_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return segments.statistics(_table(spark, d, "documents"), ["lang"])


_D, _S = "“”„«»", "‘’‚‛`´"
_CLEAN = f"""trim(regexp_replace(translate(translate(nfc_normalize(text), '{_D}{_S}', '""" + '"' * 5 + "''" * 6 + """'), '–—‒―−‑', '------'), '\\s+', ' ', 'g'))"""


@query(f"SELECT doc_id, {_CLEAN} AS text FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", tx.clean(F.col("text")).alias("text"))


@query(f"SELECT seg_id, text, CAST(row_number() OVER (ORDER BY pos) - 1 AS INT) AS row_id FROM (SELECT CAST(item_id AS VARCHAR) AS seg_id, {_CLEAN} AS text, item_id AS pos FROM benchmark) WHERE text <> ''")
def clean_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.clean(_items(spark, d)).select("seg_id", "text", "row_id")


_SPLIT = "string_split(regexp_replace({t}, '([.!?;])\\s+', concat('\\1', chr(1)), 'g'), chr(1))"


@query(f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INT) AS n, s AS sentence FROM (
  SELECT doc_id, unnest(range(len(x))) AS k, regexp_replace(unnest(x), '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT doc_id, {_SPLIT.format(t='text')} AS x FROM documents)) WHERE s <> ''""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("k", "sentence")).select("doc_id", (F.col("k") + 1).cast("int").alias("n"), "sentence")


@query(f"""
WITH c AS (SELECT conv_id, turn, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM conversations),
t AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM c GROUP BY conv_id),
p AS (SELECT conv_id, unnest(range(len(x))) AS k, unnest(x) AS raw FROM (SELECT conv_id, regexp_extract_all(regexp_replace(text, '([.!?;])(\\s+)', concat('\\1\\2', chr(1)), 'g'), '[^' || chr(1) || ']+') AS x FROM t)),
o AS (SELECT *, coalesce(sum(length(raw)) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(raw) - length(regexp_replace(raw, '^\\s+', '')) AS spot,
  regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS sentence FROM p),
m AS (SELECT o.conv_id, spot, sentence, turn FROM o ASOF JOIN (SELECT * FROM c WHERE length(text) > 0) c ON o.conv_id = c.conv_id AND o.spot >= c.start WHERE sentence <> '')
SELECT conv_id, turn || '.' || row_number() OVER (PARTITION BY conv_id, turn ORDER BY spot) AS seg_id, sentence AS text,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY spot) - 1 AS INT) AS row_id FROM m""")
def sentencize_conversations(spark: SparkSession, d: str) -> DataFrame:
    turns = _table(spark, d, "conversations")
    seg = turns.select(F.col("turn").cast("string").alias("seg_id"), "text", F.lit(None).cast("int").alias("row_id"), F.col("turn").alias("pos"), F.create_map().cast("map<string,string>").alias("meta"), "conv_id")
    return segments.sentencize(seg, "conv_id").select("conv_id", "seg_id", "text", "row_id")


_LATIN = "trim(regexp_replace(regexp_replace(translate(lower(text), 'jv', 'iu'), '[^a-z]', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT doc_id, {_LATIN} AS text FROM documents")
def latin_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", tx.latin(F.col("text")).alias("text"))


@query(f"SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split({_LATIN}, ' ')) AS token FROM documents) WHERE token <> '' GROUP BY token")
def latin_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(F.explode(tx.latin_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


# --- lexical rules --------------------------------------------------------------------------------------------------

_SEP = "[ —?!\\-,.()\\[\\]:;''/“”„]"
_NOT = "[^" + _SEP[1:]
_MAP = {**tx.ASSIMILATED}


def _transform_sql(t: str) -> str:
    cases = " ".join(f"WHEN starts_with(lower({t}), '{k}') THEN {t}[1] || '{v[1:]}' || {t}[{len(k) + 1}:]" for k, v in _MAP.items())
    return f"""CASE WHEN starts_with(lower({t}), 'ads') THEN CASE WHEN length({t}) = 3 THEN {t} WHEN regexp_matches(lower({t}), '^ads[aeiou]') THEN {t}[1] || 'ss' || {t}[4:] ELSE {t}[1] || 's' || {t}[4:] END {cases} ELSE {t} END"""


def _assimilated_sql(table: str, key: str) -> str:
    start = "^(" + "|".join([*_MAP, "ads"]) + ")"
    return f"""(SELECT id, CASE WHEN len(toks) = 0 THEN text ELSE list_reduce(list_prepend(text, toks), lambda a, t: replace(a, t, {_transform_sql('t')})) END AS text
  FROM (SELECT {key} AS id, text, list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]'), lambda t: regexp_matches(lower(t), '{start}')) AS toks FROM {table}))"""


def _phrased_sql(text: str) -> str:
    return f"""regexp_replace(regexp_replace(translate({text}, '"“”„''‘’', '{"''" * 7}'), ' (que|ve|ue)([ ,.!?])', '\\1\\2', 'g'), '^\\s+|\\s+$', '', 'g')"""


def _prepared_sql(name: str, table: str, key: str, poetry: bool) -> str:
    text = "text || ' /'" if poetry else "text"
    return f"""{name} AS (SELECT id, phrased, list_filter(string_split_regex(regexp_replace(lower(translate(phrased, 'vjVJ', 'uiUI')), '^\\s+|\\s+$', '', 'g'), '{_SEP}+'), lambda t: t <> '') AS folded
  FROM (SELECT id, {_phrased_sql(text)} AS phrased FROM {_assimilated_sql(table, key)}) WHERE length(phrased) > 1)"""


_STOP = "(" + ", ".join(f"'{w}'" for w in sorted(LEXICAL)) + ")"


def _side_sql(n: str) -> str:
    """Distinct words of a side with their places, as in rules._words."""
    return f"""
{n}f AS (SELECT id, token, min(k) AS first FROM (SELECT id, unnest(folded) AS token, unnest(range(len(folded))) AS k FROM {n}) WHERE token NOT IN {_STOP} GROUP BY id, token),
{n}p AS (SELECT id, unnest(x) AS part, unnest(range(len(x))) AS k FROM (SELECT id, regexp_extract_all(phrased, '{_NOT}+|{_SEP}+') AS x FROM {n})),
{n}c AS (SELECT id, lower(part) AS token, k, NOT regexp_matches(part, '^{_SEP}') AND lower(part) NOT IN {_STOP} AS kept,
  sum(length(part) - length(replace(part, ',', ''))) OVER w AS c0, sum(length(part) - length(replace(part, ';', ''))) OVER w AS c1, sum(length(part) - length(replace(part, ':', ''))) OVER w AS c2
  FROM {n}p WINDOW w AS (PARTITION BY id ORDER BY k)),
{n}k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS place FROM {n}c WHERE kept),
{n}m AS (SELECT id, token, min_by(c0, k) AS c0, min_by(c1, k) AS c1, min_by(c2, k) AS c2 FROM {n}k GROUP BY id, token)"""


def _gap_sql(n: str, other: str) -> str:
    """Least distance of marked words of side ``n`` for each pair."""
    return f"""
{n}g AS (SELECT q, s, min(place - before) AS gap FROM (SELECT q, s, place, lag(place) OVER (PARTITION BY q, s ORDER BY place) AS before
  FROM (SELECT DISTINCT h.q, h.s, k.place FROM h JOIN {n}k k ON k.id = h.{'q' if n == 'a' else 's'} AND (k.token = h.token OR starts_with(k.token, '**')))) GROUP BY q, s)"""


_BOTH = f"WITH {_prepared_sql('a', 'benchmark', 'item_id', False)},\n{_prepared_sql('b', 'documents', 'doc_id', True)}"
_SHARED = f"""{_BOTH}, {_side_sql('a')}, {_side_sql('b')},
h0 AS (SELECT a.id AS q, b.id AS s, token, b.first FROM af a JOIN bf b USING (token)),
n AS (SELECT q, s, count(*) AS n, string_agg(token, ' ' ORDER BY first) AS shared FROM h0 GROUP BY q, s HAVING count(*) >= 2),
h AS (SELECT h0.* FROM h0 JOIN n USING (q, s))"""
_FOUND = f"""{_SHARED}, {_gap_sql('a', 'b')}, {_gap_sql('b', 'a')},
d AS (SELECT q, s, n.n, shared FROM n JOIN ag USING (q, s) JOIN bg USING (q, s) WHERE ag.gap <= 3 AND bg.gap <= 3),
p AS (SELECT q, s, count(x.c0) AS x, count(y.c0) AS y,
  max(x.c0) - min(x.c0) = max(y.c0) - min(y.c0) AND max(x.c1) - min(x.c1) = max(y.c1) - min(y.c1) AND max(x.c2) - min(x.c2) = max(y.c2) - min(y.c2) AS same
  FROM h JOIN d USING (q, s) LEFT JOIN am x ON x.id = h.q AND x.token = h.token LEFT JOIN bm y ON y.id = h.s AND y.token = h.token GROUP BY q, s),
found AS (SELECT d.* FROM d JOIN p USING (q, s) WHERE n >= 3 OR x < 2 OR y < 2 OR same)"""


def _run_sql(out: str, side: str, other: str) -> str:
    """Longest run of side's words that the other text has."""
    return f"""
{out}k AS (SELECT DISTINCT x.id AS {side}, y.id AS {other}, x.k FROM (SELECT id, unnest(folded) AS token, unnest(range(len(folded))) AS k FROM {'a' if side == 'q' else 'b'}) x
  JOIN (SELECT DISTINCT id, unnest(folded) AS token FROM {'b' if side == 'q' else 'a'}) y USING (token)),
{out}i AS (SELECT q, s, k, k - row_number() OVER (PARTITION BY q, s ORDER BY k) AS island FROM {out}k),
{out} AS (SELECT q, s, max(n) AS n, arg_max(start, n * 1000000 - start) AS start FROM (SELECT q, s, count(*) AS n, min(k) AS start FROM {out}i GROUP BY q, s, island HAVING count(*) >= 4) GROUP BY q, s)"""


_RUNS = f"""{_run_sql('rs', 's', 'q')}, {_run_sql('rq', 'q', 's')}"""


@query(f"SELECT id AS item_id, text FROM {_assimilated_sql('benchmark', 'item_id')} UNION ALL SELECT id + 1000000000, text FROM {_assimilated_sql('documents', 'doc_id')}")
def assimilation(spark: SparkSession, d: str) -> DataFrame:
    items = _table(spark, d, "benchmark").select("item_id", "text")
    docs = _table(spark, d, "documents").select((F.col("doc_id") + 1000000000).alias("item_id"), "text")
    return items.union(docs).select("item_id", tx.assimilate(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_phrased_sql('text')} AS text FROM documents")
def phrasing_prose(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", tx.phrased(F.col("text"), poetry=False).alias("text"))


_POEM = "text || ' /'"


@query(f"SELECT doc_id, {_phrased_sql(_POEM)} AS text FROM documents")
def phrasing_poetry(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", tx.phrased(F.col("text"), poetry=True).alias("text"))


@query(f"WITH {_prepared_sql('b', 'documents', 'doc_id', True)} SELECT id AS doc_id, CAST(unnest(range(len(folded))) AS INT) AS k, unnest(folded) AS token FROM b")
def rule_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = rules.prepared(_docs(spark, d), "poetry", "source")
    return rows.select(F.col("source_id").cast("long").alias("doc_id"), F.posexplode("folded").alias("k", "token"))


_IDS = "CAST({q} AS VARCHAR) AS query_id, CAST({s} AS VARCHAR) AS source_id".format(q="q", s="s")


@query(f"{_SHARED} SELECT {_IDS}, shared, CAST(n AS INT) AS n FROM n")
def shared_words(spark: SparkSession, d: str) -> DataFrame:
    rows = rules.shared_words(_items(spark, d), _docs(spark, d))
    return rows.select("query_id", "source_id", F.array_join("shared", " ").alias("shared"), F.size("shared").alias("n"))


@query(f"{_FOUND} SELECT {_IDS}, shared, CAST(n AS INT) AS n FROM d")
def distance_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = rules.near(_items(spark, d), _docs(spark, d))
    return rows.select("query_id", "source_id", F.array_join("shared", " ").alias("shared"), F.size("shared").alias("n"))


@query(f"{_FOUND} SELECT {_IDS}, shared FROM found")
def rule_matches(spark: SparkSession, d: str) -> DataFrame:
    return rules.matches(_items(spark, d), _docs(spark, d)).withColumn("shared", F.array_join("shared", " "))


@query(f"{_BOTH}, {_RUNS} SELECT {_IDS}, array_to_string(folded[rs.start + 1 : rs.start + rs.n], ' ') AS shared FROM rs JOIN rq USING (q, s) JOIN b ON b.id = s")
def complura_runs(spark: SparkSession, d: str) -> DataFrame:
    return rules.complura(_items(spark, d), _docs(spark, d)).withColumn("shared", F.array_join("shared", " "))


_ALL = f"""{_FOUND}, {_RUNS},
u AS (SELECT q, s, 0 AS kind, n FROM found UNION ALL SELECT rs.q, rs.s, 1, rs.n FROM rs JOIN rq USING (q, s) ANTI JOIN found f ON f.q = rs.q AND f.s = rs.s),
r AS (SELECT q, s, CAST(row_number() OVER (PARTITION BY q ORDER BY kind, s) AS INT) AS rank, least(n / 5.0::DOUBLE, 1.0::DOUBLE)::DOUBLE AS candidate_score FROM u)"""


@query(f"{_ALL} SELECT {_IDS}, rank, candidate_score FROM r")
def rule_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rules.rule_based(_items(spark, d), _docs(spark, d))


@query(f"{_ALL} SELECT {_IDS}, rank, candidate_score FROM r WHERE rank <= 10")
def rule_candidates_topk(spark: SparkSession, d: str) -> DataFrame:
    return rules.rule_based(_items(spark, d), _docs(spark, d), top_k=10)


@query(f"""{_ALL}
SELECT CAST(x.item_id AS VARCHAR) AS query_id, x.text AS query_text, coalesce(CAST(s AS VARCHAR), '') AS source_id, coalesce(y.text, '') AS source_text,
  coalesce(printf('%.6f', candidate_score), '') AS similarity, CASE WHEN s IS NULL THEN '' ELSE '1.000000' END AS probability, CASE WHEN s IS NULL THEN '' ELSE 'Yes' END AS above_threshold
FROM benchmark x LEFT JOIN r f ON f.q = x.item_id LEFT JOIN documents y ON y.doc_id = f.s""")
def match_report(spark: SparkSession, d: str) -> DataFrame:
    q, s = _items(spark, d), _docs(spark, d)
    found = rules.rule_lists(q, s).withColumn("found", F.transform("found", lambda x: x.withField("judgment_score", F.lit(1.0))))
    return sinks.report_by_source(found, q, s, 0.85)


@query(f"{_ALL} SELECT CAST(x.item_id AS VARCHAR) AS query_id, CAST(count(s) FILTER (candidate_score >= 0.85) AS BIGINT) AS finds FROM benchmark x LEFT JOIN r ON r.q = x.item_id GROUP BY x.item_id")
def find_counts(spark: SparkSession, d: str) -> DataFrame:
    q, s = _items(spark, d), _docs(spark, d)
    return sinks.find_counts(rules.rule_based(q, s).withColumn("judgment_score", F.col("candidate_score")), q, 0.85)


# --- other generators and judges --------------------------------------------------------------------------------------


@query("""SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS source_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS INT) AS rank, 1.0::DOUBLE AS candidate_score FROM benchmark, documents""")
def exhaustive_pairs(spark: SparkSession, d: str) -> DataFrame:
    return generators.exhaustive(_items(spark, d), _docs(spark, d))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "embeddings").where("vec_id is not null")
    return src.of_table(t.withColumn("text", F.col("label").cast("string")), "vec_id", "text", "embedding")


_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"
_NEAR = f"""WITH v AS (SELECT vec_id, label, {_UNIT} AS e FROM embeddings),
p AS (SELECT a.vec_id AS q, b.vec_id AS s, round(list_dot_product(a.e, b.e), 6) AS score FROM v a, v b),
k AS (SELECT q, s, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, s) AS rank FROM p),
t AS (SELECT CAST(q AS VARCHAR) AS query_id, CAST(s AS VARCHAR) AS source_id, CAST(rank AS INT) AS rank, score AS candidate_score FROM k WHERE rank <= 10)"""


def _nearest(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    v = _vectors(spark, d)
    return generators.embedding(v, v, top_k=k, digits=6)


@query(f"{_NEAR} SELECT * FROM t")
def embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d)


@query(f"{_NEAR} SELECT *, 1.0::DOUBLE AS judgment_score FROM t")
def judge_identity(spark: SparkSession, d: str) -> DataFrame:
    return judges.identity(_nearest(spark, d))


@query(f"{_NEAR} SELECT *, CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS judgment_score FROM t")
def judge_topk(spark: SparkSession, d: str) -> DataFrame:
    return judges.threshold(_nearest(spark, d), top_k=3)


@query(f"{_NEAR} SELECT *, CASE WHEN candidate_score >= 0.6 THEN 1.0 ELSE 0.0 END::DOUBLE AS judgment_score FROM t")
def judge_threshold(spark: SparkSession, d: str) -> DataFrame:
    return judges.threshold(_nearest(spark, d), similarity_threshold=0.6)


_HEX = "[" + ", ".join(f"strpos('0123456789abcdef', substr(md5(word), {i}, 1)) - 8.5::DOUBLE" for i in range(1, 9)) + "]"


def hash_vectors(words: DataFrame) -> DataFrame:
    """(word, vector): made-up vectors from md5, so that SQL has the same."""
    return words.select("word").distinct().select("word", F.array(*[F.conv(F.substring(F.md5(F.col("word").cast("binary")), i, 1), 16, 10).cast("double") - 7.5 for i in range(1, 9)]).alias("vector"))


_COS = "greatest(0, least(1, (list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b})) + 1) / 2))"
_GRAMS = f"""WITH t AS (SELECT item_id AS id, list_filter(string_split({_LATIN}, ' '), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w)), lambda i: struct_pack(a := w[i], b := w[i + 1]))) AS g FROM t)"""


@query(f"{_GRAMS} SELECT CAST(id AS VARCHAR) AS seg_id, g.a AS a, g.b AS b FROM g")
def bigram_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("seg_id", F.explode(generators.bigrams(tx.latin_tokens(F.col("text")))).alias("g")).select("seg_id", "g.a", "g.b")


@query()
def bigram_topk(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: all bigrams of the items against all of the documents are too many for it."""
    q, s = _items(spark, d), _docs(spark, d)
    words = q.select("text").union(s.select("text")).select(F.explode(tx.latin_tokens(F.col("text"))).alias("word"))
    return generators.bigram(q, s, hash_vectors(words), top_k=10, digits=6)


_CONTENT = f"list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda t: length(t) >= 2 AND lower(t) NOT IN ({', '.join(repr(w) for w in sorted(CONTEXTUAL))}))"


@query(f"""WITH a AS (SELECT DISTINCT item_id AS id, lower(unnest({_CONTENT})) AS word FROM benchmark), b AS (SELECT DISTINCT doc_id AS id, lower(unnest({_CONTENT})) AS word FROM documents),
v AS (SELECT word, {_HEX} AS v FROM (SELECT word FROM a UNION SELECT word FROM b)),
m AS (SELECT x.word AS x, y.word AS y, {_COS.format(a='x.v', b='y.v')} AS sim FROM (SELECT DISTINCT word FROM a) p JOIN v x USING (word), (SELECT DISTINCT word FROM b) r JOIN v y USING (word)),
w AS (SELECT a.id AS q, y, max(sim) AS sim FROM a JOIN m ON m.x = a.word GROUP BY a.id, y),
r AS (SELECT q, b.id AS s, max(sim) AS sim FROM w JOIN b ON b.word = w.y GROUP BY q, b.id),
p AS (SELECT item_id AS q, doc_id AS s, round(coalesce(sim, 0.5), 6) AS score FROM (SELECT item_id, doc_id FROM benchmark, documents) LEFT JOIN r ON r.q = item_id AND r.s = doc_id)
SELECT CAST(q AS VARCHAR) AS query_id, CAST(s AS VARCHAR) AS source_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, s) AS INT) AS rank, score AS candidate_score FROM p QUALIFY rank <= 10""")
def contextual_topk(spark: SparkSession, d: str) -> DataFrame:
    q, s = _items(spark, d), _docs(spark, d)

    def vectors(segments: DataFrame) -> DataFrame:
        words = segments.select("seg_id", F.explode(generators.content_words(F.col("text"))).alias("word")).withColumn("word", F.lower("word")).distinct()
        return words.join(hash_vectors(words), "word").select("seg_id", "vector")

    return generators.contextual(vectors(q), vectors(s), q, s, top_k=10, digits=6)


# --- evaluation -------------------------------------------------------------------------------------------------------


def _gold(spark: SparkSession, d: str) -> ev.Classes:
    return ev.Classes(_table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("seg_id"), "label").where("seg_id is not null"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors, judged by their similarity."""
    return _nearest(spark, d).withColumn("judgment_score", F.col("candidate_score"))


_GRID = f"""{_NEAR}, n AS (SELECT count(*) AS n FROM embeddings), lab AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS size FROM embeddings)"""


def _cells_sql(hit: str, key: str = "", keys: str = "") -> str:
    k = f"{key}, " if key else ""
    return f"""c AS (SELECT {k}l.vec_id AS q, count(k.s) FILTER ({hit} AND m.label = l.label) AS tp, count(k.s) FILTER ({hit} AND m.label <> l.label) AS fp, any_value(l.size) AS gold
  FROM {keys} lab l LEFT JOIN (SELECT * FROM k WHERE rank <= 10) k ON k.q = l.vec_id LEFT JOIN lab m ON m.vec_id = k.s GROUP BY ALL),
x AS (SELECT {k}q, tp, fp, gold - tp AS fn, n - fp - gold AS tn, n FROM c, n),
y AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall FROM x),
z AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, (tp + tn)::DOUBLE / n AS accuracy, fp::DOUBLE / n AS fpr, fn::DOUBLE / n AS fnr, (fp + fn)::DOUBLE / n AS smr FROM y)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if c in ev.RATES else F.col(c) for c in df.columns])


_R9 = ", ".join(f"round({c}, 9)::DOUBLE AS {c}" for c in ev.RATES)
_C = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ev.CELLS)
_SUMC = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ev.CELLS)


def _micro_sql(key: str = "") -> str:
    k = f"{key}, " if key else ""
    return f"""s AS (SELECT {k}{_SUMC} FROM x GROUP BY ALL), o AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall, tp + fp + fn + tn AS total FROM s),
e AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, (tp + tn)::DOUBLE / total AS accuracy, fp::DOUBLE / total AS fpr, fn::DOUBLE / total AS fnr, (fp + fn)::DOUBLE / total AS smr FROM o)"""


def _scores(spark: SparkSession, d: str) -> tuple[DataFrame, ev.Gold, DataFrame]:
    v = _vectors(spark, d)
    gold = _gold(spark, d)
    return ev.per_query(ev.links(_judged(spark, d), 0.5), gold, v, v), gold, v


@query(f"{_GRID}, {_cells_sql('k.score >= 0.5')} SELECT CAST(q AS VARCHAR) AS query_id, {_R9}, CAST(fp + fn AS BIGINT) AS errors, {_C} FROM z")
def evaluate_queries(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scores(spark, d)[0])


@query("SELECT CAST(vec_id AS VARCHAR) AS query_id FROM embeddings")
def queries_with_match(spark: SparkSession, d: str) -> DataFrame:
    return ev.queries_with_match(_gold(spark, d))


@query(f"{_GRID}, {_cells_sql('k.score >= 0.5')} SELECT CAST(q AS VARCHAR) AS query_id, tp || ',' || fp || ';' || fn || ',' || tn AS matrix FROM z")
def confusion_matrices(spark: SparkSession, d: str) -> DataFrame:
    m = ev.confusion_matrix(_scores(spark, d)[0])
    return m.select("query_id", F.array_join(F.transform("matrix", lambda r: F.array_join(r.cast("array<string>"), ",")), ";").alias("matrix"))


_MEANS = ", ".join(f"round(avg({c}), 9)::DOUBLE AS {c}" for c in ev.RATES)


@query(f"{_GRID}, {_cells_sql('k.score >= 0.5')} SELECT {_MEANS}, {_SUMC} FROM z")
def evaluate_macro(spark: SparkSession, d: str) -> DataFrame:
    rows, gold, _ = _scores(spark, d)
    return _rounded(ev.averaged(rows, gold, "macro"))


@query(f"{_GRID}, {_cells_sql('k.score >= 0.5')}, {_micro_sql()} SELECT {_R9}, {_C} FROM e")
def evaluate_micro(spark: SparkSession, d: str) -> DataFrame:
    rows, gold, _ = _scores(spark, d)
    return _rounded(ev.averaged(rows, gold, "micro"))


_SWEPT = _cells_sql("k.score >= threshold", "threshold", "(SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in ev.THRESHOLDS) + "]) AS threshold) h,")


@query(f"{_GRID}, {_SWEPT}, {_micro_sql('threshold')} SELECT threshold, {_R9}, {_C} FROM e")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return _rounded(ev.threshold_sweep(_judged(spark, d), _gold(spark, d), v, v))


@query(f"{_GRID}, {_SWEPT}, {_micro_sql('threshold')} SELECT threshold, {_R9}, {_C} FROM e ORDER BY e.f1 DESC, threshold LIMIT 1")
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return _rounded(ev.best_threshold(ev.threshold_sweep(_judged(spark, d), _gold(spark, d), v, v), "f1"))


@query(f"{_GRID}, {_cells_sql('k.score >= 0.5 AND k.rank <= h.k', 'h.k', '(SELECT unnest([1, 2, 3, 5, 10])::INT AS k) h,').replace('SELECT h.k, l.vec_id', 'SELECT h.k AS k, l.vec_id').replace('SELECT h.k, q', 'SELECT k, q')}, {_micro_sql('k')} SELECT k, {_R9}, {_C} FROM e")
def k_sweep(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return _rounded(ev.k_sweep(_judged(spark, d), _gold(spark, d), v, v, 0.5, top_k=10))


# --- models: no SQL ---------------------------------------------------------------------------------------------------


@query()
def embedding_lsh(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return generators.embedding_lsh(v, v, top_k=10)


@query()
def word_vectors(spark: SparkSession, d: str) -> DataFrame:
    trainer = models.WordVectorTrainer(vector_size=64, epochs=2).fit(_table(spark, d, "documents"))
    return trainer.vectors()


@query()
def classified_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the rules, judged by a classifier fitted on whether the rules gave them full score."""
    q, s = _items(spark, d), _docs(spark, d)
    found = rules.rule_based(q, s)
    gold = found.select("query_id", "source_id", (F.col("candidate_score") >= 1).cast("int").alias("label"))
    return models.judge_pairs(found, q, s, models.fit_pair_classifier(gold, q, s))
