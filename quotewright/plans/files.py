"""Queries that go through files, stored documents and ready pipelines, and SQL that says the same.

Tables are written to the shared folder in the format that is to be read, by ranges of their key, so that files in order of
name hold rows in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.functions import text as tx
from quotewright.operators import judges, segments
from quotewright.plans import pipeline as pl
from quotewright.plans.catalog import _ALL, _CLEAN, _IDS, _NEAR, _docs, _items, _table, _vectors, query
from quotewright.sources import segments as src
from quotewright.sources import sinks
from quotewright.sources.storage import scratch

#: Files of a table that is written to be read again, at least, and bytes of text in one, as a file is written and read by one task.
FILES, FILE_BYTES = 4, 64 << 20
_ITEM_ROWS = "CAST(item_id AS VARCHAR) AS seg_id, text, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INT) AS row_id FROM benchmark"


def _files(texts: DataFrame) -> int:
    """Files for a table with ``text``."""
    return max(FILES, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES))


def _as_csv(df: DataFrame, order: str, name: str, suffix: str = "", files: int = FILES) -> str:
    path = scratch(df.sparkSession, name) + suffix
    rows = df.repartitionByRange(files, order).sortWithinPartitions(order)
    rows.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    return path


# --- sources ----------------------------------------------------------------------------------------------------------


@query("SELECT CAST(doc_id AS VARCHAR) AS seg_id, text, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INT) AS row_id FROM documents")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return src.read_csv(spark, _as_csv(docs.select("seg_id", "text", "pos"), "pos", "documents", files=_files(docs))).select("seg_id", "text", "row_id")


@query(f"SELECT {_ITEM_ROWS}")
def tsv_scan(spark: SparkSession, d: str) -> DataFrame:
    return src.read_document(spark, _as_csv(_items(spark, d).select("seg_id", "text", "pos"), "pos", "items", ".tsv")).select("seg_id", "text", "row_id")


@query(f"SELECT CAST(k AS VARCHAR) AS seg_id, text, k AS row_id FROM (SELECT {_CLEAN} AS text, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INT) AS k FROM documents) WHERE text <> ''")
def plain_scan(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "lines")
    docs = _table(spark, d, "documents")
    lines = docs.select("doc_id", tx.clean(F.col("text")).alias("value"))
    lines.repartitionByRange(_files(docs), "doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    return src.read_document(spark, path).select("seg_id", "text", "row_id")


@query("SELECT '' AS seg_id, '' AS text FROM benchmark WHERE false")
def missing_source(spark: SparkSession, d: str) -> DataFrame:
    return src.read_csv(spark, scratch(spark, "nothing")).select("seg_id", "text")


@query(f"SELECT {_ITEM_ROWS}")
def pandas_source(spark: SparkSession, d: str) -> DataFrame:
    return src.from_pandas(spark, sinks.to_pandas(_items(spark, d))[["seg_id", "text"]]).select("seg_id", "text", "row_id")


@query(f"SELECT seg_id, text, row_id, 'a name' AS author, 'Latin' AS language, 'item' AS kind FROM (SELECT {_ITEM_ROWS})")
def dict_source(spark: SparkSession, d: str) -> DataFrame:
    """Through a stored document, with what it says of itself and of its segments."""
    items = _items(spark, d).withColumn("meta", F.create_map(F.lit("kind"), F.lit("item")))
    stored = sinks.to_dict(items, author="another name", meta={"language": "Latin"})
    rows, about = src.from_dict(spark, stored, author="a name")
    return rows.select("seg_id", "text", "row_id", F.lit(about["author"]).alias("author"), F.lit(about["meta"]["language"]).alias("language"), F.col("meta")["kind"].alias("kind"))


@query("SELECT CAST(doc_id AS VARCHAR) AS seg_id, text, doc_id AS pos FROM documents UNION ALL SELECT 'new', 'one more', max(doc_id) + 1 FROM documents")
def added_segment(spark: SparkSession, d: str) -> DataFrame:
    return src.add_segment(_docs(spark, d), "one more", "new").select("seg_id", "text", "pos")


@query("SELECT CAST(doc_id AS VARCHAR) AS seg_id, text FROM documents WHERE doc_id <> 7")
def removed_segment(spark: SparkSession, d: str) -> DataFrame:
    return src.remove_segment(_docs(spark, d), "7").select("seg_id", "text")


@query("SELECT CAST(doc_id AS VARCHAR) AS seg_id FROM documents")
def segment_ids(spark: SparkSession, d: str) -> DataFrame:
    return segments.ids(_docs(spark, d))


@query("SELECT CAST(item_id AS VARCHAR) AS seg_id, text FROM benchmark WHERE item_id = (SELECT max(item_id) FROM benchmark)")
def segment_text(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    last = str(items.agg(F.max("pos")).first()[0])
    return spark.createDataFrame([(last, segments.get_text(items, last))], "seg_id string, text string")


@query("SELECT CAST(doc_id AS VARCHAR) AS query_id, 'good' AS source_id, CAST(toxic AS INT) AS label FROM labels")
def gold_scan(spark: SparkSession, d: str) -> DataFrame:
    """Of two labels of a pair, in different files, the later one."""
    t = _table(spark, d, "labels")
    pair = lambda c, k: t.select(F.lit(k).alias("k"), F.col("doc_id").alias("query_id"), F.lit("good").alias("source_id"), F.col(c).alias("label"))
    path = scratch(spark, "gold")
    pair("quality", 0).union(pair("toxic", 1)).repartitionByRange(2, "k").drop("k").write.csv(path, header=True)
    return src.read_gold(spark, path)


@query("SELECT DISTINCT word FROM (SELECT unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS word FROM benchmark) WHERE word <> ''")
def stopword_scan(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "stopwords")
    words = _table(spark, d, "benchmark").select(F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ")).alias("w")).where("w <> ''")
    words.groupBy("w").count().select(F.concat(F.lit(" "), F.initcap("w"), F.lit(" \t"), "count").alias("value")).write.text(path)
    return spark.createDataFrame([(w,) for w in sorted(src.read_stopwords(spark, path))], "word string")


@query("SELECT 'segments' AS file, true AS valid, 'valid' AS message UNION ALL SELECT 'more columns', false, 'columns must be seg_id and text, not seg_id, text, pos' UNION ALL SELECT 'empty', false, 'has no rows'")
def csv_validation(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d).select("seg_id", "text", "pos")
    two = items.select("seg_id", "text")
    files = {"segments": _as_csv(two, "seg_id", "valid"), "more columns": _as_csv(items, "pos", "more"), "empty": _as_csv(two.limit(0), "seg_id", "empty", files=1)}
    return spark.createDataFrame([(k, *src.validate_csv(spark, p)) for k, p in files.items()], "file string, valid boolean, message string")


@query("SELECT CAST(item_id AS VARCHAR) AS seg_id, text FROM benchmark ORDER BY item_id LIMIT 3")
def csv_preview(spark: SparkSession, d: str) -> DataFrame:
    return src.preview_csv(spark, _as_csv(_items(spark, d).select("seg_id", "text", "pos"), "pos", "preview", files=1), 3).select("seg_id", "text")


# --- sinks, through a pipeline ----------------------------------------------------------------------------------------


def _retrieved(spark: SparkSession, d: str, digits: int = 6) -> tuple[pl.Pipeline, DataFrame, DataFrame]:
    """(pipeline that has run, its judgments, segments)."""
    v = _vectors(spark, d)
    p = pl.retrieval()
    return p, p.run(v, v, top_k=10, similarity_threshold=0.6, digits=digits), v


_JUDGED = f"""{_NEAR}, j AS (SELECT q, s, rank, score, CASE WHEN score >= 0.6 THEN 1.0 ELSE 0.0 END::DOUBLE AS judgment FROM k WHERE rank <= 10),
r AS (SELECT j.*, CAST(label AS VARCHAR) AS text FROM j JOIN v ON v.vec_id = j.s)"""
_RESULT = f"{_IDS}, text AS source_text, score AS candidate_score, judgment AS judgment_score"


@query(f"{_JUDGED} SELECT {_IDS}, CAST(rank AS INT) AS rank, score AS candidate_score, judgment AS judgment_score FROM r")
def pipeline_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return _retrieved(spark, d)[1]


@query(f"{_JUDGED} SELECT {_RESULT} FROM r")
def results_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "results") + ".csv"
    _retrieved(spark, d)[0].to_csv(path)
    return spark.read.schema("query_id string, source_id string, source_text string, candidate_score double, judgment_score double").csv(path, header=True, multiLine=True, escape='"')


@query(f"{_JUDGED} SELECT {_RESULT}, CAST(rank AS INT) AS place FROM r")
def results_json(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "results") + ".json"
    _retrieved(spark, d)[0].to_json(path)
    kind = "map<string,array<struct<source_id:string,source_text:string,candidate_score:double,judgment_score:double>>>"
    lists = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("query_id", "matches"))
    return lists.select("query_id", F.posexplode("matches").alias("k", "m")).select("query_id", "m.*", (F.col("k") + 1).cast("int").alias("place"))


@query(f"""{_JUDGED} SELECT CAST(q AS VARCHAR) AS query_id, CAST(a.label AS VARCHAR) AS query_text, CAST(s AS VARCHAR) AS source_id, text AS source_text, printf('%.6f', score) AS similarity,
  printf('%.6f', judgment) AS probability, CASE WHEN judgment >= 0.85 THEN 'Yes' ELSE 'No' END AS above_threshold FROM r JOIN v a ON a.vec_id = q""")
def report_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "report") + ".csv"
    _, judged, v = _retrieved(spark, d)
    sinks.report_to_csv(judged, v, v, 0.85, path)
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


_THREE = _JUDGED.replace("b.e), 6)", "b.e), 3)")


@query(f"""{_THREE} SELECT CAST(q AS VARCHAR) AS Query_Segment_ID, CAST(a.label AS VARCHAR) AS Query_Text, CAST(s AS VARCHAR) AS Source_Segment_ID, text AS Source_Text, printf('%.3f', score) AS Similarity,
  printf('%.3f', judgment) AS Probability, CASE WHEN judgment >= 0.85 THEN 'Yes' ELSE 'No' END AS Above_Threshold FROM r JOIN v a ON a.vec_id = q""")
def display_rows(spark: SparkSession, d: str) -> DataFrame:
    _, judged, v = _retrieved(spark, d, digits=3)
    return sinks.display_export(judged, v, v, 0.85)


@query(f"{_THREE}, l AS (SELECT q, s, printf('  %-25s  candidate=%+.3f  judgment=%.3f', CAST(s AS VARCHAR), score, judgment) AS line FROM r) SELECT line, count(*)::BIGINT AS n FROM (SELECT line FROM l UNION ALL SELECT DISTINCT q || ':' FROM l) GROUP BY line")
def console_lines(spark: SparkSession, d: str) -> DataFrame:
    _, judged, v = _retrieved(spark, d, digits=3)
    lines = sinks.console(judged, v, v).split("\n")
    return spark.createDataFrame([(x,) for x in lines], "line string").groupBy("line").agg(F.count("*").alias("n"))


@query(f"SELECT CAST(k AS VARCHAR) AS seg_id, text FROM (SELECT {_CLEAN} AS text, row_number() OVER (ORDER BY item_id) - 1 AS k FROM benchmark) WHERE text <> ''")
def segments_plain(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "segments") + ".txt"
    sinks.save_plain(segments.clean(_items(spark, d), drop_empty=False), path, delimiter="\n--\n")
    return src.read_plain(spark, path, "\n--\n").select("seg_id", "text")


@query("SELECT CAST(doc_id AS VARCHAR) AS seg_id, text, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INT) AS row_id FROM documents")
def segments_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "segments") + ".csv"
    docs = _docs(spark, d)
    sinks.save_csv(docs, path, files=_files(docs))
    return src.read_document(spark, path).select("seg_id", "text", "row_id")


# --- ready pipelines --------------------------------------------------------------------------------------------------


def _same_text(a: Column, b: Column) -> Column:
    return F.when(a == b, 0.9).otherwise(0.1)


def _alike_length(a: Column, b: Column) -> Column:
    return F.round(F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1)), 6)


@query(f"{_JUDGED} SELECT {_IDS}, CAST(rank AS INT) AS rank, score AS candidate_score, CASE WHEN a.label = b.label THEN 0.9 ELSE 0.1 END::DOUBLE AS judgment_score FROM r JOIN v a ON a.vec_id = q JOIN v b ON b.vec_id = s")
def pipeline_two_stage(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return pl.two_stage(_same_text).run(v, v, top_k=10, digits=6)


@query("""SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS source_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS INT) AS rank, 1.0::DOUBLE AS candidate_score,
  round(least(length(a.text), length(b.text))::DOUBLE / greatest(length(a.text), length(b.text), 1), 6) AS judgment_score FROM benchmark a, documents b""")
def pipeline_exhaustive(spark: SparkSession, d: str) -> DataFrame:
    return pl.exhaustive(_alike_length).run(_items(spark, d), _docs(spark, d))


@query(f"{_ALL} SELECT {_IDS}, rank, candidate_score, 1.0::DOUBLE AS judgment_score FROM r")
def pipeline_rules(spark: SparkSession, d: str) -> DataFrame:
    return pl.rule_based().run(_items(spark, d), _docs(spark, d))


@query(f"{_JUDGED} SELECT {_IDS}, CAST(rank AS INT) AS rank, score AS candidate_score, CASE WHEN a.label = b.label THEN 0.9 ELSE 0.1 END::DOUBLE AS judgment_score FROM r JOIN v a ON a.vec_id = q JOIN v b ON b.vec_id = s")
def judge_classification(spark: SparkSession, d: str) -> DataFrame:
    _, judged, v = _retrieved(spark, d)
    return judges.classification(judged.drop("judgment_score"), v, v, _same_text)
