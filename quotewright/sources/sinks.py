"""Result sinks: CSV, JSON, reports, and segment files.

Results are rows (query_id, source_id, rank, candidate_score, judgment_score).  Files are written by Spark; where a
single file is asked for, the one part is moved to its name."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotewright.operators.segments import ordered


def _fs(df: DataFrame, path: str):
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), p


def _single(df: DataFrame, path: str, kind: str, **options) -> None:
    """Writes ``df``, in its order, as one file at ``path``; folders above are made."""
    tmp = f"{path}.{uuid.uuid4().hex}"
    if kind == "csv":
        options |= {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.coalesce(1).write.options(**options).format(kind).save(tmp)
    fs, folder = _fs(df, tmp)
    _, target = _fs(df, path)
    part = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    fs.delete(target, False)
    if target.getParent() is not None:
        fs.mkdirs(target.getParent())
    fs.rename(part, target)
    fs.delete(folder, True)


def result_rows(judged: DataFrame, query: DataFrame, source: DataFrame) -> DataFrame:
    """query_id, source_id, source_text, candidate_score, judgment_score, in the order of queries and ranks."""
    q = query.select(F.col("seg_id").alias("query_id"), F.coalesce("row_id", F.lit(0)).alias("_r"), F.col("pos").alias("_p"))
    s = source.select(F.col("seg_id").alias("source_id"), F.col("text").alias("source_text"))
    rows = judged.join(q, "query_id").join(s, "source_id", "left").orderBy("_r", "_p", "rank")
    return rows.select("query_id", "source_id", "source_text", "candidate_score", "judgment_score")


def results_to_csv(judged: DataFrame, query: DataFrame, source: DataFrame, path: str) -> None:
    _single(result_rows(judged, query, source), path, "csv", header=True, escape='"', emptyValue="", nullValue="")


def result_lists(judged: DataFrame, query: DataFrame, source: DataFrame) -> DataFrame:
    """(query_id, matches): every query, those without matches too, with its matches by rank."""
    s = source.select(F.col("seg_id").alias("source_id"), F.col("text").alias("source_text"))
    match = F.struct("rank", "source_id", "source_text", "candidate_score", "judgment_score")
    lists = judged.join(s, "source_id", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(match)).alias("matches"))
    rows = query.select(F.col("seg_id").alias("query_id"), "row_id", "pos").join(lists, "query_id", "left")
    short = F.transform("matches", lambda m: F.struct(m["source_id"].alias("source_id"), m["source_text"].alias("source_text"), m["candidate_score"].alias("candidate_score"), m["judgment_score"].alias("judgment_score")))
    return rows.orderBy(F.coalesce("row_id", F.lit(0)), "pos").select("query_id", F.coalesce(short, F.array()).alias("matches"))


def results_to_json(judged: DataFrame, query: DataFrame, source: DataFrame, path: str, *, indent: int | None = 2) -> None:
    """One JSON object of all queries.  It is put together by the driver, a query at a time; use :func:`result_lists`
    and ``write.json`` for results of any size."""
    fs, target = _fs(query, path)
    stream = fs.create(target, True)
    parts = 0
    stream.write(b"{")
    for r in result_lists(judged, query, source).toLocalIterator():
        value = json.dumps([m.asDict() for m in r["matches"]], ensure_ascii=False, indent=indent)
        pad = " " * indent if indent else ""
        value = value.replace("\n", "\n" + pad)
        stream.write(((",\n" if parts else "\n") + pad + json.dumps(r["query_id"], ensure_ascii=False) + ": " + value).encode())
        parts += 1
    stream.write(b"\n}" if parts else b"}")
    stream.close()


def _reported(rows: DataFrame, threshold: float) -> DataFrame:
    number = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.6f", F.col(c))), F.lit(""))
    flag = F.when(F.col("judgment_score").isNull(), "").when(F.col("judgment_score") >= threshold, "Yes").otherwise("No")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("query_id", "query_text", empty("source_id").alias("source_id"), empty("source_text").alias("source_text"), number("candidate_score").alias("similarity"), number("judgment_score").alias("probability"), flag.alias("above_threshold"))


def report(judged: DataFrame, query: DataFrame, source: DataFrame, threshold: float) -> DataFrame:
    """All queries with their matches; a query without any has empty fields.  Scores have six decimals."""
    q = query.select(F.col("seg_id").alias("query_id"), F.col("text").alias("query_text"), F.coalesce("row_id", F.lit(0)).alias("_r"), F.col("pos").alias("_p"))
    s = source.select(F.col("seg_id").alias("source_id"), F.col("text").alias("source_text"))
    return _reported(q.join(judged.join(s, "source_id", "left"), "query_id", "left").orderBy("_r", "_p", "rank"), threshold)


def report_by_source(found: DataFrame, query: DataFrame, source: DataFrame, threshold: float) -> DataFrame:
    """The rows of :func:`report` in no order, of matches by source: (source_id, found), found being structs of query_id, candidate_score and
    judgment_score.  A source's text moves once, and is repeated for its matches where it is."""
    q = query.select(F.col("seg_id").alias("query_id"), F.col("text").alias("query_text"))
    s = source.select(F.col("seg_id").alias("source_id"), F.col("text").alias("source_text"))
    rows = found.join(s, "source_id", "left").select("source_id", "source_text", F.explode("found").alias("f")).select("source_id", "source_text", "f.*")
    none = q.join(found.select(F.explode("found.query_id").alias("query_id")).distinct(), "query_id", "left_anti")
    return _reported(rows.join(q, "query_id").select("query_id", "query_text", "source_id", "source_text", "candidate_score", "judgment_score").unionByName(none, allowMissingColumns=True), threshold)


def report_to_csv(judged: DataFrame, query: DataFrame, source: DataFrame, threshold: float, path: str) -> None:
    _single(report(judged, query, source, threshold), path, "csv", header=True, escape='"', emptyValue="")


def display_export(judged: DataFrame, query: DataFrame, source: DataFrame, threshold: float) -> DataFrame:
    """The report as shown on screen: matches by judgment, three decimals, a missing candidate score as 0."""
    best = judged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("judgment_score"), "rank"))).withColumn("candidate_score", F.coalesce("candidate_score", F.lit(0.0)))
    r = report(best, query, source, threshold)
    names = ("Query_Segment_ID", "Query_Text", "Source_Segment_ID", "Source_Text", "Similarity", "Probability", "Above_Threshold")
    three = lambda c: F.when(F.col(c) == "", "").otherwise(F.format_string("%.3f", F.col(c).cast("double")))
    return r.withColumn("similarity", three("similarity")).withColumn("probability", three("probability")).toDF(*names)


def find_counts(judged: DataFrame, query: DataFrame, threshold: float) -> DataFrame:
    """(query_id, finds): matches of each query that reach the threshold."""
    n = judged.groupBy("query_id").agg(F.count_if(F.col("judgment_score") >= threshold).alias("finds"))
    return query.select(F.col("seg_id").alias("query_id")).join(n, "query_id", "left").select("query_id", F.coalesce("finds", F.lit(0)).cast("long").alias("finds"))


def console(judged: DataFrame, query: DataFrame, source: DataFrame) -> str:
    """Results as lines of text."""
    line = F.format_string("  %-25s  candidate=%s  judgment=%.3f", F.col("source_id"), F.coalesce(F.format_string("%+.3f", "candidate_score"), F.lit("N/A")), F.col("judgment_score"))
    line = F.when(F.col("candidate_score").isNull(), F.format_string("  %-25s  candidate=N/A  judgment=%.3f", F.col("source_id"), F.col("judgment_score"))).otherwise(line)
    out, last = [], None
    for q, text in result_rows(judged, query, source).select("query_id", line).toLocalIterator():
        if q != last:
            out.append(f"{q}:")
            last = q
        out.append(text)
    return "\n".join(out)


def save_plain(segments: DataFrame, path: str, *, delimiter: str = "\n") -> None:
    """Texts in document order, joined: one file, written segment by segment."""
    fs, target = _fs(segments, path)
    stream = fs.create(target, True)
    for n, r in enumerate(ordered(segments).select("text").toLocalIterator()):
        stream.write(((delimiter if n else "") + (r["text"] or "")).encode())
    stream.close()


def save_csv(segments: DataFrame, path: str, *, files: int = 1) -> None:
    """Segments in document order as one file, or as a folder of several whose names are in order: one file is written and read by one task."""
    if files == 1:
        return _single(ordered(segments).select("seg_id", "text"), path, "csv", header=True, escape='"', emptyValue="")
    rows = segments.select("seg_id", "text", F.coalesce("row_id", F.lit(0)).alias("_r"), F.col("pos").alias("_p"))
    rows = rows.repartitionByRange(files, "_r", "_p").sortWithinPartitions("_r", "_p").select("seg_id", "text")
    rows.write.csv(path, mode="overwrite", header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def to_pandas(segments: DataFrame) -> pd.DataFrame:
    return ordered(segments).select("seg_id", "text", "row_id", "meta").toPandas()


def to_dict(segments: DataFrame, *, path: str | None = None, author: str | None = None, meta: dict | None = None) -> dict:
    rows = ordered(segments).select("seg_id", "text", "row_id", "meta").collect()
    return {"path": path, "author": author, "meta": dict(meta or {}), "segments": [r.asDict() for r in rows]}
