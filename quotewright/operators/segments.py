"""Operations on segment tables: order, lookup, statistics, cleaning, sentences."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotewright.functions import text as tx


def ordered(segments: DataFrame) -> DataFrame:
    """In document order."""
    return segments.orderBy(F.coalesce("row_id", F.lit(0)), "pos")


def ids(segments: DataFrame) -> DataFrame:
    return ordered(segments).select("seg_id")


def get_text(segments: DataFrame, seg_id: str) -> str:
    """Text of a segment; KeyError if there is none of that id."""
    row = segments.where(F.col("seg_id") == str(seg_id)).select("text").first()
    if row is None:
        raise KeyError(seg_id)
    return row[0]


def head(segments: DataFrame, n: int = 5) -> DataFrame:
    """The first segments; none if ``n`` isn't positive."""
    return ordered(segments).limit(max(0, n))


def statistics(segments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and lengths, of all or by the given columns; all 0 where there is no segment."""
    n, chars, words = F.count("*"), F.length("text"), tx.word_count(F.col("text"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    mean = lambda c: F.coalesce(F.round(F.avg(c), 2), F.lit(0.0))
    aggs = [n.alias("num_segments"), zero(F.sum(chars)).alias("total_chars"), zero(F.sum(words)).alias("total_words"), mean(chars).alias("avg_chars"), mean(words).alias("avg_words"), zero(F.min(chars)).alias("min_chars"), zero(F.max(chars)).alias("max_chars")]
    return segments.groupBy(*by).agg(*aggs) if by else segments.agg(*aggs)


def statistics_dict(segments: DataFrame) -> dict[str, Any]:
    """The same for a whole document, averages rounded as Python does."""
    s = statistics(segments).first().asDict()
    for k in ("chars", "words"):
        s[f"avg_{k}"] = round(s[f"total_{k}"] / s["num_segments"], 2) if s["num_segments"] else 0.0
    return s


def clean(segments: DataFrame, *, drop_empty: bool = True, **steps: bool) -> DataFrame:
    """Texts cleaned; those that are empty then are dropped, and row_id numbered anew from 0."""
    out = segments.withColumn("text", tx.clean(F.col("text"), **steps))
    out = out.where(F.regexp_replace("text", r"(?U)\s+", "") != "") if drop_empty else out
    return out.withColumn("row_id", (F.row_number().over(Window.orderBy(F.coalesce("row_id", F.lit(0)), "pos")) - 1).cast("int"))


def _joined(segments: DataFrame, document: str) -> tuple[DataFrame, DataFrame]:
    """Text of each document, segments joined by spaces, and where in it each segment starts."""
    w = Window.partitionBy(document).orderBy(F.coalesce("row_id", F.lit(0)), "pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.withColumn("_start", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)))
    texts = rows.groupBy(document).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_start", "pos", "text"))), lambda x: x["text"]), " ").alias("_text"))
    return texts, rows


def sentencize(segments: DataFrame, document: str | None = None, *, splitter: Callable[[str], list[str]] | None = None, id_separator: str = ".") -> DataFrame:
    """Segments cut anew at the ends of sentences, which may lie across segments.

    The segments of a document (column ``document``; all one document if None) are read as one text.  A sentence belongs
    to the segment in which it starts, and is named by its id, ``id_separator`` and its number there.
    ``splitter`` may replace the default; what it returns must occur in the text in that order, else ValueError.
    Adds ``original_seg_id`` and ``sentence_index``, both in ``meta`` too."""
    one = document is None
    doc = "_document" if one else document
    segments = segments.withColumn(doc, F.lit(0)) if one else segments
    texts, rows = _joined(segments.where("text is not null"), doc)
    if splitter is None:
        parts = texts.select(doc, F.split("_text", tx.SENTENCE_GAP).alias("_s"), F.transform(F.regexp_extract_all("_text", F.lit(tx.SENTENCE_GAP), 0), F.length).alias("_g"))
        parts = parts.select(doc, F.posexplode(F.arrays_zip("_s", "_g")).alias("_i", "_z")).select(doc, "_i", F.col("_z._s").alias("_raw"), F.coalesce("_z._g", F.lit(0)).alias("_gap"))
        w = Window.partitionBy(doc).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
        lead = F.length("_raw") - F.length(F.regexp_replace("_raw", r"(?U)^\s+", ""))
        found = parts.withColumn("_start", F.coalesce(F.sum(F.length("_raw") + F.col("_gap")).over(w), F.lit(0)) + lead).withColumn("_text", tx.strip(F.col("_raw"))).where("_text <> ''").select(doc, "_start", "_text")
    else:

        def cut(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for key, text in zip(pdf[doc], pdf["_text"]):
                at = 0
                for s in splitter(text):
                    k = text.find(s, at)
                    if k < 0:
                        raise ValueError(f"the splitter's sentence is not in the text: {s!r}")
                    out.append((key, k, s))
                    at = k + len(s)
            return pd.DataFrame(out, columns=[doc, "_start", "_text"])

        kind = texts.schema[doc].dataType.simpleString()
        found = texts.groupBy(doc).applyInPandas(cut, f"`{doc}` {kind}, _start long, _text string")
    # the latest start of a segment at or before that of the sentence; empty segments hold none
    starts = rows.where(F.length("text") > 0).select(doc, "_start", F.lit(0).alias("_kind"), F.struct("seg_id", "meta", F.coalesce("row_id", F.lit(0)).alias("row_id"), "pos").alias("_seg"), F.lit(None).cast("string").alias("_text"))
    both = starts.union(found.select(doc, "_start", F.lit(1), F.lit(None).cast(starts.schema["_seg"].dataType), "_text"))
    over = Window.partitionBy(doc).orderBy("_start", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    mapped = both.withColumn("_seg", F.last("_seg", ignorenulls=True).over(over)).where("_kind = 1")
    n = F.row_number().over(Window.partitionBy(doc, "_seg.seg_id").orderBy("_start"))
    mapped = mapped.withColumn("sentence_index", n).withColumn("row_id", (F.row_number().over(Window.partitionBy(doc).orderBy("_start")) - 1).cast("int"))
    original = F.col("_seg.seg_id")
    meta = F.map_concat(F.map_filter(F.coalesce("_seg.meta", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("original_seg_id", "sentence_index")), F.create_map(F.lit("original_seg_id"), original, F.lit("sentence_index"), F.col("sentence_index").cast("string")))
    out = mapped.select(*([] if one else [doc]), F.concat(original, F.lit(id_separator), F.col("sentence_index").cast("string")).alias("seg_id"), F.col("_text").alias("text"), "row_id", F.col("row_id").cast("long").alias("pos"), meta.alias("meta"), original.alias("original_seg_id"), "sentence_index")
    return out
