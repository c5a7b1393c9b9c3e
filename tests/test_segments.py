import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotewright.operators import segments as op
from quotewright.sources import segments as src
from quotewright.sources import sinks


def rows(df, *c):
    return [tuple(r) for r in op.ordered(df).select(*c).collect()]


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('seg_id,text,more\ns1,"one, ""two""\nlines",x\ns2,αβ \U0001f600,y\n', encoding="utf-8")
    assert rows(src.read_csv(spark, str(p)), "seg_id", "text", "row_id") == [("s1", 'one, "two"\nlines', 0), ("s2", "αβ \U0001f600", 1)]
    (tmp_path / "b.tsv").write_text("seg_id,text\nt1,x\nt2,y\n")
    assert rows(src.read_document(spark, str(tmp_path / "b.tsv")), "seg_id") == [("t1",), ("t2",)]
    assert src.read_csv(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "c.csv").write_text("id,content\n1,x\n")
    with pytest.raises(ValueError, match="missing"):
        src.read_csv(spark, str(tmp_path / "c.csv"))
    (tmp_path / "d.csv").write_text("seg_id,text\n1,x\n1,y\n")
    with pytest.raises(ValueError, match="twice"):
        src.read_csv(spark, str(tmp_path / "d.csv"))
    (tmp_path / "e.csv").write_text("seg_id,text\n")
    assert src.read_csv(spark, str(tmp_path / "e.csv")).count() == 0
    assert src.validate_csv(spark, str(tmp_path / "d.csv"))[0] and not src.validate_csv(spark, str(p))[0] and not src.validate_csv(spark, str(tmp_path / "e.csv"))[0]
    assert src.preview_csv(spark, str(p), 1).count() == 1


def test_plain_text_and_back(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n two\nthree")
    df = src.read_document(spark, str(tmp_path / "a.txt"))
    assert rows(df, "seg_id", "text") == [("0", "one"), ("2", " two"), ("3", "three")]
    sinks.save_plain(df, str(tmp_path / "new/out.txt"), delimiter="|")
    assert (tmp_path / "new/out.txt").read_text() == "one| two|three"
    sinks.save_csv(df, str(tmp_path / "out.csv"))
    assert rows(src.read_csv(spark, str(tmp_path / "out.csv")), "seg_id", "text") == rows(df, "seg_id", "text")
    assert rows(src.read_plain(spark, str(tmp_path / "a.txt"), "o"), "text")[0] == ("ne\n\n tw",)


def test_rows_pandas_dict(spark):
    df = src.from_pandas(spark, pd.DataFrame({"seg_id": [1, 2, 3], "text": ["a", "b", "c"], "row_id": [2, None, 0], "meta": [{"k": 1}, None, float("nan")]}))
    assert rows(df, "seg_id", "row_id") == [("3", 0), ("1", 2), ("2", 2)]
    assert sinks.to_pandas(df)["seg_id"].tolist() == ["3", "1", "2"] and list(sinks.to_pandas(df.limit(0)).columns) == ["seg_id", "text", "row_id", "meta"]
    with pytest.raises(TypeError):
        src.from_rows(spark, [{"seg_id": 1, "text": "a", "meta": "x"}])
    again, attributes = src.from_dict(spark, sinks.to_dict(df, author="me", meta={"a": 1}), author="you")
    assert rows(again, "seg_id", "text") == rows(df, "seg_id", "text") and attributes == {"path": None, "author": "you", "meta": {"a": 1}}
    with pytest.raises(ValueError):
        src.from_dict(spark, {})
    more = src.add_segment(df, "d", "9")
    assert op.get_text(more, "9") == "d" and src.remove_segment(more, "9").count() == 3 and src.remove_segment(df, "none").count() == 3
    with pytest.raises(ValueError):
        src.add_segment(df, "d", "1")
    with pytest.raises(KeyError):
        op.get_text(df, "none")
    assert op.head(df, 0).count() == 0 and op.head(df, -1).count() == 0 and [r[0] for r in op.head(df, 2).collect()] == ["3", "1"]


def test_gold_and_stopwords(spark, tmp_path):
    (tmp_path / "g.csv").write_text("query_id,source_id,label\nq,s,0\nq,t,1\nq,s,1\n")
    assert sorted(map(tuple, src.read_gold(spark, str(tmp_path / "g.csv")).collect())) == [("q", "s", 1), ("q", "t", 1)]
    (tmp_path / "w.txt").write_text("Et\tx\n sed \n\n")
    assert src.read_stopwords(spark, str(tmp_path / "w.txt")) == {"et", "sed"}
    with pytest.raises(ValueError):
        src.gold_labels(spark.createDataFrame([("a",)], "query_id string"))


def test_statistics(spark):
    df = src.from_rows(spark, [{"seg_id": 1, "text": "ab c"}, {"seg_id": 2, "text": "d"}, {"seg_id": 3, "text": ""}])
    assert op.statistics_dict(df) == {"num_segments": 3, "total_chars": 5, "total_words": 3, "avg_chars": 1.67, "avg_words": 1.0, "min_chars": 0, "max_chars": 4}
    assert set(op.statistics_dict(df.limit(0)).values()) == {0}


def test_clean_renumbers(spark):
    df = src.from_rows(spark, [{"seg_id": 1, "text": "   "}, {"seg_id": 2, "text": " a  b "}, {"seg_id": 3, "text": "c"}])
    assert rows(op.clean(df), "seg_id", "text", "row_id") == [("2", "a b", 0), ("3", "c", 1)]
    assert op.clean(df, drop_empty=False).count() == 3


def slow_sentences(segs, split, sep="."):
    full, spans, at = "", [], 0
    for n, (i, t) in enumerate(segs):
        full += (" " if n else "") + t
        spans.append((len(full) - len(t), len(full), i))
    out, counts = [], {}
    for s in split(full):
        k = full.find(s, at)
        at = k + len(s)
        origin = next((i for a, z, i in spans if a <= k < z), spans[-1][2])
        counts[origin] = counts.get(origin, 0) + 1
        out.append((f"{origin}{sep}{counts[origin]}", s))
    return out


def test_sentencize(spark):
    import re

    split = lambda t: [p.strip() for p in re.split(r"(?<=[.!?;])\s+", t) if p.strip()]
    segs = [("a", "One two. Three"), ("b", "four! Five; six"), ("c", ""), ("d", "seven."), ("e", "  Eight. Eight.  ")]
    df = src.from_rows(spark, [{"seg_id": i, "text": t, "meta": {"k": i}} for i, t in segs])
    out = op.sentencize(df)
    assert rows(out, "seg_id", "text") == slow_sentences(segs, split)
    first = out.where("row_id = 0").first()
    assert first["meta"] == {"k": "a", "original_seg_id": "a", "sentence_index": "1"} and first["sentence_index"] == 1
    by_word = lambda t: t.split()
    assert rows(op.sentencize(df, splitter=by_word, id_separator="-"), "seg_id", "text") == slow_sentences(segs, by_word, "-")
    assert op.sentencize(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="not in the text"):
        op.sentencize(df, splitter=lambda t: ["nowhere"]).count()


JUDGED = [("q1", "s1", 1, 0.95, 0.85), ("q1", "s2", 2, None, 0.45)]


def test_result_sinks(spark, tmp_path):
    q = src.from_rows(spark, [{"seg_id": i, "text": f"text {i}"} for i in ("q1", "q2")])
    s = src.from_rows(spark, [{"seg_id": i, "text": f'a "{i}", b'} for i in ("s1", "s2")])
    j = spark.createDataFrame(JUDGED, "query_id string, source_id string, rank int, candidate_score double, judgment_score double")
    sinks.results_to_csv(j, q, s, str(tmp_path / "r.csv"))
    got = pd.read_csv(tmp_path / "r.csv")
    assert list(got.columns) == ["query_id", "source_id", "source_text", "candidate_score", "judgment_score"]
    assert got["source_text"].tolist() == ['a "s1", b', 'a "s2", b'] and got["candidate_score"].isna().tolist() == [False, True]
    sinks.results_to_json(j, q, s, str(tmp_path / "r.json"))
    body = json.loads((tmp_path / "r.json").read_text())
    assert list(body) == ["q1", "q2"] and body["q2"] == [] and body["q1"][1] == {"source_id": "s2", "source_text": 'a "s2", b', "candidate_score": None, "judgment_score": 0.45}
    report = [tuple(r) for r in sinks.report(j, q, s, 0.85).collect()]
    assert report == [("q1", "text q1", "s1", 'a "s1", b', "0.950000", "0.850000", "Yes"), ("q1", "text q1", "s2", 'a "s2", b', "", "0.450000", "No"), ("q2", "text q2", "", "", "", "", "")]
    sinks.report_to_csv(j, q, s, 0.85, str(tmp_path / "rep.csv"))
    assert len(pd.read_csv(tmp_path / "rep.csv")) == 3
    shown = sinks.display_export(j, q, s, 0.85).collect()
    assert shown[1]["Similarity"] == "0.000" and shown[0]["Probability"] == "0.850"
    assert sorted(map(tuple, sinks.find_counts(j, q, 0.5).collect())) == [("q1", 1), ("q2", 0)]
    assert "candidate=N/A  judgment=0.450" in sinks.console(j, q, s) and "candidate=+0.950" in sinks.console(j, q, s)


def test_example(spark):
    q, s, g = src.example(spark)
    assert g.join(q, F.col("query_id") == q["seg_id"]).join(s, F.col("source_id") == s["seg_id"]).count() == 3


def test_files_in_order_of_names(spark, tmp_path):
    for folder, name, text in (("csv", "b", "seg_id,text\n3,x\n4,\"y\nz\"\n"), ("csv", "a", "seg_id,text\n1,u\n2,v\n"), ("txt", "b", "x\n\ny"), ("txt", "a", "u\nv\n"), ("gold", "b", "query_id,source_id,label\nq,s,0\n"), ("gold", "a", "query_id,source_id,label\nq,s,1\nq,t,1\n")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.{folder.replace('gold', 'csv')}").write_text(text)
    assert rows(src.read_csv(spark, str(tmp_path / "csv")), "seg_id", "text", "row_id") == [("1", "u", 0), ("2", "v", 1), ("3", "x", 2), ("4", "y\nz", 3)]
    assert rows(src.read_plain(spark, str(tmp_path / "txt")), "seg_id", "text") == [("0", "u"), ("1", "v"), ("2", "x"), ("4", "y")]
    assert {tuple(r) for r in src.read_gold(spark, str(tmp_path / "gold")).collect()} == {("q", "s", 0), ("q", "t", 1)}
