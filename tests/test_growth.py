"""Steps whose cost must not grow faster than their input, against slow definitions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quotewright.operators import evaluate as ev
from quotewright.operators import generators
from quotewright.sources import segments as src


def test_classes_count_as_their_pairs(spark):
    label = {"a": 1, "b": 1, "c": 2, "d": 1, "e": None}
    rows = spark.createDataFrame(list(label.items()), "seg_id string, label int")
    seg = src.from_rows(spark, [{"seg_id": i, "text": ""} for i in label])
    sources = seg.where("seg_id <> 'd'")
    pairs = spark.createDataFrame([(x, y, 1) for x in label for y in label if label[x] is not None and label[x] == label[y]], src.GOLD)
    judged = spark.createDataFrame([("a", "b", 1, 0.9), ("a", "c", 2, 0.6), ("a", "d", 3, 0.6), ("b", "b", 1, 0.7), ("c", "e", 1, 0.4), ("e", "e", 1, 0.9)], "query_id string, source_id string, rank int, judgment_score double")
    got, want = ({r["query_id"]: r for r in ev.per_query(ev.links(judged, 0.5), g, seg, sources).collect()} for g in (ev.Classes(rows), pairs))
    assert got == want and (got["a"]["tp"], got["a"]["fp"], got["a"]["fn"], got["a"]["tn"]) == (1, 1, 1, 1)
    for sweep in (lambda g: ev.threshold_sweep(judged, g, seg, sources, (0.3, 0.65, 0.95), "macro"), lambda g: ev.k_sweep(judged, g, seg, sources, 0.5, (1, 2))):
        assert sorted(sweep(ev.Classes(rows)).collect()) == sorted(sweep(pairs).collect())
    assert {r[0] for r in ev.queries_with_match(ev.Classes(rows)).collect()} == {"a", "b", "c", "d"}


@pytest.mark.parametrize("digits, kinds", [(None, 4000), (2, 4000), (6, 30), (3, 1)])
def test_nearest_of_a_block(monkeypatch, digits, kinds):
    """Products of a part of the block at a time, ties in source order however many there are."""
    monkeypatch.setattr(generators, "STEP", (64, 300))
    monkeypatch.setattr(generators, "MOST_CANDIDATES", 5000)
    rng = np.random.default_rng(kinds)
    a, b = rng.normal(size=(150, 8)).astype(np.float32), rng.normal(size=(kinds, 8)).astype(np.float32)[rng.integers(0, kinds, 4000)]
    lists = lambda m: pa.chunked_array([pa.array(m.tolist(), pa.list_(pa.float32()))])
    q = pa.table({"query_id": [str(i) for i in range(150)], "v": lists(a)})
    s = pa.table({"source_id": [str(i) for i in range(4000)], "r": np.zeros(4000, np.int64), "p": np.arange(4000), "u": lists(b)})
    got = generators._nearest_of_block(10, digits)(q, s)
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    cosine = unit(a) @ unit(b).T
    want = np.argsort(-(cosine if digits is None else np.round(cosine, digits)), axis=1, kind="stable")[:, :10]
    if digits is None:  # equal vectors may differ in the last bit
        assert np.allclose(np.array(got["candidate_score"]), np.take_along_axis(cosine, want, 1).ravel(), atol=1e-12)
    else:
        assert np.array_equal(np.array(got["p"]).reshape(150, 10), want)


def test_judgments_are_made_once_for_a_sweep(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(x):
        made.add(1)
        return x

    judged = spark.createDataFrame([("a", "b", 1, 0.9), ("b", "a", 1, 0.2)], "query_id string, source_id string, rank int, judgment_score double").withColumn("judgment_score", score.asNondeterministic()("judgment_score"))
    seg = src.from_rows(spark, [{"seg_id": i, "text": ""} for i in "ab"])
    assert len(ev.threshold_sweep(judged, spark.createDataFrame([("a", "b", 1)], src.GOLD), seg, seg, (0.5, 0.95)).collect()) == 2
    assert made.value == 2


def test_rules_move_no_pairs(spark):
    """No source or pair is shuffled to find matches; ranges of sources give the ranks of the whole."""
    from quotewright.operators import rules, scan

    q = src.from_rows(spark, [{"seg_id": f"q{k}", "text": t} for k, t in enumerate(("rex lux mare terra oris", "rex, lux", "**x lux rex"))])
    s = src.from_rows(spark, [{"seg_id": f"s{k}", "text": ("rex lux mare terra", "lux; rex", "non **x lux et rex", "\u009c\nrex lux ΣΣ")[k % 4]} for k in range(40)])
    for f in (rules.shared_words, rules.near, rules.matches, rules.complura):
        assert "Exchange hashpartitioning" not in f(q, s)._jdf.queryExecution().executedPlan().toString()
    whole = sorted(rules.rule_based(q, s).collect())
    old = rules.RANKED, scan.QUERIES, rules.PASS_CHARS
    try:
        rules.RANKED, scan.QUERIES, rules.PASS_CHARS = 3, 2, 1
        assert sorted(rules.rule_based(q, s).collect()) == whole and len(whole) >= 40
        assert sorted(rules.rule_based(q, s, top_k=2).collect()) == [r for r in whole if r["rank"] <= 2]
    finally:
        rules.RANKED, scan.QUERIES, rules.PASS_CHARS = old
    assert sorted(r["rank"] for r in whole if r["query_id"] == "q0") == list(range(1, 1 + sum(r["query_id"] == "q0" for r in whole)))


def test_files_grow_in_number(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry
    from quotewright.plans import files

    monkeypatch.setattr(files, "FILE_BYTES", 40_000)
    docs = spark.range(60).selectExpr("id as doc_id", "concat('a \"b\",\n', repeat('xyz ', 1000), id) as text")
    docs.repartition(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = {(r[0], str(r[0]), r[1]) for r in docs.collect()}
    for name in ("csv_scan", "segments_csv", "plain_scan"):
        rows = entry.queries()[name](spark, str(tmp_path))
        got = {(r["row_id"], r["seg_id"], r["text"]) for r in rows.collect()}
        assert len(rows.inputFiles()) == 7 and len(got) == 60 and (name == "plain_scan" or got == want), name
