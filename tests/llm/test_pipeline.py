"""The pipeline: each stage takes effect on what the one before kept, and the columns stay."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quotewright.llm import decontaminate, jaccard_join

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = [docs]
    at = tmp_path_factory.mktemp("stages")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, D).write.parquet(str(at / str(k)))
        docs = spark.read.parquet(str(at / str(k)))
        out.append(docs)
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    assert stages[-1].columns == [*stages[0].columns, "hilbert", "shard"]


def test_clean_documents_stay_and_junk_goes(spark, stages):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    left = stages[1].join(labels, "doc_id").groupBy("quality").count().collect()
    n = {r[0]: r[1] for r in labels.join(stages[0], "doc_id").groupBy("quality").count().collect()}
    left = {r[0]: r[1] for r in left}
    assert left[1] >= 0.99 * n[1] and left.get(0, 0) <= 0.1 * n.get(0, 0)


def test_no_near_copies_and_no_leaks(spark, stages):
    assert jaccard_join.jaccard_join(stages[2]).count() == 0 and jaccard_join.jaccard_join(stages[1]).count() > 0
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    assert decontaminate.leaks(stages[2], bench).count() > 0 and decontaminate.leaks(stages[3], bench).count() == 0


def test_mixing_draws_and_sharding_keeps(stages):
    size = lambda d: d.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    assert 0.7 * size(stages[3]) < size(stages[4]) <= 0.9 * size(stages[3])
    assert stages[5].count() == stages[4].count()


def test_run_is_the_stages(spark, stages):
    got = {tuple(r) for r in corpus_pipeline.run(spark, D).select("doc_id", "text", "hilbert", "shard").collect()}
    assert got == {tuple(r) for r in stages[5].select("doc_id", "text", "hilbert", "shard").collect()}


def test_stages_on_odd_rows(spark):
    rnd = random.Random(0)
    rows = [(k, " ".join(rnd.choice("abcdefgh") * 3 for _ in range(30)), "en", "src1", 5) for k in range(5)] + [(None, None, None, None, None), (1, "", "en", None, 0), (2, "x " * 3000, None, "src1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for _, f in corpus_pipeline.STAGES:
            assert f(spark, d, D).count() <= docs.count()
