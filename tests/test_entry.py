import duckdb
import pytest

import __spark_entry__ as entry
from quotewright.plans import catalog

D = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()


@pytest.mark.parametrize("name", ["sentencize_conversations", "rule_matches", "complura_runs", "match_report", "evaluate_micro", "k_sweep", "bigram_pairs"])
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, D)
    r = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, r.fetchall()))


def test_classified_pairs_has_all_matches(spark, tmp_path):
    words = "copper lantern river meadow thunder".split()
    spark.createDataFrame([(1, " ".join(words))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # the exact quotations come last
    docs = [(k, " ".join(words[:2])) for k in range(12)] + [(k, " ".join(words)) for k in range(12, 15)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.QUERIES["classified_pairs"](spark, str(tmp_path)).select("source_id").collect()
    assert sorted(int(r[0]) for r in rows) == list(range(15))


def test_every_query_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
