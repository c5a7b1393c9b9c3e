"""Command line: finds reuse of a source document in a query document and writes a report."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from quotewright.operators import models
from quotewright.plans import pipeline as pl
from quotewright.sources import segments, sinks

PIPELINES = ("two-stage", "exhaustive", "retrieval", "rule-based", "word-vectors")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quotewright", description=__doc__)
    p.add_argument("query", help="query document (CSV with seg_id and text, or plain text)")
    p.add_argument("source", help="source document")
    p.add_argument("-o", "--output", required=True, help="report (CSV)")
    p.add_argument("--pipeline", choices=PIPELINES, default="two-stage")
    p.add_argument("--gold", help="labelled pairs (CSV) to fit the classifier of two-stage and exhaustive on")
    p.add_argument("-k", "--top-k", type=int, default=10)
    p.add_argument("-t", "--threshold", type=float, default=0.85)
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> tuple[int, int, int]:
    """(queries, candidates, matches) after the report is written."""
    query, source = segments.read_document(spark, a.query), segments.read_document(spark, a.source)
    kw = {"top_k": a.top_k}
    if a.pipeline == "rule-based":
        judged = pl.rule_based().run(query, source)
    elif a.pipeline == "word-vectors":
        vectors = models.WordVectorTrainer(vector_size=50).fit(source.select("text").union(query.select("text"))).vectors()
        judged = pl.word_vectors(vectors, similarity_threshold=a.threshold).run(query, source, **kw)
    else:
        q, s = models.hashed_embedding(query), models.hashed_embedding(source)
        if a.pipeline == "retrieval":
            judged = pl.retrieval(top_k=a.top_k).run(q, s, **kw)
        else:
            if not a.gold:
                raise ValueError("--gold is needed to fit the classifier")
            model = models.fit_pair_classifier(segments.read_gold(spark, a.gold), query, source)
            first = pl.generators.embedding(q, s, **kw) if a.pipeline == "two-stage" else pl.generators.exhaustive(q, s)
            judged = models.judge_pairs(first, query, source, model)
    judged = judged.cache()
    sinks.report_to_csv(judged, query, source, a.threshold, a.output)
    return query.count(), judged.count(), judged.where(judged["judgment_score"] >= a.threshold).count()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    for f in (a.query, a.source):
        if not Path(f).exists():
            print(f"no such file: {f}", file=sys.stderr)
            return 1
    spark = SparkSession.builder.appName("quotewright").getOrCreate()
    try:
        n, total, found = run(spark, a)
    except Exception as e:  # the message is what a user can act on
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(f"{n} query segments, {total} candidates, {found} at or above {a.threshold}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
