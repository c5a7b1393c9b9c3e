"""Streams of query segments against a source that stands still.

Lexical preparation and judging are functions of a row, matching is a join with a static table; ranks need whole
lists, so every micro-batch is one run of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quotewright.plans.pipeline import Pipeline


def judge_stream(queries: DataFrame, source: DataFrame, pipeline: Pipeline, path: str, checkpoint: str, *, trigger: dict | None = None, **kw) -> StreamingQuery:
    """Judges each batch of arriving query segments and appends the results as Parquet under ``path``.

    A batch writes to a folder of its number, overwriting what a failed try of it left, so each is there once."""

    def write(batch: DataFrame, number: int) -> None:
        pipeline.run(batch, source, **kw).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def filtered_stream(queries: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stream through an operator that looks at one row at a time, e.g. cleaning or phrasing."""
    return step(queries)
