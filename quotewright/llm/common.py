"""Helpers that the operators of this subpackage share: tables, shared storage, row identity."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor sees.

    Where the session names none, a local session (tests) gets a temporary folder; on a cluster that would
    be a folder of one machine, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="quotewright-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`written`, which nothing needs any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)


#: Bytes of a partition of a hash join's build side, at most.
BUILD_BYTES = 64 << 20


def hash_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a table made by :func:`written` with about ``row_bytes`` a row, as the build side of a shuffled hash join if its
    partitions would be small enough to be held; if not, the join is left to Catalyst."""
    return df.hint("shuffle_hash") if df.count() * row_bytes <= BUILD_BYTES * n_partitions(df.sparkSession) else df


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that no column has (names are compared without regard to case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def columns(docs: DataFrame, **types: str) -> DataFrame:
    """The named columns of ``docs``, cast; one that is missing is null.  All others are left behind."""
    have = {c.lower(): c for c in docs.columns}
    return docs.select(*[(docs[f"`{have[c]}`"] if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def text_hash(column: str = "text"):
    """Identity of a text next to its doc_id; that of null is null."""
    c = F.col(f"`{column}`")
    return F.when(c.isNotNull(), F.xxhash64(c))


def strings(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ints(batch: pa.RecordBatch, name: str, null: int = 0) -> np.ndarray:
    """An integer column as int64, nulls as ``null``."""
    return np.asarray(strings(batch, name).cast(pa.int64()).fill_null(null))


def xxh64(data: bytes | str) -> int:
    return xxhash.xxh3_64_intdigest(data)


def bin_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The one of ``n`` equal ranges of the 64-bit space that each hash lies in."""
    return (((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that one holds about ``most`` bytes of ``column``; a single value is never cut."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        size = np.asarray(pc.binary_length(strings(batch, column)).cast(pa.int64()).fill_null(0))
        part = np.cumsum(size) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n]):
            yield batch.slice(a, b - a)
