"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A batch of changes (inserts, deletes, revised texts) becomes signed rows: minus what the ledger says a document counted
so far, plus what it counts now.  Totals are sums of signed rows.  The ledger lies in buckets of doc_ids, so a batch
reads only the buckets it touches, and compaction keeps the number of files down.

What is committed is told by a log of numbered entries.  A batch is written under a name of its own attempt and exists once
its entry does; an entry appears whole, and only if no other one has taken the number.  So an attempt that died is never
seen, a batch committed before is skipped, and of two writers at once the slower one counts again on top of the other.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, n_partitions, shared_dir, slices

#: Tokenizers of the query: files of public ranks, and the versions that their counts carry.
VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")
#: Buckets of a ledger.
BUCKETS = 64
_LEDGER = "doc_id long, source string, lang string, version string, docs long, tokens long, chars long"
_TOTALS = "source string, lang string, version string, docs long, tokens long, chars long"
_KEY = ["source", "lang", "version"]
_VALUES = ["docs", "tokens", "chars"]
_encoders: dict[str, object] = {}


def default_vocabularies() -> dict[str, str]:
    """Version → path of the public vocabularies of the query."""
    import public_tokenizers

    return {v: public_tokenizers.path(f"{v}.tiktoken") for v in VERSIONS}


def _encoder(path: str):
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text; a null one has none.  Special tokens are ordinary text."""
    encode = _encoder(path).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]


def _counted(paths: list[str]):
    """Texts give way to their characters and their tokens by each vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            keep = [k for k in range(batch.num_columns) if k != at]
            counts = [count_tokens(texts, p) for p in paths]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array([len(t or "") for t in texts], pa.int64()), pa.array([list(c) for c in zip(*counts)], pa.list_(pa.int64()))], names=[*[batch.schema.names[k] for k in keep], "chars", "counts"])

    return run


class TokenRollup:
    """Totals of the documents that committed batches leave, kept in the folder ``root``.

    ``vocabularies``: version → path of its ranks; each change is counted by every version.  A rollup keeps its versions and
    its number of ``buckets`` for good."""

    def __init__(self, spark: SparkSession, root: str, vocabularies: dict[str, str] | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.vocabularies = vocabularies or default_vocabularies()

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _list(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def log(self) -> list[dict]:
        """The committed entries in order."""
        out = []
        for name in self._list(f"{self.root}/log"):
            if name.endswith(".json") and not name.startswith((".", "_")):
                fs, p = self._fs(f"{self.root}/log/{name}")
                stream = fs.open(p)
                out.append(json.loads(bytes(stream.readAllBytes())) | {"number": int(name[:-5])})
                stream.close()
        return out

    def _publish(self, after: list[dict], entry: dict) -> bool:
        """Adds an entry behind those of ``after``, unless the log has grown since."""
        number = after[-1]["number"] + 1 if after else 0
        fs, p = self._fs(f"{self.root}/log/{number:012d}.json")
        _, tmp = self._fs(f"{self.root}/log/.{uuid.uuid4().hex}")
        stream = fs.create(tmp, False)
        stream.write(json.dumps(entry).encode())
        stream.close()
        if fs.getScheme() == "file":
            # a rename would replace what is there; a second link can't
            try:
                os.link(tmp.toUri().getPath(), p.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                fs.delete(tmp, False)
        done = not fs.exists(p) and fs.rename(tmp, p)
        if not done:
            fs.delete(tmp, False)
        return done

    @staticmethod
    def _current(log: list[dict]) -> list[str]:
        """Folders that together hold all signed rows: the last compaction and what came after."""
        out: list[str] = []
        for e in log:
            out = [*([] if e["batch"] is None else out), e["folder"]]
        return out

    def committed(self) -> set[int]:
        """Numbers of the committed batches."""
        return {e["batch"] for e in self.log() if e["batch"] is not None}

    def _rows(self, log: list[dict], buckets: set[int] | None = None) -> DataFrame:
        paths = []
        for folder in self._current(log):
            at = f"{self.root}/{folder}/ledger"
            paths += [f"{at}/{n}" for n in self._list(at) if n.startswith("bucket=") and (buckets is None or int(n[7:]) in buckets)]
        return self.spark.read.schema(_LEDGER).parquet(*paths) if paths else self.spark.createDataFrame([], _LEDGER)

    def ledger(self) -> DataFrame:
        """Signed rows of all committed batches."""
        return self._rows(self.log())

    def _write(self, rows: DataFrame, folder: str) -> None:
        """Ledger rows with ``bucket``, and their sums."""
        rows.write.partitionBy("bucket").parquet(f"{self.root}/{folder}/ledger")
        self.spark.read.schema(_LEDGER).option("recursiveFileLookup", True).parquet(f"{self.root}/{folder}/ledger").groupBy(*_KEY).agg(*[F.sum(c).alias(c) for c in _VALUES]).write.parquet(f"{self.root}/{folder}/delta")

    def _bucket(self):
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def _drop(self, folder: str) -> None:
        fs, p = self._fs(f"{self.root}/{folder}")
        fs.delete(p, True)

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Applies ``changes`` as batch number ``batch``; False, and nothing happens, if it was committed before.

        Columns: doc_id, op, text, source, lang, and seq if given.  op ``delete`` takes a document out, any other puts
        it in, in place of what it was.  Of several changes to a doc_id in a batch the one of the largest seq counts,
        then a delete before others, then the longest text, then the least source, language and text hash (null first).  A deleted doc_id that isn't there
        changes nothing.  Rows without doc_id can't be revised: inserts of them add up, deletes of them are ignored.  Null names are groups of
        their own, a null or empty text counts as a document without tokens; texts of any length are counted whole, once
        for each vocabulary.  Other columns are not looked at; an empty batch is committed and changes nothing.
        """
        while True:
            log = self.log()
            if any(e["batch"] == batch for e in log):
                return False
            folder = f"batches/{batch}-{uuid.uuid4().hex}"
            self._write(self._delta(changes, log), folder)
            if self._publish(log, {"batch": batch, "folder": folder}):
                return True
            self._drop(folder)

    def _delta(self, changes: DataFrame, log: list[dict]) -> DataFrame:
        versions = sorted(self.vocabularies)
        src = columns(changes, doc_id="long", op="string", text="string", source="string", lang="string", seq="long")
        counted = src.withColumn("th", F.xxhash64("text")).mapInArrow(_counted([self.vocabularies[v] for v in versions]), "doc_id long, op string, source string, lang string, seq long, th long, chars long, counts array<long>")
        # rows without doc_id are each on their own, and spread
        loose = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
        n = n_partitions(self.spark)
        rows = counted.withColumn("gone", F.coalesce(F.lower("op") == "delete", F.lit(False))).withColumn("loose", loose)
        rows = rows.withColumn("bucket", F.when(F.col("loose").isNull(), self._bucket()).otherwise(-1)).withColumn("slot", F.pmod(F.xxhash64("doc_id", "loose", F.lit(1)), F.when(F.col("loose").isNull(), max(1, n // self.buckets)).otherwise(n)))
        rank = F.row_number().over(Window.partitionBy("bucket", "slot", "doc_id", "loose").orderBy(F.desc_nulls_last("seq"), F.desc("gone"), F.desc("chars"), "source", "lang", "th"))
        last = rows.repartition(n, "bucket", "slot").withColumn("rn", rank).where("rn = 1 and not gone")
        each = last.select("doc_id", "source", "lang", "bucket", "chars", F.posexplode("counts").alias("v", "tokens"))
        version = F.get(F.array(*[F.lit(v) for v in versions]), F.col("v"))
        delta = each.select("doc_id", "source", "lang", version.alias("version"), F.lit(1).cast("long").alias("docs"), "tokens", "chars", "bucket")
        if not log:
            return delta
        named = src.where("doc_id is not null").select("doc_id").distinct()
        touched = {r[0] for r in named.select(self._bucket().alias("b")).distinct().collect()}
        now = self._rows(log, touched).join(named, "doc_id", "left_semi").groupBy("doc_id", *_KEY).agg(*[F.sum(c).alias(c) for c in _VALUES]).where("docs <> 0")
        return delta.union(now.select("doc_id", *_KEY, *[-F.col(c) for c in _VALUES], self._bucket()))

    def compact(self) -> bool:
        """Writes the ledger anew, one row for what a document counts; False if a batch was committed meanwhile.

        What went into it is no longer read, and stays for readers that began before."""
        log = self.log()
        folder = f"batches/all-{uuid.uuid4().hex}"
        rows = self._rows(log)
        named = rows.where("doc_id is not null").groupBy("doc_id", *_KEY).agg(*[F.sum(c).alias(c) for c in _VALUES]).where("docs <> 0 or tokens <> 0 or chars <> 0").withColumn("bucket", self._bucket())
        loose = rows.where("doc_id is null").groupBy("doc_id", *_KEY).agg(*[F.sum(c).alias(c) for c in _VALUES]).withColumn("bucket", F.lit(-1))
        self._write(named.union(loose), folder)
        if self._publish(log, {"batch": None, "folder": folder}):
            return True
        self._drop(folder)
        return False

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens, chars): sums of the committed batches' deltas; empty groups are left out."""
        paths = [f"{self.root}/{f}/delta" for f in self._current(self.log())]
        d = self.spark.read.schema(_TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], _TOTALS)
        return d.groupBy(*_KEY).agg(*[F.sum(c).alias(c) for c in _VALUES]).where("docs <> 0 or tokens <> 0 or chars <> 0")


def token_counts(docs: DataFrame, vocabularies: dict[str, str] | None = None) -> DataFrame:
    """(source, lang, version, docs, tokens, chars): totals of a table, as a new rollup under the shared folder with all of ``docs`` as its
    first batch.

    Rows of one doc_id count as one document, the one of the longest text (see :meth:`TokenRollup.commit` for ties); rows without doc_id
    count each.  Null sources and languages are groups of their own; null and empty texts are documents without tokens.  An empty
    table gives an empty result."""
    spark = docs.sparkSession
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}", vocabularies)
    rollup.commit(0, columns(docs, doc_id="long", text="string", source="string", lang="string").withColumn("op", F.lit("insert")))
    return rollup.totals()
