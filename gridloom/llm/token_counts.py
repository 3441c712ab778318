"""Token counts by source, language and tokenizer version, kept up by signed deltas.

A batch of changes (inserts, deletes, revised counts) becomes a few additive rows: documents and
tokens to add or take away for each source, language and tokenizer version. A store keeps one
folder of such rows for each batch id. The folder is written aside and then renamed, which either
succeeds as a whole or finds the id taken: committing the same id again changes nothing, also where
two drivers try at once, and a failed attempt leaves nothing that counts. (Rename is atomic on HDFS
and local file systems.) ``compact`` sums all batches so far to a snapshot; totals are the last
snapshot and the batches after it, so batches can come in any order.

A null text has no tokens but counts as a document. Null sources and languages are groups of their
own. Rows with equal or null ids each count. An empty table gives no rows. Changes of an unknown or
null kind, or without the counts that their kind needs, raise. Groups without documents and tokens
aren't listed.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import default_path, tokenizer
from gridloom.llm.common import ALNUM, crc_mod, flat_chunks, scratch, shared_dir

KEYS = ("source", "lang", "tokenizer")
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def version_name(version: str) -> str:
    """How rows name a version: a file's name without folder and ending."""
    return os.path.splitext(os.path.basename(version))[0]


def _count(column: pa.Array, version: str) -> np.ndarray:
    if version == "words-1":  # runs of non-white-space
        return np.concatenate([np.diff(flat.words()[2]) for _, _, flat in flat_chunks(column)] or [np.zeros(0, np.int64)])
    if version == "words-2":  # runs of letters and digits
        return np.concatenate([np.diff(flat.words(ALNUM)[2]) for _, _, flat in flat_chunks(column)] or [np.zeros(0, np.int64)])
    return np.diff(tokenizer(version).encode(column)[1])


def counts(df: DataFrame, versions: tuple[str, ...]) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens, n_bytes of every text. A version is the path of a byte-level BPE file, or words-1 or words-2."""
    chosen = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(3)), 0).cast(pa.int64())
            for version in versions:
                n = _count(batch.column(3), version).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([version_name(version)] * len(n), pa.string()), pa.array(n), size], ["doc_id", "source", "lang", "tokenizer", "n_tokens", "n_bytes"])

    return chosen.mapInArrow(work, "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_bytes long")


def deltas(changes: DataFrame) -> DataFrame:
    """Additive rows of changes (op, source, lang, tokenizer, n_tokens, old_tokens); op: insert, delete or revise."""
    docs = F.expr("CASE op WHEN 'insert' THEN 1 WHEN 'delete' THEN -1 ELSE 0 END")
    tokens = F.expr("CASE op WHEN 'insert' THEN n_tokens WHEN 'delete' THEN -n_tokens WHEN 'revise' THEN n_tokens - old_tokens END")
    tokens = F.coalesce(tokens, F.raise_error(F.concat(F.lit("not a change with its counts: op "), F.coalesce("op", F.lit("null")))).cast("long"))
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


class RollupStore:
    """Committed batches of deltas, and snapshots of their sums, in a folder that the driver and all executors share.

    The driver sees names of batches and no rows: one listing for totals.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        path = self._path("x")
        return path.getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    @staticmethod
    def _folder(batch_id: str) -> str:
        return hashlib.sha256(batch_id.encode()).hexdigest()[:32]

    def _publish(self, staged: str, name: str) -> bool:
        """Rename a finished folder to its place; False, and the folder gone, if the place is taken."""
        jvm = self.spark._jvm
        files, none = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("x").toUri(), self._conf), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._fs().mkdirs(self._path(name).getParent())
        try:
            files.rename(self._path(staged), self._path(name), none)
        except Py4JJavaError:
            if not self._fs().exists(self._path(name)):
                raise
            self._fs().delete(self._path(staged), True)
            return False
        return True

    def committed(self, batch_id: str) -> bool:
        return self._fs().exists(self._path(f"batches/{self._folder(batch_id)}"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False if this id is in already, whatever the changes."""
        if self.committed(batch_id):
            return False
        staged = f"staging/{uuid.uuid4().hex}"
        deltas(changes).write.parquet(f"{self.root}/{staged}")
        return self._publish(staged, f"batches/{self._folder(batch_id)}")

    def _state(self) -> tuple[int, set[str], list[str]]:
        """Number of the last snapshot (0: none), the batches in it, and those after it."""
        snapshots = self._names("snapshots")
        last = max(map(int, snapshots), default=0)
        held = {r.name for r in self.spark.read.schema("name string").parquet(f"{self.root}/snapshots/{last}/names").collect()} if last else set()
        return last, held, [n for n in self._names("batches") if n not in held]

    def _sums(self, last: int, batches: list[str]) -> DataFrame:
        paths = ([f"{self.root}/snapshots/{last}/sums"] if last else []) + [f"{self.root}/batches/{n}" for n in batches]
        rows = self.spark.read.schema(_DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], _DELTA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        last, _, batches = self._state()
        return self._sums(last, batches).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> bool:
        """Sum everything committed so far to a new snapshot; False if another driver made it first.

        Rows of batches in the snapshot before go: readers of that one are given until now. Their
        folders stay, so that their ids stay taken.
        """
        last, held, batches = self._state()
        staged = f"staging/{uuid.uuid4().hex}"
        self._sums(last, batches).write.parquet(f"{self.root}/{staged}/sums")
        self.spark.createDataFrame([(n,) for n in sorted(held | set(batches))], "name string").coalesce(1).write.parquet(f"{self.root}/{staged}/names")
        if not self._publish(staged, f"snapshots/{last + 1}"):
            return False
        fs = self._fs()
        for name in held:
            for file in self._names(f"batches/{name}"):
                if file.endswith(".parquet"):
                    fs.delete(self._path(f"batches/{name}/{file}"), False)
        return True


def maintained_counts(df: DataFrame, versions: tuple[str, ...] | None = None) -> DataFrame:
    """Totals of ``df`` as a store has them after a life of batches.

    All documents come in with estimated counts (a token for each 4 bytes), then exact counts revise
    them; a tenth of the documents is withdrawn and restored; the revision is delivered twice. Batches are
    compacted on the way.
    """
    spark = df.sparkSession
    exact = scratch(counts(df, versions or (default_path(), "words-1", "words-2")), "token-counts")
    guess = F.ceil(F.col("n_bytes") / 4).cast("long")
    none = F.lit(None).cast("long")
    store = RollupStore(spark, f"{shared_dir(spark)}/gridloom-rollup-{uuid.uuid4().hex}")
    revised = exact.withColumn("op", F.lit("revise")).withColumn("old_tokens", guess)
    moved = exact.where(crc_mod("doc_id", 10) == 0).withColumn("old_tokens", none)
    store.commit("load", exact.withColumn("op", F.lit("insert")).withColumn("old_tokens", none).withColumn("n_tokens", guess))
    store.commit("recount", revised)
    store.compact()
    store.commit("withdraw", moved.withColumn("op", F.lit("delete")))
    store.commit("restore", moved.withColumn("op", F.lit("insert")))
    store.commit("recount", revised)
    return store.totals()
