"""Shared plumbing of the corpus operators.

* ``scratch`` cuts lineage with a table in the folder all executors share.
* ``FlatText`` views an Arrow string column as one byte buffer with document
  offsets, so that word splitting and hashing are numpy passes over the whole
  batch and not loops over documents.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes; longer documents are one pass each.
CHUNK_BYTES = 1 << 20

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode an own temporary one where it is unset."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="gridloom-")
    return f"file://{_own_dir}"


def scratch(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages restart from there.

    The caller's retention policy for the shared folder removes the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys with more rows than this, and more than this share of all rows, are hot: there are at most 1 / HOT_SHARE of them.
HOT_ROWS, HOT_SHARE = 1000, 1e-4


def salted_join(many: DataFrame, one: DataFrame, key: str, by: str, counts: DataFrame, total: int) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has a row for each key, where no key's rows of ``many`` need to meet.

    ``counts``: key and n, its rows in ``many``, of ``total``. The rows of a hot key are cut into pieces by
    a hash of column ``by``, and its row in ``one`` goes to every piece.
    """
    limit = max(HOT_ROWS, int(total * HOT_SHARE))
    hot = F.broadcast(counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("__cuts")))
    cuts = F.coalesce("__cuts", F.lit(1))
    left = many.join(hot, key, "left").withColumn("__piece", F.pmod(F.xxhash64(by), cuts).cast("int"))
    right = one.join(hot, key, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0), cuts - 1)))
    return left.drop("__cuts").join(right.drop("__cuts"), [key, "__piece"]).drop("__piece")


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with underscores behind it until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of the column as text, modulo ``n``; a null id counts as 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.crc32(c.cast("string")) % n, F.lit(0))


# --- numpy hashing -----------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit words (fresh array, computed in place)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words without punctuation: ASCII letters and digits, and all of other scripts.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
#: Longer spans are hashed one by one instead of in 8-byte steps.
_LONG = 512


def hash_spans(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; ``buf`` must have 8 spare bytes at its end."""
    words = np.lib.stride_tricks.as_strided(buf[:8].view("<u8"), shape=(max(len(buf) - 7, 1),), strides=(1,))
    h = mix64((words[start] & _MASK[np.minimum(length, 8)]) + length.astype(np.uint64) * _GOLD)
    rest, at = np.flatnonzero((length > 8) & (length <= _LONG)), 8
    while len(rest):
        block = words[start[rest] + at] & _MASK[np.minimum(length[rest] - at, 8)]
        h[rest] = mix64((h[rest] * _GOLD) ^ block)
        at += 8
        rest = rest[length[rest] > at]
    for i in np.flatnonzero(length > _LONG):
        part = buf[start[i] : start[i] + length[i]].tobytes()
        h[i] = np.uint64(int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little"))
    return h


class FlatText:
    """A run of documents as UTF-8 bytes: ``buf`` (8 spare zero bytes), ``offsets`` (n + 1)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.n, self.offsets = len(offsets) - 1, offsets
        self.buf = np.zeros(len(buf) + 8, np.uint8)
        self.buf[: len(buf)] = _LOWER[buf] if lower else buf

    def words(self, members: np.ndarray = ~_WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte start and length of every word (runs of ``members``, by default non-white-space), and word offsets by document."""
        size = int(self.offsets[-1])
        dark = members[self.buf[:size]]
        first = dark.copy()
        first[1:] &= ~dark[:-1]
        last = dark.copy()
        last[:-1] &= ~dark[1:]
        inner = self.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < size)]
        first[inner] = dark[inner]
        last[inner - 1] = dark[inner - 1]
        start = np.flatnonzero(first)
        return start, np.flatnonzero(last) + 1 - start, np.searchsorted(start, self.offsets)

    def word_hashes(self, members: np.ndarray = ~_WS) -> tuple[np.ndarray, np.ndarray]:
        start, length, at = self.words(members)
        return hash_spans(self.buf, start, length), at


def string_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) slices of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, len(column))
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def flat_chunks(column: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, FlatText]]:
    for a, b, buf, offsets in string_chunks(column, limit):
        yield a, b, FlatText(buf, offsets, lower)


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of code points before the byte positions ``at`` of a UTF-8 text."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles with offsets by document; a shorter document is one shingle, an empty one none."""
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out_at = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(at[:-1] - out_at[:-1], count) + np.arange(out_at[-1])
    width = np.repeat(np.minimum(n, k), count)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    h = width.astype(np.uint64) * _GOLD
    for i in range(k):
        step = mix64((h * _M1) ^ padded[begin + i])
        h = step if i == 0 else np.where(width > i, step, h)
    return h, out_at
