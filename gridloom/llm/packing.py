"""Packing of tokenised documents into fixed-length training sequences.

Documents are dealt at random into groups of bounded size; each group is one task's work: its texts
become token ids, whole multiples of the sequence length leave as full sequences, and the rests are
placed first-fit decreasing with a tournament tree over the bins' free room.

Null and empty texts are one end token. Rows with equal or null ids are packed as documents of
their own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bpe import default_path, tokenizer

#: Text bytes of one group on average: what a task holds at once. A task takes about TASK_GROUPS of them, one after the other.
GROUP_BYTES, TASK_GROUPS = 8 << 20, 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


class TournamentTree:
    """Free room of up to ``n`` bins; each inner node holds the larger of its two children."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """Put ``size`` into the first bin with room for it; its number."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        bin_no = i - self.leaves
        room[i] -= size
        while i > 1:
            i >>= 1
            left, right = room[2 * i], room[2 * i + 1]
            room[i] = left if left >= right else right
        return bin_no


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each size (all between 1 and ``capacity``), and the number of bins."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    if not len(sizes):
        return bins, offsets, 0
    tree = TournamentTree(len(sizes), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        bins[i] = b = tree.take(size)
        offsets[i] = capacity - tree.room[tree.leaves + b] - size
    return bins, offsets, int(bins.max()) + 1


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Pieces (document, start, length, bin, offset) of documents with these token counts."""
    full = lengths // capacity
    doc = np.repeat(np.arange(len(lengths)), full)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
    rest = lengths - full * capacity
    left = np.flatnonzero(rest)
    bins, offsets, n_bins = first_fit_decreasing(rest[left], capacity)
    return (
        np.concatenate([doc, left]),
        np.concatenate([nth * capacity, full[left] * capacity]),
        np.concatenate([np.full(len(doc), capacity), rest[left]]),
        np.concatenate([n_bins + np.arange(len(doc)), bins]),
        np.concatenate([np.zeros(len(doc), np.int64), offsets]),
    )


def pack(df: DataFrame, seq_len: int = 2048, end_id: int = 1, path: str | None = None, seed: int = 17, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per piece: its document, place there, place in a sequence, and crc32 of its ids."""
    path = path or default_path()
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    groups = max(1, -(-int(total) // group_bytes))
    # rows that are equal in all go to different groups, too
    drawn = F.xxhash64("doc_id", F.lit(seed), "text", F.monotonically_increasing_id())
    dealt = docs.withColumn("__group", F.pmod(drawn, F.lit(groups))).repartition(-(-groups // TASK_GROUPS), "__group")

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        ids, at = tokenizer(path).encode(table.column("text"))
        # an end token behind every document
        flat = np.insert(ids, at[1:], np.uint32(end_id)).astype("<u4")
        starts = at[:-1] + np.arange(table.num_rows)
        lengths = np.diff(at) + 1
        doc, start, length, bins, offset = pack_lengths(lengths, seq_len)
        begin = starts[doc] + start
        crc = np.fromiter((zlib.crc32(flat[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)), np.int64, len(doc))
        return pa.table(
            {
                "doc_id": table.column("doc_id").combine_chunks().take(pa.array(doc)),
                "start": start.astype(np.int64),
                "length": length.astype(np.int64),
                "ids_crc32": crc,
                "doc_tokens": lengths[doc].astype(np.int64),
                "sequence_id": (key[0].as_py() << 32) + bins.astype(np.int64),
                "offset": offset.astype(np.int64),
            }
        )

    return dealt.groupBy("__group").applyInArrow(work, SCHEMA)
