"""Removal of long repeated byte strings, by interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. No task can
sort the suffixes of a whole corpus, so strings are first brought together: each has an anchor, the
least hashed 40-byte gram in it, which depends on nothing else, so equal strings have equal
anchors. The strings of one anchor occurrence overlap and form a segment. Segments whose anchor
occurs once hold no repeats. Equal segments (two 64-bit hashes agree) repeat as wholes. Distinct segments of one anchor are
joined to a text whose suffixes are sorted to ``length`` bytes and more; breadth-first backward
extension over its BWT sets common-prefix values in increasing order and stops at ``length``: what
is not set by then is at least that long, and those suffixes start repeated strings.

Where the distinct segments of an anchor are too many bytes for one task, they are cut into shorter
ones, whose strings have their anchor within a narrower range of offsets; these all hold a
common core, and equal strings have equal anchors, offsets and cores. So segments are grouped anew by
range and core, equal ones repeat as wholes, and the rest goes the same way, with ranges down to one
offset, where distinct strings can't be equal.

Matches never cross documents. Null and empty texts, and those shorter than ``length``, keep all
bytes. Rows with equal or null ids are documents of their own. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import mix64, scratch, string_chunks

GRAM = 40
#: Bytes of segments whose suffixes one task sorts at a time, on average.
BUCKET_BYTES = 2 << 20
#: Widths of the ranges of anchor offsets that too large groups are cut to, one after the other.
WIDTHS = (40, 8, 1)
#: Keys with more than this share of all occurrences are told apart by broadcast: there can't be more of them than its inverse.
HOT_SHARE = 1e-4
#: Bits of the maps that spare keys and rows without repeats a shuffle, as a power of two, at most. A full map only spares less.
BITMAP_BITS = 27
_CHUNK = 1 << 20
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_power_cache: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _power_cache.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _CHUNK + 4096), base, np.uint64)
        have[0] = 1
        have = _power_cache[base] = np.cumprod(have)
    return have[:n]


class RollingHash:
    """Polynomial hashes of all stretches of a byte string."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * _powers(_BASE, len(data)), out=self.sums[1:])
        self.back = _powers(_BACK, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        return mix64((self.sums[k:] - self.sums[:-k]) * self.back[: len(self.sums) - k])


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, start, end, anchor, hash, anchor's place) of all segments of documents in one buffer."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
    if len(data) < length:
        return none
    rolling = RollingHash(data)
    grams = rolling.grams(min(GRAM, length))
    window = length - min(GRAM, length) + 1
    # least hash, and its first place, in each window of gram starts
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < window:
        least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.searchsorted(offsets, np.arange(len(place)), "right") - 1 if len(offsets) > 2 else np.zeros(len(place), np.int64)
    inside = np.arange(len(place)) + length <= offsets[doc + 1]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return none
    stops = np.flatnonzero(inside & np.append(~inside[1:] | new[1:], True))
    end = stops + length
    return doc[first], first, end, grams[place[first]], rolling.of(first, end), place[first]


# --- suffixes ------------------------------------------------------------------------------------


def sort_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes or more, by doubling."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), shape=(n,), strides=(1,)).astype(np.uint64)
    seen = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        if seen >= depth or new.all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        key = rank << np.uint64(32)
        if seen < n:
            key[: n - seen] |= rank[seen:]
        seen *= 2


def long_common_prefixes(text: np.ndarray, order: np.ndarray, least: int, first: int = 16) -> np.ndarray:
    """Whether each suffix shares ``least`` bytes or more with the one before it in ``order``.

    Breadth-first backward extension. Values below ``first`` are read off the text; an interval of
    suffixes with a common prefix of l bytes, whose end has value l - 1, is extended by each byte
    before it, and the end of the new interval gets value l unless it has a smaller one.
    """
    n = len(text)
    first = min(first, least)
    padded = np.concatenate([text, np.zeros(first, np.uint8)])
    known = np.zeros(n + 1, bool)  # boundaries with a value so far
    known[[0, n]] = True
    same = np.ones(n - 1, bool)
    value_before = np.zeros(n + 1, bool)  # value first - 1
    value_before[n] = True
    a, b = order[:-1], order[1:]
    for i in range(first):
        now = same & (padded[a + i] == padded[b + i])
        if i == first - 1:
            value_before[1:n] = same & ~now
        same = now
    known[1:n] = ~same
    before = text[order - 1]
    before[order == 0] = 0
    by_byte = np.argsort(before, kind="stable")  # row of the k-th suffix's tail
    forward = np.empty(n, np.int64)
    forward[by_byte] = np.arange(n)
    sorted_bytes = before[by_byte]
    alike = sorted_bytes[1:] == sorted_bytes[:-1]
    following, preceding = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    following[by_byte[:-1][alike]] = by_byte[1:][alike]
    preceding[by_byte[1:][alike]] = by_byte[:-1][alike]
    edges = np.flatnonzero(known)
    # all intervals of ``first`` common bytes; those whose end has value first - 1 are due
    low, high = edges[:-1], edges[1:]
    due = value_before[high]
    low, high = low[due], high[due]
    for level in range(first, least):
        if not len(low):
            break
        size = high - low
        ends = np.cumsum(size)
        row = np.repeat(low - (ends - size), size) + np.arange(int(ends[-1]))
        bound_low, bound_high = np.repeat(low, size), np.repeat(high, size)
        real = before[row] != 0
        new_low = np.sort(forward[row[real & (preceding[row] < bound_low)]])
        new_high = np.sort(forward[row[real & (following[row] >= bound_high)]]) + 1
        fresh = ~known[new_high]
        low, high = new_low[fresh], new_high[fresh]
        known[high] = True
    return ~known[:n]


def repeated_starts(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where strings of ``length`` bytes start that are in ``parts`` more than once, and the parts' offsets.

    Bytes count one up in the joined text, so that 0 can stand between parts; 255 shares 254's place
    only in sorting, and a last comparison tells them apart.
    """
    at = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    joined = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    text = np.minimum(joined, 254) + np.uint8(1)
    text[at[1:] - 1] = 0
    order = sort_suffixes(text, length)
    long = np.flatnonzero(long_common_prefixes(text, order, length))
    found = np.zeros(len(text), bool)
    a, b = order[long - 1], order[long]
    if (joined == 255).any() and len(long):  # not in UTF-8
        ok = np.array([joined[x : x + length].tobytes() == joined[y : y + length].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        a, b = a[ok], b[ok]
    found[a] = found[b] = True
    own = np.repeat(at[1:] - 1, np.diff(at))
    found &= np.arange(len(text)) + length <= own
    return np.flatnonzero(found), at


def _runs(start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by strings of ``length`` bytes at ascending starts."""
    if not len(start):
        return start, start
    gap = np.flatnonzero(np.diff(start) > length)
    return start[np.concatenate([[0], gap + 1])], start[np.concatenate([gap, [len(start) - 1]])] + length


def _lists(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(at.astype(np.int32), flat)


# --- operator ------------------------------------------------------------------------------------


def _documents(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _bitmap(keys: DataFrame, n: int) -> np.ndarray:
    """A bit map of ``h``, of bounded size, that lets through every key and some others."""
    bits = min(BITMAP_BITS, max(10, int(n * 16).bit_length()))
    mask = (1 << bits) - 1
    word, bit = F.shiftright(F.col("h").bitwiseAND(F.lit(mask)), 6), F.expr(f"shiftleft(1L, cast(h & {mask} & 63 as int))")
    out = np.zeros(1 << (bits - 6), np.int64)
    table = keys.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out[table.column("w").to_numpy()] = table.column("b").to_numpy()
    return out


def _passes(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.view(np.int64) & (len(bitmap) * 64 - 1)
    return (bitmap[at >> 6] >> (at & 63)) & 1 == 1


def _bwt_cover(length: int):
    """Covered stretches of a bucket's distinct segments."""

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        parts = table.column("content").to_pylist()
        start, at = repeated_starts(parts, length)
        of = np.searchsorted(at, start, "right") - 1
        cuts = np.searchsorted(of, np.arange(len(parts) + 1))
        lists = []
        for i in range(len(parts)):
            low, high = _runs(start[cuts[i] : cuts[i + 1]] - at[i], length)
            lists.append(np.stack([low, high], axis=1).reshape(-1))
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        return pa.table({"a": table.column("a"), "s": table.column("s"), "runs": _lists(np.concatenate(lists).astype(np.int32), ends)})

    return work


def _cut(length: int, width: int):
    """(a, s, off, n, content) cut to ranges of ``width`` offsets: (k, s, off, n, content, pa, ps, shift), k of range and core, s of the content."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, s, off, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = len(raw) - length  # strings start at 0 to last, their anchor is off - start bytes on
                for low in range(max(0, off - last) // width * width, off + 1, width):
                    first, stop = max(0, off - low - width + 1), min(last, off - low)
                    if first > stop:
                        continue
                    core, own = raw[off - low : off - low - width + 1 + length], raw[first : stop + length]
                    # the place of the anchor is part of a piece: equal pieces have equal strings at equal offsets
                    out.append((_digest(b"%d,%d," % (a, low) + core), _digest(b"%d," % (off - first) + own), off - first, n, own, a, s, first))
            yield pa.RecordBatch.from_pylist([dict(zip(_PIECES.names, row, strict=True)) for row in out], _PIECES)

    return work


_PIECES = pa.schema([("k", pa.int64()), ("s", pa.int64()), ("off", pa.int32()), ("n", pa.int64()), ("content", pa.binary()), ("pa", pa.int64()), ("ps", pa.int64()), ("shift", pa.int32())])


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _covered(contents: DataFrame, length: int, limit: int, widths: tuple[int, ...]) -> DataFrame:
    """a, s, runs of segments (a, s, off, n, content, size: bytes of all with that a): strings that also are in another segment of the same a."""
    small = contents.where(F.col("size") <= limit)
    total = small.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    buckets = max(1, -(-int(total) // limit))
    found = small.select("a", "s", "content", F.pmod(F.xxhash64("a"), F.lit(buckets)).alias("bucket")).groupBy("bucket").applyInArrow(_bwt_cover(length), "a long, s long, runs array<int>")
    large = contents.where(F.col("size") > limit).select("a", "s", "off", "n", "content")
    if not widths or large.isEmpty():
        return found
    schema = "k long, s long, off int, n long, content binary, pa long, ps long, shift int"
    pieces = scratch(large.mapInArrow(_cut(length, widths[0]), schema), "repeat-pieces")
    sized = F.octet_length("content").alias("size")
    kinds = scratch(pieces.select("k", "s", "off", "n", sized).groupBy("k", "s").agg(F.max("off").alias("off"), F.max("size").alias("size"), F.sum("n").alias("n")), "repeat-kinds")
    groups = kinds.groupBy("k").agg(F.count("*").alias("kinds"), F.sum("size").alias("bytes")).where("kinds > 1")
    due = kinds.join(groups, "k").select("k", "s", "n", "bytes")
    first = pieces.select("k", "s", "off", "content").dropDuplicates(["k", "s"])
    inner = first.join(due, ["k", "s"]).select(F.col("k").alias("a"), "s", "off", "n", "content", F.col("bytes").alias("size"))
    deeper = _covered(scratch(inner, "repeat-contents"), length, limit, widths[1:])
    whole = kinds.where("n > 1").select("k", "s", F.array(F.lit(0), F.col("size")).cast("array<int>").alias("runs"))
    runs = whole.union(deeper.select(F.col("a").alias("k"), "s", "runs"))
    back = pieces.select("k", "s", "pa", "ps", "shift").join(scratch(runs, "repeat-runs"), ["k", "s"])
    back = back.groupBy("pa", "ps").agg(F.flatten(F.collect_list(F.transform("runs", lambda r: (r + F.col("shift")).cast("int")))).alias("runs"))
    return found.union(back.toDF("a", "s", "runs"))


def repeats(df: DataFrame, length: int = 200, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, text, runs: the runs of bytes (start, end, start, ...) to remove from each row's text, in any order."""
    spark = df.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in string_chunks(batch.column(2), _CHUNK):
                doc, start, end, anchor, own, place = segments(buf, offsets, length)
                at = np.searchsorted(doc, np.arange(b - a + 1))
                packed = (start - offsets[doc]) << 32 | (end - start) << 16 | (place - start)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), *(_lists(x, at) for x in (anchor.view(np.int64), own.view(np.int64), packed))], ["row", "doc_id", "text", "a", "s", "pos"])

    docs = _documents(df).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = scratch(docs.mapInArrow(keyed, "row long, doc_id long, text string, a array<long>, s array<long>, pos array<long>"), "repeat-rows")
    size, off, begin = F.shiftright("pos", 16).bitwiseAND(F.lit(0xFFFF)).cast("int"), F.col("pos").bitwiseAND(F.lit(0xFFFF)).cast("int"), F.shiftright("pos", 32)
    spots = rows.select("row", F.explode(F.arrays_zip("a", "s", "pos")).alias("x")).select("row", "x.a", "x.s", "x.pos")
    kinds = scratch(spots.groupBy("a", "s").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min_by("pos", "row").alias("pos")), "repeat-segments")
    by_anchor = kinds.groupBy("a").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum(size).alias("bytes")).where("total > 1")
    by_anchor = scratch(by_anchor, "repeat-anchors")
    n_all = kinds.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(by_anchor.where(F.col("kinds") > n_all * HOT_SHARE))  # not more than 1 / HOT_SHARE rows
    joined = kinds.join(hot, "a").unionByName(kinds.join(hot.select("a"), "a", "left_anti").join(by_anchor, "a"))
    shared = scratch(joined.select("a", "s", "n", "row", "pos", "kinds", "bytes"), "repeat-shared")

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, due in enumerate(batch.column(1)):
                raw, made = memoryview(batch.column(0)[i].as_buffer()), due.as_py()
                cuts = [bytes(raw[d["pos"] >> 32 : (d["pos"] >> 32) + (d["pos"] >> 16 & 0xFFFF)]) for d in made]
                yield pa.RecordBatch.from_pylist([{"a": d["a"], "s": d["s"], "off": d["pos"] & 0xFFFF, "n": d["n"], "content": c, "size": d["bytes"]} for d, c in zip(made, cuts, strict=True)], _CONTENTS)

    # each distinct segment is cut out of the first row that has it
    due = shared.where("kinds > 1").groupBy("row").agg(F.collect_list(F.struct("a", "s", "pos", "n", "bytes")).alias("due"))
    texts = scratch(rows.select("row", "text").join(due, "row").select("text", "due").mapInArrow(contents, "a long, s long, off int, n long, content binary, size long"), "repeat-contents")
    covered = _covered(texts, length, bucket_bytes, WIDTHS).where(F.size("runs") > 0)
    moved = lambda runs: F.transform(runs, lambda r: r + begin).alias("runs")
    # a segment that occurs once is in the row that is known; those that repeat as wholes are looked for in all rows
    single = covered.join(shared.where("n = 1").select("a", "s", "row", "pos"), ["a", "s"]).select("row", moved("runs"))
    whole = shared.where("n > 1").select("a", "s", "n")
    often = {(r.a, r.s) for r in whole.where(F.col("n") > n_all * HOT_SHARE).collect()}  # not more than 1 / HOT_SHARE rows
    maybe = spark.sparkContext.broadcast((_bitmap(whole.select(F.col("a").bitwiseXOR(F.col("s")).alias("h")), whole.count()), often))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, often = maybe.value
        for batch in batches:
            a, s, pos = (c.flatten().to_numpy() for c in batch.columns[1:])
            row = np.repeat(batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy()))
            pick = np.flatnonzero(_passes(bitmap, (a ^ s).view(np.uint64)))
            sure = np.array([pair in often for pair in zip(a[pick].tolist(), s[pick].tolist(), strict=True)], bool) if often else np.zeros(len(pick), bool)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[pick]) for x in (row, a, s, pos)), pa.array(sure)], ["row", "a", "s", "pos", "sure"])

    likely = rows.select("row", "a", "s", "pos").mapInArrow(found, "row long, a long, s long, pos long, sure boolean")
    likely = scratch(likely, "repeat-likely")
    again = likely.where("sure").unionByName(likely.where("not sure").join(whole.select("a", "s"), ["a", "s"], "left_semi"))
    again = again.select("row", moved(F.array(F.lit(0), size)))
    by_row = scratch(single.union(again).groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs")), "repeat-runs")
    # only texts that may lose something are dealt out
    n_rows = by_row.count()
    bits = min(BITMAP_BITS, max(10, int(n_rows * 16).bit_length()))
    at = F.xxhash64("row").bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.expr(f"shiftleft(1L, cast(xxhash64(row) & {(1 << bits) - 1} & 63 as int))")
    words = F.broadcast(by_row.select(F.shiftright(at, 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")))  # not more than 2^(BITMAP_BITS - 6) rows
    flagged = rows.select("row", "doc_id", "text", F.shiftright(at, 6).alias("w"), bit.alias("own")).join(words, "w", "left")
    hit = F.coalesce(F.col("b").bitwiseAND(F.col("own")), F.lit(0)) != 0
    runs = F.coalesce("runs", F.array().cast("array<bigint>")).alias("runs")
    some = flagged.where(hit).select("row", "doc_id", "text").join(by_row, "row", "left").select("doc_id", "text", runs)
    return some.union(flagged.where(~hit).select("doc_id", "text", F.array().cast("array<bigint>").alias("runs")))


_CONTENTS = pa.schema([("a", pa.int64()), ("s", pa.int64()), ("off", pa.int32()), ("n", pa.int64()), ("content", pa.binary()), ("size", pa.int64())])


def removal_report(df: DataFrame, length: int = 200, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_buffer() if text.is_valid else b""
                spans = merge(runs.values.to_numpy()) if runs.is_valid and len(runs.values) else []
                made.append((len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(cut(bytes(data), spans)).hexdigest()))
            n, removed, spans, digest = zip(*made, strict=True) if made else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeats(df, length, **options).mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def merge(runs: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching stretches (start, end, start, ...)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(runs[0::2].tolist(), runs[1::2].tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])
