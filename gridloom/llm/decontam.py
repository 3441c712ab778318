"""Benchmark decontamination: windows of documents within a small edit distance of a benchmark item.

Texts are sequences of lower-cased words without punctuation. An item of n words is in a document if
some window is within floor(0.2 n) word edits of it (similarity 0.8 or more). Windows as long as items
are embedded by CGK's random walk, which turns edit into Hamming distance. Each repeat has a walk of
its own and samples a few positions of the embedding; windows look these samples up in an index of
the items' samples, and what they find is a candidate. The number of repeats for a length follows
from the wanted recall, by way of the chance that a window with all the edits allowed agrees with
its item in one repeat. An exact alignment decides on candidates.

Windows that share too few q-grams with every item of their length are not embedded: by the q-gram
lemma none of these is near an item, so this changes the work and not the result.

Null and empty texts, and texts without words, hold no items; items without words are in no
document. Rows with equal or null ids each give a row. Repeated items count once. An empty table gives no rows. Of other
columns nothing is read, and ``keep_clean`` returns all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ALNUM, FlatText, code_points, flat_chunks, hash_spans, mix64, scratch, shingle_hashes, string_chunks

#: Benchmark text of one index; a larger benchmark takes several, one after the other.
SLICE_BYTES = 4 << 20
#: Positions sampled of an embedding, and the share of windows at the limit of edits that must become candidates.
SAMPLED, RECALL = 3, 0.98
_FILTER_BITS = 20
_WINDOWS = 256


def edits_allowed(n: np.ndarray | int, share: float = 0.2):
    return np.floor(np.asarray(n) * share + 1e-9).astype(np.int64)


@lru_cache(maxsize=64)
def _walks(n: int, repeats: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers that decide each step of each walk, and which steps' words are sampled."""
    rng = np.random.default_rng([seed, n])
    # a walk is through a window of n words after 2 n steps, on average; repeats draw one after the other
    odd = np.empty((repeats, 2 * n), np.uint64)
    sampled = np.zeros((repeats, 2 * n), bool)
    for r in range(repeats):
        odd[r] = rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        sampled[r, rng.permutation(2 * n)[: min(SAMPLED, 2 * n)]] = True
    return odd.T.copy(), sampled.T.copy()


def embed(windows: np.ndarray, n: int, repeats: int, seed: int) -> np.ndarray:
    """CGK: (windows x repeats) hashes of the sampled positions of the random walks through windows of n words."""
    odd, sampled = _walks(n, repeats, seed)
    padded = np.concatenate([windows, np.zeros((len(windows), 1), np.uint64)], axis=1)
    row, at = np.arange(len(windows))[:, None], np.zeros((len(windows), repeats), np.int64)
    out = np.broadcast_to(mix64(np.arange(1, repeats + 1, dtype=np.uint64)), at.shape).copy()
    for j in range(2 * n):
        now = padded[row, at]
        if sampled[j].any():
            out = np.where(sampled[j], (out + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ now * np.uint64(0xD6E8FEB86659FD93), out)
        at = np.minimum(at + ((now * odd[j]) >> np.uint64(63)).astype(np.int64), n)
    return mix64(out)


@lru_cache(maxsize=4096)
def repeats_for(n: int, edits: int, recall: float, seed: int = 11) -> int:
    """Repeats after which a window with so many random edits has agreed at least once, with probability ``recall`` on average."""
    rng = np.random.default_rng([seed, n, edits, 1])
    trials, walks, agreed = 24, 192, []
    for _ in range(trials):
        item = rng.integers(1, 2**63, n, dtype=np.uint64)
        window = item.tolist()
        for _ in range(edits):
            k, how = rng.integers(0, max(len(window), 1)), rng.integers(0, 3)
            window[k : k + (1 if how < 2 else 0)] = [] if how == 0 else [int(rng.integers(1, 2**63))]
        window = (window + rng.integers(1, 2**63, n).tolist())[:n]
        a, b = embed(np.array([item, window], np.uint64), n, walks, seed)
        agreed.append((float((a == b).sum()) + 0.5) / (walks + 1))
    miss, repeats = 1 - np.array(agreed), 1
    while 1 - (miss**repeats).mean() < recall:
        repeats += 1 + repeats // 16
    return repeats


class ItemIndex:
    """Items' words, the samples of their embeddings by length, and their q-grams with the items and places they are from."""

    def __init__(self, ids: list[int], texts: list[str], share: float = 0.2, recall: float = RECALL, prefilter: bool = True, seed: int = 11):
        raw = [t.encode() for t in texts]
        flat = FlatText(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), lower=True)
        words, at = flat.word_hashes(ALNUM)
        n = np.diff(at)
        self.ids, self.n, self.edits, self.seed, self.prefilter = ids, n, edits_allowed(n, share), seed, prefilter
        self.words = [words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.samples: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for size in np.unique(n[n > 0]).tolist():
            rows = np.flatnonzero(n == size)
            repeats = repeats_for(size, int(self.edits[rows[0]]), recall, seed)
            keys = embed(np.stack([self.words[i] for i in rows]), size, repeats, seed)
            order = np.argsort(keys.reshape(-1), kind="stable")
            self.samples[size] = repeats, keys.reshape(-1)[order], np.repeat(rows, repeats)[order]
        # the longest q-grams of which edits must leave one
        self.q = np.select([n - 2 - 3 * self.edits >= 1, n - 1 - 2 * self.edits >= 1], [3, 2], 1)
        self.least = np.maximum(n - self.q + 1 - self.q * self.edits, 1)
        self.grams = {}
        for q in (1, 2, 3):
            rows = np.flatnonzero((self.q == q) & (n > 0))
            if len(rows):
                own = np.concatenate([self.words[i] for i in rows])
                h, ends = shingle_hashes(own, np.concatenate([[0], np.cumsum(n[rows])]), q)
                item = np.repeat(rows, np.diff(ends))
                place = np.arange(len(h)) - np.repeat(ends[:-1], np.diff(ends))
                order = np.argsort(h, kind="stable")
                keys, first = np.unique(h[order], return_index=True)
                seen = np.zeros(1 << _FILTER_BITS, bool)
                seen[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
                self.grams[q] = (keys, np.append(first, len(h)), item[order], place[order], seen)

    def hits(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, diagonal) of every shared q-gram; a diagonal is where the item's first word would be."""
        parts = []
        for q, (keys, first, item, place, seen) in self.grams.items():
            h, ends = shingle_hashes(words, at, q)
            maybe = np.flatnonzero(seen[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            spot = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            true = keys[spot] == h[maybe]
            maybe, spot = maybe[true], spot[true]
            many = first[spot + 1] - first[spot]
            post = np.repeat(first[spot] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            doc = np.searchsorted(ends, maybe, "right") - 1
            where = np.repeat(maybe - ends[doc], many)
            parts.append((np.repeat(doc, many), item[post], where - place[post]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3

    def windows(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(document, length, starts) of the windows to embed, by document."""
        if not self.prefilter:
            for d in np.flatnonzero(np.diff(at)).tolist():
                for n in self.samples:
                    yield d, n, np.arange(1 - n, int(at[d + 1] - at[d]))
            return
        doc, item, diagonal = self.hits(words, at)
        order = np.lexsort((diagonal, item, doc))
        doc, item, diagonal = doc[order], item[order], diagonal[order]
        if not len(doc):
            return
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
        ends = np.append(first[1:], len(doc))
        due: dict[tuple[int, int], list[np.ndarray]] = {}
        for a, b in zip(first.tolist(), ends.tolist(), strict=True):
            d, i = int(doc[a]), int(item[a])
            if b - a >= self.least[i]:
                # starts with enough q-grams within the edits' reach
                own, reach = diagonal[a:b], int(self.edits[i])
                enough = np.searchsorted(own, own + 2 * reach, "right") - np.arange(len(own)) >= self.least[i]
                due.setdefault((d, int(self.n[i])), []).append((own[enough][:, None] + np.arange(2 * reach + 1)[None, :]).reshape(-1))
        for (d, n), parts in due.items():
            starts = np.unique(np.concatenate(parts))
            yield d, n, starts[(starts > -n) & (starts < at[d + 1] - at[d])]

    def candidates(self, words: np.ndarray, n: int, starts: np.ndarray) -> dict[int, list[int]]:
        """By item, the starts of the windows of n words that share a sample with it."""
        repeats, keys, rows = self.samples[n]
        out: dict[int, list[int]] = {}
        for a in range(0, len(starts), _WINDOWS):
            part = starts[a : a + _WINDOWS]
            pick = part[:, None] + np.arange(n)[None, :]
            inside = np.where((pick >= 0) & (pick < len(words)), words[np.clip(pick, 0, len(words) - 1)], np.uint64(0))
            asked = embed(inside, n, repeats, self.seed).reshape(-1)
            low, high = np.searchsorted(keys, asked), np.searchsorted(keys, asked, "right")
            many = high - low
            post = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            window = np.repeat(np.repeat(np.arange(len(part)), repeats), many)
            for i, w in np.unique(np.stack([rows[post], window], axis=1), axis=0).tolist():
                out.setdefault(i, []).append(int(part[w]))
        return out

    def near(self, item: int, words: np.ndarray, starts: list[int]) -> tuple[int, int] | None:
        """First and last + 1 word of the document that is nearest to the item, if it is near enough; ``starts`` ascend."""
        n, reach = int(self.n[item]), int(self.edits[item])
        best = None
        # windows side by side are aligned together
        for run in np.split(np.array(starts, np.int64), np.flatnonzero(np.diff(starts) > 1) + 1):
            low, high = max(0, int(run[0]) - reach), min(len(words), int(run[-1]) + n + reach)
            found = align(self.words[item], words[low:high])
            if found[0] <= reach and found[2] > found[1] and (best is None or found[0] < best[0]):
                best = (found[0], low + found[1], low + found[2])
        return best and best[1:]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to any stretch of ``text``, and that stretch: the last end, then the last start."""
    m = len(text)
    one = m + 1  # of one edit; what is added is how far before the end the stretch starts
    steps = one * np.arange(m + 1)
    state = m - np.arange(m + 1)
    for w in item:
        new = state + one
        np.minimum(new[1:], state[:-1] + one * (text != w), out=new[1:])
        state = np.minimum.accumulate(new - steps) + steps
    cost = state // one
    end = m - int(np.argmin(cost[::-1]))
    return int(cost[end]), m - int(state[end] % one), end


def _indexes(benchmark: DataFrame, share: float, recall: float, prefilter: bool) -> Iterator[tuple[Broadcast, bool]]:
    """One index after the other, each of about SLICE_BYTES of text and gone from the executors when the next is asked for; and whether it is the last."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-int(size) // SLICE_BYTES))
    spark = benchmark.sparkSession
    for k in range(n):
        part = sorted((r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect())
        sent = spark.sparkContext.broadcast(ItemIndex([i for i, _ in part], [t for _, t in part], share, recall, prefilter))
        yield sent, k == n - 1
        sent.unpersist()


def _found(index: ItemIndex, column: pa.Array) -> list[list[tuple[int, int, int]]]:
    """For each text the items found and their stretch in bytes, by item and start."""
    out: list[list[tuple[int, int, int]]] = []
    for _, _, flat in flat_chunks(column, lower=True):
        begin, length, at = flat.words(ALNUM)
        words = hash_spans(flat.buf, begin, length) if len(begin) else np.zeros(0, np.uint64)
        got: list[list[tuple[int, int, int]]] = [[] for _ in range(flat.n)]
        for d, n, starts in index.windows(words, at):
            a, b, byte = int(at[d]), int(at[d + 1]), int(flat.offsets[d])
            for i, some in index.candidates(words[a:b], n, starts).items():
                near = index.near(i, words[a:b], some)
                if near:
                    last = a + near[1] - 1
                    got[d].append((index.ids[i], int(begin[a + near[0]]) - byte, int(begin[last] + length[last]) - byte))
        out += got
    return out


_MATCHES = "array<struct<item_id:bigint,start:bigint,end:bigint>>"
_MATCH_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def _matches(sent: Broadcast):
    """Batches of (key, ..., text) become (key, ..., found), positions in code points."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            rows = _found(sent.value, texts)
            for a, b, buf, offsets in string_chunks(texts):
                for i in range(a, b):
                    if rows[i]:
                        item, start, end = zip(*rows[i], strict=True)
                        points = code_points(buf[offsets[i - a] : offsets[i - a + 1]], np.array([start, end])).tolist()
                        rows[i] = sorted(set(zip(item, *points, strict=True)))
            made = pa.array([[{"item_id": k, "start": s, "end": e} for k, s, e in row] for row in rows], _MATCH_TYPE)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*batch.schema.names[:-1], "found"])

    return work


def find_items(df: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = RECALL, prefilter: bool = True) -> DataFrame:
    """doc_id and ``found``: (item_id, start, end) in code points, the nearest stretch for each item.

    With one index no row is shuffled. With several, each takes a pass over the documents, which are
    written once with keys; what passes find is written and joined by key at the end.
    """
    docs, parts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), []
    for sent, last in _indexes(benchmark, share, recall, prefilter):
        if last and not parts:
            return docs.mapInArrow(_matches(sent), f"doc_id long, found {_MATCHES}")
        if not parts:
            docs = scratch(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "clean-docs")
        parts.append(scratch(docs.select("row", "text").mapInArrow(_matches(sent), f"row long, found {_MATCHES}").where(F.size("found") > 0), "clean-found"))
    together = parts[0]
    for part in parts[1:]:
        together = together.union(part)
    found = together.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    return docs.select("row", "doc_id").join(found, "row", "left").select("doc_id", F.coalesce("found", F.array().cast(_MATCHES)).alias("found"))


def contamination_report(df: DataFrame, benchmark: DataFrame, share: float = 0.2, **options) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids and spans (item:start:end in code points, comma-joined)."""
    ids = F.array_distinct(F.transform("found", lambda x: x["item_id"]))
    line = lambda x: F.concat_ws(":", x["item_id"].cast("string"), x["start"].cast("string"), x["end"].cast("string"))
    return find_items(df, benchmark, share, **options).select(
        "doc_id",
        (F.size("found") > 0).alias("contaminated"),
        F.size(ids).cast("long").alias("n_items"),
        F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("item_ids"),
        F.array_join(F.transform("found", line), ",").alias("spans"),
    )


def keep_clean(df: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = RECALL) -> DataFrame:
    """The rows of ``df`` that hold no benchmark item, whole and in their schema; no row is shuffled."""
    where = df.columns.index("text")
    for sent, last in _indexes(benchmark, share, recall, True):

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not got for got in _found(sent.value, batch.column(where).cast(pa.string()))], pa.bool_()))

        clean = df.mapInArrow(work, df.schema)
        df = clean if last else scratch(clean, "clean-left")
    return df
