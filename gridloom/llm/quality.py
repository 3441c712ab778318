"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

A text becomes a short vector of statistics (shares of character classes, word and line repetition,
lengths). Random cosine features of the standardised vector approximate a Gaussian kernel; ridge
weights solve normal equations that partitions sum up. Folds' sums, each left out in turn, give
every training row a score from a model that hasn't seen it; isotonic regression on those makes
scores into probabilities.

Null and empty texts have the vector of an empty text and get a score like any other. Rows with
equal or null ids each give a row. Labels that are null don't count; several labels of an id are
averaged. Without any labelled training row every score is 0.5. An empty table gives no rows.
Only doc_id and text of the documents and doc_id and the label column of the labels are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import FlatText, crc_mod, flat_chunks, hash_spans, scratch

#: Rows of labels that a fit takes at most; a hash of the id chooses them where there are more.
MAX_TRAIN = 200_000
FOLDS = 4
#: Tasks that sum normal equations, each sending FOLDS matrices to the driver.
SUMMING_TASKS = 8
CALIBRATION_BINS = 2000
_LOW, _HIGH = -0.5, 1.5

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:?",
    "bang": b"!",
    "bar": b"|",
    "sign": b"#$%&*@^~=+<>/\\",
    "quote": b"'\"`()[]{}_-",
    "line": b"\n",
    "blank": b" \t\r\v\f",
}
_TABLE = np.full(256, len(_CLASSES), np.uint8)
for _i, _members in enumerate(_CLASSES.values()):
    _TABLE[list(_members)] = _i
N_FEATURES = len(_CLASSES) + 1 + 12


def _repetition(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: share of distinct items, share of the commonest, share equal to the item before."""
    n = np.diff(at)
    many = np.maximum(n, 1)
    doc = np.repeat(np.arange(len(n)), n)
    same = np.zeros(len(hashes), np.int64)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    if not len(hashes):
        zero = np.zeros(len(n))
        return zero, zero, zero
    key = hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    distinct, most = np.zeros(len(n)), np.zeros(len(n))
    np.add.at(distinct, doc[first], 1)
    np.maximum.at(most, doc[first], count)
    return distinct / many, most / many, np.bincount(doc, same, len(n)) / many


def statistics(flat: FlatText) -> np.ndarray:
    """One row of N_FEATURES numbers for each document."""
    size, offsets = int(flat.offsets[-1]), flat.offsets
    n = np.diff(offsets)
    some = np.maximum(n, 1)
    kinds = _TABLE[flat.buf[:size]]
    doc = np.repeat(np.arange(flat.n), n)
    shares = np.bincount(doc * 11 + kinds, minlength=flat.n * 11).reshape(flat.n, 11) / some[:, None]
    start, length, at = flat.words()
    words = np.diff(at)
    many = np.maximum(words, 1)
    total, squares = np.add.reduceat, length.astype(np.float64) ** 2
    sums = lambda x: np.where(words > 0, total(np.append(x, 0), np.minimum(at[:-1], len(x))), 0)
    mean = sums(length.astype(np.float64)) / many
    spread = np.sqrt(np.maximum(sums(squares) / many - mean**2, 0))
    ends = flat.buf[start + length - 1] if len(start) else np.zeros(0, np.uint8)
    odd = sums(np.isin(_TABLE[ends], [4, 5, 6]).astype(np.float64)) / many
    caps = sums((_TABLE[flat.buf[start]] == 0).astype(np.float64)) / many if len(start) else np.zeros(flat.n)
    distinct, most, again = _repetition(hash_spans(flat.buf, start, length), at)
    cut = np.union1d(np.flatnonzero(flat.buf[:size] == 10) + 1, offsets[:-1])
    cut = cut[cut < size]
    line_at = np.searchsorted(cut, offsets)
    lines, top_line, _ = _repetition(hash_spans(flat.buf, cut, np.diff(np.append(cut, size))), line_at)
    more = [np.log1p(n), np.log1p(words), mean, spread, odd, caps, distinct, most, again, lines, top_line, np.log1p(np.diff(line_at))]
    return np.column_stack([shares, *more])


def features(df: DataFrame, *extra: Column) -> DataFrame:
    """doc_id, the ``extra`` columns, and ``f``: the statistics of the whole text."""
    chosen = df.select(F.col("text").cast("string").alias("__text"), F.col("doc_id").cast("long").alias("doc_id"), *extra)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(flat) for _, _, flat in flat_chunks(batch.column(0))]
            f = np.concatenate(rows) if rows else np.zeros((0, N_FEATURES))
            made = pa.ListArray.from_arrays(np.arange(len(f) + 1, dtype=np.int32) * N_FEATURES, f.astype(np.float32).reshape(-1))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], [*batch.schema.names[1:], "f"])

    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in chosen.schema.fields[1:])
    return chosen.mapInArrow(work, f"{kinds}, f array<float>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def expand(self, f: np.ndarray) -> np.ndarray:
        x = np.clip((f - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(x @ self.w + self.b) * np.sqrt(2 / self.w.shape[1]), x / 10, np.ones((len(x), 1))])

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.knots, self.values), 0, 1)

    def score(self, f: np.ndarray) -> np.ndarray:
        return self.calibrated(self.expand(f) @ self.beta) if len(self.beta) else np.full(len(f), 0.5)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the non-decreasing fit's knots and values; ``x`` ascends."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x.tolist(), y.tolist(), weight.tolist(), strict=True):
        blocks.append([yi, wi, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            w = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]])
    return np.array([v for b in blocks for v in (b[2], b[3])]), np.array([b[0] for b in blocks for _ in (0, 1)])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), N_FEATURES).astype(np.float64)


def fit(train: DataFrame, n_random: int = 256, ridge: float = 1.0, bandwidth: float = 5.0, seed: int = 5) -> Model:
    """Model from rows doc_id, f, y (0 to 1), a written table: it is read several times."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(N_FEATURES, n_random)) / bandwidth, rng.uniform(0, 2 * np.pi, n_random)
    train = train.where(F.col("y").isNotNull() & F.col("f").isNotNull())
    moments = train.agg(*[g(F.col("f")[i].cast("double")) for i in range(N_FEATURES) for g in (F.avg, F.stddev_pop)]).first()
    if moments[0] is None:
        zero = np.zeros(0)
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), w, b, zero, zero, zero)
    mean, scale = np.array(moments[0::2]), np.array(moments[1::2])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), w, b, np.zeros(0), np.zeros(0), np.zeros(0))
    dealt = train.select("f", F.col("y").cast("double").alias("y"), F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(FOLDS)).cast("int").alias("fold")).repartition(SUMMING_TASKS, "fold", F.pmod(F.hash("doc_id"), F.lit(SUMMING_TASKS)))
    size = n_random + N_FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            z, y, fold = model.expand(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            for k in range(FOLDS):
                own = z[fold == k]
                total[k] += own.T @ np.column_stack([own, y[fold == k]])
        kept = [k for k in range(FOLDS) if total[k, -1, -2]]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array([total[k].tobytes() for k in kept], pa.binary())], ["fold", "sums"])

    total = np.zeros((FOLDS, size, size + 1))
    for row in dealt.mapInArrow(sums, "fold int, sums binary").collect():
        total[row.fold] += np.frombuffer(row.sums).reshape(size, size + 1)
    solve = lambda m: np.linalg.solve(m[:, :size] + ridge * np.diag(np.append(np.ones(size - 1), 1e-6)), m[:, size])
    everything = total.sum(axis=0)
    without = np.stack([solve(everything - total[k]) for k in range(FOLDS)])

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, good = np.zeros(CALIBRATION_BINS), np.zeros(CALIBRATION_BINS)
        for batch in batches:
            z, y, fold = model.expand(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            raw = np.einsum("ij,ij->i", z, without[fold])
            at = np.clip((raw - _LOW) / (_HIGH - _LOW) * CALIBRATION_BINS, 0, CALIBRATION_BINS - 1).astype(int)
            count += np.bincount(at, minlength=CALIBRATION_BINS)
            good += np.bincount(at, y, CALIBRATION_BINS)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at]), pa.array(good[at])], ["at", "n", "good"])

    bins = sorted(dealt.mapInArrow(unseen, "at int, n double, good double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect())
    at, count, good = np.array([[r["at"], r["n"], r["good"]] for r in bins]).T
    model.beta = solve(everything)
    model.knots, model.values = isotonic(_LOW + (at + 0.5) * (_HIGH - _LOW) / CALIBRATION_BINS, good / count, count)
    return model


def training_labels(labels: DataFrame, label: str, folds: int, max_train: int, seed: int = 5) -> DataFrame:
    """id and y, the mean label, of the ids to learn from: at most about ``max_train``, so they can go to all executors."""
    doc_id = F.col("doc_id").cast("long")
    y = labels.where(F.col(label).isNotNull() & doc_id.isNotNull() & (crc_mod("doc_id", folds) != 0)).groupBy(doc_id.alias("id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    y = scratch(y, "quality-labels")
    if (n := y.count()) > max_train:
        y = y.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(1e6 * max_train / n))
    return F.broadcast(y)


def score_documents(df: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, folds: int = 5, max_train: int = MAX_TRAIN, **fit_options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels are learnt from ids whose crc32 mod ``folds`` isn't 0."""
    feats = scratch(features(df, (crc_mod("doc_id", folds) == 0).alias("held_out")), "quality")
    chosen = training_labels(labels, label, folds, max_train)
    model = fit(scratch(feats.join(chosen, F.col("doc_id") == F.col("id")).select("doc_id", "f", "y"), "quality-train"), **fit_options)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return feats.select("doc_id", "held_out", "f").mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(df: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, folds: int = 5, max_train: int = MAX_TRAIN, **fit_options) -> DataFrame:
    """The rows of ``df`` that the classifier accepts, whole and in their schema; no row is shuffled.

    Statistics of the training texts are worked out and written once, those of all texts where they are judged.
    """
    chosen = training_labels(labels, label, folds, max_train)
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, F.col("doc_id") == F.col("id"))
    model = fit(scratch(features(texts, F.col("y")), "quality-train"), **fit_options)
    where = df.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(flat) for _, _, flat in flat_chunks(batch.column(where))]
            if rows:
                yield batch.filter(pa.array(model.score(np.concatenate(rows)) >= threshold))

    return df.mapInArrow(work, df.schema)
