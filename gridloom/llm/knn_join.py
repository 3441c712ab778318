"""Exact top-k by inner product: a Voronoi kNN join.

Pivots, about the square root of the number of vectors, cut the space into cells. Each cell's summary
(count, radius, the nearest members' distances to the pivot) bounds every inner product of a query
with the cell's vectors from above, and from below what a query surely gets. A query goes only to the
cells whose upper bound reaches the (k+1)-st best of its lower bounds, and data only to groups of
queries that need their cell; there, blocks of bounded size are solved exactly and the best of all
blocks are kept. How much this spares depends on the data: ``needed_cells`` tells.

Components are floor(256 x). A vector takes no part if it is null, empty or holds a null or
non-finite component, or if its id is null. Shorter vectors count as if padded with zeros. Rows
with equal ids are one vector's repeats: none is another's candidate, and an id's result is that of
its smallest vector. Finite components may be of any size; a score that no long holds is given as the
nearest long, and such scores tie. No candidates: no rows. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import scratch

#: Least and most pivots; summaries sent to the driver hold so many rows.
PIVOTS = (16, 1024)
#: Vectors in one block of data or queries.
DATA_BLOCK, QUERY_BLOCK = 8192, 2048
#: Vectors longer than this are multiplied in Python's integers: products of others are exact in 64-bit floats.
_LONG = 2.0**26
_LEAST, _MOST = -(2**63), 2**63 - 1


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: the vectors that take part, one an id, as doubles."""
    x = F.col(vector_col)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    good = df.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(~odd)
    return good.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: c.cast("double")).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """floor(256 x) as doubles, exact unless infinite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy()
    flat, size = column.flatten().to_numpy(), np.diff(at)
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(column)), size)
    with np.errstate(over="ignore"):
        out[row, np.arange(len(flat)) - np.repeat(at[:-1] - at[0], size)] = np.floor(256 * flat)
    return out


def _integers(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    """floor(256 x) of some rows as Python integers."""
    out = np.zeros((len(rows), dim), object)
    for i, r in enumerate(rows.tolist()):
        for j, x in enumerate(column[r].as_py()):
            out[i, j] = int(x) * 256 if abs(x) >= 2.0**53 else int(np.floor(256 * x))
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x**2).sum(axis=1))


def _assign(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, v, cell, dist: the nearest pivot and the distance to it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            norms = (pivots**2).sum(axis=1)
            for batch in batches:
                x = _matrix(batch.column(1), pivots.shape[1])
                cell = np.argmin(norms[None, :] - 2 * x @ pivots.T, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(_norms(x - pivots[cell]))], ["vec_id", "v", "cell", "dist"])

    return df.mapInArrow(work, "vec_id long, v array<double>, cell int, dist double")


def _needs(pivots: np.ndarray, radius: np.ndarray, nearest: np.ndarray, k: int):
    """The cells that each query needs. ``radius`` by cell; ``nearest``: (cell, distance) of some members of each."""
    cell_of, gap = nearest[:, 0].astype(np.int64), nearest[:, 1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, lists = _matrix(batch.column(1), pivots.shape[1]), []
            with np.errstate(all="ignore"):
                for a in range(0, len(x), 256):
                    q = x[a : a + 256]
                    size, inner = _norms(q)[:, None], q @ pivots.T
                    slack = 1e-9 * (np.abs(inner) + size * (1 + radius[None, :])) + 1e-6
                    sure = inner[:, cell_of] - size * gap[None, :] - slack[:, cell_of]
                    # one of the k + 1 may be the query itself
                    floor = np.full(len(q), -np.inf) if len(gap) <= k else np.partition(np.nan_to_num(sure, nan=-np.inf), len(gap) - k - 1, axis=1)[:, len(gap) - k - 1]
                    spared = inner + size * radius[None, :] + slack < floor[:, None]
                    lists += [np.flatnonzero(~s) for s in spared]
            ends = np.concatenate([[0], np.cumsum([len(c) for c in lists])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, np.concatenate([*lists, []]).astype(np.int32))], ["vec_id", "v", "cell", "dist", "needs"])

    return work


def _best(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k best scores, ties to the smaller column; ``own`` are left out."""
    scores[own] = -np.inf
    k = min(k, scores.shape[1])
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
    above = scores > kth
    tied = (scores == kth) & (scores > -np.inf)
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (tied & (np.cumsum(tied, axis=1) <= room)))


def _exactly(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The k best of each query among these vectors, in Python's integers."""
    out = []
    for i, row in zip(q_ids.tolist(), q, strict=True):
        scored = ((-min(max(int(s), _LEAST), _MOST), j) for s, j in zip(x.dot(row), ids.tolist(), strict=True) if j != i)
        out += [(i, j, -s) for s, j in sorted(scored)[:k]]
    return out


def _solve(k: int, dim: int):
    def work(key, data: pa.Table, queries: pa.Table) -> pa.Table:
        data = data.sort_by([("vec_id", "ascending")]).combine_chunks()
        ids, q_ids = data.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
        x, q = _matrix(data.column("v"), dim), _matrix(queries.column("q"), dim)
        small_x, small_q = _norms(x) < _LONG, _norms(q) < _LONG
        parts = []
        if small_x.any():
            xt, near_ids = np.ascontiguousarray(x[small_x].T), ids[small_x]
            asked, asked_ids = q[small_q], q_ids[small_q]
            for a in range(0, len(asked), 256):
                scores = asked[a : a + 256] @ xt
                rows, columns = _best(scores, asked_ids[a : a + 256, None] == near_ids[None, :], k)
                parts.append((asked_ids[a + rows], near_ids[columns], scores[rows, columns].astype(np.int64)))
        every_x, every_q = np.arange(len(ids)), np.arange(len(q_ids))
        for some_q, some_x in ((every_q[small_q], every_x[~small_x]), (every_q[~small_q], every_x)):
            if len(some_q) and len(some_x):
                found = _exactly(_integers(queries.column("q"), some_q, dim), q_ids[some_q], _integers(data.column("v"), some_x, dim), ids[some_x], k)
                parts += [tuple(np.array(c, np.int64) for c in zip(*found, strict=True))] if found else []
        merged = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), merged, strict=True)))

    return work


def needed_cells(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None):
    """What a join would do: (data with cells, queries with the cells that each needs, vectors by cell, longest vector); None without vectors."""
    vectors = scratch(usable(df, id_col, vector_col), "knn-vectors")
    n, dim = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return None
    # the pivots: a bounded choice by hash, spread over the data
    count = pivots or int(np.clip(np.ceil(np.sqrt(n)), *PIVOTS))
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).select("v").toArrow()
    points = _matrix(chosen.column(0), dim)
    data = scratch(_assign(vectors, points), "knn-cells")
    summary = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).toArrow()
    sizes = dict(zip(summary.column("cell").to_pylist(), summary.column("n").to_pylist(), strict=True))
    radius = np.full(len(points), -np.inf)
    radius[summary.column("cell").to_numpy()] = summary.column("radius").to_numpy()
    by_dist = Window.partitionBy("cell").orderBy("dist", "vec_id")
    nearest = data.select("cell", "dist", F.row_number().over(by_dist).alias("at")).where(F.col("at") <= k + 1).select(F.col("cell").cast("double"), "dist").toArrow()
    work = _needs(points, radius, np.stack([nearest.column(0).to_numpy(), nearest.column(1).to_numpy()], axis=1), k)
    queries = data.where(is_query).mapInArrow(work, "vec_id long, v array<double>, cell int, dist double, needs array<int>")
    return data, scratch(queries, "knn-queries"), sizes, dim


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates. ``is_query`` is over ``vec_id``."""
    spark, schema = df.sparkSession, "query_id long, rank int, vec_id long, score long"
    planned = needed_cells(df, is_query, k, id_col, vector_col, pivots)
    if planned is None:
        return spark.createDataFrame([], schema)
    data, queries, cells, dim = planned
    asked = dict(tuple(r) for r in queries.groupBy("cell").count().collect())
    pairs = queries.select("cell", F.explode("needs").alias("need")).distinct().toArrow()  # at most the square of the pivots
    wanted: dict[int, list[int]] = {i: [] for i in asked}
    for i, j in zip(pairs.column(0).to_pylist(), pairs.column(1).to_pylist(), strict=True):
        if j in cells:
            wanted[i].append(j)
    # query groups: cells with few queries share one, cells with many are cut
    group_of: dict[int, tuple[int, int]] = {}
    filled, group, needs = QUERY_BLOCK, -1, {}
    for i in sorted(asked, key=lambda c: (sorted(wanted[c]), c)):
        cuts = -(-asked[i] // QUERY_BLOCK)
        if cuts > 1 or filled + asked[i] > QUERY_BLOCK:
            group, filled = group + 1, 0
        group_of[i] = (group, cuts)
        for g in range(group, group + cuts):
            needs.setdefault(g, set()).update(wanted[i])
        filled += asked[i] if cuts == 1 else QUERY_BLOCK
        group += cuts - 1
    to_groups: dict[int, list[int]] = {j: [] for j in cells}
    for g, js in needs.items():
        for j in js:
            to_groups[j].append(g)
    rows = [(j, max(1, -(-n // DATA_BLOCK)), sorted(to_groups[j]), *group_of.get(j, (0, 1))) for j, n in cells.items()]
    plan = F.broadcast(spark.createDataFrame(rows, "cell int, blocks int, groups array<int>, g0 int, cuts int"))  # one row a pivot
    salt = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
    sent = data.join(plan, "cell").select("vec_id", "v", "cell", salt("blocks", 1).alias("block"), F.explode("groups").alias("g"))
    asking = queries.join(plan, "cell").select("vec_id", "v", (F.col("g0") + salt("cuts", 2)).alias("g"), F.explode("needs").alias("cell")).join(plan.select("cell", "blocks"), "cell")
    asking = asking.select("g", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "v").toDF("to", "of", "part", "query_id", "q")
    local = sent.groupBy("g", "cell", "block").cogroup(asking.groupBy("to", "of", "part")).applyInArrow(_solve(k, dim), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
