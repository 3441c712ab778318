"""Connected components of an edge table, distributed: no edge or label list ever meets in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import salted_join, scratch


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's batches, each batch's edges becoming a forest of stars."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        nodes, at = np.unique(ends, return_inverse=True)
        a, b = at.reshape(2, -1)
        parent = list(range(len(nodes)))
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            while parent[y] != y:
                parent[y] = parent[parent[y]]
                y = parent[y]
            if x != y:  # nodes ascend, so the smaller position is the smaller id
                parent[max(x, y)] = min(x, y)
        roots = np.array(parent)
        while True:
            above = roots[roots]
            if (above == roots).all():
                break
            roots = above
        moved = np.flatnonzero(roots != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[roots[moved]])], ["a", "b"])


def _with_lowest(edges: DataFrame, label: str) -> DataFrame:
    """u, v, low: each u's least neighbour. Rows of a hub don't meet."""
    low = scratch(edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")), label)
    total = low.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return salted_join(edges, low.drop("n"), "u", "v", low, total)


def _stars(edges: DataFrame, label: str) -> DataFrame:
    """One large-star and one small-star step over edges (a > b)."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    large = _with_lowest(both, label).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
    joined = _with_lowest(scratch(large.distinct(), label), label)
    small = joined.where("v <> low").select(F.col("v").alias("a"), F.col("low").alias("b")).union(joined.select("u", "low")).toDF("a", "b")
    return small.where("a <> b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node with an edge; ``edges`` has two id columns. component: the smallest id reachable.

    Nulls and self-links are left out; direction and repeats don't matter. Alternating large and
    small stars until nothing changes, each round restarting from a written table.
    """
    a, b = edges.columns[:2]
    clean = edges.select(F.greatest(F.col(a), F.col(b)).cast("long").alias("a"), F.least(F.col(a), F.col(b)).cast("long").alias("b"))
    clean = clean.where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("a <> b").mapInArrow(_local_forest, "a long, b long")
    now = scratch(clean, label)
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    seen = mark(now)
    while seen[0]:
        now = scratch(_stars(now, label), label)
        if (then := mark(now)) == seen:
            break
        seen = then
    stars = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
