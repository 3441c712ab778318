"""The two-fold local-mean pyramid, on pixels (SQL) and on frames (Arrow).

Every level truncates: a level is the mean of two frames of the last level, each halved by 2x2
means first, and both steps cut fractions towards zero. Means over the pixels that are there equal
those over repeated edges. A frame without a partner is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import div
from gridloom.plans.model import DTYPES, StoreConfig

#: dtypes whose means keep their fractions
_FLOATS = ("float", "double")


def _mean(column: str, kind: str) -> Column:
    mean = F.avg(column)
    return mean.cast(kind) if kind in _FLOATS else F.when(mean >= 0, F.floor(mean)).otherwise(F.ceil(mean)).cast(kind)


def downsample_spatial(pixels: DataFrame, keys: tuple[str, ...] = (), kind: str = "int") -> DataFrame:
    """t, y, x, value at half the size; ``keys`` are grouped along, for a partitioning to be used again."""
    return pixels.groupBy(*keys, "t", div(F.col("y"), 2).alias("y"), div(F.col("x"), 2).alias("x")).agg(_mean("value", kind).alias("value"))


def downsample_temporal(pixels: DataFrame, keys: tuple[str, ...] = (), kind: str = "int") -> DataFrame:
    """Means of frames 2i and 2i + 1; a last frame without a partner is dropped."""
    grouped = pixels.groupBy(*keys, div(F.col("t"), 2).alias("t"), "y", "x").agg(_mean("value", kind).alias("value"), F.count("*").alias("n"))
    return grouped.where("n = 2").drop("n")


def pyramid(pixels: DataFrame, n_levels: int, kind: str = "int") -> DataFrame:
    """level, t, y, x, value of levels 0 to ``n_levels`` - 1.

    Pixels are dealt once by the group of 2^(levels - 1) frames that shares an ancestor; all levels'
    aggregations then happen where the pixels are.
    """
    block = 2 ** (n_levels - 1)
    now = pixels.select(div(F.col("t"), block).alias("tb"), "t", "y", "x", F.col("value").cast(kind).alias("value")).repartition("tb")
    out = now.select(F.lit(0).alias("level"), "t", "y", "x", "value")
    for level in range(1, n_levels):
        now = downsample_temporal(downsample_spatial(now, ("tb",), kind), ("tb",), kind)
        out = out.unionByName(now.select(F.lit(level).alias("level"), "t", "y", "x", "value"))
    return out


def halve(image: np.ndarray) -> np.ndarray:
    """2x2 means of an image with repeated edges, cut towards zero."""
    h, w = image.shape
    wide = np.pad(image.astype(np.float64), ((0, h % 2), (0, w % 2)), mode="edge")
    mean = wide.reshape((h + 1) // 2, 2, (w + 1) // 2, 2).mean(axis=(1, 3))
    return mean.astype(image.dtype)


def mean_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The mean of two images, cut towards zero."""
    return (0.5 * (a.astype(np.float64) + b.astype(np.float64))).astype(a.dtype)


def next_level(frames: DataFrame, cfg: StoreConfig, width: int, height: int) -> DataFrame:
    """frame_id and data of the next level. Frames are halved where they are; only halves are dealt out, by pair."""
    kind = np.dtype("<" + DTYPES[cfg.dtype])
    half = ((height + 1) // 2, (width + 1) // 2)

    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [halve(np.frombuffer(raw.as_buffer(), kind).reshape(height, width)).tobytes() for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["frame_id", "data"])

    def paired(key: tuple, table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return pa.table({"frame_id": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
        a, b = (np.frombuffer(raw, kind).reshape(half) for raw in table.sort_by("frame_id").column("data").to_pylist())
        return pa.table({"frame_id": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([mean_of(a, b).tobytes()], pa.binary())})

    small = frames.select(F.col("frame_id").cast("long"), "data").mapInArrow(halved, "frame_id long, data binary")
    return small.withColumn("pair", div(F.col("frame_id"), 2)).groupBy("pair").applyInArrow(paired, "frame_id long, data binary")
