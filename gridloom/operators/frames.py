"""Frames and pixels: conversions, sample types, simulated cameras.

``frames`` have frame_id and data (an array of numbers, or bytes in row-major order); ``pixels``
have one row a sample. The order of frames is their frame_id: partitions keep no order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geometry import div
from gridloom.plans.model import DTYPES, SPARK_TYPES, StoreConfig, dtype_of

# fixed values: bounds of the sample types and stored dtypes
BOUNDS = {
    "uint8": (0, 2**8 - 1),
    "uint16": (0, 2**16 - 1),
    "uint32": (0, 2**32 - 1),
    "uint64": (0, 2**64 - 1),
    "int8": (-(2**7), 2**7 - 1),
    "int16": (-(2**15), 2**15 - 1),
    "int32": (-(2**31), 2**31 - 1),
    "int64": (-(2**63), 2**63 - 1),
}


def frames_to_pixels(frames: DataFrame, width: int, id_col: str = "frame_id", data_col: str = "data") -> DataFrame:
    """t, y, x, value for array-valued frames of this width."""
    flat = frames.select(F.col(id_col).cast("long").alias("t"), F.posexplode(data_col).alias("i", "value"))
    return flat.select("t", div(F.col("i"), width).alias("y"), F.pmod(F.col("i"), F.lit(width)).cast("long").alias("x"), "value")


def bytes_to_pixels(frames: DataFrame, width: int, dtype: str = "uint8", id_col: str = "frame_id", data_col: str = "data") -> DataFrame:
    """t, y, x, value for frames of packed bytes; an empty frame has no pixels."""
    kind = np.dtype("<" + DTYPES[dtype])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.frombuffer(raw.as_buffer(), kind) if raw.is_valid else np.zeros(0, kind)
                at = np.arange(len(v))
                value = pa.array(v.astype(np.float64 if dtype.startswith("float") else np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t)), pa.array(at // width), pa.array(at % width), value], ["t", "y", "x", "value"])

    value = "double" if dtype.startswith("float") else "long"
    return frames.select(F.col(id_col).cast("long").alias("t"), data_col).mapInArrow(work, f"t long, y long, x long, value {value}")


def pixels_to_frames(pixels: DataFrame) -> DataFrame:
    """frame_id and data: the pixels of each frame in row-major order."""
    packed = pixels.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("y", "x", "value"))).alias("all"))
    return packed.select(F.col("t").alias("frame_id"), F.transform("all", lambda p: p["value"]).alias("data"))


def whole_frames(frames: DataFrame, cfg: StoreConfig) -> DataFrame:
    """The frames with ``whole``: whether their bytes are just as many as the settings say."""
    return frames.withColumn("whole", F.coalesce(F.octet_length("data") == cfg.frame_bytes, F.lit(False)))


def coerce(value: Column, sample_type: str) -> Column:
    """The value in the stored dtype's Spark type; null where it is out of the dtype's range. Unknown sample types raise."""
    dtype = dtype_of(sample_type)
    if dtype not in BOUNDS:
        return value.cast(SPARK_TYPES[dtype])
    low, high = BOUNDS[dtype]
    return F.when(value.between(low, high), value).cast(SPARK_TYPES[dtype])


def byte_pixels(column: Column) -> Column:
    """Numbers about -1 to 1 as samples of 0 to 255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((column.cast("double") + 1.0) * 127.5))).cast("int")


# --- simulated cameras ---------------------------------------------------------------------------


def simulated(spark: SparkSession, pattern: str, n_frames: int, width: int, height: int, dtype: str = "uint8", seed: int = 0) -> DataFrame:
    """frame_id and packed bytes of an ``empty``, ``random`` or ``radial`` camera; frames are made on the executors."""
    kind = np.dtype("<" + DTYPES[dtype])
    if pattern not in ("empty", "random", "radial"):
        raise ValueError(f"unknown camera {pattern!r}")

    def make(t: int) -> bytes:
        if pattern == "empty":
            return np.zeros((height, width), kind).tobytes()
        if pattern == "radial":
            y, x = np.mgrid[:height, :width]
            return ((np.hypot(x - width / 2, y - height / 2) + t) % 256).astype(kind).tobytes()
        rng = np.random.default_rng([seed, t])
        if kind.kind == "f":
            return rng.random((height, width)).astype(kind).tobytes()
        info = np.iinfo(kind)
        return rng.integers(info.min, info.max, (height, width), kind, endpoint=True).tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([make(t)], pa.binary())], ["frame_id", "data"])

    return spark.range(n_frames).mapInArrow(work, "frame_id long, data binary")
