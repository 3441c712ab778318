"""Sinks by kind, and a sink's life: configure, bind a frame shape, start, append, stop."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.uri import normal_uri
from gridloom.operators.frames import whole_frames
from gridloom.plans.model import StatusCode, StoreConfig, dtype_of, log, require, set_log_level
from gridloom.sources import store
from gridloom.sources.shared import Folder, shared_folder

# fixed values: the sinks' names in their order, format version, codec, level and shuffle
KINDS = (
    ("Zarr", 2, None, 0, 0),
    ("ZarrBlosc1ZstdByteShuffle", 2, "zstd", 1, 1),
    ("ZarrBlosc1Lz4ByteShuffle", 2, "lz4", 1, 1),
    ("ZarrV3", 3, None, 0, 0),
    ("ZarrV3Blosc1ZstdByteShuffle", 3, "zstd", 1, 1),
    ("ZarrV3Blosc1Lz4ByteShuffle", 3, "lz4", 1, 1),
)


def sink_count() -> int:
    return len(KINDS)


def describe(i: int) -> dict:
    require(0 <= i < len(KINDS), f"there is no sink {i}", StatusCode.InvalidIndex)
    return {"device_id": i, "kind": "Storage", "name": KINDS[i][0]}


def kind_name(i: int) -> str:
    return f"Storage_{KINDS[i][0]}" if 0 <= i < len(KINDS) else "(unknown)"


def registry(spark: SparkSession) -> DataFrame:
    """All sinks with what they can do."""
    rows = [(i, name, version, codec or "none", level, shuffle, True, True, True, version == 3) for i, (name, version, codec, level, shuffle) in enumerate(KINDS)]
    return spark.createDataFrame(rows, "device_id int, name string, version int, codec string, clevel int, shuffle int, chunking boolean, multiscale boolean, s3 boolean, sharding boolean")


class State(Enum):
    AWAITING, ARMED, RUNNING, CLOSED = "AwaitingConfiguration", "Armed", "Running", "Closed"


@dataclass(frozen=True)
class Capabilities:
    chunking: bool
    multiscale: bool
    s3: bool
    sharding: bool


class Sink:
    """A failing call raises and leaves the state as it was; ``Device`` gives states instead.

    What is appended is written to the shared folder at once, so a long run costs no memory or plan.
    """

    def __init__(self, spark: SparkSession, device_id: int):
        describe(device_id)
        self.spark, self.device_id, self.state = spark, device_id, State.AWAITING
        self.config: StoreConfig | None = None
        self._folder: Folder | None = None
        self._n = self._parts = 0
        self._rest = b""

    def configure(self, cfg: StoreConfig, remove_existing: bool = True) -> State:
        """Take settings; version and codec are the kind's. A store that is there already goes, unless told otherwise."""
        require(self.state in (State.AWAITING, State.ARMED), f"can't configure while {self.state.value}", StatusCode.InvalidArgument)
        _, version, codec, level, shuffle = KINDS[self.device_id]
        cfg = replace(cfg, version=version, codec=codec, level=level, shuffle=shuffle).check()
        store.check_target(cfg)
        if remove_existing:
            store.remove(cfg)
        self.config, self.state = cfg, State.ARMED
        return self.state

    def get(self) -> dict:
        """The settings as they would be given; without any, an empty address, {} and no dimensions."""
        c = self.config
        return {
            "uri": normal_uri(c.uri) if c else "",
            "metadata": c.metadata if c else "{}",
            "dimensions": c.dims if c else (),
            "multiscale": bool(c and c.multiscale),
            "first_frame_id": 0,
            "pixel_scale": (1.0, 1.0),
            "access_key": c.access_key if c else None,
        }

    def get_meta(self) -> Capabilities:
        return Capabilities(True, True, True, KINDS[self.device_id][1] == 3)

    def reserve_image_shape(self, width: int, height: int, sample_type: str) -> State:
        require(self.state is State.ARMED, f"can't bind a shape while {self.state.value}", StatusCode.InvalidArgument)
        self.config.check_frame(width, height)
        self.config = replace(self.config, dtype=dtype_of(sample_type))
        return self.state

    def start(self) -> State:
        require(self.state is State.ARMED, f"can't start while {self.state.value}", StatusCode.InvalidArgument)
        self._folder = Folder(self.spark, f"{shared_folder(self.spark)}/gridloom-frames-{uuid.uuid4().hex}")
        self._n, self._parts, self._rest, self.state = 0, 0, b"", State.RUNNING
        return self.state

    def append(self, frames: DataFrame) -> int:
        """Take frames (frame_id, data), numbered on from those before; how many came."""
        require(self.state is State.RUNNING, f"can't append while {self.state.value}", StatusCode.InvalidArgument)
        path = f"{self._folder.path}/{self._parts}"
        frames.select(F.col("frame_id").cast("long"), F.col("data").cast("binary")).write.mode("overwrite").parquet(path)
        kept = whole_frames(self.spark.read.schema(_FRAMES).parquet(path), self.config)
        n, low, high, wrong = kept.agg(F.count("*"), F.min("frame_id"), F.max("frame_id"), F.count(F.when(~F.col("whole"), 1))).first()
        if not n:
            return 0
        require(low == self._n and high == low + n - 1, f"expected frames from {self._n}, got {low} to {high} in {n} rows", StatusCode.InvalidArgument)
        require(not wrong, f"{wrong} frames don't have {self.config.frame_bytes} bytes", StatusCode.IOError)
        self._n += n
        self._parts += 1
        return n

    def append_bytes(self, data: bytes) -> int:
        """Take packed frames in row-major order from the driver; how many bytes were taken, which is all of them.

        A frame may come in pieces; what is left of an unfinished one when the sink stops is dropped.
        """
        require(self.state is State.RUNNING, f"can't append while {self.state.value}", StatusCode.InvalidArgument)
        whole = self._rest + data
        n, size = len(whole) // self.config.frame_bytes, self.config.frame_bytes
        if n:
            rows = [(self._n + i, whole[i * size : (i + 1) * size]) for i in range(n)]
            self.append(self.spark.createDataFrame(rows, _FRAMES))
        self._rest = whole[n * size :]
        return len(data)

    def stop(self) -> State:
        """Write what was appended and go back to Armed; nothing happens unless running. The next run starts anew."""
        if self.state is State.RUNNING:
            self.state = State.ARMED
            if self._rest:
                log.warning("%d bytes of an unfinished frame are dropped", len(self._rest))
            parts = [f"{self._folder.path}/{i}" for i in range(self._parts)]
            store.write(self.spark.read.schema(_FRAMES).parquet(*parts) if parts else self.spark.createDataFrame([], _FRAMES), self.config)
            self._folder.delete("")
        return self.state

    def destroy(self) -> State:
        self.stop()
        self.state = State.CLOSED
        return self.state


_FRAMES = "frame_id long, data binary"


class Device:
    """A sink whose calls never raise: a failing one is logged and leaves the device waiting for settings."""

    def __init__(self, sink: Sink):
        self.sink = sink

    @property
    def state(self) -> State:
        return self.sink.state

    def _call(self, name: str, *args, failed=None):
        try:
            return getattr(self.sink, name)(*args)
        except Exception as e:  # all of them, as a caller without exceptions expects
            log.error("%s: %s", name, e)
            if self.sink.state is not State.CLOSED:
                self.sink.state = State.AWAITING
            return self.sink.state if failed is None else failed

    def configure(self, cfg: StoreConfig) -> State:
        return self._call("configure", cfg)

    def reserve_image_shape(self, width: int, height: int, sample_type: str) -> State:
        return self._call("reserve_image_shape", width, height, sample_type)

    def start(self) -> State:
        return self._call("start")

    def append(self, frames: DataFrame) -> int:
        return self._call("append", frames, failed=0)

    def stop(self) -> State:
        return self._call("stop")

    def destroy(self) -> State:
        return self._call("destroy")


_ready = False
_opened: list[Sink] = []


def init(spark: SparkSession) -> int:
    """Make the formats known to the session and the sinks ready to be opened; how many kinds there are."""
    global _ready
    store.register(spark)
    _ready = True
    return sink_count()


def open_sink(spark: SparkSession, device_id: int) -> Sink:
    """A new sink of a kind. Only errors are logged from here on."""
    if not _ready:
        init(spark)
    made = Sink(spark, device_id)
    set_log_level("error")
    _opened.append(made)
    return made


def close_sink(sink: Sink) -> None:
    """Stop and end a sink; once more does nothing."""
    if sink.state is not State.CLOSED:
        sink.destroy()
    if sink in _opened:
        _opened.remove(sink)


def shutdown() -> int:
    """Close all open sinks; how many there were."""
    global _ready
    n = len(_opened)
    for sink in list(_opened):
        close_sink(sink)
    _ready = False
    return n
