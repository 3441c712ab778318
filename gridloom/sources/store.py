"""Stores on a shared file system or an S3-compatible service: the object writer, the reader, whole writes.

Data objects are written by executors, each by one task attempt under a name of its own that is
renamed when it is whole; metadata come last, from the driver, so a store without them isn't ready.

``write`` deals frames out by object. ``df.write.format("gridloom")`` writes frames where they are: see
``clustered``.
"""

from __future__ import annotations

import json
import math
import os
import posixpath
import stat
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, Filter, InputPartition, WriterCommitMessage

from gridloom.functions.codec import decompress
from gridloom.functions.uri import is_web_uri, s3_parts, strip_scheme
from gridloom.functions.geometry import div
from gridloom.operators.pyramid import next_level
from gridloom.operators.reshape import Assembler, object_count, objects, unit_frames, unpack_shard
from gridloom.plans.metadata import ARRAY_V2, ATTRIBUTES_V2, GROUP_V2, NODE_V3, USER_METADATA, documents, store_levels
from gridloom.plans.model import DTYPES, StatusCode, StoreConfig, StoreError, dimensions, multiscale_ready, require
from gridloom.sources.shared import written


def open_fs(uri: str, access_key: str | None = None, secret_key: str | None = None) -> tuple[fs.FileSystem, str]:
    """File system and root path of a store."""
    if is_web_uri(uri):
        endpoint, bucket, key = s3_parts(uri)
        scheme, host = endpoint.split("//")
        made = fs.S3FileSystem(access_key=access_key, secret_key=secret_key, endpoint_override=host, scheme=scheme.rstrip(":"))
        return made, f"{bucket}/{key}"
    if "://" in uri and not uri.startswith("file://"):  # hdfs:// and others that the Arrow library knows
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), strip_scheme(uri)


def check_target(cfg: StoreConfig) -> None:
    """A local store's parent must be a folder that can be written to."""
    if "://" in cfg.uri and not cfg.uri.startswith("file://"):
        return
    parent = os.path.dirname(os.path.abspath(strip_scheme(cfg.uri)))
    require(os.path.isdir(parent), f"{parent} isn't a folder", StatusCode.IOError)
    bits = os.stat(parent).st_mode & (stat.S_IWUSR | stat.S_IWGRP | stat.S_IWOTH)
    require(bool(bits) and os.access(parent, os.W_OK), f"{parent} can't be written to", StatusCode.IOError)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its objects' names, and for frames their units and how far they go."""

    keys: list[str]
    bytes: int
    units: list[int] | None = None
    upto: int = 0


class Objects:
    """Puts objects below a root. ``undo`` takes back what was put."""

    def __init__(self, options: dict[str, str]):
        self.target, self.root = open_fs(options["path"], options.get("access_key"), options.get("secret_key"))
        self.local = isinstance(self.target, fs.LocalFileSystem)
        self.keys: list[str] = []
        self.bytes = 0

    def put(self, key: str, data) -> None:
        path = posixpath.join(self.root, key)
        part = f"{path}.{uuid.uuid4().hex}" if self.local else path  # a service shows an object only when it is whole
        if self.local:
            self.target.create_dir(posixpath.dirname(path), recursive=True)
        try:
            with self.target.open_output_stream(part) as out:
                out.write(data)
        except BaseException:
            if self.local and self.target.get_file_info(part).type == fs.FileType.File:
                self.target.delete_file(part)
            raise
        if self.local:
            self.target.move(part, path)
        self.keys.append(key)
        self.bytes += len(data)

    def undo(self, keys: list[str]) -> None:
        for key in keys:
            path = posixpath.join(self.root, key)
            if self.target.get_file_info(path).type == fs.FileType.File:
                self.target.delete_file(path)


class ObjectWriter(DataSourceArrowWriter):
    """Writes rows (key, payload) as objects below a root."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out = Objects(self.options)
        for batch in iterator:
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out.put(key, payload.as_buffer().to_pybytes())
        return Written(out.keys, out.bytes)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        want = self.options.get("expected_objects")
        have = sum(len(m.keys) for m in messages if m)
        if want is not None and have != int(want):
            self.abort(messages)
            raise StoreError(StatusCode.IOError, f"{have} objects written of {want}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Take back what the tasks wrote that had finished."""
        Objects(self.options).undo([k for m in messages if m for k in m.keys])


class ObjectSink(DataSource):
    """``df.write.format("gridloom_objects").option("path", root)``: rows (key string, payload binary)."""

    @classmethod
    def name(cls) -> str:
        return "gridloom_objects"

    def schema(self) -> str:
        return "key string, payload binary"

    def writer(self, schema, overwrite: bool) -> ObjectWriter:
        return ObjectWriter(self.options)


# --- reading ---------------------------------------------------------------------------------------


@dataclass
class ArrayInfo:
    version: int
    shape: tuple[int, ...]
    chunk: tuple[int, ...]
    shard: tuple[int, ...]
    dtype: str
    codec: str | None

    @property
    def chunk_counts(self) -> tuple[int, ...]:
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunk, strict=True))


def array_info(target: fs.FileSystem, root: str, level: int) -> ArrayInfo:
    def load(name: str) -> dict | None:
        path = f"{root}/{level}/{name}"
        if target.get_file_info(path).type != fs.FileType.File:
            return None
        with target.open_input_stream(path) as f:
            return json.loads(f.read())

    if (old := load(ARRAY_V2)) is not None:
        dtype = next(k for k, v in DTYPES.items() if v == old["dtype"][1:])
        codec = old["compressor"] and old["compressor"]["cname"]
        return ArrayInfo(2, tuple(old["shape"]), tuple(old["chunks"]), tuple(1 for _ in old["shape"]), dtype, codec)
    new = load(NODE_V3)
    require(new is not None, f"no array of level {level} at {root}", StatusCode.IOError)
    conf = new["codecs"][0]["configuration"]
    chunk = tuple(conf["chunk_shape"])
    shard = tuple(a // b for a, b in zip(new["chunk_grid"]["configuration"]["chunk_shape"], chunk, strict=True))
    codec = next((c["configuration"]["cname"] for c in conf["codecs"] if c["name"] == "blosc"), None)
    return ArrayInfo(3, tuple(new["shape"]), chunk, shard, new["data_type"], codec)


#: Samples of the objects that one partition reads, in bytes.
PARTITION_BYTES = 128 << 20


@dataclass
class ObjectPart(InputPartition):
    """A run of objects, by row-major place in a box of object coordinates."""

    low: tuple[int, ...]
    size: tuple[int, ...]
    start: int
    stop: int

    def keys(self) -> Iterator[tuple[int, ...]]:
        for i in range(self.start, self.stop):
            yield tuple(int(k) + a for k, a in zip(np.unravel_index(i, self.size), self.low, strict=True))


class StoreReader(DataSourceReader):
    """One partition for PARTITION_BYTES of objects. Bounds on t, y and x that Spark pushes down leave whole objects out."""

    def __init__(self, options: dict[str, str]):
        self.options, self.level = dict(options), int(options.get("level", 0))
        target, root = self.open()
        self.info = array_info(target, root, self.level)
        self.bounds = {0: [0, math.inf], len(self.info.shape) - 2: [0, math.inf], len(self.info.shape) - 1: [0, math.inf]}

    def open(self) -> tuple[fs.FileSystem, str]:
        return open_fs(self.options["path"], self.options.get("access_key"), self.options.get("secret_key"))

    def pushFilters(self, filters: list[Filter]):
        n = len(self.info.shape)
        axis = {("t",): 0, ("y",): n - 2, ("x",): n - 1}
        for f in filters:
            where = axis.get(getattr(f, "attribute", None))
            value = getattr(f, "value", None)
            if where is not None and isinstance(value, int):
                kind, bound = type(f).__name__, self.bounds[where]
                if kind in ("EqualTo", "GreaterThan", "GreaterThanOrEqual"):
                    bound[0] = max(bound[0], value)
                if kind in ("EqualTo", "LessThan", "LessThanOrEqual"):
                    bound[1] = min(bound[1], value)
            yield f  # Spark still applies it to the rows

    def partitions(self) -> list[ObjectPart]:
        info = self.info
        grid = [-(-n // s) for n, s in zip(info.chunk_counts, info.shard, strict=True)]
        extent = [c * s for c, s in zip(info.chunk, info.shard, strict=True)]
        low, high = [0] * len(grid), list(grid)
        for a, (least, most) in self.bounds.items():
            low[a] = min(grid[a], max(0, int(least) // extent[a]))
            high[a] = min(grid[a], max(low[a], int(most) // extent[a] + 1)) if most < math.inf else grid[a]
        size = tuple(h - n for n, h in zip(low, high, strict=True))
        total, object_bytes = math.prod(size), math.prod(extent) * int(DTYPES[info.dtype][1:])
        step = max(1, int(self.options.get("partition_bytes", PARTITION_BYTES)) // object_bytes)
        return [ObjectPart(tuple(low), size, i, min(i + step, total)) for i in range(0, total, step)]

    def read(self, partition: ObjectPart) -> Iterator[pa.RecordBatch]:
        target, root = self.open()
        for key in partition.keys():
            yield from self._object(target, root, key)

    def _object(self, target: fs.FileSystem, root: str, key: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
        info, name = self.info, "/".join(map(str, key))
        path = f"{root}/{self.level}/{'c/' if info.version == 3 else ''}{name}"
        if target.get_file_info(path).type != fs.FileType.File:
            return
        with target.open_input_stream(path) as f:
            data = f.read()
        chunks = {0: data} if info.version == 2 else unpack_shard(data, math.prod(info.shard))
        kind = np.dtype("<" + DTYPES[info.dtype])
        for slot, raw in chunks.items():
            inner = np.unravel_index(slot, info.shard)
            base = [(k * s + int(i)) * c for k, s, i, c in zip(key, info.shard, inner, info.chunk, strict=True)]
            block = np.frombuffer(decompress(raw, info.codec), kind).reshape(info.chunk)
            keep = tuple(slice(0, max(0, n - b)) for n, b in zip(info.shape, base, strict=True))
            block = block[keep]
            at = np.indices(block.shape).reshape(block.ndim, -1)
            coords = [a + b for a, b in zip(at, base, strict=True)]
            inner_id = np.zeros_like(coords[0])
            for c, n in zip(coords[1:-2], info.shape[1:-2], strict=True):
                inner_id = inner_id * n + c
            value = block.reshape(-1).astype(np.float64 if kind.kind == "f" else np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(coords[0]), pa.array(inner_id), pa.array(coords[-2]), pa.array(coords[-1]), pa.array(value)], ["t", "inner", "y", "x", "value"])


def options_of(cfg: StoreConfig) -> dict[str, str]:
    """All settings as options of the ``gridloom`` format."""
    dims = json.dumps([[d.name, d.kind.value, d.array_size, d.chunk_size, d.shard_chunks] for d in cfg.dims])
    made = {"path": cfg.uri, "dims": dims, "version": str(cfg.version), "codec": cfg.codec or "none", "clevel": str(cfg.level), "shuffle": str(cfg.shuffle), "multiscale": str(cfg.multiscale).lower(), "dtype": cfg.dtype, "metadata": cfg.metadata}
    return made | ({"access_key": cfg.access_key, "secret_key": cfg.secret_key} if cfg.access_key else {})


def config_of(options: dict[str, str]) -> StoreConfig:
    """The settings that options give; ``dims`` is JSON rows of name, kind, array size, chunk size and shard size."""
    require("dims" in options, "frames need the option dims")
    codec = options.get("codec", "none")
    return StoreConfig(
        options["path"],
        dimensions(*json.loads(options["dims"])),
        int(options.get("version", 2)),
        None if codec == "none" else codec,
        int(options.get("clevel", 1)),
        int(options.get("shuffle", 1)),
        options.get("multiscale", "false").lower() == "true",
        options.get("dtype", "uint8"),
        options.get("metadata", "{}"),
        options.get("access_key"),
        options.get("secret_key"),
    ).check()


class FrameWriter(DataSourceArrowWriter):
    """Frames (frame_id, data) to a store, all levels, each task on its own: a task must hold whole append units, by ascending id."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options = dict(options)
        self.cfg = cfg = config_of(self.options)
        check_target(cfg)
        if cfg.multiscale:
            require(multiscale_ready(cfg.dims), "a pyramid needs frames in space and no other dimension of more than one step")
        if overwrite:
            remove(cfg)
        self.before = stored_frames(cfg)
        require(self.before % unit_frames(cfg) == 0, f"the store ends within an append unit, at {self.before} frames", StatusCode.InvalidArgument)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out, unit = Objects(self.options), unit_frames(self.cfg)
        made, units, last = Assembler(self.cfg, out.put), [], None
        for batch in iterator:
            for frame_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                require(frame_id is not None and data.is_valid, "a frame lacks its id or data", StatusCode.InvalidArgument)
                follows = frame_id == last + 1 if last is not None and frame_id % unit else frame_id % unit == 0 and (last is None or frame_id > last)
                require(follows and (last is None or frame_id % unit or (last + 1) % unit == 0), f"frame {frame_id} came after {last}: cluster frames by append unit first", StatusCode.InvalidArgument)
                if frame_id % unit == 0:
                    units.append(frame_id // unit)
                made.feed(frame_id, data.as_buffer())
                last = frame_id
        made.finish()
        return Written(out.keys, out.bytes, units, 0 if last is None else last + 1)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        unit, units = unit_frames(self.cfg), sorted(u for m in messages if m for u in m.units)
        n = max([self.before, *(m.upto for m in messages if m)])
        if units != list(range(self.before // unit, -(-n // unit))):
            self.abort(messages)
            raise StoreError(StatusCode.InvalidArgument, f"append units {units[:9]}... don't follow {self.before} frames: cluster frames by append unit first")
        want = sum(object_count(self.cfg, v, v.frames) for v in store_levels(self.cfg, n)) - sum(object_count(self.cfg, v, v.frames) for v in store_levels(self.cfg, self.before))
        have = sum(len(m.keys) for m in messages if m)
        if have != want:
            self.abort(messages)
            raise StoreError(StatusCode.IOError, f"{have} objects written of {want}")
        write_metadata(self.cfg, n)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        Objects(self.options).undo([k for m in messages if m for k in m.keys])


class FrameStreamWriter(DataSourceStreamArrowWriter, FrameWriter):
    """The same for each micro-batch, which must hold whole append units; the last one may end within a unit.

    For streams without that property there is ``StreamSink``. A batch that is repeated writes the same objects.
    """

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        held = list(iterator)  # a stream can't be sorted, so a task sorts its part of the micro-batch
        table = pa.Table.from_batches(held) if held else None
        return FrameWriter.write(self, iter(table.sort_by(table.column_names[0]).to_batches() if table is not None else []))

    def commit(self, messages: list[WriterCommitMessage | None], batch_id: int) -> None:
        if not any(m and m.units for m in messages):
            return
        unit = unit_frames(self.cfg)
        self.before = min(stored_frames(self.cfg), unit * min(u for m in messages if m for u in m.units))
        FrameWriter.commit(self, messages)

    def abort(self, messages: list[WriterCommitMessage | None], batch_id: int) -> None:
        FrameWriter.abort(self, messages)


def stored_frames(cfg: StoreConfig) -> int:
    """Frames that an existing store says it has, as whole steps of the append dimension; 0 where there is none."""
    target, root = open_fs(cfg.uri, cfg.access_key, cfg.secret_key)
    name = ARRAY_V2 if cfg.version == 2 else NODE_V3
    if target.get_file_info(f"{root}/0/{name}").type != fs.FileType.File:
        return 0
    return array_info(target, root, 0).shape[0] * cfg.frames_per_step


def clustered(frames: DataFrame, cfg: StoreConfig) -> DataFrame:
    """Frames dealt out by append unit and in order, as the ``gridloom`` format takes them."""
    unit = div(F.col("frame_id"), unit_frames(cfg))
    chosen = frames.select(F.col("frame_id").cast("long"), F.col("data").cast("binary"))
    return chosen.repartition(unit).sortWithinPartitions("frame_id")


class StoreSource(DataSource):
    """``spark.read.format("gridloom").option("path", root).option("level", 0)``: t, inner, y, x, value.

    ``inner`` is the row-major place in the dimensions between the append dimension and the frame.

    ``clustered(frames, cfg).write.format("gridloom").options(**options_of(cfg)).mode("overwrite").save()``
    writes frame_id, data; ``append`` goes on behind a store of whole append units.
    """

    @classmethod
    def name(cls) -> str:
        return "gridloom"

    def schema(self) -> str:
        target, root = open_fs(self.options["path"], self.options.get("access_key"), self.options.get("secret_key"))
        dtype = array_info(target, root, int(self.options.get("level", 0))).dtype
        return f"t long, inner long, y long, x long, value {'double' if dtype.startswith('float') else 'long'}"

    def reader(self, schema) -> StoreReader:
        return StoreReader(self.options)

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> FrameStreamWriter:
        return FrameStreamWriter(self.options, False)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ObjectSink)
    spark.dataSource.register(StoreSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, cfg: StoreConfig, level: int = 0) -> DataFrame:
    register(spark)
    return _secured(spark.read.format("gridloom").option("path", cfg.uri).option("level", level), cfg).load()


def _secured(io, cfg: StoreConfig):
    return io.option("access_key", cfg.access_key).option("secret_key", cfg.secret_key) if cfg.access_key else io


# --- writing ---------------------------------------------------------------------------------------


def write_metadata(cfg: StoreConfig, n_frames: int) -> None:
    out = Objects({"path": cfg.uri, "access_key": cfg.access_key, "secret_key": cfg.secret_key})
    for name, text in documents(cfg, n_frames).items():
        out.put(name, text.encode())


def object_names(cfg: StoreConfig) -> list[tuple[str, int]]:
    """Name below the root and size of everything in a store, by name."""
    target, root = open_fs(cfg.uri, cfg.access_key, cfg.secret_key)
    found = target.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    return sorted((f.path[len(root) :].lstrip("/"), f.size) for f in found if f.type == fs.FileType.File)


def remove(cfg: StoreConfig) -> None:
    """Delete what is at the target if it is a store, a part of one, or empty; anything else raises."""
    target, root = open_fs(cfg.uri, cfg.access_key, cfg.secret_key)
    kind = target.get_file_info(root).type
    if kind == fs.FileType.NotFound:
        return
    require(kind == fs.FileType.Directory, f"{cfg.uri} isn't a folder", StatusCode.IOError)
    known = {USER_METADATA, GROUP_V2, ATTRIBUTES_V2, NODE_V3}
    found = [f.base_name for f in target.get_file_info(fs.FileSelector(root))]
    ours = lambda n: n.isdigit() or any(n == k or n.startswith(f"{k}.") for k in known)
    strange = [n for n in found if not ours(n)]
    require(not strange, f"{cfg.uri} holds {strange[:3]} and isn't a store, so it stays", StatusCode.IOError)
    target.delete_dir(root)


def write_objects(frames: DataFrame, cfg: StoreConfig, upto: int, since: int = 0) -> None:
    """All levels' data objects of frames from ``since`` (the end of an append unit) up to ``upto``.

    Levels above 0 are made from the one before, which is written first, so that no level is made twice.
    """
    register(frames.sparkSession)
    if cfg.multiscale:
        require(multiscale_ready(cfg.dims), "a pyramid needs frames in space and no other dimension of more than one step")
    made, before = store_levels(cfg, upto), store_levels(cfg, since)
    for level in made:
        if level.level:
            last = made[level.level - 1]
            frames = written(next_level(frames, cfg, last.width, last.height), "level")
        want = object_count(cfg, level, level.frames) - object_count(cfg, level, before[level.level].frames)
        out = objects(frames, cfg, level).write.format("gridloom_objects").option("path", cfg.uri).option("expected_objects", want)
        _secured(out, cfg).mode("append").save()


def write(frames: DataFrame, cfg: StoreConfig) -> int:
    """Replace the store by these frames (frame_id from 0 on, data); the number of frames.

    An old store is removed only when the frames have been counted and the settings are fine.
    """
    cfg = cfg.check()
    check_target(cfg)
    n, last = frames.agg(F.count("*"), F.max("frame_id")).first()
    require(n == 0 or last == n - 1, f"frame ids of {n} frames must run from 0, the last is {last}", StatusCode.InvalidArgument)
    remove(cfg)
    write_objects(frames, cfg, n)
    write_metadata(cfg, n)
    return n
