"""Chunks and shards: grids, zero fill, payloads, the shard index."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.codec import compress, crc32c
from gridloom.functions.geometry import div, in_chunk_offset, object_key, shard_slot
from gridloom.plans.model import DTYPES, StoreConfig

#: Stands for both index entries of a chunk that isn't there.
MISSING = 2**64 - 1


def chunk_grid(pixels: DataFrame, chunk: tuple[int, int, int], coords: tuple[str, str, str] = ("t", "y", "x")) -> DataFrame:
    """ct, cy, cx with the number and sum of valid samples."""
    keys = [div(F.col(c), n).alias(k) for c, n, k in zip(coords, chunk, ("ct", "cy", "cx"), strict=True)]
    return pixels.groupBy(*keys).agg(F.count("value").alias("n_valid"), F.sum(F.col("value").cast("long")).alias("total"))


def chunk_extents(grid: DataFrame, chunk: tuple[int, int, int]) -> DataFrame:
    """The grid with full and padding samples: every chunk is stored at its full size."""
    full = math.prod(chunk)
    return grid.withColumn("n_full", F.lit(full).cast("long")).withColumn("n_padding", F.lit(full).cast("long") - F.col("n_valid"))


def chunk_fill(pixels: DataFrame, chunk: tuple[int, int, int], coords: tuple[str, str, str] = ("t", "y", "x"), value_type: str = "int") -> DataFrame:
    """ct, cy, cx and payload: the chunk's samples in row-major order, zero where there are none. One chunk is one row."""
    at = [F.col(c) for c in coords]
    keys = [div(c, n).alias(k) for c, n, k in zip(at, chunk, ("ct", "cy", "cx"), strict=True)]
    placed = pixels.select(*keys, in_chunk_offset(at, chunk).cast("int").alias("o"), F.col("value").cast(value_type).alias("v"))
    packed = placed.groupBy("ct", "cy", "cx").agg(F.array_sort(F.collect_list(F.struct("o", "v"))).alias("m"))
    zero, full = F.lit(0).cast(value_type), math.prod(chunk)
    zeros = lambda n: F.array_repeat(zero, n)
    # each sample behind the zeros since the one before: linear in the chunk's size
    before = lambda i: F.when(i > 0, F.element_at("m", F.greatest(i, F.lit(1)))["o"]).otherwise(-1)
    runs = F.transform("m", lambda s, i: F.concat(zeros(s["o"] - before(i) - 1), F.array(s["v"])))
    tail = zeros(F.lit(full - 1) - F.element_at("m", -1)["o"])
    return packed.select("ct", "cy", "cx", F.concat(F.flatten(runs), tail).alias("payload"))


def shard_grid(chunks: DataFrame, shard: tuple[int, ...], coords: tuple[str, ...] = ("ct", "cy", "cx")) -> DataFrame:
    """Chunks with their shard's coordinates (s...) and their slot there."""
    names = ["s" + c[1:] for c in coords]
    at = [F.col(c) for c in coords]
    return chunks.select("*", *[div(c, n).alias(k) for c, n, k in zip(at, shard, names, strict=True)], shard_slot(at, shard).cast("int").alias("slot"))


def shard_index(chunks: DataFrame, shard: tuple[int, ...], coords: tuple[str, ...] = ("ct", "cy", "cx"), size: Column | None = None) -> DataFrame:
    """One row a slot of every shard: offset and size in bytes, -1 (all bits set) for chunks that aren't there.

    ``size``: a chunk's stored bytes, by default the column n_bytes. Chunks lie in slot order.
    """
    names = ["s" + c[1:] for c in coords]
    placed = shard_grid(chunks, shard, coords).withColumn("bytes_here", (F.col("n_bytes") if size is None else size).cast("long"))
    packed = placed.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("slot", "bytes_here"))).alias("have"))
    slots = packed.select(*names, F.explode(F.sequence(F.lit(0), F.lit(math.prod(shard) - 1))).alias("slot"), "have")
    here = slots.select(*names, "slot", F.element_at("have", F.col("slot")).alias("n_bytes"))
    before = Window.partitionBy(*names).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n_bytes").over(before), F.lit(0))
    return here.select(*names, "slot", F.when(F.col("n_bytes").isNull(), -1).otherwise(offset).cast("long").alias("offset"), F.coalesce("n_bytes", F.lit(-1)).cast("long").alias("n_bytes"))


def shard_bytes(chunks: DataFrame, shard: tuple[int, ...], chunk_bytes: int, coords: tuple[str, ...] = ("ct", "cy", "cx")) -> DataFrame:
    """Shards with their chunks and size: data, 16 bytes of index a slot, 4 of checksum."""
    names = ["s" + c[1:] for c in coords]
    grouped = shard_grid(chunks, shard, coords).groupBy(*names).agg(F.count("*").alias("n_chunks"))
    return grouped.withColumn("n_bytes", F.col("n_chunks") * chunk_bytes + 16 * math.prod(shard) + 4)


# --- payloads for the writer -----------------------------------------------------------------------


def coord_names(cfg: StoreConfig) -> list[str]:
    return [f"c{i}" for i in range(len(cfg.dims))]


def tiles(frames: DataFrame, cfg: StoreConfig, chunk: tuple[int, ...], width: int, height: int) -> DataFrame:
    """Chunk coordinates, plane in the chunk, and bytes of every frame's tiles, padded to the chunk's size.

    ``frames``: frame_id and data (bytes). A frame of another size raises.
    """
    kind = np.dtype("<" + DTYPES[cfg.dtype])
    ch, cw = chunk[-2:]
    ny, nx = -(-height // ch), -(-width // cw)
    interior, outer = cfg.interior, chunk[:-2]
    names = coord_names(cfg)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if raw is None or len(raw) != width * height * kind.itemsize:
                    raise ValueError(f"frame {frame_id} has {0 if raw is None else len(raw)} bytes, not {width * height * kind.itemsize}")
                coords, rest = [], frame_id
                for n in reversed(interior):
                    coords.append(rest % n)
                    rest //= n
                coords = [rest, *reversed(coords)]
                plane = 0
                for c, n in zip(coords, outer, strict=True):
                    plane = plane * n + c % n
                image = np.zeros((ny * ch, nx * cw), kind)
                image[:height, :width] = np.frombuffer(raw, kind).reshape(height, width)
                cut = image.reshape(ny, ch, nx, cw).swapaxes(1, 2)
                fixed = [c // n for c, n in zip(coords, outer, strict=True)]
                rows = [[*fixed, y, x, plane, cut[y, x].tobytes()] for y in range(ny) for x in range(nx)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:-1]), pa.array([r[-1] for r in rows], pa.binary())], [*names, "plane", "tile"])

    schema = ", ".join(f"{n} long" for n in names) + ", plane long, tile binary"
    return frames.select(F.col("frame_id").cast("long"), "data").mapInArrow(work, schema)


def chunk_payloads(frames: DataFrame, cfg: StoreConfig, chunk: tuple[int, ...], width: int, height: int) -> DataFrame:
    """Chunk coordinates and stored bytes of every chunk that a frame touches; always full-size before compression."""
    names, planes = coord_names(cfg), math.prod(chunk[:-2])
    item = np.dtype(DTYPES[cfg.dtype]).itemsize
    tile_bytes = chunk[-2] * chunk[-1] * item

    def work(key: tuple, table: pa.Table) -> pa.Table:
        out = bytearray(planes * tile_bytes)
        for plane, tile in zip(table.column("plane").to_pylist(), table.column("tile"), strict=True):
            out[plane * tile_bytes : (plane + 1) * tile_bytes] = tile.as_buffer()
        stored = compress(bytes(out), cfg.codec, cfg.level, cfg.shuffle, item)
        return pa.table({**{n: pa.array([k.as_py()], pa.int64()) for n, k in zip(names, key, strict=True)}, "payload": pa.array([stored], pa.binary())})

    schema = ", ".join(f"{n} long" for n in names) + ", payload binary"
    return tiles(frames, cfg, chunk, width, height).groupBy(*names).applyInArrow(work, schema)


def pack_shard(chunks: list[tuple[int, bytes]], slots: int) -> bytes:
    """Chunks in slot order, then (offset, size) of every slot, then the index's checksum."""
    data, index, at = [], [(MISSING, MISSING)] * slots, 0
    for slot, payload in sorted(chunks):
        index[slot] = (at, len(payload))
        data.append(payload)
        at += len(payload)
    table = b"".join(struct.pack("<QQ", *entry) for entry in index)
    return b"".join([*data, table, struct.pack("<I", crc32c(table))])


def unpack_shard(data: bytes, slots: int) -> dict[int, bytes]:
    """Chunks of a shard by slot; a wrong checksum raises."""
    table = data[-16 * slots - 4 : -4]
    if struct.unpack("<I", data[-4:])[0] != crc32c(table):
        raise ValueError("a shard's index doesn't match its checksum")
    entries = [struct.unpack_from("<QQ", table, 16 * i) for i in range(slots)]
    return {i: data[a : a + n] for i, (a, n) in enumerate(entries) if a != MISSING}


def shard_payloads(frames: DataFrame, cfg: StoreConfig, chunk: tuple[int, ...], shard: tuple[int, ...], width: int, height: int) -> DataFrame:
    """Shard coordinates and bytes. Tiles are dealt out once, by shard, and come in the order of their chunks.

    A shard is put together in one task, as it is one object; the task holds one chunk's samples and the
    shard's stored bytes.
    """
    names, planes = coord_names(cfg), math.prod(chunk[:-2])
    s_names = ["s" + n[1:] for n in names]
    item = np.dtype(DTYPES[cfg.dtype]).itemsize
    tile_bytes, slots = chunk[-2] * chunk[-1] * item, math.prod(shard)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, slot, samples, parts = None, None, bytearray(), []

        def close_chunk() -> None:
            if slot is not None:
                parts.append((slot, compress(bytes(samples), cfg.codec, cfg.level, cfg.shuffle, item)))

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in at), pa.array([pack_shard(parts, slots)], pa.binary())], [*s_names, "payload"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            for *key, now, plane, tile in zip(*columns, batch.column(batch.num_columns - 1), strict=True):
                if key != at or now != slot:
                    close_chunk()
                    if key != at:
                        if at is not None:
                            yield made()
                        at, parts = key, []
                    slot, samples = now, bytearray(planes * tile_bytes)
                samples[plane * tile_bytes : (plane + 1) * tile_bytes] = tile.as_buffer()
        close_chunk()
        if at is not None:
            yield made()

    placed = shard_grid(tiles(frames, cfg, chunk, width, height), shard, tuple(names)).select(*s_names, "slot", "plane", "tile")
    schema = ", ".join(f"{n} long" for n in s_names) + ", payload binary"
    return placed.repartition(*s_names).sortWithinPartitions(*s_names, "slot", "plane").mapInArrow(work, schema)


def objects(frames: DataFrame, cfg: StoreConfig, level) -> DataFrame:
    """key and payload of every data object of a level."""
    from gridloom.plans.metadata import level_chunk, level_shard

    chunk, names = tuple(level_chunk(cfg, level)), coord_names(cfg)
    if cfg.version == 3:
        made, names = shard_payloads(frames, cfg, chunk, tuple(level_shard(cfg, level)), level.width, level.height), ["s" + n[1:] for n in names]
    else:
        made = chunk_payloads(frames, cfg, chunk, level.width, level.height)
    key = F.concat(F.lit(f"{level.level}/"), object_key([F.col(n) for n in names], cfg.version))
    return made.select(key.alias("key"), "payload")


def object_count(cfg: StoreConfig, level, n_frames: int) -> int:
    """Objects of a level that so many frames touch."""
    from gridloom.plans.metadata import level_chunk, level_shard

    chunk = level_chunk(cfg, level)
    extent = [c * s for c, s in zip(chunk, level_shard(cfg, level), strict=True)] if cfg.version == 3 else chunk
    in_frame = -(-level.height // extent[-2]) * -(-level.width // extent[-1])
    between = list(zip(cfg.interior, extent[1:-2], strict=True))
    whole, rest = divmod(n_frames, cfg.frames_per_step * extent[0])
    # frames behind the last whole append object touch what lies between only as far as they go
    touched = set()
    for i in range(min(rest, cfg.frames_per_step)):
        at = []
        for n, e in reversed(between):
            at.append(i % n // e)
            i //= n
        touched.add(tuple(at))
    return (whole * math.prod(-(-n // e) for n, e in between) + len(touched)) * in_frame


class Assembler:
    """All levels' objects from frames that come one by one, by ascending id, with no shuffle.

    ``put`` takes (key, payload). Held are the samples of one append-chunk a level, with version 3 also
    the stored chunks of one append-shard, and with a pyramid one halved frame a level. The first frame
    must begin an append unit: see ``unit_frames``.
    """

    def __init__(self, cfg: StoreConfig, put):
        from gridloom.plans.metadata import level_chunk, level_shard, store_levels

        self.cfg, self.put, self.kind = cfg, put, np.dtype("<" + DTYPES[cfg.dtype])
        self.levels = store_levels(cfg, 0)
        self.chunks = [tuple(level_chunk(cfg, v)) for v in self.levels]
        self.shards = [tuple(level_shard(cfg, v)) if cfg.version == 3 else (1,) * len(cfg.dims) for v in self.levels]
        self.open: list[dict] = [{} for _ in self.levels]  # by outer chunk coordinates, (planes, padded height, padded width) samples
        self.stored: list[dict] = [{} for _ in self.levels]  # by shard, its chunks by slot
        self.waiting: list[tuple[int, np.ndarray] | None] = [None] * len(self.levels)

    def feed(self, frame_id: int, data: bytes | memoryview) -> None:
        want = self.cfg.width * self.cfg.height * self.kind.itemsize
        if len(data) != want:
            raise ValueError(f"frame {frame_id} has {len(data)} bytes, not {want}")
        self._place(0, frame_id, np.frombuffer(data, self.kind).reshape(self.cfg.height, self.cfg.width))

    def _place(self, i: int, frame_id: int, image: np.ndarray) -> None:
        from gridloom.operators.pyramid import halve, mean_of

        chunk, outer = self.chunks[i], self.chunks[i][:-2]
        coords, rest = [], frame_id
        for n in reversed(self.cfg.interior):
            coords.append(rest % n)
            rest //= n
        coords = [rest, *reversed(coords)]
        if any(key[0] != coords[0] // outer[0] for key in self.open[i]):
            self._close_chunks(i)
        if any(key[0] != coords[0] // (outer[0] * self.shards[i][0]) for key in self.stored[i]):
            self._close_shards(i)
        plane = 0
        for c, n in zip(coords, outer, strict=True):
            plane = plane * n + c % n
        key = tuple(c // n for c, n in zip(coords, outer, strict=True))
        ch, cw = chunk[-2:]
        if key not in self.open[i]:
            self.open[i][key] = np.zeros((math.prod(outer), -(-image.shape[0] // ch) * ch, -(-image.shape[1] // cw) * cw), self.kind)
        self.open[i][key][plane, : image.shape[0], : image.shape[1]] = image
        if i + 1 < len(self.levels):
            half, last = halve(image), self.waiting[i]
            if frame_id % 2 == 0:
                self.waiting[i] = (frame_id, half)
            elif last is not None and last[0] == frame_id - 1:
                self.waiting[i] = None
                self._place(i + 1, frame_id // 2, mean_of(last[1], half))

    def _close_chunks(self, i: int) -> None:
        ch, cw = self.chunks[i][-2:]
        for key, samples in self.open[i].items():
            for y in range(samples.shape[1] // ch):
                for x in range(samples.shape[2] // cw):
                    block = samples[:, y * ch : (y + 1) * ch, x * cw : (x + 1) * cw]
                    stored = compress(block.tobytes(), self.cfg.codec, self.cfg.level, self.cfg.shuffle, self.kind.itemsize)
                    at = (*key, y, x)
                    if self.cfg.version == 2:
                        self.put(f"{i}/" + "/".join(map(str, at)), stored)
                        continue
                    slot = 0
                    for c, n in zip(at, self.shards[i], strict=True):
                        slot = slot * n + c % n
                    self.stored[i].setdefault(tuple(c // n for c, n in zip(at, self.shards[i], strict=True)), []).append((slot, stored))
        self.open[i] = {}

    def _close_shards(self, i: int) -> None:
        for key, parts in self.stored[i].items():
            self.put(f"{i}/c/" + "/".join(map(str, key)), pack_shard(parts, math.prod(self.shards[i])))
        self.stored[i] = {}

    def finish(self) -> None:
        for i in range(len(self.levels)):
            self._close_chunks(i)
            self._close_shards(i)


def unit_frames(cfg: StoreConfig) -> int:
    """Frames of an append unit: they touch no object of any level that others touch."""
    from gridloom.plans.metadata import store_levels

    return cfg.chunk_shape[0] * cfg.frames_per_step * (cfg.shard_shape[0] if cfg.version == 3 else 1) * 2 ** store_levels(cfg, 0)[-1].level
