"""Coordinates of frames, chunks and shards. Dimensions run from the slowest to the fastest."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, n: int) -> Column:
    """Whole-number division of a non-negative column, as long."""
    return F.call_function("div", a.cast("long"), F.lit(n).cast("long")) if n != 1 else a.cast("long")


def align_up(n, step: int):
    """The least multiple of ``step`` that isn't below ``n``, a number or a column."""
    return div(n + (step - 1), step) * step if isinstance(n, Column) else -(-n // step) * step


def unravel(frame_id: Column, interior: tuple[int, ...]) -> list[Column]:
    """Append coordinate and interior coordinates of a frame; the last interior one is the fastest."""
    out, rest = [], frame_id.cast("long")
    for n in reversed(interior):
        out.append(F.pmod(rest, F.lit(n)).cast("long"))
        rest = div(rest, n)
    return [rest, *reversed(out)]


def append_size(n_frames: Column, interior: tuple[int, ...]) -> Column:
    return F.ceil(n_frames / F.lit(math.prod(interior))).cast("long")


def row_major(coords: list[Column], shape: tuple[int, ...]) -> Column:
    """Place of coordinates (each below its extent) in a row-major block."""
    return reduce(lambda at, cn: at * F.lit(cn[1]) + cn[0], zip(coords[1:], shape[1:], strict=True), coords[0].cast("long"))


def in_chunk_offset(coords: list[Column], chunk: tuple[int, ...]) -> Column:
    return row_major([F.pmod(c, F.lit(n)) for c, n in zip(coords, chunk, strict=True)], chunk)


def shard_slot(chunk_coords: list[Column], shard: tuple[int, ...]) -> Column:
    return in_chunk_offset(chunk_coords, shard)


def object_key(coords: list[Column], version: int) -> Column:
    """Object name below the level: c0/c1/..., under c/ for shards."""
    parts = [c.cast("string") for c in coords]
    return F.concat_ws("/", *([F.lit("c")] if version == 3 else []), *parts)


@dataclass(frozen=True)
class Level:
    level: int
    width: int
    height: int
    chunk_width: int
    chunk_height: int
    frames: int

    @property
    def scale(self) -> int:
        return 2**self.level


def levels(width: int, height: int, frames: int, chunk_width: int, chunk_height: int, multiscale: bool = True) -> list[Level]:
    """The pyramid's levels: halved until a level fits one chunk, level 1 always; chunks are clipped from level 1 on."""
    out = [Level(0, width, height, chunk_width, chunk_height, frames)]
    while multiscale:
        last = out[-1]
        w, h = (last.width + 1) // 2, (last.height + 1) // 2
        out.append(Level(last.level + 1, w, h, min(chunk_width, w), min(chunk_height, h), last.frames // 2))
        if w <= chunk_width and h <= chunk_height:
            break
    return out
