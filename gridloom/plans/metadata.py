"""The metadata documents of both format versions."""

from __future__ import annotations

import json

from gridloom.functions.geometry import Level, levels
from gridloom.plans.model import Kind, StoreConfig, item_size, v2_dtype

# fixed values: names of the documents in a store
USER_METADATA, GROUP_V2, ATTRIBUTES_V2, ARRAY_V2, NODE_V3 = "acquire.json", ".zgroup", ".zattrs", ".zarray", "zarr.json"


def store_levels(cfg: StoreConfig, n_frames: int) -> list[Level]:
    return levels(cfg.width, cfg.height, n_frames, cfg.dims[-1].chunk_size, cfg.dims[-2].chunk_size, cfg.multiscale)


def multiscales(cfg: StoreConfig) -> list[dict]:
    def scale(i: int) -> list[float]:
        return [float(2**i), *[1.0] * (len(cfg.dims) - 3), float(2**i), float(2**i)]

    axes = []
    for i, d in enumerate(cfg.dims):
        frame = d.kind is Kind.SPACE and i >= len(cfg.dims) - 2
        axes.append({"name": d.name, "type": d.kind.value} | ({"unit": "micrometer"} if frame else {}))
    datasets = [{"path": str(v.level), "coordinateTransformations": [{"type": "scale", "scale": scale(v.level)}]} for v in store_levels(cfg, 0)]
    made = {"version": "0.4", "axes": axes, "datasets": datasets}
    return [made | ({"type": "local_mean"} if cfg.multiscale else {})]


def array_shape(cfg: StoreConfig, level: Level) -> list[int]:
    return [cfg.steps(level.frames), *cfg.interior, level.height, level.width]


def level_chunk(cfg: StoreConfig, level: Level) -> list[int]:
    return [*cfg.chunk_shape[:-2], level.chunk_height, level.chunk_width]


def compressor_v2(cfg: StoreConfig) -> dict | None:
    if cfg.codec is None:
        return None
    return {"id": "blosc", "cname": cfg.codec, "clevel": cfg.level, "shuffle": cfg.shuffle, "blocksize": 0}


def compressor_v3(cfg: StoreConfig) -> dict:
    shuffle = {0: "noshuffle", 1: "shuffle", 2: "bitshuffle"}[cfg.shuffle]
    return {"name": "blosc", "configuration": {"blocksize": 0, "clevel": cfg.level, "cname": cfg.codec, "shuffle": shuffle, "typesize": item_size(cfg.dtype)}}


def array_v2(cfg: StoreConfig, level: Level) -> dict:
    return {
        "zarr_format": 2,
        "shape": array_shape(cfg, level),
        "chunks": level_chunk(cfg, level),
        "dtype": v2_dtype(cfg.dtype),
        "fill_value": 0,
        "order": "C",
        "filters": None,
        "dimension_separator": "/",
        "compressor": compressor_v2(cfg),
    }


def array_v3(cfg: StoreConfig, level: Level) -> dict:
    chunk = level_chunk(cfg, level)
    inner = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([compressor_v3(cfg)] if cfg.codec else [])
    sharding = {
        "name": "sharding_indexed",
        "configuration": {
            "chunk_shape": chunk,
            "codecs": inner,
            "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}],
            "index_location": "end",
        },
    }
    return {
        "zarr_format": 3,
        "node_type": "array",
        "shape": array_shape(cfg, level),
        "data_type": cfg.dtype,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [c * s for c, s in zip(chunk, level_shard(cfg, level), strict=True)]}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "fill_value": 0,
        "codecs": [sharding],
        "attributes": {},
        "extensions": [],
        "dimension_names": [d.name for d in cfg.dims],
        "storage_transformers": [],
    }


def level_shard(cfg: StoreConfig, level: Level) -> list[int]:
    """Chunks of a shard along each dimension; above level 0 no more than the level has."""
    out = list(cfg.shard_shape)
    if level.level:
        out[-2] = min(out[-2], -(-level.height // level.chunk_height))
        out[-1] = min(out[-1], -(-level.width // level.chunk_width))
    return out


def documents(cfg: StoreConfig, n_frames: int) -> dict[str, str]:
    """All documents of a store, by name relative to its root."""
    out = {USER_METADATA: cfg.metadata}
    if cfg.version == 2:
        out[GROUP_V2] = json.dumps({"zarr_format": 2})
        out[ATTRIBUTES_V2] = json.dumps({"multiscales": multiscales(cfg)})
    else:
        out[NODE_V3] = json.dumps({"zarr_format": 3, "node_type": "group", "consolidated_metadata": None, "attributes": {"multiscales": multiscales(cfg)}})
    for level in store_levels(cfg, n_frames):
        name, made = (ARRAY_V2, array_v2) if cfg.version == 2 else (NODE_V3, array_v3)
        out[f"{level.level}/{name}"] = json.dumps(made(cfg, level))
    return out
