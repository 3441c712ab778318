"""Chunk codecs: byte shuffle, zstd and lz4 in a Blosc 1 container, and crc32c.

The container follows the published chunk format: a 16-byte header (version, codec version, flags,
item size, bytes, block size, compressed bytes), block starts, and for each block a stream length
and one unsplit stream. It is read back here; no other implementation was at hand to try it with.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

# fixed values: flags and codec numbers of the container
_SHUFFLED, _STORED, _UNSPLIT = 0x1, 0x2, 0x10
_CODECS = {"lz4": 1, "zstd": 4}
_HEADER = struct.Struct("<BBBBIII")


def byte_shuffle(data: bytes, item: int) -> bytes:
    n = len(data) // item * item
    return np.frombuffer(data[:n], np.uint8).reshape(-1, item).T.tobytes() + data[n:]


def byte_unshuffle(data: bytes, item: int) -> bytes:
    n = len(data) // item * item
    return np.frombuffer(data[:n], np.uint8).reshape(item, -1).T.tobytes() + data[n:]


def _codec(name: str, level: int) -> pa.Codec:
    return pa.Codec("zstd", compression_level=level) if name == "zstd" else pa.Codec("lz4_raw")


def compress(data: bytes, codec: str | None, level: int = 1, shuffle: int = 1, item: int = 1) -> bytes:
    if codec is None:
        return data
    body = byte_shuffle(data, item) if shuffle == 1 and item > 1 else data
    packed = _codec(codec, level).compress(body, asbytes=True)
    flags = _CODECS[codec] << 5 | _UNSPLIT | (_SHUFFLED if shuffle == 1 else 0)
    if len(packed) + 8 >= len(data):
        return _HEADER.pack(2, 1, flags | _STORED, item, len(data), len(data), 16 + len(data)) + data
    size = 16 + 4 + 4 + len(packed)
    return _HEADER.pack(2, 1, flags, item, len(data), len(data), size) + struct.pack("<II", 20, len(packed)) + packed


def decompress(data: bytes, codec: str | None) -> bytes:
    if codec is None:
        return data
    _, _, flags, item, n, _, size = _HEADER.unpack_from(data)
    if size != len(data):
        raise ValueError("a compressed chunk's length differs from its header's")
    if flags & _STORED:
        return data[16:]
    start, length = struct.unpack_from("<II", data, 16)
    name = next(k for k, v in _CODECS.items() if v == flags >> 5)
    body = _codec(name, 1).decompress(data[start + 4 : start + 4 + length], n, asbytes=True)
    return byte_unshuffle(body, item) if flags & _SHUFFLED and item > 1 else body


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0x82F63B78 if i & 1 else 0)
        out.append(i)
    return out


_CRC = _crc_table()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 0xFF] ^ c >> 8
    return c ^ 0xFFFFFFFF
