"""Array configuration: dtypes, dimensions, store settings, and the rules they must meet."""

from __future__ import annotations

import json
import logging
import math
from dataclasses import dataclass, field, replace
from enum import Enum, IntEnum

# fixed values: status codes and their order
STATUS = ("Success", "InvalidArgument", "Overflow", "InvalidIndex", "NotYetImplemented", "InternalError", "OutOfMemory", "IOError", "CompressionError", "InvalidSettings")
StatusCode = IntEnum("StatusCode", [(n, i) for i, n in enumerate(STATUS)])
MESSAGES = {
    "Success": "Success",
    "InvalidArgument": "Invalid argument",
    "Overflow": "Buffer overflow",
    "InvalidIndex": "Invalid index",
    "NotYetImplemented": "Not yet implemented",
    "InternalError": "Internal error",
    "OutOfMemory": "Out of memory",
    "IOError": "I/O error",
    "CompressionError": "Compression error",
    "InvalidSettings": "Invalid settings",
}


def status_message(code: int) -> str:
    return MESSAGES[STATUS[code]] if 0 <= code < len(STATUS) else "Unknown status"


class StoreError(Exception):
    """A failure with a status code."""

    def __init__(self, code: StatusCode, text: str):
        super().__init__(f"{status_message(code)}: {text}")
        self.code = code


def require(ok: bool, text: str, code: StatusCode = StatusCode.InvalidSettings) -> None:
    if not ok:
        raise StoreError(code, text)


# fixed values: stored dtypes (numpy letter and bytes) and the sample types a camera may deliver
DTYPES = {"uint8": "u1", "uint16": "u2", "uint32": "u4", "uint64": "u8", "int8": "i1", "int16": "i2", "int32": "i4", "int64": "i8", "float32": "f4", "float64": "f8"}
SAMPLE_TYPES = {"u8": "uint8", "u10": "uint16", "u12": "uint16", "u14": "uint16", "u16": "uint16", "i8": "int8", "i16": "int16", "f32": "float32"}
#: Spark types that hold every value of a stored dtype.
SPARK_TYPES = {"uint8": "short", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double"}


def dtype_of(sample_type: str) -> str:
    require(sample_type in SAMPLE_TYPES, f"unsupported sample type {sample_type!r}", StatusCode.InvalidArgument)
    return SAMPLE_TYPES[sample_type]


def item_size(dtype: str) -> int:
    return int(DTYPES[dtype][1:])


def v2_dtype(dtype: str, order: str = "<") -> str:
    return order + DTYPES[dtype]


class Kind(Enum):
    SPACE, CHANNEL, TIME, OTHER = "space", "channel", "time", "other"


@dataclass(frozen=True)
class Dimension:
    """Sizes in pixels; ``shard_chunks`` in chunks. The first dimension of an array has array size 0 and grows."""

    name: str
    kind: Kind
    array_size: int
    chunk_size: int
    shard_chunks: int = 1

    def check(self, append: bool) -> None:
        require(isinstance(self.kind, Kind), f"dimension {self.name!r} has an unknown kind")
        require(bool(self.name), "a dimension needs a name")
        require(self.chunk_size > 0, f"dimension {self.name!r} needs a chunk size")
        if append:
            require(self.array_size == 0, f"append dimension {self.name!r} must have array size 0")
        else:
            require(self.array_size > 0, f"dimension {self.name!r} needs an array size")


def dimensions(*rows: tuple) -> tuple[Dimension, ...]:
    return tuple(Dimension(r[0], Kind(r[1]), *r[2:]) for r in rows)


def check_json(text: str | None) -> str:
    """The metadata text if it is empty or JSON (// and /* */ comments and white space around it are fine)."""
    if text is None or not text.strip():
        return "{}"
    try:
        json.loads(strip_comments(text))
    except ValueError as e:
        raise StoreError(StatusCode.InvalidArgument, f"metadata isn't JSON: {e}") from e
    return text


def strip_comments(text: str) -> str:
    out, i, inside = [], 0, False
    while i < len(text):
        c = text[i]
        if inside:
            out.append(text[i : i + 2] if c == "\\" else c)
            i += 2 if c == "\\" else 1
            inside = c != '"'
        elif text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = end + 2 if end >= 0 else len(text)
            out.append(" ")
        else:
            inside = c == '"'
            out.append(c)
            i += 1
    return "".join(out)


@dataclass(frozen=True)
class StoreConfig:
    """All of a store's settings; ``check`` raises ``StoreError`` at the first rule that isn't met."""

    uri: str
    dims: tuple[Dimension, ...]
    version: int = 2
    codec: str | None = None
    level: int = 1
    shuffle: int = 1
    multiscale: bool = False
    dtype: str = "uint8"
    metadata: str = "{}"
    access_key: str | None = field(default=None, repr=False)
    secret_key: str | None = field(default=None, repr=False)

    def check(self) -> StoreConfig:
        from gridloom.functions.uri import is_web_uri, s3_parts

        require(self.version in (2, 3), f"unknown format version {self.version}")
        require(self.codec in (None, "zstd", "lz4"), f"unknown codec {self.codec!r}")
        require(0 <= self.level <= 9, "compression level must be 0 to 9")
        require(0 <= self.shuffle <= 2, "shuffle must be 0, 1 or 2")
        require(self.dtype in DTYPES, f"unknown dtype {self.dtype!r}")
        require(bool(self.uri), "a store needs a URI")
        if is_web_uri(self.uri):
            s3_parts(self.uri)
            require(bool(self.access_key) and bool(self.secret_key), "a web store needs an access key and a secret")
        require(len(self.dims) >= 3, "at least three dimensions are needed")
        for i, d in enumerate(self.dims):
            d.check(append=i == 0)
            require(self.version == 2 or d.shard_chunks > 0, f"dimension {d.name!r} needs a shard size")
        return replace(self, metadata=check_json(self.metadata))

    def check_frame(self, width: int, height: int) -> None:
        require(self.dims[-2].array_size == height, f"frames are {height} high, the array {self.dims[-2].array_size}", StatusCode.InvalidArgument)
        require(self.dims[-1].array_size == width, f"frames are {width} wide, the array {self.dims[-1].array_size}", StatusCode.InvalidArgument)

    @property
    def height(self) -> int:
        return self.dims[-2].array_size

    @property
    def width(self) -> int:
        return self.dims[-1].array_size

    @property
    def frame_bytes(self) -> int:
        return self.width * self.height * item_size(self.dtype)

    @property
    def interior(self) -> tuple[int, ...]:
        """Array sizes between the append dimension and the frame."""
        return tuple(d.array_size for d in self.dims[1:-2])

    @property
    def frames_per_step(self) -> int:
        return math.prod(self.interior)

    @property
    def chunk_shape(self) -> tuple[int, ...]:
        return tuple(d.chunk_size for d in self.dims)

    @property
    def shard_shape(self) -> tuple[int, ...]:
        """Chunks of a shard along each dimension."""
        return tuple(d.shard_chunks for d in self.dims)

    @property
    def chunk_bytes(self) -> int:
        return math.prod(self.chunk_shape) * item_size(self.dtype)

    @property
    def chunks_per_shard(self) -> int:
        return math.prod(self.shard_shape)

    def steps(self, n_frames: int) -> int:
        """The append dimension's size after so many frames."""
        return -(-n_frames // self.frames_per_step)


def multiscale_ready(dims: tuple[Dimension, ...]) -> bool:
    """Whether a pyramid can be made: frames in space, and nothing of more than one step between."""
    return len(dims) >= 3 and all(d.kind is Kind.SPACE for d in dims[-2:]) and all(d.array_size == 1 for d in dims[1:-2])


log = logging.getLogger("gridloom")
#: fixed values: log levels from the most to the least talkative
LOG_LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warning": logging.WARNING, "error": logging.ERROR, "none": logging.CRITICAL + 1}


def set_log_level(name: str) -> None:
    require(name in LOG_LEVELS, f"unknown log level {name!r}", StatusCode.InvalidArgument)
    log.setLevel(LOG_LEVELS[name])


def get_log_level() -> str:
    return next((k for k, v in LOG_LEVELS.items() if v == log.level), "error")
