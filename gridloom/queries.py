"""The catalogue: a query for each operator over the test tables, with SQL that gives the same rows.

Frames come from ``embeddings`` (one 8x8 frame a vector; in another layout rows of 7 samples, the last
one short, so that sizes are odd), the append stream from ``events``. Rules are tried on values made
from the rows of ``part``, ``nation`` and ``pages``.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import astuple, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import gridloom
from gridloom.functions import geometry as geo
from gridloom.functions import uri as uris
from gridloom.functions.codec import crc32c
from gridloom.functions.jsons import json_ok
from gridloom.operators import frames as fr
from gridloom.operators import pyramid as pyr
from gridloom.operators import reshape as rs
from gridloom.plans import lifecycle, metadata
from gridloom.plans.model import LOG_LEVELS, Dimension, Kind, StoreConfig, StoreError, dimensions, get_log_level, multiscale_ready, set_log_level, status_message
from gridloom.sources import store
from gridloom.sources.shared import shared_folder
from gridloom.streaming.sink import StreamSink, rollover_counts

CHUNK, SHARD = (64, 5, 3), (2, 1, 2)
ODD = 7
LEVELS = 4

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str, width: int = 8) -> DataFrame:
    flat = fr.frames_to_pixels(table(spark, sf_dir, "embeddings"), width, "vec_id", "embedding")
    return flat.withColumn("value", fr.byte_pixels(F.col("value")))


def odd_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir, ODD)


def packed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id and bytes of the 8x8 frames."""
    made = fr.pixels_to_frames(pixels(spark, sf_dir))
    return made.select("frame_id", F.expr("unhex(array_join(transform(data, v -> lpad(hex(v), 2, '0')), ''))").alias("data"))


def each(kind: str, f: Callable) -> Callable:
    """A row-wise function of the library as a column function."""
    return F.udf(f, kind, useArrow=True)


def passes(f: Callable, *args) -> bool:
    try:
        f(*args)
    except (StoreError, ValueError):
        return False
    return True


def _samples(width: int) -> str:
    return f"""SELECT CAST(vec_id AS BIGINT) AS t, CAST(i // {width} AS BIGINT) AS y, CAST(i % {width} AS BIGINT) AS x,
         CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 1.0) * 127.5))) AS INTEGER) AS value
  FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS i FROM embeddings)"""


_PIXELS = f"pixels AS ({_samples(8)}), odd AS ({_samples(ODD)})"
_GRID = f"""{_PIXELS}, grid AS (
  SELECT t // 64 AS ct, y // 5 AS cy, x // 3 AS cx, count(*) AS n_valid, CAST(sum(value) AS BIGINT) AS total
  FROM pixels GROUP BY ALL
)"""


@query(f"WITH {_PIXELS} SELECT * FROM pixels")
def o01_frames_to_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir)


@query("""SELECT event_id,
  CAST(CASE WHEN event_id BETWEEN 0 AND 255 THEN event_id END AS SMALLINT) AS u8,
  CAST(CASE WHEN event_id BETWEEN 0 AND 65535 THEN event_id END AS INTEGER) AS u12,
  CAST(CASE WHEN event_id - 5000 BETWEEN -128 AND 127 THEN event_id - 5000 END AS TINYINT) AS i8,
  CAST(CASE WHEN event_id - 5000 BETWEEN -32768 AND 32767 THEN event_id - 5000 END AS SMALLINT) AS i16
FROM events""")
def o13_dtype_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", fr.coerce(e, "u8").alias("u8"), fr.coerce(e, "u12").alias("u12"), fr.coerce(e - 5000, "i8").alias("i8"), fr.coerce(e - 5000, "i16").alias("i16"))


@query("SELECT event_id, event_id // 24 AS t, (event_id // 8) % 3 AS c, event_id % 8 AS z FROM events")
def o14_unravel(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, c, z = geo.unravel(F.col("event_id"), (3, 8))
    return table(spark, sf_dir, "events").select("event_id", t.alias("t"), c.alias("c"), z.alias("z"))


@query("SELECT count(*) AS n_frames, CAST((count(*) + 23) // 24 AS BIGINT) AS append_size FROM events")
def o15_append_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n_frames"), geo.append_size(F.count("*"), (3, 8)).alias("append_size"))


@query(f"WITH {_GRID} SELECT * FROM grid")
def o16_chunk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.chunk_grid(pixels(spark, sf_dir), CHUNK)


@query(f"WITH {_PIXELS} SELECT t, y, x, ((t % 64) * 5 + y % 5) * 3 + x % 3 AS at FROM pixels")
def o17_in_chunk_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("t", "y", "x", geo.in_chunk_offset([F.col("t"), F.col("y"), F.col("x")], CHUNK).alias("at"))


@query(f"""WITH {_GRID} SELECT ct, cy, cx, n_valid, total, ct // 2 AS st, cy // 1 AS sy, cx // 2 AS sx,
  CAST(((ct % 2) * 1 + cy % 1) * 2 + cx % 2 AS INTEGER) AS slot FROM grid""")
def o18_shard_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.shard_grid(o16_chunk_grid(spark, sf_dir), SHARD)


@query(f"WITH {_GRID} SELECT ct, cy, cx, concat_ws('/', ct, cy, cx) AS v2_key, concat_ws('/', 'c', ct // 2, cy, cx // 2) AS v3_key FROM grid")
def o19_object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = o18_shard_grid(spark, sf_dir)
    key = lambda names, version: geo.object_key([F.col(n) for n in names], version)
    return g.select("ct", "cy", "cx", key(("ct", "cy", "cx"), 2).alias("v2_key"), key(("st", "sy", "sx"), 3).alias("v3_key"))


@query("SELECT event_id, CAST(16 * ((event_id + 15) // 16) AS BIGINT) AS aligned FROM events")
def o20_align_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", geo.align_up(F.col("event_id"), 16).alias("aligned"))


@query(f"WITH {_GRID} SELECT *, CAST(960 AS BIGINT) AS n_full, CAST(960 - n_valid AS BIGINT) AS n_padding FROM grid")
def o21_chunk_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.chunk_extents(o16_chunk_grid(spark, sf_dir), CHUNK)


@query(f"""WITH {_GRID}, slots AS (SELECT ct, cy, cx, unnest(range(960)) AS o FROM grid),
placed AS (SELECT t // 64 AS ct, y // 5 AS cy, x // 3 AS cx, ((t % 64) * 5 + y % 5) * 3 + x % 3 AS o, value FROM pixels)
SELECT ct, cy, cx, array_to_string(list(coalesce(value, 0) ORDER BY o), ',') AS payload, CAST(count(*) AS INTEGER) AS n
FROM slots LEFT JOIN placed USING (ct, cy, cx, o) GROUP BY ct, cy, cx""")
def o21_chunk_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = rs.chunk_fill(pixels(spark, sf_dir), CHUNK)
    return filled.select("ct", "cy", "cx", F.array_join("payload", ",").alias("payload"), F.size("payload").alias("n"))


_SHARDS = f"""{_GRID}, placed AS (
  SELECT ct // 2 AS st, cy // 1 AS sy, cx // 2 AS sx, ((ct % 2) * 1 + cy % 1) * 2 + cx % 2 AS slot FROM grid
)"""


@query(f"WITH {_SHARDS} SELECT st, sy, sx, count(*) AS n_chunks, CAST(count(*) * 960 + 16 * 4 + 4 AS BIGINT) AS n_bytes FROM placed GROUP BY st, sy, sx")
def o38_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.shard_bytes(o16_chunk_grid(spark, sf_dir), SHARD, math.prod(CHUNK))


@query(f"""WITH {_SHARDS}, slots AS (SELECT DISTINCT st, sy, sx, s AS slot FROM placed, range(4) r(s)),
have AS (SELECT slots.*, CASE WHEN placed.slot IS NULL THEN NULL ELSE 960 END AS n FROM slots LEFT JOIN placed USING (st, sy, sx, slot))
SELECT st, sy, sx, CAST(slot AS INTEGER) AS slot,
  CAST(CASE WHEN n IS NULL THEN -1 ELSE coalesce(sum(n) OVER (PARTITION BY st, sy, sx ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS BIGINT) AS "offset",
  CAST(coalesce(n, -1) AS BIGINT) AS n_bytes FROM have""")
def o39_shard_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.shard_index(o16_chunk_grid(spark, sf_dir), SHARD, size=F.lit(math.prod(CHUNK)))


_HALF = """half AS (
  SELECT t, y // 2 AS y, x // 2 AS x, CAST(floor(avg(value)) AS INTEGER) AS value FROM odd GROUP BY ALL
)"""


@query(f"WITH {_PIXELS}, {_HALF} SELECT * FROM half")
def o41_downsample_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyr.downsample_spatial(odd_pixels(spark, sf_dir))


@query(f"""WITH {_PIXELS} SELECT t, y // 2 AS y, x // 2 AS x, CAST(trunc(avg(value - 128)) AS INTEGER) AS value
FROM odd GROUP BY ALL""")
def o41_downsample_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyr.downsample_spatial(odd_pixels(spark, sf_dir).withColumn("value", F.col("value") - 128))


@query(f"""WITH {_PIXELS}, {_HALF}
SELECT t // 2 AS t, y, x, CAST(floor(avg(value)) AS INTEGER) AS value FROM half GROUP BY 1, 2, 3 HAVING count(*) = 2""")
def o42_downsample_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyr.downsample_temporal(pyr.downsample_spatial(odd_pixels(spark, sf_dir)))


_LEVEL_SQL = ", ".join(
    f"""s{i} AS (SELECT t, y // 2 AS y, x // 2 AS x, floor(avg(value)) AS value FROM l{i - 1} GROUP BY ALL),
l{i} AS (SELECT t // 2 AS t, y, x, floor(avg(value)) AS value FROM s{i} GROUP BY 1, 2, 3 HAVING count(*) = 2)"""
    for i in range(1, LEVELS)
)
_LEVEL_ROWS = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS level, t, y, x, CAST(value AS INTEGER) AS value FROM l{i}" for i in range(LEVELS))


@query(f"WITH {_PIXELS}, l0 AS (SELECT * FROM odd), {_LEVEL_SQL} {_LEVEL_ROWS}")
def o46_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyr.pyramid(odd_pixels(spark, sf_dir), LEVELS)


_FRAME_COUNTS = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS level, CAST(count(*) // {2**i} AS BIGINT) AS n_frames FROM embeddings" for i in range(LEVELS))


@query(_FRAME_COUNTS)
def o43_level_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = o46_pyramid(spark, sf_dir)
    return made.where("y = 0 and x = 0").groupBy("level").agg(F.count("*").alias("n_frames"))


# levels by name: sizes halve, rounded up, until a level fits one chunk; the first halving always happens
_LEVELS_OF = """lv AS (
  SELECT k, 0 AS l, w, h, cw, ch, n FROM given
  UNION ALL SELECT k, l + 1, (w + 1) // 2, (h + 1) // 2, least(cw, (w + 1) // 2), least(ch, (h + 1) // 2), n // 2 FROM lv WHERE l = 0 OR w > cw OR h > ch
)"""


@query(f"""WITH RECURSIVE given AS (SELECT DISTINCT p_size AS k, 16 * p_size + 7 AS w, 9 * p_size + 1 AS h, 64 AS cw, 48 AS ch, 10 * p_size AS n FROM part), {_LEVELS_OF}
SELECT k AS p_size, CAST(l AS INTEGER) AS level, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height, CAST(cw AS INTEGER) AS chunk_width,
  CAST(ch AS INTEGER) AS chunk_height, CAST(n AS INTEGER) AS frames, CAST(1 << l AS INTEGER) AS scale FROM lv""")
def o44_pyramid_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "array<struct<level:int,width:int,height:int,chunk_width:int,chunk_height:int,frames:int,scale:int>>"
    made = each(kind, lambda k: [(v.level, v.width, v.height, v.chunk_width, v.chunk_height, v.frames, v.scale) for v in geo.levels(16 * k + 7, 9 * k + 1, 10 * k, 64, 48)])
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    return sizes.select("p_size", F.inline(made("p_size")))


def _config(version: int, codec: str | None = None, multiscale: bool = False) -> StoreConfig:
    dims = dimensions(("t", "time", 0, 64, 2), ("c", "channel", 1, 1, 1), ("y", "space", 8, 4, 2), ("x", "space", 8, 4, 1))
    return StoreConfig("/tmp/store", dims, version, codec, multiscale=multiscale)


def _document(spark: SparkSession, sf_dir: str, cfg: StoreConfig, pick: Callable[[dict], dict]) -> DataFrame:
    """The fields of the level-0 array document, whose append size is counted."""
    n = table(spark, sf_dir, "embeddings").agg(F.count("*")).first()[0]
    name = metadata.ARRAY_V2 if cfg.version == 2 else metadata.NODE_V3
    doc = pick(json.loads(metadata.documents(cfg, n)[f"0/{name}"]))
    return spark.createDataFrame([(k, json.dumps(v, separators=(",", ":"))) for k, v in doc.items()], "field string, value string")


@query("""SELECT * FROM (SELECT 'dtype' AS field, '"<u1"' AS value UNION ALL SELECT 'chunks', '[64,1,4,4]'
UNION ALL SELECT 'shape', '[' || count(*) || ',1,8,8]' FROM embeddings)""")
def o48_array_metadata_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document(spark, sf_dir, _config(2), lambda d: {k: d[k] for k in ("dtype", "chunks", "shape")})


@query("""SELECT 'shape' AS field, '[' || count(*) || ',1,8,8]' AS value FROM embeddings
UNION ALL SELECT * FROM (VALUES ('data_type', '"uint8"'), ('extensions', '[]'), ('grid', '"regular"'), ('shard_shape', '[128,1,8,4]'),
('separator', '"/"'), ('n_codecs', '1'), ('chunk_shape', '[64,1,4,4]'), ('n_inner', '2'),
('blosc', '{"blocksize":0,"clevel":1,"cname":"zstd","shuffle":"shuffle","typesize":1}'))""")
def o51_array_metadata_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pick(d: dict) -> dict:
        inner = d["codecs"][0]["configuration"]
        return {
            "shape": d["shape"],
            "data_type": d["data_type"],
            "extensions": d["extensions"],
            "grid": d["chunk_grid"]["name"],
            "shard_shape": d["chunk_grid"]["configuration"]["chunk_shape"],
            "separator": d["chunk_key_encoding"]["configuration"]["separator"],
            "n_codecs": len(d["codecs"]),
            "chunk_shape": inner["chunk_shape"],
            "n_inner": len(inner["codecs"]),
            "blosc": inner["codecs"][1]["configuration"],
        }

    return _document(spark, sf_dir, _config(3, "zstd"), pick)


_NATION_LEVELS = f"given AS (SELECT n_nationkey AS k, 8 * (n_nationkey + 1) AS w, 8 * (n_regionkey + 1) AS h, 8 AS cw, 8 AS ch, 0 AS n FROM nation), {_LEVELS_OF}"


def _nation_config(key: int, region: int, version: int) -> StoreConfig:
    dims = dimensions(("t", "time", 0, 64, 2), ("c", "channel", 1, 1, 1), ("y", "space", 8 * (region + 1), 8, 1), ("x", "space", 8 * (key + 1), 8, 1))
    return StoreConfig("/tmp/store", dims, version, multiscale=key % 5 > 0)


def _scales(key: int, region: int, version: int) -> list[tuple]:
    """Path, scale and kind of a group document's datasets."""
    made = metadata.documents(_nation_config(key, region, version), 0)
    text = json.loads(made[metadata.ATTRIBUTES_V2 if version == 2 else metadata.NODE_V3])
    (m,) = text["multiscales"] if version == 2 else text["attributes"]["multiscales"]
    axes = ",".join(":".join(a.values()) for a in m["axes"])
    return [(d["path"], ",".join(map(str, d["coordinateTransformations"][0]["scale"])), m.get("type", ""), axes, text.get("zarr_format", 2)) for d in m["datasets"]]


def _group_sql(version: int) -> str:
    return f"""WITH RECURSIVE {_NATION_LEVELS} SELECT CAST(k AS INTEGER) AS n_nationkey, CAST(l AS VARCHAR) AS path,
  CAST(CAST(1 << l AS DOUBLE) AS VARCHAR) || ',1.0,' || CAST(CAST(1 << l AS DOUBLE) AS VARCHAR) || ',' || CAST(CAST(1 << l AS DOUBLE) AS VARCHAR) AS scale,
  CASE WHEN k % 5 > 0 THEN 'local_mean' ELSE '' END AS type, 't:time,c:channel,y:space:micrometer,x:space:micrometer' AS axes, CAST({version} AS INTEGER) AS format
FROM lv WHERE l = 0 OR k % 5 > 0"""


def _groups(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    made = each("array<struct<path:string,scale:string,type:string,axes:string,format:int>>", lambda k, r: _scales(k, r, version))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.inline(made("n_nationkey", "n_regionkey")))


@query(_group_sql(2))
def o49_group_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir, 2)


@query(_group_sql(3))
def o50_group_metadata_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir, 3)


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '{}' ELSE props END AS document FROM events")
def o53_user_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = each("string", lambda text: metadata.documents(replace(_config(2), metadata=text).check(), 0)[metadata.USER_METADATA])
    text = F.when(F.col("event_id") % 10 == 0, F.lit("  ")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", made(text).alias("document"))


_KIND_NAMES = ("space", "time", "channel", "spice")


@query("""SELECT p_partkey, p_partkey % 4 < 3 AND p_size % 7 <> 0 AND p_size % 4 > 0
  AND CASE WHEN p_size % 2 = 0 THEN p_partkey % 3 = 0 ELSE p_partkey % 3 > 0 END AS ok FROM part""")
def o22_validate_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    def check(key: int, size: int) -> bool:
        return passes(lambda: Dimension("d" if size % 7 else "", Kind(_KIND_NAMES[key % 4]), key % 3, size % 4).check(append=size % 2 == 0))

    return table(spark, sf_dir, "part").select("p_partkey", each("boolean", check)("p_partkey", "p_size").alias("ok"))


@query("SELECT p_partkey, p_size % 4 > 0 AND p_size % 5 <> 0 AND (p_size % 4 = 1 OR p_partkey % 2 = 0) AS ready FROM part")
def o26_multiscale_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    def ready(key: int, size: int) -> bool:
        between = [(f"c{i}", "channel", 1 + key % 2, 1) for i in range(size % 4 - 1)]
        rows = ([("t", "time", 0, 1)] if size % 4 else []) + between + [("y", "space", 8, 8), ("x", "space" if size % 5 else "time", 8, 8)]
        return multiscale_ready(dimensions(*rows))

    return table(spark, sf_dir, "part").select("p_partkey", each("boolean", ready)("p_partkey", "p_size").alias("ready"))


@query("SELECT p_partkey, p_size % 5 IN (2, 3) AND p_partkey % 4 < 3 AND p_size % 12 <= 9 AND p_partkey % 5 <= 2 AS ok FROM part")
def o27_kind_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    def check(key: int, size: int) -> bool:
        made = replace(_config(2), version=size % 5, codec=(None, "zstd", "lz4", "gzip")[key % 4], level=size % 12, shuffle=key % 5)
        return passes(made.check)

    return table(spark, sf_dir, "part").select("p_partkey", each("boolean", check)("p_partkey", "p_size").alias("ok"))


@query("SELECT p_partkey, p_size % 3 = 1 AND p_partkey % 3 = 1 AS ok FROM part")
def o28_frame_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    def check(key: int, size: int) -> bool:
        dims = dimensions(("t", "time", 0, 1), ("y", "space", 1 + size % 3, 1), ("x", "space", 1 + key % 3, 1))
        return passes(StoreConfig("/tmp/store", dims).check_frame, 2, 2)

    return table(spark, sf_dir, "part").select("p_partkey", each("boolean", check)("p_partkey", "p_size").alias("ok"))


@query("""SELECT page_id, page_id % 4 > 0 AND page_id % 3 > 0 AND CASE page_id % 4 WHEN 1 THEN len(list_filter(string_split(url, '/'), lambda p: p <> '')) > 3 ELSE true END AS ok FROM pages""")
def o24_validate_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    def check(key: int, url: str) -> bool:
        uri = ("", url, f"{url}/bucket/key/more", "file:///tmp/store")[key % 4]
        text = '{"a": 1} x' if key % 3 == 0 else '{"a": 1}'
        return passes(replace(_config(2), uri=uri, metadata=text, access_key="a", secret_key="b").check)

    return table(spark, sf_dir, "pages").select("page_id", each("boolean", check)("page_id", "url").alias("ok"))


@query("SELECT n_nationkey, n_nationkey % 3 = 0 AS ok FROM nation")
def o29_writable_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = Path(uris.strip_scheme(shared_folder(spark))) / f"gridloom-parents-{uuid.uuid4().hex}"
    (top / "folder").mkdir(parents=True)
    (top / "file").write_text("")
    ok = [passes(store.check_target, replace(_config(2), uri=str(top / parent / "store"))) for parent in ("folder", "absent", "file")]
    found = spark.createDataFrame(list(enumerate(ok)), "parent int, ok boolean")
    return table(spark, sf_dir, "nation").withColumn("parent", F.col("n_nationkey") % 3).join(F.broadcast(found), "parent").select("n_nationkey", "ok")


@query("SELECT vec_id AS frame_id, vec_id % 50 <> 0 AS whole FROM embeddings")
def o30_short_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.when(F.col("frame_id") % 50 == 0, F.expr("substring(data, 1, 63)")).otherwise(F.col("data"))
    return fr.whole_frames(packed_frames(spark, sf_dir).withColumn("data", cut), _config(2)).select("frame_id", "whole")


@query("""SELECT n_nationkey, CASE n_nationkey WHEN 0 THEN 'Storage_Zarr' WHEN 1 THEN 'Storage_ZarrBlosc1ZstdByteShuffle' WHEN 2 THEN 'Storage_ZarrBlosc1Lz4ByteShuffle'
  WHEN 3 THEN 'Storage_ZarrV3' WHEN 4 THEN 'Storage_ZarrV3Blosc1ZstdByteShuffle' WHEN 5 THEN 'Storage_ZarrV3Blosc1Lz4ByteShuffle' ELSE '(unknown)' END AS name FROM nation""")
def o36_kind_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", each("string", lifecycle.kind_name)("n_nationkey").alias("name"))


@query("""SELECT n_nationkey, CASE n_nationkey WHEN 0 THEN 'Success' WHEN 1 THEN 'Invalid argument' WHEN 2 THEN 'Buffer overflow' WHEN 3 THEN 'Invalid index'
  WHEN 4 THEN 'Not yet implemented' WHEN 5 THEN 'Internal error' WHEN 6 THEN 'Out of memory' WHEN 7 THEN 'I/O error' WHEN 8 THEN 'Compression error'
  WHEN 9 THEN 'Invalid settings' ELSE 'Unknown status' END AS message FROM nation""")
def o37_status_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", each("string", status_message)("n_nationkey").alias("message"))


@query("""WITH bytes AS (SELECT p_partkey, list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT)) AS b FROM part)
SELECT p_partkey, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
  lambda c, d: list_reduce([xor(c, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda e, i: CASE WHEN e % 2 = 1 THEN xor(e >> 1, 2197175160) ELSE e >> 1 END))) AS checksum FROM bytes""")
def o40_crc32c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", each("long", lambda name: crc32c(name.encode()))("p_name").alias("checksum"))


@query("""WITH parts AS (SELECT page_id, url, list_filter(string_split(url, '/'), lambda p: p <> '') AS p FROM pages)
SELECT page_id, starts_with(url, 'http://') OR starts_with(url, 'https://') AS is_web, CAST(len(p) AS INTEGER) AS n_parts,
  array_to_string(p, '|') AS parts,
  CASE WHEN len(p) > 3 AND url LIKE 'http%://%' THEN p[1] || '//' || p[2] END AS endpoint,
  CASE WHEN len(p) > 3 AND url LIKE 'http%://%' THEN p[3] END AS bucket,
  CASE WHEN len(p) > 3 AND url LIKE 'http%://%' THEN array_to_string(p[4:], '/') END AS key
FROM parts""")
def o31_uri_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, parts = F.col("url"), uris.split_uri_col(F.col("url"))
    s3 = uris.s3_parts_col(u)
    return table(spark, sf_dir, "pages").select("page_id", uris.web_uri_col(u).alias("is_web"), F.size(parts).alias("n_parts"), F.array_join(parts, "|").alias("parts"), s3["endpoint"].alias("endpoint"), s3["bucket"].alias("bucket"), s3["key"].alias("key"))


@query("SELECT page_id, 'file://file:///data/' || page_id AS given, '/data/' || page_id AS path FROM pages")
def o33_strip_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.concat(F.lit("file://file:///data/"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", given.alias("given"), uris.strip_scheme_col(given).alias("path"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'file:///data/' || page_id WHEN 2 THEN 'file:///data/x/' || page_id
  ELSE array_to_string(list_concat([p[1] || '//' || p[2]], p[3:]), '/') || '/bucket/key' END AS normal
FROM (SELECT page_id, list_filter(string_split(url, '/'), lambda q: q <> '') AS p FROM pages)""")
def o35_normal_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    def normal(key: int, url: str) -> str:
        return uris.normal_uri(("", f"/data/{key}", f"file:///data/./x//{key}", f"{url}//bucket/key")[key % 4])

    return table(spark, sf_dir, "pages").select("page_id", each("string", normal)("page_id", "url").alias("normal"))


@query("SELECT event_id, json_valid(props) AS plain, json_valid(props || '  ') AS spaced, json_valid(props || ' x') AS broken FROM events")
def o23_json_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("props")
    ok = json_ok(p, F.concat(p, F.lit("  ")), F.concat(p, F.lit(" x")))
    return table(spark, sf_dir, "events").select("event_id", ok.alias("ok")).select("event_id", F.col("ok")[0].alias("plain"), F.col("ok")[1].alias("spaced"), F.col("ok")[2].alias("broken"))


@query("SELECT event_id // 512 AS append_chunk, count(*) AS n_frames FROM events GROUP BY 1")
def o74_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollover_counts(table(spark, sf_dir, "events"), 512)


# fixed values: the sinks in their order
_SINKS = """(0,'Zarr',2,'none',0,0,false), (1,'ZarrBlosc1ZstdByteShuffle',2,'zstd',1,1,false), (2,'ZarrBlosc1Lz4ByteShuffle',2,'lz4',1,1,false),
(3,'ZarrV3',3,'none',0,0,true), (4,'ZarrV3Blosc1ZstdByteShuffle',3,'zstd',1,1,true), (5,'ZarrV3Blosc1Lz4ByteShuffle',3,'lz4',1,1,true)"""


@query(f"SELECT i AS device_id, name, version, codec, clevel, shuffle, true AS chunking, true AS multiscale, true AS s3, sharding FROM (VALUES {_SINKS}) v(i, name, version, codec, clevel, shuffle, sharding)")
def o60_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry, with what each kind's opened sink says that it can do."""
    can = [(i, *astuple(lifecycle.Sink(spark, i).get_meta())) for i in range(lifecycle.sink_count())]
    told = spark.createDataFrame(can, "device_id int, chunking boolean, multiscale boolean, s3 boolean, sharding boolean")
    return lifecycle.registry(spark).drop("chunking", "multiscale", "s3", "sharding").join(told, "device_id")


@query("""SELECT l_orderkey // 1024 AS ct, CAST((l_linenumber - 1) // 4 AS BIGINT) AS cx, count(*) AS n_cells, CAST(sum(v) AS BIGINT) AS total
FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1, 2""")
def o21_raster_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("v"))
    keys = [geo.div(F.col("l_orderkey"), 1024).alias("ct"), geo.div(F.col("l_linenumber") - 1, 4).alias("cx")]
    return cells.groupBy(*keys).agg(F.count("*").alias("n_cells"), F.sum("v").cast("long").alias("total"))


def _target(spark: SparkSession, version: int = 2, codec: str | None = None) -> StoreConfig:
    dims = dimensions(("t", "time", 0, 64, 2), ("y", "space", 8, 5, 1), ("x", "space", 8, 3, 2))
    return StoreConfig(f"{shared_folder(spark)}/gridloom-store-{uuid.uuid4().hex}", dims, version, codec)


def _stored(spark: SparkSession, sf_dir: str, version: int, codec: str | None) -> StoreConfig:
    """The embeddings' frames in a store of the shared folder."""
    cfg = _target(spark, version, codec)
    store.write(packed_frames(spark, sf_dir), cfg)
    return cfg


_READ_BACK = f"WITH {_PIXELS} SELECT t, CAST(0 AS BIGINT) AS \"inner\", y, x, CAST(value AS BIGINT) AS value FROM pixels"


@query(_READ_BACK)
def o05_store_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read(spark, _stored(spark, sf_dir, 2, None))


@query(_READ_BACK)
def o06_store_v2_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read(spark, _stored(spark, sf_dir, 2, "zstd"))


@query(_READ_BACK)
def o07_store_v2_lz4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read(spark, _stored(spark, sf_dir, 2, "lz4"))


@query(_READ_BACK)
def o08_store_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read(spark, _stored(spark, sf_dir, 3, None))


@query(_READ_BACK)
def o09_store_v3_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read(spark, _stored(spark, sf_dir, 3, "zstd"))


@query(_READ_BACK)
def o10_store_v3_lz4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read(spark, _stored(spark, sf_dir, 3, "lz4"))


@query(f"WITH {_PIXELS} SELECT t, CAST(0 AS BIGINT) AS \"inner\", y, x, CAST(value AS BIGINT) AS value FROM pixels WHERE t >= 64 AND t < 100 AND x < 3")
def o04_subset_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read(spark, _stored(spark, sf_dir, 3, None)).where("t >= 64 and t < 100 and x < 3")


# --- more of stores ----------------------------------------------------------------------------------


@query(_READ_BACK)
def o02_append_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as bytes from one producer, in three pieces that end within frames."""
    sink = lifecycle.Sink(spark, 0)
    sink.configure(_target(spark))
    sink.reserve_image_shape(8, 8, "u8")
    sink.start()
    frames = packed_frames(spark, sf_dir).orderBy("frame_id")
    size, held = frames.count() * 64 // 3 + 1, bytearray()
    for row in frames.toLocalIterator():
        held += row.data
        while len(held) >= size:
            sink.append_bytes(bytes(held[:size]))
            del held[:size]
    sink.append_bytes(bytes(held))
    sink.stop()
    return store.read(spark, sink.config)


@query("""SELECT t, y, x, CAST(floor(fmod(sqrt((x - 4.0) * (x - 4.0) + (y - 3.0) * (y - 3.0)) + t, 256)) AS BIGINT) AS value
FROM (SELECT vec_id AS t FROM embeddings), (SELECT unnest(range(6)) AS y), (SELECT unnest(range(8)) AS x)""")
def o03_simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").count()
    return fr.bytes_to_pixels(fr.simulated(spark, "radial", n, 8, 6), 8)


_OBJECTS = f"WITH {_GRID} SELECT concat_ws('/', '0', ct, cy, cx) AS key, CAST(960 AS BIGINT) AS n_bytes FROM grid"


def _listed(spark: SparkSession, cfg: StoreConfig) -> DataFrame:
    """Data objects of the first level with their sizes."""
    rows = [(k, n) for k, n in store.object_names(cfg) if k.startswith("0/") and k[2].isdigit()]
    return spark.createDataFrame(rows, "key string, n_bytes long")


@query(_OBJECTS)
def o11_local_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in a folder where a larger store was before."""
    cfg, n = _target(spark), table(spark, sf_dir, "embeddings").count()
    store.write(fr.simulated(spark, "empty", n + 200, 8, 8), cfg)
    store.write(packed_frames(spark, sf_dir), cfg)
    return _listed(spark, cfg)


@query("""WITH c AS (SELECT count(*) AS n FROM embeddings)
SELECT CAST(k AS INTEGER) AS step, CAST(least(n, k * ((n + 3) // 4)) // 64 * 64 AS BIGINT) AS n_frames FROM c, (SELECT unnest(range(1, 5)) AS k)
UNION ALL SELECT 5, n FROM c""")
def o55_metadata_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The array's size as its document has it after each micro-batch, and at the end."""
    cfg = _target(spark)
    sink, frames = StreamSink(spark, cfg, f"{shared_folder(spark)}/gridloom-work-{uuid.uuid4().hex}"), packed_frames(spark, sf_dir)
    part = (frames.count() + 3) // 4
    sink.begin()
    seen = []
    for k in range(4):
        sink.take(frames.where((F.col("frame_id") >= k * part) & (F.col("frame_id") < (k + 1) * part)), k)
        seen.append(store.stored_frames(cfg))
    sink.finish()
    return spark.createDataFrame([*enumerate([*seen, store.stored_frames(cfg)], 1)], "step int, n_frames long")


@query("SELECT n_nationkey, CAST((7 * n_nationkey + 23) // 24 AS INTEGER) AS size FROM nation")
def o73_append_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    def size(key: int) -> int:
        cfg = replace(_config(2), dims=dimensions(("t", "time", 0, 8), ("c", "channel", 3, 1), ("z", "space", 8, 4), ("y", "space", 8, 4), ("x", "space", 8, 4)))
        return metadata.array_shape(cfg, metadata.store_levels(cfg, 7 * key)[0])[0]

    return table(spark, sf_dir, "nation").select("n_nationkey", each("int", size)("n_nationkey").alias("size"))


@query(_OBJECTS)
def o75_partial_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a streamed store: the last, incomplete append-chunk is written at full size."""
    cfg = _target(spark)
    sink = StreamSink(spark, cfg, f"{shared_folder(spark)}/gridloom-work-{uuid.uuid4().hex}")
    sink.begin()
    sink.take(packed_frames(spark, sf_dir), 0)
    sink.finish()
    return _listed(spark, cfg)


@query(f"WITH {_PIXELS} SELECT t, CAST(0 AS BIGINT) AS \"inner\", y, x, CAST(value AS BIGINT) AS value FROM pixels WHERE t < (SELECT count(*) // 2 FROM embeddings)")
def o76_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink that runs twice: the second run has the first half of the frames, and nothing of the first run is left."""
    sink, frames = lifecycle.Sink(spark, 3), packed_frames(spark, sf_dir)
    sink.configure(_target(spark))
    half = frames.count() // 2
    for part in (frames, frames.where(F.col("frame_id") < half)):
        sink.start()
        sink.append(part)
        sink.stop()
    return store.read(spark, sink.config)


@query(_READ_BACK)
def o77_frame_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that arrive in any order lie where their ids say."""
    cfg = _target(spark, 3)
    mixed = packed_frames(spark, sf_dir).repartition(7, F.xxhash64("frame_id")).sortWithinPartitions(F.xxhash64("frame_id", F.lit(1)))
    store.write(mixed, cfg)
    return store.read(spark, cfg)


# --- life of a sink ----------------------------------------------------------------------------------


def _for_nations(spark: SparkSession, sf_dir: str, n: int, value: Callable[[int], object], kind: str, column: str) -> DataFrame:
    """``value`` of n_nationkey modulo ``n``."""
    found = spark.createDataFrame([(i, value(i)) for i in range(n)], f"rest int, {column} {kind}")
    return table(spark, sf_dir, "nation").withColumn("rest", F.col("n_nationkey") % n).join(F.broadcast(found), "rest").select("n_nationkey", column)


def _device(spark: SparkSession, stage: int, kind: int = 0) -> lifecycle.Device:
    """A device that waits for settings, is armed, runs or is closed."""
    device = lifecycle.Device(lifecycle.Sink(spark, kind))
    if stage in (1, 2):
        device.configure(_target(spark))
    if stage == 2:
        device.start()
    if stage == 3:
        device.destroy()
    return device


def _state_sql(*states: str) -> str:
    return "SELECT n_nationkey, CASE n_nationkey % 4 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(states)) + " END AS state FROM nation"


_WAITING, _ARMED, _RUNNING, _CLOSED = (s.value for s in lifecycle.State)


def _after(spark: SparkSession, sf_dir: str, call: Callable[[lifecycle.Device], object]) -> DataFrame:
    """The state after a call on a device that waits, is armed, runs, is closed."""

    def state(stage: int) -> str:
        device = _device(spark, stage)
        call(device)
        return device.state.value

    return _for_nations(spark, sf_dir, 4, state, "string", "state")


@query(_state_sql(_ARMED, _ARMED, _WAITING, _CLOSED))
def o58_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(spark, sf_dir, lambda d: d.configure(_target(spark)))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN ' {} 0 false 0 1.0' WHEN n_nationkey % 2 = 1 THEN 'file:///data/store {"k":1} 3 true 0 1.0'
  ELSE 'file:///data/store {} 3 false 0 1.0' END AS settings FROM nation""")
def o59_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    def settings(i: int) -> str:
        sink = lifecycle.Sink(spark, 0)
        if i:
            cfg = replace(_target(spark), metadata='{"k":1}' if i % 2 else "", multiscale=i % 2 == 1)
            sink.configure(cfg)
            sink.config = replace(sink.config, uri="/data/store")
        got = sink.get()
        return f"{got['uri']} {got['metadata']} {len(got['dimensions'])} {str(got['multiscale']).lower()} {got['first_frame_id']} {got['pixel_scale'][0]}"

    return _for_nations(spark, sf_dir, 4, settings, "string", "settings")


@query("""SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'uint8' WHEN 1 THEN 'uint16' WHEN 2 THEN 'float32' WHEN 3 THEN 'int16' ELSE 'AwaitingConfiguration' END AS dtype FROM nation""")
def o61_reserve_image_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    def dtype(i: int) -> str:
        device = _device(spark, 1)
        device.reserve_image_shape(8 if i < 5 else 9, 8, ("u8", "u14", "f32", "i16", "u32", "u8")[i])
        return device.sink.config.dtype if device.state is lifecycle.State.ARMED else device.state.value

    return _for_nations(spark, sf_dir, 6, dtype, "string", "dtype")


@query(_state_sql(_WAITING, _RUNNING, _WAITING, _CLOSED))
def o62_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(spark, sf_dir, lambda d: d.start())


@query(_state_sql(_WAITING, _ARMED, _ARMED, _CLOSED))
def o63_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(spark, sf_dir, lambda d: d.stop())


@query(_state_sql(_CLOSED, _CLOSED, _CLOSED, _CLOSED))
def o64_destroy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(spark, sf_dir, lambda d: d.destroy())


@query(_state_sql(_WAITING, _WAITING, _WAITING, _CLOSED))
def o65_failing_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a wrong size, or none expected: the call doesn't raise, and the device waits for settings."""
    return _after(spark, sf_dir, lambda d: d.append(fr.simulated(spark, "empty", 2, 7, 8)))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 8 < 6 THEN 'AwaitingConfiguration Closed' ELSE 'Invalid index' END AS outcome FROM nation")
def o68_open_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    def outcome(i: int) -> str:
        try:
            sink = lifecycle.open_sink(spark, i)
        except StoreError as e:
            return status_message(e.code)
        before = sink.state.value
        lifecycle.close_sink(sink)
        return f"{before} {sink.state.value}"

    return _for_nations(spark, sf_dir, 8, outcome, "string", "outcome")


@query("SELECT CAST(6 AS INTEGER) AS kinds, CAST(count(*) AS INTEGER) AS closed FROM nation")
def o69_init_shutdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    lifecycle.shutdown()
    kinds = lifecycle.init(spark)
    for row in table(spark, sf_dir, "nation").select("n_nationkey").collect():
        lifecycle.open_sink(spark, row.n_nationkey % kinds)
    return spark.createDataFrame([(kinds, lifecycle.shutdown())], "kinds int, closed int")


@query("SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'debug' WHEN 1 THEN 'info' WHEN 2 THEN 'warning' WHEN 4 THEN 'none' ELSE 'error' END AS level FROM nation")
def o70_log_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level after it was set, by name; an unknown name changes nothing, and opening a sink sets it to error."""

    def level(i: int) -> str:
        lifecycle.open_sink(spark, 0)
        if not passes(set_log_level, [*LOG_LEVELS, "loud"][i]):
            assert i == len(LOG_LEVELS)
        return get_log_level()

    made = [(i, level(i)) for i in range(6)]
    set_log_level("error")
    return _for_nations(spark, sf_dir, 6, lambda i: made[i][1], "string", "level")


@query(f"SELECT '{gridloom.__version__}' AS version, true AS semantic")
def o72_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(gridloom.__version__,)], "version string").withColumn("semantic", F.col("version").rlike(r"^\d+\.\d+\.\d+$"))
