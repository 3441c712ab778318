from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import geometry as geo
from gridloom.operators import pyramid, reshape
from gridloom.plans.metadata import store_levels
from gridloom.plans.model import StoreConfig, dimensions

# fixed values: level tables of known stores
KNOWN = {
    (240, 135, 100, 80, 45): [(240, 135, 80, 45, 100), (120, 68, 80, 45, 50), (60, 34, 60, 34, 25)],
    (240, 135, 128, 240, 135): [(240, 135, 240, 135, 128), (120, 68, 120, 68, 64)],
    (1920, 1080, 74, 640, 360): [(1920, 1080, 640, 360, 74), (960, 540, 640, 360, 37), (480, 270, 480, 270, 18)],
}


@pytest.mark.parametrize("case", KNOWN)
def test_levels(case):
    assert [(v.width, v.height, v.chunk_width, v.chunk_height, v.frames) for v in geo.levels(*case)] == KNOWN[case]


def test_single_level_is_not_clipped():
    cfg = StoreConfig("/tmp/x", dimensions(("t", "time", 0, 32), ("y", "space", 46, 48), ("x", "space", 62, 64)))
    (only,) = store_levels(cfg, 32)
    assert (only.chunk_width, only.chunk_height) == (64, 48)
    assert cfg.chunk_bytes == 98304


# fixed values: chunk sizes, append sizes and shard sizes of known stores
def test_known_sizes():
    g1 = StoreConfig("/tmp/x", dimensions(("t", "time", 0, 70), ("c", "channel", 1, 1), ("y", "space", 48, 48), ("x", "space", 64, 64)))
    assert g1.chunk_bytes == 215040
    g5 = StoreConfig("/tmp/x", dimensions(("t", "time", 0, 64), ("c", "channel", 1, 1), ("y", "space", 192, 38), ("x", "space", 256, 85)))
    assert g5.chunk_bytes == 206720
    g6 = StoreConfig("/tmp/x", dimensions(("t", "time", 0, 10), ("c", "channel", 3, 1), ("z", "space", 8, 4), ("y", "space", 1080, 540), ("x", "space", 1920, 960)))
    assert g6.steps(241) == 11


def test_ragged_shards(spark):
    # 1080x1920 in chunks of 154x274 makes 8x8 chunks, in shards of 7x6
    grid = spark.range(64).select(F.lit(0).cast("long").alias("ct"), geo.div(F.col("id"), 8).alias("cy"), F.pmod("id", F.lit(8)).alias("cx"))
    size = 16 * 154 * 274
    made = reshape.shard_bytes(grid, (1, 7, 6), size).orderBy("sy", "sx").collect()
    assert [(r.n_chunks, r.n_bytes) for r in made] == [(42, 28356388), (14, 9452580), (6, 4051492), (2, 1350948)]
    index = reshape.shard_index(grid, (1, 7, 6), size=F.lit(size)).where("sy = 0 and sx = 1").orderBy("slot").collect()
    assert len(index) == 42
    for i, row in enumerate(index):
        there = i % 6 < 2
        assert row.n_bytes == (size if there else -1)
        assert row.offset == ((i // 6 * 2 + i % 6) * size if there else -1)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(1, 400), st.integers(0, 300), st.integers(1, 500), st.integers(1, 500))
def test_level_laws(w, h, n, cw, ch):
    made = geo.levels(w, h, n, cw, ch)
    assert len(made) >= 2
    for a, b in zip(made[:-1], made[1:], strict=True):
        assert (b.width, b.height, b.frames) == (-(-a.width // 2), -(-a.height // 2), a.frames // 2)
        assert b.chunk_width == min(cw, b.width) and b.chunk_height == min(ch, b.height)
    assert made[-1].width <= cw and made[-1].height <= ch
    assert all(v.width > cw or v.height > ch for v in made[1:-1])


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.data())
def test_halving_is_the_mean_of_what_is_there(h, w, data):
    image = np.array(data.draw(st.lists(st.integers(0, 255), min_size=h * w, max_size=h * w)), np.uint8).reshape(h, w)
    half = pyramid.halve(image)
    for y in range(half.shape[0]):
        for x in range(half.shape[1]):
            assert half[y, x] == int(image[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean())


def test_unravel_round_trip(spark):
    sizes = (3, 8)
    t, c, z = geo.unravel(F.col("id"), sizes)
    got = spark.range(241).select("id", t.alias("t"), c.alias("c"), z.alias("z")).collect()
    assert all(r.id == (r.t * 3 + r.c) * 8 + r.z and r.c < 3 and r.z < 8 for r in got)


def test_pixels_land_in_one_place(spark):
    shape, chunk = (5, 7, 9), (2, 3, 4)
    n = math.prod(shape)
    t, y, x = geo.unravel(F.col("id"), shape[1:])
    pixels = spark.range(n).select(t.alias("t"), y.alias("y"), x.alias("x"), F.col("id").alias("value"))
    filled = reshape.chunk_fill(pixels.withColumn("value", F.col("value") + 1), chunk, value_type="long").collect()
    assert all(len(r.payload) == 24 for r in filled)
    seen = {}
    for r in filled:
        block = np.array(r.payload).reshape(chunk)
        for (a, b, c), v in np.ndenumerate(block):
            if v:
                seen[int(v) - 1] = (r.ct * 2 + a, r.cy * 3 + b, r.cx * 4 + c)
    assert seen == {i: tuple(int(k) for k in np.unravel_index(i, shape)) for i in range(n)}


def test_pyramid_deals_pixels_once(spark):
    pixels = spark.range(64 * 4).select(geo.div(F.col("id"), 4).alias("t"), geo.div(F.pmod("id", F.lit(4)), 2).alias("y"), F.pmod("id", F.lit(2)).alias("x"), F.col("id").alias("value"))
    top = pyramid.pyramid(pixels, 3).where("level = 2")
    assert top._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
