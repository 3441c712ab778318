from __future__ import annotations

import json
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from gridloom.functions import codec
from gridloom.functions.uri import normal_uri, s3_parts, split_uri, strip_scheme
from gridloom.operators import frames as fr
from gridloom.operators import pyramid, reshape
from gridloom.plans import lifecycle
from gridloom.plans.model import StatusCode, StoreConfig, StoreError, check_json, dimensions, dtype_of, get_log_level, set_log_level, status_message
from gridloom.sources import store
from gridloom.sources.shared import clear_shared, written
from gridloom.streaming.sink import StreamSink
from tests.fake_s3 import FakeS3


def test_crc32c():
    assert codec.crc32c(b"123456789") == 0xE3069283


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600), st.sampled_from(["zstd", "lz4", None]), st.sampled_from([1, 2, 4]), st.integers(0, 1))
def test_codec_round_trip(data, name, item, shuffle):
    assert codec.decompress(codec.compress(data * 4, name, 1, shuffle, item), name) == data * 4


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 11), st.binary(max_size=40)))
def test_shard_round_trip(chunks):
    packed = reshape.pack_shard(list(chunks.items()), 12)
    assert len(packed) == sum(map(len, chunks.values())) + 16 * 12 + 4
    assert reshape.unpack_shard(packed, 12) == chunks


def config(path, **more):
    dims = more.pop("dims", None) or dimensions(("t", "time", 0, 4, 2), ("c", "channel", 1, 1), ("y", "space", 5, 4, 1), ("x", "space", 7, 3, 2))
    return StoreConfig(str(path / "store"), dims, **more)


def read_array(spark, cfg, level=0):
    got = store.read(spark, cfg, level).collect()
    shape = [max(r[k] for r in got) + 1 for k in ("t", "inner", "y", "x")]
    out = np.full(shape, -1)
    for r in got:
        out[r.t, r.inner, r.y, r.x] = r.value
    assert (out >= 0).all() and len(got) == out.size
    return out


@pytest.mark.parametrize("version,codec_name", [(2, None), (2, "zstd"), (3, None), (3, "lz4")])
@pytest.mark.parametrize("dtype", ["uint8", "uint16"])
def test_round_trip(spark, tmp_path, version, codec_name, dtype):
    cfg = config(tmp_path, version=version, codec=codec_name, dtype=dtype, metadata='{"hello":"world"}')
    made = fr.simulated(spark, "random", 10, 7, 5, dtype, seed=4)
    assert store.write(made, cfg) == 10
    want = np.stack([np.frombuffer(r.data, dtype).reshape(5, 7) for r in made.orderBy("frame_id").collect()])
    assert (read_array(spark, cfg)[:, 0] == want).all()
    assert json.loads((tmp_path / "store/acquire.json").read_text()) == {"hello": "world"}
    if version == 2 and codec_name is None:
        sizes = {p.stat().st_size for p in (tmp_path / "store/0").rglob("*") if p.is_file() and not p.name.startswith(".")}
        assert sizes == {cfg.chunk_bytes}
        assert (tmp_path / "store/0/2/0/1/2").exists() and not (tmp_path / "store/0/3").exists()


def test_exactly_full_chunks_open_no_other(spark, tmp_path):
    cfg = config(tmp_path)
    store.write(fr.simulated(spark, "empty", 4, 7, 5), cfg)
    assert sorted(os.listdir(tmp_path / "store/0")) == [".zarray", "0"]
    store.write(fr.simulated(spark, "radial", 5, 7, 5), cfg)
    assert sorted(os.listdir(tmp_path / "store/0")) == [".zarray", "0", "1"]


def test_restart_overwrites(spark, tmp_path):
    cfg = config(tmp_path, version=3)
    for _ in range(2):
        store.write(fr.simulated(spark, "random", 10, 7, 5), cfg)
        doc = json.loads((tmp_path / "store/0/zarr.json").read_text())
        assert doc["shape"] == [10, 1, 5, 7]


def test_pyramid_in_store(spark, tmp_path):
    cfg = config(tmp_path, multiscale=True)
    made = fr.simulated(spark, "random", 11, 7, 5, seed=1)
    store.write(made, cfg)
    base = read_array(spark, cfg)[:, 0]
    level = 1
    images = [base[i].astype(np.uint8) for i in range(11)]
    while (tmp_path / f"store/{level}").exists():
        half = [pyramid.halve(i) for i in images]
        images = [(0.5 * (a.astype(float) + b.astype(float))).astype(np.uint8) for a, b in zip(half[0::2], half[1::2], strict=False)]
        assert (read_array(spark, cfg, level)[:, 0] == np.stack(images)).all()
        level += 1
    assert level == 3


def test_subset_reads_fewer_objects(spark, tmp_path):
    cfg = config(tmp_path, version=3)
    store.write(fr.simulated(spark, "random", 32, 7, 5), cfg)
    part = store.read(spark, cfg).where("t >= 9 and t < 12 and y = 4")
    assert part.count() == 3 * 7
    options = {"path": cfg.uri, "partition_bytes": "1"}
    reader = store.StoreReader(options)
    assert len(reader.partitions()) == 4 * 2 * 2
    assert list(reader.pushFilters([GreaterThanOrEqual(("t",), 9), LessThan(("t",), 12), EqualTo(("y",), 4)]))
    keys = [k for p in reader.partitions() for k in p.keys()]
    assert len(keys) == 2 and all(k[0] == 1 and k[2] == 1 for k in keys)
    # many small objects are one partition
    assert store.read(spark, cfg).rdd.getNumPartitions() == 1
    assert sorted(map(tuple, spark.read.format("gridloom").options(**options).load().collect())) == sorted(map(tuple, store.read(spark, cfg).collect()))


def test_wrong_frames_raise(spark, tmp_path):
    cfg = config(tmp_path)
    with pytest.raises(Exception, match="bytes"):
        store.write(fr.simulated(spark, "empty", 2, 6, 5), cfg)
    with pytest.raises(StoreError, match="frame ids"):
        store.write(fr.simulated(spark, "empty", 4, 7, 5).where("frame_id <> 1"), cfg)


def test_no_frames(spark, tmp_path):
    cfg = config(tmp_path)
    assert store.write(fr.simulated(spark, "empty", 0, 7, 5), cfg) == 0
    assert json.loads((tmp_path / "store/0/.zarray").read_text())["shape"] == [0, 1, 5, 7]


@pytest.mark.parametrize("version", [2, 3])
def test_stream_equals_batch(spark, tmp_path, version):
    cfg = config(tmp_path, version=version, multiscale=version == 2)
    made = fr.simulated(spark, "random", 21, 7, 5, seed=2).collect()
    source = tmp_path / "in"
    for k in range(4):
        part = [r for r in made if r.frame_id // 6 == k]
        spark.createDataFrame(part, "frame_id long, data binary").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("frame_id long, data binary").option("maxFilesPerTrigger", 1).parquet(str(source))
    sink = StreamSink(spark, cfg, str(tmp_path / "work"))
    sink.start(stream)
    assert sink.stop() == 21
    other = StoreConfig(str(tmp_path / "batch"), cfg.dims, version, multiscale=cfg.multiscale)
    store.write(spark.createDataFrame(made, "frame_id long, data binary"), other)
    assert files(tmp_path / "store") == files(tmp_path / "batch")


def files(top):
    return {str(p.relative_to(top)): p.read_bytes() for p in top.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


@pytest.mark.parametrize("version,codec_name,multiscale", [(2, None, True), (3, "zstd", False), (3, None, True)])
def test_frames_by_format(spark, tmp_path, version, codec_name, multiscale):
    """The format's writer, where frames are, makes the same bytes as the writer by object; a second write goes on behind it."""
    cfg = config(tmp_path, version=version, codec=codec_name, multiscale=multiscale)
    made = fr.simulated(spark, "random", 43, 7, 5, seed=3).repartition(5)
    store.write(made, cfg)
    want = files(tmp_path / "store")
    other = StoreConfig(str(tmp_path / "other"), cfg.dims, version, codec_name, multiscale=multiscale)
    save = lambda df, mode: store.clustered(df, other).write.format("gridloom").options(**store.options_of(other)).mode(mode).save()
    save(made, "overwrite")
    assert files(tmp_path / "other") == want
    unit = reshape.unit_frames(cfg)
    assert 0 < unit < 43
    save(made.where(F.col("frame_id") < unit), "overwrite")
    save(made.where(F.col("frame_id") >= unit), "append")
    assert files(tmp_path / "other") == want
    before = files(tmp_path / "other")
    with pytest.raises(Exception, match="within an append unit"):
        save(made, "append")
    assert files(tmp_path / "other") == before
    with pytest.raises(Exception, match="cluster frames|came after"):
        made.coalesce(1).sortWithinPartitions(F.desc("frame_id")).write.format("gridloom").options(**store.options_of(other)).mode("overwrite").save()
    assert not [n for n in files(tmp_path / "other") if n[0].isdigit()]  # what finished tasks wrote is taken back


def test_stream_by_format(spark, tmp_path):
    """Micro-batches of whole append units."""
    cfg = config(tmp_path)
    made = fr.simulated(spark, "random", 11, 7, 5, seed=3).collect()
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([r for r in made if r.frame_id // 4 == k], "frame_id long, data binary").coalesce(1).write.mode("append").parquet(str(source))
    store.register(spark)
    stream = spark.readStream.schema("frame_id long, data binary").parquet(str(source)).repartition(1)
    query = stream.writeStream.format("gridloom").options(**store.options_of(cfg)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    other = StoreConfig(str(tmp_path / "other"), cfg.dims)
    store.write(spark.createDataFrame(made, "frame_id long, data binary"), other)
    assert files(tmp_path / "store") == files(tmp_path / "other")


def test_object_counts():
    for dims, version in (((("t", "time", 0, 4, 2), ("c", "channel", 3, 2, 1), ("z", "space", 5, 2, 2), ("y", "space", 5, 4, 1), ("x", "space", 7, 3, 2)), 3), ((("t", "time", 0, 2), ("c", "channel", 3, 1), ("y", "space", 5, 4), ("x", "space", 7, 3)), 2)):
        cfg = StoreConfig("/tmp/x", dimensions(*dims), version)
        for n in (0, 1, 2, 14, 15, 16, 60, 61, 200):
            made = []
            run = reshape.Assembler(cfg, lambda key, data, made=made: made.append(key))
            for i in range(n):
                run.feed(i, bytes(35))
            run.finish()
            assert len(made) == len(set(made)) == reshape.object_count(cfg, run.levels[0], n)


def test_missing_objects_raise(spark, tmp_path):
    store.register(spark)
    rows = spark.createDataFrame([("0/a", b"1"), ("0/b", b"2")], "key string, payload binary").repartition(2)
    out = rows.write.format("gridloom_objects").option("path", str(tmp_path / "store")).option("expected_objects", 3).mode("append")
    with pytest.raises(Exception, match="2 objects written of 3"):
        out.save()
    assert not files(tmp_path / "store")


def test_only_stores_are_removed(spark, tmp_path):
    cfg = config(tmp_path)
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "notes.txt").write_text("mine")
    with pytest.raises(StoreError, match="isn't a store"):
        store.write(fr.simulated(spark, "empty", 1, 7, 5), cfg)
    assert (tmp_path / "store" / "notes.txt").exists()


def test_targets(tmp_path):
    os.chmod(tmp_path, 0o555)
    try:
        with pytest.raises(StoreError, match="can't be written to"):
            store.check_target(config(tmp_path))
    finally:
        os.chmod(tmp_path, 0o755)
    store.check_target(config(tmp_path))
    (tmp_path / "file").write_text("x")
    for parent in (tmp_path / "absent", tmp_path / "file"):
        with pytest.raises(StoreError, match="isn't a folder"):
            store.check_target(config(parent))


@pytest.mark.parametrize("version", [2, 3])
def test_web_store(spark, tmp_path, version):
    """Against a service in this process: write, list, read, replace, stream."""
    with FakeS3() as service:
        local = config(tmp_path, version=version)
        cfg = StoreConfig(f"{service.url}/frames/run/store", local.dims, version, access_key="a", secret_key="b")
        made = fr.simulated(spark, "random", 10, 7, 5, seed=4)
        store.write(made, cfg)
        store.write(made, local)
        here = files(tmp_path / "store")
        assert {k[len("run/store/") :]: v for (_, k), v in service.objects.items() if v} == here
        assert store.object_names(cfg) == sorted((k, len(v)) for k, v in here.items())
        assert sorted(map(tuple, store.read(spark, cfg).collect())) == sorted(map(tuple, store.read(spark, local).collect()))
        store.write(made.where("frame_id < 3"), cfg)
        assert len(store.object_names(cfg)) < len(here) and store.stored_frames(cfg) == 3
        store.clustered(made, cfg).write.format("gridloom").options(**store.options_of(cfg)).mode("overwrite").save()
        assert {k[len("run/store/") :]: v for (_, k), v in service.objects.items() if v} == here


def test_stream_goes_on_after_a_lost_driver(spark, tmp_path):
    cfg = config(tmp_path, version=3)
    made = fr.simulated(spark, "random", 30, 7, 5, seed=2).collect()
    source, work = tmp_path / "in", tmp_path / "work"
    put = lambda a, b: spark.createDataFrame([r for r in made if a <= r.frame_id < b], "frame_id long, data binary").coalesce(1).write.mode("append").parquet(str(source))
    stream = lambda: spark.readStream.schema("frame_id long, data binary").option("maxFilesPerTrigger", 1).parquet(str(source))
    (work / "mine").mkdir(parents=True)
    put(0, 13)
    first = StreamSink(spark, cfg, f"file://{work}")
    first.start(stream())
    first.query.processAllAvailable()
    first.query.stop()  # and nothing else of it is known any more
    assert first.written == 8 and json.loads((tmp_path / "store/0/zarr.json").read_text())["shape"][0] == 8
    assert [p.name for p in (work / "kept").rglob("unit=*")] == ["unit=1"]  # written frames are gone
    for k in range(13, 30, 6):
        put(k, min(k + 6, 30))
    second = StreamSink(spark, cfg, f"file://{work}")
    second.start(stream(), resume=True)
    assert second.stop() == 30
    other = StoreConfig(str(tmp_path / "other"), cfg.dims, 3)
    store.write(spark.createDataFrame(made, "frame_id long, data binary"), other)
    assert files(tmp_path / "store") == files(tmp_path / "other")
    assert not list((work / "kept").rglob("unit=*")) and (work / "mine").exists()
    # a new run starts anew
    third = StreamSink(spark, cfg, f"file://{work}")
    third.start(stream())
    assert third.stop() == 30 and files(tmp_path / "store") == files(tmp_path / "other")


def test_stream_keeps_batches_whole(spark, tmp_path):
    """Folders and files that are kept don't grow with the units of a batch; a batch is rewritten where half of it is written."""
    cfg = config(tmp_path)
    made, work = fr.simulated(spark, "random", 43, 7, 5, seed=6).coalesce(2), tmp_path / "work"
    other = StoreConfig(str(tmp_path / "other"), cfg.dims)
    store.write(made, other)
    kept = lambda: sorted(str(p.relative_to(work / "kept")) for p in (work / "kept").glob("*/*") if p.is_dir())
    rows = lambda: sorted(r.frame_id for r in spark.read.parquet(str(work / "kept")).collect())
    sink = StreamSink(spark, cfg, str(work))
    sink.begin()
    assert sink.unit == 4 and sink.take(made.where("frame_id not in (2, 14, 30)"), 0) == 0
    assert kept() == ["batch=0/unit=0"] and len(list(work.rglob("*.parquet"))) <= 2
    assert sink.take(made.where("frame_id = 2"), 1) == 12  # less than half
    assert kept() == ["batch=0/unit=0"] and len(rows()) == 40
    assert sink.take(made.where("frame_id = 14"), 2) == 28
    assert kept() == ["batch=0/unit=7"] and rows() == [28, 29, *range(31, 43)]
    assert sink.take(made.where("frame_id in (14, 30)"), 2) == 40  # a repeated batch replaces itself
    assert kept() == ["batch=0/unit=10"] and rows() == [40, 41, 42]
    assert sink.finish() == 43 and files(tmp_path / "store") == files(tmp_path / "other")


def test_stream_lost_between_rest_and_batch(spark, tmp_path, monkeypatch):
    """The driver goes when a batch's rest is kept and the batch isn't deleted yet: frames that are there twice count once."""
    cfg = config(tmp_path, version=3, multiscale=True)
    made, work = fr.simulated(spark, "random", 70, 7, 5, seed=7).coalesce(2), tmp_path / "work"
    other = StoreConfig(str(tmp_path / "other"), cfg.dims, 3, multiscale=True)
    store.write(made, other)
    first = StreamSink(spark, cfg, str(work))
    first.begin()
    unit, late = first.unit, 69 // first.unit * first.unit + 1
    assert first.take(made.where(f"frame_id not in (2, {late})"), 0) == 0
    delete = first.folder.delete
    with monkeypatch.context() as m:
        m.setattr(first.folder, "delete", lambda name: delete(name) if "unit=" not in name else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            first.take(made.where("frame_id = 2"), 1)
    assert sorted(p.name for p in (work / "kept/batch=0").glob("unit=*") if p.is_dir()) == ["unit=0", f"unit={late // unit}"]
    second = StreamSink(spark, cfg, str(work))
    second.begin(resume=True)
    assert second.take(made.where("frame_id = 2"), 1) == late - 1
    assert second.take(made.where(f"frame_id = {late}"), 2) == 70 // unit * unit
    assert second.finish() == 70 and files(tmp_path / "store") == files(tmp_path / "other")


def test_bytes_in_pieces(spark, tmp_path):
    made = fr.simulated(spark, "random", 6, 7, 5, seed=5).orderBy("frame_id").collect()
    raw = b"".join(r.data for r in made) + b"1234567"
    sink = lifecycle.open_sink(spark, 0)
    sink.configure(config(tmp_path))
    sink.reserve_image_shape(7, 5, "u8")
    sink.start()
    assert [sink.append_bytes(raw[a:b]) for a, b in ((0, 10), (10, 80), (80, 80), (80, 200), (200, 210), (210, 217))] == [10, 70, 0, 120, 10, 7]
    sink.stop()  # 7 bytes of a seventh frame are dropped
    got = read_array(spark, sink.config)[:, 0]
    assert (got == np.stack([np.frombuffer(r.data, np.uint8).reshape(5, 7) for r in made])).all()


def test_devices_never_raise(spark, tmp_path):
    set_log_level("debug")
    device = lifecycle.Device(lifecycle.open_sink(spark, 0))
    assert get_log_level() == "error"
    waiting, armed, running = lifecycle.State.AWAITING, lifecycle.State.ARMED, lifecycle.State.RUNNING
    assert device.start() is waiting
    assert device.configure(config(tmp_path / "absent")) is waiting
    assert device.configure(config(tmp_path)) is armed
    assert device.reserve_image_shape(8, 5, "u8") is waiting  # a failing call leaves it waiting
    assert device.configure(config(tmp_path)) is armed and device.reserve_image_shape(7, 5, "u8") is armed and device.start() is running
    assert device.append(fr.simulated(spark, "empty", 3, 6, 5)) == 0 and device.state is waiting
    assert device.configure(config(tmp_path)) is armed and device.start() is running
    assert device.append(fr.simulated(spark, "empty", 3, 7, 5)) == 3 and device.stop() is armed
    assert device.destroy() is lifecycle.State.CLOSED and device.configure(config(tmp_path)) is lifecycle.State.CLOSED


def test_old_tables_are_cleared(spark):
    kept = written(spark.range(3).toDF("id"), "kept")
    assert kept.count() == 3 and clear_shared(spark, 1.0) == 0
    assert kept.count() == 3 and clear_shared(spark, -1.0) > 0
    with pytest.raises(Exception, match="not exist|NOT_FOUND|not found"):
        spark.read.parquet(kept.inputFiles()[0]).count()


def test_shutdown(spark):
    lifecycle.shutdown()
    assert lifecycle.init(spark) == 6
    sinks = [lifecycle.open_sink(spark, i) for i in (0, 3)]
    lifecycle.close_sink(sinks[0])
    lifecycle.close_sink(sinks[0])
    assert lifecycle.shutdown() == 1 and all(s.state is lifecycle.State.CLOSED for s in sinks)


# --- settings and life ------------------------------------------------------------------------------


def test_settings_rules(tmp_path):
    good = config(tmp_path)
    assert good.check().metadata == "{}"
    bad = [
        {"version": 4},
        {"codec": "gzip"},
        {"level": 10},
        {"shuffle": 3},
        {"metadata": '{"a":1} x'},
        {"dims": dimensions(("y", "space", 0, 4), ("x", "space", 7, 3))},
        {"dims": dimensions(("t", "time", 1, 4), ("y", "space", 5, 4), ("x", "space", 7, 3))},
        {"dims": dimensions(("t", "time", 0, 4), ("y", "space", 0, 4), ("x", "space", 7, 3))},
        {"dims": dimensions(("t", "time", 0, 0), ("y", "space", 5, 4), ("x", "space", 7, 3))},
        {"dims": dimensions(("t", "time", 0, 4), ("", "space", 5, 4), ("x", "space", 7, 3))},
    ]
    for more in bad:
        with pytest.raises(StoreError):
            config(tmp_path, **more).check()
    with pytest.raises(StoreError):
        StoreConfig("http://host/bucket", good.dims, access_key="a", secret_key="b").check()
    with pytest.raises(StoreError):
        StoreConfig("http://host/bucket/key", good.dims).check()


def test_json_and_uris():
    assert check_json("") == "{}" and check_json(None) == "{}"
    check_json('{"a": "//no comment"}  // but this is\n ')
    check_json('/* c */ {"a": 1}')
    assert split_uri("http://h:9//b/k/l") == ["http:", "h:9", "b", "k", "l"]
    assert s3_parts("http://h:9//b/k/l") == ("http://h:9", "b", "k/l")
    assert strip_scheme("file://file:///a") == "/a" and strip_scheme("/x/file://y") == "/x/file://y"
    assert normal_uri("") == "" and normal_uri("file:///a/b") == "file:///a/b"


def test_status_and_log_level():
    assert status_message(0) == "Success" and status_message(99) == "Unknown status"
    set_log_level("debug")
    assert get_log_level() == "debug"
    set_log_level("error")
    with pytest.raises(StoreError):
        set_log_level("loud")
    assert dtype_of("u12") == "uint16"
    with pytest.raises(StoreError):
        dtype_of("u32")


def test_sinks():
    assert lifecycle.sink_count() == 6
    assert [lifecycle.describe(i)["name"] for i in range(6)][3] == "ZarrV3"
    assert lifecycle.kind_name(0) == "Storage_Zarr" and lifecycle.kind_name(9) == "(unknown)"
    with pytest.raises(StoreError) as e:
        lifecycle.describe(6)
    assert e.value.code is StatusCode.InvalidIndex


def test_life(spark, tmp_path):
    sink = lifecycle.open_sink(spark, 4)
    assert sink.get() == {"uri": "", "metadata": "{}", "dimensions": (), "multiscale": False, "first_frame_id": 0, "pixel_scale": (1.0, 1.0), "access_key": None}
    assert sink.get_meta().sharding and not lifecycle.open_sink(spark, 1).get_meta().sharding
    with pytest.raises(StoreError):
        sink.start()
    cfg = config(tmp_path)
    assert sink.configure(cfg) is lifecycle.State.ARMED
    assert sink.get()["uri"] == f"file://{tmp_path}/store"
    with pytest.raises(StoreError):
        sink.reserve_image_shape(8, 5, "u8")
    sink.reserve_image_shape(7, 5, "u10")
    frames = fr.simulated(spark, "random", 6, 7, 5, "uint16")
    for _ in range(2):
        sink.start()
        with pytest.raises(StoreError):
            sink.configure(cfg)
        assert sink.append(frames.where("frame_id < 2")) == 2
        assert sink.append(frames.where("frame_id < 0")) == 0
        with pytest.raises(StoreError):
            sink.append(frames.where("frame_id > 3"))
        assert sink.append(frames.where("frame_id >= 2")) == 4
        assert sink.stop() is lifecycle.State.ARMED
        doc = json.loads((tmp_path / "store/0/zarr.json").read_text())
        assert doc["shape"] == [6, 1, 5, 7] and doc["data_type"] == "uint16"
    sink.destroy()
    assert sink.state is lifecycle.State.CLOSED


def test_frames_and_pixels(spark):
    made = fr.simulated(spark, "random", 3, 4, 2, "int16")
    pixels = fr.bytes_to_pixels(made, 4, "int16")
    back = {r.frame_id: np.array(r.data, np.int16).tobytes() for r in fr.pixels_to_frames(pixels).collect()}
    assert back == {r.frame_id: bytes(r.data) for r in made.collect()}
    empty = spark.createDataFrame([(0, b""), (1, None)], "frame_id long, data binary")
    assert fr.bytes_to_pixels(empty, 4).count() == 0
    odd = spark.createDataFrame([(300.0,), (-1.0,), (7.0,), (None,)], "v double").select(fr.coerce(F.col("v"), "u8").alias("v"))
    assert [r.v for r in odd.collect()] == [None, None, 7, None]
