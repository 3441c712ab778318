"""Streaming sink: append units are written as soon as all their frames are there, the rest at the end.

The unit is a count of frames, not event time. Each micro-batch is first kept under its batch id, so
that a repeated batch replaces itself; objects are derived from kept frames only, under fixed names,
so a repeat writes the same bytes. A batch lies in one folder, however many its units are, named after
the first unit that wasn't written then. It goes once its objects are written; where that is half of it
or more, its rest takes its place, so that all rests together are no larger than the batch was. How far
objects are written stands in a small file beside the checkpoint, from which a run goes on whose driver
was lost.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.functions.geometry import div
from gridloom.operators.reshape import unit_frames
from gridloom.plans.model import StatusCode, StoreConfig, require
from gridloom.sources.shared import Folder
from gridloom.sources.store import check_target, register, remove, write_metadata, write_objects

_KEPT = "frame_id long, data binary, batch long, unit long"
_STATE = "written.json"


class StreamSink:
    """One run of a streaming write. ``work``: a folder all executors share, on any file system; its subfolders ``kept`` and ``checkpoint`` and the file ``written.json`` are the sink's."""

    def __init__(self, spark: SparkSession, cfg: StoreConfig, work: str):
        self.spark, self.cfg, self.work = spark, cfg.check(), work.rstrip("/")
        self.folder = Folder(spark, self.work)
        self.query: StreamingQuery | None = None
        self.written = 0  # frames whose objects are written
        self.unit = unit_frames(self.cfg)

    def _kept(self) -> DataFrame:
        """All kept frames with their batches; after a lost driver some may be there twice."""
        if not self.folder.names("kept"):
            return self.spark.createDataFrame([], _KEPT)
        return self.spark.read.schema(_KEPT).option("basePath", f"{self.work}/kept").parquet(f"{self.work}/kept")

    def _held(self) -> DataFrame:
        """Kept frames that aren't written, each once."""
        return self._kept().select("frame_id", "data").where(F.col("frame_id") >= self.written).dropDuplicates(["frame_id"])

    def _keep(self, frames: DataFrame, batch_id: int) -> None:
        """Keep what isn't written of a batch's frames."""
        path = f"{self.work}/kept/batch={batch_id}/unit={self.written // self.unit}"
        frames.select("frame_id", "data").where(F.col("frame_id") >= self.written).write.mode("append").parquet(path)

    def take(self, batch: DataFrame, batch_id: int) -> int:
        """Keep a micro-batch and write the units that are whole now; the frames written so far."""
        self.folder.delete(f"kept/batch={batch_id}")
        self._keep(batch.select(F.col("frame_id").cast("long"), F.col("data").cast("binary")), batch_id)
        # frames may come out of order: units count when they and all before them are whole
        units = self._held().groupBy(div(F.col("frame_id"), self.unit).alias("unit")).agg(F.count("*").alias("n"))
        full = {r.unit for r in units.where(F.col("n") == self.unit).select("unit").collect()}
        last = self.written // self.unit
        while last in full:
            last += 1
        if last * self.unit > self.written:
            self._write(self._held().where(F.col("frame_id") < last * self.unit), last * self.unit)
            self._drop()
        return self.written

    def _write(self, frames: DataFrame, upto: int) -> None:
        write_objects(frames, self.cfg, upto, self.written)
        write_metadata(self.cfg, upto)
        self.folder.save(_STATE, json.dumps({"frames": upto}))
        self.written = upto

    def _drop(self) -> None:
        """Kept frames that are written go, where they are half of a batch or more."""
        kept = self._kept()
        rest = kept.groupBy("batch").agg(F.count("*").alias("n"), F.count(F.when(F.col("frame_id") >= self.written, 1)).alias("rest"))
        more = {r.batch: r for r in rest.where("rest > 0").collect()}
        for name in self.folder.names("kept"):
            batch = int(name.removeprefix("batch="))
            if batch not in more:
                self.folder.delete(f"kept/{name}")
            elif 2 * more[batch].rest <= more[batch].n:
                self._keep(kept.where(F.col("batch") == batch).dropDuplicates(["frame_id"]), batch)
                for unit in self.folder.names(f"kept/{name}"):  # the rest is there as a whole by now
                    if unit.startswith("unit=") and int(unit[5:]) < self.written // self.unit:
                        self.folder.delete(f"kept/{name}/{unit}")

    def begin(self, resume: bool = False) -> None:
        """Make ready to take frames. A new run removes an old store and the sink's own files in the work folder; a resumed one goes on from them."""
        check_target(self.cfg)
        register(self.spark)
        if resume:
            self.written = json.loads(self.folder.load(_STATE) or '{"frames": 0}')["frames"]
            require(self.written % self.unit == 0, "the run is over", StatusCode.InvalidArgument)
            return
        remove(self.cfg)
        for name in ("kept", "checkpoint", _STATE):
            self.folder.delete(name)
        self.written = 0

    def start(self, frames: DataFrame, resume: bool = False) -> StreamingQuery:
        """Begin to write a stream of (frame_id, data)."""
        require(self.query is None, "the sink is running", StatusCode.InvalidArgument)
        self.begin(resume)
        self.query = frames.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.work}/checkpoint").start()
        return self.query

    def finish(self) -> int:
        """Write the last, incomplete chunks at full size; the number of frames."""
        held = self._held()
        n, low, high = held.agg(F.count("*"), F.min("frame_id"), F.max("frame_id")).first()
        if n:
            require(low == self.written and high == low + n - 1, f"frames are missing between {self.written} and {high}", StatusCode.InvalidArgument)
            self._write(held, self.written + n)
        elif not self.written:
            write_metadata(self.cfg, 0)
        self.folder.delete("kept")
        return self.written

    def stop(self) -> int:
        """Take in what has come, write the rest, and end; the number of frames."""
        if self.query is None:
            return self.written
        self.query.processAllAvailable()
        self.query.stop()
        self.query = None
        return self.finish()


def rollover_counts(stream: DataFrame, chunk_frames: int, id_col: str = "event_id") -> DataFrame:
    """Frames in each append-chunk, for a batch or a stream: a tumbling window over counts."""
    return stream.groupBy(div(F.col(id_col), chunk_frames).alias("append_chunk")).agg(F.count("*").alias("n_frames"))
