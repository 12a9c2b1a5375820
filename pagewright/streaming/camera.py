"""Live frames: the latest of each camera, and corners and resolutions kept from frame to frame as typed state that expires with its camera.

Streams with state need the RocksDB state store: see ready()."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from pagewright.operators.frames import latest
from pagewright.operators.state import corners_kept, resolutions

#: coarse and detected are null or four coordinates, as flat columns; dynamic is the box found with the corners.
FRAME = "camera_id long, frame_id long, cx1 int, cy1 int, cx2 int, cy2 int, corner string, dynamic string"
BOX = ("cx1", "cy1", "cx2", "cy2")
CACHED = "camera_id long, frame_id long, reused boolean, used string, used_dynamic string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ready(spark: SparkSession) -> SparkSession:
    """spark, with the state store that typed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def _sorted(parts: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    """The rows of a camera's micro-batch by frame_id; none have pixels. maxFilesPerTrigger and the like bound a micro-batch."""
    return pd.concat([p[columns] for p in parts], ignore_index=True).sort_values("frame_id", kind="stable")


class CornerCache(StatefulProcessor):
    def __init__(self, threshold: float, expiry_ms: int | None) -> None:
        self.step, self.expiry_ms = corners_kept(threshold), expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = StructType()
        for c in BOX:
            kind = kind.add(c, DoubleType())
        self.cached = handle.getValueState("cached", kind.add("corner", StringType()).add("dynamic", StringType()), self.expiry_ms)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kinds = [("camera_id", pa.int64()), ("frame_id", pa.int64()), *[(c, pa.int32()) for c in BOX], ("corner", pa.string()), ("dynamic", pa.string())]
        pair = ["corner", "dynamic"]
        held = None
        if self.cached.exists():
            *box, corner, dynamic = self.cached.get()
            held = None if box[0] is None else np.array(box, float), pa.StructArray.from_arrays([pa.array([v], pa.string()) for v in (corner, dynamic)], pair)
        part = _sorted(rows, [n for n, _ in kinds])
        batch = pa.RecordBatch.from_pandas(part, pa.schema(kinds), preserve_index=False)
        coarse = pa.StructArray.from_arrays([batch.column(c) for c in BOX], BOX, mask=batch.column("cx1").is_null())
        found = pa.StructArray.from_arrays([batch.column(c) for c in pair], pair, mask=batch.column("corner").is_null())
        held, (reused, used) = self.step(held, pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), coarse, found], names=["camera_id", "frame_id", "coarse", "detected"]))
        used = used.to_pylist()
        out = [None if u is None else u[c] for c in pair for u in used]
        n = batch.num_rows
        yield pd.DataFrame({"camera_id": part["camera_id"].to_numpy(), "frame_id": part["frame_id"].to_numpy(), "reused": reused.to_pandas().to_numpy(), "used": pd.Series(out[:n], dtype=object), "used_dynamic": pd.Series(out[n:], dtype=object)})
        if held is not None:
            last = held[1][0].as_py()
            self.cached.update((*((None,) * 4 if held[0] is None else map(float, held[0])), last["corner"], last["dynamic"]))


class Resolution(StatefulProcessor):
    def __init__(self, budget: float, start: int, expiry_ms: int | None) -> None:
        self.step, self.expiry_ms = resolutions(budget, start), expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.dim = handle.getValueState("dim", StructType().add("dim", IntegerType()), self.expiry_ms)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        dim = self.dim.get()[0] if self.dim.exists() else None
        part = _sorted(rows, ["camera_id", "frame_id", "seconds"])
        kinds = pa.schema([("camera_id", pa.int64()), ("frame_id", pa.int64()), ("seconds", pa.float64())])
        dim, (dims,) = self.step(dim, pa.RecordBatch.from_pandas(part, kinds, preserve_index=False))
        yield pd.DataFrame({"camera_id": part["camera_id"].to_numpy(), "frame_id": part["frame_id"].to_numpy(), "dim": dims.to_numpy()})
        self.dim.update((dim,))


def _with_state(frames: DataFrame, processor: StatefulProcessor, schema: str, expiry_ms: int | None) -> DataFrame:
    return frames.groupBy("camera_id").transformWithStateInPandas(processor, schema, "append", "none" if expiry_ms is None else "processingTime")


def cached_corners(frames: DataFrame, threshold: float = 0.97, expiry_ms: int | None = None) -> DataFrame:
    """The corner cache over a stream of frames (FRAME): CACHED rows, by the step of the batch form. State is a box, its corners and the box found with them
    for each camera. expiry_ms: it is forgotten so long after a camera's last frame; such a query looks for what has expired in batches of its own, so it
    runs on until it is stopped."""
    return _with_state(frames.select(*[c.split()[0] for c in FRAME.split(", ")]), CornerCache(threshold, expiry_ms), CACHED, expiry_ms)


def adapted_resolution(frames: DataFrame, budget: float = 2.5, start: int = 1280, expiry_ms: int | None = None) -> DataFrame:
    """camera_id, frame_id, dim over a stream of frames(camera_id, frame_id, seconds), by the step of the batch form. State is the resolution of each camera;
    expiry_ms as in cached_corners."""
    return _with_state(frames.select("camera_id", "frame_id", "seconds"), Resolution(budget, start, expiry_ms), "camera_id long, frame_id long, dim int", expiry_ms)


def on_latest(frames: DataFrame, action: Callable[[DataFrame, int], None], **trigger):
    """A query that gives each micro-batch's last frame of every camera to action(frames, epoch); older ones are dropped."""
    return frames.writeStream.foreachBatch(lambda batch, epoch: action(latest(batch), epoch)).trigger(**(trigger or {"availableNow": True})).start()
