"""Cameras as a streaming source: a partition for each camera, read where its task runs. A micro-batch is the latest frame of each; older ones are dropped where
they are captured."""

from __future__ import annotations

import importlib
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FRAME = "camera_id long, frame_id long, ts double, width int, height int, n_channels int, data binary"
KINDS = pa.schema([("camera_id", pa.int64()), ("frame_id", pa.int64()), ("ts", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("n_channels", pa.int32()), ("data", pa.binary())])


class Latest:
    """Runs capture() in a thread and keeps its last result: (ts, width, height, n_channels, data), or None for no more. idle: seconds without get() after
    which it ends, as the camera is then read by another process."""

    def __init__(self, capture: Callable[[], tuple | None], idle: float = float("inf")) -> None:
        self._new, self._frame, self._count, self._asked, self._idle = threading.Condition(), None, 0, time.monotonic(), idle
        self._thread = threading.Thread(target=self._run, args=(capture,), daemon=True)
        self._thread.start()

    def _run(self, capture: Callable[[], tuple | None]) -> None:
        while time.monotonic() - self._asked < self._idle and (frame := capture()) is not None:
            with self._new:
                self._frame, self._count = frame, self._count + 1
                self._new.notify_all()
        if hasattr(capture, "close"):
            capture.close()

    def get(self, after: int = -1, wait: float = 0.0) -> tuple[int, tuple | None]:
        """How many frames were captured, and the last; waits for one after number `after`."""
        with self._new:
            self._asked = time.monotonic()
            self._new.wait_for(lambda: self._count > after, wait)
            return self._count, self._frame

    def running(self) -> bool:
        return self._thread.is_alive()

    def join(self) -> None:
        self._thread.join()


#: The open cameras of this process, and the number of the last frame each gave: a Python worker is used again by later tasks.
_open: dict[tuple[str, int], Latest] = {}
_given: dict[tuple[str, int], int] = {}


def latest_frame(capture: str, camera: int, wait: float, idle: float) -> tuple | None:
    """The newest frame of a camera that this process has not given yet, None if none comes in `wait` seconds. capture: "module:function"; function(camera)
    opens a camera and gives a capture for Latest."""
    key = (capture, camera)
    if key not in _open or not (_open[key].running() or _open[key].get()[0] > _given.get(key, 0)):
        module, name = capture.split(":")
        _open[key], _given[key] = Latest(getattr(importlib.import_module(module), name)(camera), idle), 0
    count, frame = _open[key].get(_given[key], wait)
    if frame is None or count <= _given[key]:
        return None
    _given[key] = count
    return frame


class Spool:
    """Frames that were given, one file each, in a folder that all machines share: a batch that is read again gives the same frames."""

    def __init__(self, folder: str) -> None:
        self.system, self.root = FileSystem.from_uri(folder)

    def _path(self, camera: int, tick: int) -> str:
        return f"{self.root}/{camera}-{tick}.arrow"

    def get(self, camera: int, tick: int) -> pa.Table | None:
        path = self._path(camera, tick)
        if self.system.get_file_info(path).type == FileType.NotFound:
            return None
        with self.system.open_input_file(path) as f:
            return pa.ipc.open_file(f).read_all()

    def put(self, camera: int, tick: int, rows: pa.Table) -> None:
        """In place at once, so that a task that is stopped leaves nothing half written; also without rows, so that "no frame" stays so."""
        self.system.create_dir(self.root, recursive=True)
        part = f"{self.root}/.{camera}-{tick}-{uuid.uuid4().hex}"
        with self.system.open_output_stream(part) as out, pa.ipc.new_file(out, rows.schema) as f:
            f.write_table(rows)
        self.system.move(part, self._path(camera, tick))

    def forget(self, tick: int) -> None:
        """Removes what was given up to tick."""
        for f in self.system.get_file_info(FileSelector(self.root, allow_not_found=True)):
            stem, _, kind = f.base_name.partition(".")
            if kind == "arrow" and int(stem.rpartition("-")[2]) <= tick:
                self.system.delete_file(f.path)


@dataclass
class CameraPartition(InputPartition):
    camera: int
    tick: int


class CameraReader(DataSourceStreamReader):
    """Offsets are ticks of the driver's clock in milliseconds, so they go on after a restart; a frame's number is the tick of its batch."""

    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        if "spool" not in self.options:
            raise ValueError("option spool has to name a folder that driver and executors share, as a URI")
        self.cameras = [int(c) for c in options.get("cameras", "0").split(",")]
        self.last = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"tick": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.last = max(self.last + 1, int(time.time() * 1000))
        return {"tick": self.last}

    def partitions(self, start: dict, end: dict) -> list[CameraPartition]:
        self.last = max(self.last, end["tick"])
        return [CameraPartition(c, end["tick"]) for c in self.cameras] if end["tick"] > start["tick"] else []

    def read(self, partition: CameraPartition) -> Iterator[pa.RecordBatch]:
        camera, tick = partition.camera, partition.tick
        spool = Spool(self.options["spool"])
        rows = spool.get(camera, tick)
        if rows is None:
            frame = latest_frame(self.options["capture"], camera, float(self.options.get("wait", "5")), float(self.options.get("idle", "60")))
            rows = pa.Table.from_pylist([] if frame is None else [dict(zip(KINDS.names, (camera, tick, *frame)))], KINDS)
            spool.put(camera, tick, rows)
        yield from rows.to_batches()

    def commit(self, end: dict) -> None:
        Spool(self.options["spool"]).forget(end["tick"])


class CameraSource(DataSource):
    """spark.dataSource.register(CameraSource); spark.readStream.format("camera") with options capture ("module:function"; function(camera) opens a camera),
    spool (a shared folder's URI), cameras ("0,1"), wait (seconds for a frame, 5) and idle (seconds after which a camera that is no longer asked is closed, 60).

    Each camera's pixels are read by a task, so none pass through the driver. A frame that a later one overtakes is never read. A batch that was not
    committed before a restart gives the same frames again, out of the spool; frames are removed from there once their batch is committed."""

    @classmethod
    def name(cls) -> str:
        return "camera"

    def schema(self) -> str:
        return FRAME

    def streamReader(self, schema: StructType) -> CameraReader:  # noqa: N802
        return CameraReader(self.options)
