"""What each stage of a plan took: rows, frames and seconds as a table; the same of each micro-batch of a stream."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

TABLE = "run string, stage string, rows long, frames long, seconds double"
STREAM_TABLE = "run string, batch long, stage string, rows long, frames long, seconds double"


def counts(df: DataFrame) -> list:
    """What a stage is asked: rows, and about how many frames they are of."""
    frames = F.approx_count_distinct("frame_id") if "frame_id" in df.columns else F.lit(None).cast("long")
    return [F.count(F.lit(1)).alias("rows"), F.max(frames).alias("frames") if "frame_id" not in df.columns else frames.alias("frames")]


class Metrics:
    """Rows, frames and seconds of the stages that are evaluated through it, taken while they are written: without another pass."""

    def __init__(self, run: str = "") -> None:
        self.run, self.rows = run, []

    @contextmanager
    def watched(self, df: DataFrame, stage: str) -> Iterator[DataFrame]:
        """df, to be evaluated once inside the block."""
        seen, start = Observation(), time.time()
        yield df.observe(seen, *counts(df))
        got = seen.get
        self.rows.append((self.run, stage, got["rows"], got["frames"], time.time() - start))

    def table(self, spark: SparkSession) -> DataFrame:
        """run, stage, rows, frames, seconds in order of evaluation."""
        return spark.createDataFrame(self.rows, TABLE)

    def seconds(self) -> float:
        return sum(r[-1] for r in self.rows)

    def throughput(self, frames: DataFrame) -> DataFrame:
        """run, frames, seconds, frames_per_second of all frames that went in, rejected ones too."""
        took = F.lit(self.seconds())
        rate = F.when(took > 0, F.col("frames") / took)
        return frames.agg(F.count("*").alias("frames")).select(F.lit(self.run).alias("run"), "frames", took.alias("seconds"), rate.alias("frames_per_second"))


def observed(frames: DataFrame, stage: str) -> DataFrame:
    """A streaming DataFrame whose micro-batches tell a StreamMetrics their rows and frames."""
    return frames.observe(stage, *counts(frames))


class StreamMetrics(StreamingQueryListener):
    """Keeps what observed() stages tell of each micro-batch; append() adds it to a table: spark.streams.addListener(StreamMetrics())."""

    def __init__(self) -> None:
        super().__init__()
        self._lock, self._rows = threading.Lock(), []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        seconds = json.loads(progress.json).get("batchDuration", 0) / 1000
        found = [(str(progress.runId), progress.batchId, stage, row["rows"], row["frames"], seconds) for stage, row in progress.observedMetrics.items() if "rows" in row]
        with self._lock:
            self._rows += found

    def taken(self) -> list[tuple]:
        """The rows so far, each given once."""
        with self._lock:
            rows, self._rows = self._rows, []
        return rows

    def append(self, spark: SparkSession, path: str) -> int:
        """Appends what has come since to the table at path; how many rows."""
        rows = self.taken()
        if rows:
            spark.createDataFrame(rows, STREAM_TABLE).coalesce(1).write.mode("append").parquet(path)
        return len(rows)
