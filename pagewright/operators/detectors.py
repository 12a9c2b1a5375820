"""Several detectors: boxes from a detector's cells, unions that tolerate failures, what an ensemble costs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.geometry import BOX, east_box, whole
from pagewright.functions.text import server_info

from .boxes import suppressed

#: Least score of a cell, overlap from which the lower box goes, and side of the image that the cells belong to.
EAST = (0.5, 0.4, 1280)


def east(cells: DataFrame, least: float = EAST[0], threshold: float = EAST[1], side: int = EAST[2]) -> DataFrame:
    """frame_id, word_id, x1 .. y2, score of cells(frame_id, pos, cx, cy, d0 .. d3, angle, score, width, height): cells over the least score are boxes in an
    image of side x side; of boxes that overlap by over `threshold` the surest stays (ties by pos); those left are scaled to the frame."""
    box = east_box("cx", "cy", "d0", "d1", "d2", "d3", "angle")
    found = cells.where(F.col("score") > least).select("frame_id", "pos", "score", "width", "height", box.alias("b"))
    found = found.select("frame_id", "pos", "score", F.col("b.x").alias("x1"), F.col("b.y").alias("y1"), (F.col("b.x") + F.col("b.w")).alias("x2"), (F.col("b.y") + F.col("b.h")).alias("y2"))
    kept = suppressed(found, threshold, "pos")
    size = cells.groupBy("frame_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    scaled = lambda c: whole(F.col(c) * (F.col("width" if c[0] == "x" else "height") / F.lit(float(side)))).alias(c)
    return kept.join(size, "frame_id").select("frame_id", (F.col("nms_ord") + 1).alias("word_id"), *[scaled(c) for c in BOX], "score")


def union(detectors: dict[str, DataFrame]) -> DataFrame:
    """All boxes of named detectors with detector and detector_ord, their order in the dict, so that an ensemble's result has one order."""
    named = [d.withColumn("detector", F.lit(name)).withColumn("detector_ord", F.lit(i)) for i, (name, d) in enumerate(detectors.items(), 1)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def tolerant_union(detectors: dict[str, Callable[[], DataFrame]], strict: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """union() of the detectors that can be planned, and why the others can't. strict: the first failure is raised. RuntimeError if none is left."""
    planned, failed = {}, {}
    for name, make in detectors.items():
        try:
            planned[name] = make()
            planned[name].schema  # noqa: B018 (resolves the plan)
        except Exception as e:
            if strict:
                raise
            failed[name] = str(e)
    if not planned:
        raise RuntimeError(f"no detector is left: {failed}")
    return union(planned), failed


def answers_and_faults(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """rows whose `error` is null, without that column, and frame_id, error of the others: a provider that fails for a frame says so in a column and
    loses nothing of other frames."""
    good = rows.where(F.col(error).isNull()).drop(error)
    return good, rows.where(F.col(error).isNotNull()).select("frame_id", F.col(error).alias("error")).distinct()


def ensemble_seconds(runs: DataFrame) -> DataFrame:
    """frame_id, seconds of runs(frame_id, detector, seconds): members run side by side, so the slowest counts; a missing time is 0."""
    return runs.groupBy("frame_id").agg(F.max(F.coalesce("seconds", F.lit(0.0))).alias("seconds"))


def fleet(servers: DataFrame) -> DataFrame:
    """One row for servers(url, model, device, num_replicas, healthy): replicas and devices of the healthy ones, and a line that names them by url."""
    up = servers.where("healthy")
    count = F.greatest(F.lit(1), F.coalesce("num_replicas", F.lit(1)))
    line = server_info("model", "url", "device", "num_replicas")
    info = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("url", line.alias("line")))), lambda s: s["line"]), ", ")
    return up.agg(F.coalesce(F.sum(count), F.lit(0)).alias("replicas"), F.countDistinct("device").alias("devices"), info.alias("info"))
