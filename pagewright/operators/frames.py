"""Frames: screen and obstacles, corners and their fallbacks, the state kept from frame to frame, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.geometry import overlap

from . import state

SCREENS, OBSTACLES = ("laptop", "tvmonitor"), ("person",)
BOX = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in BOX])


def of_interest(detections: DataFrame, screen: float = 0.3, obstacle: float = 0.5) -> DataFrame:
    """Screens and obstacles of enough confidence. The lower threshold is applied first: it reaches the scan."""
    kept = detections.where(F.col("score") >= min(screen, obstacle))
    return kept.where((F.col("label").isin(*SCREENS) & (F.col("score") >= screen)) | (F.col("label").isin(*OBSTACLES) & (F.col("score") >= obstacle)))


def best_screen(detections: DataFrame) -> DataFrame:
    """frame_id, screen_score, sx1 .. sy2 of the surest screen of every frame with detections (ties: the first); 0 and null without one."""
    screens = F.col("label").isin(*SCREENS) & (F.col("score") >= 0.3)
    top = F.max_by(F.when(screens, F.struct("score", *BOX)), F.when(screens, F.struct("score", (-F.col("det_ord")).alias("o"))))
    found = detections.groupBy("frame_id").agg(top.alias("t"))
    return found.select("frame_id", F.coalesce("t.score", F.lit(0.0)).alias("screen_score"), *[F.col(f"t.{c}").alias(f"s{c}") for c in BOX])


def obstructions(detections: DataFrame, papers: DataFrame, ratio: float = 0.01) -> DataFrame:
    """frame_id, det_ord, label, shared of the first obstacle in each frame that covers over `ratio` of papers(frame_id, px1 .. py2)."""
    hits = detections.where(F.col("label").isin(*OBSTACLES) & (F.col("score") >= 0.5)).join(papers, "frame_id")
    paper = F.greatest(F.lit(1), (F.col("px2") - F.col("px1")) * (F.col("py2") - F.col("py1")))
    shared = overlap(box(), box("p"))
    hits = hits.withColumn("shared", shared).where((F.col("shared") > 0) & (F.col("shared") > F.lit(ratio) * paper))
    return hits.groupBy("frame_id").agg(F.min_by(F.struct("det_ord", "label", "shared"), "det_ord").alias("o")).select("frame_id", "o.*")


def corners_of(frames: DataFrame) -> DataFrame:
    """frames(width, height, model, contour, contour_area, coarse) with corners and source: the model's polygon of four points, else the largest contour's
    rectangle if it has 0.12 of the frame, else the coarse box, else null. model and contour are arrays of x, y; coarse is a box struct."""
    four = F.size("model") == 4
    wide = F.col("contour").isNotNull() & (F.col("contour_area") >= F.lit(0.12) * F.col("width") * F.col("height"))
    point = lambda x, y: F.struct(F.col(f"coarse.{x}").cast("double").alias("x"), F.col(f"coarse.{y}").cast("double").alias("y"))
    coarse = F.array(point("x1", "y1"), point("x2", "y1"), point("x2", "y2"), point("x1", "y2"))
    there = F.col("coarse").isNotNull()
    return frames.withColumn("corners", F.when(four, F.col("model")).when(wide, F.col("contour")).when(there, coarse)).withColumn(
        "source", F.when(four, "model").when(wide, "contour").when(there, "coarse").otherwise("none")
    )


def largest_contours(contours: DataFrame) -> DataFrame:
    """frame_id, contour, contour_area of the largest of each frame's contours(frame_id, ord, contour, area); of equal ones the first."""
    top = F.max_by(F.struct("contour", "area"), F.struct("area", (-F.col("ord")).alias("o")))
    return contours.groupBy("frame_id").agg(top.alias("c")).select("frame_id", F.col("c.contour").alias("contour"), F.col("c.area").alias("contour_area"))


def unknown_classes(detections: DataFrame, known: DataFrame) -> DataFrame:
    """label, class_id, n of the detections whose label is not in known(label), a model's few names."""
    return detections.join(F.broadcast(known.select("label")), "label", "left_anti").groupBy("label", "class_id").agg(F.count("*").alias("n"))


def with_corner_cache(frames: DataFrame, threshold: float = 0.97, by: str = "camera_id", order: str = "frame_id", long: bool | None = None) -> DataFrame:
    """frames(by, order, coarse, detected) with reused, used: in order, a frame takes the cached corners if its coarse box overlaps the cached one by
    `threshold`; else its own, which are cached if they are not null. A null coarse box matches nothing.

    coarse is a struct of x1 .. y2. The state is the cached box and corners, as in a stream (see streaming); a camera of over state.LONG frames goes through
    many tasks (long: always, or never), which gives the same rows. With a column dynamic, the box that was found with the corners, that is cached beside them and comes back as
    used_dynamic."""
    types = dict(frames.dtypes)
    both = "dynamic" in frames.columns
    found = F.when(F.col("detected").isNotNull(), F.struct("detected", "dynamic")) if both else F.col("detected")
    ready = frames.select(by, order, "coarse", found.alias("detected"))
    schema = f"{by} {types[by]}, {order} {types[order]}, reused boolean, used {dict(ready.dtypes)['detected']}"
    parted = state.is_long(ready, by) if long is None else long
    out = state.corners_in_blocks(ready, threshold, by, order, schema) if parted else state.scan(ready, by, order, state.corners_kept(threshold), schema)
    return out.select(by, order, "reused", F.col("used.detected").alias("used"), F.col("used.dynamic").alias("used_dynamic")) if both else out


def with_resolution(frames: DataFrame, budget: float = 2.5, start: int = 1280, by: str = "camera_id", order: str = "frame_id", long: bool | None = None) -> DataFrame:
    """frames(by, order, seconds) with dim, the resolution after each frame: times 0.85 over the budget, times 1.1 under half of it, towards zero,
    320 to 1600. A camera of over state.LONG frames goes through many tasks (long: always, or never), which gives the same rows."""
    types = dict(frames.dtypes)
    ready, schema = frames.select(by, order, "seconds"), f"{by} {types[by]}, {order} {types[order]}, dim int"
    if state.is_long(ready, by) if long is None else long:
        return state.resolutions_in_blocks(ready, budget, start, by, order, schema)
    return state.scan(ready, by, order, state.resolutions(budget, start), schema)


def with_batch_size(runs: DataFrame, start: int = 8, most: int = 256, by: str = "model_id", order: str = "run_id") -> DataFrame:
    """runs(by, order, n_left, items_per_s, failed) with batch, the size tried: it doubles while throughput rises by over 3 %, settles on the best so far
    when it doesn't, and is halved for good by a failure. Each run uses min(size, ceiling, n_left)."""
    types = dict(runs.dtypes)
    return state.scan(runs.select(by, order, "n_left", "items_per_s", "failed"), by, order, state.batch_sizes(start, most), f"{by} {types[by]}, {order} {types[order]}, batch int")


def latest(frames: DataFrame, by: str = "camera_id", ts: str = "ts", order: str = "frame_id") -> DataFrame:
    """The last frame of each camera; the columns of frames."""
    rest = [c for c in frames.columns if c != by]
    return frames.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(ts, order)).alias("f")).select(by, *[f"f.{c}" for c in rest])


def statuses(frames: DataFrame, corners: DataFrame, blocked: DataFrame, lines: DataFrame) -> DataFrame:
    """frame_id, status of frames(frame_id): no_corners, obstructed, no_text or ok, the first that holds."""
    have = lambda df, name: df.select("frame_id").distinct().withColumn(name, F.lit(True))
    joined = frames.select("frame_id").join(have(corners.where(F.col("corners").isNotNull()), "c"), "frame_id", "left").join(have(blocked, "b"), "frame_id", "left").join(have(lines, "l"), "frame_id", "left")
    return joined.select("frame_id", F.when(F.col("c").isNull(), "no_corners").when(F.col("b"), "obstructed").when(F.col("l").isNull(), "no_text").otherwise("ok").alias("status"))


def total_seconds(*stages: str) -> Column:
    """Sum of the stages' seconds; a missing one is 0."""
    total = F.lit(0.0)
    for s in stages:
        total = total + F.coalesce(F.col(s), F.lit(0.0))
    return total


def overhead(total: str, server: str) -> Column:
    """Seconds of a request that no server spent; never under 0."""
    return F.greatest(F.lit(0.0), F.col(total) - F.coalesce(F.col(server), F.lit(0.0)))
