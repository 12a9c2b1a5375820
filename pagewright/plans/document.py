"""The whole plan: detections, corners and text boxes in, lines and status out. Models are tables or functions that return them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pagewright.functions import pixels
from pagewright.functions.geometry import bounds_of, ordered_corners, rectified_size
from pagewright.operators import pictures
from pagewright.operators.boxes import consensus, detected, merged, suppressed
from pagewright.operators.detectors import answers_and_faults
from pagewright.operators.frames import best_screen, corners_of, obstructions, statuses
from pagewright.operators.layout import lines
from pagewright.operators.words import by_size, crops, recognised, reread, weak_crops
from pagewright.plans.metrics import Metrics, counts
from pagewright.sources.images import write_files
from pagewright.sources.tables import shared_folder, stored

POINTS = "array<struct<x: double, y: double>>"


@dataclass
class Providers:
    """What a model would give, for a DataFrame of frames or crops: a table-backed provider is a function that joins a table.

    detections(frames): frame_id, det_ord, label, score, x1 .. y2. corners(frames): frames with model, contour, contour_area.
    boxes(frames): frame_id, detector_ord, word_id, score, x1 .. y2. read(crops), second(crops): frame_id, word_id, text, conf.
    Frames and crops have data where the plan was given pixels; boxes are those of the flattened page then."""

    detections: Callable[[DataFrame], DataFrame]
    corners: Callable[[DataFrame], DataFrame]
    boxes: Callable[[DataFrame], DataFrame]
    read: Callable[[DataFrame], DataFrame]
    second: Callable[[DataFrame], DataFrame] | None = None


def outlined(frames: DataFrame) -> DataFrame:
    """A corners provider without a model: the largest outline in each frame's pixels."""
    return pixels.outline(frames.withColumn("model", F.lit(None).cast(POINTS)))


def flat_pages(frames: DataFrame, corners: DataFrame, most: int = 5760) -> DataFrame:
    """frame_id, width, height, data of frames(frame_id, width, height, data) that have corners(frame_id, corners): the page inside them flattened so that its
    longer side has `most` pixels, contrast evened out."""
    size = rectified_size("corners", most)
    found = corners.where("corners is not null").select("frame_id", ordered_corners("corners").alias("corners")).withColumn("_s", size).select("frame_id", "corners", "_s.w", "_s.h")
    flat = pixels.rectified(frames.select("frame_id", "width", "height", "data").join(found, "frame_id"))
    return flat.withColumn("data", pixels.enhanced("data"))


def process(
    frames: DataFrame, use: Providers, ensemble: bool = False, pad: float = 0.55, stages: str | None = None, metrics: Metrics | None = None, page: int = 5760, draw: bool = False
) -> tuple[DataFrame, DataFrame]:
    """lines and status of frames(frame_id, width, height). Frames without corners or with an obstacle on the paper are gated before any
    text is detected; the same rows pass no gate twice.

    With pixels, frames(.., data), the page of each open frame is flattened to `page` pixels and enhanced, boxes are looked for in that, and crops are cut
    from it; boxes and lines are in its coordinates then.

    Models run once a frame: what they return is stored as tables detections, corners, pages, boxes, crops, readings, words and lines under `stages`, or in a new folder under
    spark.checkpoint.dir. The caller removes it (tables.removed) when lines and status are no longer read. metrics: gets each table's rows, frames and seconds.
    draw: writes PNG files of corners, boxes and lines under `stages`/pictures. A provider may return a column error (see guarded): rows with an error go into
    the table faults(stage, frame_id, error), and all others on."""
    spark, with_pixels = frames.sparkSession, "data" in frames.columns
    folder = stages or shared_folder(spark, "plan")
    watch = metrics or Metrics()

    def kept(df: DataFrame, name: str) -> DataFrame:
        with watch.watched(df, name) as seen:
            return stored(seen, f"{folder}/{name}")

    faults: list[DataFrame] = []

    def asked(rows: DataFrame, name: str) -> DataFrame:
        """The stored rows of a provider that are answers."""
        rows = kept(rows, name)
        if "error" not in rows.columns:
            return rows
        good, failed = answers_and_faults(rows)
        faults.append(failed.select(F.lit(name).alias("stage"), F.col("frame_id").cast("long").alias("frame_id"), "error"))
        return good

    def shown(picture: DataFrame, name: str) -> None:
        if draw and with_pixels:
            write_files(pictures.png_files(picture, name), f"{folder}/pictures")

    found = asked(use.detections(frames), "detections")
    screens = best_screen(found)
    coarse = frames.join(screens, "frame_id", "left").withColumn(
        "coarse", F.when(F.col("sx1").isNotNull(), F.struct(*[F.col(f"s{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]))
    )
    cornered = kept(corners_of(use.corners(coarse)).drop("data"), "corners")
    papers = cornered.where(F.col("corners").isNotNull()).select("frame_id", bounds_of("corners").alias("p"))
    papers = papers.select("frame_id", *[F.col(f"p.{c}").alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")])
    blocked = obstructions(found, papers)
    open_frames = frames.join(papers.select("frame_id"), "frame_id", "left_semi").join(blocked.select("frame_id"), "frame_id", "left_anti")
    shown(pictures.with_corners(frames, cornered) if draw and with_pixels else frames, "corners")
    pages = kept(flat_pages(open_frames, cornered, page), "pages") if with_pixels else open_frames
    boxes = asked(use.boxes(pages), "boxes")
    single = suppressed(consensus(boxes).withColumn("score", F.lit(None).cast("double")) if ensemble else detected(boxes))
    units = merged(single.drop("word_id").withColumnRenamed("nms_ord", "word_id"))
    cut = crops(units.join(pages.select("frame_id", "width", "height"), "frame_id"), pad)
    if with_pixels:
        cut = kept(pictures.cut(pages, cut), "crops")
        shown(pictures.with_boxes(pages, cut) if draw else frames, "boxes")
    words = recognised(asked(use.read(by_size(cut)), "readings")).join(cut.select("frame_id", "word_id", "x1", "y1", "x2", "y2"), ["frame_id", "word_id"])
    if use.second is not None:
        words = kept(words, "first-words")
        words = reread(words, recognised(asked(use.second(by_size(weak_crops(cut, words))), "second-readings")))
    out = kept(lines(kept(words, "words")), "lines")
    shown(pictures.with_boxes(pages, out, (200, 200, 200), 1, "line_id") if draw and with_pixels else frames, "lines")
    if faults:
        kept(reduce(DataFrame.unionByName, faults), "faults")
    return out, statuses(frames, cornered, blocked, out)


def measured(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and an observation of its rows and frames that is filled when df is evaluated: a stage's metrics without another pass."""
    seen = Observation(name)
    return df.observe(seen, *counts(df)), seen
