"""Duplicate boxes: greedy suppression, ensemble consensus, merging of neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.geometry import iou

from .layout import MERGE, banded

BOX = ("x1", "y1", "x2", "y2")
#: Boxes of frames that are folded side by side.
CELLS = 1 << 17


def large_enough(boxes: DataFrame, least: int = 32) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.where((w * h >= least) & (w > 1) & (h > 1))


def detected(boxes: DataFrame, least: float = 0.22) -> DataFrame:
    """Boxes of enough confidence that have an inside."""
    return boxes.where((F.col("score") >= least) & (F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2")))


def _leaders(row: Column, kind: str, threshold: float) -> Column:
    """Of an ordered array of boxes those that no earlier leader overlaps by over `threshold`."""
    return F.aggregate(row, F.array().cast(f"array<{kind}>"), lambda kept, b: F.when(F.exists(kept, lambda a: over(a, b, threshold)), kept).otherwise(F.concat(kept, F.array(b))))


def over(a: Column, b: Column, threshold: float) -> Column:
    """Whether two boxes overlap by over `threshold`, 0 or more; boxes apart are told by their sides alone."""
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"]) & (iou(a, b) > threshold)


def overlapping(boxes: DataFrame, threshold: float = 0.5, pos: str = "word_id") -> DataFrame:
    """frame_id, a, b, iou of the pairs of boxes in a frame that overlap by over `threshold`; a is before b by `pos`. A frame's boxes are one array."""
    frames = boxes.groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("pos"), *BOX))).alias("row"))
    later = lambda p, i: F.filter(F.slice("row", i + 2, F.size("row")), lambda q: over(p, q, threshold))
    pairs = F.flatten(F.transform("row", lambda p, i: F.transform(later(p, i), lambda q: F.struct(p["pos"].alias("a"), q["pos"].alias("b"), iou(p, q).alias("iou")))))
    return frames.select("frame_id", F.explode(pairs).alias("p")).select("frame_id", "p.*")


def suppressed(boxes: DataFrame, threshold: float = 0.5, pos: str = "word_id") -> DataFrame:
    """frame_id, pos, x1 .. y2, score of the boxes kept: by score from the top (missing: 1; ties by `pos`), a box goes if a kept one
    overlaps it by over `threshold`. A suppressed box suppresses nothing."""
    row = F.struct((-F.coalesce("score", F.lit(1.0))).alias("rank"), F.col(pos).alias("pos"), *BOX, "score")
    frames = boxes.groupBy("frame_id").agg(F.sort_array(F.collect_list(row)).alias("row"))
    kind = frames.schema["row"].dataType.elementType.simpleString()
    kept = frames.select("frame_id", F.posexplode(_leaders(F.col("row"), kind, threshold)).alias("nms_ord", "b"))
    return kept.select("frame_id", "nms_ord", F.col("b.pos").alias(pos), *[f"b.{c}" for c in BOX], "b.score")


def first_leaders(boxes: np.ndarray, threshold: float) -> np.ndarray:
    """For frames of ordered boxes, an array (frames, boxes, 4) of x1, y1, x2, y2 with NaN for what is missing: the place of the first leader that overlaps a box by
    over `threshold`, its own if none does; then it leads."""
    frames, n = boxes.shape[:2]
    x1, y1, x2, y2 = (np.ascontiguousarray(boxes[..., i].T) for i in range(4))  # a row for each place
    area = np.maximum(0, x2 - x1) * np.maximum(0, y2 - y1)
    leads, first = np.zeros((n, frames), bool), np.empty((n, frames), np.int64)
    for i in range(n):
        wide = np.minimum(x2[:i], x2[i]) - np.maximum(x1[:i], x1[i])
        high = np.minimum(y2[:i], y2[i]) - np.maximum(y1[:i], y1[i])
        near = leads[:i] & (wide > 0) & (high > 0) & (x1[:i] < x2[i]) & (x1[i] < x2[:i]) & (y1[:i] < y2[i]) & (y1[i] < y2[:i])
        k, f = np.nonzero(near)
        shared = wide[k, f] * high[k, f]
        union = area[k, f] + area[i, f] - shared
        over_ = (union > 0) & (shared / np.where(union > 0, union, 1) > threshold)
        first[i] = i
        np.minimum.at(first[i], f[over_], k[over_])
        leads[i] = first[i] == i
    return first.T


def _first_leaders(threshold: float):
    @F.arrow_udf("array<int>")
    def run(rows: pa.Array) -> pa.Array:
        offsets = rows.offsets.to_numpy().astype(np.int64)
        flat = rows.values
        sides = np.stack([flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in BOX], axis=1)
        size, out = np.diff(offsets), np.zeros(len(flat), np.int32)
        order = np.argsort(-size, kind="stable")
        at = 0
        while at < len(order) and size[order[at]]:  # frames of like size side by side
            longest = int(size[order[at]])
            chosen = order[at : at + max(1, CELLS // longest)]
            place = offsets[chosen, None] + np.arange(longest)
            there = np.arange(longest) < size[chosen, None]
            boxes = np.where(there[..., None], sides[np.where(there, place, 0)], np.nan)
            out[place[there]] = first_leaders(boxes, threshold)[there] + 1
            at += len(chosen)
        return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(out[offsets[0] : offsets[-1]], pa.int32()))

    return run


def consensus(boxes: DataFrame, threshold: float = 0.35, order: tuple[str, ...] = ("detector_ord", "word_id")) -> DataFrame:
    """frame_id, word_id, x1 .. y2, votes of several detectors' boxes: in `order`, each box not yet taken leads and takes the later ones that
    overlap it by over `threshold`; a group's box is the mean, towards zero."""
    numbered = boxes.withColumn("pos", F.row_number().over(Window.partitionBy("frame_id").orderBy(*order)))
    frames = numbered.groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("pos", *BOX))).alias("row"))
    led = frames.withColumn("leads", _first_leaders(threshold)("row"))
    member = led.select("frame_id", F.explode(F.zip_with("leads", "row", lambda n, b: F.struct(n.alias("lead"), *[b[c].alias(c) for c in BOX]))).alias("m")).select("frame_id", "m.*")
    groups = member.groupBy("frame_id", "lead").agg(*[F.avg(c).cast("int").alias(c) for c in BOX], F.count("*").cast("int").alias("votes"))
    return groups.select("frame_id", F.row_number().over(Window.partitionBy("frame_id").orderBy("lead")).alias("word_id"), *BOX, "votes")


def merged(boxes: DataFrame, gap: int = MERGE[0], ratio: float = MERGE[1], spread: float = 2.0, most: int = 5, pos: str = "word_id") -> DataFrame:
    """frame_id, word_id, x1 .. y2 of text units: neighbours in a band merge, the nearest pair first (ties: leftmost), while the gap is at most
    `spread` mean heights of both, the unit has at most `most` boxes and no bullet stands at the seam. Boxes under the least area go.

    A band is folded as one array: as many steps as it has boxes at most, each merging one pair."""
    row = banded(large_enough(boxes), gap, ratio, pos)
    mean = F.avg("h").over(Window.partitionBy("frame_id", "col", "band"))
    bullet = (F.col("x2") - F.col("x1") <= mean * F.lit(0.05)) & (F.col("y2") - F.col("y1") <= mean * F.lit(1.4))
    unit = F.struct("rn", F.lit(1).alias("n"), F.col("h").cast("double").alias("sh"), F.col("x1").alias("first"), F.col("x2").alias("last"), F.col("bullet").alias("bl"), F.col("bullet").alias("br"), *BOX)
    bands = row.withColumn("bullet", bullet).groupBy("frame_id", "col", "band").agg(F.sort_array(F.collect_list(unit)).alias("units"))
    kind = bands.schema["units"].dataType.simpleString()

    def nearest(units: Column) -> Column:
        """The seam to merge as a struct gap, i; null if there is none."""

        def seam(i: Column) -> Column:
            a, b = F.get(units, i), F.get(units, i + 1)
            width = b["first"] - a["last"]
            able = ~a["br"] & ~b["bl"] & (a["n"] + b["n"] <= most) & (width <= (a["sh"] + b["sh"]) / (a["n"] + b["n"]) * F.lit(spread))
            return F.when(able, F.struct(width.alias("gap"), i.alias("i")))

        return F.array_min(F.filter(F.transform(F.sequence(F.lit(0), F.size(units) - 2), seam), lambda s: s.isNotNull()))

    def join_at(units: Column, best: Column) -> Column:
        i = best["i"]
        a, b = F.get(units, i), F.get(units, i + 1)
        both = F.struct(
            a["rn"].alias("rn"), (a["n"] + b["n"]).alias("n"), (a["sh"] + b["sh"]).alias("sh"), a["first"].alias("first"), b["last"].alias("last"), a["bl"].alias("bl"), b["br"].alias("br"),
            F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"), F.greatest(a["x2"], b["x2"]).alias("x2"), F.greatest(a["y2"], b["y2"]).alias("y2"),
        )
        return F.concat(F.slice(units, F.lit(1), i), F.array(both), F.slice(units, i + 3, F.size(units))).cast(kind)

    def step(a: Column, _: Column) -> Column:
        """The nearest pair merged; after the last merge, units stay and no seam is looked at. transform binds the seam, so it is found once."""
        units = a["units"]
        once = F.transform(F.array(nearest(units)), lambda best: F.when(best.isNull(), F.struct(units.alias("units"), F.lit(True).alias("done"))).otherwise(F.struct(join_at(units, best).alias("units"), F.lit(False).alias("done"))))
        return F.when(a["done"] | (F.size(units) < 2), a).otherwise(F.get(once, F.lit(0)))

    start = F.struct(F.col("units"), F.lit(False).alias("done"))
    folded = F.aggregate(F.sequence(F.lit(2), F.size("units")), start, step, lambda a: a["units"])
    done = bands.withColumn("units", F.when(F.size("units") > 1, folded).otherwise(F.col("units")))
    flat = done.select("frame_id", "col", "band", F.explode("units").alias("u"))
    return flat.select("frame_id", F.row_number().over(Window.partitionBy("frame_id").orderBy("col", "band", "u.rn")).alias("word_id"), *[f"u.{c}" for c in BOX], F.col("u.n").alias("merged"))
