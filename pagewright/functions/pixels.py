"""Pixels in Arrow batches: the gray mean, dark crops inverted, the flattening of a quadrilateral, resampling, enhancement, the outline of a page. data holds
h x w x 3 bytes, RGB."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructType

from .geometry import col
from .raster import enhanced as enhanced_image
from .raster import largest_outline
from .raster import resized as resized_image

#: A crop whose gray mean is lower has light text on dark ground.
DARK = 115.0
#: Weights of red, green and blue in 2**16 parts.
GRAY = np.array([19595, 38470, 7471])


#: Bytes of pixels that are handed on at once.
BATCH_BYTES = 4 << 20


def in_batches(images: Iterable[bytes | None]) -> Iterator[pa.Array]:
    """images in arrays of about BATCH_BYTES, so that a batch of rows never stands in memory as one with all its results."""
    held, size = [], 0
    for data in images:
        held.append(data)
        size += len(data or b"")
        if size >= BATCH_BYTES:
            yield pa.array(held, pa.binary())
            held, size = [], 0
    if held:
        yield pa.array(held, pa.binary())


def _mean(data: bytes) -> float:
    rgb = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int64)
    return float((((rgb @ GRAY) + 0x8000) >> 16).mean())


@F.arrow_udf(DoubleType())
def _gray_mean(data: pa.Array) -> pa.Array:
    return pa.array([_mean(d) if d else None for (d,) in _rows(data)], pa.float64())


@F.arrow_udf(BinaryType())
def _inverted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for data in batches:
        yield from in_batches(d if d is None else (255 - np.frombuffer(d, np.uint8)).tobytes() for (d,) in _rows(data))


def gray_mean(data: str | Column) -> Column:
    """Mean of the pixels' gray values; null without pixels."""
    return _gray_mean(data)


def light_ground(data: str | Column) -> Column:
    """data, inverted if it is dark."""
    c = F.col(data) if isinstance(data, str) else data
    return F.when(_gray_mean(c) < DARK, _inverted(c)).otherwise(c)


def non_empty(crops: DataFrame, data: str = "data") -> DataFrame:
    return crops.where(F.octet_length(data) > 0)


def _homography(corners: np.ndarray, w: int, h: int) -> np.ndarray:
    """The projective map from a w x h rectangle's corners to four points."""
    rows, values = [], []
    for (x, y), (u, v) in zip(((0, 0), (w, 0), (w, h), (0, h)), corners):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        values += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(values, float)), 1).reshape(3, 3)


def flattened(image: np.ndarray, corners: np.ndarray, w: int, h: int, rows: int = 256) -> np.ndarray:
    """The quadrilateral `corners` (in order from the top left) of an image as a w x h rectangle, bilinear; black beyond the image. In bands of rows, so memory
    follows a band."""
    back, out = _homography(corners, w, h), np.zeros((h, w, image.shape[2]), np.uint8)
    tall, wide = image.shape[:2]
    for low in range(0, h, rows):
        y, x = np.mgrid[low : min(h, low + rows), 0:w].astype(float)
        u, v, z = (back[i, 0] * x + back[i, 1] * y + back[i, 2] for i in range(3))
        u, v = u / z, v / z
        inside = (u > -1) & (v > -1) & (u < wide) & (v < tall)
        a, b = np.floor(u), np.floor(v)
        total = np.zeros((*u.shape, image.shape[2]))
        for dx in (0, 1):
            for dy in (0, 1):
                i, j = (a + dx).astype(int), (b + dy).astype(int)
                share = np.abs(1 - dx - (u - a)) * np.abs(1 - dy - (v - b)) * (inside & (i >= 0) & (j >= 0) & (i < wide) & (j < tall))
                total += share[..., None] * image[np.clip(j, 0, tall - 1), np.clip(i, 0, wide - 1)]
        out[low : low + rows] = np.rint(total)
    return out


def rectified(frames: DataFrame) -> DataFrame:
    """frame_id, width, height, data of frames(frame_id, width, height, data, corners, w, h): each frame's corners flattened to w x h. Frames without corners
    or pixels go. One frame is unpacked at a time; those done are handed on at BATCH_BYTES."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i, w, h, data, corners, wide, high in _rows(*batch.columns):
                yield i, wide, high, flattened(image(data, w, h), np.array([(c["x"], c["y"]) for c in corners]), wide, high).tobytes()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["frame_id", "width", "height", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in flat(batches):
            held.append(row)
            size += len(row[3])
            if size >= BATCH_BYTES:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    ready = frames.where("corners is not null and octet_length(data) > 0 and w > 0 and h > 0")
    return ready.select(F.col("frame_id").cast("long"), "width", "height", "data", "corners", "w", "h").mapInArrow(run, "frame_id long, width int, height int, data binary")


def image(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


def _rows(*columns: pa.Array) -> Iterator[tuple]:
    """The rows of columns one by one, so that no more than one image is unpacked at a time."""
    return ([c[i].as_py() for c in columns] for i in range(len(columns[0])))


@F.arrow_udf(BinaryType())
def _resized(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of data, width, height, w, h, kernel."""
    for columns in batches:
        yield from in_batches(resized_image(image(d, a, b), c, e, k).tobytes() if d else d for d, a, b, c, e, k in _rows(*columns))


@F.arrow_udf(BinaryType())
def _enhanced(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of data, width, height."""
    for columns in batches:
        yield from in_batches(enhanced_image(image(d, a, b)).tobytes() if d else d for d, a, b in _rows(*columns))


@F.arrow_udf(BinaryType())
def _swapped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for data in batches:
        yield from in_batches(np.ascontiguousarray(np.frombuffer(d, np.uint8).reshape(-1, 3)[:, ::-1]).tobytes() if d else d for (d,) in _rows(data))


def resized(data: str | Column, width: str | Column, height: str | Column, w: Column, h: Column, kernel: str = "area") -> Column:
    """data of a width x height image as w x h, by a kernel of raster.KERNELS; null and empty data stay."""
    return _resized(col(data), col(width), col(height), w, h, F.lit(kernel))


def enhanced(data: str | Column, width: str | Column = "width", height: str | Column = "height") -> Column:
    """data with its contrast evened out and sharpened, gray in three channels; null and empty data stay."""
    return _enhanced(col(data), col(width), col(height))


def swapped(data: str | Column) -> Column:
    """data with the order of its channels turned round: RGB to BGR and back."""
    return _swapped(col(data))


OUTLINE = StructType().add("contour", ArrayType(StructType().add("x", DoubleType()).add("y", DoubleType()))).add("contour_area", DoubleType())
#: Share of a coarse box that is added on each side before its outline is looked for.
MARGIN = 0.08


def _outline(data: bytes, width: int, height: int, coarse: dict | None, most: int) -> dict:
    low_x, low_y, high_x, high_y = 0, 0, width, height
    if coarse is not None:
        px, py = int((coarse["x2"] - coarse["x1"]) * MARGIN), int((coarse["y2"] - coarse["y1"]) * MARGIN)
        low_x, low_y, high_x, high_y = max(0, coarse["x1"] - px), max(0, coarse["y1"] - py), min(width, coarse["x2"] + px), min(height, coarse["y2"] + py)
    part = image(data, width, height)[low_y:high_y, low_x:high_x]
    none = {"contour": None, "contour_area": 0.0}
    if not part.size:
        return none
    scale = min(1.0, most / max(part.shape[:2]))
    if scale < 1:
        part = resized_image(part, max(1, int(part.shape[1] * scale)), max(1, int(part.shape[0] * scale)), "area")
    found = largest_outline(part)
    if found is None:
        return none
    corners, area = found
    share = area / (part.shape[0] * part.shape[1])
    return {"contour": [{"x": x / scale + low_x, "y": y / scale + low_y} for x, y in corners.tolist()], "contour_area": share * width * height}


@F.arrow_udf(OUTLINE)
def _outlines(data: pa.Array, width: pa.Array, height: pa.Array, coarse: pa.Array, most: pa.Array) -> pa.Array:
    kind = pa.struct([("contour", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("contour_area", pa.float64())])
    return pa.array([_outline(d, *rest) if d else None for d, *rest in _rows(data, width, height, coarse, most)], kind)


def outline(frames: DataFrame, most: int = 1280) -> DataFrame:
    """frames(width, height, data, coarse) with contour and contour_area, for corners_of: the rectangle of the largest outline inside the coarse box and a margin, or
    in the whole frame if that is null, looked for in an image of at most `most` pixels a side. contour is null, and contour_area 0, without an outline of
    enough size; contour_area is in proportion to the part looked at, times the frame. coarse is a box struct; null or empty data: both null."""
    found = F.when(F.octet_length("data") > 0, _outlines(F.col("data"), F.col("width"), F.col("height"), F.col("coarse"), F.lit(most)))
    return frames.withColumn("_outline", found).select("*", "_outline.contour", "_outline.contour_area").drop("_outline")
