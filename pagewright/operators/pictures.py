"""Frames with pixels: crops cut from their frames, made ready for a recogniser; boxes drawn into frames; lossless image files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from pagewright.functions import pixels
from pagewright.functions.codec import pack
from pagewright.functions.geometry import enlarged
from pagewright.functions.raster import resized

#: The digits 0 to 9 in 3 x 5 dots, a row a string.
DIGITS = ("### # # # # ###", " #  #  #  #  # ", "###  #####  ###", "###  ####  ####", "# ## ####  #  #", "####  ###  ####", "####  #### ####", "###  #  #  #  #", "#### ##### ####", "#### ####  ####")


def _with_frame(frames: DataFrame, rows: DataFrame) -> DataFrame:
    """_rows, an array of a frame's rows, with _width, _height, _data of their frame, null if it has no pixels; a row for each frame that rows has. frames and
    rows meet by frame_id in a merge join: pixels made by Python count as a few bytes in Spark's estimates, by which it would broadcast them all. Rows go to as
    many tasks as frames do, so that only they are shuffled anew where they came dealt. Of repeated frames with pixels one counts; null meets null."""
    image = F.when(F.octet_length("data") > 0, F.struct(*[F.col(c).alias(f"_{c}") for c in ("width", "height", "data")]))  # no filter: it would go below the dealing
    one = frames.select(F.col("frame_id").cast("long").alias("_id"), image.alias("_image")).groupBy("_id").agg(F.first("_image", ignorenulls=True).alias("_image"))
    each = rows.select(F.col("frame_id").cast("long").alias("_frame"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row")).repartition("_frame").groupBy("_frame").agg(F.collect_list("_row").alias("_rows"))
    met = each.where("_frame is not null").join(one.hint("merge"), F.col("_frame") == F.col("_id"), "left")
    lost = each.where("_frame is null").join(one.where("_id is null"), F.lit(True), "left")
    return met.unionByName(lost).select("_rows", "_image._width", "_image._height", "_image._data")


def _met(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, Iterator[tuple[np.ndarray | None, int]]]:
    """All rows of a batch of _with_frame; and each frame's image, unpacked when its turn comes, with the number of its rows."""
    lists = batch.column("_rows")
    sizes = lists.value_lengths().to_pylist()
    pictures = (None if data is None else pixels.image(data, w, h) for w, h, data in ([batch.column(c)[i].as_py() for c in ("_width", "_height", "_data")] for i in range(len(sizes))))
    return pa.RecordBatch.from_struct_array(lists.flatten()), zip(pictures, sizes)


def cut(frames: DataFrame, crops: DataFrame, kernel: str = "bins") -> DataFrame:
    """crops(frame_id, cx1 .. cy2, out_w, out_h) with data, their pixels out of frames(frame_id, width, height, data) at size out_w x out_h. data is null where
    the frame has no pixels, and "" for a crop outside the frame."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in crops.schema.fields if f.name != "data"]
    names = [f.name for f in crops.schema.fields if f.name != "data"]

    def parts(image: np.ndarray | None, boxes: list[tuple]) -> Iterator[bytes | None]:
        for x1, y1, x2, y2, w, h in boxes:
            if image is None:
                yield None
            else:
                part = image[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)]
                yield resized(part, w, h, kernel).tobytes() if part.size else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, each = _met(batch)
            boxes = zip(*(rows.column(c).to_pylist() for c in ("cx1", "cy1", "cx2", "cy2", "out_w", "out_h")))
            start = 0
            for data in pixels.in_batches(d for image, n in each for d in parts(image, list(islice(boxes, n)))):
                yield pa.RecordBatch.from_arrays([*(rows.column(c).slice(start, len(data)) for c in names), data], [*names, "data"])
                start += len(data)

    return _with_frame(frames, crops.drop("data")).mapInArrow(run, ", ".join([*fields, "data binary"]))


def upscaled(crops: DataFrame, least: int, target: int, kernel: str = "lanczos") -> DataFrame:
    """crops(out_w, out_h, data) whose shorter side is under `least` brought up to `target`; out_w and out_h with them."""
    w, h = enlarged("out_w", "out_h", least, target)
    grown = F.when((F.octet_length("data") > 0) & (F.least("out_w", "out_h") < least), pixels.resized("data", "out_w", "out_h", w, h, kernel)).otherwise(F.col("data"))
    return crops.withColumns({"data": grown, "_w": w, "_h": h}).withColumns({"out_w": F.col("_w"), "out_h": F.col("_h")}).drop("_w", "_h")


def wired(crops: DataFrame, least: int = 32, target: int = 32) -> DataFrame:
    """crops(out_w, out_h, data) as a remote recogniser takes them: small ones upscaled, channels as BGR, packed with their size; empty ones go."""
    ready = upscaled(pixels.non_empty(crops), least, target)
    return ready.withColumn("data", pack("out_h", "out_w", F.lit(3), pixels.swapped("data")))


def _number(image: np.ndarray, n: int, x: int, y: int, colour: tuple, dot: int = 2) -> None:
    """A number's digits with their lower left corner at x, y."""
    for i, d in enumerate(str(abs(n))):
        for k, mark in enumerate(DIGITS[int(d)]):
            if mark == "#":
                a, b = y - (5 - k // 3) * dot, x + (i * 4 + k % 3) * dot
                image[max(0, a) : max(0, a + dot), max(0, b) : max(0, b + dot)] = colour


def _line(image: np.ndarray, a: tuple, b: tuple, colour: tuple, thick: int) -> None:
    steps = int(max(abs(b[0] - a[0]), abs(b[1] - a[1]))) + 1
    xs, ys = (np.rint(np.linspace(a[i], b[i], steps)).astype(int) for i in (0, 1))
    for dx in range(-(thick // 2), thick - thick // 2):
        for dy in range(-(thick // 2), thick - thick // 2):
            inside = (xs + dx >= 0) & (ys + dy >= 0) & (xs + dx < image.shape[1]) & (ys + dy < image.shape[0])
            image[ys[inside] + dy, xs[inside] + dx] = colour


PICTURE = "frame_id long, width int, height int, data binary"


def _drawn(frames: DataFrame, rows: DataFrame, draw: Callable[[np.ndarray, pa.RecordBatch], None]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, each = _met(batch)
            start = 0
            for image, n in each:
                if image is not None:
                    out, mine = image.copy(), found.slice(start, n)
                    draw(out, mine)
                    values = (mine.column("_frame")[0].as_py(), out.shape[1], out.shape[0], out.tobytes())
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["frame_id", "width", "height", "data"])
                start += n

    return _with_frame(frames, rows.withColumn("_frame", F.col("frame_id").cast("long"))).mapInArrow(run, PICTURE)


def with_boxes(frames: DataFrame, boxes: DataFrame, colour: tuple = (0, 255, 0), thick: int = 2, number: str | None = "word_id") -> DataFrame:
    """frame_id, width, height, data of the frames that have boxes(frame_id, x1 .. y2), these drawn as outlines, with their number over the top left corner."""

    def draw(image: np.ndarray, rows: pa.RecordBatch) -> None:
        for i, (x1, y1, x2, y2) in enumerate(zip(*(rows[c].to_pylist() for c in ("x1", "y1", "x2", "y2")))):
            for a, b in (((x1, y1), (x2, y1)), ((x2, y1), (x2, y2)), ((x2, y2), (x1, y2)), ((x1, y2), (x1, y1))):
                _line(image, a, b, colour, thick)
            if number is not None:
                _number(image, rows[number][i].as_py() or 0, x1, max(10, y1 - 5), (255, 0, 0))

    return _drawn(frames, boxes, draw)


def with_corners(frames: DataFrame, corners: DataFrame, colour: tuple = (0, 255, 0), thick: int = 3) -> DataFrame:
    """The same for corners(frame_id, corners), an array of x, y: a closed outline; frames whose corners are null are as they are."""

    def draw(image: np.ndarray, rows: pa.RecordBatch) -> None:
        for points in rows["corners"].to_pylist():
            at = [(p["x"], p["y"]) for p in points or []]
            for a, b in zip(at, at[1:] + at[:1]):
                _line(image, a, b, colour, thick)

    return _drawn(frames, corners.select("frame_id", "corners"), draw)


def png(data: bytes, width: int, height: int) -> bytes:
    """An RGB image as a PNG file."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.zeros((height, width * 3 + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(data, np.uint8).reshape(height, width * 3)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


@F.arrow_udf(BinaryType())
def _png(data: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    return pa.array([png(d.as_py(), w.as_py(), h.as_py()) for d, w, h in zip(data, width, height)], pa.binary())


def png_files(pictures: DataFrame, stage: str) -> DataFrame:
    """name, content, clash of a PNG file `<stage>-<frame_id>.png` for each of pictures(frame_id, width, height, data), for images.write_files."""
    name = F.concat(F.lit(f"{stage}-"), F.col("frame_id").cast("string"), F.lit(".png"))
    return pixels.non_empty(pictures).select(name.alias("name"), _png("data", "width", "height").alias("content"), F.lit(False).alias("clash"))
