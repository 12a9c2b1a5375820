"""Reading order: columns, bands, lines. Every operator works within frame_id, so one shuffle by it serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.geometry import centre_y, height

#: Gap that parts columns, share of the last height that keeps a band, for merging boxes and for lines.
MERGE, LINES = (40, 0.40), (35, 0.28)


def measured(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("cy", centre_y()).withColumn("h", height())


def with_columns(boxes: DataFrame, gap: int, pos: str = "word_id") -> DataFrame:
    """boxes with col: left to right, a box over `gap` right of all before it opens a column."""
    order = Window.partitionBy("frame_id").orderBy("x1", pos)
    reach = F.max("x2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("x1") > reach + gap), 1).otherwise(0)
    return boxes.withColumn("_opens", opens).withColumn("col", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_opens")


def with_bands(boxes: DataFrame, ratio: float, pos: str = "word_id") -> DataFrame:
    """boxes(cy, h, col) with band and rn: top to bottom, a box joins the band of the one before it if their centres are nearer than
    `ratio` of that one's height; rn is the place in the band from left to right."""
    order = Window.partitionBy("frame_id", "col").orderBy("cy", "x1", pos)
    near = F.abs(F.col("cy") - F.lag("cy").over(order)) < F.lag("h").over(order) * F.lit(ratio)
    banded = boxes.withColumn("_opens", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1))
    banded = banded.withColumn("band", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_opens")
    return banded.withColumn("rn", F.row_number().over(Window.partitionBy("frame_id", "col", "band").orderBy("x1", "cy", pos)))


def banded(boxes: DataFrame, gap: int, ratio: float, pos: str = "word_id") -> DataFrame:
    return with_bands(with_columns(measured(boxes), gap, pos), ratio, pos)


def with_lines(words: DataFrame, gap: int = LINES[0], ratio: float = LINES[1], spread: float = 2.0) -> DataFrame:
    """frame_id, word_id, x1 .. y2, text, rn, line_id: bands split where the gap to the word before exceeds `spread` mean heights of the
    line so far; lines are numbered by column, band and place."""
    row = F.struct("rn", "word_id", "x1", "y1", "x2", "y2", "h", "text")
    bands = banded(words, gap, ratio).groupBy("frame_id", "col", "band").agg(F.sort_array(F.collect_list(row)).alias("row"))
    start = F.struct(F.lit(0).alias("seg"), F.lit(None).cast("double").alias("end"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def add(a: Column, w: Column) -> Column:
        cut = a["end"].isNull() | (w["x1"] - a["end"] > F.lit(spread) * a["sum"] / a["n"])
        seg = F.when(cut, a["seg"] + 1).otherwise(a["seg"])
        return F.struct(
            seg.alias("seg"),
            w["x2"].cast("double").alias("end"),
            F.when(cut, w["h"].cast("double")).otherwise(a["sum"] + w["h"]).alias("sum"),
            F.when(cut, 1).otherwise(a["n"] + 1).alias("n"),
            F.concat(a["out"], F.array(seg)).alias("out"),
        )

    segs = bands.withColumn("segs", F.when(F.size("row") > 1, F.aggregate("row", start, add, lambda a: a["out"])).otherwise(F.array(F.lit(1))))
    cut = segs.select("frame_id", "col", "band", F.explode(F.zip_with("segs", "row", lambda s, w: F.struct(s.alias("seg"), w.alias("w")))).alias("o"))
    line = F.dense_rank().over(Window.partitionBy("frame_id").orderBy("col", "band", "o.seg")).cast("int")
    return cut.withColumn("line_id", line).select("frame_id", "line_id", "o.w.*")


def lines(words: DataFrame, **how) -> DataFrame:
    """frame_id, line_id, text, x1 .. y2, words_count of words(frame_id, word_id, x1 .. y2, text). Frames without words have no lines."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "text"))), lambda s: s["text"]), " ")
    return (
        with_lines(words, **how)
        .groupBy("frame_id", "line_id")
        .agg(text.alias("text"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").cast("int").alias("words_count"))
    )


def unmerged(boxes: DataFrame, pos: str = "word_id") -> DataFrame:
    """Boxes that are not merged: numbered from top to bottom, then left to right."""
    return boxes.withColumn("new_id", F.row_number().over(Window.partitionBy("frame_id").orderBy("y1", "x1", pos)))


def chunks(items: DataFrame, n: int, order: str, by: str = "frame_id") -> DataFrame:
    """items with chunk 1 to n: even, the first ones take what is over."""
    return items.withColumn("chunk", F.ntile(n).over(Window.partitionBy(by).orderBy(order)))
