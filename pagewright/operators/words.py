"""Recognised words: cleaning, weak words, the second reading, crops and their plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.geometry import crop_pads, shrunk
from pagewright.functions.text import clean_text, weak


def crops(units: DataFrame, pad: float = 0.55) -> DataFrame:
    """units(frame_id, word_id, x1 .. y2, width, height) with the padded crop cx1 .. cy2 and its size out_w, out_h after shrinking; crops without
    an inside go."""
    px, py = crop_pads(F.col("y2") - F.col("y1"), pad)
    cut = units.select(
        "*",
        F.greatest(F.lit(0), F.col("x1") - px).alias("cx1"),
        F.greatest(F.lit(0), F.col("y1") - py).alias("cy1"),
        F.least("width", F.col("x2") + px).alias("cx2"),
        F.least("height", F.col("y2") + py).alias("cy2"),
    ).where("cx1 < cx2 and cy1 < cy2")
    w, h = shrunk(F.col("cx2") - F.col("cx1"), F.col("cy2") - F.col("cy1"))
    return cut.withColumn("out_w", w).withColumn("out_h", h)


def recognised(readings: DataFrame, bullets: bool = True) -> DataFrame:
    """readings(text, ...) with text cleaned, without those that are empty then."""
    return readings.withColumn("text", clean_text("text", bullets)).where(F.col("text") != "")


def weak_words(words: DataFrame, least: float = 0.97) -> DataFrame:
    return words.where(weak("text", "conf", least=least))


def weak_crops(crops_: DataFrame, words: DataFrame) -> DataFrame:
    """Crops whose word is to be read again."""
    return crops_.join(weak_words(words).select("frame_id", "word_id"), ["frame_id", "word_id"], "left_semi")


def reread(words: DataFrame, second: DataFrame) -> DataFrame:
    """words with the text of second(frame_id, word_id, text) where that is not empty; confidence stays. Words never read first stay away."""
    other = second.select("frame_id", "word_id", F.col("text").alias("_second"))
    return words.join(other, ["frame_id", "word_id"], "left").withColumn("text", F.coalesce(F.nullif("_second", F.lit("")), F.col("text"))).drop("_second")


def answered(crops_: DataFrame, answers: DataFrame) -> DataFrame:
    """crops_(batch_id, pos, ...) with text and conf of the answers at their place; unanswered ones have "" and 0."""
    joined = crops_.join(answers.select("batch_id", "pos", "text", "conf"), ["batch_id", "pos"], "left")
    return joined.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("conf", F.coalesce("conf", F.lit(0.0)))


def by_size(crops_: DataFrame, aspect: bool = True) -> DataFrame:
    """Crops of a partition in order of shape, so that a batch holds like ones."""
    key = (F.col("x2") - F.col("x1")) / F.greatest(F.lit(1), F.col("y2") - F.col("y1")) if aspect else F.col("x2") - F.col("x1")
    return crops_.sortWithinPartitions(key, "frame_id", "word_id")


def restored(words: DataFrame) -> DataFrame:
    """words in order of frame and word, after work in any order."""
    return words.orderBy("frame_id", "word_id")
