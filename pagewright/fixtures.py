"""Tables of boxes, detections, corners and words derived from the provided tables with integer arithmetic, the same in Spark and DuckDB."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from pagewright.functions.pixels import in_batches
from pagewright.sources.tables import dealt

#: {div} is the integer division of the engine, {t[x]} the table x, {three} and {four} make a row for each number under 3 or 4.
BOXES = """
select l_orderkey {div} 8 as frame_id,
  row_number() over (partition by l_orderkey {div} 8 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) as word_id,
  cast((l_partkey * 37 + l_suppkey * 13 + l_linenumber * 101) % 1600 as int) as x1,
  cast(((l_orderkey * 7 + l_linenumber * 3) % 12) * 40 + l_partkey % 7 as int) as y1,
  cast((l_partkey * 37 + l_suppkey * 13 + l_linenumber * 101) % 1600 + 24 + (l_suppkey * 11 + l_partkey) % 160 as int) as x2,
  cast(((l_orderkey * 7 + l_linenumber * 3) % 12) * 40 + l_partkey % 7 + 14 + l_partkey % 19 as int) as y2,
  1 - l_discount as conf, l_partkey as part_id, cast(1 + l_suppkey % 3 as int) as detector_ord
from {t[lineitem]}"""
#: Heights of 25 to 100, where shares of a height meet a difference exactly, bullets (1 or 2 pixels wide) and thin boxes.
TALL = """
select l_orderkey {div} 8 as frame_id,
  row_number() over (partition by l_orderkey {div} 8 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) as word_id,
  cast((l_partkey * 37 + l_suppkey * 13 + l_linenumber * 101) % 1600 as int) as x1,
  cast(((l_orderkey * 7 + l_linenumber * 3) % 6) * 90 + (l_partkey % 5) * 7 as int) as y1,
  cast((l_partkey * 37 + l_suppkey * 13 + l_linenumber * 101) % 1600 + case when l_partkey % 4 = 0 then 1 + l_suppkey % 4 else 24 + l_partkey % 60 end as int) as x2,
  cast(((l_orderkey * 7 + l_linenumber * 3) % 6) * 90 + (l_partkey % 5) * 7 + 25 * (1 + l_suppkey % 4) as int) as y2,
  1 - l_discount as conf
from {t[lineitem]}"""
DETECTIONS = """
select event_id {div} 10 as frame_id, cast(event_id % 10 as int) as det_ord, cast(event_id % 4 as int) as class_id,
  case event_id % 4 when 0 then 'laptop' when 1 then 'tvmonitor' when 2 then 'person' else 'chair' end as label,
  cast((event_id * 37) % 101 as double) / cast(100 as double) as score,
  cast((event_id * 53) % 900 as int) as x1, cast((event_id * 29) % 500 as int) as y1,
  cast((event_id * 53) % 900 + 60 + (event_id * 17) % 500 as int) as x2, cast((event_id * 29) % 500 + 60 + (event_id * 41) % 400 as int) as y2
from {t[events]}"""
FRAMES = """
select event_id as frame_id, user_id % 5 as camera_id, ts, cast(1280 + (event_id * 7) % 640 as int) as width, cast(720 + (event_id * 11) % 360 as int) as height,
  cast((event_id * 53) % 300 as int) as x1, cast((event_id * 29) % 200 as int) as y1,
  cast((event_id * 53) % 300 + 400 + (event_id * 17) % 500 as int) as x2, cast((event_id * 29) % 200 + 300 + (event_id * 41) % 400 as int) as y2,
  cast((event_id * 31) % 400 as double) / cast(100 as double) as seconds
from {t[events]}"""
WORDS = """
select b.*, case when b.part_id % 11 = 0 then '' else p.p_name end as text, case when b.part_id % 3 <> 0 then p.p_brand else '' end as second_text
from boxes b join {t[part]} p on p.p_partkey = b.part_id"""
TABLES = {"boxes": BOXES, "tall": TALL, "detections": DETECTIONS, "frames": FRAMES, "words": "with boxes as (" + BOXES + ") " + WORDS}


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    """How many rows a given table has, by its files' footers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").count()


def spark_table(spark: SparkSession, sf_dir: str, name: str, by_frame: bool = True) -> DataFrame:
    """A table of TABLES. by_frame: those of lineitem alone come dealt by frame_id, in the one shuffle that numbers their boxes."""
    files = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("lineitem", "part", "events", "customer", "documents", "conversations")}
    given = {}
    if by_frame and "{t[lineitem]}" in TABLES[name]:
        files["lineitem"] = "{lineitem}"
        given["lineitem"] = dealt(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), rows_of(spark, sf_dir, "lineitem"), F.expr("l_orderkey div 8"))
    return spark.sql(TABLES[name].format(div="div", t=files, three="explode(array(0, 1, 2))", four="explode(array(0, 1, 2, 3))"), **given)


def duck(name: str) -> str:
    """The table as a SQL subquery for DuckDB."""
    return "(" + TABLES[name].format(div="//", t={t: t for t in ("lineitem", "part", "events", "customer", "documents", "conversations")}, three="unnest([0, 1, 2])", four="unnest([0, 1, 2, 3])") + ")"


#: Value of a pixel at x, y in channel c of frame f.
PIXEL = "(f * 31 + x * 7 + y * 13 + c * 57 + (x * y) % 11) % 256"


@lru_cache(64)
def _pattern(width: int, height: int) -> np.ndarray:
    """The pixels of frame 0; those of other frames differ by one number."""
    y, x, c = np.mgrid[0:height, 0:width, 0:3]
    return ((x * 7 + y * 13 + c * 57 + (x * y) % 11) % 256).astype(np.uint8)


def patterned(f: int, width: int, height: int) -> bytes:
    return (_pattern(width, height) + np.uint8(f * 31 % 256)).tobytes()


def paper(width: int, height: int, x1: int, y1: int, x2: int, y2: int) -> bytes:
    """A light rectangle on dark ground."""
    image = np.full((height, width, 3), 30, np.uint8)
    image[y1:y2, x1:x2] = 220
    return image.tobytes()


@F.arrow_udf(BinaryType())
def _patterns(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for columns in batches:
        yield from in_batches(patterned(*r) for r in zip(*(c.to_pylist() for c in columns)))


@F.arrow_udf(BinaryType())
def _papers(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for columns in batches:
        yield from in_batches(paper(*r) for r in zip(*(c.to_pylist() for c in columns)))


PICTURES = "select c_custkey as frame_id, 20 as width, cast(66 + c_custkey % 5 as int) as height from {t[customer]}"
PAPERS = """
select c_custkey as frame_id, cast(120 + c_custkey % 40 as int) as width, cast(100 + c_custkey % 30 as int) as height,
  cast(20 + c_custkey % 7 as int) as x1, cast(15 + c_custkey % 5 as int) as y1,
  cast(120 + c_custkey % 40 - 18 - c_custkey % 9 as int) as x2, cast(100 + c_custkey % 30 - 12 - c_custkey % 4 as int) as y2
from {t[customer]}"""
#: Tokens, some of characters that may not be read, and scores of up to four tokens at each of three places of a word.
TOKENS = """
select p_partkey as token_id, case p_partkey % 5 when 0 then concat('é', substr(p_brand, 1, 3)) when 1 then concat(substr(p_name, 1, 3), ' ') else substr(p_name, 1, 4) end as token from {t[part]}"""
SCORES = """
with boxes as (""" + BOXES + """), places as (select frame_id, word_id, part_id, {three} as pos from boxes), tries as (select *, {four} as k from places)
select frame_id, word_id, pos, part_id - k * (pos + 1) as token_id, cast((part_id * 37 + pos * 11 + k * 53) % 101 as double) / cast(100 as double) as score
from tries where part_id - k * (pos + 1) >= 0"""
TABLES |= {"pictures": PICTURES, "papers": PAPERS, "tokens": TOKENS, "scores": SCORES}


#: Frames with pixels that a task gets.
EACH_PICTURES = 2_000


def pictures_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The tables pictures or papers without pixels, in tasks of at most about EACH_PICTURES frames: a file of small rows makes large ones."""
    return dealt(spark_table(spark, sf_dir, name), rows_of(spark, sf_dir, "customer"), "frame_id", each=EACH_PICTURES)


def with_pixels(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The tables pictures or papers with data."""
    data = _patterns("frame_id", "width", "height") if name == "pictures" else _papers("width", "height", "x1", "y1", "x2", "y2")
    return pictures_of(spark, sf_dir, name).withColumn("data", data)
