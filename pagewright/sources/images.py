"""Images in, text out."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions.text import stem

PATTERN = "*.{jpg,jpeg,png,bmp,tif,tiff}"


def image_folder(spark: SparkSession, path: str, tolerant: bool = True) -> DataFrame:
    """path, width, height, n_channels, data of the images right in a folder. tolerant drops files that cannot be decoded; else they come with
    a null height. Frames have no order until it is asked for: orderBy("path")."""
    read = spark.read.format("image").option("pathGlobFilter", PATTERN).option("dropInvalid", tolerant).load(path)
    image = read.select("image.*")
    size = lambda c: F.when(F.col(c) > 0, F.col(c)).alias(c)
    return image.select(F.col("origin").alias("path"), size("width"), size("height"), F.col("nChannels").alias("n_channels"), "data")


def one_image(spark: SparkSession, path: str) -> DataFrame:
    """The image of one file. FileNotFoundError if there is none or it cannot be decoded."""
    found = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    if not found.limit(1).count():
        raise FileNotFoundError(path)
    return found.select(F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("n_channels"), "data")


def text_files(frames: DataFrame, lines: DataFrame) -> DataFrame:
    """name, content of one text file a frame: a line for each line; frames without lines have an empty one. Frames whose paths have one stem would
    overwrite each other: clash says so."""
    body = lines.groupBy("frame_id").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_id", "text"))), lambda s: s["text"]), "\n"), F.lit("\n")).alias("content"))
    named = frames.select("frame_id", F.concat(stem("path"), F.lit(".txt")).alias("name"))
    clash = F.count("*").over(Window.partitionBy("name")) > 1
    return named.withColumn("clash", clash).join(body, "frame_id", "left").select("frame_id", "name", F.coalesce("content", F.lit("")).alias("content"), "clash")


def write_files(files: DataFrame, folder: str) -> None:
    """Writes files(name, content, clash) as one file `name` each, right in folder, through Hadoop's file system, by the tasks that hold the rows. content is text
    or bytes. A file of that name is replaced, others stay; a file is moved into place when it is whole, so a repeated task does no harm. ValueError if names
    clash."""
    if files.where("clash").limit(1).count():
        raise ValueError("several images would be written to one text file")
    spark = files.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    uri = re.sub("^file:/+", "file:///", uri)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = FileSystem.from_uri(uri)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    files.select("name", F.col("content").cast("binary")).mapInArrow(put, "n long").agg(F.sum("n")).collect()


write_text_files = write_files
