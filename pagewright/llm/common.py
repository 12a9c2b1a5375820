"""What the training-data operators share: tables in the shared folder, Arrow mapping of whole texts, gapless numbering, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Texts are handed to numpy in chunks of about this many characters, so a worker's memory does not follow the partition's size.
CHUNK_CHARS = 1 << 20
#: The same where a chunk's results do not depend on what else is in it, and workers stand beside an executor that is full already.
FEW_CHARS = 1 << 18


#: Removes a query's shuffle files once its result is stored; without it they stay until the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch: whole texts are long rows, and a batch stands in the memory of the executor and its Python worker at once.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SMALL_BATCH = "4m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a new temporary
    folder; on a cluster that would be another folder on each machine, so it is an error there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_uri(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared one, as a URI that every machine opens alike."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", uri)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Tables:
    """The tables that written() makes inside `with Tables() as t:` in this thread; t.drop(spark) removes them, and no others.

    Only for when nothing that reads them is still to be evaluated. Outside any such block tables stay: a frame that an operator
    returns may read them at any later time."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Tables:
        self._token = _scope.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _scope.reset(self._token)

    def drop(self, spark: SparkSession) -> None:
        while self.paths:
            remove(spark, self.paths.pop())


_scope: ContextVar[Tables | None] = ContextVar("tables", default=None)


def written(df: DataFrame, name: str, keep: bool = False, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and survives the loss of any executor. It belongs to the Tables block that
    it is called in, if any, unless keep. compression: a codec of Parquet other than the session's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    wanted = {SHUFFLE_CLEANUP: "true", ARROW_BYTES: SMALL_BATCH}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        (df.write.option("compression", compression) if compression else df.write).parquet(path)
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    if not keep and (scope := _scope.get()) is not None:
        scope.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_chunks(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK_CHARS) -> Iterator[list[pa.Array]]:
    """The columns of batches, the last one a text, in chunks of whole rows of about `chunk` characters; null texts become "".

    No row is split, so one very long text makes one larger chunk."""
    for batch in batches:
        text = batch.column(batch.num_columns - 1).fill_null("")
        sizes = pc.binary_length(text).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            held += int(n)
            if held >= chunk or i + 1 == len(sizes):
                yield [batch.column(c).slice(start, i + 1 - start) for c in range(batch.num_columns - 1)] + [text.slice(start, i + 1 - start)]
                start, held = i + 1, 0


def map_texts(docs: DataFrame, fn: Callable[..., pa.RecordBatch], schema: str, columns: tuple[str, ...] = ("doc_id", "text"), chunk: int = CHUNK_CHARS) -> DataFrame:
    """fn(array of each of `columns`, the last a text) -> RecordBatch, over chunks of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, chunk):
            yield fn(*part)
        pa.default_memory_pool().release_unused()

    return docs.select(*columns).mapInArrow(run, schema)


def text_flag(fn: Callable[[pa.Array], np.ndarray], text: str = "text") -> Column:
    """A boolean of each row's own text: fn(texts without nulls) -> flags, over chunks. Decides by row, whatever its ids, and shuffles nothing."""

    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        chunks = text_chunks([pa.RecordBatch.from_arrays([texts], ["text"])], FEW_CHARS)
        out = pa.array(np.concatenate([np.zeros(0, bool), *(fn(c) for (c,) in chunks)]), pa.bool_())
        pa.default_memory_pool().release_unused()
        return out

    return run(F.col(text))


def parts(rows: int, each: int, least: int = 1) -> int:
    """How many parts of about `each` rows hold `rows`."""
    return max(least, -(-rows // each))


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str, buckets: int, by: str | Column) -> DataFrame:
    """df with `name`: gapless numbers from 0 within `keys`.

    Two levels: rows are dealt to hash buckets of `by`, numbered inside a bucket, and a bucket starts where the ones before it end.
    No task sorts more than a bucket, whatever the size of a key."""
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    sizes = dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    ranked = dealt.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(starts, [*keys, "_bucket"]).withColumn(name, (F.col("_from") + F.col("_rank")).cast("long")).drop("_bucket", "_rank", "_from")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) of every node of edges(a, b); component is the smallest node reachable.

    Alternating stars: each round every node's larger, then its smaller neighbours are linked to the smallest one, until nothing
    changes. Hubs are no problem: only a minimum is taken per node. The longest path halves in a round, so `rounds` is never reached;
    if it were, labels would be unfinished, and this raises."""
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(links, "links")
    seen = _fingerprint(now)
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        now = written(small, "links")
        last, seen = seen, _fingerprint(now)
        if last == seen:
            break
    else:
        raise RuntimeError(f"components are not finished after {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(roots)


def _fingerprint(links: DataFrame) -> tuple:
    """How many links, and two sums of their hashes: equal for equal sets."""
    hashes = [F.sum(F.shiftright(F.xxhash64("u", "v", F.lit(i)), 24)) for i in (0, 1)]
    return tuple(links.agg(F.count("*"), *hashes).first())
