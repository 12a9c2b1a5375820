"""The corpus pipeline over `documents`: language, near copies, benchmark leaks, personal data, pieces.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but the last return the columns of docs.
run() writes each stage's rows as Parquet in the shared folder and reads them again, so a lost executor costs a stage at most. A stage
begins by removing the tables that the stage before it, in this thread and application, has had written: docs is stored by then. Tables
of other queries stay. It also has the session hand texts to Python in small Arrow batches from then on, for its result is written later.

In every stage other columns, whatever their names, pass unchanged, and an empty table gives an empty one."""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import ARROW_BYTES, SMALL_BATCH, Tables, documents, written
from pagewright.llm.decontaminate import clean
from pagewright.llm.language import accepted, fit
from pagewright.llm.minhash import near_classes, text_key
from pagewright.llm.pieces import pieces_of
from pagewright.llm.pii import redact

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_before: dict[tuple[str, int], Tables] = {}


def stage(fn: Stage) -> Stage:
    """fn, after the tables of the stage before it are removed."""

    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(ARROW_BYTES, SMALL_BATCH)
        mine = spark.sparkContext.applicationId, threading.get_ident()
        if mine in _before:
            _before.pop(mine).drop(spark)
        with Tables() as tables:
            out = fn(spark, docs, sf_dir)
        _before[mine] = tables
        return out

    return run


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the models of docs' own labelled rows don't reject, each judged by its own text.

    Null, empty and letterless texts go. Null doc_id or lang: judged as any other. Repeated rows: each. No labelled row at all: no model,
    all go."""
    return accepted(docs, fit(docs))


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (five-word shingles, similarity 0.8): the smallest doc_id, then the smallest digest of the
    text; null ids come last. Repeated rows (same doc_id and text) are one row.

    Null, empty and wordless texts are linked with nothing: a row of each doc_id stays."""
    keep = near_classes(docs, 5, (80, 100)).where("first").select(F.col("doc_id").alias("_pagewright_doc"), F.col("text_key").alias("_pagewright_kept")).distinct()
    keyed = docs.withColumn("_pagewright_id", F.col("doc_id").cast("long")).withColumn("_pagewright_key", text_key())
    same = F.col("_pagewright_id").eqNullSafe(F.col("_pagewright_doc")) & (F.col("_pagewright_key") == F.col("_pagewright_kept"))
    return keyed.join(keep, same, "left_semi").dropDuplicates(["_pagewright_id", "_pagewright_key"]).select(*docs.columns)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a passage of `benchmark`, each judged by its own text. Null and empty texts stay. Repeated rows: each."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind. Null and empty texts stay as they are. Repeated rows: each."""
    return redact(docs)


@stage
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_hash, decoded_sha256, round_trip of all rows. Null and empty texts: no pieces. Repeated rows: each."""
    return pieces_of(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("decontaminate", decontaminate), ("personal_data", personal_data), ("pieces", pieces)]
#: SQL can express neither the language models nor the latent search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, one in STAGES[:-1]:
        docs = written(one(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
