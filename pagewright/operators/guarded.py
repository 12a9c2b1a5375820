"""Models that may fail while they run: a failure becomes a row that says so, and costs no other frame its result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Model = Callable[[pa.RecordBatch], pa.RecordBatch]
#: Rows that a model is given at once. When it fails for them it is asked for each half, down to single rows.
TOGETHER = 64


def _kinds(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _asked(model: Model, rows: pa.RecordBatch, kinds: pa.Schema, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """model's rows with a null error; for a row that it fails for one of its keys and the error."""
    try:
        out = model(rows)
        if out.schema.names != kinds.names[:-1]:
            raise ValueError(f"the model returns {out.schema.names}, not {kinds.names[:-1]}")
        columns = [out.column(i).cast(f.type) for i, f in enumerate(list(kinds)[:-1])]
    except Exception as e:  # whatever a model raises is its own failure
        if rows.num_rows == 1:
            text = f"{type(e).__name__}: {e}"
            values = [rows.column(f.name).cast(f.type) if f.name in keys else pa.nulls(1, f.type) for f in list(kinds)[:-1]]
            yield pa.RecordBatch.from_arrays([*values, pa.array([text])], schema=kinds)
        else:
            half = rows.num_rows // 2
            yield from _asked(model, rows.slice(0, half), kinds, keys)
            yield from _asked(model, rows.slice(half), kinds, keys)
        return
    yield pa.RecordBatch.from_arrays([*columns, pa.nulls(out.num_rows, pa.string())], schema=kinds)


def guarded(model: Model, schema: str, keys: tuple[str, ...] = ("frame_id",), together: int = TOGETHER, strict: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A provider out of a model that takes and returns Arrow batches, its rows in `schema`: provider(frames) has those columns and error.

    A batch that the model fails for, by an exception or by columns that `schema` doesn't have, is given to it again in halves, until the row at
    fault stands alone: that row comes back as its keys (columns of both) and the error, all else null. strict: the first failure ends the query. See
    answers_and_faults for parting the two."""
    names, kinds = list(keys), _kinds(f"{schema}, error string")
    if missing := set(names) - set(kinds.names):
        raise ValueError(f"schema has no {', '.join(sorted(missing))}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, together):
                rows = batch.slice(low, together)
                if strict:
                    out = model(rows)
                    yield pa.RecordBatch.from_arrays([*[out.column(f.name).cast(f.type) for f in list(kinds)[:-1]], pa.nulls(out.num_rows, pa.string())], schema=kinds)
                else:
                    yield from _asked(model, rows, kinds, names)

    return lambda frames: frames.mapInArrow(run, f"{schema}, error string")


def ensemble(frames: DataFrame, models: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The rows of guarded providers over the same frames, with detector and detector_ord, their order in the dict; a failing member costs its own rows of a
    frame alone."""
    named = [f(frames).withColumn("detector", F.lit(n)).withColumn("detector_ord", F.lit(i)) for i, (n, f) in enumerate(models.items(), 1)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def lost_frames(rows: DataFrame, members: int) -> DataFrame:
    """frame_id, errors (detector: error, in order) of the frames for which all of an ensemble's members failed: nothing is known of them, while a frame
    without rows has no text."""
    failed = rows.where("error is not null").groupBy("frame_id").agg(F.sort_array(F.collect_set(F.struct("detector_ord", F.concat_ws(": ", "detector", "error").alias("e")))).alias("f"))
    few = F.size(F.array_distinct(F.transform("f", lambda x: x["detector_ord"]))) == members
    return failed.where(few).select("frame_id", F.transform("f", lambda x: x["e"]).alias("errors"))
