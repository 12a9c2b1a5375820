import pyarrow as pa
import pyarrow.compute as pc
import pytest

from pagewright.operators.detectors import answers_and_faults
from pagewright.operators.guarded import ensemble, guarded, lost_frames

SCHEMA = "frame_id long, x1 int, score double"


def model(bad, twice=True):
    """Two boxes a frame; fails for the frames in bad."""

    def run(rows):
        ids = rows.column("frame_id")
        for i in ids.to_pylist():
            if i in bad:
                raise MemoryError(f"frame {i}")
        ids = pa.concat_arrays([ids, ids]) if twice else ids
        return pa.RecordBatch.from_arrays([ids, pc.cast(ids, pa.int64()), pa.array([0.5] * len(ids))], names=["frame_id", "x1", "score"])

    return run


def frames(spark, n=20):
    return spark.range(n).withColumnRenamed("id", "frame_id").selectExpr("frame_id", "'x' as path").coalesce(2)


def test_failures_stay_with_their_frames(spark):
    rows = guarded(model({3, 11}), SCHEMA, together=8)(frames(spark))
    good, faults = answers_and_faults(rows)
    assert sorted((r.frame_id, r.x1, r.score) for r in good.collect()) == sorted((i, i, 0.5) for i in range(20) if i not in (3, 11) for _ in range(2))
    assert sorted((r.frame_id, r.error) for r in faults.collect()) == [(3, "MemoryError: frame 3"), (11, "MemoryError: frame 11")]
    assert guarded(model(set()), SCHEMA)(frames(spark, 0)).count() == 0


def test_wrong_columns_are_failures(spark):
    wrong = lambda rows: rows
    assert {r.error for r in guarded(wrong, SCHEMA)(frames(spark, 3)).collect()} == {"ValueError: the model returns ['frame_id', 'path'], not ['frame_id', 'x1', 'score']"}
    with pytest.raises(ValueError):
        guarded(wrong, "x1 int")


def test_strict_ends_the_query(spark):
    with pytest.raises(Exception, match="frame 3"):
        guarded(model({3}), SCHEMA, strict=True)(frames(spark)).collect()
    assert guarded(model(set()), SCHEMA, strict=True)(frames(spark)).where("error is null").count() == 40


def test_ensemble_loses_only_what_failed(spark):
    members = {"a": guarded(model({1, 2}, False), SCHEMA), "b": guarded(model({2, 4}, False), SCHEMA)}
    rows = ensemble(frames(spark, 6), members)
    good, _ = answers_and_faults(rows)
    assert sorted((r.frame_id, r.detector, r.detector_ord) for r in good.collect()) == [(0, "a", 1), (0, "b", 2), (1, "b", 2), (3, "a", 1), (3, "b", 2), (4, "a", 1), (5, "a", 1), (5, "b", 2)]
    assert [(r.frame_id, r.errors) for r in lost_frames(rows, 2).collect()] == [(2, ["a: MemoryError: frame 2", "b: MemoryError: frame 2"])]
