import numpy as np
from pyspark.sql import functions as F

from pagewright.functions import pixels


def test_dark_crops_are_inverted(spark):
    dark, light = bytes([10, 20, 30] * 4), bytes([200, 210, 220] * 4)
    rows = spark.createDataFrame([(1, dark), (2, light), (3, None), (4, b"")], "frame_id int, data binary")
    got = {r.frame_id: (r.mean, r.ground) for r in rows.select("frame_id", pixels.gray_mean("data").alias("mean"), pixels.light_ground("data").alias("ground")).collect()}
    assert got[1] == (18.0, bytes([245, 235, 225] * 4))
    assert got[2] == (208.0, light) and got[3] == (None, None)
    assert {r.frame_id for r in pixels.non_empty(rows).collect()} == {1, 2}


def test_flattening(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (20, 30, 3)).astype(np.uint8)
    same = pixels.flattened(image, np.array([(0, 0), (30, 0), (30, 20), (0, 20)]), 30, 20, rows=7)
    assert (same == image).all()
    turned = pixels.flattened(image, np.array([(0, 20), (0, 0), (30, 0), (30, 20)]), 20, 30)
    assert (turned[:, 1:] == image[::-1].transpose(1, 0, 2)[:, :-1]).all()  # a quarter turn; rows 20 is beyond the image
    half = pixels.flattened(image, np.array([(0, 0), (29, 0), (29, 19), (0, 19)]), 58, 38)
    assert (half[::2, ::2] == image[:19, :29]).all()
    assert (half[0, 1] == np.rint((image[0, 0].astype(float) + image[0, 1]) / 2)).all()


def test_rectified_frames(spark):
    point = "array<struct<x:double,y:double>>"
    rows = spark.createDataFrame([(1, 2, 2, bytes(range(12)), [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], 2, 2), (2, 2, 2, bytes(12), None, 2, 2)], f"frame_id long, width int, height int, data binary, corners {point}, w int, h int")
    got = pixels.rectified(rows).collect()
    assert [(r.frame_id, r.width, r.height, bytes(r.data)) for r in got] == [(1, 2, 2, bytes(range(12)))]
    assert pixels.rectified(rows).select(F.octet_length("data")).first()[0] == 12


def test_pixels_are_handed_on_in_small_batches(spark):
    """1,000 papers of 63 KB in one batch of rows never stand in memory at once (F1, F2)."""
    import pyarrow as pa

    from pagewright import fixtures

    columns = tuple(pa.array([v] * 1000, pa.int32()) for v in (150, 140, 20, 15, 120, 100))
    batches = list(fixtures._papers.func(iter([columns])))
    assert sum(len(b) for b in batches) == 1000 and max(b.nbytes for b in batches) < 2 * pixels.BATCH_BYTES
    assert [len(b) for b in pixels.in_batches([None, b"", b"ab"])] == [3] and not list(pixels.in_batches([]))


def test_frames_with_pixels_go_to_tasks_by_their_number(spark, monkeypatch):
    """a file of small rows was one task, whatever its length."""
    from pagewright import fixtures
    from pagewright.pixel_queries import rectified_pixels_p9
    from tests.oracle import DATA

    monkeypatch.setattr(fixtures, "EACH_PICTURES", 20)
    assert rectified_pixels_p9(spark, DATA).rdd.getNumPartitions() == -(-fixtures.rows_of(spark, DATA, "customer") // 20)
