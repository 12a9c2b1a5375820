import pytest

from pagewright.operators import detectors, frames, state, words

BOX = "frame_id int, word_id int, x1 int, y1 int, x2 int, y2 int"


def test_union_keeps_an_order_and_tolerates_failures(spark):
    a = spark.createDataFrame([(1, 1, 0, 0, 9, 9)], BOX)
    b = spark.createDataFrame([(1, 1, 5, 5, 9, 9), (2, 1, 0, 0, 1, 1)], BOX)
    got, failed = detectors.tolerant_union({"one": lambda: a, "broken": lambda: a.select("nothing"), "two": lambda: b})
    assert list(failed) == ["broken"]
    assert sorted((r.detector_ord, r.detector, r.frame_id) for r in got.collect()) == [(1, "one", 1), (2, "two", 1), (2, "two", 2)]
    with pytest.raises(Exception, match="nothing"):
        detectors.tolerant_union({"broken": lambda: a.select("nothing"), "two": lambda: b}, strict=True)
    with pytest.raises(RuntimeError):
        detectors.tolerant_union({"broken": lambda: a.select("nothing")})


def test_faults_of_a_frame_leave_others(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, None, "out of memory"), (2, None, "out of memory")], "frame_id int, text string, error string")
    good, faults = detectors.answers_and_faults(rows)
    assert [tuple(r) for r in good.collect()] == [(1, "x")] and [tuple(r) for r in faults.collect()] == [(2, "out of memory")]


def test_no_server_is_healthy(spark):
    servers = spark.createDataFrame([("u", "m", None, None, False)], "url string, model string, device string, num_replicas int, healthy boolean")
    assert tuple(detectors.fleet(servers).first()) == (0, 0, "")


def test_words_in_order(spark):
    got = words.restored(spark.createDataFrame([(2, 1), (1, 2), (1, 1)], "frame_id int, word_id int")).collect()
    assert [tuple(r) for r in got] == [(1, 1), (1, 2), (2, 1)]


@pytest.mark.parametrize("rows", [1, 3, 10_000])
def test_state_over_batches(spark, rows):
    """The corner cache in plain loops, for cameras with null boxes and corners, a null camera and one with a long run of hits; batches of a few rows."""
    import random

    rng, data = random.Random(rows), []
    for camera in (1, 2, 3, None):
        for i in range(120):
            box = None if rng.random() < 0.1 else (x := rng.choice((0, 1, 2, 60)) if camera != 2 else 0, 0, x + 100, 100)
            data.append((camera, i, box, None if rng.random() < 0.3 else f"c{i}"))
    shuffled = rng.sample(data, len(data))
    df = spark.createDataFrame(shuffled, "camera_id long, frame_id long, coarse struct<x1:int,y1:int,x2:int,y2:int>, detected string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = {(r.camera_id, r.frame_id): (r.reused, r.used) for r in frames.with_corner_cache(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

    def iou(a, b):
        shared = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return shared / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared)

    for camera in (1, 2, 3, None):
        box = corners = None
        for c, i, coarse, detected in sorted((r for r in data if r[0] == camera), key=lambda r: r[1]):
            hit = corners is not None and coarse is not None and box is not None and iou(coarse, box) >= 0.97
            assert got[c, i] == (hit, corners if hit else detected)
            if not hit and detected is not None:
                box, corners = coarse, detected
    assert state.resolutions(2.5, 1280)
