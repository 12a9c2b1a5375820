import time

import pytest

from pagewright.plans.metrics import StreamMetrics, observed
from pagewright.streaming import camera


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield camera.ready(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def ran(frames, name, tmp_path, **options):
    query = frames.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


FRAMES = [(1, 1, 0, 0, 100, 100, "a"), (1, 2, 0, 0, 100, 100, "b"), (2, 3, None, None, None, None, "c"), (1, 4, 50, 0, 150, 100, None), (2, 5, None, None, None, None, "e"), (1, 6, 1, 0, 101, 100, "f")]


def test_cached_corners_over_batches(store, tmp_path):
    rows = [(*r, None if r[-1] is None else f"box {r[-1]}") for r in FRAMES]
    for i in (0, 3):
        store.createDataFrame(rows[i : i + 3][::-1], camera.FRAME).coalesce(1).write.mode("append").json(str(tmp_path / "in"), ignoreNullFields=False)
    stream = store.readStream.schema(camera.FRAME).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    ran(camera.cached_corners(stream), "corners", tmp_path)
    got = {(r.frame_id, r.reused, r.used, r.used_dynamic) for r in store.table("corners").collect()}
    want = {(1, False, "a"), (2, True, "a"), (3, False, "c"), (4, False, None), (5, False, "e"), (6, True, "a")}
    assert got == {(*w, None if w[-1] is None else f"box {w[-1]}") for w in want}


SECONDS = "camera_id long, frame_id long, seconds double"


def arrive(spark, tmp_path, rows):
    spark.createDataFrame(rows, SECONDS).coalesce(1).write.mode("append").json(str(tmp_path / "in"), ignoreNullFields=False)


def dims(spark, tmp_path, want, expiry_ms=None, **trigger):
    """The rows so far, once there are `want` of them."""
    frames = camera.adapted_resolution(spark.readStream.schema(SECONDS).json(str(tmp_path / "in")), expiry_ms=expiry_ms)
    query = frames.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(**(trigger or {"availableNow": True})).start()
    until, rows = time.time() + 60, []
    while len(rows) < want and time.time() < until and query.exception() is None:
        query.awaitTermination(1)
        rows = spark.read.schema("camera_id long, frame_id long, dim int").parquet(str(tmp_path / "out")).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
    query.stop()
    assert query.exception() is None
    return {(r.frame_id, r.dim) for r in rows}


def test_state_goes_on_after_a_restart(store, tmp_path):
    arrive(store, tmp_path, [(1, 1, 3.0), (1, 2, 3.0)])
    assert dims(store, tmp_path, 2) == {(1, 1088), (2, 924)}
    arrive(store, tmp_path, [(1, 3, 3.0)])
    assert dims(store, tmp_path, 3) == {(1, 1088), (2, 924), (3, 785)}


def test_state_expires(store, tmp_path):
    arrive(store, tmp_path, [(1, 1, 3.0), (1, 2, 3.0)])
    assert dims(store, tmp_path, 2, 1, processingTime="1 second") == {(1, 1088), (2, 924)}
    time.sleep(0.1)
    arrive(store, tmp_path, [(1, 3, 3.0)])
    assert dims(store, tmp_path, 3, 1, processingTime="1 second") == {(1, 1088), (2, 924), (3, 1088)}


def test_metrics_of_micro_batches(spark, tmp_path):
    listener = StreamMetrics()
    spark.streams.addListener(listener)
    try:
        spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "frame_id long, text string").write.json(str(tmp_path / "in"))
        stream = observed(spark.readStream.schema("frame_id long, text string").json(str(tmp_path / "in")), "words")
        ran(stream, "seen", tmp_path)
        until = time.time() + 20
        while not listener.append(spark, str(tmp_path / "metrics")) and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    row = spark.read.parquet(str(tmp_path / "metrics")).first()
    assert (row.batch, row.stage, row.rows, row.frames) == (0, "words", 3, 2) and row.seconds >= 0 and listener.taken() == []


def test_latest_frame_of_each_camera(spark, tmp_path):
    rows = [(1, 1, "t1"), (1, 2, "t2"), (2, 3, "t1")]
    spark.createDataFrame(rows, "camera_id int, frame_id int, ts string").write.json(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("camera_id int, frame_id int, ts string").json(str(tmp_path / "in"))
    query = camera.on_latest(stream, lambda df, epoch: seen.extend(r.frame_id for r in df.collect()))
    query.awaitTermination(120)
    assert sorted(seen) == [2, 3]


def test_resolution_over_batches(store, tmp_path):
    rows = [(1, 1, 3.0), (1, 2, 3.0), (2, 3, 0.5), (1, 4, 2.0), (2, 5, 0.5), (1, 6, None)]
    schema = "camera_id long, frame_id long, seconds double"
    for i in (0, 3):
        store.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"), ignoreNullFields=False)
    stream = store.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = camera.adapted_resolution(stream).writeStream.format("memory").queryName("dims").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.frame_id, r.dim) for r in store.table("dims").collect()} == {(1, 1088), (2, 924), (3, 1408), (4, 924), (5, 1548), (6, 924)}
