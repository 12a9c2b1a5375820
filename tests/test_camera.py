import os
import time

import pytest

from pagewright.sources import camera
from tests import capture


@pytest.fixture
def options(tmp_path):
    return {"capture": "tests.capture:three", "cameras": "0,7", "spool": (tmp_path / "spool").as_uri(), "wait": "1"}


def read(reader, start, end):
    return [tuple(r.values()) for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]


def test_latest_frame_of_each_camera_once(options):
    reader = camera.CameraReader(options)
    camera._open.clear()
    for c in (0, 7):
        camera._open["tests.capture:three", c] = camera.Latest(capture.three(c))
        camera._given["tests.capture:three", c] = 0
        camera._open["tests.capture:three", c].join()
    start, end = reader.initialOffset(), reader.latestOffset()
    rows = read(reader, start, end)
    assert sorted((r[0], r[2], r[-1]) for r in rows) == [(0, 3.0, bytes([0, 3] * 3)), (7, 3.0, bytes([7, 3] * 3))] and {r[1] for r in rows} == {end["tick"]}
    assert read(camera.CameraReader(options), start, end) == rows  # another process, or a task that runs again
    reader.commit(end)
    assert os.listdir(options["spool"].removeprefix("file://")) == []
    assert reader.latestOffset()["tick"] > end["tick"] and reader.partitions(end, end) == []
    assert camera.CameraSource.name() == "camera" and camera.Latest(capture.three(1)).join() is None
    with pytest.raises(ValueError):
        camera.CameraReader({"capture": "tests.capture:three"})


def test_idle_cameras_end():
    one = camera.Latest(capture.endless(1), idle=0.2)
    assert one.get(0, 2)[0] >= 1
    one.join()
    assert not one.running()


def run(spark, options, checkpoint, out, batches):
    stream = spark.readStream.format("camera").options(**options).load()
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="300 milliseconds").start()
    until = time.time() + 90
    while time.time() < until and query.exception() is None and len([p for p in query.recentProgress if p.numInputRows]) < batches:
        time.sleep(0.1)
    query.stop()
    assert query.exception() is None
    return spark.read.parquet(out).drop("data").collect()


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """Frames come in order and once, also those of a batch whose commit was lost."""
    spark.dataSource.register(camera.CameraSource)
    options = {"capture": "tests.capture:endless", "cameras": "1,2,9", "spool": (tmp_path / "spool").as_uri(), "wait": "0.5"}
    checkpoint, out = str(tmp_path / "state"), str(tmp_path / "out")
    first = run(spark, options, checkpoint, out, 2)
    assert {r.camera_id for r in first} == {1, 2}
    commits = [int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit()]
    for name in (str(max(commits)), f".{max(commits)}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")
    second = run(spark, options, checkpoint, out, 2)
    assert len(second) > len(first) and len({(r.camera_id, r.frame_id) for r in second}) == len(second)
    before = {r.camera_id: max(f.frame_id for f in first if f.camera_id == r.camera_id) for r in first}
    assert all(r.frame_id > before[r.camera_id] for r in second if r not in first)
    for c in (1, 2):
        mine = sorted((r.frame_id, r.ts) for r in second if r.camera_id == c)
        assert mine == sorted(mine, key=lambda x: x[1])
