import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import pixels, raster
from pagewright.operators import pictures
from pagewright.plans.document import Providers, outlined, process
from pagewright.plans.metrics import Metrics

FRAME = "frame_id long, width int, height int, data binary"
CROP = "frame_id int, word_id int, cx1 int, cy1 int, cx2 int, cy2 int, out_w int, out_h int, width string"


def frames(spark, images):
    return spark.createDataFrame([(i, *(m.shape[1::-1] if m is not None else (0, 0)), None if m is None else m.tobytes()) for i, m in images], FRAME)


def noise(w, h, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)


def unpng(data):
    """The pixels of a PNG without filters."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    w, h = int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    at, body = 8, b""
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        assert zlib.crc32(data[at + 4 : at + 8 + n]) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        body += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 3 * w + 1)
    return lines[:, 1:].reshape(h, w, 3)


def test_crops_are_cut_from_their_frames(spark):
    one, two = noise(40, 30), noise(20, 90, 1)
    rows = [(1, 1, 3, 4, 23, 14, 20, 10, "x"), (1, 2, 0, 0, 40, 30, 20, 15, "y"), (2, 1, 0, 0, 20, 90, 14, 64, "x"), (3, 1, 0, 0, 5, 5, 5, 5, None), (4, 7, 0, 0, 5, 5, 5, 5, None), (1, 3, 50, 50, 60, 60, 10, 10, "z")]
    got = pictures.cut(frames(spark, [(1, one), (2, two), (3, None), (9, one)]), spark.createDataFrame(rows, CROP))
    assert got.columns == [c.split()[0] for c in CROP.split(", ")] + ["data"]
    data = {(r.frame_id, r.word_id, r.width): r.data for r in got.collect()}
    assert bytes(data[1, 1, "x"]) == one[4:14, 3:23].tobytes()
    assert bytes(data[1, 2, "y"]) == raster.resized(one, 20, 15, "bins").tobytes()
    assert bytes(data[2, 1, "x"]) == raster.resized(two, 14, 64, "bins").tobytes()
    assert data[3, 1, None] is None and data[4, 7, None] is None and bytes(data[1, 3, "z"]) == b""
    assert pictures.cut(frames(spark, [(1, one)]), spark.createDataFrame([], CROP)).count() == 0


def test_small_crops_are_upscaled_and_packed(spark):
    small, wide = noise(10, 8), noise(60, 40)
    rows = spark.createDataFrame([(1, 10, 8, small.tobytes()), (2, 60, 40, wide.tobytes()), (3, 4, 4, None)], "word_id int, out_w int, out_h int, data binary")
    got = {r.word_id: r for r in pictures.wired(rows).collect()}
    assert set(got) == {1, 2} and (got[1].out_w, got[1].out_h) == (40, 32)
    assert bytes(got[2].data) == b"".join(n.to_bytes(4, "big") for n in (40, 60, 3)) + wide[:, :, ::-1].tobytes()
    assert bytes(got[1].data)[12:] == raster.resized(small, 40, 32, "lanczos")[:, :, ::-1].tobytes()


def test_columns_of_pixels(spark):
    one = noise(33, 21)
    df = frames(spark, [(1, one), (2, None)]).withColumn("other", F.lit(1))
    row = {r.frame_id: r for r in df.select("frame_id", pixels.resized("data", "width", "height", F.lit(7), F.lit(5), "cubic").alias("small"), pixels.enhanced("data").alias("better"), pixels.swapped("data").alias("bgr")).collect()}
    assert bytes(row[1].small) == raster.resized(one, 7, 5, "cubic").tobytes()
    assert bytes(row[1].better) == raster.enhanced(one).tobytes()
    assert bytes(row[1].bgr) == one[:, :, ::-1].tobytes()
    assert row[2].small is None and row[2].better is None and row[2].bgr is None


def page(w=160, h=120, low=(40, 30), high=(120, 90)):
    image = np.full((h, w, 3), 30, np.uint8)
    image[low[1] : high[1], low[0] : high[0]] = 220
    return image


def test_outline_in_the_frame_and_in_a_coarse_box(spark):
    df = frames(spark, [(1, page()), (2, np.full((20, 20, 3), 9, np.uint8)), (3, None), (4, page(320, 240, (200, 140), (280, 220)))])
    none = "cast(null as struct<x1:int,y1:int,x2:int,y2:int>)"
    boxed = df.withColumn("coarse", F.when(F.col("frame_id") == 4, F.struct(*[F.lit(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), (180, 120, 300, 236))])).otherwise(F.expr(none)))
    got = {r.frame_id: r for r in pixels.outline(boxed, 100).collect()}
    for frame, (low, high) in {1: ((40, 30), (120, 90)), 4: ((200, 140), (280, 220))}.items():
        xs, ys = [p.x for p in got[frame].contour], [p.y for p in got[frame].contour]
        assert min(xs) == pytest.approx(low[0], abs=9) and max(xs) == pytest.approx(high[0], abs=9) and min(ys) == pytest.approx(low[1], abs=9) and max(ys) == pytest.approx(high[1], abs=9)
    assert got[2].contour is None and got[2].contour_area == 0 and got[3].contour is None and got[3].contour_area is None
    assert got[4].contour_area > 0.12 * 320 * 240 > 80 * 80 / 2


def test_drawing_and_files(spark, tmp_path):
    from pagewright.sources.images import write_files

    plain = np.zeros((40, 60, 3), np.uint8)
    df = frames(spark, [(1, plain), (2, plain), (3, None)])
    boxes = spark.createDataFrame([(1, 7, 20, 20, 50, 35), (1, 10, -5, 2, 70, 90), (3, 1, 0, 0, 3, 3)], "frame_id int, word_id int, x1 int, y1 int, x2 int, y2 int")
    drawn = pictures.with_boxes(df, boxes)
    got = {r.frame_id: pixels.image(r.data, r.width, r.height) for r in drawn.collect()}
    assert set(got) == {1}
    assert (got[1][20, 20:51] == (0, 255, 0)).all() and (got[1][20:36, 50] == (0, 255, 0)).all() and (got[1][2, 30:] == (0, 255, 0)).all() and not got[1][28, 30].any()
    assert (got[1][5:15, 20:26] == (255, 0, 0)).all(axis=2).any()
    write_files(pictures.png_files(drawn, "boxes"), str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["boxes-1.png"]
    assert (unpng((tmp_path / "out" / "boxes-1.png").read_bytes()) == got[1]).all()
    read = spark.read.format("image").load(str(tmp_path / "out")).select("image.*").first()
    assert (read.width, read.height) == (60, 40)


def test_whole_plan_with_pixels(spark, tmp_path):
    dark = np.full((120, 160, 3), 9, np.uint8)
    df = frames(spark, [(1, page()), (2, page()), (3, dark)])
    seen = []
    found = spark.createDataFrame([(2, 0, "person", 0.9, 50, 40, 100, 80)], "frame_id long, det_ord int, label string, score double, x1 int, y1 int, x2 int, y2 int")

    def boxes(pages):
        seen.extend((r.frame_id, r.width, r.height, len(r.data)) for r in pages.collect())
        at = [F.lit(v).alias(c) for c, v in (("detector_ord", 1), ("word_id", 1), ("score", 0.9), ("x1", 10), ("y1", 10), ("x2", 90), ("y2", 40))]
        return pages.select("frame_id", *at)

    def read(crops):
        light = F.when(pixels.gray_mean("data") > 115, "light").otherwise("dark")
        return crops.select("frame_id", "word_id", light.alias("text"), F.lit(1.0).alias("conf"))

    metrics = Metrics("one")
    use = Providers(detections=lambda f: found, corners=outlined, boxes=lambda f: boxes(f).withColumn("error", F.lit(None).cast("string")), read=read)
    lines, status = process(df, use, stages=str(tmp_path), metrics=metrics, page=200, draw=True)
    assert {r.frame_id: r.status for r in status.collect()} == {1: "ok", 2: "obstructed", 3: "no_corners"}
    assert [(r.frame_id, r.text) for r in lines.collect()] == [(1, "light")]
    (frame, w, h, size), = seen
    assert frame == 1 and max(w, h) == 200 and size == w * h * 3
    assert {p.name for p in tmp_path.iterdir()} == {"detections", "corners", "pages", "boxes", "crops", "readings", "words", "lines", "pictures", "faults"}
    assert {p.name for p in (tmp_path / "pictures").iterdir()} == {"corners-1.png", "corners-2.png", "corners-3.png", "boxes-1.png", "lines-1.png"}
    table = {r.stage: (r.run, r.rows, r.frames) for r in metrics.table(spark).collect()}
    assert table["corners"] == ("one", 3, 3) and table["pages"] == ("one", 1, 1) and table["detections"] == ("one", 1, 1) and metrics.seconds() > 0
    rate = metrics.throughput(df).first()
    assert rate.frames == 3 and rate.frames_per_second == pytest.approx(3 / metrics.seconds())


def test_failing_models_cost_their_frames_alone(spark, tmp_path):
    """A detector that fails for one frame, a reader that fails for one crop."""
    from pagewright.operators.guarded import guarded

    def boxes(rows):
        if 2 in rows.column("frame_id").to_pylist():
            raise RuntimeError("out of memory")
        ids, n = rows.column("frame_id").to_pylist(), rows.num_rows
        import pyarrow as pa

        values = {"frame_id": [i for i in ids for _ in (0, 1)], "detector_ord": [1] * 2 * n, "word_id": [1, 2] * n, "score": [0.9] * 2 * n, "x1": [10, 150] * n, "y1": [10, 10] * n, "x2": [60, 190] * n, "y2": [40, 40] * n}
        return pa.RecordBatch.from_pydict(values)

    found = spark.createDataFrame([], "frame_id long, det_ord int, label string, score double, x1 int, y1 int, x2 int, y2 int")
    fails = (F.col("frame_id") == 3) & (F.col("x1") > 50)
    use = Providers(
        detections=lambda f: found, corners=outlined, boxes=guarded(boxes, "frame_id long, detector_ord int, word_id int, score double, x1 int, y1 int, x2 int, y2 int"),
        read=lambda c: c.select("frame_id", "word_id", F.when(~fails, "w").alias("text"), F.lit(1.0).alias("conf"), F.when(fails, "no answer").alias("error")),
    )
    lines, status = process(frames(spark, [(i, page()) for i in (1, 2, 3)]), use, stages=str(tmp_path), page=200)
    assert sorted((r.frame_id, r.text) for r in lines.collect()) == [(1, "w"), (1, "w"), (3, "w")]
    assert {r.frame_id: r.status for r in status.collect()} == {1: "ok", 2: "no_text", 3: "ok"}
    faults = spark.read.parquet(str(tmp_path / "faults"))
    assert sorted(map(tuple, faults.collect())) == [("boxes", 2, "RuntimeError: out of memory"), ("readings", 3, "no answer")]


def test_frames_meet_their_crops_in_batches(spark):
    """F16: a frame was a group of its own in Python. Repeated and null numbers, and many frames, as before."""
    rng = np.random.default_rng(4)
    images = [(i, rng.integers(0, 256, (70, 20, 3)).astype(np.uint8)) for i in range(60)] + [(None, np.full((70, 20, 3), 5, np.uint8)), (60, None)]
    crops = [(i, k, k, 2, 15 + k, 70, 14, 64, "x") for i, _ in images for k in (1, 2)] + [(77, 1, 0, 0, 5, 5, 5, 5, "x")]
    got = pictures.cut(frames(spark, images + [(60, None), (3, images[3][1])]), spark.createDataFrame(crops, CROP))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in plan and "MapInArrow" in plan
    found = {(r.frame_id, r.word_id): r.data for r in got.collect()}
    assert got.count() == len(crops) == len(found)
    whole = dict(images)
    for i, k, *_ in crops:
        want = None if whole.get(i) is None else raster.resized(whole[i][2:70, k : 15 + k], 14, 64, "bins").tobytes()
        assert (found[i, k] if found[i, k] is None else bytes(found[i, k])) == want


def test_pixels_of_crops_are_made_once_in_dealt_tasks(spark):
    """F16: not in the tasks of the file too, before its rows are dealt."""
    from pagewright.pixel_queries import crop_pixels_p12
    from tests.oracle import DATA

    plan = crop_pixels_p12(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # of the frames, and of those without a number


def test_pixels_meet_their_rows_without_broadcast(spark, monkeypatch):
    """Spark took pixels for a few bytes a frame and sent all of them through the driver. They are shuffled once, rows dealt to other tasks follow them."""
    from pagewright import fixtures
    from pagewright.pixel_queries import crop_pixels_p12
    from tests.oracle import DATA

    monkeypatch.setattr(fixtures, "EACH_PICTURES", 20)
    cut = crop_pixels_p12(spark, DATA)
    first = cut._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_frame" in first and first.count("Exchange hashpartitioning(_id#") == 2  # of the frames, and of those without a number
    one = fixtures.with_pixels(spark, DATA, "pictures")
    boxes = one.select("frame_id", *[F.lit(v).alias(c) for c, v in (("word_id", 1), ("x1", 2), ("y1", 2), ("x2", 9), ("y2", 9))])
    corners = one.select("frame_id", F.expr("array(struct(1.0d as x, 1.0d as y))").alias("corners"))
    for made, rows in ((cut, 2), (pictures.with_boxes(one, boxes), 1), (pictures.with_corners(one, corners), 1)):
        assert len(made.collect()) == rows * fixtures.rows_of(spark, DATA, "customer")
        last = made._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in last and "BroadcastHashJoin" not in last
