from pyspark.sql import functions as F

from pagewright.plans.document import Providers, process


def test_whole_plan(spark):
    frames = spark.createDataFrame([(i, 640, 480) for i in range(1, 5)], "frame_id int, width int, height int")
    found = spark.createDataFrame(
        [(1, 0, "laptop", 0.9, 0, 0, 400, 300), (2, 0, "laptop", 0.8, 0, 0, 400, 300), (2, 1, "person", 0.9, 10, 10, 200, 200), (3, 0, "person", 0.9, 0, 0, 9, 9), (4, 0, "tvmonitor", 0.4, 0, 0, 400, 300)],
        "frame_id int, det_ord int, label string, score double, x1 int, y1 int, x2 int, y2 int",
    )
    boxes = spark.createDataFrame([(1, 1, 1, 0.9, 10, 10, 60, 30), (1, 1, 2, 0.8, 200, 10, 260, 30), (1, 1, 3, 0.1, 10, 10, 60, 30)], "frame_id int, detector_ord int, word_id int, score double, x1 int, y1 int, x2 int, y2 int")
    read = lambda c: c.select("frame_id", "word_id", F.concat(F.lit("w"), "x1").alias("text"), F.lit(0.5).alias("conf"))
    use = Providers(
        detections=lambda f: f.select("frame_id").join(found, "frame_id"),
        corners=lambda f: f.select("*", F.lit(None).cast("array<struct<x:double,y:double>>").alias("model"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("contour"), F.lit(0.0).alias("contour_area")),
        boxes=lambda f: f.select("frame_id").join(boxes, "frame_id"),
        read=read,
        second=lambda c: c.where("x1 < 100").select("frame_id", "word_id", F.lit("better").alias("text"), F.lit(1.0).alias("conf")),
    )
    lines, status = process(frames, use)
    assert [(r.frame_id, r.line_id, r.text) for r in lines.orderBy("line_id").collect()] == [(1, 1, "better"), (1, 2, "w200")]
    assert {r.frame_id: r.status for r in status.collect()} == {1: "ok", 2: "obstructed", 3: "no_corners", 4: "no_text"}


def test_stage_tables_and_metrics(spark, tmp_path):
    from pagewright.plans.document import measured

    calls = []
    frames = spark.createDataFrame([(1, 640, 480)], "frame_id int, width int, height int")
    found = spark.createDataFrame([(1, 0, "laptop", 0.9, 0, 0, 400, 300)], "frame_id int, det_ord int, label string, score double, x1 int, y1 int, x2 int, y2 int")
    boxes = spark.createDataFrame([(1, 1, 1, 0.9, 10, 10, 60, 30)], "frame_id int, detector_ord int, word_id int, score double, x1 int, y1 int, x2 int, y2 int")
    none = F.lit(None).cast("array<struct<x:double,y:double>>")

    def read(crops):
        calls.append("read")
        return crops.select("frame_id", "word_id", F.lit("w").alias("text"), F.lit(0.5).alias("conf"))

    use = Providers(detections=lambda f: found, corners=lambda f: f.select("*", none.alias("model"), none.alias("contour"), F.lit(0.0).alias("contour_area")), boxes=lambda f: boxes, read=read)
    lines, status = process(frames, use, stages=str(tmp_path))
    assert lines.count() == 1 and status.first().status == "ok" and calls == ["read"]
    assert {p.name for p in tmp_path.iterdir()} == {"detections", "corners", "boxes", "readings", "words", "lines"}
    seen, metrics = measured(lines, "lines")
    seen.collect()
    assert metrics.get == {"rows": 1, "frames": 1}
