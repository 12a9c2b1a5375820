import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import frames, state

FRAME = "camera_id long, frame_id long, x1 int, y1 int, x2 int, y2 int, detected string, seconds double"


def table(spark, rows):
    df = spark.createDataFrame(rows, FRAME)
    box = F.when(F.col("x1").isNotNull(), F.struct("x1", "y1", "x2", "y2"))
    return df.withColumn("coarse", box).repartition(3)


def cameras(kind, n, seed=0):
    rng, rows = random.Random(seed), []
    for c, count in ((1, n), (2, 7), (None, 12), (3, n // 2)):
        x = 0
        for i in range(count):
            x = {"still": 0, "drift": x + 1, "jumpy": rng.choice([0, 0, 0, 300]), "rare": x + (rng.random() < 0.02) * 50}[kind]
            null, lost = rng.random() < 0.03 and kind != "still", rng.random() < 0.1
            at = (None,) * 4 if null else (x, 0, x + 100 + rng.randrange(2), 100)
            rows.append((c, i, *at, None if lost else f"{c}-{i}", rng.choice([None, 0.3, 1.0, 2.0, 3.0, 9.0])))
    rng.shuffle(rows)
    return rows


def plain(rows, threshold):
    out, cache = {}, {}
    for c, i, *box, found, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        box = None if box[0] is None else box
        held = cache.get(c)
        same = False
        if held and held[0] and box:
            a, b = held[0], box
            shared = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
            union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
            same = union > 0 and shared / union >= threshold
        if same:
            out[c, i] = True, held[1]
            continue
        if found is not None:
            cache[c] = (box, found)
        out[c, i] = False, found
    return out


@pytest.mark.parametrize("kind,rounds", [("still", 5), ("drift", 1), ("jumpy", 5), ("rare", 5), ("rare", 0)])
def test_corner_cache_of_long_cameras(spark, monkeypatch, kind, rounds):
    monkeypatch.setattr(state, "ROUNDS", rounds)
    rows = cameras(kind, 400)
    got = frames.with_corner_cache(table(spark, rows), 0.9, long=True).collect()
    assert {(r.camera_id, r.frame_id): (r.reused, r.used) for r in got} == plain(rows, 0.9) and len(got) == len(rows)


def test_long_cameras_are_told_by_their_rows(spark, monkeypatch):
    """The same rows by one task a camera and by blocks; which way is taken follows the longest camera."""
    rows = cameras("jumpy", 60)
    taken = []
    monkeypatch.setattr(state, "in_blocks", lambda df, by, order, real=state.in_blocks: (taken.append(1), real(df, by, order))[1])
    for most, blocks in ((60, 0), (59, 1)):
        monkeypatch.setattr(state, "LONG", most)
        got = frames.with_corner_cache(table(spark, rows), 0.9).collect()
        assert {(r.camera_id, r.frame_id): (r.reused, r.used) for r in got} == plain(rows, 0.9) and len(taken) == blocks


def test_dynamic_box_is_cached_with_the_corners(spark):
    rows = cameras("rare", 60)
    df = table(spark, rows).withColumn("dynamic", F.concat(F.lit("box "), "detected"))
    got = frames.with_corner_cache(df, 0.9, long=True).collect()
    want = plain(rows, 0.9)
    assert {(r.camera_id, r.frame_id): (r.reused, r.used) for r in got} == want
    assert all(r.used_dynamic == (None if r.used is None else f"box {r.used}") for r in got)


@pytest.mark.parametrize("start", [1280, 2000])
def test_resolution_of_long_cameras(spark, start):
    rows = cameras("still", 500, 3)
    want = {}
    dims = {}
    for c, i, *_, seconds in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        d = dims.get(c, start)
        if seconds is not None and (seconds > 2.5 or seconds < 1.25):
            d = max(320, min(1600, int(d * (0.85 if seconds > 2.5 else 1.1))))
        dims[c] = want[c, i] = d
    got = frames.with_resolution(table(spark, rows), 2.5, start, long=True).collect()
    assert {(r.camera_id, r.frame_id): r.dim for r in got} == want and len(got) == len(rows)


def test_empty(spark):
    none = table(spark, [])
    assert frames.with_corner_cache(none, long=True).count() == 0 and frames.with_resolution(none, long=True).count() == 0
