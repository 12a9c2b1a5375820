"""Random frames against plain loops."""

import random

import pytest

from pagewright.operators import boxes, frames, layout


def make(seed, n_frames=12, tall=False):
    rng = random.Random(seed)
    rows = []
    for f in range(n_frames):
        for w in range(1, rng.randint(1, 26)):
            x, y = rng.randint(0, 500), rng.choice((0, 10, 20, 22, 50, 90)) + rng.randint(0, 6)
            h = rng.choice((25, 50, 75, 100)) if tall else rng.randint(6, 30)
            rows.append((f, w, x, y, x + rng.choice((1, 2, 3, 20, 60, 120)), y + h, rng.choice((None, 0.2, 0.5, 0.5, 0.9)), f"t{w}"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "frame_id int, word_id int, x1 int, y1 int, x2 int, y2 int, score double, text string")


def reading_order(rows, gap, ratio):
    """Bands of one frame in reading order: lists of rows from left to right."""
    out, reach, column, columns = [], None, [], []
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        if reach is not None and r[2] > reach + gap:
            columns.append(column)
            column, reach = [], None
        column.append(r)
        reach = r[4] if reach is None else max(reach, r[4])
    for c in [*columns, column]:
        last = None
        for r in sorted(c, key=lambda r: ((r[3] + r[5]) / 2, r[2], r[1])):
            if last is None or not abs((r[3] + r[5]) / 2 - (last[3] + last[5]) / 2) < max(1, last[5] - last[3]) * ratio:
                out.append([])
            out[-1].append(r)
            last = r
    return [sorted(b, key=lambda r: (r[2], (r[3] + r[5]) / 2, r[1])) for b in out]


def by_frame(rows):
    return {f: [r for r in rows if r[0] == f] for f in {r[0] for r in rows}}


@pytest.mark.parametrize("seed,tall", [(1, False), (2, True), (3, True)])
def test_lines(spark, seed, tall):
    rows = make(seed, tall=tall)
    want = set()
    for f, mine in by_frame(rows).items():
        n = 0
        for band in reading_order(mine, 35, 0.28):
            line = []
            for r in band:
                if line and r[2] - line[-1][4] > 2.0 * sum(max(1, x[5] - x[3]) for x in line) / len(line):
                    n += 1
                    want.add((f, n, " ".join(x[7] for x in line), len(line)))
                    line = []
                line.append(r)
            n += 1
            want.add((f, n, " ".join(x[7] for x in line), len(line)))
    got = {(r.frame_id, r.line_id, r.text, r.words_count) for r in layout.lines(frame(spark, rows)).collect()}
    assert got == want


def merge_band(band):
    mean = sum(max(1, r[5] - r[3]) for r in band) / len(band)
    bullet = {r[1]: r[4] - r[2] <= mean * 0.05 and r[5] - r[3] <= mean * 1.4 for r in band}
    units = [[r] for r in band]
    while True:
        able = []
        for i, (a, b) in enumerate(zip(units, units[1:])):
            gap, heights = b[0][2] - a[-1][4], [max(1, r[5] - r[3]) for r in a + b]
            if not bullet[a[-1][1]] and not bullet[b[0][1]] and len(heights) <= 5 and gap <= sum(heights) / len(heights) * 2.0:
                able.append((gap, i))
        if not able:
            return units
        _, i = min(able)
        units[i : i + 2] = [units[i] + units[i + 1]]


@pytest.mark.parametrize("seed,tall", [(4, False), (5, True), (6, True)])
def test_merged_units(spark, seed, tall):
    rows = make(seed, tall=tall)
    want = set()
    for f, mine in by_frame(rows).items():
        n = 0
        able = [r for r in mine if (r[4] - r[2]) * (r[5] - r[3]) >= 32 and r[4] - r[2] > 1 and r[5] - r[3] > 1]
        for band in reading_order(able, 40, 0.40) if able else []:
            for u in merge_band(band):
                n += 1
                want.add((f, n, min(r[2] for r in u), min(r[3] for r in u), max(r[4] for r in u), max(r[5] for r in u), len(u)))
    got = {tuple(r) for r in boxes.merged(frame(spark, rows)).collect()}
    assert got == want


def iou(a, b):
    w, h = max(0, min(a[4], b[4]) - max(a[2], b[2])), max(0, min(a[5], b[5]) - max(a[3], b[3]))
    size = lambda r: (r[4] - r[2]) * (r[5] - r[3])
    union = size(a) + size(b) - w * h
    return w * h / union if union else 0.0


def test_suppression(spark):
    rows = make(7)
    want = set()
    for f, mine in by_frame(rows).items():
        kept = []
        for r in sorted(mine, key=lambda r: (-(1.0 if r[6] is None else r[6]), r[1])):
            if all(iou(r, k) <= 0.5 for k in kept):
                kept.append(r)
        want |= {(f, i, r[1]) for i, r in enumerate(kept)}
    got = {(r.frame_id, r.nms_ord, r.word_id) for r in boxes.suppressed(frame(spark, rows)).collect()}
    assert got == want


def test_consensus(spark):
    rows = make(8)
    want = set()
    for f, mine in by_frame(rows).items():
        left, n = sorted(mine, key=lambda r: r[1]), 0
        while left:
            lead = left[0]
            group = [lead] + [r for r in left[1:] if iou(lead, r) > 0.35]
            left = [r for r in left if r not in group]
            n += 1
            want.add((f, n, *(int(sum(r[k] for r in group) / len(group)) for k in (2, 3, 4, 5)), len(group)))
    got = {tuple(r) for r in boxes.consensus(frame(spark, rows), order=("word_id",)).collect()}
    assert got == want


def test_empty_tables(spark):
    none = frame(spark, [])
    assert layout.lines(none).count() == boxes.merged(none).count() == boxes.suppressed(none).count() == boxes.consensus(none, order=("word_id",)).count() == 0


def test_corner_cache_and_nulls(spark):
    box = lambda x: (x, 0, x + 100, 100)
    rows = [(1, 1, None, "a"), (1, 2, box(0), None), (1, 3, box(0), "c"), (1, 4, box(0), "d"), (1, 5, box(50), None), (1, 6, box(1), "f"), (1, 7, None, "g"), (1, 8, None, "h"), (1, 9, box(1), "i")]
    kind = "camera_id int, frame_id int, coarse struct<x1:int,y1:int,x2:int,y2:int>, detected string"
    got = [(r.frame_id, r.reused, r.used) for r in frames.with_corner_cache(spark.createDataFrame(rows, kind)).orderBy("frame_id").collect()]
    assert got == [(1, False, "a"), (2, False, None), (3, False, "c"), (4, True, "c"), (5, False, None), (6, True, "c"), (7, False, "g"), (8, False, "h"), (9, False, "i")]


def test_tables_by_frame_are_shuffled_once_into_tasks_by_their_rows(spark):
    """Tasks of lines and merging hold about so many boxes, however many there are (F8, F9, F11 to F15, F17)."""
    from pagewright import queries
    from pagewright.sources.tables import dealt
    from tests.oracle import DATA

    assert dealt(spark.range(1000).selectExpr("id as frame_id"), 1000, "frame_id", each=30).rdd.getNumPartitions() == 34
    for name in ("bands_w2", "line_splits_w4", "merge_m2", "merge_bullets_m2b"):
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan, name


def test_first_leaders_equal_plain_loops(spark, monkeypatch):
    """frames of unlike size side by side, with boxes that lack a side."""
    import random

    import numpy as np
    import pyarrow as pa

    from pagewright.operators import boxes

    rng = random.Random(3)
    frames = [[[x := rng.randrange(60), y := rng.randrange(30), x + rng.randrange(-2, 50), y + rng.randrange(0, 30)] for _ in range(rng.choice([0, 1, 2, 9, 40]))] for _ in range(60)]
    frames[5].append([None, 1, 5, 5])

    def plain(rows):
        kept, out = [], []
        for i, b in enumerate(rows):
            lead = i
            for k in kept:
                a = rows[k]
                if None in a or None in b:
                    continue
                w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
                size = [max(0, r[2] - r[0]) * max(0, r[3] - r[1]) for r in (a, b)]
                if w > 0 and h > 0 and min(size) > 0 and w * h / (sum(size) - w * h) > 0.35:
                    lead = k
                    break
            kept += [i] * (lead == i)
            out.append(lead + 1)
        return out

    rows = pa.array([[dict(zip(boxes.BOX, b), pos=i) for i, b in enumerate(f)] for f in frames], pa.list_(pa.struct([("pos", pa.int32())] + [(c, pa.int32()) for c in boxes.BOX])))
    for cells in (50, 1 << 17):
        monkeypatch.setattr(boxes, "CELLS", cells)
        got = boxes._first_leaders(0.35).func(rows[3:]).to_pylist()
        assert got == [plain(f) for f in frames[3:]]
    assert np.array_equal(boxes.first_leaders(np.zeros((2, 0, 4)), 0.5), np.zeros((2, 0)))
