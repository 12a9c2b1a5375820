"""State from row to row of a key: rows come in order, and only the state stays from one batch to the next. A key's rows go through one task (scan), or, where a
block's effect on the state can be told without knowing it, through many (composed, carried)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagewright.sources.tables import shared_folder, stored

#: Rows of a key from which it goes through many tasks.
LONG = 2_000_000
#: How often blocks are run again from another state before the rest of a key goes through one task.
ROUNDS = 5


def scan(df: DataFrame, by: str, order: str, step: Callable, schema: str) -> DataFrame:
    """by, order and what step adds, for each row of df: step(state, rows) -> (state, arrays) sees the rows of one key in their order, in parts of an Arrow
    batch; state is None at a key's first part. schema: of by, order and the added columns.

    One shuffle by key. A task holds a batch and a state, however long a key's history is; the histories of different keys go side by side. Within
    one key each step needs the last one's state, so a key's rows pass through one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            last, new = keys.slice(0, len(keys) - 1), keys.slice(1)
            same = pc.fill_null(pc.or_kleene(pc.equal(last, new), pc.and_(pc.is_null(last), pc.is_null(new))), False) if len(keys) > 1 else pa.array([], pa.bool_())
            cuts = [0, *(np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(a, b - a)
                key = (part.column(0)[0].as_py(),)
                state, added = step(state if key == held else None, part)
                held = key
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *added], names=[by, order, *(f"_{i}" for i in range(len(added)))])

    rest = [c for c in df.columns if c not in (by, order)]
    return df.select(by, order, *rest).repartition(by).sortWithinPartitions(by, order).mapInArrow(run, schema)


def corners_kept(threshold: float) -> Callable:
    """The corner cache's step, over rows of (key, order, coarse, detected): reused, used. State: the cached box (null or four coordinates) and corners.

    Runs of hits are found at once: the boxes after a refresh are compared with it, in spans that double until one misses."""

    def step(state: tuple | None, part: pa.RecordBatch) -> tuple[tuple | None, list[pa.Array]]:
        coarse, detected = part.column(2), part.column(3)
        there = coarse.is_valid().to_numpy(zero_copy_only=False)
        boxes = np.stack([coarse.field(i).fill_null(0).to_numpy(zero_copy_only=False).astype(float) for i in range(4)], axis=1)
        found = detected.is_valid().to_numpy(zero_copy_only=False)
        n = part.num_rows
        hit, source = np.zeros(n, bool), np.where(found, np.arange(n) + 1, -1)
        held = pa.nulls(1, detected.type) if state is None else state[1]
        box, at = (None, -1) if state is None else (state[0], 0)
        i, span = 0, 16
        while i < n:
            if at < 0:
                first = np.flatnonzero(found[i:])
                if not len(first):
                    break
                i += int(first[0])
                box, at, i, span = (boxes[i] if there[i] else None), i + 1, i + 1, 16
                continue
            stop = min(n, i + span)
            near = there[i:stop] & (overlaps(boxes[i:stop], box) >= threshold) if box is not None else np.zeros(stop - i, bool)
            miss = np.flatnonzero(~near & found[i:stop])
            end = i + int(miss[0]) if len(miss) else stop
            hit[i:end] = near[: end - i]
            source[i:end][near[: end - i]] = at
            if len(miss):
                box, at, end, span = (boxes[end] if there[end] else None), end + 1, end + 1, 16
            else:
                span *= 2
            i = end
        every = pa.concat_arrays([held, detected])
        used = every.take(pa.array(source, pa.int64(), mask=source < 0))
        return (None if at < 0 else (box, every.slice(at, 1))), [pa.array(hit), used]

    return step


def overlaps(boxes: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes with one box; 0 where the union is empty. The rule of geometry.iou, in its order of operations."""
    wide = np.maximum(0, np.minimum(boxes[:, 2], box[2]) - np.maximum(boxes[:, 0], box[0]))
    high = np.maximum(0, np.minimum(boxes[:, 3], box[3]) - np.maximum(boxes[:, 1], box[1]))
    area = lambda b: np.maximum(0, b[..., 2] - b[..., 0]) * np.maximum(0, b[..., 3] - b[..., 1])
    shared = wide * high
    union = area(boxes) + area(box) - shared
    return np.where(union > 0, shared / np.where(union > 0, union, 1), 0.0)


def resolutions(budget: float, start: int) -> Callable:
    """The adaptive resolution's step, over rows of (key, order, seconds): dim."""

    def step(state: int | None, part: pa.RecordBatch) -> tuple[int, list[pa.Array]]:
        dim, out = start if state is None else state, []
        for seconds in part.column(2).to_pylist():
            if seconds is not None and (seconds > budget or seconds < budget * 0.5):
                dim = max(320, min(1600, int(dim * (0.85 if seconds > budget else 1.1))))
            out.append(dim)
        return dim, [pa.array(out, pa.int32())]

    return step


def batch_sizes(start: int, most: int) -> Callable:
    """The batch size's step, over rows of (key, order, n_left, items_per_s, failed): batch."""

    def step(state: tuple | None, part: pa.RecordBatch) -> tuple[tuple, list[pa.Array]]:
        now, top, best, at, up = state or (start, most, 0.0, start, True)
        out = []
        for left, speed, failed in zip(*(part.column(i).to_pylist() for i in (2, 3, 4))):
            used = max(1, min(now, top, max(1, left)))
            out.append(used)
            better = speed > best * 1.03
            if failed:
                now = top = max(1, used // 2)
                up = False
                continue
            if better and up and used >= now:
                now = min(top, max(now * 2, used + 1))
            elif not better and up:
                now = at
            if better:
                best, at = speed, used
            else:
                up = False
        return (now, top, best, at, up), [pa.array(out, pa.int32())]

    return step


# --- one key in many tasks: rows are range-partitioned by key and order; a block is what one partition has of a key


def is_long(df: DataFrame, by: str) -> bool:
    """Whether a key has so many rows that one task would take long over them."""
    return not df.groupBy(by).count().where(F.col("count") > LONG).isEmpty()


def _kind(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def in_blocks(df: DataFrame, by: str, order: str) -> DataFrame:
    """df as a stored table with `part`, the number of its range partition by (by, order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32))], names=[*batch.schema.names, "part"])

    schema = ", ".join([*(f"`{c}` {_kind(df, c)}" for c in df.columns), "part int"])
    return stored(df.repartitionByRange(by, order).mapInArrow(run, schema), shared_folder(df.sparkSession, "blocks"))


def _spans(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The runs of rows with one key (first column) and part (last column)."""
    if not batch.num_rows:
        return
    keys, parts = batch.column(0).dictionary_encode("encode").indices.to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
    cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield (batch.column(0)[a].as_py(), int(parts[a])), batch.slice(a, b - a)


def _block_rows(rows: DataFrame, starts: DataFrame | None, by: str, order: str) -> DataFrame:
    """Rows of blocks beside each other and in order: by, order, the rest, start (of starts, whose blocks alone stay), part."""
    rest = [c for c in rows.columns if c not in (by, order, "part")]
    if starts is None:
        joined = rows.select(by, order, *rest, "part").repartition(by, "part")
    else:
        same = rows[by].eqNullSafe(starts[by]) & (rows["part"] == starts["part"])
        joined = rows.join(starts, same).select(rows[by], order, *rest, "start", rows["part"]).repartition(by, "part")
    return joined.sortWithinPartitions(by, "part", order)


def block_ends(rows: DataFrame, starts: DataFrame | None, by: str, order: str, begin: Callable, step: Callable, end: Callable, schema: str) -> DataFrame:
    """A row (by, part, *end(state)) of each block: begin(first rows) -> state, step(state, rows) -> state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        kinds = [pa.field(n, t) for n, t in zip(names, types)]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for f, v in zip(kinds, (*held, *end(state)))], names=names)

        for batch in batches:
            for key, part in _spans(batch):
                if key != held:
                    if held is not None:
                        yield row()
                    held, state = key, begin(part)
                state = step(state, part)
        if held is not None:
            yield row()

    whole = f"`{by}` {_kind(rows, by)}, part int, {schema}"
    arrow = to_arrow_schema(StructType.fromDDL(whole))
    names, types = arrow.names, arrow.types
    return _block_rows(rows, starts, by, order).mapInArrow(run, whole)


def replayed(rows: DataFrame, starts: DataFrame, by: str, order: str, begin: Callable, step: Callable, schema: str) -> DataFrame:
    """by, order and what step adds, for each row: every block from its state in starts(by, part, start). As scan, in one task a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            for key, part in _spans(batch):
                if key != held:
                    held, state = key, begin(part)
                state, added = step(state, part)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *added], names=[by, order, *(f"_{i}" for i in range(len(added)))])

    return _block_rows(rows, starts, by, order).mapInArrow(run, schema)


def _by_key(blocks: DataFrame, by: str, fn: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """fn(a key's blocks in order) -> rows; a key has as many blocks as partitions at most."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return blocks.groupBy(by).applyInArrow(lambda t: pa.Table.from_pylist(fn(sorted(t.to_pylist(), key=lambda r: r["part"])), arrow), schema)


def resolutions_in_blocks(frames: DataFrame, budget: float, start: int, by: str, order: str, schema: str) -> DataFrame:
    """The adaptive resolution of frames(by, order, seconds), each camera in as many tasks as it has blocks: a block composes its steps into a map of all sizes,
    the maps of a camera are followed from the first size, and every block is replayed from the size that it is met with."""
    rows = in_blocks(frames.select(by, order, "seconds"), by, order)
    sizes = np.unique([start, *range(320, 1601)])
    moves = {f: np.searchsorted(sizes, [max(320, min(1600, int(x * f))) for x in sizes.tolist()]) for f in (0.85, 1.1)}

    def compose(state: np.ndarray, part: pa.RecordBatch) -> np.ndarray:
        for seconds in part.column(2).to_pylist():
            if seconds is not None and (seconds > budget or seconds < budget * 0.5):
                state = moves[0.85 if seconds > budget else 1.1][state]
        return state

    def follow(blocks: list[dict]) -> list[dict]:
        at, out = int(np.searchsorted(sizes, start)), []
        for b in blocks:
            out.append({by: b[by], "part": b["part"], "start": int(sizes[at])})
            at = int(np.frombuffer(b["map"], np.int64)[at])
        return out

    maps = block_ends(rows, None, by, order, lambda _: np.arange(len(sizes)), compose, lambda s: (s.astype(np.int64).tobytes(),), "map binary")
    starts = _by_key(maps, by, follow, f"`{by}` {_kind(rows, by)}, part int, start int")
    return replayed(rows, starts, by, order, lambda part: part.column(part.num_columns - 2)[0].as_py(), resolutions(budget, start), schema)


def _hits_all(block: dict, box: list | None, threshold: float) -> bool:
    """Whether every frame of a block that has corners surely overlaps a box by the threshold, so that the block leaves the state as it is: by what all its
    boxes share, and the largest of their areas."""
    if not block["found"]:
        return True
    if box is None or block["bare"]:
        return False
    shared = max(0.0, min(box[2], block["x2"]) - max(box[0], block["x1"])) * max(0.0, min(box[3], block["y2"]) - max(box[1], block["y1"]))
    union = max(0.0, box[2] - box[0]) * max(0.0, box[3] - box[1]) + block["area"] - shared
    return union > 0 and shared / union >= threshold + 1e-9


def corners_in_blocks(frames: DataFrame, threshold: float, by: str, order: str, schema: str) -> DataFrame:
    """The corner cache of frames(by, order, coarse, detected), each camera in as many tasks as it has blocks.

    Blocks run at once, each from a guess of the cached box: nothing at first, then what the block before it ended with. A block whose guess was right is done,
    and so is one that surely leaves any such box as it is; the others run again, until none is left. After ROUNDS the cameras that are not done
    go through one task each. Results are those of the plain scan."""
    rows = in_blocks(frames.select(by, order, "coarse", "detected"), by, order)
    spark, kind, held = rows.sparkSession, _kind(rows, "detected"), "array<double>"
    state = f"struct<there: boolean, box: {held}, detected: {kind}>"
    step = corners_kept(threshold)

    def told(part: pa.RecordBatch) -> tuple | None:
        s = part.column(4)[0].as_py()
        if not s["there"]:
            return None
        return None if s["box"] is None else np.array(s["box"], float), pa.array([s["detected"]], part.column(3).type)

    def plain(state: tuple | None) -> dict:
        return {"there": False, "box": None, "detected": None} if state is None else {"there": True, "box": None if state[0] is None else state[0].tolist(), "detected": state[1][0].as_py()}

    def run(state: tuple, part: pa.RecordBatch) -> tuple:
        now, seen = step(state[0], part)[0], state[1]
        found = part.filter(part.column(3).is_valid())
        seen["found"] += found.num_rows
        coarse = found.column(2)
        seen["bare"] += coarse.null_count
        if found.num_rows > coarse.null_count:
            x1, y1, x2, y2 = (coarse.field(i).filter(coarse.is_valid()).to_numpy(zero_copy_only=False).astype(float) for i in range(4))
            for name, value in (("x1", x1.max()), ("y1", y1.max()), ("area", (np.maximum(0, x2 - x1) * np.maximum(0, y2 - y1)).max())):
                seen[name] = max(seen[name], float(value))
            for name, value in (("x2", x2.min()), ("y2", y2.min())):
                seen[name] = min(seen[name], float(value))
        return now, seen

    def begin(part: pa.RecordBatch) -> tuple:
        return told(part), {"found": 0, "bare": 0, "x1": -np.inf, "y1": -np.inf, "x2": np.inf, "y2": np.inf, "area": 0.0}

    facts = "found long, bare long, x1 double, y1 double, x2 double, y2 double, area double"
    ran = f"stop {state}, {facts}"

    def ends(starts: DataFrame) -> DataFrame:
        out = block_ends(rows, starts, by, order, begin, run, lambda s: (plain(s[0]), *s[1].values()), ran)
        return out.join(starts.select(F.col(by).alias("_by"), F.col("part").alias("_part"), "start"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("part") == F.col("_part"))).drop("_by", "_part")

    def follow(blocks: list[dict]) -> list[dict]:
        now, out = {"there": False, "box": None, "detected": None}, []
        for b in blocks:
            out.append({by: b[by], "part": b["part"], "start": now, "again": False})
            if now == b["start"]:
                now = b["stop"]
            elif not (now["there"] and _hits_all(b, now["box"], threshold)):
                out[-1]["again"] = True
                now = b["stop"]
        return out

    first = rows.select(by, "part").distinct().withColumn("start", F.expr(f"cast(named_struct('there', false, 'box', null, 'detected', null) as {state})"))
    known = stored(ends(stored(first, shared_folder(spark, "starts"))), shared_folder(spark, "ends"))
    keys = f"`{by}` {_kind(rows, by)}, part int, start {state}"
    for _ in range(ROUNDS):
        plan = stored(_by_key(known, by, follow, f"{keys}, again boolean"), shared_folder(spark, "starts"))
        again = plan.where("again").drop("again")
        if again.isEmpty():
            return replayed(rows, plan.drop("again"), by, order, told, step, schema)
        left = again.select(F.col(by).alias("_by"), F.col("part").alias("_part"))
        others = known.join(left, F.col(by).eqNullSafe(F.col("_by")) & (F.col("part") == F.col("_part")), "left_anti")
        known = stored(others.unionByName(ends(again)), shared_folder(spark, "ends"))
    plan = stored(_by_key(known, by, follow, f"{keys}, again boolean"), shared_folder(spark, "starts"))
    open_keys = plan.where("again").select(F.col(by).alias("_by")).distinct()
    is_open: Column = F.col(by).eqNullSafe(F.col("_by"))
    done = replayed(rows.join(open_keys, is_open, "left_anti"), plan.drop("again"), by, order, told, step, schema)
    return done.unionByName(scan(rows.join(open_keys, is_open, "left_semi").drop("part"), by, order, step, schema))
