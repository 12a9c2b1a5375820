"""The registered queries of the layout engine and their DuckDB SQL. Keys begin with what they show; the suffix is the operator's number in the survey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import fixtures
from pagewright.functions import codec, geometry, text
from pagewright.operators import boxes, detectors, frames, layout, vocabulary, words
from pagewright.sources.images import text_files
from pagewright.sources.tables import dealt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BOX = ("x1", "y1", "x2", "y2")


def query(sql: str, ints: str = ""):
    """Registers a query with its SQL; ints: its columns of type int, which SQL counts and numbers as longer ones."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = f"select * replace ({', '.join(f'cast({c} as int) as {c}' for c in ints.split())}) from ({sql}) z" if ints else sql
        return fn

    return register


def T(name):  # noqa: N802
    return fixtures.duck(name)


def table(spark, d, name):
    return fixtures.spark_table(spark, d, name)


def _words(spark, d):
    """The table words, which a join has dealt by part, dealt by frame."""
    return dealt(table(spark, d, "words"), fixtures.rows_of(spark, d, "lineitem"), "frame_id")


def _prefix(source: str, gap: int, ratio: str, area: bool = False) -> str:
    """Columns, bands and places, as SQL."""
    keep = "where (x2 - x1) * (y2 - y1) >= 32 and x2 - x1 > 1 and y2 - y1 > 1" if area else ""
    return f"""
w as (select *, (y1 + y2) / cast(2 as double) as cy, greatest(1, y2 - y1) as h from {source} s {keep}),
c0 as (select *, max(x2) over (partition by frame_id order by x1, word_id rows between unbounded preceding and 1 preceding) as mx from w),
c1 as (select *, sum(case when mx is null or x1 > mx + {gap} then 1 else 0 end) over (partition by frame_id order by x1, word_id rows between unbounded preceding and current row) as col from c0),
b0 as (select *, lag(cy) over (partition by frame_id, col order by cy, x1, word_id) as pcy, lag(h) over (partition by frame_id, col order by cy, x1, word_id) as ph from c1),
b1 as (select *, sum(case when pcy is null or not (abs(cy - pcy) < ph * cast('{ratio}' as double)) then 1 else 0 end) over (partition by frame_id, col order by cy, x1, word_id rows between unbounded preceding and current row) as band from b0),
p as (select *, row_number() over (partition by frame_id, col, band order by x1, cy, word_id) as rn from b1)"""


def _line_sql(source: str) -> str:
    return f"""
with recursive {_prefix(source, 35, "0.28")},
r as (select frame_id, col, band, rn, word_id, x2, cast(h as double) as sh, 1 as n, 1 as seg from p where rn = 1
  union all select p.frame_id, p.col, p.band, p.rn, p.word_id, p.x2,
    case when p.x1 - r.x2 > cast(2 as double) * r.sh / r.n then cast(p.h as double) else r.sh + p.h end,
    case when p.x1 - r.x2 > cast(2 as double) * r.sh / r.n then 1 else r.n + 1 end,
    case when p.x1 - r.x2 > cast(2 as double) * r.sh / r.n then r.seg + 1 else r.seg end
  from r join p on p.frame_id = r.frame_id and p.col = r.col and p.band = r.band and p.rn = r.rn + 1),
l as (select frame_id, word_id, rn, dense_rank() over (partition by frame_id order by col, band, seg) as line_id from r)"""


def _merge_sql(source: str) -> str:
    return f"""
with recursive {_prefix(source, 40, "0.40", True)},
s0 as (select *, (x2 - x1) <= ah * 0.05::double and (y2 - y1) <= ah * 1.4::double as bul from (select *, avg(h) over (partition by frame_id, col, band) as ah from p) z),
r as (select 0 as it, frame_id, col, band, rn, x1, x2, h, bul, rn as cid from s0
  union all
  select it + 1, frame_id, col, band, rn, x1, x2, h, bul, case when cid = mrg then tgt else cid end from (
    select k.*, m.lc as tgt, m.rc as mrg from r k join (
      select frame_id, col, band, lc, rc from (select *, row_number() over (partition by frame_id, col, band order by gap, lc) as pk from (
        select a.frame_id, a.col, a.band, a.cid as lc, lead(a.cid) over w as rc, lead(a.fx1) over w - a.lx2 as gap, a.n + lead(a.n) over w as nn,
          (a.sh + lead(a.sh) over w) / (a.n + lead(a.n) over w)::double as av, a.lbul or lead(a.fbul) over w as nb
        from (select frame_id, col, band, cid, count(*) as n, sum(h) as sh, min_by(x1, rn) as fx1, max_by(x2, rn) as lx2, min_by(bul, rn) as fbul, max_by(bul, rn) as lbul
              from r group by 1, 2, 3, 4) a
        window w as (partition by a.frame_id, a.col, a.band order by a.cid)) e
      where rc is not null and not nb and nn <= 5 and gap <= av * 2.0::double) f where pk = 1) m using (frame_id, col, band)) u),
f as (select * from (select *, max(it) over (partition by frame_id, col, band) as mi from r) where it = mi),
g as (select f.frame_id, f.col, f.band, f.cid, min(p.x1) as x1, min(p.y1) as y1, max(p.x2) as x2, max(p.y2) as y2, count(*) as merged
  from f join p using (frame_id, col, band, rn) group by 1, 2, 3, 4)
select frame_id, row_number() over (partition by frame_id order by col, band, cid) as word_id, x1, y1, x2, y2, merged from g"""


# Reading order


@query(f"with {_prefix(T('boxes'), 40, '0.40')} select frame_id, word_id, col from c1", "word_id col")
def columns_w1(spark, d):
    return layout.with_columns(table(spark, d, "boxes"), 40).select("frame_id", "word_id", "col")


@query(f"with {_prefix(T('tall'), 35, '0.28')} select frame_id, word_id, col, band, rn from p", "word_id col band rn")
def bands_w2(spark, d):
    return layout.banded(table(spark, d, "tall"), *layout.LINES).select("frame_id", "word_id", "col", "band", "rn")


@query(_line_sql(T("tall")) + " select frame_id, word_id, line_id from l", "word_id line_id")
def line_splits_w4(spark, d):
    return layout.with_lines(table(spark, d, "tall").withColumn("text", F.lit("x"))).select("frame_id", "word_id", "line_id")


@query(
    _line_sql(T("words"))
    + f""" select l.frame_id, l.line_id, string_agg(w.text, ' ' order by l.rn) as text, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, count(*) as words_count
from l join {T('words')} w using (frame_id, word_id) group by 1, 2""", "line_id words_count")
def line_groups_m3(spark, d):
    return layout.lines(_words(spark, d))


@query(f"select frame_id, word_id, ntile(7) over (partition by frame_id order by word_id) as chunk from {T('boxes')} b", "word_id chunk")
def chunks_w6(spark, d):
    return layout.chunks(table(spark, d, "boxes"), 7, "word_id").select("frame_id", "word_id", "chunk")


@query(f"select frame_id, word_id, row_number() over (partition by frame_id order by y1, x1, word_id) as new_id from {T('tall')} b where (x2 - x1) * (y2 - y1) >= 32 and x2 - x1 > 1 and y2 - y1 > 1", "word_id new_id")
def unmerged_w7(spark, d):
    return layout.unmerged(boxes.large_enough(table(spark, d, "tall"))).select("frame_id", "word_id", "new_id")


# Boxes

_IOU = "case when {u} > 0 then {i} / {u} else 0 end"


def _iou_sql(a: str, b: str) -> str:
    i = f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))::double * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))::double)"
    u = f"(greatest(0, {a}.x2 - {a}.x1)::double * greatest(0, {a}.y2 - {a}.y1)::double + greatest(0, {b}.x2 - {b}.x1)::double * greatest(0, {b}.y2 - {b}.y1)::double - {i})"
    return f"(case when {u} > 0 then {i} / {u} else 0.0::double end)"


def _leaders_sql(threshold: str) -> str:
    """Fold of the ordered rows of each frame in `o` to the leaders."""
    return f"list_reduce(list_transform(o, lambda b: [b]), lambda k, b: case when len(list_filter(k, lambda a: {_iou_sql('a', 'b[1]')} > {threshold}::double)) > 0 then k else list_concat(k, b) end)"


#: Wide boxes on few rows overlap often.
_DENSE = """(select frame_id, word_id, detector_ord, (x1 % 400) as x1, (y1 % 90) as y1, (x1 % 400) + (x2 - x1) as x2, (y1 % 90) + (y2 - y1) as y2, case when word_id % 5 = 0 then null else conf end as score from {b} b)"""


def _dense(spark, d):
    b = table(spark, d, "boxes")
    return b.select("frame_id", "word_id", "detector_ord", (F.col("x1") % 400).alias("x1"), (F.col("y1") % 90).alias("y1"), (F.col("x1") % 400 + F.col("x2") - F.col("x1")).alias("x2"), (F.col("y1") % 90 + F.col("y2") - F.col("y1")).alias("y2"), F.when(F.col("word_id") % 5 != 0, F.col("conf")).alias("score"))


def _nms_sql(threshold: str, source: str = "") -> str:
    return f"""with g as (select frame_id, list({{'r': -coalesce(score, 1.0::double), 'pos': word_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score}} order by -coalesce(score, 1.0::double), word_id) as o from {source or _DENSE.format(b=T('boxes'))} q group by 1),
k as (select frame_id, {_leaders_sql(threshold)} as kept from g),
u as (select frame_id, unnest(kept) as b, generate_subscripts(kept, 1) - 1 as nms_ord from k)
select frame_id, nms_ord, b.pos as word_id, b.x1 as x1, b.y1 as y1, b.x2 as x2, b.y2 as y2, b.score as score from u"""


@query(_nms_sql("0.5"), "nms_ord word_id")
def nms_m1(spark, d):
    return boxes.suppressed(_dense(spark, d))


@query(_nms_sql("0.3"), "nms_ord word_id")
def nms_tight_m1b(spark, d):
    return boxes.suppressed(_dense(spark, d), 0.3)


@query(
    f"""with n as (select *, row_number() over (partition by frame_id order by detector_ord, word_id) as pos from {_DENSE.format(b=T('boxes'))} q),
g as (select frame_id, list({{'pos': pos, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} order by pos) as o from n group by 1),
k as (select frame_id, o, {_leaders_sql('0.35')} as kept from g),
l as (select frame_id, unnest(kept) as a from k),
m as (select n.frame_id, n.pos, min(l.a.pos) as lead from n join l on l.frame_id = n.frame_id and (l.a.pos = n.pos or (l.a.pos < n.pos and {_iou_sql('l.a', 'n')} > 0.35::double)) group by 1, 2),
s as (select m.frame_id, m.lead, trunc(avg(x1))::int as x1, trunc(avg(y1))::int as y1, trunc(avg(x2))::int as x2, trunc(avg(y2))::int as y2, count(*) as votes from m join n using (frame_id, pos) group by 1, 2)
select frame_id, row_number() over (partition by frame_id order by lead) as word_id, x1, y1, x2, y2, votes from s""", "word_id votes")
def ensemble_m4(spark, d):
    return boxes.consensus(_dense(spark, d))


@query(_merge_sql(T("boxes")), "word_id merged")
def merge_m2(spark, d):
    return boxes.merged(table(spark, d, "boxes"))


@query(_merge_sql(T("tall")), "word_id merged")
def merge_bullets_m2b(spark, d):
    return boxes.merged(table(spark, d, "tall"))


@query(f"select frame_id, word_id from {T('tall')} b where (x2 - x1) * (y2 - y1) >= 32 and x2 - x1 > 1 and y2 - y1 > 1", "word_id")
def min_area_f3(spark, d):
    return boxes.large_enough(table(spark, d, "tall")).select("frame_id", "word_id")


@query(f"select frame_id, word_id from (select frame_id, word_id, (conf - 0.9::double) * 10.0::double as score, x1, y1, x2 - 40 as x2, y2 from {T('boxes')} b) where score >= 0.22::double and x1 < x2 and y1 < y2", "word_id")
def detector_filter_f1(spark, d):
    b = table(spark, d, "boxes").withColumn("score", (F.col("conf") - F.lit(0.9)) * F.lit(10.0)).withColumn("x2", F.col("x2") - 40)
    return boxes.detected(b).select("frame_id", "word_id")


@query(f"select a.frame_id, a.word_id as a, b.word_id as b, round({_iou_sql('a', 'b')}, 9) as iou from {_DENSE.format(b=T('boxes'))} a join {_DENSE.format(b=T('boxes'))} b on a.frame_id = b.frame_id and a.word_id < b.word_id where {_iou_sql('a', 'b')} > 0.5::double", "a b")
def overlaps_j5(spark, d):
    return boxes.overlapping(_dense(spark, d)).select("frame_id", "a", "b", F.round("iou", 9).alias("iou"))


@query(
    """select frame_id, detector, word_id from (select l_orderkey // 8 as frame_id, 'a' as detector, l_linenumber as word_id from lineitem where l_suppkey % 2 = 0
union all select l_orderkey // 8, 'b', l_linenumber from lineitem where l_suppkey % 3 = 0)"""
)
def detector_union_u1(spark, d):
    return detectors.union(_two_detectors(spark, d)).select("frame_id", "detector", "word_id")


def _two_detectors(spark, d):
    b = spark.read.parquet(f"{d}/lineitem.parquet").select(F.expr("l_orderkey div 8").alias("frame_id"), F.col("l_linenumber").alias("word_id"), "l_suppkey")
    return {name: b.where(F.col("l_suppkey") % k == 0).select("frame_id", "word_id") for name, k in (("a", 2), ("b", 3))}


@query(ORACLES["detector_union_u1"])
def tolerant_union_u3(spark, d):
    """A detector that cannot be planned is left out."""
    both = _two_detectors(spark, d)
    make = {"a": lambda: both["a"], "broken": lambda: both["a"].select("no_such_column"), "b": lambda: both["b"]}
    return detectors.tolerant_union(make)[0].select("frame_id", "detector", "word_id")


_EAST = f"""(select frame_id, det_ord as pos, x1 % 320 as cx, y1 % 180 as cy, 8.0::double + det_ord % 3 as d0, 60.0::double + det_ord as d1, 9.0::double as d2, 50.0::double as d3, (det_ord - 4) / 50.0::double as angle, score from {T('detections')} d)"""
_EAST_BOXES = f"""(select frame_id, pos as word_id, score, trunc(ex - w)::int as x1, trunc(ey - h)::int as y1, trunc(ex - w)::int + trunc(w)::int as x2, trunc(ey - h)::int + trunc(h)::int as y2 from (
  select *, d1 + d3 as w, d0 + d2 as h, trunc(cx * 4.0::double + cos(angle) * d1 + sin(angle) * d2)::int as ex, trunc(cy * 4.0::double - sin(angle) * d1 + cos(angle) * d2)::int as ey from {_EAST} e where score > 0.5::double) z)"""


@query(
    f"""select frame_id, nms_ord + 1 as word_id, trunc(x1 * (1920 / 1280.0::double))::int as x1, trunc(y1 * (1080 / 1280.0::double))::int as y1, trunc(x2 * (1920 / 1280.0::double))::int as x2, trunc(y2 * (1080 / 1280.0::double))::int as y2, score
from ({_nms_sql('0.4', _EAST_BOXES)}) n""", "word_id"
)
def east_m1c(spark, d):
    o = F.col("det_ord")
    cells = table(spark, d, "detections").select(
        "frame_id", o.alias("pos"), (F.col("x1") % 320).alias("cx"), (F.col("y1") % 180).alias("cy"), (F.lit(8.0) + o % 3).alias("d0"), (F.lit(60.0) + o).alias("d1"), F.lit(9.0).alias("d2"), F.lit(50.0).alias("d3"),
        ((o - 4) / F.lit(50.0)).alias("angle"), "score", F.lit(1920).alias("width"), F.lit(1080).alias("height"),
    )
    return detectors.east(cells)


@query(f"select frame_id, max(coalesce(case when det_ord % 3 > 0 then score end, 0.0::double)) as seconds from {T('detections')} d group by 1")
def ensemble_time_a7(spark, d):
    runs = table(spark, d, "detections").select("frame_id", F.col("label").alias("detector"), F.when(F.col("det_ord") % 3 > 0, F.col("score")).alias("seconds"))
    return detectors.ensemble_seconds(runs)


@query(
    """select sum(greatest(1, n_nationkey % 4))::bigint as replicas, count(distinct n_regionkey) as devices,
  string_agg('rec@http://' || n_name || ' (device=gpu:' || n_regionkey || ', replicas=' || greatest(1, n_nationkey % 4) || ')', ', ' order by 'http://' || n_name) as info
from nation where n_nationkey % 3 <> 0"""
)
def fleet_a10(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    servers = n.select(F.concat(F.lit("http://"), "n_name").alias("url"), F.lit("rec").alias("model"), F.concat(F.lit("gpu:"), "n_regionkey").alias("device"), (F.col("n_nationkey") % 4).cast("int").alias("num_replicas"), (F.col("n_nationkey") % 3 != 0).alias("healthy"))
    return detectors.fleet(servers)


@query(
    """select s_suppkey, s_name || '@http://s' || s_suppkey || ' (device=' || case when s_suppkey % 3 = 0 then 'unknown' else 'gpu:' || s_nationkey % 4 end || ', replicas=' || greatest(1, s_suppkey % 5) || ')' as info,
  'remote cluster (' || s_name || ', ' || s_nationkey || ')' as cluster from supplier"""
)
def server_info_p19(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    device = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("gpu:"), (F.col("s_nationkey") % 4).cast("string")))
    info = text.server_info("s_name", F.concat(F.lit("http://s"), "s_suppkey"), device, (F.col("s_suppkey") % 5).cast("int"))
    return s.select("s_suppkey", info.alias("info"), text.cluster_info("remote cluster", F.array("s_name", F.col("s_nationkey").cast("string"))).alias("cluster"))


# Projections

_F = T("frames")


@query(f"select frame_id, word_id, (y1 + y2) / 2.0::double as cy, greatest(1, y2 - y1) as h from {T('boxes')} b", "word_id")
def box_metrics_p1(spark, d):
    return layout.measured(table(spark, d, "boxes")).select("frame_id", "word_id", "cy", "h")


@query(f"select frame_id, greatest(0, least(width, round_even(((frame_id * 7919) % 1201) / 1000.0::double * width, 0)::int)) as px from {_F} f")
def pixel_box_p2(spark, d):
    v = (F.col("frame_id") * 7919) % 1201 / F.lit(1000.0)
    return table(spark, d, "frames").select("frame_id", geometry.pixels(v, "width").alias("px"))


@query(f"select frame_id, trunc(x1 / (0.1::double + (frame_id % 9) / 10.0::double))::int as x, least(1.0::double, 640.0::double / greatest(height, width)) as scale from {_F} f")
def scales_p4_p5(spark, d):
    f = table(spark, d, "frames")
    return f.select("frame_id", geometry.inverse_scale("x1", F.lit(0.1) + F.col("frame_id") % 9 / F.lit(10.0)).alias("x"), geometry.downscale("width", "height", 640).alias("scale"))


@query(f"select frame_id, greatest(32, round_even(height * (2056.0::double / greatest(height, width)) / 32.0::double, 0)::int * 32) as h, greatest(32, round_even(width * (2056.0::double / greatest(height, width)) / 32.0::double, 0)::int * 32) as w from {_F} f")
def resize_p6(spark, d):
    f = table(spark, d, "frames")
    return f.select("frame_id", geometry.detector_side("height", "width", "height").alias("h"), geometry.detector_side("width", "width", "height").alias("w"))


@query(f"select frame_id, greatest(0, x1 - trunc((x2 - x1) * 0.08::double)::int) as x1, least(width, x2 + trunc((x2 - x1) * 0.08::double)::int) as x2 from {_F} f")
def coarse_pad_p7(spark, d):
    low, high = geometry.padded("x1", "x2", "width")
    return table(spark, d, "frames").select("frame_id", low.alias("_l"), high.alias("_h")).withColumnsRenamed({"_l": "x1", "_h": "x2"})


def _corners(spark, d):
    f = table(spark, d, "frames")
    point = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    shift = lambda p, dx, dy: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"))
    k = F.col("frame_id") % 7
    return f.withColumn("pts", F.array(point("x2", "y2"), shift(point("x1", "y1"), k, F.lit(0)), shift(point("x1", "y2"), F.lit(0), -k), shift(point("x2", "y1"), k, k)))


_PTS = f"(select *, [{{'x': x2::double, 'y': y2::double}}, {{'x': x1::double + frame_id % 7, 'y': y1::double}}, {{'x': x1::double, 'y': y2::double - frame_id % 7}}, {{'x': x2::double + frame_id % 7, 'y': y1::double + frame_id % 7}}] as pts from {_F} f)"
_ORD = f"""o as (select frame_id, width, height, list_sort([{{'k': p.x + p.y, 'i': i, 'x': p.x, 'y': p.y}} for p, i in pts])[1] as tl, list_sort([{{'k': p.y - p.x, 'i': i, 'x': p.x, 'y': p.y}} for p, i in pts])[1] as tr,
  list_sort([{{'k': -(p.x + p.y), 'i': i, 'x': p.x, 'y': p.y}} for p, i in pts])[1] as br, list_sort([{{'k': -(p.y - p.x), 'i': i, 'x': p.x, 'y': p.y}} for p, i in pts])[1] as bl from {_PTS} q)"""


@query(f"with {_ORD} select frame_id, tl.x as tlx, tl.y as tly, tr.x as trx, tr.y as try, br.x as brx, br.y as bry, bl.x as blx, bl.y as bly from o")
def corner_order_p9(spark, d):
    o = _corners(spark, d).select("frame_id", geometry.ordered_corners("pts").alias("o"))
    return o.select("frame_id", *[F.col("o")[i][c].alias(f"{n}{c}") for i, n in enumerate(("tl", "tr", "br", "bl")) for c in "xy"])


@query(
    f"""with q as (select frame_id, width, height, [{{'x': p.x / least(1.0::double, s) + frame_id % 5, 'y': p.y / least(1.0::double, s) - frame_id % 40}} for p in pts] as pts from (select *, 0.5::double + (frame_id % 9) / 10.0::double as s from {_PTS} z) y)
select frame_id, trunc(greatest(0, list_min([p.x for p in pts])))::int as x1, trunc(greatest(0, list_min([p.y for p in pts])))::int as y1, trunc(least(width, list_max([p.x for p in pts])))::int as x2, trunc(least(height, list_max([p.y for p in pts])))::int as y2 from q"""
)
def placed_corners_p8(spark, d):
    i = F.col("frame_id")
    back = _corners(spark, d).withColumn("pts", geometry.placed("pts", F.lit(0.5) + i % 9 / F.lit(10.0), i % 5, -(i % 40)))
    return back.select("frame_id", geometry.placed_box("pts", "width", "height").alias("b")).select("frame_id", "b.*")


_DIST = "sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"


def _dist(a: str, b: str) -> str:
    return _DIST.format(a=a, b=b)


@query(
    f"""with {_ORD}, z as (select frame_id, trunc(greatest({_dist('br', 'bl')}, {_dist('tr', 'tl')}))::int as w, trunc(greatest({_dist('tr', 'br')}, {_dist('tl', 'bl')}))::int as h from o)
select frame_id, trunc(w * (5760.0::double / greatest(w, h)))::int as w, trunc(h * (5760.0::double / greatest(w, h)))::int as h from z"""
)
def rect_size_p10(spark, d):
    o = _corners(spark, d).select("frame_id", geometry.rectified_size(geometry.ordered_corners("pts")).alias("s"))
    return o.select("frame_id", "s.w", "s.h")


@query(f"select frame_id, trunc(list_min([p.x for p in pts]))::int as x1, trunc(list_min([p.y for p in pts]))::int as y1, trunc(list_max([p.x for p in pts]))::int as x2, trunc(list_max([p.y for p in pts]))::int as y2 from {_PTS} q")
def polygon_box_p15(spark, d):
    return _corners(spark, d).select("frame_id", geometry.bounds_of("pts").alias("b")).select("frame_id", "b.*")


_CROP = f"""(select *, greatest(0, x1 - px) as cx1, greatest(0, y1 - py) as cy1, least(1700, x2 + px) as cx2, least(500, y2 + py) as cy2 from (
  select *, greatest(4, least(14, trunc((y2 - y1) * 0.55::double)::int)) as px, greatest(4, least(12, trunc((y2 - y1) * 0.55::double * 0.9::double)::int)) as py from {T('tall')} b))"""


@query(
    f"""select frame_id, word_id, cx1, cy1, cx2, cy2, case when cy2 - cy1 > 64 then greatest(1, trunc((cx2 - cx1) * (64.0::double / (cy2 - cy1)))::int) else cx2 - cx1 end as out_w, least(64, cy2 - cy1) as out_h
from {_CROP} c where cx1 < cx2 and cy1 < cy2""", "word_id")
def crop_pad_p11(spark, d):
    b = table(spark, d, "tall").withColumn("width", F.lit(1700)).withColumn("height", F.lit(500))
    return words.crops(b).select("frame_id", "word_id", "cx1", "cy1", "cx2", "cy2", "out_w", "out_h")


@query(
    f"""select frame_id, word_id, case when s < 32 then greatest(1, round_even((x2 - x1) * (32.0::double / greatest(1, s)), 0)::int) else x2 - x1 end as w, case when s < 32 then greatest(1, round_even((y2 - y1) * (32.0::double / greatest(1, s)), 0)::int) else y2 - y1 end as h
from (select *, least(x2 - x1, y2 - y1) as s from {T('boxes')} b)""", "word_id")
def upscale_p13(spark, d):
    w, h = geometry.enlarged(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), 32, 32)
    return table(spark, d, "boxes").select("frame_id", "word_id", w.alias("w"), h.alias("h"))


def _upscale_sql(least: int, target: int) -> str:
    return f"""select frame_id, word_id, case when s < {least} then greatest(1, round_even((x2 - x1) * ({target}.0::double / greatest(1, s)), 0)::int) else x2 - x1 end as w, case when s < {least} then greatest(1, round_even((y2 - y1) * ({target}.0::double / greatest(1, s)), 0)::int) else y2 - y1 end as h
from (select *, least(x2 - x1, y2 - y1) as s from {T('tall')} b)"""


def _upscaled(spark, d, least, target):
    w, h = geometry.enlarged(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), least, target)
    return table(spark, d, "tall").select("frame_id", "word_id", w.alias("w"), h.alias("h"))


@query(_upscale_sql(40, 64), "word_id")
def upscale_crops_p13b(spark, d):
    return _upscaled(spark, d, 40, 64)


@query(_upscale_sql(4, 4), "word_id")
def upscale_tiny_p13c(spark, d):
    return _upscaled(spark, d, 4, 4)


@query(f"select frame_id, greatest(8, least(48, trunc(max(x2 - x1) / 9.0::double)::int + 6)) as budget from {T('boxes')} b group by 1")
def token_budget_p14(spark, d):
    return fixtures.spark_table(spark, d, "boxes", by_frame=False).groupBy("frame_id").agg(F.max(F.col("x2") - F.col("x1")).alias("w")).select("frame_id", geometry.token_budget("w").alias("budget"))


_CELL = "frame_id % 320 as cx, frame_id % 180 as cy, 3.0::double + frame_id % 5 as d0, 4.0::double + frame_id % 7 as d1, 5.0::double + frame_id % 3 as d2, 6.0::double + frame_id % 11 as d3, (frame_id % 13 - 6) / 10.0::double as angle"


@query(
    f"""select frame_id, trunc(ex - w)::int as x, trunc(ey - h)::int as y, trunc(w)::int as w, trunc(h)::int as h from (select frame_id, d1 + d3 as w, d0 + d2 as h,
  trunc(cx * 4.0::double + cos(angle) * d1 + sin(angle) * d2)::int as ex, trunc(cy * 4.0::double - sin(angle) * d1 + cos(angle) * d2)::int as ey from (select frame_id, {_CELL} from {_F} f))"""
)
def east_decode_p16(spark, d):
    i = F.col("frame_id")
    f = table(spark, d, "frames").select("frame_id", (i % 320).alias("cx"), (i % 180).alias("cy"), *[(F.lit(a) + i % m).alias(f"d{k}") for k, (a, m) in enumerate(((3.0, 5), (4.0, 7), (5.0, 3), (6.0, 11)))], ((i % 13 - 6) / F.lit(10.0)).alias("angle"))
    return f.select("frame_id", geometry.east_box("cx", "cy", "d0", "d1", "d2", "d3", "angle").alias("b")).select("frame_id", "b.*")


# Text

_CLEAN = r"""regexp_replace(regexp_replace({c}, '[^A-Za-z0-9\s.,:;!?\-><_()\[\]''"/\\@#$%&*+=~^•★●▪‣♦]', '', 'g'), '^\s+|\s+$', '', 'g')"""


@query(f"select doc_id, {_CLEAN.format(c='text')} as text from documents where {_CLEAN.format(c='text')} <> ''")
def clean_text_s10(spark, d):
    return words.recognised(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


_WEAK = "(coalesce(conf, 1.0::double) < 0.97::double or (text <> '' and length(text) > greatest(1, x2 - x1) / 4.0::double))"


@query(f"select frame_id, word_id, text from {T('words')} w where {_WEAK}", "word_id")
def weak_words_f8(spark, d):
    return words.weak_words(table(spark, d, "words")).select("frame_id", "word_id", "text")


@query(f"select frame_id, word_id, text from {T('words')} w where text <> '' and length(text) > greatest(1, x2 - x1) / 4.0::double", "word_id")
def suspect_f9(spark, d):
    return table(spark, d, "words").where(text.suspect("text")).select("frame_id", "word_id", "text")


@query(f"select c.frame_id, c.word_id, c.x1 from {T('boxes')} c where exists (select 1 from {T('words')} w where w.frame_id = c.frame_id and w.word_id = c.word_id and {_WEAK})", "word_id")
def weak_crops_j1(spark, d):
    return words.weak_crops(table(spark, d, "boxes"), table(spark, d, "words")).select("frame_id", "word_id", "x1")


@query(
    f"""with s as (select frame_id, word_id, second_text from {T('words')} w where {_WEAK})
select w.frame_id, w.word_id, coalesce(nullif(s.second_text, ''), w.text) as text, w.conf from {T('words')} w left join s using (frame_id, word_id)""", "word_id")
def fallback_j2(spark, d):
    w = table(spark, d, "words")
    second = words.weak_words(w).select("frame_id", "word_id", F.col("second_text").alias("text"))
    return words.reread(w, second).select("frame_id", "word_id", "text", "conf")


@query(
    f"""with a as (select frame_id, word_id, text from {T('words')} w where part_id % 4 <> 0)
select b.frame_id, b.word_id, coalesce(a.text, '') as text, case when a.text is null then 0.0::double else 0.5::double end as conf from {T('boxes')} b left join a using (frame_id, word_id)""", "word_id")
def scatter_j7(spark, d):
    named = {"frame_id": "batch_id", "word_id": "pos"}
    back = {v: k for k, v in named.items()}
    answers = table(spark, d, "words").where("part_id % 4 <> 0").withColumn("conf", F.lit(0.5)).withColumnsRenamed(named)
    return words.answered(table(spark, d, "boxes").select("frame_id", "word_id").withColumnsRenamed(named), answers).withColumnsRenamed(back).select("frame_id", "word_id", "text", "conf")


# Frames

_D = T("detections")


@query(f"select frame_id, det_ord, label from {_D} d where (label in ('laptop', 'tvmonitor') and score >= 0.3::double) or (label = 'person' and score >= 0.5::double)")
def class_filter_f7(spark, d):
    return frames.of_interest(table(spark, d, "detections")).select("frame_id", "det_ord", "label")


@query(
    f"""with s as (select *, row_number() over (partition by frame_id order by score desc, det_ord) as r from {_D} d where label in ('laptop', 'tvmonitor') and score >= 0.3::double)
select f.frame_id, coalesce(s.score, 0.0::double) as screen_score, s.x1 as sx1, s.y1 as sy1, s.x2 as sx2, s.y2 as sy2 from (select distinct frame_id from {_D} d) f left join s on s.frame_id = f.frame_id and s.r = 1"""
)
def best_screen_a6(spark, d):
    return frames.best_screen(table(spark, d, "detections"))


_PAPER = "(select frame_id, (frame_id * 3 % 300)::int as px1, (frame_id * 5 % 200)::int as py1, (frame_id * 3 % 300 + 500)::int as px2, (frame_id * 5 % 200 + 400)::int as py2 from (select distinct frame_id from " + _D + " d))"


@query(
    f"""with h as (select d.frame_id, d.det_ord, d.label, greatest(0, least(x2, px2) - greatest(x1, px1))::double * greatest(0, least(y2, py2) - greatest(y1, py1))::double as shared,
  greatest(1, (px2 - px1) * (py2 - py1)) as paper from {_D} d join {_PAPER} p using (frame_id) where label = 'person' and score >= 0.5::double),
r as (select *, row_number() over (partition by frame_id order by det_ord) as r from h where shared > 0 and shared > 0.01::double * paper)
select frame_id, det_ord, label, shared from r where r = 1"""
)
def obstruction_j4(spark, d):
    found = table(spark, d, "detections")
    i = F.col("frame_id")
    papers = found.select("frame_id").distinct().select("frame_id", (i * 3 % 300).cast("int").alias("px1"), (i * 5 % 200).cast("int").alias("py1"), (i * 3 % 300 + 500).cast("int").alias("px2"), (i * 5 % 200 + 400).cast("int").alias("py2"))
    return frames.obstructions(found, papers)


@query(
    f"""select frame_id, case when frame_id % 3 = 0 then 'model' when frame_id % 5 < 3 and ((x2 - x1) * (y2 - y1)) % 300000 >= 0.12::double * width * height then 'contour' when frame_id % 4 = 0 then 'coarse' else 'none' end as source,
case when frame_id % 3 = 0 then x1 + frame_id % 7 when frame_id % 5 < 3 and ((x2 - x1) * (y2 - y1)) % 300000 >= 0.12::double * width * height then x2 when frame_id % 4 = 0 then x1 end::double as first_x from {_F} f"""
)
def corner_fallback_m9(spark, d):
    f = _corners(spark, d)
    i = F.col("frame_id")
    model = F.when(i % 3 == 0, F.array(F.col("pts")[1], F.col("pts")[0], F.col("pts")[2], F.col("pts")[3])).otherwise(F.slice("pts", 1, 3))
    ready = f.withColumn("model", model).withColumn("contour", F.when(i % 5 < 3, F.col("pts"))).withColumn("contour_area", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))) % 300000).withColumn("coarse", F.when(i % 4 == 0, F.struct(*BOX)))
    return frames.corners_of(ready).select("frame_id", "source", F.col("corners")[0]["x"].alias("first_x"))


#: Coarse boxes that stay within a few pixels for a while.
_CACHE = f"""(select camera_id, frame_id, case when frame_id % 17 = 0 then null else {{'x1': (x1 // 100)::int, 'y1': (y1 // 50)::int, 'x2': 1000, 'y2': 700}} end as coarse, case when frame_id % 6 = 0 then null else frame_id end as detected from {_F} f)"""


@query(
    f"""with recursive s as (select *, row_number() over (partition by camera_id order by frame_id) as n from {_CACHE} q),
r as (select camera_id, frame_id, n, false as reused, detected as used, case when detected is not null then coarse end as box, detected as corners from s where n = 1
  union all select s.camera_id, s.frame_id, s.n, h.hit, case when h.hit then r.corners else s.detected end,
    case when not h.hit and s.detected is not null then s.coarse else r.box end, case when not h.hit and s.detected is not null then s.detected else r.corners end
  from r join s on s.camera_id = r.camera_id and s.n = r.n + 1,
  lateral (select coalesce(r.corners is not null and s.coarse is not null and r.box is not null and {_iou_sql('s.coarse', 'r.box')} >= 0.97::double, false) as hit) h)
select camera_id, frame_id, reused, used from r"""
)
def corner_cache_m6(spark, d):
    return frames.with_corner_cache(_cache_rows(spark, d))


def _cache_rows(spark, d):
    i = F.col("frame_id")
    coarse = F.struct(F.expr("cast(x1 div 100 as int)").alias("x1"), F.expr("cast(y1 div 50 as int)").alias("y1"), F.lit(1000).alias("x2"), F.lit(700).alias("y2"))
    return table(spark, d, "frames").select("camera_id", "frame_id", F.when(i % 17 != 0, coarse).alias("coarse"), F.when(i % 6 != 0, i).alias("detected"))


@query(ORACLES["corner_cache_m6"])
def corner_cache_blocks_m6(spark, d):
    """The same by blocks of a camera in many tasks."""
    return frames.with_corner_cache(_cache_rows(spark, d), long=True)


@query(
    f"""with recursive s as (select camera_id, frame_id, seconds, row_number() over (partition by camera_id order by frame_id) as n from {_F} f),
r as (select camera_id, 0::bigint as frame_id, 0::bigint as n, 1280 as dim from (select distinct camera_id from s)
  union all select s.camera_id, s.frame_id, s.n, case when s.seconds > 2.5::double then greatest(320, least(1600, trunc(r.dim * 0.85::double)::int)) when s.seconds < 1.25::double then greatest(320, least(1600, trunc(r.dim * 1.1::double)::int)) else r.dim end
  from r join s on s.camera_id = r.camera_id and s.n = r.n + 1)
select camera_id, frame_id, dim from r where n > 0"""
)
def adaptive_res_m7(spark, d):
    return frames.with_resolution(table(spark, d, "frames").select("camera_id", "frame_id", "seconds"))


@query(ORACLES["adaptive_res_m7"])
def adaptive_res_blocks_m7(spark, d):
    """The same by blocks of a camera in many tasks."""
    return frames.with_resolution(table(spark, d, "frames").select("camera_id", "frame_id", "seconds"), long=True)


_RUNS = f"(select camera_id as model_id, frame_id as run_id, (1 + frame_id % 500)::int as n_left, 100.0::double + (frame_id * 37) % 400 as items_per_s, frame_id % 97 = 50 as failed from {_F} f)"


@query(
    f"""with recursive s as (select *, row_number() over (partition by model_id order by run_id) as n from {_RUNS} q),
r as (select model_id, 0::bigint as run_id, 0::bigint as n, 0 as batch, 8 as now, 256 as top, 0.0::double as best, 8 as at, true as up from (select distinct model_id from s)
  union all select s.model_id, s.run_id, s.n, u.used,
    case when s.failed then greatest(1, u.used // 2) when b.better and r.up and u.used >= r.now then least(r.top, greatest(r.now * 2, u.used + 1)) when not b.better and r.up then r.at else r.now end::int,
    case when s.failed then greatest(1, u.used // 2) else r.top end::int, case when not s.failed and b.better then s.items_per_s else r.best end,
    case when not s.failed and b.better then u.used else r.at end, case when s.failed or not b.better then false else r.up end
  from r join s on s.model_id = r.model_id and s.n = r.n + 1, lateral (select greatest(1, least(r.now, r.top, greatest(1, s.n_left)))::int as used) u, lateral (select s.items_per_s > r.best * 1.03::double as better) b)
select model_id, run_id, batch from r where n > 0"""
)
def batch_sizer_m10(spark, d):
    i = F.col("frame_id")
    runs = table(spark, d, "frames").select(F.col("camera_id").alias("model_id"), i.alias("run_id"), (i % 500 + 1).cast("int").alias("n_left"), (F.lit(100.0) + i * 37 % 400).alias("items_per_s"), (i % 97 == 50).alias("failed"))
    return frames.with_batch_size(runs)


@query(f"select camera_id, frame_id, width from (select *, row_number() over (partition by camera_id order by ts desc, frame_id desc) as r from {_F} f) where r = 1")
def latest_frame_t6(spark, d):
    return frames.latest(table(spark, d, "frames")).select("camera_id", "frame_id", "width")


@query(
    f"""with f as (select distinct frame_id from {_D} d), b as (select distinct frame_id from {_D} d where label = 'person' and score >= 0.9::double), l as (select distinct frame_id from {_D} d where label = 'chair' and score > 0.2::double)
select f.frame_id, case when f.frame_id % 7 = 0 then 'no_corners' when b.frame_id is not null then 'obstructed' when l.frame_id is null then 'no_text' else 'ok' end as status from f left join b using (frame_id) left join l using (frame_id)"""
)
def frame_status_f12(spark, d):
    found = table(spark, d, "detections")
    ids = found.select("frame_id").distinct()
    corners = ids.withColumn("corners", F.when(F.col("frame_id") % 7 != 0, F.lit(1)))
    return frames.statuses(ids, corners, found.where("label = 'person' and score >= 0.9"), found.where("label = 'chair' and score > 0.2"))


@query(f"select label, count(*) as n, class_id from {_D} d where label not in ('laptop', 'person') group by all")
def class_names_j6(spark, d):
    known = spark.createDataFrame([("laptop",), ("person",)], "label string")
    return frames.unknown_classes(table(spark, d, "detections"), known)


@query(f"select frame_id, det_ord, case class_id when 0 then 'laptop' when 2 then 'person' else 'id_' || class_id end as name from {_D} d")
def label_names(spark, d):
    return table(spark, d, "detections").select("frame_id", "det_ord", text.label_of("class_id", {0: "laptop", 2: "person"}).alias("name"))


@query(
    f"""with g as (select frame_id, list_distinct(list(label)) as l from {_D} d where score > 0.4::double group by 1)
select frame_id, list_sort(list_distinct(list_concat(l, ['laptop', 'screen'])))::varchar as every, list_sort(list_filter(l, lambda x: x not in ('laptop', 'screen')))::varchar as missing from g"""
)
def name_sets_u2(spark, d):
    g = table(spark, d, "detections").where("score > 0.4").groupBy("frame_id").agg(F.collect_set("label").alias("l"))
    every, missing = text.name_sets("l", F.array(F.lit("laptop"), F.lit("screen")))
    shown = lambda a: F.concat(F.lit("["), F.array_join(a, ", "), F.lit("]"))
    return g.select("frame_id", shown(every).alias("every"), shown(missing).alias("missing"))


@query(f"select frame_id, arg_max(det_ord, (x2 - x1) * (y2 - y1) * 100 - det_ord) as contour, max((x2 - x1) * (y2 - y1)) as contour_area from {_D} d group by 1")
def largest_contour_t5(spark, d):
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return frames.largest_contours(table(spark, d, "detections").select("frame_id", F.col("det_ord").alias("ord"), F.col("det_ord").alias("contour"), area.alias("area")))


_ABLE = r"regexp_full_match(token, '[A-Za-z0-9\s\p{Z}.,:;!?\-><_()\[\]''\"/\\\\@#$%&*+=~^]*')"


@query(f"select token_id, token, {_ABLE} or token_id in (5, 10) as able from {T('tokens')} t")
def vocabulary_mask(spark, d):
    return vocabulary.vocabulary(table(spark, d, "tokens"), (5, 10))


@query(
    f"""with t as (select token_id, token, {_ABLE} or token_id in (5, 10) as able from {T('tokens')} t),
s as (select s.*, coalesce(t.able, false) as able, t.token, row_number() over (partition by frame_id, word_id, pos order by coalesce(t.able, false) desc, score desc, s.token_id) as n from {T('scores')} s left join t using (token_id)),
b as (select frame_id, word_id, pos, case when able then token_id end as token_id, case when able then token end as token from s where n = 1),
e as (select *, count(*) filter (where token_id = 7) over (partition by frame_id, word_id order by pos) as ended from b)
select frame_id, word_id, coalesce(string_agg(token, '' order by pos) filter (where ended = 0), '') as text from e group by 1, 2""",
)
def masked_decoding(spark, d):
    """Words read from scores under the vocabulary's mask, up to the end token 7."""
    tokens = vocabulary.vocabulary(table(spark, d, "tokens"), (5, 10))
    return vocabulary.decoded(table(spark, d, "scores"), tokens, 7)


# Codec and service


@query("select event_id, (event_id % 5)::bigint as h, (event_id % 3)::bigint as w, 3::bigint as c, (event_id % 5 > 0 and event_id % 3 > 0 and event_id % 4 <> 0) as valid from events")
def wire_header(spark, d):
    i = F.col("event_id")
    e = spark.read.parquet(f"{d}/events.parquet")
    size = ((i % 5) * (i % 3) * 3 + F.when(i % 4 == 0, 1).otherwise(0)).cast("int")
    packed = codec.pack(i % 5, i % 3, F.lit(3), F.encode(F.repeat(F.lit("z"), size), "UTF-8"))
    return e.select("event_id", codec.unpack(packed).alias("u")).select("event_id", "u.h", "u.w", "u.c", "u.valid")


@query("select event_id, pos, case when pos = 0 then event_type else '' end as text, case when pos = 1 then 0.5::double else 0.0::double end as conf from events, lateral (select unnest([0, 1]) as pos)")
def json_results(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    body = F.concat(F.lit('{"results":[{"text":"'), F.col("event_type"), F.lit('"},{"conf":0.5}],"model_time":0.1}'))
    return e.select("event_id", F.explode(codec.answers(body)).alias("r")).select("event_id", "r.pos", "r.text", "r.conf")


@query("select event_id, greatest(1, least((event_id % 900)::int, greatest((1 + event_id % 4)::int, ceil((event_id % 900) / 256.0::double)::int))) as requests from events")
def plan_requests_m12(spark, d):
    i = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", codec.requests((i % 900).cast("int"), (i % 4 + 1).cast("int"), F.lit(256)).alias("requests"))


@query(f"select frame_id, seconds + 0.5::double + case when frame_id % 2 = 0 then 0.25::double else 0 end as total, greatest(0.0::double, seconds - 1.0::double) as overhead from {_F} f")
def total_time_a8(spark, d):
    f = table(spark, d, "frames").withColumn("a", F.lit(0.5)).withColumn("b", F.when(F.col("frame_id") % 2 == 0, 0.25)).withColumn("server", F.lit(1.0))
    return f.select("frame_id", frames.total_seconds("seconds", "a", "b").alias("total"), frames.overhead("seconds", "server").alias("overhead"))


@query(
    _line_sql(T("words"))
    + f""", s as (select l.frame_id, l.line_id, string_agg(w.text, ' ' order by l.rn) as text from l join {T('words')} w using (frame_id, word_id) group by 1, 2)
select frame_id, frame_id || '.txt' as name, string_agg(text, chr(10) order by line_id) || chr(10) as content, false as clash from s group by 1"""
)
def text_sink_k1(spark, d):
    w = _words(spark, d)
    named = w.select("frame_id").distinct().withColumn("path", F.concat(F.lit("/in/"), F.col("frame_id"), F.lit(".jpg")))
    return text_files(named, layout.lines(w))


@query(_line_sql(T("words")) + f""", s as (select l.frame_id, l.line_id, string_agg(w.text, ' ' order by l.rn) as text, count(*) as n from l join {T('words')} w using (frame_id, word_id) group by 1, 2)
select frame_id, line_id, 'Line ' || line_id || ' (' || n || ' words): ' || text as report from s""", "line_id")
def console_k2(spark, d):
    return layout.lines(_words(spark, d)).select("frame_id", "line_id", text.line_report("line_id", "words_count", "text").alias("report"))


@query(_line_sql(T("words")) + f""", s as (select l.frame_id, l.line_id, string_agg(w.text, ' ' order by l.rn) as text from l join {T('words')} w using (frame_id, word_id) group by 1, 2)
select frame_id, line_id, ' - ' || text as line from s""", "line_id")
def camera_console_k3(spark, d):
    return layout.lines(_words(spark, d)).select("frame_id", "line_id", text.spoken("text").alias("line"))
