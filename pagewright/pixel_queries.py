"""Registered queries over pixels: patterned frames and bright papers of the size of a thumbnail, one for each customer, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright import fixtures
from pagewright.functions import geometry, pixels
from pagewright.operators import pictures
from pagewright.queries import QUERIES, T, query

_CROPS = f"""
crops as (select frame_id, height, k as word_id, case when k = 1 then (frame_id % 4)::int else 2 end as cx1, case when k = 1 then (frame_id % 3)::int else 2 end as cy1,
    case when k = 1 then (20 - frame_id % 3)::int else 9 end as cx2, case when k = 1 then height else 12 end as cy2 from {T('pictures')} p, (select unnest([1, 2]) as k) z),
sized as (select *, case when cy2 - cy1 > 64 then greatest(1, floor((cx2 - cx1) * (64.0::double / (cy2 - cy1))))::int else cx2 - cx1 end as w, least(cy2 - cy1, 64) as h from crops)"""


def _hex(data: str) -> F.Column:
    return F.hex(data).alias("pixels")


@query(
    f"""with {_CROPS},
ys as (select *, unnest(range(h)) as oy from sized), xs as (select *, unnest(range(w)) as ox from ys), cs as (select *, unnest([0, 1, 2]) as c from xs),
yb as (select *, cy1 + unnest(range(oy * (cy2 - cy1) // h, ((oy + 1) * (cy2 - cy1) + h - 1) // h)) as y from (select * replace (oy::bigint as oy) from cs)),
xb as (select *, cx1 + unnest(range(ox * (cx2 - cx1) // w, ((ox + 1) * (cx2 - cx1) + w - 1) // w)) as x from yb),
o as (select frame_id, word_id, w, h, oy, ox, c, floor(avg({fixtures.PIXEL.replace('f *', 'frame_id *')}) + 0.5::double)::int as v from xb group by all)
select frame_id, word_id, w::int as out_w, h::int as out_h, string_agg(printf('%02X', v), '' order by oy, ox, c) as pixels from o group by 1, 2, 3, 4""",
    "word_id",
)
def crop_pixels_p12(spark, d):
    """Crops cut from their frames, those over 64 pixels high shrunk to 64."""
    frames = fixtures.with_pixels(spark, d, "pictures")
    i = F.col("frame_id")
    crops = frames.select("frame_id", "height", F.explode(F.array(F.lit(1), F.lit(2))).alias("word_id"))
    one = F.col("word_id") == 1
    at = {"cx1": (i % 4, 2), "cy1": (i % 3, 2), "cx2": (20 - i % 3, 9), "cy2": (F.col("height"), 12)}
    crops = crops.select("frame_id", "word_id", *[F.when(one, a).otherwise(b).cast("int").alias(c) for c, (a, b) in at.items()])
    w, h = geometry.shrunk(F.col("cx2") - F.col("cx1"), F.col("cy2") - F.col("cy1"))
    return pictures.cut(frames, crops.withColumns({"out_w": w, "out_h": h})).select("frame_id", "word_id", "out_w", "out_h", _hex("data"))


_AT = fixtures.PIXEL.replace("f *", "frame_id *")


def _pixel(x: str, y: str) -> str:
    return _AT.replace("x *", f"({x}) *").replace("y *", f"({y}) *").replace("* y", f"* ({y})")


@query(
    f"""with p as (select frame_id, height, greatest(32, round_even(20 * (64.0::double / height) / 32.0, 0) * 32)::int as w, greatest(32, round_even(height * (64.0::double / height) / 32.0, 0) * 32)::int as h from {T('pictures')} p),
ys as (select *, unnest(range(h)) as oy from p), xs as (select *, unnest(range(w)) as ox from ys), cs as (select *, unnest([0, 1, 2]) as c from xs),
u as (select *, (oy + 0.5::double) * height / h - 0.5::double as v, (ox + 0.5::double) * 20 / w - 0.5::double as u from cs),
k as (select *, v - floor(v) as fy, u - floor(u) as fx, greatest(0, floor(v))::bigint as y0, least(height - 1, floor(v) + 1)::bigint as y1, greatest(0, floor(u))::bigint as x0, least(19, floor(u) + 1)::bigint as x1 from u),
o as (select frame_id, w, h, oy, ox, c, floor(({_pixel('x0', 'y0')} * (1 - fx) + {_pixel('x1', 'y0')} * fx) * (1 - fy) + ({_pixel('x0', 'y1')} * (1 - fx) + {_pixel('x1', 'y1')} * fx) * fy + 0.5::double)::int as v from k)
select frame_id, w as width, h as height, string_agg(printf('%02X', v), '' order by oy, ox, c) as pixels from o group by 1, 2, 3""",
)
def detector_pixels_p6(spark, d):
    """Frames at a text detector's size: the longer side to 64 pixels, sides in multiples of 32, linear."""
    side = lambda c: geometry.detector_side(c, "width", "height", 64)
    frames = fixtures.with_pixels(spark, d, "pictures")
    return frames.select("frame_id", side("width").alias("width"), side("height").alias("height"), _hex(pixels.resized("data", "width", "height", side("width"), side("height"), "linear")))


@query(
    f"""with p as (select frame_id, (frame_id % 7)::int as a, (frame_id % 11)::int as b, (20 + frame_id % 10)::int as h from {T('pictures')} p),
ys as (select *, unnest(range(h)) as oy from p), xs as (select *, unnest(range(40)) as ox from ys), cs as (select *, unnest([0, 1, 2]) as c from xs),
o as (select frame_id, h, oy, ox, c, {_pixel('ox + a', 'oy + b')} as v from cs)
select frame_id, 40::int as width, h as height, string_agg(printf('%02X', v), '' order by oy, ox, c) as pixels from o group by 1, 2, 3""",
)
def rectified_pixels_p9(spark, d):
    """A quadrilateral of each frame flattened; its corners come in any order."""
    rows = fixtures.pictures_of(spark, d, "pictures").withColumns({"width": F.lit(50), "height": F.lit(42)})
    i = F.col("frame_id")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    a, b, h = i % 7, i % 11, 20 + i % 10
    corners = geometry.ordered_corners(F.array(point(a + 40, b + h), point(a, b), point(a, b + h), point(a + 40, b)))
    frames = rows.withColumns({"data": fixtures._patterns("frame_id", "width", "height"), "corners": corners}).withColumn("s", geometry.rectified_size("corners", 40))
    flat = pixels.rectified(frames.select("frame_id", "width", "height", "data", "corners", "s.w", "s.h"))
    return flat.select("frame_id", "width", "height", _hex("data"))


@query(
    f"""select frame_id, (x1 - 5)::int as x1, (y1 - 5)::int as y1, (x2 + 3)::int as x2, (y2 + 3)::int as y2,
  (x2 - x1 + 8) * (y2 - y1 + 8) >= 0.12::double * width * height as large from {T('papers')} p"""
)
def outline_m9(spark, d):
    """The rectangle of the largest outline: a paper's edges, widened by the dilation."""
    frames = fixtures.with_pixels(spark, d, "papers").withColumn("coarse", F.lit(None).cast("struct<x1:int,y1:int,x2:int,y2:int>"))
    found = pixels.outline(frames.drop("x1", "y1", "x2", "y2"))
    xs, ys = F.transform("contour", lambda p: F.round(p["x"]).cast("int")), F.transform("contour", lambda p: F.round(p["y"]).cast("int"))
    ends = [F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")]
    return found.select("frame_id", *ends, (F.col("contour_area") >= 0.12 * F.col("width") * F.col("height")).alias("large"))


def enhanced_pixels(spark, d):
    """Frames with their contrast evened out and sharpened. Its steps are tested against plain loops."""
    return fixtures.with_pixels(spark, d, "papers").select("frame_id", "width", "height", F.sha2(pixels.enhanced("data"), 256).alias("sha256"))


QUERIES["enhanced_pixels"] = enhanced_pixels
