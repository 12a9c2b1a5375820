"""Box, size and corner arithmetic as Column functions. Boxes are x1, y1, x2, y2 in pixels, origin top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole(c: Column) -> Column:
    """Towards zero, as int."""
    return c.cast("int")


def half_even(c: Column) -> Column:
    return F.bround(c).cast("int")


def clamp(c: Column, low, high) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.greatest(low, F.least(high, c))


def centre_y(y1="y1", y2="y2") -> Column:
    return (col(y1) + col(y2)) / F.lit(2.0)


def height(y1="y1", y2="y2") -> Column:
    return F.greatest(F.lit(1), col(y2) - col(y1))


def area(b: Column) -> Column:
    side = lambda a, c: F.greatest(F.lit(0), b[c] - b[a]).cast("double")
    return side("x1", "x2") * side("y1", "y2")


def overlap(a: Column, b: Column) -> Column:
    """Area that two box structs share."""
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo])).cast("double")
    return side("x1", "x2") * side("y1", "y2")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two box structs; 0 where the union is empty or a box is null."""
    union = area(a) + area(b) - overlap(a, b)
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).when(union > 0, overlap(a, b) / union).otherwise(F.lit(0.0))


def pixels(v: str | Column, extent: str | Column) -> Column:
    """A normalised coordinate as a pixel inside the frame (half to even)."""
    return clamp(half_even(col(v) * col(extent)), 0, col(extent))


def inverse_scale(v: str | Column, scale: str | Column) -> Column:
    return whole(col(v) / col(scale))


def downscale(width: str | Column, height_: str | Column, most: int) -> Column:
    """Factor that brings the longer side to `most`; never over 1."""
    return F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(col(height_), col(width)))


def detector_side(side: str | Column, width: str | Column, height_: str | Column, target: int = 2056) -> Column:
    """Side length for the text detector: the longer side to `target`, rounded half to even to a multiple of 32, at least 32."""
    scale = F.lit(float(target)) / F.greatest(col(height_), col(width))
    return F.greatest(F.lit(32), half_even(col(side) * scale / F.lit(32.0)) * 32)


def padded(low: str | Column, high: str | Column, extent: str | Column, share: float = 0.08) -> tuple[Column, Column]:
    """An interval widened by a share of its length on both sides, inside the frame."""
    pad = whole((col(high) - col(low)) * F.lit(share))
    return F.greatest(F.lit(0), col(low) - pad), F.least(col(extent), col(high) + pad)


def crop_pads(h: str | Column, ratio: float = 0.55) -> tuple[Column, Column]:
    """Padding of a recognition crop: 4 to 14 pixels across, 4 to 12 down."""
    return clamp(whole(col(h) * F.lit(ratio)), 4, 14), clamp(whole(col(h) * F.lit(ratio) * F.lit(0.9)), 4, 12)


def shrunk(w: str | Column, h: str | Column, most: int = 64) -> tuple[Column, Column]:
    """Width and height of a crop whose height is brought down to `most`."""
    tall = col(h) > most
    return F.when(tall, F.greatest(F.lit(1), whole(col(w) * (F.lit(float(most)) / col(h))))).otherwise(col(w)), F.when(tall, F.lit(most)).otherwise(col(h))


def enlarged(w: str | Column, h: str | Column, least: int, target: int) -> tuple[Column, Column]:
    """Width and height of a crop whose shorter side is brought up to `target` if it is under `least`."""
    short = F.least(col(w), col(h))
    scale = F.lit(float(target)) / F.greatest(F.lit(1), short)
    grow = lambda s: F.when(short < least, F.greatest(F.lit(1), half_even(s * scale))).otherwise(s)
    return grow(col(w)), grow(col(h))


def token_budget(widest: str | Column) -> Column:
    return clamp(whole(col(widest) / F.lit(9.0)) + 6, 8, 48)


def bounds_of(points: str | Column) -> Column:
    """Bounding box struct of an array of x, y structs, towards zero."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(whole(F.array_min(xs)).alias("x1"), whole(F.array_min(ys)).alias("y1"), whole(F.array_max(xs)).alias("x2"), whole(F.array_max(ys)).alias("y2"))


def placed(points: str | Column, scale: str | Column, dx: str | Column, dy: str | Column) -> Column:
    """Corners found in a scaled crop, in the frame."""
    back = lambda v, d: v / F.least(F.lit(1.0), col(scale)) + col(d)
    return F.transform(points, lambda p: F.struct(back(p["x"], dx).alias("x"), back(p["y"], dy).alias("y")))


def placed_box(points: str | Column, width: str | Column, height_: str | Column) -> Column:
    """Bounding box struct of placed corners, inside the frame, towards zero."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    low = lambda v: whole(F.greatest(F.lit(0.0), F.array_min(v)))
    high = lambda v, most: whole(F.least(col(most).cast("double"), F.array_max(v)))
    return F.struct(low(xs).alias("x1"), low(ys).alias("y1"), high(xs, width).alias("x2"), high(ys, height_).alias("y2"))


def ordered_corners(points: str | Column) -> Column:
    """Four corners as top left, top right, bottom right, bottom left; the first of equal ones."""

    def pick(sign: int, key) -> Column:
        ranked = F.array_sort(F.transform(points, lambda p, i: F.struct((key(p) * sign).alias("key"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))))
        first = F.get(ranked, F.lit(0))
        return F.struct(first["x"].alias("x"), first["y"].alias("y"))

    total, slope = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(pick(1, total), pick(1, slope), pick(-1, total), pick(-1, slope))


def rectified_size(corners: str | Column, most: int = 5760) -> Column:
    """Struct w, h: the longer of opposite sides, scaled so that the longest has `most` pixels."""
    tl, tr, br, bl = (F.get(col(corners), F.lit(i)) for i in range(4))
    far = lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    w, h = whole(F.greatest(far(br, bl), far(tr, tl))), whole(F.greatest(far(tr, br), far(tl, bl)))
    scale = F.lit(float(most)) / F.greatest(w, h)
    return F.struct(whole(w * scale).alias("w"), whole(h * scale).alias("h"))


def east_box(cx, cy, d0, d1, d2, d3, angle) -> Column:
    """Struct x, y, w, h of an EAST cell: distances d0 to d3 (top, right, bottom, left) and an angle at 4-pixel cell cx, cy."""
    c, s = F.cos(col(angle)), F.sin(col(angle))
    h, w = col(d0) + col(d2), col(d1) + col(d3)
    end_x = whole(col(cx) * 4.0 + c * col(d1) + s * col(d2))
    end_y = whole(col(cy) * 4.0 - s * col(d1) + c * col(d2))
    return F.struct(whole(end_x - w).alias("x"), whole(end_y - h).alias("y"), whole(w).alias("w"), whole(h).alias("h"))
