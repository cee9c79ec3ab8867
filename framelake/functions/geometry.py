"""Rectangles and integer arithmetic as columns. A rectangle is four columns x, y, w, h with a common prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(prefix: str, *names: str) -> list[Column]:
    return [F.col(prefix + n) for n in names]


def area(p: str = "") -> Column:
    w, h = _c(p, "w", "h")
    return w * h


def overlap(a: str, b: str, dx: Column | int = 0, dy: Column | int = 0) -> Column:
    """Area that a, moved by (dx, dy), and b share; touching edges share none."""
    ax, ay, aw, ah = _c(a, "x", "y", "w", "h")
    bx, by, bw, bh = _c(b, "x", "y", "w", "h")
    ax, ay, none = ax + dx, ay + dy, F.lit(0).cast("long")
    return F.greatest(none, F.least(ax + aw, bx + bw) - F.greatest(ax, bx)) * F.greatest(none, F.least(ay + ah, by + bh) - F.greatest(ay, by))


def iou(a: str, b: str, dx: Column | int = 0, dy: Column | int = 0) -> Column:
    """Intersection over union: whole numbers, then one division; 0 where they share nothing."""
    both = overlap(a, b, dx, dy)
    return F.when(both > 0, both.cast("double") / (area(a) + area(b) - both)).otherwise(F.lit(0.0))


def fits(p: str = "", fw: str = "fw", fh: str = "fh") -> Column:
    x, y, w, h = _c(p, "x", "y", "w", "h")
    return (w > 0) & (h > 0) & (x + w <= F.col(fw)) & (y + h <= F.col(fh))


def valid_frame(fw: str = "fw", fh: str = "fh") -> Column:
    return (F.col(fw) > 0) & (F.col(fh) > 0)


def clamped(x: Column, y: Column, w: Column, h: Column, fw: str = "fw", fh: str = "fh") -> dict[str, Column]:
    """x, y, w, h of the part inside the frame; w or h is 0 or less where there is none."""
    zero = F.lit(0).cast("long")
    cx, cy = F.least(F.greatest(x, zero), F.col(fw)), F.least(F.greatest(y, zero), F.col(fh))
    return {"x": cx, "y": cy, "w": F.least(x + w, F.col(fw)) - cx, "h": F.least(y + h, F.col(fh)) - cy}


def contains(p: str, px: Column, py: Column) -> Column:
    x, y, w, h = _c(p, "x", "y", "w", "h")
    return (px >= x) & (px < x + w) & (py >= y) & (py < y + h)


def near(a: str, b: str, by: int = 16) -> Column:
    """The rectangles, each grown by `by` on all sides, overlap."""
    ax, ay, aw, ah = _c(a, "x", "y", "w", "h")
    bx, by_, bw, bh = _c(b, "x", "y", "w", "h")
    zero, g = F.lit(0).cast("long"), F.lit(by)
    low = lambda v: F.greatest(zero, v - g)
    return (low(ax) < bx + bw + g) & (low(bx) < ax + aw + g) & (low(ay) < by_ + bh + g) & (low(by_) < ay + ah + g)


def centre_shift(a: str, b: str) -> tuple[Column, Column]:
    """Movement of the centre from a to b: doubled centres, halved towards zero."""
    half = lambda p, q, n: F.try_divide(2 * F.col(q + n[0]) + F.col(q + n[1]) - 2 * F.col(p + n[0]) - F.col(p + n[1]), F.lit(2))
    cut = lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("long")
    return cut(half(a, b, "xw")), cut(half(a, b, "yh"))


def rounded_bin(v: str, width: int) -> Column:
    """Nearest multiple number of width, halves away from zero."""
    return F.expr(f"cast(case when {v} >= 0 then ({v} + {width // 2}) div {width} else ({v} - {width // 2}) div {width} end as long)")


def floor_half(v: str) -> Column:
    return F.floor(F.col(v) / 2).cast("long")


def ratio_ppm(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(0).cast("long")).otherwise(F.floor(n * F.lit(1_000_000) / d).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def log2_bin(v: Column) -> Column:
    """Bin of a 64-bin histogram: the highest set bit; 0 for 0."""
    return (F.length(F.bin(v)) - 1).cast("int")


def meaningful_move(dx: Column, dy: Column, least: int = 16) -> Column:
    return (F.abs(dx) >= least) | (F.abs(dy) >= least)


def centre_distance2(a: str, b: str) -> Column:
    """Squared distance of the doubled centres."""
    ax, ay, aw, ah = _c(a, "x", "y", "w", "h")
    bx, by, bw, bh = _c(b, "x", "y", "w", "h")
    dx, dy = 2 * ax + aw - 2 * bx - bw, 2 * ay + ah - 2 * by - bh
    return dx * dx + dy * dy


def expanded(p: str, by: int, fw: Column, fh: Column) -> dict[str, Column]:
    """x, y, w, h grown by `by` on all sides, within the frame."""
    x, y, w, h = _c(p, "x", "y", "w", "h")
    zero = F.lit(0).cast("long")
    left, top = F.greatest(zero, x - by), F.greatest(zero, y - by)
    return {"x": left, "y": top, "w": F.least(x + w + by, fw) - left, "h": F.least(y + h + by, fh) - top}


def node_box(grid_x: Column, grid_y: Column, span: Column, leaf: int, fw: Column, fh: Column) -> dict[str, Column]:
    """x, y, w, h of a square of span leaves, cut at the frame's right and lower edge."""
    x, y = grid_x * leaf, grid_y * leaf
    return {"x": x, "y": y, "w": F.least(span * leaf, fw - x), "h": F.least(span * leaf, fh - y)}


def corner_cell(wide: Column, high: Column, base: int = 24, most: int = 1024) -> Column:
    """Side of the smallest cells, from base on, of which a span of wide x high needs no more than `most`."""
    count = lambda c: F.ceil(wide / c) * F.ceil(high / c)
    # the side wanted is no more than two above the root of the area a cell may have, or the longer side
    top = F.greatest(F.lit(base), F.least(F.greatest(wide, high), F.ceil(F.sqrt(wide * high / F.lit(float(most)))) * 2 + 2)).cast("int")
    return F.array_min(F.filter(F.sequence(F.lit(base), F.greatest(top, F.lit(base))), lambda c: count(c) <= most))


def saturating(op: str, a: Column, b: Column, low: int = 0, high: int = (1 << 63) - 1) -> Column:
    """a + b, a - b or a * b of whole numbers, held between low and high."""
    x, y = (v.cast("decimal(19,0)") for v in (a, b))
    exact = {"+": x + y, "-": x - y, "*": x * y}[op]
    return F.least(F.greatest(exact, F.lit(low).cast("decimal(38,0)")), F.lit(high).cast("decimal(38,0)")).cast("long")


def checked(op: str, a: Column, b: Column, low: int = 0, high: int = (1 << 63) - 1) -> Column:
    """The same, null where it would leave that range."""
    x, y = (v.cast("decimal(19,0)") for v in (a, b))
    exact = {"+": x + y, "-": x - y, "*": x * y}[op]
    return F.when(exact.between(F.lit(low).cast("decimal(38,0)"), F.lit(high).cast("decimal(38,0)")), exact.cast("long"))
