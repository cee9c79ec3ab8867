"""Shapes, gates and verdicts around a text detector, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SHORT_SIDE, LONGEST, STRIDE, MOST_PIXELS = 736, 4000, 32, 1 << 24
LINE_HEIGHT, LEAST_WIDTH, WIDTH_STEP, MOST_WIDTH = 48, 320, 8, 3200
FIRST_SIDE, SCORE_FLOOR, SECOND_SIDE = 3.0, 0.4, 5.0
ELIGIBLE, ACCEPTED, SURVIVAL_PPM = 16, 12, 350_000
STILL, STILL_CLASS, STILL_PPM = 8, 12, 600_000
MOVED, RESIDUAL_PPM = 12, 250_000

STAGES = ("first_side", "score", "second_side", "admitted")


def _div(a: Column, b: Column | int) -> Column:
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a, b)


def nominal_shape(h: Column, w: Column) -> tuple[Column, Column]:
    """(height, width) in whole numbers: the short side becomes 736, the long one the nearest multiple of 32, half up."""
    short, long = F.least(h, w), F.greatest(h, w)
    scaled = _div(long * SHORT_SIDE + _div(short, 2), short)
    aligned = _div(scaled + STRIDE // 2, STRIDE) * STRIDE
    fixed = F.lit(SHORT_SIDE).cast("long")
    return F.when(h <= w, fixed).otherwise(aligned), F.when(h <= w, aligned).otherwise(fixed)


def input_shape(h: Column, w: Column) -> tuple[Column, Column]:
    """(height, width) a detector is run at: in doubles, long side 4,000 at most, multiples of 32 with ties to even.

    Null where the area would exceed 2**24. Not the same as nominal_shape.
    """
    ratio = F.lit(float(SHORT_SIDE)) / F.least(h, w)
    ph, pw = (F.floor(v * ratio).cast("double") for v in (h, w))
    cap = F.when(F.greatest(ph, pw) > LONGEST, F.lit(float(LONGEST)) / F.greatest(ph, pw))
    ph, pw = (F.coalesce(F.floor(v * cap).cast("double"), v) for v in (ph, pw))
    fit = lambda v: F.greatest(F.lit(STRIDE).cast("long"), F.rint(v / STRIDE).cast("long") * STRIDE)
    small = fit(ph) * fit(pw) <= MOST_PIXELS
    return F.when(small, fit(ph)), F.when(small, fit(pw))


def regional_extent(extent: Column, h: Column, w: Column) -> Column:
    """An extent of a page of h x w at the page's detector scale (the larger of its two), up to a multiple of 32."""
    nh, nw = nominal_shape(h, w)
    tall = nh * w >= nw * h
    up, down = F.when(tall, nh).otherwise(nw), F.when(tall, h).otherwise(w)
    return _div(extent * up + down * STRIDE - 1, down * STRIDE) * STRIDE


def line_width(w: Column, h: Column) -> Column:
    """Width of a text line scaled to 48 pixels of height, rounded up."""
    return _div(w * LINE_HEIGHT + h - 1, h)


def batch_width(content: Column, tight: bool = False) -> Column:
    """Width of a batch whose widest line is content; null above 3,200 (refused, not cropped)."""
    wide = _div(content + WIDTH_STEP - 1, WIDTH_STEP) * WIDTH_STEP if tight else F.greatest(content, F.lit(LEAST_WIDTH).cast("long"))
    return F.when(wide <= MOST_WIDTH, wide)


def area_perimeter(points: Column) -> Column:
    """Struct (area, perimeter) of a polygon, given as an array of structs x, y. A null point gives nulls."""
    n = F.size(points)
    at = lambda i: F.element_at(points, (i % n + 1).cast("int"))
    p, q = (lambda i: at(i)), (lambda i: at(i + 1))
    steps = F.sequence(F.lit(0), n - 1)
    total = lambda f: F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + f(p(i), q(i)))
    area = F.abs(total(lambda a, b: a["x"] * b["y"] - a["y"] * b["x"])) * 0.5
    return F.struct(area.alias("area"), total(lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])).alias("perimeter"))


def ordered_quad(points: Column) -> Column:
    """Four points as top-left, top-right, bottom-right, bottom-left: halves by x (equal x keep their order), then each by y."""
    numbered = F.transform(points, lambda p, i: F.struct(p["x"].alias("x"), i.alias("i"), p["y"].alias("y")))
    s = F.array_sort(numbered)
    point = lambda k: F.struct(s[k]["x"].alias("x"), s[k]["y"].alias("y"))
    left, right = s[1]["y"] > s[0]["y"], s[3]["y"] > s[2]["y"]
    pick = lambda when, a, b: F.when(when, point(a)).otherwise(point(b))
    return F.array(pick(left, 0, 1), pick(right, 2, 3), pick(right, 3, 2), pick(left, 1, 0))


def quad_fits(points: Column, width: Column, height: Column) -> Column:
    """All corners finite and on the page, page borders included."""
    top = float("inf")
    inside = lambda v, most: (v >= 0) & (v <= most) & (v < top) & ~F.isnan(v)
    return F.coalesce(F.forall(points, lambda p: inside(p["x"], width) & inside(p["y"], height)), F.lit(False))


def gate(first_side: Column, score: Column, second_side: Column) -> Column:
    """Where a contour leaves the detector's chain of gates, or 'admitted'. A missing value does not pass its gate."""
    fails = lambda v, least: ~F.coalesce((v >= least) & ~F.isnan(v), F.lit(False))
    return (
        F.when(fails(first_side, FIRST_SIDE), STAGES[0]).when(fails(score, SCORE_FLOOR), STAGES[1]).when(fails(second_side, SECOND_SIDE), STAGES[2]).otherwise(STAGES[3])
    )


def motion_verdict(eligible: Column, accepted: Column, survival: Column, still: Column, moved: Column, dx: Column, dy: Column, residual: Column) -> Column:
    """Verdict on a pair of frames. moved, dx, dy, residual are null where no translation was found."""
    known = lambda c: F.coalesce(c, F.lit(False))
    alive = survival >= SURVIVAL_PPM
    share = F.when(accepted == 0, 0).otherwise(_div(still * 1_000_000, F.greatest(accepted, F.lit(1).cast("long"))))
    few = (eligible < ELIGIBLE) | (accepted < ACCEPTED)
    at_rest = alive & (still >= STILL_CLASS) & (share >= STILL_PPM) & (F.coalesce(moved, F.lit(0)) < MOVED)
    shifted = alive & (still >= STILL) & (moved >= MOVED) & (F.greatest(F.abs(dx), F.abs(dy)) >= 2) & (residual <= RESIDUAL_PPM)
    return F.when(few, "insufficient_support").when(at_rest, "stationary").when(known(shifted), "coherent_translation").otherwise("ambiguous_motion")


def clock(ms: Column) -> Column:
    """m:ss of milliseconds, rounded half up, not below zero."""
    s = F.greatest(F.lit(0).cast("long"), F.floor(ms / 1000 + 0.5))
    return F.format_string("%d:%02d", _div(s, 60), s % 60)


def duration_label(ms: Column) -> Column:
    """'7 seconds' below a minute (one at least), m:ss from there."""
    s = F.greatest(F.lit(1).cast("long"), F.floor(ms / 1000 + 0.5))
    return F.when(s < 60, F.format_string("%d seconds", s)).otherwise(clock(ms))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many or one + "s"))
