"""Pixel operators on exploded planes (frame_id, x, y, luma). Planes are bounded; frames are many."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as G
from .scan import each_group


def changes(pixels: DataFrame, least: int = 24) -> DataFrame:
    """Pixels whose luma differs by `least` or more from the frame before. One shuffle by position and range of frames."""
    # each range of frames also takes the last frame before it
    ahead = pixels.where("frame_id % 4096 = 4095").withColumn("cut", F.expr("frame_id div 4096 + 1"))
    rows = pixels.withColumn("cut", F.expr("frame_id div 4096")).unionByName(ahead)
    own = W.partitionBy("x", "y", "cut").orderBy("frame_id")
    rows = rows.withColumn("before", F.lag(F.struct("frame_id", "luma")).over(own)).where("frame_id div 4096 = cut and before.frame_id = frame_id - 1")
    return rows.withColumn("diff", F.abs(F.col("luma") - F.col("before.luma"))).where(F.col("diff") >= least).select("frame_id", "x", "y", "diff")


def changed_leaves(changed: DataFrame, leaf: int = 16, least: int = 8) -> DataFrame:
    """(frame_id, leaf_x, leaf_y, changed) of leaves with at least that many changed pixels."""
    return changed.groupBy("frame_id", F.expr(f"x div {leaf}").alias("leaf_x"), F.expr(f"y div {leaf}").alias("leaf_y")).agg(F.count(F.lit(1)).alias("changed")).where(F.col("changed") >= least)


def box_mean(pixels: DataFrame, by: int = 4) -> DataFrame:
    """Means of by x by boxes, cut to whole numbers; boxes at the edges may be smaller."""
    boxes = pixels.groupBy("frame_id", F.expr(f"x div {by}").alias("x"), F.expr(f"y div {by}").alias("y"))
    return boxes.agg(F.expr("sum(luma) div count(luma)").alias("luma"))


def census_plane(luma: np.ndarray, radius: int = 3) -> np.ndarray:
    """Descriptor of each pixel of a plane (rows, columns): a bit for each neighbour (row by row, the centre skipped) that is darker; 0 at the border."""
    h, w = luma.shape
    out = np.zeros((h, w), np.uint64)
    if h <= 2 * radius or w <= 2 * radius:
        return out
    inner, bit = luma[radius : h - radius, radius : w - radius], 0
    total = np.zeros(inner.shape, np.uint64)
    for dy in range(2 * radius + 1):
        for dx in range(2 * radius + 1):
            if dx != radius or dy != radius:
                total |= (luma[dy : dy + inner.shape[0], dx : dx + inner.shape[1]] < inner).astype(np.uint64) << np.uint64(bit)
                bit += 1
    out[radius : h - radius, radius : w - radius] = total
    return out


def census(pixels: DataFrame, radius: int = 3) -> DataFrame:
    """census_plane() of each frame, a row a pixel. A task holds one plane at a time."""

    def described(c: dict) -> dict:
        x, y = (np.asarray(c[k], np.int64) for k in "xy")
        plane = np.zeros((y.max() + 1, x.max() + 1), np.int64)
        plane[y, x] = c["luma"]
        return {"x": x, "y": y, "descriptor": census_plane(plane, radius)[y, x].view(np.int64)}

    return each_group(pixels, ["frame_id"], ["y", "x"], ["x", "y", "luma"], described, f"frame_id {dict(pixels.dtypes)['frame_id']}, x bigint, y bigint, descriptor bigint")


def nearest(a: DataFrame, b: DataFrame, reach: int) -> DataFrame:
    """For each descriptor of a (pair_id, x, y, d): the closest of b within reach, ties to the first by (y, x).

    Per pair, b's descriptors lie on a grid, and all of a's look at one place of the window at a time: work is a's points times the
    window, memory that of one plane.
    """
    both = a.select("pair_id", "x", "y", "d", F.lit(0).alias("side")).union(b.select("pair_id", "x", "y", "d", F.lit(1).alias("side")))

    def matched(c: dict) -> dict | None:
        x, y, d, side = (np.asarray(c[k]).astype(np.int64) for k in ("x", "y", "d", "side"))
        left, right = side == 0, side == 1
        if not left.any() or not right.any():
            return None
        grid = np.zeros((y.max() + 1 + 2 * reach, x.max() + 1 + 2 * reach), np.uint64)
        there = np.zeros(grid.shape, bool)
        grid[y[right] + reach, x[right] + reach], there[y[right] + reach, x[right] + reach] = d[right].view(np.uint64), True
        ax, ay, ad = x[left], y[left], d[left].view(np.uint64)
        best, at = np.full(len(ax), 65, np.int64), np.full((len(ax), 2), -1, np.int64)
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                rows, cols = ay + dy + reach, ax + dx + reach
                distance = np.where(there[rows, cols], np.bitwise_count(grid[rows, cols] ^ ad), 65)
                closer = distance < best
                best[closer], at[closer, 0], at[closer, 1] = distance[closer], (ax + dx)[closer], (ay + dy)[closer]
        hit = best < 65
        return {"ax": ax[hit], "ay": ay[hit], "bx": at[hit, 0], "by": at[hit, 1], "distance": best[hit]}

    return each_group(both, ["pair_id"], ["side", "y", "x"], ["x", "y", "d", "side"], matched, f"pair_id {dict(a.dtypes)['pair_id']}, ax bigint, ay bigint, bx bigint, by bigint, distance int")


def mutual(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Matches that lead back to where they began; others are inconsistent."""
    back = backward.select("pair_id", F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("bx").alias("rx"), F.col("by").alias("ry"))
    both = forward.join(back, ["pair_id", "bx", "by"], "left")
    same = F.coalesce((F.col("rx") == F.col("ax")) & (F.col("ry") == F.col("ay")), F.lit(False))
    return both.select("pair_id", "ax", "ay", "bx", "by", "distance", F.when(same, "matched").otherwise("inconsistent").alias("state"))


def motion_clusters(moves: DataFrame) -> DataFrame:
    """Dominant displacement of each pair: clusters by halves rounded down; most support, then larger movement, then
    smaller cluster dy, dx; lower medians."""
    c = moves.where("dx <> 0 or dy <> 0").withColumn("cx", G.floor_half("dx")).withColumn("cy", G.floor_half("dy"))
    mid = lambda n: F.get(F.array_sort(F.collect_list(n)), F.floor((F.count(F.lit(1)) - 1) / 2).cast("int"))
    found = c.groupBy("pair_id", "cx", "cy").agg(F.count(F.lit(1)).alias("support"), mid("dx").alias("dx"), mid("dy").alias("dy"), F.min("bx").alias("left"), F.max("bx").alias("right"), F.min("by").alias("top"), F.max("by").alias("bottom"))
    size = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    best = found.groupBy("pair_id").agg(F.max_by(F.struct("support", "dx", "dy", "left", "top", "right", "bottom"), F.struct("support", size.alias("s"), -F.col("cy"), -F.col("cx"))).alias("b"))
    return best.select("pair_id", "b.*")


def corners(scored: DataFrame, cell: int, least: int = 12) -> DataFrame:
    """The best-scored pixel of each cell: score, then smaller y, then smaller x."""
    group = scored.where(F.col("score") >= least).groupBy("frame_id", F.expr(f"x div {cell}").alias("cell_x"), F.expr(f"y div {cell}").alias("cell_y"))
    return group.agg(F.max(F.struct("score", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("m")).select("frame_id", "cell_x", "cell_y", "m.score", (-F.col("m.nx")).alias("x"), (-F.col("m.ny")).alias("y"))


def support_box(clusters: DataFrame, width: str, height: str, by: int = 4) -> DataFrame:
    """clusters (left, top, right, bottom: places of a plane `by` times smaller) with x, y, w, h of the whole frame's pixels they cover, cut at its edges."""
    x, y = F.col("left") * by, F.col("top") * by
    right, bottom = F.least((F.col("right") + 1) * by, F.col(width)), F.least((F.col("bottom") + 1) * by, F.col(height))
    return clusters.select("*", x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h"))


def residual(pixels: DataFrame, shifts: DataFrame, apart: int = 16) -> DataFrame:
    """(frame_id, n, residual, ppm) of frames with a shift (frame_id, dx, dy): pixels of the frame before that differ by more than `apart` both from their place
    and from where the shift leads, of those that it leaves in the frame. Two equi-joins by frame and place."""
    before = shifts.join(pixels.select((F.col("frame_id") + 1).alias("frame_id"), "x", "y", F.col("luma").alias("was")), "frame_id")
    still = pixels.select("frame_id", "x", "y", F.col("luma").alias("still"))
    moved = pixels.select("frame_id", F.col("x").alias("mx"), F.col("y").alias("my"), F.col("luma").alias("moved"))
    both = before.join(still, ["frame_id", "x", "y"]).withColumn("mx", F.col("x") + F.col("dx")).withColumn("my", F.col("y") + F.col("dy")).join(moved, ["frame_id", "mx", "my"])
    off = (F.abs(F.col("was") - F.col("still")) > apart) & (F.abs(F.col("was") - F.col("moved")) > apart)
    return both.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(off).alias("residual")).withColumn("ppm", G.ratio_ppm(F.col("residual"), F.col("n")))
