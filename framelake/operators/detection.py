"""From a detector's map of scores to the quads of text lines on the page."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.detector import FIRST_SIDE, SCORE_FLOOR, SECOND_SIDE, STAGES

# Fixed values.
ACTIVE, UNCLIP, MOST_CONTOURS, ARC, MOST_POINTS = np.float32(0.2), 1.4, 3_000, 0.25, 1_024

SCHEMA = "contour_no long, disposition string, first_side double, score double, second_side double, quad array<struct<x:long,y:long>>"


def components(active: np.ndarray) -> list[np.ndarray]:
    """Ends (x, y) of the runs of each 8-connected component, in the order a scan by rows meets them."""
    above, parent, runs = [], [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for y, row in enumerate(active):
        edge = np.flatnonzero(np.diff(row.astype(np.int8), prepend=0, append=0))
        now, k = [], 0
        for a, b in edge.reshape(-1, 2).tolist():
            i = len(runs)
            runs.append((a, b - 1, y))
            parent.append(i)
            while k < len(above) and runs[above[k]][1] < a - 1:
                k += 1
            j = k
            while j < len(above) and runs[above[j]][0] <= b:
                p, q = sorted((root(above[j]), root(i)))
                parent[q] = p
                j += 1
            now.append(i)
        above = now
    found: dict[int, list] = {}
    for i, (a, b, y) in enumerate(runs):
        found.setdefault(root(i), []).extend(((a, y), (b, y)))
    return [np.array(found[r], float) for r in sorted(found)]


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, one turn around it."""
    rows = sorted(set(map(tuple, points.tolist())))

    def half(run):
        out: list = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(rows) + half(rows[::-1]) if len(rows) > 1 else rows, float)


def smallest_rectangle(points: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(four corners, side, other side) of the rectangle of least area around points; one of its sides lies on the hull."""
    corners = hull(points)
    if len(corners) == 1:
        return np.repeat(corners, 4, 0), 0.0, 0.0
    along = np.roll(corners, -1, 0) - corners
    along /= np.hypot(*along.T)[:, None]
    across = np.stack([-along[:, 1], along[:, 0]], 1)
    u, v = corners @ along.T, corners @ across.T
    wide, high = np.ptp(u, 0), np.ptp(v, 0)
    k = int(np.argmin(wide * high))
    return _corners(along[k], across[k], u[:, k].min(), u[:, k].max(), v[:, k].min(), v[:, k].max()), float(wide[k]), float(high[k])


def _corners(along, across, u0, u1, v0, v1) -> np.ndarray:
    return np.array([u * along + v * across for u, v in ((u0, v0), (u1, v0), (u1, v1), (u0, v1))])


def grown(corners: np.ndarray, by: float) -> np.ndarray:
    """Whole-number points of a convex polygon, its corners cut to whole numbers, moved out by `by`: around each corner an arc from one side's normal to the next
    one's, in steps that leave ARC of a pixel at most (of `by`, where that is less than a pixel); points are rounded, halves away from zero."""
    p = np.trunc(corners).astype(np.int64)
    p = p[[i for i in range(len(p)) if (p[i] != p[i - 1]).any()]]
    if len(p) < 3:
        return np.trunc(corners[:1])
    x, y = p.T
    p = p if (x * np.roll(y, -1) - y * np.roll(x, -1)).sum() >= 0 else p[::-1]
    along = (np.roll(p, -1, 0) - p).astype(float)
    along /= np.hypot(*along.T)[:, None]
    out = np.stack([along[:, 1], -along[:, 0]], 1)
    full = min(math.pi / math.acos(1 - min(ARC, by * ARC) / by), by * math.pi)  # steps of a whole turn
    points = []
    for corner, a, b in zip(p, np.roll(out, 1, 0), out):
        sine, cosine = a[0] * b[1] - a[1] * b[0], float(a @ b)
        straight = abs(sine * by) < 1 and cosine > 0
        angle = math.atan2(min(1.0, max(-1.0, sine)), cosine)
        at = 0.0 if straight else math.tau / full * np.arange(max(1, math.floor(full / math.tau * abs(angle) + 0.5)))
        turned = np.stack([a[0] * np.cos(at) - a[1] * np.sin(at), a[0] * np.sin(at) + a[1] * np.cos(at)], -1).reshape(-1, 2)
        points += [corner + by * turned] + ([] if straight else [(corner + by * b)[None]])
    points = np.concatenate(points)
    if len(points) > MOST_POINTS:
        raise ValueError("an offset has too many points")
    return np.trunc(points + np.copysign(0.5, points))


def line_pixels(a: tuple[int, int], b: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of the 8-connected line between two pixels, drawn from left to right."""
    (x0, y0), (x1, y1) = sorted((a, b), key=lambda p: p[0]) if a[0] != b[0] else (a, b)
    wide, high = abs(x1 - x0), abs(y1 - y0)
    long, short = max(wide, high), min(wide, high)
    # the short side steps where the error term, which starts at long - 2 short and falls by 2 short a pixel, is below zero
    k = np.arange(long + 1, dtype=np.int64)
    minor = np.where(k == 0, 0, (2 * short * k + long - 1) // (2 * long)) if long else k
    sx, sy = (1 if x1 >= x0 else -1), (1 if y1 >= y0 else -1)
    major = k
    return (x0 + sx * major, y0 + sy * minor) if wide >= high else (x0 + sx * minor, y0 + sy * major)


def polygon_mask(height: int, width: int, polygon: np.ndarray) -> np.ndarray:
    """Pixels of a polygon of whole corners within the mask: its outline's lines, and on each row what lies between crossings of its edges, which run in
    steps of 2^-16 pixels."""
    mask = np.zeros((height, width), bool)
    corners = [tuple(map(int, p)) for p in polygon]
    crossings: list[list[int]] = [[] for _ in range(height)]
    for a, b in zip([corners[-1], *corners], corners):
        x, y = line_pixels(a, b)
        mask[y, x] = True
        if a[1] != b[1]:
            (xa, ya), (xb, yb) = (a, b) if a[1] < b[1] else (b, a)
            rise = ((b[0] - a[0]) << 16) / (b[1] - a[1])
            step = int(rise)  # cut towards zero
            for row in range(ya, yb):
                crossings[row].append((xa << 16) + (row - ya) * step)
    for row, xs in enumerate(crossings):
        xs.sort()
        for left, right in zip(xs[::2], xs[1::2]):
            mask[row, (left + 0xFFFF) >> 16 : (right >> 16) + 1] = True
    return mask


def mean_inside(scores: np.ndarray, corners: np.ndarray) -> float:
    """Mean of the scores in a polygon, borders included; corners are cut to whole pixels of the polygon's box. 0 if there is none."""
    h, w = scores.shape
    lo = np.clip(np.floor(corners.min(0)), 0, [w - 1, h - 1]).astype(int)
    hi = np.clip(np.ceil(corners.max(0)), 0, [w - 1, h - 1]).astype(int)
    p = np.clip(np.trunc(corners - lo).astype(int), 0, hi - lo)
    part = scores[lo[1] : hi[1] + 1, lo[0] : hi[0] + 1][polygon_mask(hi[1] - lo[1] + 1, hi[0] - lo[0] + 1, p)]
    return float(part.astype(float).sum() / len(part)) if len(part) else 0.0


def ordered(corners: np.ndarray) -> np.ndarray:
    """Top-left, top-right, bottom-right, bottom-left."""
    s = corners[np.argsort(corners[:, 0], kind="stable")]
    left, right = s[:2], s[2:]
    left = left if left[1, 1] > left[0, 1] else left[::-1]
    right = right if right[1, 1] > right[0, 1] else right[::-1]
    return np.array([left[0], right[0], right[1], left[1]])


def lines_of(scores: np.ndarray, src_h: int, src_w: int) -> list[tuple]:
    """Rows of SCHEMA of one map, the last component met first, 3,000 at most."""
    if not np.isfinite(scores).all() or (scores < 0).any() or (scores > 1).any():
        raise ValueError("a score is not from 0 to 1")
    h, w = scores.shape
    met = components(scores > ACTIVE)
    out = []
    for n in range(len(met) - 1, max(len(met) - 1 - MOST_CONTOURS, -1), -1):
        corners, a, b = smallest_rectangle(met[n])
        first = min(a, b)
        if first < FIRST_SIDE:
            out.append((n, STAGES[0], first, None, None, None))
            continue
        score = mean_inside(scores, corners)
        if score < SCORE_FLOOR:
            out.append((n, STAGES[1], first, score, None, None))
            continue
        wider, *sides = smallest_rectangle(grown(corners, a * b * UNCLIP / (2 * (a + b))))
        second = min(sides)
        if second < SECOND_SIDE:
            out.append((n, STAGES[2], first, score, second, None))
            continue
        quad = np.clip(np.rint(ordered(wider) / [w, h] * [src_w, src_h]), 0, [src_w, src_h]).astype(int)
        out.append((n, STAGES[3], first, score, second, [{"x": x, "y": y} for x, y in quad.tolist()]))
    return out


def detect(maps: DataFrame, key: str) -> DataFrame:
    """Contours of maps (key, map_h, map_w, src_h, src_w, scores: array of float by rows), each with the gate it stopped at or its quad.

    Rectangles are computed in doubles: a quad's corner may lie a pixel from that of an engine that works in singles.
    """
    kind = maps.schema[key].dataType.simpleString()
    names = [key, *(c.split()[0] for c in SCHEMA.split(", "))]

    def run(batches):
        for rows in batches:
            out = []
            for k, mh, mw, sh, sw, scores in rows[[key, "map_h", "map_w", "src_h", "src_w", "scores"]].itertuples(index=False, name=None):
                if len(scores) != mh * mw:
                    raise ValueError("a map has another number of scores")
                out += [(k, *r) for r in lines_of(np.asarray(scores, np.float32).reshape(mh, mw), sh, sw)]
            yield pd.DataFrame(out, columns=names)

    return maps.select(key, "map_h", "map_w", "src_h", "src_w", "scores").mapInPandas(run, f"{key} {kind}, {SCHEMA}")
