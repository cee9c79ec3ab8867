"""Motion of a stream's frames: corners of the quarter-size frame, matched forth and back by census descriptors, and what they agree on.

Which frames are compared depends on their times and sizes alone, so that is decided on those columns; the frames themselves are
made small where they are read, and each comparison is a row by itself. Only small frames are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import detector as D
from .planes import census_plane
from .scan import each_group

# Fixed values.
INTERVAL_MS, BY, RADIUS, SEARCH, CELL, MOST_ANCHORS, LEAST_CORNER = 250, 4, 3, 24, 24, 1_024, 12
MOST_DISTANCE, LEAST_MARGIN, TOLERANCE, APART = 12, 3, 1, 16
MOST_WIDTH, MOST_HEIGHT = 7_680, 4_320
REJECTIONS = ("forward_distance", "forward_uniqueness", "reverse_distance", "reverse_uniqueness", "reverse_consistency")
_FAR = 255


def quarter(luma: np.ndarray) -> np.ndarray:
    """Means of 4 x 4 boxes, cut to whole numbers; boxes at the right and lower edge may be smaller."""
    h, w = luma.shape
    total = np.add.reduceat(np.add.reduceat(luma.astype(np.int64), range(0, h, BY), 0), range(0, w, BY), 1)
    rows, cols = (np.diff([*range(0, n, BY), n]) for n in (h, w))
    return (total // (rows[:, None] * cols[None, :])).astype(np.uint8)


def anchors(luma: np.ndarray) -> np.ndarray:
    """(y, x) of the best corner of each cell, cells row by row: highest score, then smaller y, then smaller x. Cells grow until there are MOST_ANCHORS
    at most; corners keep the search window inside the frame."""
    h, w = luma.shape
    margin = RADIUS + SEARCH
    if w <= 2 * margin or h <= 2 * margin:
        return np.zeros((0, 2), np.int64)
    high, wide, cell = h - 2 * margin, w - 2 * margin, CELL
    while -(-wide // cell) * -(-high // cell) > MOST_ANCHORS:
        cell += 1
    v = luma.astype(np.int64)
    inner = lambda dy, dx: v[margin + dy : h - margin + dy, margin + dx : w - margin + dx]
    score = np.minimum(abs(inner(0, 1) - inner(0, -1)), abs(inner(1, 0) - inner(-1, 0)))
    y, x = np.mgrid[0:high, 0:wide]
    of = (y // cell * -(-wide // cell) + x // cell).ravel()
    order = np.lexsort((x.ravel(), y.ravel(), -score.ravel(), of))
    best = order[np.unique(of[order], return_index=True)[1]]
    best = best[score.ravel()[best] >= LEAST_CORNER]
    return np.stack((y.ravel()[best] + margin, x.ravel()[best] + margin), 1)


def ranked(needles: np.ndarray, field: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, distance, margin) of each needle's closest descriptor in the window around its centre, the first by (y, x) of equal ones. The margin is to the
    closest one that doesn't touch the best's place."""
    h, w = field.shape
    step = np.arange(-SEARCH, SEARCH + 1)
    dy, dx = (g.ravel() for g in np.meshgrid(step, step, indexing="ij"))
    place, distance, margin = np.zeros((len(needles), 2), np.int64), np.zeros(len(needles), np.int64), np.zeros(len(needles), np.int64)
    for s in range(0, len(needles), 256):
        y, x = centres[s : s + 256, :1] + dy, centres[s : s + 256, 1:] + dx
        inside = (y >= RADIUS) & (y < h - RADIUS) & (x >= RADIUS) & (x < w - RADIUS)
        d = np.bitwise_count(field[np.where(inside, y, 0), np.where(inside, x, 0)] ^ needles[s : s + 256, None]).astype(np.int64)
        d[~inside] = _FAR
        best, row = d.argmin(axis=1), np.arange(len(d))
        by, bx = y[row, best], x[row, best]
        place[s : s + 256], distance[s : s + 256] = np.stack((by, bx), 1), d[row, best]
        d[(abs(y - by[:, None]) <= 1) & (abs(x - bx[:, None]) <= 1)] = _FAR
        margin[s : s + 256] = d.min(axis=1) - distance[s : s + 256]
    return place, distance, margin


def correspondences(before: np.ndarray, now: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Corners of before that lead to a place of now and back: source_y, source_x, destination_y, destination_x, distances and margins; and how many were
    turned down by each of REJECTIONS, the first that applies."""
    source = anchors(before)
    field = [census_plane(p.astype(np.int64), RADIUS) for p in (before, now)]
    place, distance, margin = ranked(field[0][source[:, 0], source[:, 1]], field[1], source)
    back, back_distance, back_margin = ranked(field[1][place[:, 0], place[:, 1]], field[0], place)
    fails = np.stack((
        distance > MOST_DISTANCE, margin < LEAST_MARGIN, back_distance > MOST_DISTANCE, back_margin < LEAST_MARGIN, (abs(back - source) > TOLERANCE).any(axis=1),
    ))
    kept = ~fails.any(axis=0)
    turned = np.bincount(fails.argmax(axis=0)[~kept], minlength=len(REJECTIONS))
    values = (*source[kept].T, *place[kept].T, distance[kept], margin[kept], back_distance[kept], back_margin[kept])
    return dict(zip(("source_y", "source_x", "destination_y", "destination_x", "forward_distance", "forward_margin", "reverse_distance", "reverse_margin"), values)), turned


def translation(dy: np.ndarray, dx: np.ndarray) -> tuple[int, int, int, np.ndarray] | None:
    """(dy, dx, support, members) of the dominant movement of more than a pixel: clusters by halves rounded down; most members, then the larger movement,
    then the smaller cluster; lower medians."""
    moved = np.nonzero((abs(dy) > 1) | (abs(dx) > 1))[0]
    clusters: dict = {}
    for i in moved.tolist():
        clusters.setdefault((int(dy[i]) // 2, int(dx[i]) // 2), []).append(i)
    found = []
    for key, members in clusters.items():
        middle = (len(members) - 1) // 2
        y, x = int(np.sort(dy[members])[middle]), int(np.sort(dx[members])[middle])
        found.append((-len(members), -(y * y + x * x), key, y, x, members))
    if not found:
        return None
    n, _, _, y, x, members = min(found, key=lambda f: f[:3])
    return y, x, -n, np.array(members)


def residual(before: np.ndarray, now: np.ndarray, dy: int, dx: int) -> tuple[int, int]:
    """Pixels that differ by more than APART both from their place and from where the movement leads, of those that it leaves in the frame."""
    h, w = before.shape
    ys, ye, xs, xe = max(0, -dy), min(h, now.shape[0] - dy), max(0, -dx), min(w, now.shape[1] - dx)
    if ys >= ye or xs >= xe:
        return 0, 0
    was = before[ys:ye, xs:xe].astype(np.int64)
    still, moved = now[ys:ye, xs:xe], now[ys + dy : ye + dy, xs + dx : xe + dx]
    return int(((abs(was - still) > APART) & (abs(was - moved) > APART)).sum()), was.size


def compared(before: np.ndarray, now: np.ndarray, width: int, height: int) -> dict:
    """What a comparison of two quarter frames of one size finds; width and height are the whole frame's."""
    found, turned = correspondences(before, now)
    dy, dx = found["destination_y"] - found["source_y"], found["destination_x"] - found["source_x"]
    eligible, accepted = len(dy) + int(turned.sum()), len(dy)
    out = {"eligible": eligible, "accepted": accepted, **dict(zip(REJECTIONS, turned.tolist())), "survival_ppm": accepted * 1_000_000 // eligible if eligible else 0}
    out |= {"stationary": int(((abs(dy) <= 1) & (abs(dx) <= 1)).sum()), "anchors": eligible}
    move = translation(dy, dx)
    if move:
        y, x, support, members = move
        top, left = (int(found[c][members].min()) * BY for c in ("destination_y", "destination_x"))
        bottom = min((int(found["destination_y"][members].max()) + 1) * BY, height)
        right = min((int(found["destination_x"][members].max()) + 1) * BY, width)
        off, of = residual(before, now, y, x)
        out |= {"support": support, "dx": x, "dy": y, "x": left, "y": top, "w": right - left, "h": bottom - top, "residual": off, "residual_of": of, "residual_ppm": off * 1_000_000 // of if of else None}
    out["matches"] = [dict(zip(found, map(int, row))) for row in zip(*found.values())]
    return out


_LONGS = ["eligible", "accepted", *REJECTIONS, "survival_ppm", "stationary", "support", "dx", "dy", "x", "y", "w", "h", "residual", "residual_of", "residual_ppm"]
_MATCH = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("source_y", "source_x", "destination_y", "destination_x", "forward_distance", "forward_margin", "reverse_distance", "reverse_margin")]))


def _small(planes: DataFrame) -> DataFrame:
    """planes (stream_no, ts_ms, width, height, luma) with the quarter frame's bytes in place of luma."""

    def run(batches):
        for batch in batches:
            small = []
            for w, h, luma in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if not (0 < w <= MOST_WIDTH and 0 < h <= MOST_HEIGHT) or luma is None or len(luma) != w * h:
                    raise ValueError("a frame's size is out of bounds, or it has another number of pixels")
                small.append(quarter(np.frombuffer(luma, np.uint8).reshape(h, w)).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(small, pa.binary())], ["stream_no", "ts_ms", "width", "height", "small"])

    return planes.select(F.col("stream_no").cast("long").alias("stream_no"), F.col("ts_ms").cast("long").alias("ts_ms"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "luma").mapInArrow(
        run, "stream_no long, ts_ms long, width int, height int, small binary")


def schedule(frames: DataFrame, interval_ms: int = INTERVAL_MS) -> DataFrame:
    """(stream_no, ts_ms, from_ms, disposition, resized) of frames (stream_no, ts_ms, width, height): skipped_interval, initialized (a stream's first frame, or one of
    another quarter size), or null for a frame that is compared with that of from_ms. Times of a stream must increase."""

    def judged(c: dict) -> dict:
        out, last = {"ts_ms": [], "from_ms": [], "disposition": [], "resized": []}, None
        before = None
        for ts, w, h in zip(*(map(int, c[k]) for k in ("ts_ms", "width", "height"))):
            if before is not None and ts <= before:
                raise ValueError("display times must increase")
            before, size = ts, (-(-w // BY), -(-h // BY))
            resized = last is not None and last[1] != size
            skipped = last is not None and not resized and ts - last[0] < interval_ms
            first = last is None or resized
            out["ts_ms"].append(ts)
            out["from_ms"].append(None if first or skipped else last[0])
            out["disposition"].append("skipped_interval" if skipped else "initialized" if first else None)
            out["resized"].append(resized)
            last = last if skipped else (ts, size)
        return out

    return each_group(frames, ["stream_no"], ["ts_ms"], ["ts_ms", "width", "height"], judged, f"stream_no {dict(frames.dtypes)['stream_no']}, ts_ms bigint, from_ms bigint, disposition string, resized boolean")


def observed(planes: DataFrame, interval_ms: int = INTERVAL_MS) -> DataFrame:
    """A row a frame of planes (stream_no, ts_ms, width, height, luma: binary, row by row): how it was handled (disposition) and, where it was
    compared, what was found: counts, the dominant translation in quarter pixels, its support's box in whole ones, residual, and matches."""
    small = _small(planes)
    plan = schedule(small.select("stream_no", "ts_ms", "width", "height"), interval_ms)
    used = small.join(plan, ["stream_no", "ts_ms"])
    selected = used.where("disposition IS NULL OR disposition = 'initialized'")
    pairs = selected.withColumn("before", F.lag("small").over(W.partitionBy("stream_no").orderBy("ts_ms"))).where("disposition IS NULL")
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("stream_no", "ts_ms", *_LONGS)), T.StructField("matches", _MATCH)])

    def run(batches):
        for batch in batches:
            rows = []
            for stream, ts, w, h, before, now in zip(*(c.to_pylist() for c in batch.columns)):
                shape = (-(-h // BY), -(-w // BY))
                rows.append({"stream_no": stream, "ts_ms": ts} | compared(*(np.frombuffer(x, np.uint8).reshape(shape) for x in (before, now)), w, h))
            kinds = [*(pa.int64() for _ in schema.fields[:-1]), pa.list_(pa.struct([(f.name, pa.int32()) for f in _MATCH.elementType.fields]))]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], k) for f, k in zip(schema.fields, kinds)], schema.names)

    found = pairs.select("stream_no", "ts_ms", "width", "height", "before", "small").mapInArrow(run, schema)
    rows = plan.join(small.select("stream_no", "ts_ms", "width", "height"), ["stream_no", "ts_ms"]).join(found, ["stream_no", "ts_ms"], "left")
    verdict = D.motion_verdict(*(F.col(c) for c in ("eligible", "accepted", "survival_ppm", "stationary", "support", "dx", "dy", "residual_ppm")))
    return rows.withColumn("disposition", F.coalesce("disposition", verdict))


def motions(found: DataFrame) -> DataFrame:
    """(stream_no, ts_ms, from_ms, x, y, w, h, dx, dy) in whole pixels of the coherent translations: what becomes an activity event."""
    return found.where("disposition = 'coherent_translation'").select("stream_no", "ts_ms", "from_ms", "x", "y", "w", "h", *((F.col(c) * BY).alias(c) for c in ("dx", "dy")))


def run_metrics(found: DataFrame) -> DataFrame:
    """Per stream: frames, resets by a new size, frames by disposition, sums over comparisons, and the most bytes that a frame kept for the next
    comparison can hold (its quarter pixels, their descriptors, its corners)."""
    states = ("initialized", "skipped_interval", "insufficient_support", "stationary", "coherent_translation", "ambiguous_motion")
    small = F.ceil(F.col("width") / BY) * F.ceil(F.col("height") / BY)
    return found.groupBy("stream_no").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if("resized").alias("resets"), *(F.count_if(F.col("disposition") == s).alias(f"{s}_frames") for s in states), F.count("eligible").alias("comparisons"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_total") for c in ("eligible", "accepted", *REJECTIONS, "stationary", "support")),
        F.max(F.when(F.col("disposition") != "skipped_interval", small * 9 + F.lit(8 * MOST_ANCHORS))).alias("most_bytes"),
    )
