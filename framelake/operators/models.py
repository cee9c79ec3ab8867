"""Stages around text models that are handed in: pages to tensors, maps to lines, lines to texts, all as DataFrames.

A model is a function of a float32 array. It is pickled into the stage (or a function that makes it, see `made`), called by
batches in Arrow, and never sees more than one batch. No model is part of this library.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import detector as D
from ..functions import geometry as G
from ..functions import texts as X
from . import detection

# Scale, mean and deviation of a detector's channels; a line's height, and the range its values lie in; sizes and lanes.
SCALE, MEAN, DEVIATION = np.float32(1 / 255), np.array([0.485, 0.456, 0.406], np.float32), np.array([0.229, 0.224, 0.225], np.float32)
SEAM_HEIGHT, SEAM_RANGE, MOST_SIDE, MOST_ASPECT, MOST_LANES = 64, 0.5, 16_384, 256, 4
_ready: dict = {}


def made(model, key: str):
    """model, or what model.make() gives, once a worker."""
    if not hasattr(model, "make"):
        return model
    if key not in _ready:
        _ready[key] = model.make()
    return _ready[key]


def checked_page(luma: bytes | None, width: int, height: int) -> np.ndarray:
    """A page's pixels (rows, columns). An error where they aren't as many as its sides say, or its sides are out of bounds."""
    if width is None or height is None or not (0 < width <= MOST_SIDE and 0 < height <= MOST_SIDE) or -(-max(width, height) // min(width, height)) > MOST_ASPECT:
        raise ValueError("a page's sides are out of bounds")
    if luma is None or len(luma) != width * height:
        raise ValueError("a page has another number of pixels")
    return np.frombuffer(luma, np.uint8).reshape(height, width)


def resized(plane: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """plane (float32) in another size: bilinear, pixels' centres aligned, borders repeated."""
    out = plane.astype(np.float32)
    for axis, n in enumerate(shape):
        m = out.shape[axis]
        at = np.clip((np.arange(n, dtype=np.float32) + np.float32(0.5)) * np.float32(m / n) - np.float32(0.5), 0, m - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1)).astype(np.float32)
        out = np.take(out, low, axis) * (1 - part) + np.take(out, np.minimum(low + 1, m - 1), axis) * part
    return out


def page_tensor(plane: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """(1, 3, height, width): the page in that size, each channel scaled, less its mean, over its deviation, in singles."""
    small = resized(plane, shape)
    return np.stack([(small * SCALE - m) / d for m, d in zip(MEAN, DEVIATION)])[None].astype(np.float32)


def score_maps(pages: DataFrame, key: str, model: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Maps for detection.detect() of pages (key, width, height, luma: binary): the model's scores of page_tensor() at the detector's input shape.

    The model gives (1, 1, height, width); another shape, or a score that isn't from 0 to 1, is an error.
    """
    h, w = D.input_shape(F.col("height").cast("long"), F.col("width").cast("long"))
    sized = pages.select(key, F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "luma", h.cast("int").alias("map_h"), w.cast("int").alias("map_w"))
    schema = T.StructType([sized.schema[key], *(T.StructField(c, T.IntegerType()) for c in ("map_h", "map_w", "src_h", "src_w")), T.StructField("scores", T.ArrayType(T.FloatType()))])

    def run(batches):
        own = made(model, "detector")
        for batch in batches:
            for i in range(len(batch)):
                _, wide, high, luma, mh, mw = (c[i].as_py() for c in batch.columns)
                plane = checked_page(luma, wide, high)
                if mh is None:
                    raise ValueError("a page is too large for the detector")
                scores = np.asarray(own(page_tensor(plane, (mh, mw))), np.float32)
                if scores.shape != (1, 1, mh, mw) or not np.isfinite(scores).all() or scores.min() < 0 or scores.max() > 1:
                    raise ValueError("the detector gave another shape, or a score that is not from 0 to 1")
                flat = pa.ListArray.from_arrays(pa.array([0, mh * mw], pa.int32()), pa.array(scores.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([v], pa.int32()) for v in (mh, mw, high, wide)), flat], schema.names)

    return sized.mapInArrow(run, schema)


def seam(plane: np.ndarray, quad: list[tuple[float, float]]) -> np.ndarray:
    """A line's pixels, SEAM_HEIGHT rows: the quad (top-left, top-right, bottom-right, bottom-left) made upright, bilinear, values less a half of their range."""
    q = np.asarray(quad, np.float64)
    if q.shape != (4, 2) or not np.isfinite(q).all():
        raise ValueError("a quad needs four finite corners")
    wide, high = (max(np.hypot(*(q[a] - q[b])), np.hypot(*(q[c] - q[d]))) for a, b, c, d in ((1, 0, 2, 3), (3, 0, 2, 1)))
    columns = max(1, int(np.ceil(wide * SEAM_HEIGHT / max(high, 1.0))))
    u, v = (np.arange(columns) + 0.5) / columns, (np.arange(SEAM_HEIGHT) + 0.5) / SEAM_HEIGHT
    top, bottom = q[0] + u[:, None] * (q[1] - q[0]), q[3] + u[:, None] * (q[2] - q[3])
    at = top[None] + v[:, None, None] * (bottom - top)[None] - 0.5
    h, w = plane.shape
    x, y = np.clip(at[..., 0], 0, w - 1), np.clip(at[..., 1], 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1, fx, fy = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1), x - x0, y - y0
    p = plane.astype(np.float64)
    value = (p[y0, x0] * (1 - fx) + p[y0, x1] * fx) * (1 - fy) + (p[y1, x0] * (1 - fx) + p[y1, x1] * fx) * fy
    return (value / 255 - 0.5).astype(np.float32)


def checked_seam(values: np.ndarray) -> np.ndarray:
    """An error where a seam isn't SEAM_HEIGHT rows of finite values in its range."""
    if values.ndim != 2 or values.shape[0] != SEAM_HEIGHT or not values.shape[1] or not np.isfinite(values).all() or abs(values).max() > SEAM_RANGE:
        raise ValueError("a seam's shape or values are out of bounds")
    return values


def line_tensor(values: np.ndarray) -> tuple[np.ndarray, bool]:
    """(1, 3, height, width) of a seam for the recogniser, padded with zeros on the right to its batch width; and whether the width was cut at the most it takes."""
    checked_seam(values)
    wide = -(-values.shape[1] * D.LINE_HEIGHT // values.shape[0])
    cut = min(wide, D.MOST_WIDTH)
    out = np.zeros((1, 3, D.LINE_HEIGHT, max(D.LEAST_WIDTH, cut)), np.float32)
    out[:, :, :, :cut] = resized(values, (D.LINE_HEIGHT, cut)) * np.float32(2)
    return out, wide > cut


def lanes(items: int, count: int) -> list[list[int]]:
    """Which items each of count lanes handles: item i goes to lane i % count."""
    if not 1 <= count <= MOST_LANES:
        raise ValueError(f"from one to {MOST_LANES} lanes")
    return [list(range(k, items, count)) for k in range(count)]


def reconciled(records: list[list[tuple[int, object]]], items: int) -> list:
    """What lanes returned, in the items' order. An item of another lane, out of range, there twice or missing is an error."""
    out: dict = {}
    for lane, rows in enumerate(records):
        for i, value in rows:
            if i % len(records) != lane or not 0 <= i < items or i in out:
                raise ValueError(f"lane {lane} returned item {i} wrongly")
            out[i] = value
    if len(out) != items:
        raise ValueError("an item is missing")
    return [out[i] for i in range(items)]


def recognised(lines: DataFrame, pages: DataFrame, key: str, model: Callable[[np.ndarray], np.ndarray], labels: list[str]) -> DataFrame:
    """lines (key, line_no, quad, score) with raw_text, steps (of the model's output), input_width and capped (its width was cut).

    The model gives (1, steps, classes), blank and labels. Lines of a page are one group; Spark's tasks are the lanes, and line_no keeps the order.
    """
    crops = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "quad", F.col("score").cast("double").alias("score")))).alias("lines"))
    rows = pages.select(key, F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "luma").join(crops, key)
    out = T.StructType([rows.schema[key], T.StructField("line_no", T.LongType()), T.StructField("quad", rows.schema["lines"].dataType.elementType["quad"].dataType), T.StructField("score", T.DoubleType()),
                        T.StructField("raw_text", T.StringType()), T.StructField("steps", T.IntegerType()), T.StructField("input_width", T.IntegerType()), T.StructField("capped", T.BooleanType())])
    at = {n: i for i, n in enumerate(rows.columns)}

    def run(batches):
        own, words = made(model, "recogniser"), ["", *labels]
        for batch in batches:
            for i in range(len(batch)):
                plane = checked_page(batch.column(at["luma"])[i].as_py(), batch.column(at["width"])[i].as_py(), batch.column(at["height"])[i].as_py())
                made_rows, mine = [], batch.column(at["lines"])[i].as_py()
                for line in mine:
                    tensor, capped = line_tensor(seam(plane, [(p["x"], p["y"]) for p in line["quad"]]))
                    scores = np.asarray(own(tensor), np.float32)
                    if scores.ndim != 3 or scores.shape[0] != 1 or scores.shape[2] != len(words) or not np.isfinite(scores).all():
                        raise ValueError("the recogniser gave another shape, or a score that is not finite")
                    best = scores[0].argmax(axis=1)
                    new = best[(best != 0) & (best != np.concatenate(([0], best[:-1])))]
                    made_rows.append(("".join(words[k] for k in new), len(best), tensor.shape[3], capped))
                lists = batch.column(at["lines"]).slice(i, 1).flatten()
                fields = [lists.field(k) for k in ("line_no", "quad", "score")]
                texts = [pa.array(c, k) for c, k in zip(zip(*made_rows), (pa.string(), pa.int32(), pa.int32(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(at[key])[i], len(mine)), fields[0].cast(pa.int64()), *fields[1:], *texts], out.names)

    return rows.mapInArrow(run, out)


def observations(lines: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Lines with what becomes of them: disposition (missing, geometry_clamp, text_filter, emitted), and for those emitted obs_index, x, y, w, h, txt, role and conf.

    A line's box is its quad's, rounded outwards and cut to the page; its confidence the detector's score (0.5 without one).
    """
    xs, ys = F.transform("quad", lambda p: p["x"]), F.transform("quad", lambda p: p["y"])
    low, high = lambda a: F.floor(F.array_min(a)).cast("long"), lambda a: F.ceil(F.array_max(a)).cast("long")
    rows = lines.join(pages.select(key, F.col("width").cast("long").alias("fw"), F.col("height").cast("long").alias("fh")), key)
    box = G.clamped(low(xs), low(ys), high(xs) - low(xs), high(ys) - low(ys))
    rows = rows.select("*", *(c.alias(n) for n, c in box.items()))
    state = X.line_disposition(F.col("raw_text"), (F.col("w") > 0) & (F.col("h") > 0))
    rows = rows.withColumn("disposition", state).withColumn("emitted", F.col("disposition") == "emitted")
    place = F.when(F.col("emitted"), F.sum(F.col("emitted").cast("long")).over(W.partitionBy(key).orderBy("line_no")) - 1)
    return rows.select(
        key, "line_no", "raw_text", "disposition", place.alias("obs_index"), *(F.when(F.col("emitted"), F.col(c)).alias(c) for c in "xywh"),
        F.when(F.col("emitted"), X.trimmed(F.col("raw_text"))).alias("txt"), F.when(F.col("emitted"), F.lit("text")).alias("role"),
        F.when(F.col("emitted"), F.coalesce(F.col("score"), F.lit(0.5))).alias("conf"), "steps", "input_width", "capped",
    )


def read_pages(pages: DataFrame, key: str, detector: Callable, recogniser: Callable, labels: list[str]) -> DataFrame:
    """The whole way: pages (key, width, height, luma) to observations(), through a detector and a recogniser that are handed in."""
    found = detection.detect(score_maps(pages, key, detector), key).where("quad IS NOT NULL")
    lines = found.withColumn("line_no", (F.row_number().over(W.partitionBy(key).orderBy(F.desc("contour_no"))) - 1).cast("long")).select(key, "line_no", "quad", "score")
    return observations(recognised(lines, pages, key, recogniser, labels), pages, key)


def geometry_bits(lines: DataFrame, key: str) -> DataFrame:
    """Each corner's coordinates (x, y, corner by corner) as the bits of single-precision numbers, unsigned: for comparing engines exactly."""
    out = T.StructType([lines.schema[key], T.StructField("line_no", T.LongType()), T.StructField("bits", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            bits = [np.array([v for p in quad for v in (p["x"], p["y"])], np.float32).view(np.uint32).tolist() for quad in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(bits, pa.list_(pa.int64()))], out.names)

    return lines.select(key, "line_no", "quad").mapInArrow(run, out)


def profile(read: DataFrame, key: str) -> DataFrame:
    """Per page: lines and what became of them, model calls, input pixels, the widest input, capped lines, steps, and the area emitted."""
    is_ = lambda s: F.count_if(F.col("disposition") == s)
    return read.groupBy(key).agg(
        F.count(F.lit(1)).alias("lines"), is_("emitted").alias("emitted"), is_("geometry_clamp").alias("dropped_by_geometry"), is_("text_filter").alias("dropped_by_text"), F.count("steps").alias("calls"),
        F.coalesce(F.sum(F.col("input_width").cast("long") * (3 * D.LINE_HEIGHT)), F.lit(0)).alias("input_pixels"), F.max("input_width").alias("widest"), F.count_if(F.coalesce("capped", F.lit(False))).alias("capped"),
        F.coalesce(F.sum("steps"), F.lit(0)).alias("steps"), F.coalesce(F.sum(F.col("w") * F.col("h")), F.lit(0)).alias("emitted_area"),
    )
