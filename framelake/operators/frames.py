"""Joins and diffs between consecutive frames of a stream. Frames are rows of observations (see sources.tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as G
from ..functions import texts as T
from .scan import each_group

#: Side of the cells in which boxes meet; candidates of a frame at most.
CELL, MOST_CANDIDATES = 128, 1_000_000
COLUMNS = ["obs_index", "x", "y", "w", "h", "txt", "role", "conf"]


def frame_numbers(obs: DataFrame) -> DataFrame:
    """Adds frame_no: 0, 1, ... over the frames of a stream."""
    return obs.withColumn("frame_no", (F.dense_rank().over(W.partitionBy("stream_no").orderBy("ts_ms")) - 1).cast("long"))


def frame_pairs(obs: DataFrame) -> DataFrame:
    """Every element of a frame (p_ columns) beside every element of the stream's next frame (n_ columns).

    All pairs of two frames, which are quadratic in a frame's elements; likely_pairs() has those that can match.
    """
    numbered = frame_numbers(obs)
    side = lambda p, shift: numbered.select("stream_no", (F.col("frame_no") + shift).alias("frame_no"), *(F.col(c).alias(p + c) for c in COLUMNS))
    return side("p_", 1).join(side("n_", 0), ["stream_no", "frame_no"])


def likely_pairs(obs: DataFrame, cell: int = CELL) -> DataFrame:
    """Those of frame_pairs() that overlap or whose texts are normally equal: no other pair can match.

    Boxes meet in the cells of a grid that they touch, texts by their key, both as equi-joins by (stream, frame): work follows the pairs
    found, not the square of a frame's elements. A pair that meets in several cells counts in the first that both touch.
    """
    # normal forms are made once an element, not once a pair
    numbered = frame_numbers(obs).withColumn("key", T.normalize(F.col("txt"))).withColumn("role_key", T.normalize(F.col("role")))
    side = lambda p, shift, *more: numbered.select("stream_no", (F.col("frame_no") + shift).alias("frame_no"), *(F.col(c).alias(p + c) for c in [*COLUMNS, "key", "role_key"]), *more)
    across = lambda low, size: F.sequence(F.floor(F.col(low) / cell), F.floor((F.col(low) + F.greatest(F.col(size), F.lit(1)) - 1) / cell))
    touched = F.explode(F.flatten(F.transform(across("x", "w"), lambda i: F.transform(across("y", "h"), lambda j: F.struct(i.alias("i"), j.alias("j")))))).alias("cell")
    met = side("p_", 1, touched).join(side("n_", 0, touched), ["stream_no", "frame_no", "cell"])
    first = lambda n: F.floor(F.greatest(F.col("p_" + n), F.col("n_" + n)) / cell)
    met = met.where((F.col("cell.i") == first("x")) & (F.col("cell.j") == first("y")) & (G.overlap("p_", "n_") > 0)).drop("cell")
    alike = side("p_", 1).where("p_key <> ''").join(side("n_", 0).withColumn("p_key", F.col("n_key")), ["stream_no", "frame_no", "p_key"]).where(G.overlap("p_", "n_") == 0)
    return met.unionByName(alike)


def match_scores(pairs: DataFrame, dx: int = 0, dy: int = 0) -> DataFrame:
    """Candidates of the active match: ordinary and translated overlap, score, and whether the pair is eligible. Normal forms of texts and roles
    (p_key, n_key, p_role_key, n_role_key) are taken from the pairs where they have them."""
    plain, moved = G.iou("p_", "n_"), G.iou("p_", "n_", dx, dy)
    known = "n_role_key" in pairs.columns
    same = lambda c: F.coalesce((F.col(f"p_{c}") == F.col(f"n_{c}")) & (F.col(f"p_{c}") != ""), F.lit(False))
    text, role = (same("key"), same("role_key")) if known else (T.normalized_equal(F.col("p_txt"), F.col("n_txt")), T.normalized_equal(F.col("p_role"), F.col("n_role")))
    scored = pairs.withColumn("iou", plain).withColumn("moved_iou", moved).withColumn("text_equal", text).withColumn("role_equal", role)
    score = F.lit(0.35) * F.greatest("iou", "moved_iou") + F.when(F.col("text_equal"), 0.6).otherwise(0.0) + F.when(F.col("role_equal"), 0.05).otherwise(0.0)
    eligible = (F.col("score") >= 0.3) & ((F.col("iou") > 0.1) | (F.col("text_equal") & (F.col("role_equal") | F.col("p_role").isNull() & F.col("n_role").isNull()) & (F.col("moved_iou") > 0.1)))
    return scored.withColumn("score", score).withColumn("eligible", eligible)


def greedy_assignment(candidates: DataFrame, group: list[str], left: str, right: str, order: list) -> DataFrame:
    """One-to-one assignment: candidates of a group in order, each taken if neither side is taken yet.

    order must be total; left and right are whole numbers. One pass over each group's candidates in their order.
    """

    def picked(c: dict) -> dict:
        if len(c[left]) > MOST_CANDIDATES:
            raise ValueError(f"more than {MOST_CANDIDATES} candidates")
        ls, rs, pairs = set(), set(), []
        for a, b in zip(c[left], c[right]):
            if a not in ls and b not in rs:
                ls.add(a)
                rs.add(b)
                pairs.append((a, b))
        return {"pick": range(len(pairs)), left: [a for a, _ in pairs], right: [b for _, b in pairs]}

    kinds = dict(candidates.dtypes)
    schema = ", ".join([*(f"{g} {kinds[g]}" for g in group), "pick bigint", f"{left} {kinds[left]}", f"{right} {kinds[right]}"])
    keyed = candidates.select(*group, left, right, F.row_number().over(W.partitionBy(*group).orderBy(*order)).alias("__rank"))
    return each_group(keyed, group, ["__rank"], [left, right, "__rank"], picked, schema)


def lost_matches(seen: DataFrame, lost: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Elements seen (keys, obs_index, box, txt, role) that may be lost ones (keys, element_no, box, txt, role) again: equal normal text and role, and an
    overlap of `least` at the place where they were lost; with overlap and score. An equi-join on the key, so common texts cost their own pairs only."""
    side = lambda rows, p, id: rows.withColumn("k", T.exact_key(F.col("txt"), F.col("role"))).where("k IS NOT NULL").select(*keys, F.col("k.text").alias("text_key"), F.coalesce("k.role", F.lit("")).alias("role_key"), id, *(F.col(c).alias(p + c) for c in "xywh"))
    both = side(seen, "n_", "obs_index").join(side(lost, "p_", "element_no"), [*keys, "text_key", "role_key"]).withColumn("overlap", G.iou("p_", "n_"))
    score = F.lit(0.35) * F.col("overlap") + F.lit(0.6) + F.when(F.col("role_key") != "", 0.05).otherwise(0.0)
    return both.where(F.col("overlap") >= least).select(*keys, "obs_index", "element_no", "overlap", score.alias("score"))


def arrivals(seen: DataFrame, going_on: DataFrame, returned: DataFrame, keys: list[str]) -> DataFrame:
    """What was seen (keys, obs_index) and goes on from no element of the frame before: with the lost element it is again (element_no), or as new (null)."""
    rest = seen.join(going_on.select(*keys, "obs_index"), [*keys, "obs_index"], "left_anti")
    return rest.join(returned.select(*keys, "obs_index", "element_no"), [*keys, "obs_index"], "left")


def near_regions(before: DataFrame, now: DataFrame, keys: list[str], by: int = 16) -> DataFrame:
    """Pairs of regions (before: keys, p_no, p_x, ...; now: keys, n_no, n_x, ...) that overlap once each is grown by `by`, with the area they share as
    they are and the squared distance of their doubled centres. Regions meet in the cells of a grid that the grown ones touch."""
    def touched(rows: DataFrame, p: str) -> DataFrame:
        x, y, w, h = (F.col(p + c) for c in "xywh")
        across = lambda low, size: F.sequence(F.floor(F.greatest(F.lit(0), low - by) / CELL), F.floor((low + size + by - 1) / CELL))
        cells = F.flatten(F.transform(across(x, w), lambda i: F.transform(across(y, h), lambda j: F.struct(i.alias("i"), j.alias("j")))))
        return rows.withColumn("cell", F.explode(cells))

    low = lambda p, c: F.greatest(F.lit(0), F.col(p + c) - by)
    first = lambda c: F.floor(F.greatest(low("p_", c), low("n_", c)) / CELL)
    both = touched(before, "p_").join(touched(now, "n_"), [*keys, "cell"]).where((F.col("cell.i") == first("x")) & (F.col("cell.j") == first("y")) & G.near("p_", "n_", by))
    return both.select(*keys, "p_no", "n_no", G.overlap("p_", "n_").alias("shared"), G.centre_distance2("p_", "n_").alias("apart"))


def unique_anchors(obs: DataFrame) -> DataFrame:
    """Pairs of elements in consecutive frames whose text occurs once in both frames, of compatible roles."""
    numbered = frame_numbers(obs).withColumn("key", T.normalize(F.col("txt"))).where("key <> ''")
    once = numbered.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("stream_no", "frame_no", "key"))).where("n = 1")
    side = lambda p, shift: once.select("stream_no", (F.col("frame_no") + shift).alias("frame_no"), "key", *(F.col(c).alias(p + c) for c in COLUMNS))
    both = side("p_", 1).join(side("n_", 0), ["stream_no", "frame_no", "key"])
    dx, dy = G.centre_shift("p_", "n_")
    return both.where(T.roles_compatible(F.col("p_role"), F.col("n_role"))).withColumn("dx", dx).withColumn("dy", dy)


def dominant_translation(anchors: DataFrame, width: int = 20, least: int = 3) -> DataFrame:
    """Per (stream, frame): the strongest bin of movements of unique anchors, and its upper medians."""
    binned = anchors.withColumn("bx", G.rounded_bin("dx", width)).withColumn("by", G.rounded_bin("dy", width))
    bins = binned.groupBy("stream_no", "frame_no", "bx", "by").agg(F.count(F.lit(1)).alias("support"), F.array_sort(F.collect_list("dx")).alias("xs"), F.array_sort(F.collect_list("dy")).alias("ys"))
    mid = lambda c: F.get(F.col(c), F.floor(F.size(c) / 2).cast("int"))
    best = bins.where(F.col("support") >= least).groupBy("stream_no", "frame_no").agg(
        F.max_by(F.struct("support", mid("xs").alias("dx"), mid("ys").alias("dy")), F.struct("support", -F.col("bx"), -F.col("by"))).alias("b"))
    return best.select("stream_no", "frame_no", "b.support", "b.dx", "b.dy")


def point_hits(points: DataFrame, obs: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, point_no, px, py) with how many elements of the frame hold them: none, one (its index) or ambiguous. A point meets the
    elements that touch its cell of a grid."""
    across = lambda low, size: F.sequence(F.floor(F.col(low) / CELL), F.floor((F.col(low) + F.greatest(F.col(size), F.lit(1)) - 1) / CELL))
    cells = F.flatten(F.transform(across("x", "w"), lambda i: F.transform(across("y", "h"), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    touched = obs.select(*keys, "obs_index", "x", "y", "w", "h", F.explode(cells).alias("cell"))
    own = points.withColumn("cell", F.struct(F.floor(F.col("px") / CELL).alias("i"), F.floor(F.col("py") / CELL).alias("j")))
    found = own.join(touched, [*keys, "cell"]).where(G.contains("", F.col("px"), F.col("py"))).groupBy(*keys, "point_no").agg(F.count(F.lit(1)).alias("n"), F.min("obs_index").alias("only"))
    out = points.join(found, [*keys, "point_no"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    state = F.when(F.col("n") == 0, "unassociated").when(F.col("n") == 1, "associated").otherwise("ambiguous")
    return out.select(*keys, "point_no", "n", state.alias("state"), F.when(F.col("n") == 1, F.col("only")).alias("obs_index"))


def element_versions(obs: DataFrame) -> DataFrame:
    """Elements keyed by (stream, normalised text, rank among equal texts in the frame), with their place in the
    frame before, flags (is it new, does it end after this frame), and the next frame's time.

    All windows are by stream or by more than that, so one exchange by stream serves them.
    """
    numbered = frame_numbers(obs).withColumn("key", T.normalize(F.col("txt"))).withColumn("conf", T.quantized(F.col("conf")))
    rank = F.row_number().over(W.partitionBy("stream_no", "frame_no", "key").orderBy("obs_index"))
    own = W.partitionBy("stream_no", "key", "rank").orderBy("frame_no")
    later = F.first("ts_ms").over(W.partitionBy("stream_no").orderBy("frame_no").rangeBetween(1, 1))
    rows = numbered.withColumn("next_ms", later).withColumn("rank", rank.cast("long"))
    before = F.lag(F.struct("frame_no", "x", "y", "conf")).over(own)
    rows = rows.withColumn("before", before).withColumn("next_frame", F.lead("frame_no").over(own))
    follows = F.coalesce(F.col("before.frame_no") == F.col("frame_no") - 1, F.lit(False))
    return rows.withColumn("follows", follows).withColumn("ends", F.col("next_ms").isNotNull() & ~F.coalesce(F.col("next_frame") == F.col("frame_no") + 1, F.lit(False)))


def _changes(obs: DataFrame, snapshot: bool) -> DataFrame:
    """The change log, each row's events made from the row itself; snapshot: with the first frame's elements."""
    now, origin = F.struct("frame_no", "ts_ms"), F.struct(F.col("before.x").alias("x"), F.col("before.y").alias("y"))
    later, none = F.struct((F.col("frame_no") + 1).alias("frame_no"), F.col("next_ms").alias("ts_ms")), F.lit(None).cast("struct<x:bigint,y:bigint>")
    event = lambda name, when, at, was: F.when(when, F.struct(F.lit(name).alias("type"), at.alias("at"), was.alias("was")))
    first = F.col("frame_no") == 0
    events = F.array_compact(F.array(
        event("snapshot", first & F.lit(snapshot), now, none), event("appeared", ~F.col("follows") & ~first, now, none),
        event("moved", F.col("follows") & ((F.col("x") != F.col("before.x")) | (F.col("y") != F.col("before.y"))), now, origin),
        event("content_changed", F.col("follows") & ~F.col("conf").eqNullSafe(F.col("before.conf")), now, none), event("disappeared", F.col("ends"), later, none),
    ))
    rows = element_versions(obs).withColumn("events", events).where(F.size("events") > 0)
    return rows.select("stream_no", "key", "rank", "x", "y", "conf", F.explode("events").alias("e")).select(
        "stream_no", F.col("e.at.frame_no").alias("frame_no"), "key", "rank", "x", "y", "conf", "e.type", F.col("e.at.ts_ms").alias("ts_ms"),
        F.col("e.was.x").alias("from_x"), F.col("e.was.y").alias("from_y"),
    )


def frame_diff(obs: DataFrame) -> DataFrame:
    """The change log of a stream: per frame from the second on, what disappeared, appeared, moved or changed.

    One pass over the elements instead of a full outer join of frames: every row knows whether the element was in the
    frame before and whether it is in the next.
    """
    return _changes(obs, False).drop("from_x", "from_y")


PHASE = {"snapshot": 0, "disappeared": 1, "moved": 2, "content_changed": 3, "appeared": 4}


def sequenced(log: DataFrame) -> DataFrame:
    """Adds sequence: 0, 1, ... per stream in the order of time, type of event, key and rank."""
    phase = F.create_map(*(F.lit(x) for kv in PHASE.items() for x in kv))[F.col("type")]
    order = W.partitionBy("stream_no").orderBy("ts_ms", phase, "key", "rank")
    return log.withColumn("sequence", (F.row_number().over(order) - 1).cast("long"))


def event_log(obs: DataFrame, origins: bool = False) -> DataFrame:
    """frame_diff() with the first frame's elements as snapshot rows, in sequence; origins: with where moves began (from_x, from_y)."""
    log = sequenced(_changes(obs, True))
    return log if origins else log.drop("from_x", "from_y")
