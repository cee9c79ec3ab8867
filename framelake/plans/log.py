"""The event log as one sequence: activity beside structural events, what each row finds before it, errors, and the view at a time.

Rows have stream_no, sequence, ts_ms, type (snapshot, appeared, moved, content_changed, disappeared, resized, activity), element_no,
x, y, w, h, txt, role, conf; from_x, from_y, from_w, from_h (where a move began; from_w and from_h: the size before a resize); fw, fh (of a
snapshot or resize); from_ms, kind, dx, dy (of activity). A snapshot is a row for each element under one sequence (one without
elements is a row without element_no); every other event is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

COLUMNS = {
    "stream_no": "bigint", "ts_ms": "bigint", "type": "string", "element_no": "bigint", "x": "bigint", "y": "bigint", "w": "bigint", "h": "bigint", "txt": "string", "role": "string",
    "conf": "float", "from_x": "bigint", "from_y": "bigint", "from_w": "bigint", "from_h": "bigint", "fw": "bigint", "fh": "bigint", "from_ms": "bigint", "kind": "string", "dx": "bigint", "dy": "bigint",
}
LIFE = ("snapshot", "appeared", "disappeared")
RECENT_MS = 1000
_OWN = ["stream_no", "epoch", "element_no"]


def widened(rows: DataFrame) -> DataFrame:
    """rows with all columns of a log; those it lacks are null. Other columns pass through."""
    return rows.select(*(F.col(c).cast(k).alias(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in COLUMNS.items()), *(c for c in rows.columns if c not in COLUMNS))


def with_activity(structural: DataFrame, activity: DataFrame) -> DataFrame:
    """One sequence: by time; at one time activity comes first (it is about what was there before the frame), in the order of its ordinal."""
    both = widened(activity.withColumn("type", F.lit("activity"))).withColumn("__phase", F.lit(0)).withColumn("__order", F.col("ordinal").cast("long")).drop("ordinal")
    rest = widened(structural).withColumn("__phase", F.lit(1)).withColumn("__order", F.col("sequence").cast("long")).drop("sequence")
    names = [*COLUMNS, "__phase", "__order"]
    place = F.dense_rank().over(W.partitionBy("stream_no").orderBy("ts_ms", "__phase", "__order")) - 1
    return both.select(*names).union(rest.select(*names)).withColumn("sequence", place.cast("long")).select("sequence", *COLUMNS)


def activity_kinds(activity: DataFrame) -> DataFrame:
    """Activity of a boundary (stream_no, ts_ms) in its order: translations, then elements by number, each element once; adds ordinal."""
    first = F.row_number().over(W.partitionBy("stream_no", "ts_ms", "kind", "element_no").orderBy("from_ms"))
    once = activity.withColumn("__first", first).where("kind <> 'element_region_changed' OR __first = 1").drop("__first")
    order = W.partitionBy("stream_no", "ts_ms").orderBy(F.col("kind") == "element_region_changed", "element_no")
    return once.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))


def with_before(log: DataFrame) -> DataFrame:
    """Adds what each row finds: epoch (sequence of the last snapshot at or before it), frame (size in force before it), alive (is its element
    there), was (its box), look (its text, role and confidence) and place (its position in the stream)."""
    whole = W.partitionBy("stream_no").orderBy("sequence")
    sized = F.when(F.col("fw").isNotNull(), F.struct("fw", "fh"))
    rows = log.withColumn("epoch", F.max(F.when(F.col("type") == "snapshot", F.col("sequence"))).over(whole.rangeBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("frame", F.last(sized, True).over(whole.rangeBetween(W.unboundedPreceding, -1))).withColumn("place", F.dense_rank().over(whole) - 1)
    before = W.partitionBy(*_OWN).orderBy("sequence").rowsBetween(W.unboundedPreceding, -1)
    kept = lambda when, value: F.last(F.when(when & F.col("element_no").isNotNull(), value), True).over(before)
    rows = rows.withColumn("alive", F.coalesce(kept(F.col("type").isin(*LIFE), F.col("type")) != "disappeared", F.lit(False)))
    rows = rows.withColumn("was", kept(F.col("type").isin("snapshot", "appeared", "moved", "content_changed"), F.struct("x", "y", "w", "h")))
    return rows.withColumn("look", kept(F.col("type").isin("snapshot", "appeared", "content_changed"), F.struct("txt", "role", "conf")))


def subjects(log: DataFrame) -> DataFrame:
    """Activity rows with the box (of a translation its own) and the look of their element at their time; alive says whether it is there."""
    rows = with_before(log).where("type = 'activity'")
    own = F.when(F.col("kind") == "element_region_changed", F.col("was")).otherwise(F.struct("x", "y", "w", "h"))
    rows = rows.withColumn("box", own)
    return rows.select("stream_no", "sequence", "ts_ms", "from_ms", "kind", "element_no", "dx", "dy", "alive", "box.*", "look.*")


def _inside(frame: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    fits = (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= frame["fw"]) & (y + h <= frame["fh"])
    return F.coalesce(fits, F.lit(False))


def problems(log: DataFrame, strict: bool = False) -> DataFrame:
    """(stream_no, sequence, element_no, problem): the first rule that each row breaks; rows that break none are left out.

    As a reducer sees it: missing_snapshot, duplicate_element, unknown_element, invalid_activity_interval, invalid_activity_box,
    zero_activity_translation. strict, as a validator of a whole stream does, besides: sequence_gap (positions from 0 on), time_goes_back,
    frame_size, element_number, confidence, box, moved_from_elsewhere, resized_from_elsewhere, unknown_kind.
    """
    rows = with_before(log)
    kind, is_ = F.col("kind"), lambda *t: F.col("type").isin(*t)
    box = [F.col(c) for c in "xywh"]
    moving = is_("activity") & (kind == "region_translated")
    now = F.when(F.col("fw").isNotNull(), F.struct("fw", "fh")).otherwise(F.col("frame"))
    sized = is_("snapshot", "resized") & ~F.coalesce((F.col("fw") > 0) & (F.col("fh") > 0), F.lit(False))
    same = F.count(F.lit(1)).over(W.partitionBy("stream_no", "sequence", "element_no"))
    problem = F.when(F.lit(False), "")
    if strict:
        earlier = F.max("ts_ms").over(W.partitionBy("stream_no").orderBy("sequence").rangeBetween(W.unboundedPreceding, -1))
        rows = rows.withColumn("earlier", earlier).withColumn("same", F.when(is_("snapshot") & F.col("element_no").isNotNull(), same))
        problem = problem.when(F.col("sequence") != F.col("place"), "sequence_gap").when(F.col("ts_ms") < F.col("earlier"), "time_goes_back").when(sized, "frame_size")
    problem = problem.when(F.col("epoch").isNull(), "missing_snapshot")
    if strict:
        shown = is_("snapshot", "appeared", "content_changed") & F.col("element_no").isNotNull()
        problem = problem.when(shown & (F.col("element_no") < 1), "element_number").when(shown & ~F.coalesce(F.col("conf").between(0, 1) & ~F.isnan("conf"), F.lit(False)), "confidence")
        problem = problem.when((shown | is_("moved")) & ~_inside(now, *box), "box").when(F.col("same") > 1, "duplicate_element")
    problem = (
        problem.when(is_("appeared") & F.col("alive"), "duplicate_element").when(is_("moved", "content_changed", "disappeared") & ~F.col("alive"), "unknown_element")
        .when(is_("activity") & ~F.coalesce(F.col("from_ms") < F.col("ts_ms"), F.lit(False)), "invalid_activity_interval")
        .when(is_("activity") & (kind == "element_region_changed") & ~F.col("alive"), "unknown_element")
        .when(moving & ~_inside(now, *box), "invalid_activity_box").when(moving & (F.col("dx") == 0) & (F.col("dy") == 0), "zero_activity_translation")
    )
    if strict:
        begun = F.struct(*(F.col(f"from_{c}").alias(c) for c in "xywh"))
        problem = problem.when(is_("moved") & ~F.col("was").eqNullSafe(begun), "moved_from_elsewhere")
        problem = problem.when(is_("resized") & ~((F.col("from_w") == F.col("frame.fw")) & (F.col("from_h") == F.col("frame.fh"))), "resized_from_elsewhere")
        problem = problem.when(is_("activity") & ~F.coalesce(kind.isin("element_region_changed", "region_translated"), F.lit(False)), "unknown_kind")
    return rows.withColumn("problem", problem).where("problem IS NOT NULL").select("stream_no", "sequence", "element_no", "problem")


def discontinuities(envelopes: DataFrame, group: str, order: str) -> DataFrame:
    """(group, order, problem) of rows (group, order, source, sequence) that don't go on from the one before: another source than the first row's,
    or a sequence that isn't the one before plus one. The first row may have any; after the highest possible one none can follow."""
    own = W.partitionBy(group).orderBy(order)
    rows = envelopes.withColumn("__first", F.first("source").over(own)).withColumn("__before", F.lag("sequence").over(own)).withColumn("__n", F.row_number().over(own))
    end = F.lit((1 << 63) - 1)
    problem = F.when(~F.col("source").eqNullSafe(F.col("__first")), "source").when((F.col("__n") > 1) & (F.col("__before") == end), "sequence_overflow").when((F.col("__n") > 1) & (F.col("sequence") != F.col("__before") + 1), "sequence")
    return rows.withColumn("problem", problem).where("problem IS NOT NULL").select(group, order, "problem")


def view_at(log: DataFrame, t_ms: int, samples: DataFrame | None = None, recent_ms: int = RECENT_MS) -> dict[str, DataFrame]:
    """Each stream at t_ms: frame (stream_no, fw, fh), elements, trails (moves since the last snapshot), changes (of the last recent_ms, with the
    element's box and look at their time), activities (shown from their time on for as long as their interval was), stale (elements that
    activity touched since the latest sample and that still look as they did then) and samples (latest_ms, next_ms,
    awaiting_refresh). samples: (stream_no, ts_ms); without it the times of structural events are the samples."""
    marked = with_before(log).withColumn("last", F.max(F.when((F.col("type") == "snapshot") & (F.col("ts_ms") <= t_ms), F.col("sequence"))).over(W.partitionBy("stream_no")))
    past = marked.where(F.col("ts_ms") <= t_ms)
    since = past.where(F.col("epoch") == F.col("last"))
    frame = past.where("fw IS NOT NULL").groupBy("stream_no").agg(F.max_by(F.struct("fw", "fh"), "sequence").alias("f")).select("stream_no", "f.*")
    latest = lambda value, *types: F.max_by(value, F.when(F.col("type").isin(*types), F.col("sequence")))
    elements = since.where("element_no IS NOT NULL AND type <> 'activity'").groupBy("stream_no", "element_no").agg(
        latest(F.struct("x", "y", "w", "h"), "snapshot", "appeared", "moved", "content_changed").alias("box"),
        latest(F.struct("txt", "role", "conf"), "snapshot", "appeared", "content_changed").alias("look"), latest(F.col("type"), *LIFE).alias("life"),
    ).where("life <> 'disappeared'").select("stream_no", "element_no", "box.*", "look.*")
    trails = since.where("type = 'moved'").select("stream_no", "sequence", "ts_ms", "element_no", *(F.col(f"from_{c}") for c in "xywh"), "x", "y", "w", "h")
    own = F.struct("x", "y", "w", "h")
    recent = past.where((t_ms - F.col("ts_ms") <= recent_ms) & F.col("type").isin("appeared", "content_changed", "moved", "disappeared"))
    recent = recent.withColumn("box", F.when(F.col("type") == "disappeared", F.col("was")).otherwise(own))
    recent = recent.withColumn("shown", F.when(F.col("type").isin("appeared", "content_changed"), F.struct("txt", "role", "conf")).otherwise(F.col("look")))
    changes = recent.select("stream_no", "sequence", "ts_ms", "type", "element_no", "box.*", "shown.*")
    touched = marked.where("type = 'activity'").withColumn("box", F.when(F.col("kind") == "element_region_changed", F.col("was")).otherwise(own))
    lasts = (F.col("ts_ms") <= t_ms) & (2 * F.col("ts_ms") - F.col("from_ms") > t_ms)
    activities = touched.where(lasts).select("stream_no", "sequence", "ts_ms", "from_ms", "kind", "element_no", "dx", "dy", "box.*")
    times = log.where("type <> 'activity'").select("stream_no", "ts_ms").distinct() if samples is None else samples.select("stream_no", "ts_ms").distinct()
    around = times.groupBy("stream_no").agg(F.max(F.when(F.col("ts_ms") <= t_ms, F.col("ts_ms"))).alias("latest_ms"), F.min(F.when(F.col("ts_ms") > t_ms, F.col("ts_ms"))).alias("next_ms"))
    look = ["x", "y", "w", "h", "txt", "role"]
    still = touched.where((F.col("kind") == "element_region_changed") & F.col("look.txt").isNotNull() & (F.col("ts_ms") < t_ms)).join(around, "stream_no", "left")
    still = still.where(F.col("ts_ms") > F.coalesce("latest_ms", F.lit(-1))).select("stream_no", "element_no", "box.*", "look.txt", "look.role").distinct()
    # null-safe in look, as a role may be missing on both sides
    other = elements.select(F.col("stream_no").alias("__s"), F.col("element_no").alias("__e"), *(F.col(c).alias(f"__{c}") for c in look))
    on = (F.col("stream_no") == F.col("__s")) & (F.col("element_no") == F.col("__e"))
    for c in look:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    stale = still.join(other, on, "left_semi").select("stream_no", "element_no").distinct()
    waiting = stale.groupBy("stream_no").agg(F.lit(True).alias("awaiting_refresh"))
    samples_at = around.join(waiting, "stream_no", "left").withColumn("awaiting_refresh", F.coalesce("awaiting_refresh", F.lit(False)))
    return {"frame": frame, "elements": elements, "trails": trails, "changes": changes, "activities": activities, "stale": stale, "samples": samples_at}
