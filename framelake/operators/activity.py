"""Activity of elements and regions between structural samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as G

KEYS = ["stream_no", "boundary"]


def onset_outcomes(regions: DataFrame, elements: DataFrame, translated: DataFrame) -> DataFrame:
    """What becomes of each region that starts, one row an onset: (stream_no, boundary, region_no, element_no, outcome).

    regions: stream_no, boundary (0, 1, ... over a stream's compared frames), region_no, x, y, w, h, started; elements: the elements a
    boundary sees (stream_no, boundary, element_no, x, y, w, h); translated: (stream_no, boundary) of boundaries at which one motion
    explains the frame, where no region becomes an event.

    An element is latched by an event and let go at the first boundary at which no region's centre lies in it. As a started region
    supports its own element, a latch lasts to the end of a run of supported boundaries: the first onset of a run is the event,
    so no state need be carried along the stream. One join by (stream, boundary), then windows by element.
    """
    centred = regions.select(*KEYS, "region_no", "started", (F.col("x") + F.expr("w div 2")).alias("__cx"), (F.col("y") + F.expr("h div 2")).alias("__cy"))
    hits = centred.join(elements, KEYS).where(G.contains("", F.col("__cx"), F.col("__cy"))).select(*KEYS, "region_no", "started", "element_no")

    supported = hits.select("stream_no", "element_no", "boundary").distinct()
    place = F.row_number().over(W.partitionBy("stream_no", "element_no").orderBy("boundary"))
    runs = supported.withColumn("__run", F.col("boundary") - place)

    unique = hits.where("started").groupBy(*KEYS, "region_no").agg(F.count(F.lit(1)).alias("__n"), F.min("element_no").alias("element_no"))
    starts = centred.where("started").select(*KEYS, "region_no")
    moving = translated.select(*KEYS).distinct().withColumn("__moving", F.lit(True))
    seen = starts.join(unique, [*KEYS, "region_no"], "left").join(moving, KEYS, "left")
    state = (
        F.when(F.col("__moving"), "suppressed_by_translation").when(F.col("__n").isNull(), "unassociated").when(F.col("__n") > 1, "ambiguous")
    )
    judged = seen.withColumn("outcome", state).withColumn("element_no", F.when(F.col("__n") == 1, F.col("element_no")))
    rest, own = judged.where("outcome IS NOT NULL"), judged.where("outcome IS NULL")

    run = W.partitionBy("stream_no", "element_no", "__run")
    ranked = own.join(runs, ["stream_no", "element_no", "boundary"])
    ranked = ranked.withColumn("__first", F.min("boundary").over(run)).withColumn("__k", F.row_number().over(run.orderBy("boundary", "region_no")))
    verdict = F.when(F.col("__k") == 1, "event").when(F.col("boundary") == F.col("__first"), "duplicate").otherwise("latched")
    columns = [*KEYS, "region_no", "element_no", "outcome"]
    return ranked.withColumn("outcome", verdict).select(*columns).unionByName(rest.select(*columns))


OUTCOMES = {"event": "events", "latched": "latched", "duplicate": "duplicate", "unassociated": "unassociated", "ambiguous": "ambiguous", "suppressed_by_translation": "suppressed"}


def latched(regions: DataFrame, elements: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(stream_no, boundary, element_no): the elements that are latched after each boundary: from their event on to the end of the run of boundaries
    at which some region's centre lies in them."""
    centred = regions.select(*KEYS, (F.col("x") + F.expr("w div 2")).alias("__cx"), (F.col("y") + F.expr("h div 2")).alias("__cy"))
    supported = centred.join(elements, KEYS).where(G.contains("", F.col("__cx"), F.col("__cy"))).select("stream_no", "element_no", "boundary").distinct()
    events = outcomes.where("outcome = 'event'").select("stream_no", "element_no", "boundary", F.lit(1).alias("__event"))
    rows = supported.join(events, ["stream_no", "element_no", "boundary"], "left")
    rows = rows.withColumn("__run", F.col("boundary") - F.row_number().over(W.partitionBy("stream_no", "element_no").orderBy("boundary")))
    since = F.max("__event").over(W.partitionBy("stream_no", "element_no", "__run").orderBy("boundary"))
    return rows.withColumn("__on", since).where("__on = 1").select("stream_no", "boundary", "element_no")


def activity_metrics(boundaries: DataFrame, regions: DataFrame, elements: DataFrame, motions: DataFrame) -> DataFrame:
    """Per stream: boundaries, regions, onsets and their outcomes, translations, and the most elements latched at once."""
    outcomes = onset_outcomes(regions, elements, motions)
    counted = outcomes.groupBy("stream_no").agg(F.count(F.lit(1)).alias("onsets"), *(F.count_if(F.col("outcome") == k).alias(v) for k, v in OUTCOMES.items()))
    held = latched(regions, elements, outcomes).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("__n")).groupBy("stream_no").agg(F.max("__n").alias("most_latched"))
    each = lambda rows, name: rows.groupBy("stream_no").agg(F.count(F.lit(1)).alias(name))
    out = each(boundaries, "boundaries")
    for other in (each(regions, "regions"), counted, each(motions, "translations"), held):
        out = out.join(other, "stream_no", "left")
    return out.fillna(0)


def activities(outcomes: DataFrame, motions: DataFrame, by: int = 4) -> DataFrame:
    """Events of each boundary in their order: a translation, or else elements by number. Motions are in units of `by` pixels."""
    kinds = outcomes.where("outcome = 'event'").select(*KEYS, F.lit("element_region_changed").alias("kind"), "element_no", *(F.lit(None).cast("long").alias(c) for c in ("dx", "dy")))
    moved = motions.select(*KEYS, F.lit("region_translated").alias("kind"), F.lit(None).cast("long").alias("element_no"), *((F.col(c) * by).cast("long").alias(c) for c in ("dx", "dy")))
    both = moved.unionByName(kinds)
    order = W.partitionBy(*KEYS).orderBy(F.col("element_no").asc_nulls_first())
    return both.withColumn("ordinal", F.row_number().over(order) - 1)


def awaiting_refresh(live: DataFrame, seen: DataFrame, samples: DataFrame, t_ms: int) -> DataFrame:
    """live with awaiting_refresh: did activity touch a text element since the latest sample, while its look stays what it was then?

    live: elements at t_ms (stream_no, element_no, x, y, w, h, txt, role); seen: the same columns as activity at ts_ms found them;
    samples: (stream_no, ts_ms). Confidence does not count.
    """
    latest = samples.where(F.col("ts_ms") <= t_ms).groupBy("stream_no").agg(F.max("ts_ms").alias("__latest"))
    since = seen.where((F.col("ts_ms") < t_ms) & F.col("txt").isNotNull()).join(latest, "stream_no", "left").where(F.col("ts_ms") > F.coalesce("__latest", F.lit(-1)))
    look = ["stream_no", "element_no", "x", "y", "w", "h", "txt", "role"]
    touched = since.select(*(F.col(c).alias("__" + c) for c in look)).distinct()
    same = [live[c].eqNullSafe(touched["__" + c]) for c in look]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return live.join(touched, on, "left").withColumn("awaiting_refresh", F.col("__stream_no").isNotNull()).select(*live.columns, "awaiting_refresh")
