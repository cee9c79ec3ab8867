"""State from the event log: point-in-time views, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def state_at(events: DataFrame, t_ms: int | None = None) -> DataFrame:
    """Live elements of each stream at t_ms (None: the end), without replaying the log.

    Per element after its last lifecycle row: box from the last row that has one, text, role and confidence from the last of snapshot,
    appeared and content_changed; alive unless the last lifecycle row is disappeared.
    """
    log = events if t_ms is None else events.where(F.col("ts_ms") <= t_ms)
    log = log.where("element_no IS NOT NULL")
    content = F.col("type").isin("snapshot", "appeared", "content_changed")
    last = lambda cols, when: F.max_by(F.struct(*cols), F.when(when, F.col("sequence")))
    folded = log.groupBy("stream_no", "element_no").agg(
        last(["x", "y", "w", "h"], F.col("type") != "disappeared").alias("box"), last(["txt", "role", "conf"], content).alias("c"),
        F.max_by("type", F.when(F.col("type").isin("snapshot", "appeared", "disappeared"), F.col("sequence"))).alias("life"),
    )
    return folded.where("life <> 'disappeared'").select("stream_no", "element_no", "box.*", "c.*")


def recent_changes(events: DataFrame, t_ms: int, window_ms: int = 1000) -> DataFrame:
    return events.where((F.col("ts_ms") <= t_ms) & (t_ms - F.col("ts_ms") <= window_ms))


def violations(events: DataFrame, strict: bool = True) -> DataFrame:
    """(stream_no, sequence, problem) of rows that break the log's rules; strict adds those of a replay."""
    own = W.partitionBy("stream_no", "element_no").orderBy("sequence")
    whole = W.partitionBy("stream_no").orderBy("sequence")
    rows = events.withColumn("life", F.last(F.when(F.col("type").isin("snapshot", "appeared", "disappeared"), F.col("type")), True).over(own.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("was", F.last(F.when(F.col("type") != "disappeared", F.struct("x", "y")), True).over(own.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("before", F.lag(F.struct("sequence", "ts_ms", "type")).over(whole))
    alive = F.col("life").isin("snapshot", "appeared")
    problem = (
        F.when(F.col("before").isNull() & (F.col("type") != "snapshot"), "missing_snapshot")
        .when(F.col("before.ts_ms") > F.col("ts_ms"), "time_goes_back")
        .when(F.col("type").isin("moved", "content_changed", "disappeared") & ~F.coalesce(alive, F.lit(False)), "unknown_element")
        .when((F.col("type") == "appeared") & F.coalesce(alive, F.lit(False)), "already_there")
    )
    if strict:
        gap = ~((F.col("sequence") == F.col("before.sequence") + 1) | ((F.col("type") == "snapshot") & (F.col("sequence") == F.col("before.sequence"))))
        problem = problem.when(gap, "sequence_gap").when((F.col("type") == "moved") & ((F.col("from_x") != F.col("was.x")) | (F.col("from_y") != F.col("was.y"))), "moved_from_elsewhere")
    return rows.withColumn("problem", problem).where("problem IS NOT NULL").select("stream_no", "sequence", "problem")


def family_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("stream_no", "type").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
