"""Queries over the one sequence of activity and structural events, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import activity as policy
from ..operators import frames
from ..sources.tables import observations
from ..streaming import tracker
from . import log
from .catalog import DIFF, query
from .catalog_views import ONSETS, _boundaries

T_MS, DAY_MS = 1_705_000_000_000, 86_400_000

WIDE = f"""{DIFF}, origins AS (SELECT p.stream_no, n.frame_no, n.key, n.rank, p.x AS from_x, p.y AS from_y FROM keyed p JOIN keyed n ON p.stream_no = n.stream_no AND p.frame_no + 1 = n.frame_no AND p.key = n.key AND p.rank = n.rank),
structural AS (
  SELECT s.stream_no, s.ts_ms, s.type, dense_rank() OVER (PARTITION BY s.stream_no ORDER BY s.key, s.rank) AS element_no, x, y, 100 AS w, 30 AS h, s.key || CAST(round(conf * 10) AS INTEGER) AS txt,
    CASE s.rank % 3 WHEN 1 THEN 'button' WHEN 2 THEN 'label' END AS role, conf, CASE WHEN s.type = 'moved' THEN o.from_x END AS from_x, CASE WHEN s.type = 'moved' THEN o.from_y END AS from_y,
    CASE WHEN s.type = 'snapshot' THEN 640 END AS fw, CASE WHEN s.type = 'snapshot' THEN 480 END AS fh, s.frame_no, CASE WHEN s.type = 'snapshot' THEN 0 ELSE sequence END AS ord
  FROM seq s LEFT JOIN origins o ON o.stream_no = s.stream_no AND o.frame_no = s.frame_no AND o.key = s.key AND o.rank = s.rank
), acts AS (
  SELECT stream_no, ts_ms, 'element_region_changed' AS kind, element_no, ts_ms - {DAY_MS} AS from_ms, NULL AS x, NULL AS y, NULL AS w, NULL AS h, NULL AS dx, NULL AS dy FROM structural WHERE type IN ('moved', 'content_changed') AND element_no % 2 = 0 GROUP BY ALL
  UNION ALL SELECT stream_no, ts_ms, 'region_translated', NULL, ts_ms - {DAY_MS} // 2, min(x), min(y), 100, 30, frame_no % 3 - 1, 1 FROM structural WHERE type = 'appeared' AND frame_no % 5 = 2 GROUP BY stream_no, ts_ms, frame_no
), merged AS (
  SELECT *, dense_rank() OVER (PARTITION BY stream_no ORDER BY ts_ms, phase, ord) - 1 AS sequence FROM (
    SELECT stream_no, ts_ms, 'activity' AS type, element_no, x, y, w, h, NULL AS txt, NULL AS role, NULL AS conf, NULL AS from_x, NULL AS from_y, NULL AS fw, NULL AS fh, from_ms, kind, dx, dy, 0 AS phase,
      row_number() OVER (PARTITION BY stream_no, ts_ms ORDER BY kind = 'element_region_changed', element_no) - 1 AS ord FROM acts
    UNION ALL SELECT stream_no, ts_ms, type, element_no, x, y, w, h, txt, role, conf, from_x, from_y, fw, fh, NULL, NULL, NULL, NULL, 1, ord FROM structural)
)"""


def _structural(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.event_log(observations(spark, d), origins=True)
    number = F.dense_rank().over(W.partitionBy("stream_no").orderBy("key", "rank")).cast("long")
    first = F.col("type") == "snapshot"
    return rows.select(
        "stream_no", "frame_no", "ts_ms", "type", number.alias("element_no"), "x", "y", F.lit(100).alias("w"), F.lit(30).alias("h"), F.concat("key", F.round(F.col("conf") * 10).cast("int")).alias("txt"),
        F.expr("CASE rank % 3 WHEN 1 THEN 'button' WHEN 2 THEN 'label' END").alias("role"), "conf", "from_x", "from_y",
        F.when(F.col("type") == "moved", 100).alias("from_w"), F.when(F.col("type") == "moved", 30).alias("from_h"),
        F.when(first, 640).alias("fw"), F.when(first, 480).alias("fh"), F.when(first, 0).otherwise(F.col("sequence")).alias("sequence"),
    )


def wide_log(spark: SparkSession, d: str) -> DataFrame:
    rows = _structural(spark, d)
    null = F.lit(None).cast("long")
    changed = rows.where("type IN ('moved', 'content_changed') AND element_no % 2 = 0").select("stream_no", "ts_ms", F.lit("element_region_changed").alias("kind"), "element_no", (F.col("ts_ms") - DAY_MS).alias("from_ms"), *(null.alias(c) for c in ("x", "y", "w", "h", "dx", "dy")))
    moved = rows.where("type = 'appeared' AND frame_no % 5 = 2").groupBy("stream_no", "ts_ms", "frame_no").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    moved = moved.select("stream_no", "ts_ms", F.lit("region_translated").alias("kind"), null.alias("element_no"), (F.col("ts_ms") - DAY_MS // 2).alias("from_ms"), "x", "y", F.lit(100).cast("long").alias("w"), F.lit(30).cast("long").alias("h"), (F.col("frame_no") % 3 - 1).alias("dx"), F.lit(1).cast("long").alias("dy"))
    return log.with_activity(rows.drop("frame_no"), log.activity_kinds(changed.union(moved)))


@query(f"WITH {WIDE} SELECT stream_no, sequence, ts_ms, type, kind, element_no, from_ms, dx, dy, x, y FROM merged")
def merged_sequence(spark: SparkSession, d: str) -> DataFrame:
    return wide_log(spark, d).select("stream_no", "sequence", "ts_ms", "type", "kind", "element_no", "from_ms", "dx", "dy", "x", "y")


@query(f"""WITH {WIDE}, found AS (SELECT a.stream_no, a.sequence, a.kind, a.element_no,
  CASE WHEN a.kind = 'region_translated' THEN a.x ELSE (SELECT arg_max(m.x, m.sequence) FROM merged m WHERE m.stream_no = a.stream_no AND m.element_no = a.element_no AND m.sequence < a.sequence AND m.type IN ('snapshot', 'appeared', 'moved', 'content_changed')) END AS x,
  (SELECT arg_max(m.txt, m.sequence) FROM merged m WHERE m.stream_no = a.stream_no AND m.element_no = a.element_no AND m.sequence < a.sequence AND m.type IN ('snapshot', 'appeared', 'content_changed')) AS txt
  FROM merged a WHERE a.type = 'activity') SELECT * FROM found""")
def activity_subjects(spark: SparkSession, d: str) -> DataFrame:
    return log.subjects(wide_log(spark, d)).select("stream_no", "sequence", "kind", "element_no", "x", "txt")


HURT = f"""{WIDE}, hurt AS (SELECT stream_no, sequence, type, element_no, kind, phase, CASE WHEN sequence % 19 = 4 THEN ts_ms - 1000000000000 ELSE ts_ms END AS ts_ms, CASE WHEN sequence % 23 = 7 THEN x + 600 ELSE x END AS x, y, w, h,
  CASE WHEN sequence % 17 = 3 THEN from_x + 1 ELSE from_x END AS from_x, from_y, CASE WHEN sequence % 29 = 6 THEN conf + 1 ELSE conf END AS conf, CASE WHEN sequence % 5 = 1 THEN ts_ms ELSE from_ms END AS from_ms, dx, CASE WHEN dx = 0 THEN 0 ELSE dy END AS dy
  FROM merged WHERE type = 'snapshot' OR sequence % 13 <> 5), b AS (
  SELECT *, dense_rank() OVER (PARTITION BY stream_no ORDER BY sequence) - 1 AS place, max(ts_ms) OVER (PARTITION BY stream_no ORDER BY sequence RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier,
    coalesce(last_value(CASE WHEN type IN ('snapshot', 'appeared', 'disappeared') THEN type END IGNORE NULLS) OVER o <> 'disappeared', false) AND element_no IS NOT NULL AS alive,
    last_value(CASE WHEN type IN ('snapshot', 'appeared', 'moved', 'content_changed') THEN x END IGNORE NULLS) OVER o AS was_x, last_value(CASE WHEN type IN ('snapshot', 'appeared', 'moved', 'content_changed') THEN y END IGNORE NULLS) OVER o AS was_y
  FROM hurt WINDOW o AS (PARTITION BY stream_no, element_no ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
REDUCER = """WHEN type = 'appeared' AND alive THEN 'duplicate_element' WHEN type IN ('moved', 'content_changed', 'disappeared') AND NOT alive THEN 'unknown_element'
  WHEN type = 'activity' AND from_ms >= ts_ms THEN 'invalid_activity_interval' WHEN kind = 'element_region_changed' AND NOT alive THEN 'unknown_element'
  WHEN kind = 'region_translated' AND x + w > 640 THEN 'invalid_activity_box' WHEN kind = 'region_translated' AND dx = 0 AND dy = 0 THEN 'zero_activity_translation'"""


def _hurt(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("sequence")
    rows = wide_log(spark, d).where((F.col("type") == "snapshot") | (s % 13 != 5))
    rows = rows.withColumn("from_ms", F.when(s % 5 == 1, F.when(F.col("type") == "activity", F.col("ts_ms"))).otherwise(F.col("from_ms"))).withColumn("ts_ms", F.when(s % 19 == 4, F.col("ts_ms") - 1_000_000_000_000).otherwise(F.col("ts_ms")))
    rows = rows.withColumn("x", F.when(s % 23 == 7, F.col("x") + 600).otherwise(F.col("x"))).withColumn("from_x", F.when(s % 17 == 3, F.col("from_x") + 1).otherwise(F.col("from_x")))
    return rows.withColumn("conf", F.when(s % 29 == 6, F.col("conf") + 1).otherwise(F.col("conf"))).withColumn("dy", F.when(F.col("dx") == 0, 0).otherwise(F.col("dy")))


@query(f"WITH {HURT}, p AS (SELECT stream_no, sequence, element_no, CASE {REDUCER} END AS problem FROM b) SELECT * FROM p WHERE problem IS NOT NULL")
def reducer_errors(spark: SparkSession, d: str) -> DataFrame:
    return log.problems(_hurt(spark, d))


@query(f"""WITH {HURT}, p AS (SELECT stream_no, place AS sequence, element_no, CASE WHEN ts_ms < earlier THEN 'time_goes_back'
  WHEN type IN ('snapshot', 'appeared', 'content_changed') AND NOT conf BETWEEN 0 AND 1 THEN 'confidence' WHEN type IN ('snapshot', 'appeared', 'content_changed', 'moved') AND x + w > 640 THEN 'box'
  {REDUCER} WHEN type = 'moved' AND (was_x <> from_x OR was_y <> from_y) THEN 'moved_from_elsewhere' END AS problem FROM b) SELECT * FROM p WHERE problem IS NOT NULL""")
def log_violations(spark: SparkSession, d: str) -> DataFrame:
    renumbered = F.dense_rank().over(W.partitionBy("stream_no").orderBy("sequence")).cast("long") - 1
    return log.problems(_hurt(spark, d).withColumn("sequence", renumbered), strict=True)


VIEW = f"""{WIDE}, past AS (SELECT * FROM merged WHERE ts_ms <= {T_MS}),
fold AS (SELECT stream_no, element_no, arg_max(x, sequence) FILTER (type <> 'disappeared') AS x, arg_max(y, sequence) FILTER (type <> 'disappeared') AS y, arg_max(txt, sequence) FILTER (type IN ('snapshot', 'appeared', 'content_changed')) AS txt,
  arg_max(coalesce(role, ''), sequence) FILTER (type IN ('snapshot', 'appeared', 'content_changed')) AS role, arg_max(type, sequence) FILTER (type IN ('snapshot', 'appeared', 'disappeared')) AS life FROM past WHERE type <> 'activity' GROUP BY 1, 2),
elements AS (SELECT stream_no, element_no, x, y, txt, role FROM fold WHERE life <> 'disappeared'),
around AS (SELECT stream_no, max(ts_ms) FILTER (ts_ms <= {T_MS}) AS latest, min(ts_ms) FILTER (ts_ms > {T_MS}) AS next FROM (SELECT * FROM merged WHERE type <> 'activity' AND ts_ms % 4 <> 1 AND ts_ms // 172800000 % 3 <> 1) GROUP BY 1),
seen AS (SELECT a.stream_no, a.sequence, a.ts_ms, a.from_ms, a.element_no, a.kind, CASE WHEN a.kind = 'region_translated' THEN a.x ELSE arg_max(m.x, m.sequence) FILTER (m.type IN ('snapshot', 'appeared', 'moved', 'content_changed')) END AS x,
  arg_max(m.y, m.sequence) FILTER (m.type IN ('snapshot', 'appeared', 'moved', 'content_changed')) AS y, arg_max(m.txt, m.sequence) FILTER (m.type IN ('snapshot', 'appeared', 'content_changed')) AS txt, arg_max(coalesce(m.role, ''), m.sequence) FILTER (m.type IN ('snapshot', 'appeared', 'content_changed')) AS role
  FROM merged a LEFT JOIN merged m ON m.stream_no = a.stream_no AND m.element_no = a.element_no AND m.sequence < a.sequence WHERE a.type = 'activity' GROUP BY a.stream_no, a.sequence, a.ts_ms, a.from_ms, a.element_no, a.kind, a.x),
stale AS (SELECT DISTINCT s.stream_no, s.element_no FROM seen s JOIN around r ON r.stream_no = s.stream_no JOIN elements e ON e.stream_no = s.stream_no AND e.element_no = s.element_no AND e.x = s.x AND e.y = s.y AND e.txt = s.txt AND e.role = s.role
  WHERE s.kind = 'element_region_changed' AND s.ts_ms < {T_MS} AND s.ts_ms > coalesce(r.latest, -1))"""


@query(f"""WITH {VIEW}
SELECT stream_no, 'frame' AS part, NULL AS element_no, NULL AS at_ms, 640 AS x, 480 AS y, NULL AS txt FROM (SELECT DISTINCT stream_no FROM past)
UNION ALL SELECT stream_no, 'element', element_no, NULL, x, y, txt FROM elements
UNION ALL SELECT stream_no, 'trail', element_no, ts_ms, x, y, NULL FROM past WHERE type = 'moved'
UNION ALL SELECT p.stream_no, 'change', p.element_no, p.ts_ms, p.x, p.y, p.type FROM past p WHERE {T_MS} - ts_ms <= 400000000 AND type IN ('appeared', 'moved', 'content_changed', 'disappeared')
UNION ALL SELECT stream_no, 'activity', element_no, ts_ms, x, NULL, kind FROM seen WHERE ts_ms <= {T_MS} AND 2 * ts_ms - from_ms > {T_MS}
UNION ALL SELECT stream_no, 'stale', element_no, NULL, NULL, NULL, NULL FROM stale
UNION ALL SELECT stream_no, 'sample', NULL, latest, next, NULL, CASE WHEN stream_no IN (SELECT stream_no FROM stale) THEN 'awaiting' ELSE 'fresh' END FROM around""")
def state_view(spark: SparkSession, d: str) -> DataFrame:
    rows = wide_log(spark, d).persist()  # read by every part of the view
    samples = rows.where("type <> 'activity' AND ts_ms % 4 <> 1 AND ts_ms div 172800000 % 3 <> 1").select("stream_no", "ts_ms")
    view = log.view_at(rows, T_MS, samples, 400_000_000)
    null, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    part = lambda name, rows, element=null, at=null, x=null, y=null, txt=text: rows.select("stream_no", F.lit(name).alias("part"), element.alias("element_no"), at.alias("at_ms"), x.cast("long").alias("x"), y.cast("long").alias("y"), txt.alias("txt"))
    c = F.col
    return reduce(DataFrame.union, [
        part("frame", view["frame"], x=c("fw"), y=c("fh")), part("element", view["elements"], c("element_no"), null, c("x"), c("y"), c("txt")),
        part("trail", view["trails"], c("element_no"), c("ts_ms"), c("x"), c("y")), part("change", view["changes"], c("element_no"), c("ts_ms"), c("x"), c("y"), c("type")),
        part("activity", view["activities"], c("element_no"), c("ts_ms"), c("x"), null, c("kind")), part("stale", view["stale"], c("element_no")),
        part("sample", view["samples"], null, c("latest_ms"), c("next_ms"), null, F.when(c("awaiting_refresh"), "awaiting").otherwise("fresh")),
    ])


@query(f"""WITH {DIFF}, e AS (SELECT stream_no, sequence + 7 AS sequence, row_number() OVER (PARTITION BY stream_no ORDER BY sequence) AS n, CASE WHEN sequence % 31 = 30 THEN 'b' ELSE 'a' END AS source FROM seq WHERE sequence % 11 <> 10),
p AS (SELECT stream_no, n, CASE WHEN source <> first_value(source) OVER w THEN 'source' WHEN sequence <> lag(sequence) OVER w + 1 THEN 'sequence' END AS problem FROM e WINDOW w AS (PARTITION BY stream_no ORDER BY n)) SELECT * FROM p WHERE problem IS NOT NULL""")
def envelope_continuity(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.event_log(observations(spark, d)).where("sequence % 11 <> 10")
    rows = rows.select("stream_no", (F.col("sequence") + 7).alias("sequence"), F.row_number().over(W.partitionBy("stream_no").orderBy("sequence")).cast("long").alias("n"), F.when(F.col("sequence") % 31 == 30, "b").otherwise("a").alias("source"))
    return log.discontinuities(rows, "stream_no", "n")


@query(f"""WITH {ONSETS}, held AS (SELECT stream_no, boundary, count(DISTINCT element_no) AS latched FROM (SELECT h.stream_no, h.boundary, h.element_no, bool_or(o.outcome = 'event') OVER (PARTITION BY h.stream_no, h.element_no, r.run ORDER BY h.boundary) AS on_ FROM
    (SELECT DISTINCT stream_no, boundary, element_no FROM hits) h JOIN runs r ON r.stream_no = h.stream_no AND r.element_no = h.element_no AND r.boundary = h.boundary LEFT JOIN onsets o ON o.stream_no = h.stream_no AND o.boundary = h.boundary AND o.element_no = h.element_no AND o.outcome = 'event') WHERE on_ GROUP BY ALL),
  n AS (SELECT stream_no, max(frame_no) + 1 AS boundaries FROM numbered GROUP BY 1), g AS (SELECT stream_no, count(*) AS regions FROM regions GROUP BY 1), w AS (SELECT stream_no, max(latched) AS high FROM held GROUP BY 1), m AS (SELECT stream_no, count(*) AS motions FROM motions GROUP BY 1),
  c AS (SELECT stream_no, count(*) AS onsets, count(*) FILTER (outcome = 'event') AS events, count(*) FILTER (outcome = 'latched') AS latched, count(*) FILTER (outcome = 'duplicate') AS duplicate, count(*) FILTER (outcome = 'unassociated') AS unassociated,
    count(*) FILTER (outcome = 'ambiguous') AS ambiguous, count(*) FILTER (outcome = 'suppressed_by_translation') AS suppressed FROM onsets GROUP BY 1)
SELECT n.stream_no, boundaries, coalesce(regions, 0) AS regions, coalesce(onsets, 0) AS onsets, coalesce(events, 0) AS events, coalesce(latched, 0) AS latched, coalesce(duplicate, 0) AS duplicate, coalesce(unassociated, 0) AS unassociated, coalesce(ambiguous, 0) AS ambiguous,
  coalesce(suppressed, 0) AS suppressed, coalesce(motions, 0) AS translations, coalesce(high, 0) AS most_latched FROM n LEFT JOIN g USING (stream_no) LEFT JOIN c USING (stream_no) LEFT JOIN w USING (stream_no) LEFT JOIN m USING (stream_no)""")
def activity_metrics(spark: SparkSession, d: str) -> DataFrame:
    regions, elements, motions = _boundaries(spark, d)
    boundaries = frames.frame_numbers(observations(spark, d)).select("stream_no", F.col("frame_no").alias("boundary")).distinct()
    return policy.activity_metrics(boundaries, regions, elements, motions)


@query()
def tracker_profile(spark: SparkSession, d: str) -> DataFrame:
    return tracker.run_profile(tracker.batch_profile(observations(spark, d)))
