"""Queries for activity, views at a time, manifests and evaluation, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity, detection, evaluation, frames, manifests, quality, regions
from ..sources.tables import observations, pixels, table
from ..streaming import episodes as sessions
from ..streaming import tracker
from . import compact
from .catalog import FRAMES, query

BOUNDARIES = f"""{FRAMES}, regions AS (SELECT stream_no, frame_no AS boundary, obs_index AS region_no, x, y, w, h, conf < 0.6 AS started FROM numbered WHERE obs_index % 2 = 1),
elements AS (SELECT stream_no, frame_no AS boundary, obs_index AS element_no, x // 2 AS x, y // 2 AS y, 320 AS w, 240 AS h FROM numbered WHERE obs_index % 2 = 0),
motions AS (SELECT DISTINCT stream_no, frame_no AS boundary, frame_no % 5 - 2 AS dx, 3 AS dy FROM numbered WHERE frame_no % 7 = 3)"""
ONSETS = f"""{BOUNDARIES}, hits AS (SELECT r.stream_no, r.boundary, region_no, started, element_no FROM regions r JOIN elements e
  ON r.stream_no = e.stream_no AND r.boundary = e.boundary AND r.x + r.w // 2 >= e.x AND r.x + r.w // 2 < e.x + e.w AND r.y + r.h // 2 >= e.y AND r.y + r.h // 2 < e.y + e.h),
runs AS (SELECT *, boundary - row_number() OVER (PARTITION BY stream_no, element_no ORDER BY boundary) AS run FROM (SELECT DISTINCT stream_no, element_no, boundary FROM hits)),
u AS (SELECT r.stream_no, r.boundary, r.region_no, count(element_no) AS n, min(element_no) AS element_no, EXISTS (SELECT 1 FROM motions m WHERE m.stream_no = r.stream_no AND m.boundary = r.boundary) AS moving
  FROM regions r LEFT JOIN hits h ON h.stream_no = r.stream_no AND h.boundary = r.boundary AND h.region_no = r.region_no WHERE r.started GROUP BY r.stream_no, r.boundary, r.region_no),
k AS (SELECT u.stream_no, u.boundary, region_no, u.element_no, row_number() OVER w AS k, min(u.boundary) OVER (PARTITION BY u.stream_no, u.element_no, run) AS first FROM u JOIN runs
  ON u.stream_no = runs.stream_no AND u.element_no = runs.element_no AND u.boundary = runs.boundary WHERE n = 1 AND NOT moving WINDOW w AS (PARTITION BY u.stream_no, u.element_no, run ORDER BY u.boundary, region_no)),
onsets AS (SELECT stream_no, boundary, region_no, CASE WHEN n = 1 THEN element_no END AS element_no, CASE WHEN moving THEN 'suppressed_by_translation' WHEN n = 0 THEN 'unassociated' ELSE 'ambiguous' END AS outcome FROM u WHERE moving OR n <> 1
  UNION ALL SELECT stream_no, boundary, region_no, element_no, CASE WHEN k = 1 THEN 'event' WHEN boundary = first THEN 'duplicate' ELSE 'latched' END FROM k)"""


def _boundaries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = frames.frame_numbers(observations(spark, d)).withColumn("boundary", F.col("frame_no"))
    regions = n.where("obs_index % 2 = 1").select("stream_no", "boundary", F.col("obs_index").alias("region_no"), "x", "y", "w", "h", (F.col("conf") < 0.6).alias("started"))
    elements = n.where("obs_index % 2 = 0").selectExpr("stream_no", "boundary", "obs_index AS element_no", "x div 2 AS x", "y div 2 AS y", "320 AS w", "240 AS h")
    motions = n.where("frame_no % 7 = 3").selectExpr("stream_no", "boundary", "boundary % 5 - 2 AS dx", "3 AS dy").distinct()
    return regions, elements, motions


@query(f"WITH {ONSETS} SELECT * FROM onsets")
def activity_onsets(spark: SparkSession, d: str) -> DataFrame:
    return activity.onset_outcomes(*_boundaries(spark, d))


@query(f"""WITH {ONSETS}, kinds AS (SELECT stream_no, boundary, 'region_translated' AS kind, CAST(NULL AS BIGINT) AS element_no, CAST(dx * 4 AS BIGINT) AS dx, CAST(dy * 4 AS BIGINT) AS dy FROM motions
  UNION ALL SELECT stream_no, boundary, 'element_region_changed', element_no, NULL, NULL FROM onsets WHERE outcome = 'event')
SELECT *, CAST(row_number() OVER (PARTITION BY stream_no, boundary ORDER BY element_no NULLS FIRST) - 1 AS INTEGER) AS ordinal FROM kinds""")
def activity_events(spark: SparkSession, d: str) -> DataFrame:
    regions, elements, motions = _boundaries(spark, d)
    return activity.activities(activity.onset_outcomes(regions, elements, motions), motions)


@query(f"""WITH {FRAMES}, latest AS (SELECT stream_no, max(frame_no) AS f, max(ts_ms) AS t FROM numbered WHERE ts_ms <= 1705000000000 GROUP BY 1),
live AS (SELECT n.stream_no, obs_index AS element_no, x, y, w, h, CASE WHEN conf > 0.2 THEN txt END AS txt, role FROM numbered n JOIN latest l ON n.stream_no = l.stream_no AND n.frame_no = l.f),
seen AS (SELECT n.stream_no, ts_ms + 1 AS ts_ms, obs_index AS element_no, CASE WHEN obs_index % 3 = 0 THEN x + 1 ELSE x END AS x, y, w, h, CASE WHEN conf > 0.2 THEN txt END AS txt, role FROM numbered n WHERE obs_index % 2 = 0)
SELECT l.*, EXISTS (SELECT 1 FROM seen s JOIN latest t ON t.stream_no = s.stream_no WHERE s.stream_no = l.stream_no AND s.ts_ms > t.t AND s.ts_ms < 1705000000000 AND s.txt IS NOT NULL
  AND s.element_no = l.element_no AND s.x = l.x AND s.y = l.y AND s.w = l.w AND s.h = l.h AND s.txt = l.txt AND s.role = l.role) AS awaiting_refresh FROM live l""")
def overlay_refresh(spark: SparkSession, d: str) -> DataFrame:
    t = 1_705_000_000_000
    n = frames.frame_numbers(observations(spark, d)).withColumn("txt", F.when(F.col("conf") > 0.2, F.col("txt"))).withColumn("element_no", F.col("obs_index"))
    look = ["stream_no", "element_no", "x", "y", "w", "h", "txt", "role"]
    at = n.where(F.col("ts_ms") <= t).groupBy("stream_no").agg(F.max("frame_no").alias("frame_no"))
    live = n.join(at, ["stream_no", "frame_no"]).select(*look)
    seen = n.where("obs_index % 2 = 0").withColumn("ts_ms", F.col("ts_ms") + 1).withColumn("x", F.when(F.col("obs_index") % 3 == 0, F.col("x") + 1).otherwise(F.col("x"))).select("ts_ms", *look)
    return activity.awaiting_refresh(live, seen, n.select("stream_no", "ts_ms"), t)


@query("""WITH f AS (SELECT doc_id, strlen(text) AS bytes, sha256(text) AS digest FROM documents WHERE doc_id % 7 <> 2),
e AS (SELECT doc_id, strlen(text) AS bytes, sha256(CASE WHEN doc_id % 11 = 5 THEN text || ' ' ELSE text END) AS digest FROM documents WHERE doc_id % 13 <> 1)
SELECT coalesce(e.doc_id, f.doc_id) AS doc_id, CASE WHEN f.doc_id IS NULL THEN 'missing' WHEN e.doc_id IS NULL THEN 'unexpected' WHEN e.bytes <> f.bytes THEN 'wrong_size' ELSE 'wrong_digest' END AS problem
FROM e FULL JOIN f ON e.doc_id = f.doc_id WHERE f.doc_id IS NULL OR e.doc_id IS NULL OR e.bytes <> f.bytes OR e.digest <> f.digest""")
def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("bytes", F.octet_length("text").cast("long"))
    found = docs.where("doc_id % 7 <> 2").select("doc_id", "bytes", F.sha2("text", 256).alias("digest"))
    told = docs.where("doc_id % 13 <> 1").select("doc_id", "bytes", F.sha2(F.when(F.col("doc_id") % 11 == 5, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("digest"))
    return manifests.differences(told, found, "doc_id")


TRIALS = "trials AS (SELECT l_orderkey AS task, l_orderkey % 50 AS cluster, l_orderkey % 4 AS scenario, l_suppkey % 3 > 0 AS correct, l_partkey % 4 > 0 AS other FROM lineitem)"


def _trials(spark: SparkSession, d: str, arm: str) -> DataFrame:
    c = {"correct": F.col("l_suppkey") % 3 > 0, "other": F.col("l_partkey") % 4 > 0}[arm]
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), (F.col("l_orderkey") % 4).alias("scenario"), c.alias("correct"))
    return evaluation.majority(rows, ["task", "scenario"])


@query(f"""WITH {TRIALS}, m AS (SELECT task, count(*) FILTER (correct) * 2 > count(*) AS a, count(*) FILTER (other) * 2 > count(*) AS b FROM trials GROUP BY 1)
SELECT count(*) FILTER (a AND NOT b) AS wins, count(*) FILTER (b AND NOT a) AS losses, count(*) FILTER (a = b) AS ties, round(avg(CAST(a AS INTEGER) - CAST(b AS INTEGER)), 9) AS delta FROM m""")
def paired_outcomes(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.paired(_trials(spark, d, "correct"), _trials(spark, d, "other"), ["task", "scenario"])
    return out.withColumn("delta", F.round("delta", 9))


@query(f"""WITH {TRIALS}, m AS (SELECT task, scenario, count(*) FILTER (correct) * 2 > count(*) AS a FROM trials GROUP BY 1, 2), s AS (SELECT scenario, avg(CAST(a AS INTEGER)) AS a FROM m GROUP BY 1)
SELECT round(avg(a), 9) AS macro FROM s""")
def scenario_macro(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.macro(_trials(spark, d, "correct"), "scenario").select(F.round("macro", 9).alias("macro"))


@query(f"""WITH {TRIALS}, m AS (SELECT task, scenario, task % 200 AS cluster, CAST(count(*) FILTER (correct) * 2 > count(*) AS INTEGER) AS a FROM trials GROUP BY 1, 2, 3),
s AS (SELECT scenario, cluster, CAST(sum(a) AS DOUBLE) AS s, count(*) AS n, row_number() OVER (PARTITION BY scenario ORDER BY cluster) - 1 AS k FROM m GROUP BY 1, 2), z AS (SELECT scenario, count(*) AS of_ FROM s GROUP BY 1),
d AS (SELECT r, z.scenario, CAST('0x' || substr(md5(7 || ':' || r || ':' || z.scenario || ':' || j), 1, 8) AS BIGINT) % of_ AS k FROM z, range(2000) t(r), range(of_) u(j)),
x AS (SELECT r, sum(s) / sum(n) AS mean FROM d JOIN s ON s.scenario = d.scenario AND s.k = d.k GROUP BY r) SELECT round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high FROM x""")
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    tasks = _trials(spark, d, "correct").withColumn("cluster", F.col("task") % 200).withColumn("value", F.col("correct").cast("double"))
    return evaluation.bootstrap(tasks, "scenario", "cluster", "value", replicates=2000).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query()
def visual_episodes(spark: SparkSession, d: str) -> DataFrame:
    cells = pixels(spark, d).groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "luma"))), lambda p: p["luma"]).alias("luma"))
    planes = cells.select((F.col("frame_id") % 20).alias("stream_no"), F.col("frame_id").alias("ts_ms"), F.lit(8).alias("width"), "luma")
    return sessions.episodes(planes, leaf=2, least=2)


@query()
def compact_text(spark: SparkSession, d: str) -> DataFrame:
    return compact.state_text(tracker.batch_events(observations(spark, d)))


PROPOSALS = """proposals AS (SELECT stream_no, ts_ms, x // 40 * 40 AS "left", y // 40 * 40 AS top, x // 40 * 40 + 80 AS "right", y // 40 * 40 + 40 AS bottom FROM observations)"""


def _proposals(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).selectExpr("stream_no", "ts_ms", "x div 40 * 40 AS left", "y div 40 * 40 AS top", "x div 40 * 40 + 80 AS right", "y div 40 * 40 + 40 AS bottom")


@query(f"""WITH {PROPOSALS}, g AS (SELECT *, count(*) AS proposals FROM proposals GROUP BY ALL)
SELECT *, row_number() OVER w - 1 AS leaf_no, CAST(coalesce(sum(proposals) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_member FROM g WINDOW w AS (PARTITION BY stream_no, ts_ms ORDER BY "left", top, "right", bottom)""")
def proposal_leaves(spark: SparkSession, d: str) -> DataFrame:
    return regions.leaves(_proposals(spark, d), ["stream_no", "ts_ms"])


@query()
def merged_regions(spark: SparkSession, d: str) -> DataFrame:
    return regions.merged(_proposals(spark, d), ["stream_no", "ts_ms"], 480, 1280)


@query(f"""WITH {FRAMES}, o AS (SELECT stream_no, frame_no, CASE WHEN frame_no % 9 = 5 THEN ts_ms - 1000000000 ELSE ts_ms END AS ts_ms, CASE WHEN frame_no % 17 = 4 THEN 0 ELSE 560 END AS fw, fh, obs_index, x, y, w, h, conf * 1.05 AS conf FROM numbered),
e AS (SELECT *, CASE WHEN NOT conf BETWEEN 0 AND 1 THEN 'confidence' WHEN NOT (w > 0 AND h > 0 AND x + w <= fw AND y + h <= fh) THEN 'box' END AS wrong FROM o),
f AS (SELECT stream_no, frame_no, min(ts_ms) AS ts_ms, any_value(fw) AS fw, count(*) AS n, min(CASE WHEN wrong IS NOT NULL THEN obs_index END) AS first_at, arg_min(wrong, obs_index) AS what FROM e GROUP BY 1, 2),
b AS (SELECT *, max(CASE WHEN fw > 0 AND what IS NULL AND n <= 9 THEN ts_ms END) OVER (PARTITION BY stream_no ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f),
p AS (SELECT *, CASE WHEN fw = 0 THEN 'frame_size' WHEN ts_ms < before THEN 'time_goes_back' WHEN what IS NOT NULL THEN what WHEN n > 9 THEN 'too_many_elements' END AS problem FROM b)
SELECT stream_no, frame_no, problem, CASE WHEN problem IN ('confidence', 'box') THEN first_at END AS obs_index FROM p WHERE problem IS NOT NULL""")
def frame_validation(spark: SparkSession, d: str) -> DataFrame:
    n = frames.frame_numbers(observations(spark, d)).withColumn("conf", F.col("conf") * 1.05)
    n = n.withColumn("ts_ms", F.when(F.col("frame_no") % 9 == 5, F.col("ts_ms") - 1_000_000_000).otherwise(F.col("ts_ms")))
    n = n.withColumn("fw", F.when(F.col("frame_no") % 17 == 4, 0).otherwise(560).cast("long"))
    return quality.frame_problems(n, "frame_no", most=9)


@query()
def text_regions(spark: SparkSession, d: str) -> DataFrame:
    scores = F.transform("embedding", lambda v: F.least(F.lit(1.0), F.abs(v.cast("double")) * 6).cast("float"))
    maps = table(spark, d, "embeddings").select("vec_id", F.lit(8).alias("map_h"), F.lit(8).alias("map_w"), F.lit(80).alias("src_h"), F.lit(160).alias("src_w"), scores.alias("scores"))
    return detection.detect(maps, "vec_id")
