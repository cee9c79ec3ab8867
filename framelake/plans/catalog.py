"""One query for each operator family, with the SQL an independent engine answers it by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as G
from ..functions import texts as T
from ..operators import frames, planes, series
from ..sources.tables import ORACLE_VIEWS, frame_times, observations, pixels, table
from ..streaming import tracker
from . import state

SAMPLE_MS, GATE_MS = 43_200_000, 3_600_000
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            rest = body[body.upper().index("WITH") + 4 :] if body.upper().startswith("WITH") else None
            recursive = rest is not None and rest.strip().upper().startswith("RECURSIVE")
            rest = rest.strip()[9:] if recursive else rest
            ORACLE[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{ORACLE_VIEWS}" + (f", {rest}" if rest is not None else body)
        return f

    return add


FRAMES = "numbered AS (SELECT *, dense_rank() OVER (PARTITION BY stream_no ORDER BY ts_ms) - 1 AS frame_no FROM observations)"
IOU = """CASE WHEN least(p.x + p.w, n.x + n.w) > greatest(p.x, n.x) AND least(p.y + p.h, n.y + n.h) > greatest(p.y, n.y)
  THEN CAST((least(p.x + p.w, n.x + n.w) - greatest(p.x, n.x)) * (least(p.y + p.h, n.y + n.h) - greatest(p.y, n.y)) AS DOUBLE)
    / (p.w * p.h + n.w * n.h - (least(p.x + p.w, n.x + n.w) - greatest(p.x, n.x)) * (least(p.y + p.h, n.y + n.h) - greatest(p.y, n.y))) ELSE 0.0 END"""
NORM = lambda c: f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"

SCORED = f"""{FRAMES}, scored AS (
  SELECT n.stream_no, n.frame_no, p.obs_index AS p_obs_index, n.obs_index AS n_obs_index, {IOU} AS iou, {NORM('p.txt')} = {NORM('n.txt')} AS text_equal
  FROM numbered p JOIN numbered n ON p.stream_no = n.stream_no AND p.frame_no + 1 = n.frame_no
), candidates AS (
  SELECT *, 0.35::DOUBLE * iou + CASE WHEN text_equal THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END + 0.05::DOUBLE AS score FROM scored
)"""


@query(f"WITH {SCORED} SELECT stream_no, frame_no, p_obs_index, n_obs_index, iou, score, score >= 0.3 AND iou > 0.1 AS eligible FROM candidates WHERE iou > 0")
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    scored = frames.match_scores(frames.likely_pairs(observations(spark, d)))
    return scored.where("iou > 0").select("stream_no", "frame_no", "p_obs_index", "n_obs_index", "iou", "score", "eligible")


@query(f"""WITH RECURSIVE {SCORED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stream_no, frame_no ORDER BY score DESC, iou DESC, p_obs_index, n_obs_index) AS rk FROM candidates WHERE score >= 0.3 AND iou > 0.1
), fold AS (
  SELECT stream_no, frame_no, 0::BIGINT AS rk, []::BIGINT[] AS ps, []::BIGINT[] AS ns FROM (SELECT DISTINCT stream_no, frame_no FROM ranked)
  UNION ALL
  SELECT f.stream_no, f.frame_no, r.rk, CASE WHEN list_contains(ps, p_obs_index) OR list_contains(ns, n_obs_index) THEN ps ELSE list_append(ps, p_obs_index) END,
    CASE WHEN list_contains(ps, p_obs_index) OR list_contains(ns, n_obs_index) THEN ns ELSE list_append(ns, n_obs_index) END
  FROM fold f JOIN ranked r ON f.stream_no = r.stream_no AND f.frame_no = r.frame_no AND r.rk = f.rk + 1
), done AS (SELECT stream_no, frame_no, arg_max(ps, rk) AS ps, arg_max(ns, rk) AS ns FROM fold GROUP BY ALL)
SELECT stream_no, frame_no, i - 1 AS pick, ps[i] AS p_obs_index, ns[i] AS n_obs_index FROM done, unnest(range(1, len(ps) + 1)) u(i)""")
def greedy_assignment(spark: SparkSession, d: str) -> DataFrame:
    scored = frames.match_scores(frames.likely_pairs(observations(spark, d))).where("eligible")
    return frames.greedy_assignment(scored, ["stream_no", "frame_no"], "p_obs_index", "n_obs_index", [F.desc("score"), F.desc("iou"), "p_obs_index", "n_obs_index"])


@query(f"SELECT doc_id, md5({NORM('text')}) AS norm_md5, CAST(length({NORM('text')}) AS INTEGER) AS norm_chars, regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AS spoken, CASE WHEN {NORM('text')} = '' THEN NULL ELSE {NORM('lang')} END AS role_key FROM documents")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    norm, key = T.normalize(F.col("text")), T.exact_key(F.col("text"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", F.md5(norm.cast("binary")).alias("norm_md5"), F.char_length(norm).alias("norm_chars"), T.spoken(F.col("text")).alias("spoken"), key["role"].alias("role_key"))


@query("""SELECT doc_id, md5(CASE WHEN text = '' THEN '\\e' ELSE replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') END) AS escaped_md5 FROM documents""")
def state_text_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.state_text(F.col("text")).cast("binary")).alias("escaped_md5"))


@query("""WITH r AS (SELECT stream_no, ts_ms, obs_index, fw, fh, x * 2 - 100 AS x, y - 30 AS y, w, h, txt FROM observations),
c AS (SELECT *, least(greatest(x, 0), fw) AS cx, least(greatest(y, 0), fh) AS cy FROM r),
e AS (SELECT *, least(x + w, fw) - cx AS cw, least(y + h, fh) - cy AS ch FROM c)
SELECT stream_no, ts_ms, obs_index, cx, cy, cw, ch, cw > 0 AND ch > 0 AS kept, x + w <= fw AND y + h <= fh AS fits, w * h AS area FROM e""")
def region_clamp(spark: SparkSession, d: str) -> DataFrame:
    r = observations(spark, d).select("stream_no", "ts_ms", "obs_index", "fw", "fh", (F.col("x") * 2 - 100).alias("x"), (F.col("y") - 30).alias("y"), "w", "h")
    c = G.clamped(*(F.col(n) for n in "xywh"))
    out = r.select("*", *(v.alias(f"c{k}") for k, v in c.items()))
    return out.select("stream_no", "ts_ms", "obs_index", "cx", "cy", "cw", "ch", ((F.col("cw") > 0) & (F.col("ch") > 0)).alias("kept"), G.fits().alias("fits"), G.area().alias("area"))


@query(f"""WITH {FRAMES}, points AS (SELECT stream_no, frame_no + 1 AS frame_no, obs_index AS point_no, x + 50 AS px, y + 15 AS py FROM numbered),
hits AS (SELECT p.stream_no, p.frame_no, p.point_no, count(n.obs_index) AS n, min(n.obs_index) AS one
  FROM points p LEFT JOIN numbered n ON p.stream_no = n.stream_no AND p.frame_no = n.frame_no AND px >= x AND px < x + w AND py >= y AND py < y + h GROUP BY ALL)
SELECT stream_no, frame_no, point_no, n, CASE n WHEN 0 THEN 'unassociated' WHEN 1 THEN 'associated' ELSE 'ambiguous' END AS state, CASE WHEN n = 1 THEN one END AS obs_index FROM hits""")
def point_in_element(spark: SparkSession, d: str) -> DataFrame:
    obs = frames.frame_numbers(observations(spark, d))
    points = obs.select("stream_no", (F.col("frame_no") + 1).alias("frame_no"), F.col("obs_index").alias("point_no"), (F.col("x") + 50).alias("px"), (F.col("y") + 15).alias("py"))
    return frames.point_hits(points, obs, ["stream_no", "frame_no"])


ANCHORS = f"""{FRAMES}, once AS (SELECT *, {NORM('txt')} AS key, count(*) OVER (PARTITION BY stream_no, frame_no, {NORM('txt')}) AS c FROM numbered),
anchors AS (SELECT n.stream_no, n.frame_no, n.key, p.obs_index AS p_obs_index, n.obs_index AS n_obs_index, n.x - p.x AS dx, n.y - p.y AS dy
  FROM once p JOIN once n ON p.stream_no = n.stream_no AND p.frame_no + 1 = n.frame_no AND p.key = n.key AND p.c = 1 AND n.c = 1)"""


@query(f"WITH {ANCHORS} SELECT * FROM anchors")
def unique_text_anchors(spark: SparkSession, d: str) -> DataFrame:
    return frames.unique_anchors(observations(spark, d)).select("stream_no", "frame_no", "key", "p_obs_index", "n_obs_index", "dx", "dy")


@query(f"""WITH {ANCHORS}, b AS (SELECT *, sign(dx) * ((abs(dx) + 100) // 200) AS bx, sign(dy) * ((abs(dy) + 100) // 200) AS b_y FROM anchors),
g AS (SELECT stream_no, frame_no, bx, b_y, count(*) AS support, list_sort(list(dx)) AS xs, list_sort(list(dy)) AS ys FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY stream_no, frame_no ORDER BY support DESC, bx, b_y) AS rk FROM g WHERE support >= 2)
SELECT stream_no, frame_no, support, xs[len(xs) // 2 + 1] AS dx, ys[len(ys) // 2 + 1] AS dy FROM r WHERE rk = 1""")
def dominant_translation_bins(spark: SparkSession, d: str) -> DataFrame:
    return frames.dominant_translation(frames.unique_anchors(observations(spark, d)), width=200, least=2)


DIFF = f"""{FRAMES}, keyed AS (
  SELECT *, {NORM('txt')} AS key, row_number() OVER (PARTITION BY stream_no, frame_no, {NORM('txt')} ORDER BY obs_index) AS rank, CAST(round(CAST(conf AS FLOAT) * 10) / 10 AS FLOAT) AS q FROM numbered
), frame_list AS (SELECT DISTINCT stream_no, frame_no, ts_ms FROM numbered), pairs AS (
  SELECT coalesce(p.stream_no, n.stream_no) AS stream_no, coalesce(n.frame_no, p.frame_no + 1) AS frame_no, coalesce(p.key, n.key) AS key, coalesce(p.rank, n.rank) AS rank,
    p.x AS px, p.y AS py, p.q AS pq, n.x AS nx, n.y AS ny, n.q AS nq
  FROM keyed p FULL OUTER JOIN keyed n ON p.stream_no = n.stream_no AND p.frame_no + 1 = n.frame_no AND p.key = n.key AND p.rank = n.rank
), log AS (
  SELECT p.stream_no, p.frame_no, key, rank, t.type, CASE WHEN t.type = 'disappeared' THEN px ELSE nx END AS x, CASE WHEN t.type = 'disappeared' THEN py ELSE ny END AS y,
    CASE WHEN t.type = 'disappeared' THEN pq ELSE nq END AS conf, f.ts_ms
  FROM pairs p JOIN frame_list f ON f.stream_no = p.stream_no AND f.frame_no = p.frame_no
  CROSS JOIN (VALUES ('disappeared'), ('appeared'), ('moved'), ('content_changed')) t(type)
  WHERE p.frame_no > 0 AND CASE t.type WHEN 'disappeared' THEN nx IS NULL WHEN 'appeared' THEN px IS NULL WHEN 'moved' THEN px <> nx OR py <> ny ELSE px IS NOT NULL AND nx IS NOT NULL AND pq <> nq END
), full_log AS (
  SELECT * FROM log UNION ALL BY NAME SELECT stream_no, frame_no, key, rank, 'snapshot' AS type, x, y, q AS conf, ts_ms FROM keyed WHERE frame_no = 0
), seq AS (
  SELECT *, row_number() OVER (PARTITION BY stream_no ORDER BY ts_ms, list_position(['snapshot', 'disappeared', 'moved', 'content_changed', 'appeared'], type), key, rank) - 1 AS sequence FROM full_log
)"""


@query(f"WITH {DIFF} SELECT stream_no, frame_no, key, rank, x, y, conf, type, ts_ms FROM log")
def frame_diff_events(spark: SparkSession, d: str) -> DataFrame:
    return frames.frame_diff(observations(spark, d))


@query(f"WITH {DIFF} SELECT * FROM seq")
def event_sequence(spark: SparkSession, d: str) -> DataFrame:
    return frames.event_log(observations(spark, d))


@query(f"WITH {DIFF} SELECT stream_no, type, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM seq GROUP BY ALL")
def family_counts(spark: SparkSession, d: str) -> DataFrame:
    return state.family_counts(frames.event_log(observations(spark, d)))




@query(f"""WITH {DIFF}, m AS (SELECT * FROM seq WHERE ts_ms <= (SELECT (min(ts_ms) + max(ts_ms)) // 2 FROM seq)),
latest AS (SELECT *, row_number() OVER (PARTITION BY stream_no, key, rank ORDER BY sequence DESC) AS rk FROM m)
SELECT stream_no, key, rank, x, y, conf FROM latest WHERE rk = 1 AND type <> 'disappeared'""")
def state_at(spark: SparkSession, d: str) -> DataFrame:
    log = frames.event_log(observations(spark, d)).withColumn("element_no", F.struct("key", "rank")).withColumn("w", F.lit(100)).withColumn("h", F.lit(30)).withColumn("txt", F.col("key")).withColumn("role", F.lit("text"))
    # every row of this log carries the element's confidence, so a move brings it too
    log = log.withColumn("type", F.when(F.col("type") == "moved", "content_changed").otherwise(F.col("type")))
    ends = observations(spark, d).agg(((F.min("ts_ms") + F.max("ts_ms")) / 2).cast("long").alias("mid"))
    cut = log.join(F.broadcast(ends), F.col("ts_ms") <= F.col("mid"))  # one row
    found = state.state_at(cut)
    return found.select("stream_no", F.col("element_no.key").alias("key"), F.col("element_no.rank").alias("rank"), "x", "y", "conf")


@query(f"WITH {DIFF}, top AS (SELECT stream_no, max(ts_ms) AS t FROM seq GROUP BY 1) SELECT stream_no, sequence, type, key, rank FROM seq JOIN top USING (stream_no) WHERE t - ts_ms <= 1000 AND ts_ms <= t")
def recent_changes(spark: SparkSession, d: str) -> DataFrame:
    log = frames.event_log(observations(spark, d)).withColumn("t", F.max("ts_ms").over(W.partitionBy("stream_no")))
    return log.where((F.col("ts_ms") <= F.col("t")) & (F.col("t") - F.col("ts_ms") <= 1000)).select("stream_no", "sequence", "type", "key", "rank")


SAMPLER = """RECURSIVE s AS (
  SELECT stream_no, min(t_ms) AS t_ms FROM frame_times GROUP BY 1
  UNION ALL
  SELECT s.stream_no, (SELECT min(f.t_ms) FROM frame_times f WHERE f.stream_no = s.stream_no AND f.t_ms >= s.t_ms + {ms}) AS t_ms FROM s
  WHERE EXISTS (SELECT 1 FROM frame_times f WHERE f.stream_no = s.stream_no AND f.t_ms >= s.t_ms + {ms})
)"""


@query(f"""WITH {SAMPLER.format(ms=SAMPLE_MS)}, ends AS (SELECT f.stream_no, max(f.t_ms) AS t FROM frame_times f GROUP BY 1), last AS (SELECT stream_no, max(t_ms) AS l FROM s GROUP BY 1)
SELECT stream_no, t_ms, false AS terminal FROM s UNION ALL SELECT e.stream_no, t, true FROM ends e JOIN last USING (stream_no) WHERE t <> l""")
def frame_sampler(spark: SparkSession, d: str) -> DataFrame:
    return series.sampled_times(frame_times(spark, d), SAMPLE_MS)


@query(f"WITH {SAMPLER.format(ms=GATE_MS)}, g AS (SELECT stream_no, lag(t_ms) OVER (PARTITION BY stream_no ORDER BY t_ms) AS from_ms, t_ms AS to_ms FROM s) SELECT * FROM g WHERE from_ms IS NOT NULL")
def activity_gate(spark: SparkSession, d: str) -> DataFrame:
    return series.gated_times(frame_times(spark, d), GATE_MS)


@query("""WITH ids AS (SELECT DISTINCT stream_no, x // 5 AS id FROM observations), lagged AS (SELECT *, CASE WHEN lag(id) OVER (PARTITION BY stream_no ORDER BY id) = id - 1 THEN 0 ELSE 1 END AS start FROM ids),
runs AS (SELECT *, sum(start) OVER (PARTITION BY stream_no ORDER BY id) AS run FROM lagged), ends AS (SELECT stream_no, run, min(id) AS a, max(id) AS b, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS l FROM runs GROUP BY ALL)
SELECT stream_no, string_agg(CASE WHEN b - a >= 2 THEN a || '-' || b ELSE l END, ',' ORDER BY a) AS ids FROM ends GROUP BY 1""")
def id_ranges(spark: SparkSession, d: str) -> DataFrame:
    return series.id_ranges(observations(spark, d).select("stream_no", F.expr("x div 5").alias("id")), ["stream_no"], "id")


@query(f"""WITH {DIFF}, b AS (SELECT *, CASE WHEN lag(type) OVER w IS NOT DISTINCT FROM type AND lag(ts_ms) OVER w IS NOT DISTINCT FROM ts_ms AND sequence > 0 THEN 0 ELSE 1 END AS brk FROM seq WINDOW w AS (PARTITION BY stream_no ORDER BY sequence)),
c AS (SELECT *, sum(brk) OVER (PARTITION BY stream_no ORDER BY sequence) AS run FROM b), e AS (SELECT *, (row_number() OVER (PARTITION BY stream_no, run ORDER BY sequence) - 1) // 2 AS part FROM c)
SELECT stream_no, sequence, type, dense_rank() OVER (PARTITION BY stream_no ORDER BY run, part) - 1 AS run_no FROM e""")
def run_breaks(spark: SparkSession, d: str) -> DataFrame:
    return series.broken_runs(frames.event_log(observations(spark, d)), ["stream_no"], ["sequence"], ["type", "ts_ms"], chunk=2).select("stream_no", "sequence", "type", "run_no")


@query(f"""WITH {SAMPLER.format(ms=SAMPLE_MS)} SELECT DISTINCT f.stream_no, f.t_ms, (SELECT max(t_ms) FROM s WHERE s.stream_no = f.stream_no AND s.t_ms <= f.t_ms) AS latest,
(SELECT min(t_ms) FROM s WHERE s.stream_no = f.stream_no AND s.t_ms > f.t_ms) AS next FROM frame_times f""")
def asof_sample(spark: SparkSession, d: str) -> DataFrame:
    times, samples = frame_times(spark, d).distinct(), series.sampled_times(frame_times(spark, d), SAMPLE_MS, terminal=False)
    latest = series.as_of(times, samples, "stream_no", "t_ms", "t_ms", "latest")
    return series.as_of(latest, samples, "stream_no", "t_ms", "t_ms", "next", forward=True)


CHANGED = "changed AS (SELECT n.frame_id, n.x, n.y, abs(n.luma - p.luma) AS diff FROM pixels n JOIN pixels p ON p.frame_id = n.frame_id - 1 AND p.x = n.x AND p.y = n.y WHERE abs(n.luma - p.luma) >= 24)"


@query(f"WITH {CHANGED} SELECT frame_id, x // 2 AS leaf_x, y // 2 AS leaf_y, count(*) AS changed FROM changed GROUP BY ALL HAVING count(*) >= 2")
def pixel_diff_leaves(spark: SparkSession, d: str) -> DataFrame:
    return planes.changed_leaves(planes.changes(pixels(spark, d)), leaf=2, least=2)


@query("SELECT frame_id, x // 3 AS x, y // 3 AS y, CAST(sum(luma) // count(*) AS BIGINT) AS luma FROM pixels GROUP BY ALL")
def box_downsample(spark: SparkSession, d: str) -> DataFrame:
    return planes.box_mean(pixels(spark, d), 3)


CENSUS = """desc_bits AS (
  SELECT c.frame_id, c.x, c.y, CAST(sum(CASE WHEN n.luma < c.luma THEN 1::BIGINT << ((n.y - c.y + {r}) * {s} + n.x - c.x + {r} - CASE WHEN (n.y - c.y) * {s} + n.x - c.x > 0 THEN 1 ELSE 0 END) ELSE 0 END) AS BIGINT) AS descriptor, count(*) AS k
  FROM pixels c JOIN pixels n ON c.frame_id = n.frame_id AND abs(c.x - n.x) <= {r} AND abs(c.y - n.y) <= {r} AND (c.x <> n.x OR c.y <> n.y) GROUP BY ALL),
census AS (SELECT frame_id, x, y, CASE WHEN k = {s} * {s} - 1 THEN descriptor ELSE 0 END AS descriptor FROM desc_bits)"""


@query(f"WITH {CENSUS.format(r=3, s=7)} SELECT * FROM census")
def census(spark: SparkSession, d: str) -> DataFrame:
    return planes.census(pixels(spark, d))


INNER = "inner_d AS (SELECT frame_id, x, y, descriptor AS d FROM census WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6)"
NEAREST = f"""{CENSUS.format(r=1, s=3)}, {INNER},
fw AS (SELECT b.frame_id AS pair_id, a.x AS ax, a.y AS ay, arg_min({{'x': b.x, 'y': b.y}}, {{'d': bit_count(xor(a.d, b.d)), 'y': b.y, 'x': b.x}}) AS m, min(bit_count(xor(a.d, b.d))) AS distance FROM inner_d a JOIN inner_d b ON a.frame_id = b.frame_id - 1 AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY ALL),
bw AS (SELECT a.frame_id AS pair_id, a.x AS bx, a.y AS "by", arg_min({{'x': b.x, 'y': b.y}}, {{'d': bit_count(xor(a.d, b.d)), 'y': b.y, 'x': b.x}}) AS m FROM inner_d a JOIN inner_d b ON a.frame_id - 1 = b.frame_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY ALL),
nn AS (SELECT fw.pair_id, fw.ax, fw.ay, fw.m.x AS bx, fw.m.y AS "by", fw.distance, CASE WHEN bw.m.x = fw.ax AND bw.m.y = fw.ay THEN 'matched' ELSE 'inconsistent' END AS state FROM fw JOIN bw ON fw.pair_id = bw.pair_id AND fw.m.x = bw.bx AND fw.m.y = bw."by")"""


def _mutual(spark: SparkSession, d: str) -> DataFrame:
    inner = planes.census(pixels(spark, d), 1).where("x between 1 and 6 and y between 1 and 6").withColumnRenamed("descriptor", "d")
    old, new = inner.withColumn("pair_id", F.col("frame_id") + 1), inner.withColumn("pair_id", F.col("frame_id"))
    return planes.mutual(planes.nearest(old, new, 2), planes.nearest(new, old, 2))


@query(f"""WITH {NEAREST} SELECT pair_id, ax, ay, bx, "by", CAST(distance AS INTEGER) AS distance, state FROM nn""")
def mutual_nn(spark: SparkSession, d: str) -> DataFrame:
    return _mutual(spark, d)


@query(f"""WITH {NEAREST}, mv AS (SELECT pair_id, bx - ax AS dx, "by" - ay AS dy, bx, "by" FROM nn WHERE state = 'matched' AND (bx <> ax OR "by" <> ay)),
g AS (SELECT pair_id, CAST(floor(dx / 2.0) AS BIGINT) AS cx, CAST(floor(dy / 2.0) AS BIGINT) AS cy, count(*) AS support, list_sort(list(dx)) AS xs, list_sort(list(dy)) AS ys, min(bx) AS "left", max(bx) AS "right", min("by") AS top, max("by") AS bottom FROM mv GROUP BY ALL),
h AS (SELECT *, xs[(len(xs) - 1) // 2 + 1] AS dx, ys[(len(ys) - 1) // 2 + 1] AS dy FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY support DESC, dx * dx + dy * dy DESC, cy, cx) AS rk FROM h)
SELECT pair_id, support, dx, dy, "left", top, "right", bottom FROM r WHERE rk = 1""")
def motion_clusters(spark: SparkSession, d: str) -> DataFrame:
    moves = _mutual(spark, d).where("state = 'matched'").select("pair_id", (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by") - F.col("ay")).alias("dy"), "bx", "by")
    return planes.motion_clusters(moves)


@query("""WITH t AS (SELECT n.frame_id, count(*) AS n, count(*) FILTER (abs(n.luma - p.luma) > 16 AND abs(n.luma - m.luma) > 16) AS residual FROM pixels n
JOIN pixels p ON p.frame_id = n.frame_id - 1 AND p.x = n.x AND p.y = n.y JOIN pixels m ON m.frame_id = n.frame_id - 1 AND m.x = n.x - 1 AND m.y = n.y GROUP BY 1)
SELECT frame_id, n, residual, residual * 1000000 // n AS ppm FROM t""")
def residual_ppm(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d)
    old = px.select((F.col("frame_id") + 1).alias("frame_id"), "x", "y", F.col("luma").alias("still"))
    moved = px.select((F.col("frame_id") + 1).alias("frame_id"), (F.col("x") + 1).alias("x"), "y", F.col("luma").alias("moved"))
    both = px.join(old, ["frame_id", "x", "y"]).join(moved, ["frame_id", "x", "y"])
    off = (F.abs(F.col("luma") - F.col("still")) > 16) & (F.abs(F.col("luma") - F.col("moved")) > 16)
    return both.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(off).alias("residual")).withColumn("ppm", G.ratio_ppm(F.col("residual"), F.col("n")))


@query("""WITH gaps AS (SELECT t_ms - lag(t_ms) OVER (PARTITION BY stream_no ORDER BY t_ms) AS gap FROM frame_times), h AS (SELECT CASE WHEN gap = 0 THEN 0 ELSE length(bin(gap)) - 1 END AS bin, count(*) AS n FROM gaps WHERE gap IS NOT NULL GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(64) r(i) LEFT JOIN h ON h.bin = i""")
def latency_hist(spark: SparkSession, d: str) -> DataFrame:
    gap = F.col("t_ms") - F.lag("t_ms").over(W.partitionBy("stream_no").orderBy("t_ms"))
    return series.histogram64(frame_times(spark, d).select(gap.alias("gap")).where("gap IS NOT NULL"), G.log2_bin(F.col("gap")))


@query("""WITH r AS (SELECT frame_id, x // 4 AS cell_x, y // 4 AS cell_y, luma AS score, x, y, row_number() OVER (PARTITION BY frame_id, x // 4, y // 4 ORDER BY luma DESC, y, x) AS rk FROM pixels WHERE luma >= 12)
SELECT frame_id, cell_x, cell_y, score, x, y FROM r WHERE rk = 1""")
def corner_topk(spark: SparkSession, d: str) -> DataFrame:
    return planes.corners(pixels(spark, d).withColumnRenamed("luma", "score"), 4)


@query("""WITH a AS (SELECT stream_no, ts_ms, obs_index, x // 50 AS bx, y // 50 AS "by", CASE WHEN obs_index < 2 THEN 0 ELSE 1 END AS part FROM observations),
r AS (SELECT *, row_number() OVER (PARTITION BY stream_no, ts_ms, bx, "by" ORDER BY part, obs_index) AS k FROM a)
SELECT stream_no, ts_ms, obs_index, bx, "by", CASE WHEN part = 0 THEN 'prefix' WHEN k > 1 THEN 'duplicate' ELSE 'appended' END AS decision FROM r""")
def quad_fuse(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).select("stream_no", "ts_ms", "obs_index", F.expr("x div 50").alias("bx"), F.expr("y div 50").alias("by"))
    return series.fused(o.where("obs_index < 2"), o.where("obs_index >= 2"), ["stream_no", "ts_ms", "bx", "by"], "obs_index").drop("part")


@query("""WITH r AS (SELECT lang, doc_id, sha256(source || ':' || doc_id) AS priority, row_number() OVER (PARTITION BY lang ORDER BY sha256(source || ':' || doc_id), doc_id) AS k FROM documents) SELECT lang, doc_id, priority FROM r WHERE k <= 50""")
def eviction_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", "doc_id", F.sha2(F.concat_ws(":", "source", "doc_id"), 256).alias("priority"))
    return series.keep_smallest(docs, ["lang"], ["priority", "doc_id"], 50)


@query("""WITH steps AS (SELECT vec_id, r.i AS step, (SELECT arg_min(j, {'v': -embedding[8 * r.i + j + 1], 'j': j}) FROM range(8) q(j)) AS label FROM embeddings, range(8) r(i)),
l AS (SELECT *, lag(label) OVER (PARTITION BY vec_id ORDER BY step) AS before FROM steps) SELECT vec_id, CAST(step AS INTEGER) AS step, CAST(label AS INTEGER) AS label FROM l WHERE label <> 0 AND label IS DISTINCT FROM before""")
def ctc_collapse(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    steps = e.groupBy("vec_id", F.expr("pos div 8").alias("step")).agg(F.min_by((F.col("pos") % 8), F.struct(-F.col("v"), F.col("pos"))).alias("label"))
    return series.collapsed(steps, ["vec_id"], "step", "label").select("vec_id", F.col("step").cast("int").alias("step"), F.col("label").cast("int").alias("label"))


@query("""WITH j AS (SELECT d.lang, d.source, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id))
SELECT lang, source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic, avg(CAST(quality AS DOUBLE)) AS accuracy FROM j GROUP BY GROUPING SETS ((lang), (source), ())""")
def slice_rollup(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return both.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"), F.avg("quality").alias("accuracy"))


@query("""WITH m AS (SELECT lang, doc_id, strlen(text) AS b, sha256(text) AS s FROM documents)
SELECT lang, sha256('[' || string_agg('{"bytes":' || b || ',"sha256":"' || s || '"}', ',' ORDER BY doc_id) || ']') AS digest FROM m GROUP BY 1""")
def artifact_digest(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "documents").select("lang", "doc_id", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha"))
    return series.digests(members, ["lang"], ["doc_id"], "size", "sha").select("lang", "digest")


@query("""WITH g AS (SELECT stream_no, t_ms, t_ms - lag(t_ms) OVER (PARTITION BY stream_no ORDER BY t_ms) AS gap FROM frame_times)
SELECT stream_no, count(*) AS n, min(t_ms) AS first_ms, max(t_ms) AS last_ms, max(t_ms) - min(t_ms) AS duration_ms, max(gap) AS max_gap, count(*) FILTER (gap <= 0) AS not_after FROM g GROUP BY 1""")
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    gap = F.col("t_ms") - F.lag("t_ms").over(W.partitionBy("stream_no").orderBy("t_ms"))
    rows = frame_times(spark, d).withColumn("gap", gap)
    return rows.groupBy("stream_no").agg(F.count(F.lit(1)).alias("n"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"), (F.max("t_ms") - F.min("t_ms")).alias("duration_ms"), F.max("gap").alias("max_gap"), F.count_if(F.col("gap") <= 0).alias("not_after"))


@query(f"""WITH {FRAMES}, m AS (SELECT stream_no, frame_no, max(frame_no) OVER (PARTITION BY stream_no) AS last, {NORM('txt')} AS key FROM numbered)
SELECT stream_no, frame_no, key, 'released' AS change FROM (SELECT DISTINCT stream_no, frame_no + 1 AS frame_no, key FROM m WHERE frame_no < last EXCEPT SELECT stream_no, frame_no, key FROM m)
UNION ALL SELECT stream_no, frame_no, key, 'kept' FROM (SELECT stream_no, frame_no + 1 AS frame_no, key FROM m WHERE frame_no < last INTERSECT SELECT stream_no, frame_no, key FROM m)""")
def latch_sets(spark: SparkSession, d: str) -> DataFrame:
    now = frames.frame_numbers(observations(spark, d)).select("stream_no", "frame_no", T.normalize(F.col("txt")).alias("key"))
    last = F.max("frame_no").over(W.partitionBy("stream_no"))
    latched = now.withColumn("last", last).where("frame_no < last").select("stream_no", (F.col("frame_no") + 1).alias("frame_no"), "key")
    return latched.subtract(now).withColumn("change", F.lit("released")).union(latched.intersect(now).withColumn("change", F.lit("kept")))


@query()
def tracker_events(spark: SparkSession, d: str) -> DataFrame:
    return tracker.batch_events(observations(spark, d))


@query()
def tracker_state(spark: SparkSession, d: str) -> DataFrame:
    return state.state_at(tracker.batch_events(observations(spark, d)))


def entry(spark: SparkSession, d: str = "/root/testdata/sf0.001") -> DataFrame:
    """Event family counts of the snapshot diff."""
    return frames.frame_diff(observations(spark, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
