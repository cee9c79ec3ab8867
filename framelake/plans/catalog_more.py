"""Queries of lost elements, regions over time, motion, marks, arithmetic and model stages, with their SQL where there is one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as G
from ..functions import texts as T
from ..operators import frames, manifests, models, motion, planes, series
from ..sources import files
from ..sources.tables import observations, pixels, table
from ..streaming import episodes, tracker
from .catalog import DIFF, FRAMES, IOU, NEAREST, NORM, _mutual, query

LOST = f"""{FRAMES}, e AS (SELECT *, {NORM('txt')} AS key, CASE WHEN obs_index % 5 = 4 THEN NULL ELSE role END AS r FROM numbered),
lost AS (SELECT stream_no, frame_no + 2 AS frame_no, obs_index AS element_no, x, y, w, h, key, r FROM e), lm AS (
  SELECT n.stream_no, n.frame_no, n.obs_index, p.element_no, {IOU} AS overlap, n.r FROM e n JOIN lost p ON p.stream_no = n.stream_no AND p.frame_no = n.frame_no AND p.key = n.key AND p.r IS NOT DISTINCT FROM n.r WHERE n.key <> ''
), matched AS (SELECT stream_no, frame_no, obs_index, element_no, overlap, 0.35::DOUBLE * overlap + 0.6::DOUBLE + CASE WHEN r IS NOT NULL THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS score FROM lm WHERE overlap >= 0.5)"""


def _lost(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    seen = frames.frame_numbers(observations(spark, d)).withColumn("role", F.when(F.col("obs_index") % 5 != 4, F.col("role")))
    lost = seen.select("stream_no", (F.col("frame_no") + 2).alias("frame_no"), F.col("obs_index").alias("element_no"), "x", "y", "w", "h", "txt", "role")
    return seen, lost


@query(f"WITH {LOST} SELECT stream_no, frame_no, obs_index, element_no, round(overlap, 9) AS overlap, round(score, 9) AS score FROM matched")
def lost_matches(spark: SparkSession, d: str) -> DataFrame:
    found = frames.lost_matches(*_lost(spark, d), ["stream_no", "frame_no"])
    return found.select("stream_no", "frame_no", "obs_index", "element_no", F.round("overlap", 9).alias("overlap"), F.round("score", 9).alias("score"))


@query(f"""WITH {LOST}, first AS (SELECT stream_no, frame_no, obs_index, arg_max(element_no, {{'s': score, 'o': -element_no}}) AS element_no FROM matched GROUP BY 1, 2, 3)
SELECT n.stream_no, n.frame_no, n.obs_index, f.element_no FROM e n LEFT JOIN first f ON f.stream_no = n.stream_no AND f.frame_no = n.frame_no AND f.obs_index = n.obs_index
WHERE NOT EXISTS (SELECT 1 FROM e p WHERE p.stream_no = n.stream_no AND p.frame_no = n.frame_no - 1 AND p.key = n.key)""")
def element_arrivals(spark: SparkSession, d: str) -> DataFrame:
    seen, lost = _lost(spark, d)
    keys = ["stream_no", "frame_no"]
    back = frames.lost_matches(seen, lost, keys).groupBy(*keys, "obs_index").agg(F.max_by("element_no", F.struct("score", -F.col("element_no"))).alias("element_no"))
    key = T.normalize(F.col("txt")).alias("key")
    before = seen.select("stream_no", (F.col("frame_no") + 1).alias("frame_no"), key).distinct()
    going_on = seen.select(*keys, "obs_index", key).join(before, [*keys, "key"], "left_semi")
    return frames.arrivals(seen.select(*keys, "obs_index"), going_on, back, keys)


@query(f"""WITH {FRAMES}, pairs AS (SELECT n.stream_no, n.frame_no, p.obs_index AS p_no, n.obs_index AS n_no, p.x AS px, p.y AS py, n.x AS nx, n.y AS ny FROM numbered p JOIN numbered n ON p.stream_no = n.stream_no AND p.frame_no + 1 = n.frame_no)
SELECT stream_no, frame_no, p_no, n_no, greatest(0, least(px, nx) + 100 - greatest(px, nx)) * greatest(0, least(py, ny) + 30 - greatest(py, ny)) AS shared, 4 * (px - nx) * (px - nx) + 4 * (py - ny) * (py - ny) AS apart
FROM pairs WHERE greatest(0, px - 16) < nx + 116 AND greatest(0, nx - 16) < px + 116 AND greatest(0, py - 16) < ny + 46 AND greatest(0, ny - 16) < py + 46""")
def near_regions(spark: SparkSession, d: str) -> DataFrame:
    n = frames.frame_numbers(observations(spark, d))
    side = lambda p, shift: n.select("stream_no", (F.col("frame_no") + shift).alias("frame_no"), F.col("obs_index").alias(p + "no"), *(F.col(c).alias(p + c) for c in "xywh"))
    return frames.near_regions(side("p_", 1), side("n_", 0), ["stream_no", "frame_no"])


@query(f"""WITH {NEAREST}, mv AS (SELECT pair_id, bx - ax AS dx, "by" - ay AS dy, bx, "by" FROM nn WHERE state = 'matched' AND (bx <> ax OR "by" <> ay)),
g AS (SELECT pair_id, CAST(floor(dx / 2.0) AS BIGINT) AS cx, CAST(floor(dy / 2.0) AS BIGINT) AS cy, count(*) AS support, list_sort(list(dx)) AS xs, list_sort(list(dy)) AS ys, min(bx) AS l, max(bx) AS r, min("by") AS t, max("by") AS b FROM mv GROUP BY ALL),
h AS (SELECT *, xs[(len(xs) - 1) // 2 + 1] AS dx, ys[(len(ys) - 1) // 2 + 1] AS dy FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY support DESC, dx * dx + dy * dy DESC, cy, cx) AS rk FROM h)
SELECT pair_id, support, l * 4 AS x, t * 4 AS y, least((r + 1) * 4, 30) - l * 4 AS w, least((b + 1) * 4, 27) - t * 4 AS h FROM k WHERE rk = 1""")
def motion_support_box(spark: SparkSession, d: str) -> DataFrame:
    moves = _mutual(spark, d).where("state = 'matched'").select("pair_id", (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by") - F.col("ay")).alias("dy"), "bx", "by")
    clusters = planes.motion_clusters(moves).withColumn("fw", F.lit(30).cast("long")).withColumn("fh", F.lit(27).cast("long"))
    return planes.support_box(clusters, "fw", "fh").select("pair_id", "support", "x", "y", "w", "h")


@query("""WITH s AS (SELECT DISTINCT frame_id, frame_id % 5 - 2 AS dx, frame_id % 3 - 1 AS dy FROM pixels),
t AS (SELECT s.frame_id, count(*) AS n, count(*) FILTER (abs(p.luma - c.luma) > 16 AND abs(p.luma - m.luma) > 16) AS residual FROM s JOIN pixels p ON p.frame_id = s.frame_id - 1
  JOIN pixels c ON c.frame_id = s.frame_id AND c.x = p.x AND c.y = p.y JOIN pixels m ON m.frame_id = s.frame_id AND m.x = p.x + dx AND m.y = p.y + dy GROUP BY 1)
SELECT frame_id, n, residual, residual * 1000000 // n AS ppm FROM t""")
def shifted_residual(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d)
    shifts = px.select("frame_id").distinct().select("frame_id", (F.col("frame_id") % 5 - 2).alias("dx"), (F.col("frame_id") % 3 - 1).alias("dy"))
    return planes.residual(px, shifts)


@query("""WITH s AS (SELECT o_orderkey, 60 + o_orderkey % 1800 AS wide, 60 + o_custkey % 1000 AS high FROM orders)
SELECT o_orderkey, (SELECT min(c) FROM range(24, 400) r(c) WHERE ceil(wide / c) * ceil(high / c) <= 1024) AS cell FROM s""")
def corner_cells(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", G.corner_cell(60 + F.col("o_orderkey") % 1800, 60 + F.col("o_custkey") % 1000).cast("long").alias("cell"))


@query("""WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 9223372036854775807 - event_id WHEN 1 THEN event_id WHEN 2 THEN event_id * 3037000499 ELSE 4294967296 END AS a, CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN user_id ELSE event_id * 1000003 END AS b FROM events),
e AS (SELECT event_id, a::HUGEINT + b AS s, a::HUGEINT - b AS d, a::HUGEINT * b AS p FROM v)
SELECT event_id, CAST(least(s, 9223372036854775807) AS BIGINT) AS total, CAST(greatest(d, 0) AS BIGINT) AS rest, CAST(least(p, 9223372036854775807) AS BIGINT) AS product, CASE WHEN s <= 9223372036854775807 THEN CAST(s AS BIGINT) END AS checked_total, CASE WHEN d >= 0 THEN CAST(d AS BIGINT) END AS checked_rest FROM e""")
def bounded_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "events").selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN 9223372036854775807 - event_id WHEN 1 THEN event_id WHEN 2 THEN event_id * 3037000499 ELSE 4294967296 END AS a", "CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN user_id ELSE event_id * 1000003 END AS b")
    a, b = F.col("a"), F.col("b")
    return v.select("event_id", G.saturating("+", a, b).alias("total"), G.saturating("-", a, b).alias("rest"), G.saturating("*", a, b).alias("product"), G.checked("+", a, b).alias("checked_total"), G.checked("-", a, b).alias("checked_rest"))


LE = lambda v, n: "||".join(f"substr(lpad(hex({v}::UBIGINT), 16, '0'), {2 * k - 1}, 2)" for k in range(8, 8 - n, -1))


@query(f"""WITH k AS (SELECT doc_id, {NORM('substr(text, 1, 40)')} AS t, CASE doc_id % 3 WHEN 0 THEN NULL ELSE lang END AS r, doc_id % 640 AS x, n_chars AS y FROM documents),
b AS (SELECT doc_id, unhex('{tracker.DOMAIN.hex()}' || {LE('strlen(t)', 8)}) || encode(t) || CASE WHEN r IS NULL THEN unhex('00') ELSE unhex('01' || {LE('strlen(r)', 8)}) || encode(r) END || unhex({LE('x', 4)} || {LE('y', 4)} || {LE('100', 4)} || {LE('30', 4)} || {LE('doc_id', 8)}) AS raw FROM k)
SELECT doc_id, sha256(raw) AS priority FROM b""")
def lost_priorities(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    text, role = T.normalize(F.substring("text", 1, 40)), F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    return docs.select("doc_id", T.lost_priority(text, role, F.col("doc_id") % 640, F.col("n_chars"), F.lit(100), F.lit(30), F.col("doc_id"), tracker.DOMAIN).alias("priority"))


@query(f"""WITH {FRAMES}, n AS (SELECT stream_no, frame_no, count(*) AS elements, sum(w * h) AS area FROM numbered GROUP BY ALL)
SELECT *, max(elements) OVER w AS most_elements, max(area) OVER w AS most_area FROM n WINDOW w AS (PARTITION BY stream_no ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def high_water(spark: SparkSession, d: str) -> DataFrame:
    n = frames.frame_numbers(observations(spark, d)).groupBy("stream_no", "frame_no").agg(F.count(F.lit(1)).alias("elements"), F.sum(F.col("w") * F.col("h")).alias("area"))
    return series.high_water(n, ["stream_no"], ["frame_no"], ["elements", "area"])


@query(f"""WITH {FRAMES}, e AS (SELECT stream_no, frame_no, obs_index, txt, CASE WHEN obs_index % 3 = 0 THEN NULL ELSE role END AS role, CAST(round(CAST(conf AS FLOAT) * 10) / 10 AS FLOAT) AS q, CASE WHEN obs_index % 2 = 0 THEN 1 + frame_no % 2 END AS s FROM numbered)
SELECT n.stream_no, n.frame_no, n.obs_index, p.txt IS NOT DISTINCT FROM n.txt AND p.role IS NOT DISTINCT FROM n.role AND p.q IS NOT DISTINCT FROM n.q AS same, p.txt IS NOT DISTINCT FROM n.txt AND p.role IS NOT DISTINCT FROM n.role AND p.q IS NOT DISTINCT FROM n.q AND p.s IS NOT DISTINCT FROM n.s AS same_with_state
FROM e n JOIN e p ON p.stream_no = n.stream_no AND p.frame_no = n.frame_no - 1 AND p.obs_index = n.obs_index""")
def same_content(spark: SparkSession, d: str) -> DataFrame:
    n = frames.frame_numbers(observations(spark, d)).withColumn("role", F.when(F.col("obs_index") % 3 != 0, F.col("role")))
    n = n.withColumn("state", F.when(F.col("obs_index") % 2 == 0, F.create_map(F.lit("a"), (1 + F.col("frame_no") % 2).cast("string"), F.lit("b"), F.lit("x"))))
    side = lambda p, shift: n.select("stream_no", (F.col("frame_no") + shift).alias("frame_no"), "obs_index", *(F.col(c).alias(p + c) for c in ("txt", "role", "conf", "state")))
    both = side("p_", 1).join(side("n_", 0), ["stream_no", "frame_no", "obs_index"])
    return both.select("stream_no", "frame_no", "obs_index", T.same_content("p_", "n_").alias("same"), T.same_content("p_", "n_", state=True).alias("same_with_state"))


@query("""WITH c AS (SELECT n.frame_id, n.x // 2 AS lx, n.y // 2 AS ly, count(*) AS n FROM pixels n JOIN pixels p ON p.frame_id = n.frame_id - 1 AND p.x = n.x AND p.y = n.y WHERE abs(n.luma - p.luma) >= 24 GROUP BY ALL HAVING count(*) >= 2),
p1 AS (SELECT frame_id, lx // 2 AS ax, ly // 2 AS ay, sum(n) AS n, 16 <= 2 * sum(n) AS joined FROM c GROUP BY ALL),
p2 AS (SELECT frame_id, ax // 2 AS bx, ay // 2 AS b_y, sum(CASE WHEN joined THEN n ELSE 0 END) AS n, bool_and(joined) AND 64 <= 2 * sum(n) AS joined FROM p1 GROUP BY ALL)
SELECT c.frame_id, lx * 2 AS x, ly * 2 AS y, 2 AS w, 2 AS h, c.n AS changed FROM c JOIN p1 ON p1.frame_id = c.frame_id AND ax = lx // 2 AND ay = ly // 2 WHERE NOT p1.joined
UNION ALL SELECT p1.frame_id, ax * 4, ay * 4, 4, 4, CAST(p1.n AS BIGINT) FROM p1 JOIN p2 ON p1.frame_id = p2.frame_id AND bx = ax // 2 AND b_y = ay // 2 WHERE p1.joined AND NOT p2.joined
UNION ALL SELECT frame_id, bx * 8, b_y * 8, 8, 8, CAST(n AS BIGINT) FROM p2 WHERE joined""")
def quadtree_regions(spark: SparkSession, d: str) -> DataFrame:
    cells = pixels(spark, d).groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "luma"))), lambda p: p["luma"]).alias("now"))
    before = cells.select((F.col("frame_id") + 1).alias("frame_id"), F.col("now").alias("before"))
    return episodes.changed_regions(cells.join(before, "frame_id").withColumn("width", F.lit(8)), "frame_id", leaf=2, least=2)


@query(f"""WITH {FRAMES}, pairs AS (SELECT n.stream_no, n.frame_no, p.obs_index AS p_no, n.obs_index AS n_no, p.x AS px, p.y AS py, n.x AS nx, n.y AS ny FROM numbered p JOIN numbered n ON p.stream_no = n.stream_no AND p.frame_no + 1 = n.frame_no),
m AS (SELECT *, greatest(0, least(px, nx) + 100 - greatest(px, nx)) * greatest(0, least(py, ny) + 30 - greatest(py, ny)) AS shared, 4 * (px - nx) * (px - nx) + 4 * (py - ny) * (py - ny) AS apart
  FROM pairs WHERE greatest(0, px - 16) < nx + 116 AND greatest(0, nx - 16) < px + 116 AND greatest(0, py - 16) < ny + 46 AND greatest(0, ny - 16) < py + 46)
SELECT stream_no, frame_no, p_no, n_no, CAST(row_number() OVER (PARTITION BY stream_no, frame_no ORDER BY shared DESC, apart, p_no, n_no) AS INTEGER) AS rank FROM m""")
def episode_ranks(spark: SparkSession, d: str) -> DataFrame:
    keys = ["stream_no", "frame_no"]
    return series.ranked(near_regions(spark, d), keys, [F.desc("shared"), "apart", "p_no", "n_no"]).select(*keys, "p_no", "n_no", "rank")


@query(f"""WITH {DIFF}, e AS (SELECT stream_no, ts_ms, type, x // 5 AS id, sequence FROM seq)
SELECT *, CASE WHEN lag(id) OVER (PARTITION BY stream_no, ts_ms, type ORDER BY id, sequence) + 1 = id THEN '' ELSE CAST(id AS VARCHAR) END AS shown FROM e""")
def shown_ids(spark: SparkSession, d: str) -> DataFrame:
    e = frames.event_log(observations(spark, d)).select("stream_no", "ts_ms", "type", F.expr("x div 5").alias("id"), "sequence")
    return series.shown_ids(e, ["stream_no", "ts_ms", "type"], ["id", "sequence"], "id")


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS k FROM documents) SELECT lang, doc_id FROM r WHERE k <= 30""")
def contour_cap(spark: SparkSession, d: str) -> DataFrame:
    """As contours are capped: the last met come first, and so many of them stay."""
    return series.keep_smallest(table(spark, d, "documents").select("lang", "doc_id"), ["lang"], [F.desc("doc_id")], 30)


@query(f"""WITH {DIFF} SELECT stream_no, sequence, md5('{{"specversion":"1.0","id":"' || stream_no || ':' || sequence || '","source":"urn:framelake:stream:' || stream_no || '","sequence":' || sequence || ',"frametime":' || ts_ms
  || ',"datacontenttype":"application/json","type":"' || type || '","data":{{"x":' || x || ',"y":' || y || ',"txt":"' || key || '","conf":' || conf || '}}}}') AS line FROM seq""")
def event_json(spark: SparkSession, d: str) -> DataFrame:
    events = frames.event_log(observations(spark, d)).select("stream_no", "sequence", "ts_ms", "type", "x", "y", F.col("key").alias("txt"), "conf")
    return events.select("stream_no", "sequence", F.md5(files.event_line(events).cast("binary")).alias("line"))


LINES = f"""{FRAMES}, lines AS (SELECT stream_no, row_number() OVER (PARTITION BY stream_no ORDER BY frame_no, obs_index) - 1 AS line_no, CASE WHEN obs_index = 0 AND frame_no % 3 <> 1 THEN '@' || ts_ms || ' !' || frame_no ELSE '+' || obs_index || ' ' || txt END AS line FROM numbered)"""


@query(f"""WITH {LINES}, t AS (SELECT *, CASE WHEN line LIKE '@%' THEN CAST(regexp_extract(line, '^@([0-9]+)', 1) AS BIGINT) END AS at_ms FROM lines WHERE line_no > 0)
SELECT stream_no, line_no, line, last_value(at_ms IGNORE NULLS) OVER (PARTITION BY stream_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block_ms FROM t""")
def state_block_times(spark: SparkSession, d: str) -> DataFrame:
    n = frames.frame_numbers(observations(spark, d))
    line = F.when((F.col("obs_index") == 0) & (F.col("frame_no") % 3 != 1), F.concat(F.lit("@"), "ts_ms", F.lit(" !"), "frame_no")).otherwise(F.concat(F.lit("+"), "obs_index", F.lit(" "), "txt"))
    place = F.row_number().over(W.partitionBy("stream_no").orderBy("frame_no", "obs_index")) - 1
    return files.state_blocks(n.select("stream_no", place.cast("long").alias("line_no"), line.alias("line"))).select("stream_no", "line_no", "line", "block_ms")


@query(f"""WITH {FRAMES}, q AS (SELECT n.stream_no, n.frame_no, p.obs_index AS p_no, n.obs_index AS n_no, n.x - p.x AS dx, n.y - p.y AS dy, least(p.x + 130, n.x + 100) - greatest(p.x + 30, n.x) AS ow, least(p.y + 10, n.y + 30) - greatest(p.y - 20, n.y) AS oh, p.x AS px, p.y AS py, n.x AS nx, n.y AS ny, n.ts_ms
  FROM numbered p JOIN numbered n ON p.stream_no = n.stream_no AND p.frame_no + 1 = n.frame_no)
SELECT stream_no, frame_no, p_no, n_no, abs(dx) >= 16 OR abs(dy) >= 16 AS meaningful, round(CASE WHEN ow > 0 AND oh > 0 THEN CAST(ow * oh AS DOUBLE) / (6000 - ow * oh) ELSE 0 END, 9) AS moved_iou,
  greatest(0, px - 16) < nx + 116 AND greatest(0, nx - 16) < px + 116 AND greatest(0, py - 16) < ny + 46 AND greatest(0, ny - 16) < py + 46 AS near, ts_ms % 7 BETWEEN 2 AND 4 AS lasting,
  'e' || CASE WHEN length(CAST(n_no * 377773 AS VARCHAR)) < 6 THEN lpad(CAST(n_no * 377773 AS VARCHAR), 6, '0') ELSE CAST(n_no * 377773 AS VARCHAR) END AS id, CASE WHEN n_no > 0 THEN n_no * 377773 END AS number FROM q""")
def geometry_predicates(spark: SparkSession, d: str) -> DataFrame:
    p = frames.frame_pairs(observations(spark, d))
    ts = frames.frame_numbers(observations(spark, d)).select("stream_no", "frame_no", "ts_ms").distinct()
    id = T.element_id(F.col("n_obs_index") * 377773)
    return p.join(ts, ["stream_no", "frame_no"]).select(
        "stream_no", "frame_no", F.col("p_obs_index").alias("p_no"), F.col("n_obs_index").alias("n_no"), G.meaningful_move(F.col("n_x") - F.col("p_x"), F.col("n_y") - F.col("p_y")).alias("meaningful"),
        F.round(G.iou("p_", "n_", 30, -20), 9).alias("moved_iou"), G.near("p_", "n_").alias("near"), series.within(F.col("ts_ms") % 7, F.lit(2), 3).alias("lasting"), id.alias("id"), T.element_number(id).alias("number"),
    )


@query("""WITH m AS (SELECT doc_id AS position, CASE doc_id % 9 WHEN 8 THEN 'x' ELSE CASE doc_id WHEN 0 THEN 'media' WHEN 1 THEN 'events' ELSE 'state' END END AS role, CASE doc_id % 11 WHEN 3 THEN '/abs' WHEN 4 THEN 'a//b' WHEN 5 THEN '../up' ELSE 'dir/' || doc_id % 700 END AS path,
  CASE WHEN doc_id % 13 = 2 THEN 0 ELSE n_chars END AS bytes, CASE WHEN doc_id % 17 = 1 THEN upper(sha256(text)) ELSE sha256(text) END AS digest FROM documents),
o AS (SELECT path, count(*) AS n FROM m GROUP BY 1), r AS (SELECT position, CASE WHEN position > 2 OR role <> CASE position WHEN 0 THEN 'media' WHEN 1 THEN 'events' WHEN 2 THEN 'state' END THEN 'role'
  WHEN path IN ('/abs', 'a//b', '../up') THEN 'path' WHEN n > 1 THEN 'repeated_path' WHEN bytes <= 0 THEN 'bytes' WHEN NOT regexp_full_match(digest, '[0-9a-f]{64}') THEN 'digest' END AS problem FROM m JOIN o USING (path)) SELECT * FROM r WHERE problem IS NOT NULL""")
def manifest_rules(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").selectExpr(
        "doc_id AS position", "CASE doc_id % 9 WHEN 8 THEN 'x' ELSE CASE doc_id WHEN 0 THEN 'media' WHEN 1 THEN 'events' ELSE 'state' END END AS role",
        "CASE doc_id % 11 WHEN 3 THEN '/abs' WHEN 4 THEN 'a//b' WHEN 5 THEN '../up' ELSE concat('dir/', doc_id % 700) END AS path",
        "CASE WHEN doc_id % 13 = 2 THEN 0 ELSE n_chars END AS bytes", "CASE WHEN doc_id % 17 = 1 THEN upper(sha2(text, 256)) ELSE sha2(text, 256) END AS digest")
    return manifests.malformed(m, ["media", "events", "state"])


SIDE, TILES = 19, 361


def moving_planes(spark: SparkSession, d: str) -> DataFrame:
    """(stream_no, ts_ms, width, height, luma): each TILES vectors, as tiles of 8 x 8 blocks of 4 x 4 pixels, are a stream's frame; four more show it again at once, still, with its
    lower half moved by 16 pixels to the right, and in another size."""
    tiles = table(spark, d, "embeddings").select(F.expr(f"vec_id div {TILES}").cast("long").alias("stream_no"), F.struct("vec_id", "embedding").alias("v")).groupBy("stream_no").agg(F.array_sort(F.collect_list("v")).alias("vs"))

    def run(batches):
        for batch in batches:
            for stream, vs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                flat = np.zeros((TILES, 64))
                for i, v in enumerate(vs):
                    flat[i] = np.asarray(v["embedding"], float)
                plane = np.clip(np.floor((flat + 1) * 127.5), 0, 255).astype(np.uint8).reshape(SIDE, SIDE, 8, 8).transpose(0, 2, 1, 3).reshape(SIDE * 8, SIDE * 8)
                plane = np.kron(plane, np.ones((4, 4), np.uint8))
                moved = plane.copy()
                moved[300:] = np.roll(plane[300:], 16, 1)
                shown = [plane, plane, plane, moved, moved[:500]]
                yield pa.RecordBatch.from_arrays([pa.array([stream] * 5), pa.array([0, 100, 300, 600, 900]), pa.array([p.shape[1] for p in shown], pa.int32()), pa.array([p.shape[0] for p in shown], pa.int32()), pa.array([p.tobytes() for p in shown], pa.binary())], ["stream_no", "ts_ms", "width", "height", "luma"])

    return tiles.mapInArrow(run, "stream_no long, ts_ms long, width int, height int, luma binary")


@query()
def motion_observed(spark: SparkSession, d: str) -> DataFrame:
    return motion.observed(moving_planes(spark, d)).drop("matches")


@query()
def motion_metrics(spark: SparkSession, d: str) -> DataFrame:
    return motion.run_metrics(motion.observed(moving_planes(spark, d)))


@query()
def episode_metrics(spark: SparkSession, d: str) -> DataFrame:
    cells = pixels(spark, d).groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "luma"))), lambda p: p["luma"]).alias("luma"))
    return episodes.episode_metrics(cells.select((F.col("frame_id") % 20).alias("stream_no"), F.col("frame_id").alias("ts_ms"), F.lit(8).alias("width"), "luma"), leaf=2, least=2)


def bright(tensor: np.ndarray) -> np.ndarray:
    """Stands in for a detector: a map of scores, high where a page is brighter than most."""
    return np.clip((tensor[:, :1] - 0.3) * 3, 0, 1)


def striped(tensor: np.ndarray) -> np.ndarray:
    """Stands in for a recogniser of three classes: a step for each 8 columns, by their mean."""
    mean = tensor[0, 0].mean(axis=0).reshape(-1, 8).mean(axis=1)
    return np.stack([abs(mean) < 0.05, mean >= 0.05, mean <= -0.05], 1).astype(np.float32)[None]


@query()
def pages_read(spark: SparkSession, d: str) -> DataFrame:
    pages = moving_planes(spark, d).where("ts_ms = 0").select(F.col("stream_no").alias("page_id"), "width", "height", "luma")
    return models.read_pages(pages, "page_id", bright, striped, ["a", "b"])
