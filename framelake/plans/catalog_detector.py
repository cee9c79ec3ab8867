"""Queries for the detector's shapes, gates and verdicts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detector as D
from ..functions import recognition
from ..functions import texts as T
from ..operators import contours
from ..sources.tables import observations, table
from .catalog import query

SIZES = """sizes AS (SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS line, CAST(l_partkey % 3000 + 1 AS BIGINT) AS h, CAST(l_suppkey * 37 % 4000 + 1 AS BIGINT) AS w FROM lineitem)"""
NOMINAL = """nominal AS (SELECT *, CASE WHEN h <= w THEN 736 ELSE ((h * 736 + w // 2) // w + 16) // 32 * 32 END AS nh, CASE WHEN h <= w THEN ((w * 736 + h // 2) // h + 16) // 32 * 32 ELSE 736 END AS nw FROM sizes)"""


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c, by, mod: (F.col(c) * by % mod + 1).cast("long")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("line"), at("l_partkey", 1, 3000).alias("h"), at("l_suppkey", 37, 4000).alias("w"))


@query(f"""WITH {SIZES}, {NOMINAL}, pre AS (SELECT *, floor(h * (736.0::DOUBLE / least(h, w))) AS ph, floor(w * (736.0::DOUBLE / least(h, w))) AS pw FROM nominal),
capped AS (SELECT *, CASE WHEN greatest(ph, pw) > 4000 THEN floor(ph * (4000.0::DOUBLE / greatest(ph, pw))) ELSE ph END AS qh, CASE WHEN greatest(ph, pw) > 4000 THEN floor(pw * (4000.0::DOUBLE / greatest(ph, pw))) ELSE pw END AS qw FROM pre),
fitted AS (SELECT *, greatest(32, CAST(round_even(qh / 32, 0) AS BIGINT) * 32) AS ih, greatest(32, CAST(round_even(qw / 32, 0) AS BIGINT) * 32) AS iw FROM capped)
SELECT page, line, h, w, nh, nw, CASE WHEN ih * iw <= 16777216 THEN ih END AS ih, CASE WHEN ih * iw <= 16777216 THEN iw END AS iw,
  CASE WHEN nh * w >= nw * h THEN ((h // 3 + 1) * nh + h * 32 - 1) // (h * 32) * 32 ELSE ((h // 3 + 1) * nw + w * 32 - 1) // (w * 32) * 32 END AS rh FROM fitted""")
def detector_shapes(spark: SparkSession, d: str) -> DataFrame:
    h, w = F.col("h"), F.col("w")
    (nh, nw), (ih, iw) = D.nominal_shape(h, w), D.input_shape(h, w)
    rh = D.regional_extent(F.expr("h div 3 + 1"), h, w)
    return _sizes(spark, d).select("page", "line", "h", "w", nh.alias("nh"), nw.alias("nw"), ih.alias("ih"), iw.alias("iw"), rh.alias("rh"))


@query(f"""WITH {SIZES}, lines AS (SELECT page, (w * 48 + h % 90 + 9) // (h % 90 + 10) AS width FROM sizes), b AS (SELECT page, count(*) AS lines, max(width) AS content FROM lines GROUP BY 1)
SELECT page, lines, content, CASE WHEN greatest(content, 320) <= 3200 THEN greatest(content, 320) END AS padded, CASE WHEN (content + 7) // 8 * 8 <= 3200 THEN (content + 7) // 8 * 8 END AS tight FROM b""")
def recogniser_widths(spark: SparkSession, d: str) -> DataFrame:
    widths = _sizes(spark, d).select("page", D.line_width(F.col("w"), F.col("h") % 90 + 10).alias("width"))
    by_page = widths.groupBy("page").agg(F.count(F.lit(1)).alias("lines"), F.max("width").alias("content"))
    return by_page.select("*", D.batch_width(F.col("content")).alias("padded"), D.batch_width(F.col("content"), tight=True).alias("tight"))


@query("""WITH q AS (SELECT vec_id, [{'x': floor(CAST(embedding[1] AS DOUBLE) * 4) + 9, 'y': floor(CAST(embedding[2] AS DOUBLE) * 64) + 99}, {'x': floor(CAST(embedding[3] AS DOUBLE) * 4) + 9, 'y': floor(CAST(embedding[4] AS DOUBLE) * 64) + 99},
  {'x': floor(CAST(embedding[5] AS DOUBLE) * 4) + 9, 'y': floor(CAST(embedding[6] AS DOUBLE) * 64) + 99}, {'x': floor(CAST(embedding[7] AS DOUBLE) * 4) + 9, 'y': floor(CAST(embedding[8] AS DOUBLE) * 64) + 99}] AS p FROM embeddings),
e AS (SELECT vec_id, i, p[i].x AS x, p[i].y AS y, p[i % 4 + 1].x AS nx, p[i % 4 + 1].y AS ny FROM q, range(1, 5) r(i)),
m AS (SELECT vec_id, abs(sum(x * ny - y * nx)) / 2 AS area, round(sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))), 6) AS perimeter, bool_and(x BETWEEN 0 AND 12 AND y BETWEEN 0 AND 120) AS fits FROM e GROUP BY 1),
s AS (SELECT vec_id, list({'x': x, 'y': y} ORDER BY x, i) AS s FROM e GROUP BY 1),
o AS (SELECT vec_id, CASE WHEN s[2].y > s[1].y THEN s[1] ELSE s[2] END AS tl, CASE WHEN s[2].y > s[1].y THEN s[2] ELSE s[1] END AS bl, CASE WHEN s[4].y > s[3].y THEN s[3] ELSE s[4] END AS tr, CASE WHEN s[4].y > s[3].y THEN s[4] ELSE s[3] END AS br FROM s)
SELECT vec_id, area, perimeter, fits, tl.x AS tl_x, tl.y AS tl_y, tr.x AS tr_x, tr.y AS tr_y, br.x AS br_x, br.y AS br_y, bl.x AS bl_x, bl.y AS bl_y FROM o JOIN m USING (vec_id)""")
def quad_measures(spark: SparkSession, d: str) -> DataFrame:
    v = lambda i, by, plus: F.floor(F.col("embedding")[i].cast("double") * by).cast("double") + plus
    points = F.array(*(F.struct(v(2 * k, 4, 9).alias("x"), v(2 * k + 1, 64, 99).alias("y")) for k in range(4)))
    quads = table(spark, d, "embeddings").select("vec_id", points.alias("p"))
    m = quads.select("vec_id", D.area_perimeter(F.col("p")).alias("m"), D.quad_fits(F.col("p"), F.lit(12), F.lit(120)).alias("fits"), D.ordered_quad(F.col("p")).alias("o"))
    corners = [F.col("o")[k][c].alias(f"{n}_{c}") for k, n in enumerate(("tl", "tr", "br", "bl")) for c in "xy"]
    return m.select("vec_id", "m.area", F.round("m.perimeter", 6).alias("perimeter"), "fits", *corners)


@query("""WITH p AS (SELECT vec_id, i, CAST(floor(CAST(embedding[2 * i + 1] AS DOUBLE) * 4) AS BIGINT) AS x, CAST(floor(CAST(embedding[2 * i + 2] AS DOUBLE) * 4) AS BIGINT) AS y FROM embeddings, range(32) r(i)),
j AS (SELECT c.*, c.x - b.x AS ix, c.y - b.y AS iy, n.x - c.x AS ox, n.y - c.y AS oy FROM p c JOIN p b ON b.vec_id = c.vec_id AND b.i = (c.i + 31) % 32 JOIN p n ON n.vec_id = c.vec_id AND n.i = (c.i + 1) % 32)
SELECT vec_id, CAST(i AS INTEGER) AS i, x, y FROM j WHERE sign(ix) <> sign(ox) OR sign(iy) <> sign(oy)""")
def contour_turns(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"), "embedding")
    v = lambda k: F.floor(F.col("embedding")[F.col("i") * 2 + k].cast("double") * 4).cast("long")
    return contours.turning_points(e.select("vec_id", "i", v(0).alias("x"), v(1).alias("y")), ["vec_id"], "i")


@query("""WITH c AS (SELECT label, abs(CAST(embedding[1] AS DOUBLE)) * 40 AS a, abs(CAST(embedding[2] AS DOUBLE)) * 8 AS s, abs(CAST(embedding[3] AS DOUBLE)) * 60 AS b FROM embeddings)
SELECT label, count(*) AS contours, count(*) FILTER (a >= 3) AS passed_first_side, count(*) FILTER (a >= 3 AND s >= 0.4) AS passed_score, count(*) FILTER (a >= 3 AND s >= 0.4 AND b >= 5) AS passed_second_side FROM c GROUP BY 1""")
def gate_counts(spark: SparkSession, d: str) -> DataFrame:
    v = lambda i, by: F.abs(F.col("embedding")[i].cast("double")) * by
    c = table(spark, d, "embeddings").select("label", v(0, 40).alias("first_side"), v(1, 8).alias("score"), v(2, 60).alias("second_side"))
    return contours.gate_counts(c, ["label"])


@query("""WITH t AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey % 40 AS e, l_suppkey % 30 AS a, l_orderkey % 10 * 100000 AS s, l_partkey % 31 AS z, CASE WHEN l_suppkey % 4 > 0 THEN l_partkey % 17 END AS m, l_suppkey % 5 - 2 AS dx, l_partkey % 3 - 1 AS dy, l_orderkey % 7 * 50000 AS r FROM lineitem),
u AS (SELECT *, CASE WHEN a = 0 THEN 0 ELSE z * 1000000 // a END AS share FROM t)
SELECT l_orderkey, line, CASE WHEN e < 16 OR a < 12 THEN 'insufficient_support' WHEN s >= 350000 AND z >= 12 AND share >= 600000 AND coalesce(m, 0) < 12 THEN 'stationary'
  WHEN m IS NOT NULL AND s >= 350000 AND z >= 8 AND m >= 12 AND (abs(dx) >= 2 OR abs(dy) >= 2) AND r <= 250000 THEN 'coherent_translation' ELSE 'ambiguous_motion' END AS verdict FROM u""")
def motion_verdicts(spark: SparkSession, d: str) -> DataFrame:
    o, p, s = (F.col(c).cast("long") for c in ("l_orderkey", "l_partkey", "l_suppkey"))
    moved = F.when(s % 4 > 0, p % 17)
    verdict = D.motion_verdict(p % 40, s % 30, o % 10 * 100_000, p % 31, moved, s % 5 - 2, p % 3 - 1, o % 7 * 50_000)
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), verdict.alias("verdict"))


@query("""WITH t AS (SELECT event_id, event_id % 200000 AS ms FROM events), s AS (SELECT *, CAST(floor(ms / 1000 + 0.5) AS BIGINT) AS s FROM t)
SELECT event_id, s // 60 || ':' || CASE WHEN s % 60 < 10 THEN '0' ELSE '' END || s % 60 AS clock, CASE WHEN greatest(1, s) < 60 THEN greatest(1, s) || ' seconds' ELSE s // 60 || ':' || CASE WHEN s % 60 < 10 THEN '0' ELSE '' END || s % 60 END AS label,
CASE WHEN event_id % 3 = 1 THEN '1 event' ELSE event_id % 3 || ' events' END AS n FROM s""")
def display_labels(spark: SparkSession, d: str) -> DataFrame:
    ms = F.col("event_id") % 200_000
    return table(spark, d, "events").select("event_id", D.clock(ms).alias("clock"), D.duration_label(ms).alias("label"), D.plural(F.col("event_id") % 3, "event").alias("n"))


@query("""WITH steps AS (SELECT vec_id, r.i AS step, (SELECT arg_min(j, {'v': -embedding[8 * r.i + j + 1], 'j': j}) FROM range(8) q(j)) AS label FROM embeddings, range(8) r(i)),
l AS (SELECT *, lag(label) OVER (PARTITION BY vec_id ORDER BY step) AS before FROM steps)
SELECT vec_id, coalesce(string_agg(substr('abcdef ', CAST(label AS BIGINT), 1), '' ORDER BY step) FILTER (label <> 0 AND label IS DISTINCT FROM before), '') AS text FROM l GROUP BY 1""")
def ctc_text(spark: SparkSession, d: str) -> DataFrame:
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    return table(spark, d, "embeddings").select("vec_id", recognition.ctc_text(steps, recognition.dictionary(list("abcdef"))).alias("text"))


@query("""WITH l AS (SELECT stream_no, w * h AS area, conf < 0.25 AS missing, y >= 300 AS outside, obs_index % 5 = 0 AS silent FROM observations),
d AS (SELECT stream_no, CASE WHEN missing THEN 'missing' WHEN outside THEN 'geometry_clamp' WHEN silent THEN 'text_filter' ELSE 'emitted' END AS disposition, area FROM l)
SELECT stream_no, disposition, count(*) AS lines, CAST(sum(CASE WHEN disposition = 'emitted' THEN area ELSE 0 END) AS BIGINT) AS emitted_area FROM d GROUP BY 1, 2""")
def line_outcomes(spark: SparkSession, d: str) -> DataFrame:
    txt = F.when(F.col("conf") < 0.25, None).when(F.col("obs_index") % 5 == 0, " -- ").otherwise(F.col("txt"))
    lines = observations(spark, d).select("stream_no", (F.col("w") * F.col("h")).alias("area"), T.line_disposition(txt, F.col("y") < 300).alias("disposition"))
    emitted = F.when(F.col("disposition") == "emitted", F.col("area")).otherwise(0)
    return lines.groupBy("stream_no", "disposition").agg(F.count(F.lit(1)).alias("lines"), F.sum(emitted).alias("emitted_area"))
