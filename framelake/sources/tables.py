"""Table loaders, and adapters that read screen-state tables out of general ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BUCKET_MS = 172_800_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_no, t_ms): every event's time; milliseconds are floored."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_no"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed screen snapshots: one row for each element seen in a frame (a two-day bucket of a stream)."""
    t = F.expr(f"unix_millis(cast(ts as timestamp)) div {BUCKET_MS} * {BUCKET_MS}")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_no"), t.alias("ts_ms"), F.lit(640).cast("long").alias("fw"), F.lit(480).cast("long").alias("fh"), "event_id",
        (F.get_json_object("props", "$.k").cast("long") * 5).alias("x"), (F.floor("value") % 440).cast("long").alias("y"),
        F.lit(100).cast("long").alias("w"), F.lit(30).cast("long").alias("h"), F.col("event_type").alias("txt"),
        ((F.col("event_id") % 11) / 10).alias("conf"), F.lit("text").alias("role"),
    )
    frame = W.partitionBy("stream_no", "ts_ms")
    return rows.withColumn("obs_index", (F.row_number().over(frame.orderBy("event_id")) - 1).cast("long")).drop("event_id")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, x, y, luma): 8 x 8 luma planes."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.posexplode("embedding").alias("pos", "v"))
    luma = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v").cast("double") + 1) * 127.5)))
    return cells.select("frame_id", (F.col("pos") % 8).cast("long").alias("x"), F.expr("cast(pos div 8 as long)").alias("y"), luma.cast("long").alias("luma"))


#: The same adapters for an oracle.
ORACLE_VIEWS = f"""
frame_times AS (SELECT user_id AS stream_no, epoch_us(ts) // 1000 AS t_ms FROM events),
observations AS (
  SELECT user_id AS stream_no, epoch_us(ts) // 1000 // {BUCKET_MS} * {BUCKET_MS} AS ts_ms, CAST(640 AS BIGINT) AS fw, CAST(480 AS BIGINT) AS fh,
    row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 1000 // {BUCKET_MS} ORDER BY event_id) - 1 AS obs_index,
    CAST(json_extract_string(props, '$.k') AS BIGINT) * 5 AS x, CAST(floor(value) AS BIGINT) % 440 AS y, CAST(100 AS BIGINT) AS w, CAST(30 AS BIGINT) AS h,
    event_type AS txt, (event_id % 11) / 10 AS conf, 'text' AS role
  FROM events),
pixels AS (
  SELECT vec_id AS frame_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y, CAST(least(255, greatest(0, floor((CAST(embedding[i] AS DOUBLE) + 1) * 127.5))) AS BIGINT) AS luma
  FROM embeddings, range(1, 65) r(i))
"""
