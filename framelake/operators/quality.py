"""Frames that break the rules of input, as rows instead of an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as G

# Fixed values.
MOST_ELEMENTS, MOST_BYTES = 3_000, 64 << 20


def frame_problems(obs: DataFrame, arrival: str, most: int = MOST_ELEMENTS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(stream_no, arrival, problem, obs_index) of the frames a tracker refuses, with the first rule broken.

    Frames come in the order of `arrival`; a row without obs_index stands for a frame without elements. The order of rules: the
    frame's size, its time (equal is allowed, and only accepted frames count as before), each element by number (confidence, then
    box), the number of elements, their bytes (text and role in UTF-8; an estimate of what a tracker holds).
    """
    frame = ["stream_no", arrival]
    there = F.col("obs_index").isNotNull()
    sure = F.coalesce(F.col("conf").between(0, 1) & ~F.isnan("conf"), F.lit(False))
    wrong = F.when(there & ~sure, "confidence").when(there & ~F.coalesce(G.fits(), F.lit(False)), "box")
    folded = obs.withColumn("__wrong", wrong).groupBy(*frame).agg(
        F.first("fw").alias("fw"), F.first("fh").alias("fh"), F.min("ts_ms").alias("ts_ms"), F.count("obs_index").alias("__n"),
        F.sum(F.coalesce(F.octet_length("txt"), F.lit(0)) + F.coalesce(F.octet_length("role"), F.lit(0))).alias("__bytes"),
        F.min_by(F.struct("__wrong", "obs_index"), F.when(F.col("__wrong").isNotNull(), F.col("obs_index"))).alias("__first"),
    )
    other = (
        F.when(F.col("__first").isNotNull(), F.col("__first.__wrong")).when(F.col("__n") > most, "too_many_elements").when(F.col("__bytes") > most_bytes, "too_many_bytes")
    )
    size = ~F.coalesce(G.valid_frame(), F.lit(False))
    own = folded.withColumn("__size", size).withColumn("__other", other)
    # a frame is accepted if it is sound by itself and not before the highest time accepted so far, and that is the highest sound one
    sound = F.when(~F.col("__size") & F.col("__other").isNull(), F.col("ts_ms"))
    before = F.max(sound).over(W.partitionBy("stream_no").orderBy(arrival).rowsBetween(W.unboundedPreceding, -1))
    problem = F.when(F.col("__size"), "frame_size").when(F.col("ts_ms") < before, "time_goes_back").otherwise(F.col("__other"))
    at = F.when(F.col("__problem").isin("confidence", "box"), F.col("__first.obs_index"))
    return own.withColumn("__problem", problem).where("__problem IS NOT NULL").select(*frame, F.col("__problem").alias("problem"), at.alias("obs_index"))
