"""Contours as rows (contour, point number, x, y), and the counts of the detector's gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import detector as D


def turning_points(points: DataFrame, contour: list[str], order: str) -> DataFrame:
    """Points of closed contours at which the direction changes; a contour of one point keeps it.

    Before the first point comes the last one, after the last the first.
    """
    by = W.partitionBy(*contour).orderBy(order)
    every = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    place = F.struct("x", "y")
    around = points.withColumn("__n", F.count(F.lit(1)).over(every)).withColumn("__p", F.coalesce(F.lag(place).over(by), F.last(place).over(every)))
    around = around.withColumn("__q", F.coalesce(F.lead(place).over(by), F.first(place).over(every)))
    way = lambda a, b: F.struct(*(F.signum(b[c] - a[c]) for c in "xy"))
    here = {"x": F.col("x"), "y": F.col("y")}
    kept = around.where((F.col("__n") == 1) | (way(F.col("__p"), here) != way(here, F.col("__q"))))
    return kept.drop("__n", "__p", "__q")


def gate_counts(contours: DataFrame, group: list[str]) -> DataFrame:
    """Per group how many contours there were and how many passed each gate of the chain; columns first_side, score, second_side hold the measures."""
    left_at = D.gate(F.col("first_side"), F.col("score"), F.col("second_side"))
    passed = [F.count_if(F.col("__at").isin(*D.STAGES[k + 1 :])).alias(f"passed_{s}") for k, s in enumerate(D.STAGES[:-1])]
    return contours.withColumn("__at", left_at).groupBy(*group).agg(F.count(F.lit(1)).alias("contours"), *passed)
