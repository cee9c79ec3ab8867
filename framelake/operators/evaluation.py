"""Evaluation roll-ups: majority of trials, slices, paired outcomes, clustered bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def majority(trials: DataFrame, task: list[str], correct: str = "correct", of: int | None = None) -> DataFrame:
    """Per task: correct in more than half of its trials, or of `of` where that many were meant (missing ones count as wrong)."""
    all_ = F.count(F.lit(1)) if of is None else F.lit(of)
    return trials.groupBy(*task).agg((F.count_if(correct) * 2 > all_).alias("correct"), F.count_if(correct).alias("hits"), F.count(F.lit(1)).alias("trials"))


def slices(tasks: DataFrame, dimensions: list[str]) -> DataFrame:
    """Accuracy overall and by each dimension alone."""
    return tasks.groupingSets([[d] for d in dimensions] + [[]], *dimensions).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def macro(tasks: DataFrame, by: str) -> DataFrame:
    return tasks.groupBy(by).agg(F.avg(F.col("correct").cast("double")).alias("a")).agg(F.avg("a").alias("macro"))


def paired(a: DataFrame, b: DataFrame, task: list[str]) -> DataFrame:
    """One row: wins, losses, ties of a against b, and the difference in accuracy."""
    both = a.select(*task, F.col("correct").alias("a")).join(b.select(*task, F.col("correct").alias("b")), task)
    return both.agg(F.count_if(F.col("a") & ~F.col("b")).alias("wins"), F.count_if(~F.col("a") & F.col("b")).alias("losses"), F.count_if(F.col("a") == F.col("b")).alias("ties"),
                    F.avg(F.col("a").cast("double") - F.col("b").cast("double")).alias("delta"))


def bootstrap(clusters: DataFrame, stratum: str, cluster: str, value: str, replicates: int = 10_000, seed: int = 7) -> DataFrame:
    """95 % interval of the mean of value: in each of `replicates` as many clusters are drawn with replacement within each stratum as it has.

    The k-th draw of a replicate is the first 32 bits of an MD5 of (seed, replicate, stratum, k), modulo the stratum's clusters, so draws need no state and
    the same ones come at any partitioning. Replicates are dealt to tasks; sums go to them by the number drawn.
    """
    own = W.partitionBy(stratum).orderBy(cluster)
    sums = clusters.groupBy(stratum, cluster).agg(F.sum(value).alias("__s"), F.count(F.lit(1)).alias("__n")).withColumn("__k", F.row_number().over(own) - 1)
    sizes = sums.groupBy(stratum).agg(F.count(F.lit(1)).alias("__of"))
    draws = sizes.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).repartition("__r").withColumn("__j", F.explode(F.sequence(F.lit(0), (F.col("__of") - 1).cast("int"))))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "__r", F.col(stratum).cast("string"), "__j").cast("binary")), 1, 8), 16, 10).cast("long") % F.col("__of")
    drawn = draws.withColumn("__k", number).join(sums.select(stratum, "__k", "__s", "__n"), [stratum, "__k"])
    means = drawn.groupBy("__r").agg((F.sum("__s") / F.sum("__n")).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
