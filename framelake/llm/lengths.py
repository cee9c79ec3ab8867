"""Exact length histogram: answers for every context limit from one aggregation.

Texts are encoded once; documents are counted by encoded length. Suffix sums over the histogram give, for every limit, how
many documents reach it, all their tokens, and what is left of all documents when cut at the limit. The
histogram has one row for each length that occurs. It is summed in two steps (ranges of lengths, then within a
range), so no task holds all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RANGE = 1024


def histogram(counted: DataFrame, length: str = "n_tokens") -> DataFrame:
    """(n_tokens, docs). Null lengths are passed over; an empty table has no rows."""
    return counted.where(F.col(length).isNotNull()).groupBy(F.col(length).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("docs"))


def answers(hist: DataFrame) -> DataFrame:
    """For each length as a context limit: docs of it, docs_at_least, tokens_at_least (theirs, uncut), truncated_tokens
    (of all documents, each cut at the limit), and share_at_most, the share of documents not over it. hist has n_tokens and docs, each length once (ties are
    counted by histogram()); its other columns are left out. An empty histogram has no answers."""
    cut = hist.withColumn("range", F.expr(f"n_tokens div {RANGE}")).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    ranges = cut.groupBy("range").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    above = W.partitionBy(F.lit(0)).orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    everything = ranges.agg(F.sum("docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))  # one row
    starts = ranges.select("range", F.coalesce(F.sum("docs").over(above), zero).alias("docs_above"), F.coalesce(F.sum("tokens").over(above), zero).alias("tokens_above"))
    within = W.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    summed = cut.withColumn("d", F.sum("docs").over(within)).withColumn("t", F.sum("tokens").over(within))
    reach = summed.join(starts, "range").crossJoin(F.broadcast(everything)).withColumn("docs_at_least", F.col("d") + F.col("docs_above")).withColumn("tokens_at_least", F.col("t") + F.col("tokens_above"))
    return reach.select(
        "n_tokens", "docs", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("docs")) / F.col("all_docs")).alias("share_at_most"),
    )


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_tokens, docs_over) for any limits, from answers(): sums over the lengths, each cut at the limit."""
    wanted = F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))).alias("context_limit")
    return table.select("n_tokens", "docs", wanted).groupBy("context_limit").agg(
        F.sum(F.least("n_tokens", "context_limit") * F.col("docs")).alias("truncated_tokens"),
        F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("docs")).otherwise(0)).alias("docs_over"),
    )


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least that share of documents does not exceed."""
    wanted = F.explode(F.array(*(F.lit(float(x)) for x in shares))).alias("share")
    return table.select("n_tokens", "share_at_most", wanted).where(F.col("share_at_most") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
