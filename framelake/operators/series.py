"""Samplers, runs, as-of joins, caps and sets over ordered rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scan import each_group


def sampled_times(times: DataFrame, interval_ms: int, terminal: bool = True) -> DataFrame:
    """(stream_no, t_ms, terminal): the first time, then each next one at least interval_ms after the last taken.

    terminal: the last time is taken too, if it isn't already. Each time taken leads to the next one by a binary search.
    """

    def taken(c: dict) -> dict:
        times, at, out = np.unique(np.asarray(c["t_ms"], np.int64)), 0, []
        while at < len(times):
            out.append(int(times[at]))
            at = int(np.searchsorted(times, out[-1] + interval_ms)) if interval_ms > 0 else at + 1
        rest = [int(times[-1])] if terminal and times[-1] != out[-1] else []
        return {"t_ms": out + rest, "terminal": [False] * len(out) + [True] * len(rest)}

    known = times.where(F.col("t_ms").isNotNull()).select("stream_no", F.col("t_ms").cast("long").alias("t_ms"))
    return each_group(known, ["stream_no"], ["t_ms"], ["t_ms"], taken, f"stream_no {dict(times.dtypes)['stream_no']}, t_ms bigint, terminal boolean")


def gated_times(times: DataFrame, interval_ms: int) -> DataFrame:
    """(stream_no, from_ms, to_ms): intervals between times of the gate; the first boundary gives none."""
    gate = sampled_times(times, interval_ms, terminal=False)
    own = W.partitionBy("stream_no").orderBy("t_ms")
    return gate.select("stream_no", F.lag("t_ms").over(own).alias("from_ms"), F.col("t_ms").alias("to_ms")).where("from_ms IS NOT NULL")


def id_ranges(rows: DataFrame, group: list[str], id: str) -> DataFrame:
    """One text a group: runs of three or more consecutive ids as a-b, others one by one, by commas."""
    own = W.partitionBy(*group).orderBy(id)
    runs = rows.select(*group, id).distinct().withColumn("run", F.col(id) - F.row_number().over(own))
    ends = runs.groupBy(*group, "run").agg(F.min(id).alias("a"), F.max(id).alias("b"))
    text = F.when(F.col("b") - F.col("a") >= 2, F.concat_ws("-", "a", "b")).otherwise(F.array_join(F.sequence("a", "b").cast("array<string>"), ","))
    return ends.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ",").alias("ids"))


def broken_runs(rows: DataFrame, group: list[str], order: list, same: list[str], chunk: int = 3000) -> DataFrame:
    """Adds run_no: a new run starts where one of `same` changes, or after chunk rows."""
    own = W.partitionBy(*group).orderBy(*order)
    now = F.struct(*same)
    rows = rows.withColumn("__new", F.when(F.lag(now).over(own).eqNullSafe(now), 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__new").over(own))
    inside = F.row_number().over(W.partitionBy(*group, "__run").orderBy(*order)) - 1
    rows = rows.withColumn("__part", F.floor(inside / chunk))
    return rows.withColumn("run_no", (F.dense_rank().over(W.partitionBy(*group).orderBy("__run", "__part")) - 1).cast("long")).drop("__new", "__run", "__part")


def shown_ids(rows: DataFrame, run: list[str], order: list, id: str, out: str = "shown") -> DataFrame:
    """Adds out: the id as text, empty where it is the one before in its run plus one."""
    before = F.lag(id).over(W.partitionBy(*run).orderBy(*order))
    return rows.withColumn(out, F.when(before + 1 == F.col(id), "").otherwise(F.col(id).cast("string")))


def ranked(rows: DataFrame, group: list[str], order: list, out: str = "rank") -> DataFrame:
    """Adds out: 1, 2, ... in a group by a total order."""
    return rows.withColumn(out, F.row_number().over(W.partitionBy(*group).orderBy(*order)))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, time: str, out: str, forward: bool = False) -> DataFrame:
    """Adds out: right's latest time at or before left's (forward: its earliest after), by one window over both."""
    both = left.withColumn("__side", F.lit(1)).withColumn("__t", F.col(at)).withColumn("__r", F.lit(None).cast("long")).unionByName(
        right.select(key, F.col(time).alias("__t"), F.col(time).cast("long").alias("__r"), F.lit(0).alias("__side")).distinct(), allowMissingColumns=True)
    if forward:
        seen = F.min("__r").over(W.partitionBy(key).orderBy("__t", "__side").rowsBetween(1, W.unboundedFollowing))
    else:
        seen = F.last("__r", ignorenulls=True).over(W.partitionBy(key).orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn(out, seen).where("__side = 1").drop("__side", "__t", "__r")


def keep_smallest(rows: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    """Eviction: what is left of each group once the largest are removed until `most` remain."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def fused(prefix: DataFrame, suffix: DataFrame, key: list[str], order: str) -> DataFrame:
    """prefix as it is, then each row of suffix that equals none before it; appended says so, decision why not."""
    rows = prefix.withColumn("part", F.lit(0)).unionByName(suffix.withColumn("part", F.lit(1)))
    seen = F.row_number().over(W.partitionBy(*key).orderBy("part", order)) > 1
    return rows.withColumn("decision", F.when(F.col("part") == 0, "prefix").when(seen, "duplicate").otherwise("appended"))


def collapsed(steps: DataFrame, group: list[str], order: str, label: str, blank: int = 0) -> DataFrame:
    """CTC: drops repeats of the step before, then blanks."""
    before = F.lag(label).over(W.partitionBy(*group).orderBy(order))
    return steps.withColumn("__b", before).where((F.col(label) != blank) & ~F.col(label).eqNullSafe(F.col("__b"))).drop("__b")


def within(t: Column, start: Column, length: Column | int) -> Column:
    return (t >= start) & (t < start + length)


def histogram64(values: DataFrame, bin: Column) -> DataFrame:
    """(bin, n) for all 64 bins."""
    spark = values.sparkSession
    return spark.range(64).select(F.col("id").cast("int").alias("bin")).join(values.groupBy(bin.alias("bin")).agg(F.count(F.lit(1)).alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def digests(rows: DataFrame, group: list[str], order: list[str], size: str, sha: str, name: str = "digest") -> DataFrame:
    """(group, name, items): SHA-256 of each group's canonical JSON list of (bytes, sha256), in order. A group is hashed as its rows pass by; nothing is collected."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{g} {kinds[g]}" for g in group), f"{name} string", "items bigint"])

    def run(batches):
        import hashlib

        now, state, n = None, None, 0

        def done():
            state.update(b"]")
            return pa.RecordBatch.from_arrays([*(pa.array([v], f.type) for v, f in zip(now, fields)), pa.array([state.hexdigest()]), pa.array([n], pa.int64())], [*group, name, "items"])

        for batch in batches:
            fields = [batch.schema.field(g) for g in group]
            keys = list(zip(*(batch.column(g).to_pylist() for g in group))) if group else [()] * len(batch)
            for key, item in zip(keys, batch.column("__item").to_pylist()):
                if state is None or key != now:
                    if state is not None:
                        yield done()
                    now, state, n = key, hashlib.sha256(b"["), 0
                state.update((b"," if n else b"") + item.encode())
                n += 1
        if state is not None:
            yield done()

    item = F.to_json(F.struct(F.col(size).alias("bytes"), F.col(sha).alias("sha256")))
    dealt = rows.withColumn("__item", item).select(*dict.fromkeys([*group, *order]), "__item")
    dealt = dealt.repartition(*group) if group else dealt.coalesce(1)
    return dealt.sortWithinPartitions(*group, *order).select(*group, "__item").mapInArrow(run, schema)


def digest(rows: DataFrame, order: str, name: str, size: str, sha: str) -> DataFrame:
    """One row: digests() of all rows as one group; no rows give the digest of an empty list."""
    found = digests(rows, [], [order], size, sha, name)
    none = rows.sparkSession.range(1).select(F.sha2(F.lit("[]"), 256).alias(name), F.lit(0).cast("long").alias("items"))
    return found.union(none).groupBy().agg(F.max_by(name, "items").alias(name), F.max("items").alias("items"))


def high_water(rows: DataFrame, group: list[str], order: list, values: list[str]) -> DataFrame:
    """Adds most_<value>: the highest so far."""
    own = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.select("*", *(F.max(v).over(own).alias(f"most_{v}") for v in values))


def guarded(rows: DataFrame, group: list[str], most: int, what: str) -> DataFrame:
    """rows as they are; an error where a group has more than `most`."""
    n = F.count(F.lit(1)).over(W.partitionBy(*group))
    seen = rows.withColumn("__n", n)
    return seen.where(F.when(F.col("__n") > most, F.raise_error(F.lit(f"more than {most} {what}"))).otherwise(F.lit(True))).drop("__n")


def zipped(left: DataFrame, right: DataFrame, group: list[str], at: str) -> DataFrame:
    """Rows of a group put side by side by their position; a position that one side lacks or has twice is an error."""
    n = F.count(F.lit(1)).over(W.partitionBy(*group, at))
    twice = lambda rows, p: rows.withColumn(f"__{p}", n)
    both = twice(left, "l").join(twice(right, "r"), [*group, at], "full")
    wrong = F.when(F.col("__l").isNull() | F.col("__r").isNull(), "a position is missing").when((F.col("__l") > 1) | (F.col("__r") > 1), "a position is there twice")
    return both.where(F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.lit(True))).drop("__l", "__r")
