"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. A source with p of q parts of the weight is to have its k-th block
(k = 0, 1, ...) released in slot floor(k q / p) and done by slot ceil((k + 1) q / p); one block a slot, and among
the released blocks the one with the earliest deadline goes first. Unit jobs with whole release times and deadlines
on one machine: this always meets them, so after any number t of slots a source has had less than one
block more or less than t p / q. The parts are whole numbers that stand to one another exactly as the weights do, and every
source is scheduled by itself. The schedule goes slot by slot in one task, which gets a row a source and writes one a
block, holding the sources only. When a source has run out, the others go on by their own weights from the next slot on, in a
schedule of its own. Nothing is dropped or repeated: every prefix of the order is mixed to the weights as long as all sources last.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .runtime import numbered

#: Rows of a block; rows of a batch of the schedule.
BLOCK_ROWS, PLAN_ROWS = 100, 50_000


def endless(parts: list[int]) -> Iterator[int]:
    """The index of each slot's source, earliest deadline first, as if blocks never ran out; ties go to the lesser index."""
    q, waiting, t = sum(parts), [], 0
    ready = [(-(-q // p), i, 0) for i, p in enumerate(parts) if p]
    heapq.heapify(ready)
    while True:
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * q // parts[i]), i, k))
        deadline, i, k = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline was missed")
        yield i
        heapq.heappush(waiting, ((k + 1) * q // parts[i], i, k + 1))
        t += 1


def period(parts: dict) -> list:
    """The source of each slot of one period (sum of parts) of the earliest-deadline-first schedule."""
    order = sorted(parts, key=str)
    return [order[i] for i in islice(endless([parts[s] for s in order]), sum(parts.values()))]


def schedule(blocks: list[int], parts: list[int]) -> Iterator[int]:
    """The index of each slot's source until all blocks are done, begun anew when a source has run out.

    Sources without parts come when all others have run out, evenly.
    """
    left = [n for n in blocks]
    alive = [i for i, n in enumerate(left) if n]
    while alive:
        mine = [i for i in alive if parts[i]] or alive
        for at in endless([parts[i] or 1 for i in mine]):
            i = mine[at]
            yield i
            left[i] -= 1
            if not left[i]:
                alive.remove(i)
                break


def to_parts(weights: dict) -> dict:
    """Whole parts in exactly the ratio of the weights (numbers, doubles by their shortest decimal form), not negative."""
    exact = {s: Fraction(repr(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    common = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * common) for s, w in exact.items()}
    shared = math.gcd(*whole.values()) or 1
    return {s: w // shared for s, w in whole.items()}


def _plan(groups: DataFrame, weights: dict | None, alpha: float, block_rows: int) -> DataFrame:
    """(__from, block, slot) for every block of groups (__from: struct of pooled and source, n: rows), made in one task."""
    schema = T.StructType([groups.schema["__from"], T.StructField("block", T.LongType()), T.StructField("slot", T.LongType())])

    def run(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        names, counts = table.column(0).combine_chunks(), table.column(1).to_pylist()
        if weights is None:
            given = [n**alpha for n in counts]
        else:
            given = [min(weights.values()) if g["pooled"] else weights.get(g["source"], min(weights.values())) for g in names.to_pylist()]
        parts = to_parts(dict(enumerate(given)))
        slots, first, had = schedule([-(-n // block_rows) for n in counts], list(parts.values())), 0, [0] * len(counts)
        while piece := list(islice(slots, PLAN_ROWS)):
            block = np.empty(len(piece), np.int64)
            for at, i in enumerate(piece):
                block[at] = had[i]
                had[i] += 1
            yield pa.RecordBatch.from_arrays([names.take(pa.array(piece)), pa.array(block), pa.array(np.arange(first, first + len(piece)))], ["__from", "block", "slot"])
            first += len(piece)

    lined = groups.repartition(1).sortWithinPartitions(F.col("__from.pooled"), F.desc("n"), F.asc_nulls_first("__from.source"))
    return lined.select("__from", "n").mapInArrow(run, schema)


def mixed(df: DataFrame, source: str = "source", order: list[str] | None = None, weights: dict | None = None, alpha: float = 0.5, block_rows: int = BLOCK_ROWS, most_sources: int | None = None) -> DataFrame:
    """Adds block (of its source), slot (of the whole schedule) and mix_pos (place in the slot) to every row.

    weights: target weight by source; a source without one has the smallest given. None: rows to the power of alpha.
    Every source is scheduled by itself; only where most_sources is given are all but the most_sources - 1 with most rows
    scheduled together as one. order: the columns that tell rows apart; rows are numbered in the order of a hash of these
    (repeated rows next to one another). A null source is a source. An empty table gives an empty result. Columns block, slot
    and mix_pos are replaced.
    """
    order = order or [source]
    df = df.drop("block", "slot", "mix_pos")
    pooled, keyed = F.lit(False), df
    if most_sources is not None:
        top = df.groupBy(source).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first(source)).limit(most_sources - 1)
        keyed = df.join(F.broadcast(top.select(F.col(source).alias("__s"), F.lit(False).alias("__top"))), F.col(source).eqNullSafe(F.col("__s")), "left").drop("__s")
        pooled = F.coalesce("__top", F.lit(True))
    keyed = keyed.withColumn("__from", F.struct(pooled.alias("pooled"), F.when(~pooled, F.col(source)).alias("source")))
    groups = keyed.groupBy("__from").agg(F.count(F.lit(1)).alias("n"))
    plan = _plan(groups, weights, alpha, block_rows).select(F.col("__from").alias("__h"), F.col("block").alias("__b"), "slot")
    placed = numbered(keyed, "__from", [F.xxhash64(*order), *(F.col(c) for c in order)], "__n", bucket_rows=20_000)
    placed = placed.withColumn("block", F.expr(f"__n div {block_rows}")).withColumn("mix_pos", (F.col("__n") % block_rows).cast("int"))
    return placed.join(plan, F.col("__from").eqNullSafe(F.col("__h")) & (F.col("block") == F.col("__b"))).select(*df.columns, "block", "slot", "mix_pos")


def ordered(df: DataFrame, source: str = "source", order: list[str] | None = None, **how) -> DataFrame:
    """The rows of df, its columns alone, in mixed order: files hold ranges of slots, ordered within.

    Places are found from the source and order columns alone, so long columns move twice: to their places, and into
    order. Rows that agree in all of these go to the first of their places.
    """
    keys = list(dict.fromkeys([source, *(order or ["doc_id"])]))
    places = mixed(df.select(*keys), source, order or ["doc_id"], **how).groupBy(*keys).agg(F.min(F.struct("slot", "mix_pos")).alias("__place"))
    places = places.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(keys)), "__place")
    same = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(keys)]
    return df.join(places, same, "left").repartitionByRange("__place").sortWithinPartitions("__place").select(*df.columns)


def with_places(df: DataFrame, rows: DataFrame, source: str = "source", order: list[str] | None = None, **how) -> DataFrame:
    """df, a row for each of rows, with the slot and mix_pos that ordered() put rows by. Both have the source and order columns.

    Rows that agree in all of these share their places out, one each.
    """
    keys = list(dict.fromkeys([source, *(order or ["doc_id"])]))
    copy = lambda by: F.row_number().over(W.partitionBy(*keys).orderBy(*by))
    places = mixed(rows.select(*keys), source, order or ["doc_id"], **how).withColumn("__copy", copy(["slot", "mix_pos"]))
    places = places.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(keys)), F.col("__copy").alias("__nth"), "slot", "mix_pos")
    same = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(keys)]
    copies = df.withColumn("__copy", copy(keys))
    return copies.join(places, [*same, F.col("__copy") == F.col("__nth")]).select(*df.columns, "slot", "mix_pos")
