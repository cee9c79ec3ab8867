"""Sharding by k-d tree, in DataFrame functions only.

Rows are split in two, again and again, at the weighted median of the metadata dimension that is widest among the
node's rows, until each leaf is one shard. A node that is to give k shards cuts its bytes at floor(k/2) : ceil(k/2).
All nodes of a depth are cut together: one grouped aggregation gives each node's ranges, and a few for each part
of the row key (dimension value, text hash, id hash) give histograms of bytes, of BINS bins a node. Only those
histograms reach the driver, MOST_BINS bins at most (fewer a node, and more passes, where nodes are many), and a row a node. Ties in the dimension are
broken by the text's hash, and then by the id's hash. Equal texts share the metadata of the least of them, so they are next to one another
in every order; a cut goes around them, unless they are more than WHOLE of a shard's bytes: then it goes through them, and
sizes stay near equal.
"""

from __future__ import annotations

import bisect
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import checkpoint, inline_table, numbered

#: Bins of a node's histogram at most, and of all nodes' together, which reach the driver; a cut is looked for until its bin is 2^-BITS of the range.
BINS, MOST_BINS, BITS, SHARDS = 1024, 1 << 20, 30, 40
#: A cut may be off by this share of a shard's bytes before it is looked for more finely.
TOLERANCE = 0.002
#: Rows of one text stay in one shard up to this share of a shard's bytes.
WHOLE = 0.1
_LOW, _SPAN = -(2.0**63), 2.0**64


def _dimensions(df: DataFrame, text: str, metadata: list[str]) -> list[Column]:
    """Each dimension as a double: numbers as they are, other values as a hash; nulls lowest."""
    out = []
    for name in metadata:
        kind = df.schema[name].dataType.typeName()
        number = kind in ("byte", "short", "integer", "long", "float", "double") or kind.startswith("decimal")
        value = F.col(name).cast("double") if number else F.xxhash64(F.col(name)).cast("double") / 2.0**40
        out.append(F.when(F.col(name).isNull() | F.isnan(value), F.lit(-(2.0**62))).otherwise(F.log1p(F.abs(value)) * F.signum(value) if number else value))
    return out


class _Node:
    def __init__(self, shards: int, first: int):
        self.shards, self.first = shards, first


def _with_shared_metadata(rows: DataFrame, dims: list[str]) -> DataFrame:
    """rows with each dimension set to its least value among the rows of the same text hash. Only texts whose rows differ are joined."""
    ranges = [f(d).alias(f"{n}{d}") for d in dims for n, f in (("__lo", F.min), ("__hi", F.max))]
    differ = rows.groupBy("ht").agg(F.count(F.lit(1)).alias("__n"), *ranges).where("__n > 1").where(" OR ".join(f"__lo{d} < __hi{d}" for d in dims))
    joined = rows.join(differ.select(F.col("ht").alias("__ht"), *(f"__lo{d}" for d in dims)), F.col("ht") == F.col("__ht"), "left")
    return joined.select(*(F.coalesce(f"__lo{c}", c).alias(c) if c in dims else c for c in rows.columns))


def kd_shards(df: DataFrame, id: str, text: str, metadata: list[str], shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """id, size (UTF-8 bytes of the text, null: none, plus 16), text_crc32, shard (int) of every row; a checkpoint.

    shards: their number; else as many as leave at most target_bytes, on average, in each (one, for an empty table). Shards differ
    in bytes by little more than the largest single rows and WHOLE of a shard, up to which rows of one text stay together. Null ids,
    texts and metadata are values; repeated rows are rows; rows that agree in text and id go to one shard. Other
    columns are left out, whatever their names. An empty table gives no rows. There may be empty shards where there are few rows.
    """
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
    key = [d.alias(f"d{i}") for i, d in enumerate(_dimensions(df, text, metadata))]
    dims = [f"d{i}" for i in range(len(metadata))]
    rows = df.select(
        F.col(id).alias("id"), size.alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).cast("double").alias("ht"), F.xxhash64(F.col(id), F.lit(7)).cast("double").alias("hi"), *key,
    )
    rows = checkpoint(_with_shared_metadata(rows, dims) if dims else rows)
    if shards is None:
        total = rows.agg(F.sum("size").alias("b")).first()["b"] or 0
        shards = max(1, math.ceil(total / target_bytes))
    nodes, placed = {0: _Node(shards, 0)}, rows.withColumn("node", F.lit(0))
    while any(n.shards > 1 for n in nodes.values()):
        cuts = _cuts(placed, nodes, dims)
        placed, nodes = _applied(placed, nodes, cuts, dims)
        placed = checkpoint(placed)
    shard = _table(placed, [(k, n.first) for k, n in nodes.items()], "node int, shard int")
    return placed.join(shard, "node").select(F.col("id").alias(id), "size", "text_crc32", "shard")


def _table(like: DataFrame, rows: list, schema: str) -> DataFrame:
    """A row for each node, of which there are no more than shards."""
    return F.broadcast(inline_table(like.sparkSession, rows, schema))


def _cuts(placed: DataFrame, nodes: dict, dims: list[str]) -> dict:
    """node -> [dimension, value, text hash, id hash]: rows whose key is below go left. Parts after a null one don't count."""
    split = _table(placed, [(k,) for k, n in nodes.items() if n.shards > 1], "node int")
    ranges = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
    stats = {r["node"]: r for r in placed.join(split, "node").groupBy("node").agg(F.sum("size").alias("bytes"), *ranges).collect()}
    if not stats:
        return {}
    wide = {k: max(dims, key=lambda d: r[f"hi_{d}"] - r[f"lo_{d}"]) for k, r in stats.items()}
    goal = {k: r["bytes"] * (nodes[k].shards // 2) / nodes[k].shards for k, r in stats.items()}
    near = {k: r["bytes"] / nodes[k].shards * TOLERANCE for k, r in stats.items()}
    keyed = placed.join(_table(placed, list(wide.items()), "node int, dim string"), "node")
    keyed = keyed.withColumn("v", F.coalesce(*(F.when(F.col("dim") == d, F.col(d)) for d in dims))).select("node", "size", "v", "ht", "hi")
    out = {k: [wide[k], None, None, None] for k in stats}
    left = {k: (r[f"lo_{wide[k]}"], r[f"hi_{wide[k]}"]) for k, r in stats.items()}
    for part, column in enumerate(("v", "ht", "hi"), 1):
        through, seen = {}, 0.0  # nodes whose cut runs through rows of one value of this part; bits of the range that have been told
        while left and seen < BITS:
            bins_a_node = max(16, min(BINS, MOST_BINS // len(left)))
            seen += math.log2(bins_a_node)
            inside = keyed.join(_table(placed, [(k, *x) for k, x in left.items()], "node int, low double, high double"), "node").where(F.col(column).between(F.col("low"), F.col("high")))
            cell = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins_a_node - 1), F.floor((F.col(column) - F.col("low")) / (F.col("high") - F.col("low")) * bins_a_node))).otherwise(F.lit(0)).cast("int")
            hist = inside.groupBy("node", cell.alias("bin")).agg(F.sum("size").alias("b"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
            narrowed, of = {}, {}
            for r in hist:
                of.setdefault(r["node"], []).append((r["bin"], r["b"], r["lo"], r["hi"]))
            for k in left:
                bins = sorted(of[k])
                ends = list(itertools.accumulate(x[1] for x in bins))
                i = min(bisect.bisect_left(ends, goal[k]), len(bins) - 1)
                goal[k] -= ends[i - 1] if i else 0
                _, here, low, high = bins[i]
                out[k][part] = low if goal[k] < here / 2 else math.nextafter(high, math.inf)
                if min(goal[k], here - goal[k]) > near[k]:
                    if low == high and column == "ht" and here <= stats[k]["bytes"] / nodes[k].shards * WHOLE:
                        pass  # one text's rows: the cut stays before or after all of them
                    elif low == high:
                        out[k][part] = low
                        through[k] = low
                    else:
                        narrowed[k] = (low, high)
            left = narrowed
        keyed = keyed.join(_table(placed, list(through.items()), "node int, only double"), "node").where(F.col(column) == F.col("only")).drop("only")
        left = dict.fromkeys(through, (_LOW, _LOW + _SPAN))
    return out


def _applied(placed: DataFrame, nodes: dict, cuts: dict, dims: list[str]) -> tuple[DataFrame, dict]:
    table = _table(placed, [(k, *cuts.get(k, (None,) * 4)) for k in nodes], "node int, dim string, cv double, ct double, ci double")
    value = F.coalesce(*(F.when(F.col("dim") == d, F.col(d)) for d in dims))
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    below = (value < F.col("cv")) | same(value, F.col("cv")) & ((F.col("ht") < F.col("ct")) | same(F.col("ht"), F.col("ct")) & (F.col("hi") < F.col("ci")))
    after, whole = {}, []
    for k, n in nodes.items():
        left = n.shards // 2
        if not left:
            whole.append(k)
            after[2 * k + 1] = n
        else:
            after[2 * k + 1], after[2 * k + 2] = _Node(left, n.first), _Node(n.shards - left, n.first + left)
    first = F.coalesce(below, F.lit(False)) | (F.col("node").isin(whole) if whole else F.lit(False))
    moved = placed.join(table, "node").withColumn("node", 2 * F.col("node") + F.when(first, F.lit(1)).otherwise(F.lit(2)))
    return moved.select(*placed.columns), after


def sharded(df: DataFrame, id: str = "doc_id", text: str = "text", metadata: list[str] | None = None, shards: int = SHARDS) -> DataFrame:
    """kd_shards() with law `bytes`, slot (0, 1, ... in each shard) and grown_shard (null: only the `key` law has it)."""
    placed = kd_shards(df, id, text, metadata or [c for c in ("source", "lang", "n_chars") if c in df.columns], shards)
    out = numbered(placed, "shard", [F.col(id), F.col("text_crc32"), F.col("size")], "slot")
    return out.select(id, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
