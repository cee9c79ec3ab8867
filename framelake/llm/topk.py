"""Exact top-k inner products by dual-tree search over cover trees.

The top of the tree over all candidates is a net of pivots, picked farthest first from a bounded sample; every row
belongs to its nearest pivot, whose covering radius is the true one over all rows. A query's kth best product with the
sample bounds its result from below, and it is sent only to pivots whose ball allows as much: what the tree prunes is not
shuffled. A pivot's rows are one block, or several by a hash of their ids where there are many, so no block grows with the data.
Each block and the queries sent to it are a task: both are indexed by a cover tree and the trees are walked together. A
node pair is pruned when the largest product that its covering radii allow, cq.cr + rho_q |cr| + rho_r |cq| + rho_q rho_r,
is under the worst kth score of the node's queries. Each task returns k rows a query at most; the k best of those
are the result. All products are of whole numbers and exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .runtime import bounded_batches, checkpoint

#: Queries and candidates of a block at most; rows of the sample and pivots at most, and rows a pivot is to have at least; partitions at most.
QUERY_BLOCK, DATA_BLOCK, SAMPLE, PIVOTS, PIVOT_ROWS, MOST_TASKS = 8192, 4096, 4096, 256, 2048, 20_000
LEAF, QUERY_LEAF = 64, 16
#: Candidates compared with a leaf's queries before its worst kth score is looked at again.
CHUNK = 1024


def farthest_first(points: np.ndarray, most: int, enough: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of at most `most` different points, each the farthest from those before it; that distance for each (infinite for the
    first); and the position of each point's nearest among them. It ends early once no point is nearest to more than `enough`."""
    chosen, reach, nearest = [0], [np.inf], np.zeros(len(points), np.int64)
    far = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    while len(chosen) < most and (new := int(far.argmax())) not in chosen[:1] and far[new] > 0:
        reach.append(float(far[new]))
        d = np.sqrt(((points - points[new]) ** 2).sum(axis=1))
        closer = d < far
        nearest[closer], far[closer] = len(chosen), d[closer]
        chosen.append(new)
        if enough and len(chosen) % 16 == 0 and np.bincount(nearest).max() <= enough:
            break
    return np.array(chosen), np.array(reach), nearest


class CoverTree:
    """A cover tree down to leaves of about `leaf` points.

    Its nets come from one farthest-first order of the points: the net of level i is what was picked at a distance over 2^i.
    So nets are nested, a net's points are over 2^i apart (separation), and every point is within 2^i of the net (covering). A node of
    level i is a point of its net; its children are itself and the points of the next net that it is the nearest to. Levels
    whose net is that of the level above are left out. Points are reordered: a node is the range start..end of
    `order`; radius is the true one over its points.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.centre, self.radius, self.start, self.end, self.children, self.level = [], [], [], [], [], []
        if not len(points):
            return
        chosen, reach, nearest = farthest_first(points, 1 if len(points) <= leaf else max(64, len(points) // 8), leaf)
        #: distinct levels, coarse to fine, and how many of `chosen` are in the net of each
        levels = np.unique(np.floor(np.log2(reach[1:])).astype(np.int64))[::-1] if len(reach) > 1 else np.zeros(0, np.int64)
        sizes = [1, *(int((reach > 2.0**i).sum()) for i in levels)]
        sizes = sorted({*sizes, len(chosen)})
        # parent of each net point in the net above, by distance
        below = {}
        for upper, lower in zip(sizes, sizes[1:]):
            d = ((points[chosen[upper:lower], None] - points[None, chosen[:upper]]) ** 2).sum(axis=2) if (lower - upper) * upper * points.shape[1] < 1 << 24 else None
            up = d.argmin(axis=1) if d is not None else np.array([int(((points[chosen[:upper]] - points[c]) ** 2).sum(axis=1).argmin()) for c in chosen[upper:lower]])
            for child, parent in zip(range(upper, lower), up.tolist()):
                below.setdefault((upper, parent), []).append(child)
        by = np.argsort(nearest, kind="stable")
        cuts = np.searchsorted(nearest[by], np.arange(len(chosen) + 1))
        last = len(sizes) - 1
        under = [None] * last + [np.diff(cuts)]  # points below each net point, by level
        for depth in range(last - 1, -1, -1):
            under[depth] = under[depth + 1][: sizes[depth]].copy()
            for c in range(sizes[depth]):
                under[depth][c] += sum(under[depth + 1][x] for x in below.get((sizes[depth], c), ()))

        def points_below(c, depth):
            out, open_ = [], [(c, depth)]
            while open_:
                c, depth = open_.pop()
                if depth == last:
                    out += by[cuts[c] : cuts[c + 1]].tolist()
                else:
                    open_ += [(x, depth + 1) for x in (c, *below.get((sizes[depth], c), ()))]
            return out

        order, todo = [], [(0, 0, None)]
        while todo:
            c, depth, parent = todo.pop()
            if depth == -1:  # all below the node c have been placed
                self.end[c] = len(order)
                continue
            # a point without other children stays itself on finer levels: go down at once
            while depth < last and (sizes[depth], c) not in below:
                depth += 1
            node = len(self.centre)
            self.centre.append(points[chosen[c]])
            self.start.append(len(order))
            self.end.append(0)
            self.children.append([])
            self.level.append(depth)
            if parent is not None:
                self.children[parent].append(node)
            if depth == last or under[depth][c] <= leaf:  # few enough points are a leaf on any level
                order += points_below(c, depth)
                self.end[node] = len(order)
                continue
            todo.append((node, -1, None))
            todo += [(x, depth + 1, node) for x in [c, *below[sizes[depth], c]]]
        self.order = np.array(order)
        self.centre = np.array(self.centre)
        self.start, self.end = np.array(self.start), np.array(self.end)
        self.radius = np.array([np.sqrt(((points[self.order[s:e]] - c) ** 2).sum(axis=1)).max() for c, s, e in zip(self.centre, self.start, self.end)])
        # a little wider than computed, so that rounding never prunes
        self.radius = self.radius * (1 + 1e-9) + 1e-6
        self.norm = np.sqrt((self.centre**2).sum(axis=1)) * (1 + 1e-9)


def search(qid: np.ndarray, q: np.ndarray, rid: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each query its k best (scores, ids; ids -1 where there are fewer) among r, its own id left out, ties to
    smaller ids; and the number of products computed. q and r hold whole numbers as doubles."""
    order = np.argsort(rid, kind="stable")
    rid, r = rid[order], r[order]
    none = np.iinfo(np.int64).min
    score, best, products = np.full((len(q), k), none), np.full((len(q), k), -1, np.int64), 0
    if not len(q) or not len(r):
        return score, best, products
    if max(abs(q).max(), 1) * max(abs(r).max(), 1) * q.shape[1] >= 2**53:
        q, r = q.astype(np.int64), r.astype(np.int64)
    tq, tr = CoverTree(q.astype(float), QUERY_LEAF), CoverTree(r.astype(float))

    def bound(a, b):
        top = (tq.centre[a] * tr.centre[b]).sum(axis=-1) + tq.radius[a] * tr.norm[b] + tr.radius[b] * tq.norm[a] + tq.radius[a] * tr.radius[b]
        return top + abs(top) * 1e-9

    def compare(a, nodes):
        nonlocal products
        mine = tq.order[tq.start[a] : tq.end[a]]
        cols = np.concatenate([tr.order[tr.start[n] : tr.end[n]] for n in nodes])
        s = q[mine] @ r[cols].T
        products += s.size
        # only what reaches a query's kth score so far can enter its list
        i, j = np.nonzero((s >= score[mine, -1][:, None]) & (qid[mine][:, None] != rid[cols][None, :]))
        if not len(i):
            return
        rows = np.concatenate((np.repeat(np.arange(len(mine)), k), i))
        new_score, new_id = np.concatenate((score[mine].ravel(), s[i, j].astype(np.int64))), np.concatenate((best[mine].ravel(), rid[cols[j]]))
        by = np.lexsort((new_id, -(new_score + (new_score == none)), rows))
        first = np.searchsorted(rows[by], np.arange(len(mine)))
        top = by[first[:, None] + np.arange(k)]
        score[mine], best[mine] = new_score[top], new_id[top]

    leaves_q = [n for n, c in enumerate(tq.children) if not c]
    leaves_r = np.array([n for n, c in enumerate(tr.children) if not c])
    seen = {}
    for a in leaves_q:  # the most promising leaves first give every query a kth score to prune by
        likely = leaves_r[np.argsort(-(tr.centre[leaves_r] @ tq.centre[a]), kind="stable")[:2]]
        compare(a, likely)
        seen[a] = set(likely.tolist())

    def worst(a):
        return score[tq.order[tq.start[a] : tq.end[a]], -1].min()

    pairs, open_pairs = {a: [] for a in leaves_q}, [(0, np.array([0]))]
    while open_pairs:
        a, nodes = open_pairs.pop()
        nodes = nodes[bound(a, nodes) >= worst(a)]
        if not len(nodes):
            continue
        below = [c for n in nodes for c in (tr.children[n] or [n])]
        if tq.children[a]:
            open_pairs += [(c, np.array(below)) for c in tq.children[a]]
        elif any(tr.children[n] for n in nodes):
            open_pairs.append((a, np.array(below)))
        else:
            pairs[a] = nodes
    for a, nodes in pairs.items():
        nodes = np.array([n for n in nodes if n not in seen[a]], np.int64)
        nodes = nodes[np.argsort(-bound(a, nodes), kind="stable")] if len(nodes) else nodes
        mine = tq.order[tq.start[a] : tq.end[a]]
        length = np.sqrt((q[mine].astype(float) ** 2).sum(axis=1))[:, None]
        while len(nodes):
            nodes = nodes[bound(a, nodes) >= worst(a)]
            # at the leaves each query looks by itself, which is tighter than their ball
            top = q[mine] @ tr.centre[nodes].T + length * tr.radius[nodes]
            nodes = nodes[(top + abs(top) * 1e-9 >= score[mine, -1][:, None]).any(axis=0)]
            if len(nodes):
                some = max(1, int(np.searchsorted(np.cumsum(tr.end[nodes] - tr.start[nodes]), CHUNK, "right")))
                compare(a, nodes[:some])
                nodes = nodes[some:]
    return score, best, products


def whole_numbers(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double (array of long); null where the vector or a component is null or not finite."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(x.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long")))


def _vectors(batch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1)


def _by_size(batch, column: str):
    """(row positions, components, vectors) for each number of components."""
    sizes = pa.compute.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)
    for d in np.unique(sizes):
        at = np.nonzero(sizes == d)[0]
        yield at, int(d), _vectors(batch.take(pa.array(at)), column)


def _pivots(rows: DataFrame, n: int) -> tuple[dict, dict]:
    """By number of components: the pivots, and the sample's ids and vectors. The sample is SAMPLE rows at most, those with the smallest hashes."""
    place = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30))
    drawn = rows.withColumn("h", place).where(F.col("h") < (1.2 * SAMPLE + 100) / max(n, 1) * (1 << 30)).orderBy("h", "id").limit(SAMPLE).select("id", "v").toArrow()
    pivots, sample = {}, {}
    for batch in drawn.combine_chunks().to_batches():
        for at, d, v in _by_size(batch, "v"):
            sample[d] = batch.column("id").to_numpy()[at], v
            pivots[d] = v[farthest_first(v, min(PIVOTS, max(1, n // PIVOT_ROWS)))[0]]
    return pivots, sample


def _assigned(rows: DataFrame, pivots) -> DataFrame:
    """rows (id, v, q) with p, the nearest pivot (0 where none has the row's number of components), and its distance."""

    def run(batches):
        for batch in batches:
            p, far = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for at, d, v in _by_size(batch, "v") if len(batch) else ():
                centres = pivots.value[0].get(d, np.zeros((1, d)))
                for i in range(0, len(at), 1024):
                    x = v[i : i + 1024]
                    square = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)
                    best = square.argmin(axis=1)
                    p[at[i : i + 1024]], far[at[i : i + 1024]] = best, np.sqrt(((x - centres[best]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(far)], [*batch.schema.names, "p", "far"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("p", T.IntegerType()), T.StructField("far", T.DoubleType())]))


def _asked(asks: DataFrame, pivots, balls: dict, k: int) -> DataFrame:
    """(id, v, d, p) for each query and each pivot whose ball may hold one of its k best; balls: radius by (components, pivot)."""

    def run(batches):
        for batch in batches:
            rows, to = [], []
            for at, d, v in _by_size(batch, "v") if len(batch) else ():
                mine = np.array([p for e, p in balls if e == d])
                if not len(mine):
                    continue
                centres, radius = pivots.value[0].get(d, np.zeros((1, d)))[mine], np.array([balls[d, int(p)] for p in mine])
                ids, sample = pivots.value[1].get(d, (np.zeros(0, np.int64), np.zeros((0, d))))
                for i in range(0, len(at), 256):
                    x, own = v[i : i + 256], batch.column("id").to_numpy()[at[i : i + 256]]
                    least = np.full(len(x), -np.inf)
                    if len(ids) > k:
                        products = x @ sample.T
                        products[own[:, None] == ids[None, :]] = -np.inf
                        least = np.partition(products, -k, axis=1)[:, -k]
                    top = x @ centres.T + np.sqrt((x**2).sum(axis=1))[:, None] * radius
                    q, p = np.nonzero(top + abs(top) * 1e-9 + 1e-6 >= least[:, None])
                    rows.append(at[i + q])
                    to.append(mine[p])
            if rows:
                taken = batch.take(pa.array(np.concatenate(rows)))
                d = pa.compute.list_value_length(taken.column("v"))
                yield pa.RecordBatch.from_arrays([taken.column("id"), taken.column("v"), d, pa.array(np.concatenate(to).astype(np.int32))], ["id", "v", "d", "p"])

    return asks.select("id", "v").mapInArrow(run, "id long, v array<long>, d int, p int")


def top_products(vectors: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "whole", k: int = 5, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> DataFrame:
    """(query_id, rank, id, score): each query row's k largest inner products with all rows of other ids.

    vector: array of long. Rows with a null id or vector, and vectors of no component, take no part; vectors of different lengths aren't
    compared. A repeated row is one more candidate; the best k of a query id hold each id as often as it occurs. Of a query id with
    different vectors the one that comes first (by components, one after another) is asked. Other columns are left out, whatever
    their names. Fewer than k candidates: all of them. An empty table, or one without queries: no rows.
    """
    bounded_batches(vectors.sparkSession)
    rows = vectors.where(F.col(id).isNotNull() & F.col(vector).isNotNull()).where(F.size(vector) > 0).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n = rows.count()
    pivots = _pivots(rows, n)
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # SAMPLE vectors at most
    placed = checkpoint(_assigned(rows, shared).withColumn("d", F.size("v")))
    stats = placed.groupBy("d", "p").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"))
    stats = {(r["d"], r["p"]): (r["n"], r["far"]) for r in stats.collect()}  # a row a pivot
    balls = {x: far * (1 + 1e-9) + 1e-6 for x, (_, far) in stats.items()}
    cuts = F.lit(1)
    for (d, p), (m, _) in stats.items():
        if m > data_block:
            cuts = F.when((F.col("d") == d) & (F.col("p") == p), -(-m // data_block)).otherwise(cuts)
    asks = placed.where("q").groupBy("id").agg(F.min("v").alias("v"))
    asked = _asked(asks, shared, balls, k).withColumn("c", F.explode(F.sequence(F.lit(0), cuts - 1)))
    # as many queries as there may be are dealt to pieces of query_block
    pieces = max(1, -(-asks.count() // query_block))
    deal = lambda m, salt: F.pmod(F.xxhash64("id", F.lit(salt)), m).cast("int")
    asked = asked.select("d", "p", "c", deal(F.lit(pieces), 1).alias("b"), F.lit(True).alias("q"), "id", "v")
    spread = F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))
    data = placed.select("d", "p", deal(cuts, 2).alias("c"), spread.alias("b"), F.lit(False).alias("q"), "id", "v")

    def run(table: pa.Table) -> pa.Table:
        q = table.column("q").to_numpy().astype(bool)
        ids = table.column("id").to_numpy()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(float)
        if len(ids) and abs(v).max() >= 2**31:
            raise ValueError("a component is beyond 32 bits")
        score, best, _ = search(ids[q], v[q], ids[~q], v[~q], k)
        asked, at = np.nonzero(best >= 0) if not (ids < 0).any() else np.nonzero(score > np.iinfo(np.int64).min)
        return pa.table({"query_id": pa.array(ids[q][asked], pa.int64()), "id": pa.array(best[asked, at], pa.int64()), "score": pa.array(score[asked, at], pa.int64())})

    blocks = sum(-(-m // data_block) for m, _ in stats.values()) * pieces
    part = asked.union(data).repartition(max(1, min(blocks, MOST_TASKS)), "d", "p", "c", "b").groupBy("d", "p", "c", "b").applyInArrow(run, "query_id long, id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return part.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id), "score")
