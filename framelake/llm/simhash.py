"""SimHash near-duplicates: fingerprints, tiled exact comparison, components.

Fingerprints within `radius` bits are found exactly and without comparing all pairs. The 64 bits are cut into
radius + 1 bands; two fingerprints within the radius agree in one band at least (many fingerprints: into more bands, all but
`radius` of which agree). A cell holds the distinct fingerprints that agree in a band (in those). Within a cell, rows are ordered by population count and cut into tiles; a tile pair
whose counts differ beyond the radius is skipped, every other is compared by exclusive-or and bit counts. Cells
over TILE_ROWS rows are dealt over several tasks: their rows are cut by population count and a hash into parts of
about TILE_ROWS, and each pair of parts within the radius is a task of its own. Each task returns no more links
than it has rows (a spanning forest), so a group of n copies gives O(n) rows, not n squared.

similar_documents() links texts by the exact Jaccard similarity of their sets of shingles. The links above come first, each decided by the sets.
64 bits can't bound that similarity, so what they leave apart goes on: there cells are shingles in both sets' prefixes, and what is compared
are parity sketches, a bit a shingle: sets that are similar enough differ in few bits for certain, so exclusive-or and bit counts
lose no pair, and what they leave is decided by the sets.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .components import connected_components, roots
from .runtime import bounded_batches, checkpoint, few, with_field

RADIUS, SHINGLE, SEED = 3, 3, 42
TILE, TILE_ROWS = 256, 4096
#: For similarity of shingle sets: words of a shingle, least similarity.
SIMILAR_WORDS, SIMILARITY = 5, 0.8
#: The sample that tells common shingles: texts at least, one text in so many, shingles counted at once; common ones at most; slack of bounds in doubles.
SAMPLE_TEXTS, SAMPLE_EVERY, SAMPLE_SHINGLES, COMMON, _EPS = 4_000, 16, 2_000_000, 400_000, 1e-9
#: Nodes of a cell up to which all its pairs are looked at at once; rows of cells held at once; bits of a sketch; pairs held for a forest.
LARGE_CELL, MEET_ROWS, MOST_PARTS, BEST_PAIRS = 64, 100_000, 1 << 16, 1_000_000
#: Comparisons that take as long as moving a row to another cell.
ROW_COST = 1_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """64-bit SimHash of one text; see fingerprints()."""
    from xxhash import xxh64_intdigest

    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not found:
        return 0
    joined, sizes = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(words, len(found))
    whole, starts, ends = memoryview(joined), starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), 65_536):
        hashes = np.array([xxh64_intdigest(whole[s:e], SEED) for s, e in zip(starts[at : at + 65_536], ends[at : at + 65_536])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", words: int = SHINGLE, out: str = "fp") -> DataFrame:
    """Replaces the text column by out (long, the fingerprint's bits).

    A-Z are lower-cased; words are runs other than blank, tab, line feed, VT, FF, CR; shingles of `words` words,
    repeats included, are joined by one blank and hashed by XXH64 with seed 42; a bit is set if set in over half of
    the hashes. With fewer words than that the whole sequence is one shingle; no word (null, empty): 0.
    """
    bounded_batches(df.sparkSession)
    schema = with_field(T.StructType([f for f in df.schema.fields if f.name != text]), out, T.LongType())

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x, words) for x in batch.column(text).to_pylist()], np.uint64).view(np.int64)
            keep = [i for i, x in enumerate(batch.schema.names) if x not in (text, out)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(found)], [*(batch.schema.names[i] for i in keep), out])

    return df.mapInArrow(run, schema)


def close_pairs(a: np.ndarray, b: np.ndarray | None, radius: int):
    """Yields, tile pair by tile pair, indices (i into a, j into b) of all pairs within the radius; b None: pairs within a, each once.

    Both are uint64 in any order. Tiles are cut along the population counts; tile pairs apart by more than the
    radius there are skipped.
    """
    same, b = b is None, a if b is None else b
    pa_, pb = np.bitwise_count(a), np.bitwise_count(b)
    oa, ob = np.argsort(pa_, kind="stable"), np.argsort(pb, kind="stable")
    sa, sb, pa_, pb = a[oa], b[ob], pa_[oa].astype(np.int64), pb[ob].astype(np.int64)
    for i in range(0, len(sa), TILE):
        low, high = pa_[i] - radius, pa_[min(i + TILE, len(sa)) - 1] + radius
        first, last = np.searchsorted(pb, low), np.searchsorted(pb, high, "right")
        for j in range(i if same else first // TILE * TILE, last, TILE):
            x, y = np.nonzero(np.bitwise_count(sa[i : i + TILE, None] ^ sb[None, j : j + TILE]) <= radius)
            x, y = x + i, y + j
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield oa[x], ob[y]


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices into a, then b) of a spanning forest of the pairs within the radius, each of them such a pair.

    Each tile's pairs are joined as they come; pairs that are joined already aren't looked at, so memory is that of one tile pair.
    """
    n, shift = len(a) + (0 if b is None else len(b)), 0 if b is None else len(a)
    label, u, v = np.arange(n), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in close_pairs(a, b, radius):
        j = j + shift
        while (apart := label[i] != label[j]).any():
            i, j = i[apart], j[apart]
            first = np.unique(np.stack((label[i], label[j]), axis=1), return_index=True)[1]  # each tree's first pair: no cycle arises
            chosen = np.unique(first // 2)
            u.append(i[chosen])
            v.append(j[chosen])
            label = _merged(label, u[-1], v[-1])
    return np.concatenate(u), np.concatenate(v)


def _merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the nodes i and j have been joined."""
    used, at = np.unique(np.concatenate((label[i], label[j])), return_inverse=True)
    to = np.arange(len(label))
    to[used] = used[roots(len(used), at[: len(i)], at[len(i) :])]
    return to[label]


def _small_cells(cell: np.ndarray, fp: np.ndarray, radius: int):
    """Index pairs within runs of equal cell (ordered by it): neighbours at distance 1, 2, ... in the whole array at once."""
    i, j, d = [], [], 1
    at = np.arange(len(fp) - 1) if len(fp) > 1 else np.zeros(0, np.int64)
    while len(at := at[at + d < len(fp)]) and len(at := at[cell[at] == cell[at + d]]):
        hit = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= radius]
        i.append(hit)
        j.append(hit + d)
        d += 1
    return (np.concatenate(i), np.concatenate(j)) if i else (np.zeros(0, np.int64),) * 2


def _by_task(of, columns, schema: list[str]):
    """A function of batches ordered by task (column 0), for mapInArrow: of(columns' arrays) gets whole tasks, several at once, and
    returns arrays u and v."""

    def run(batches):
        held = []  # the pieces of the last task, which may go on in the next batch

        def done(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in of(*rows)], schema)

        for batch in batches:
            if not len(batch):
                continue
            rows = columns(batch)
            if held and held[0][0][-1] == rows[0][0] == rows[0][-1]:
                held.append(rows)
                continue
            rows = [np.concatenate(x) for x in zip(*held, rows)]
            last = int(np.nonzero(rows[0] != rows[0][-1])[0].max(initial=-1)) + 1
            held = [[x[last:] for x in rows]]
            if last:
                yield done([x[:last] for x in rows])
        if held:
            yield done([np.concatenate(x) for x in zip(*held)])

    return run


def _links(radius: int):
    """(task, side, fp) ordered by task and side -> links u, v between fingerprints. Rows of side 1 are compared with those of side 0,
    or, if all rows are on side 0, these with one another."""

    def of(task, side, fp):
        u, v = [], []
        starts = np.concatenate(([0], np.nonzero(np.diff(task))[0] + 1, [len(task)]))
        sizes = np.diff(starts)
        tiny = np.repeat((sizes <= 32) & (np.maximum.reduceat(side, starts[:-1]) == 0), sizes)
        if tiny.any():
            at = np.nonzero(tiny)[0]
            i, j = (at[x] for x in _small_cells(task[tiny], fp[tiny], radius))
            u.append(fp[i])
            v.append(fp[j])
        for s, e in zip(starts[:-1], starts[1:]):
            if not tiny[s]:
                cut = s + int(np.searchsorted(side[s:e], 1))
                i, j = forest(fp[s:cut], fp[cut:e] if cut < e else None, radius)
                u.append(fp[s + i])
                v.append(fp[s + j])
        return [(np.concatenate(x) if x else np.zeros(0, np.uint64)).view(np.int64) for x in (u, v)]

    def columns(batch):
        out = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
        return [out[0], out[1], out[2].view(np.uint64)]

    return _by_task(of, columns, ["u", "v"])


def band_count(n: int, radius: int) -> int:
    """Into how many bands to cut n fingerprints' bits: fingerprints within the radius agree in all but `radius` of them, so each set of
    the others is a table of cells. More bands make finer cells and more tables; comparisons per table are about n squared by cells."""
    def cost(bands):
        tables = math.comb(bands, radius)
        return tables * (n * ROW_COST + n * n / 2.0 ** (64 * (bands - radius) / bands + 1))

    return min(range(radius + 1, radius + 5), key=cost)


def links(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, bands: int | None = None) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of distinct fingerprints (fp: long) within radius bits.

    Nulls are ignored. Every returned link is one within the radius. fps must be cheap to read several times.
    bands: band_count() of the fingerprints unless given; results don't depend on it.
    """
    if not 0 <= radius <= 15:
        raise ValueError("the radius must be from 0 to 15")
    alone = fps.where("fp IS NOT NULL").select("fp").distinct()
    bands = bands or band_count(alone.count(), radius)
    edges = [64 * i // bands for i in range(bands + 1)]
    band = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << e - s) - 1).cast("long")) for s, e in zip(edges, edges[1:])]
    if not radius:
        cells = F.array(F.lit(0).cast("long"))
    elif bands == radius + 1:
        cells = F.array(*(F.lit(i).cast("long") * F.lit(1 << 56) + b for i, b in enumerate(band)))
    else:  # two cells with one hash are one cell, in which more is compared
        cells = F.array(*(F.xxhash64(F.lit(i), *(band[x] for x in kept)) for i, kept in enumerate(itertools.combinations(range(bands), bands - radius))))
    rows = alone.withColumn("pop", F.bit_count("fp")).withColumn("cell", F.explode(cells))
    dealt = _dealt(rows, "fp", lambda high, low: low - high <= radius, tile_rows).repartition("task").sortWithinPartitions("task", "side")
    return dealt.select("task", "side", "fp").mapInArrow(_links(radius), "u long, v long").distinct()


def _dealt(rows: DataFrame, node: str, near, tile_rows: int) -> DataFrame:
    """rows (cell, pop, ...) with a task and side for each comparison a row takes part in.

    A cell of up to tile_rows rows is one task, all on side 0. A larger one is cut along pop (and by a hash of node where rows
    agree in pop) into parts of about that many; each part is a task, and each pair of parts one with its parts on sides 0 and 1, if
    near(high, low): a row whose pop is high can match one that has low, and high <= low where the parts don't overlap.
    """
    counts = checkpoint(rows.groupBy("cell", "pop").agg(F.count(F.lit(1)).alias("n")))
    upto = F.sum("n").over(W.partitionBy("cell").orderBy("pop"))
    cut = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(W.partitionBy("cell"))).where(F.col("all") > tile_rows)
    parts = cut.select("cell", "pop", F.floor((F.col("upto") - F.col("n")) / tile_rows).cast("int").alias("first"), F.floor((F.col("upto") - 1) / tile_rows).cast("int").alias("last"))
    tiles = parts.select("cell", "pop", F.explode(F.sequence("first", "last")).alias("part")).groupBy("cell", "part").agg(F.min("pop").alias("low"), F.max("pop").alias("high"))
    other = tiles.select("cell", F.col("part").alias("part2"), F.col("low").alias("low2"))
    pairs = tiles.join(other, "cell").where((F.col("part") <= F.col("part2")) & near(F.col("high"), F.col("low2")))
    task = F.xxhash64("cell", "part", "part2").alias("task")
    sides = pairs.select("cell", "part", task, F.lit(0).alias("side")).union(pairs.where("part < part2").select("cell", "part2", task, F.lit(1)))
    marked = rows.join(parts, ["cell", "pop"], "left")
    part = (F.col("first") + F.pmod(F.xxhash64(node), F.col("last") - F.col("first") + 1)).cast("int")
    hot = marked.where("first IS NOT NULL").withColumn("part", part).join(sides, ["cell", "part"]).select("task", "side", *rows.columns)
    cold = marked.where("first IS NULL").select(F.col("cell").alias("task"), F.lit(0).alias("side"), *rows.columns)
    return cold.union(hot)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct XXH64 hashes of the shingles of `words` words, in order; words and short texts as in fingerprints()."""
    from xxhash import xxh64_intdigest

    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not found:
        return np.zeros(0, np.uint64)
    k = min(words, len(found))
    joined, sizes = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    whole, starts, ends = memoryview(joined), (ends - sizes)[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    return np.sort(np.fromiter({xxh64_intdigest(whole[s:e], SEED) for s, e in zip(starts, ends)}, np.uint64))


def prefix(found: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first of found in an order of all shingles (those not in common first, then by hash) that suffice to meet.

    A set of that similarity has at least ceil(similarity * n) of the n, so two such sets share one of their first
    n - ceil(similarity * n) + 1 each, whatever the order is. Sets so small that only equal ones are similar: none.
    """
    n = len(found)
    if n < similarity * (n + 1) - _EPS:
        return found[:0]
    at = np.minimum(np.searchsorted(common, found), max(len(common) - 1, 0))
    last = common[at] == found if len(common) else np.zeros(n, bool)
    return np.concatenate((found[~last], found[last]))[: n - math.ceil(similarity * n - _EPS) + 1]


def _common_shingles(own: DataFrame, words: int) -> np.ndarray:
    """Shingles that several texts of a sample (one text in SAMPLE_EVERY, and SAMPLE_TEXTS if the table has as many) share, the COMMON
    most frequent at most. They only come last in prefix()'s order: results don't depend on them."""
    share = min(1.0, max(1 / SAMPLE_EVERY, SAMPLE_TEXTS / max(1, own.count())))
    sample = own.where(F.pmod(F.shiftrightunsigned("__hash", 20), F.lit(1 << 20)) < share * (1 << 20)).select("__hash", "__text")

    def run(batches):
        held, size = [], 0

        def counted():
            found, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int32))], ["h", "n"])

        for batch in batches:
            for x in dict(zip(*(c.to_pylist() for c in batch.columns))).values():
                held.append(shingle_set(x, words))
                size += len(held[-1])
            if size > SAMPLE_SHINGLES:
                yield counted()
                held, size = [], 0
        yield counted()

    counts = checkpoint(sample.mapInArrow(run, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 3"))
    least, total = 3, 0
    for r in sorted(counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["n"]):
        total += r["k"]
        if total > COMMON:
            least = r["n"] + 1
            break
    found = counts.where(F.col("n") >= least).select("h").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def parity_sketch(found: np.ndarray) -> bytes:
    """A bit for each of 64 * 2^k parts (at least one a hash, MOST_PARTS at most) that the hashes' low bits deal them to: whether the part has an odd number.

    Each hash that only one of two sets has turns one bit, so sketches differ in no more bits than sets do in hashes. The halves of a
    sketch, exclusive-or, are the sketch of half as many parts.
    """
    parts = 64
    while parts < min(len(found), MOST_PARTS):
        parts *= 2
    odd = np.bincount((found & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _reach(n, m, similarity: float):
    """The most hashes that sets of n and m hashes of that similarity differ in."""
    return np.floor((1 - similarity) / (1 + similarity) * (n + m) + _EPS)


def _may_be_alike(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """pairs but for those whose sketches show that they differ in too many shingles."""

    def run(batches):
        for batch in batches:
            n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            a, b = (batch.column(i).to_pylist() for i in (4, 5))
            wide = np.array([len(x) << 32 | len(y) for x, y in zip(a, b)], np.int64)
            near = np.zeros(len(batch), bool)
            for w in np.unique(wide):
                at = np.nonzero(wide == w)[0]
                x, y = (np.frombuffer(b"".join([z[i] for i in at]), np.uint64).reshape(len(at), -1) for z in (a, b))
                words = min(x.shape[1], y.shape[1])
                near[at] = np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum(axis=1) <= _reach(n[at], m[at], similarity)
            yield batch.select(["u", "v"]).filter(pa.array(near))

    of = lambda x, n, sketch: nodes.select(F.col("node").alias(x), F.col("n").alias(n), F.col("sketch").alias(sketch))
    joined = pairs.join(of("u", "n", "a"), "u").join(of("v", "m", "b"), "v").select("u", "v", "n", "m", "a", "b")
    return checkpoint(joined.mapInArrow(run, "u long, v long"))


def _meet(similarity: float):
    """(token, node, n, pos), ordered by token, n and node -> pairs (token null, u, v) that sizes and places in the prefixes allow:
    in cells up to LARGE_CELL all of them, in larger ones neighbours only; these cells' rows (v null) come as well.

    A cell that goes on over MEET_ROWS rows counts as large in each of its pieces, which overlap by a row.
    """

    def of(token, node, n, pos, cut):
        starts = np.concatenate(([0], np.nonzero(np.diff(token))[0] + 1, [len(token)]))
        many = np.diff(starts) > LARGE_CELL
        many[0] |= cut[0]
        many[-1] |= cut[1]
        large = np.repeat(many, np.diff(starts))
        u, v, at, d = [], [], np.arange(len(token)), 1
        while len(at := at[at + d < len(token)]):
            at = at[(token[at] == token[at + d]) & (n[at] >= similarity * n[at + d] - _EPS)]  # ordered by n: those after are longer still
            if d > 1:
                at = at[~large[at]]
            to = at + d
            hit = np.minimum(n[at] - pos[at], n[to] - pos[to]) >= similarity / (1 + similarity) * (n[at] + n[to]) - _EPS
            u.append(np.minimum(node[at[hit]], node[to[hit]]))
            v.append(np.maximum(node[at[hit]], node[to[hit]]))
            d += 1
        pairs = np.unique(np.stack([np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v)]), axis=1)
        large[: cut[0]] = False  # the overlapping row has come before
        k, rows = pairs.shape[1], np.nonzero(large)[0]
        null = np.arange(k + len(rows)) < k
        put = lambda x, y, mask=None: pa.array(np.concatenate((x, y)).astype(np.int64), mask=mask)
        zero, none = np.zeros(k, np.int64), np.zeros(len(rows), np.int64)
        return pa.RecordBatch.from_arrays([put(zero, token[rows], null), put(pairs[0], node[rows]), put(pairs[1], none, ~null), put(zero, n[rows]), put(zero, pos[rows])], ["token", "u", "v", "n", "pos"])

    def run(batches):
        held, size, before = [], 0, 0  # rows whose last cell may go on; before: the first of them has come in the last piece
        for batch in batches:
            if not len(batch):
                continue
            held.append([c.to_numpy().astype(np.int64) for c in batch.columns])
            size += len(batch)
            if size < MEET_ROWS:
                continue
            rows = [np.concatenate(x) for x in zip(*held)]
            last = int(np.nonzero(rows[0] != rows[0][-1])[0].max(initial=-1)) + 1
            if last:
                yield of(*(x[:last] for x in rows), (before, 0))
                held, size, before = [[x[last:] for x in rows]], size - last, 0
            else:
                yield of(*rows, (before, 1))
                held, size, before = [[x[-1:] for x in rows]], 1, 1
        if held:
            yield of(*(np.concatenate(x) for x in zip(*held)), (before, 0))

    return run


def _tiled(similarity: float, best: bool):
    """(task, side, node, root, n, pos, sketch) ordered by task, side and n -> pairs u, v of nodes of different roots that sizes,
    places and sketches allow; best: of each task only a forest that joins its roots, by the pairs with the fewest differing bits.

    Sets are compared tile by tile, by exclusive-or and bit counts of their sketches; tile pairs whose sets' sizes (the
    population counts of the whole sets) differ beyond the radius are skipped.
    """

    def task_pairs(a, b):
        u, v, bits = [], [], []
        same = b is None
        b = a if same else b
        for i in range(0, len(a[0]), TILE):
            x = [z[i : i + TILE] for z in a]
            for j in range(i if same else 0, len(b[0]), TILE):
                y = [z[j : j + TILE] for z in b]
                if y[2].min() * similarity > x[2].max() + _EPS or x[2].min() * similarity > y[2].max() + _EPS:
                    continue
                near = (x[1][:, None] != y[1][None, :]) & (np.minimum((x[2] - x[3])[:, None], (y[2] - y[3])[None, :]) >= similarity / (1 + similarity) * (x[2][:, None] + y[2][None, :]) - _EPS)
                p, q = np.nonzero(np.triu(near, 1) if same and i == j else near)
                if not len(p):
                    continue
                words = min(len(z) for z in (*x[4], *y[4])) // 8
                s, t = (np.stack([_folded(np.frombuffer(k, np.uint64)[None, :], words)[0] for k in z[4]]) for z in (x, y))
                for at in range(0, len(p), 1 << 14):
                    pp, qq = p[at : at + (1 << 14)], q[at : at + (1 << 14)]
                    differ = np.bitwise_count(s[pp] ^ t[qq]).sum(axis=1, dtype=np.int64)
                    hit = differ <= _reach(x[2][pp], y[2][qq], similarity)
                    u.append(x[0][pp[hit]])
                    v.append(y[0][qq[hit]])
                    bits.append(np.stack((differ[hit], x[1][pp[hit]], y[1][qq[hit]])))
                    if best and sum(map(len, u)) > BEST_PAIRS:
                        u, v, bits = ([z] for z in lightest(u, v, bits))
        return lightest(u, v, bits) if best and u else (u, v, bits)

    def lightest(u, v, bits):
        """A spanning forest of the roots by the pairs with the fewest differing bits (Boruvka's steps)."""
        u, v, bits = np.concatenate(u), np.concatenate(v), np.concatenate(bits, axis=1)
        names, ends = np.unique(bits[1:], return_inverse=True)
        left, right = ends.reshape(2, -1)
        rank = np.argsort(np.argsort(bits[0], kind="stable"), kind="stable")  # all different, so no cycle arises
        label, used = np.arange(len(names)), np.zeros(len(u), bool)
        while len(open_ := np.nonzero(label[left] != label[right])[0]):
            first = np.full(len(names), len(u))
            for side in (left, right):
                np.minimum.at(first, label[side[open_]], rank[open_])
            chosen = np.isin(rank, first[first < len(u)])
            used |= chosen
            label = _merged(label, left[chosen], right[chosen])
        return u[used], v[used], bits[:, used]

    def of(task, side, node, root, n, pos, sketch):
        out = [[], []]
        starts = np.concatenate(([0], np.nonzero(np.diff(task))[0] + 1, [len(task)]))
        for s, e in zip(starts[:-1], starts[1:]):
            cut, rows = int(np.searchsorted(side[s:e], 1)), [x[s:e] for x in (node, root, n, pos, sketch)]
            u, v, _ = task_pairs([x[:cut] for x in rows], [x[cut:] for x in rows] if cut < e - s else None)
            for z, w in zip(out, (u, v)):
                z += w if isinstance(w, list) else [w]
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        return [*np.unique(np.stack((np.minimum(u, v), np.maximum(u, v))), axis=1)]

    def columns(batch):
        sketch = np.empty(len(batch), object)
        sketch[:] = batch.column(6).to_pylist()
        return [*(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)), sketch]

    return _by_task(of, columns, ["u", "v"])


def _alike(pairs: DataFrame, nodes: DataFrame, own: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of pairs (u, v: nodes) whose shingle sets, made again from the texts, have that Jaccard similarity."""
    if pairs.isEmpty():
        return pairs
    wanted = checkpoint(nodes.join(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi").select("node", F.col("text_hash").alias("__h")))
    texts = own.select("__hash", "__text").join(few(wanted), F.col("__hash") == F.col("__h")).dropDuplicates(["node"]).select("node", "__text")

    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x, words).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], ["node", "set"])

    def decide(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both / (len(a) + len(b) - both) >= similarity)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    of = checkpoint(texts.mapInArrow(sets, "node long, set binary"))
    joined = pairs.join(of.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(of.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    return checkpoint(joined.select("u", "v", "a", "b").mapInArrow(decide, "u long, v long"))


def _close_nodes(marks: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """Pairs (u < v) of nodes that links() of their fingerprints give; marks: (fp, node), a checkpoint.

    A fingerprint's least node stands for it; the fingerprint's other nodes are paired with that one.
    """
    least = checkpoint(marks.groupBy("fp").agg(F.min("node").alias("least")))
    of = lambda x: least.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_node"))
    linked = links(least, radius, tile_rows).join(of("u"), "u").join(of("v"), "v")
    pairs = linked.select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v"))
    return checkpoint(pairs.union(marks.join(least, "fp").select("least", "node")).where("u < v").distinct())


def _between(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """Those of pairs (u, v) whose nodes aren't in one component of root (node, root) already."""
    root = few(root)
    of = lambda x: root.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    return pairs.join(of("u"), "u", "left").join(of("v"), "v", "left").where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")


def _further(root: DataFrame, linked: DataFrame) -> DataFrame:
    """root (node, root) after the links (u, v) have been added."""
    return root if linked.isEmpty() else connected_components(root.select(F.col("node").alias("u"), F.col("root").alias("v")).union(linked))


def similar_documents(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, tile_rows: int = TILE_ROWS, radius: int = RADIUS) -> DataFrame:
    """(id, text_hash, component, component_id), one row for each row of df: texts whose sets of `words`-word shingles have at
    least that Jaccard similarity are linked, and only these; component_id is the smallest id of those linked.

    Sets that equal are one node. Links of the texts' fingerprints, as near_duplicates() makes them, are decided first, by the sets, and joined. Then no
    pair between their components is lost: it meets in a cell, that of a shingle in the prefix() of both, and
    sets are compared themselves, unless sizes, places in the prefixes or sketches rule that out. In cells over LARGE_CELL nodes each is
    compared with its neighbour first; those that aren't one component by that are compared tile by tile, first by
    the likeliest pairs that would make them one, then by all that are left between components. Nulls, empty texts and
    repeated rows are as in near_duplicates(): texts without a word are equal.
    """
    bounded_batches(df.sparkSession)
    own = df.select(F.col(id).alias("__id"), F.xxhash64(text).alias("__hash"), F.col(text).alias("__text"))
    common = _common_shingles(own, words)

    def run(batches):
        from xxhash import xxh128_digest

        for batch in batches:
            fps, keys, sizes, sketches, heads = [], [], [], [], []
            for x in batch.column(2).to_pylist():
                fps.append(fingerprint(x))
                found = shingle_set(x, words)
                keys.append(xxh128_digest(found.tobytes()))
                sizes.append(len(found))
                sketches.append(parity_sketch(found))
                heads.append(prefix(found, common, similarity).view(np.int64))
            ends = np.cumsum([0, *map(len, heads)])
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(heads) if heads else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), made], schema.names)

    schema = T.StructType([
        own.schema["__id"], T.StructField("__hash", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("n", T.IntegerType()),
        T.StructField("sketch", T.BinaryType()), T.StructField("head", T.ArrayType(T.LongType())),
    ])
    found = checkpoint(own.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    nodes = checkpoint(found.groupBy("key").agg(F.min("row").alias("node"), F.min("__id").alias("least"), F.min("__hash").alias("text_hash"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    marks = checkpoint(found.select("fp", "key").distinct().join(nodes.select("key", "node"), "key").select("fp", "node"))
    tried = _may_be_alike(_close_nodes(marks, radius, tile_rows), nodes, similarity)
    root = connected_components(_alike(tried, nodes, own, words, similarity))
    cells = found.join(few(nodes.select(F.col("node").alias("__n"))), F.col("row") == F.col("__n"), "left_semi").select(F.col("row").alias("node"), "n", F.posexplode("head").alias("pos", "token"))
    cells = cells.select("token", "node", "n", "pos").repartition("token").sortWithinPartitions("token", "n", "node")
    met = checkpoint(cells.mapInArrow(_meet(similarity), "token long, u long, v long, n long, pos long"))
    # what fingerprints leave apart
    pairs = _may_be_alike(_between(met.where("token IS NULL").select("u", "v").distinct(), root).join(few(tried), ["u", "v"], "left_anti"), nodes, similarity)
    root, tried = _further(root, _alike(pairs, nodes, own, words, similarity)), tried.union(pairs)
    large = met.where("token IS NOT NULL").select("token", F.col("u").alias("node"), "n", "pos")
    if not large.isEmpty():
        of = lambda cells: cells.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rows = of(large)
        mixed = rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
        kept = checkpoint(large.join(mixed, "token", "left_semi").join(nodes.select("node", "sketch"), "node"))
        for best in (True, False):
            rows = of(kept).select(F.col("token").alias("cell"), F.col("n").alias("pop"), "node", "root", "pos", "sketch")
            dealt = _dealt(rows, "node", lambda high, low: high >= similarity * low - _EPS, tile_rows).repartition("task").sortWithinPartitions("task", "side", "pop")
            pairs = dealt.select("task", "side", "node", "root", F.col("pop").alias("n"), "pos", "sketch").mapInArrow(_tiled(similarity, best), "u long, v long")
            pairs = checkpoint(pairs.distinct().join(tried, ["u", "v"], "left_anti"))
            root, tried = _further(root, _alike(pairs, nodes, own, words, similarity)), tried.union(pairs)
    joined = nodes.select("key", "least", "node").join(root, "node", "left").select("key", "least", F.coalesce("root", "node").alias("component"))
    low = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    member = joined.select("key", "component").join(low, "component")
    return found.select("__id", "__hash", "key").join(member, "key").select(F.col("__id").alias(id), F.col("__hash").alias("text_hash"), "component", "component_id")


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id among texts reachable over links of radius bits.

    One row for each row of df. Null and empty texts have fingerprint 0 and are linked like any other; rows with a
    null id are linked too (component_id is null only where no row of the component has an id). Repeated rows
    share a component. An empty table gives an empty result.
    """
    fps = checkpoint(fingerprints(df.select(F.col(id).alias("__id"), F.col(text).alias("__text")), "__text", words))
    least = fps.groupBy("fp").agg(F.min("__id").alias("least"))
    root = connected_components(links(fps, radius))
    joined = least.join(root, least.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # only fingerprints with links need their component's smallest id
    linked = joined.join(root.select(F.col("root")).distinct(), "root", "left_semi").groupBy("root").agg(F.min("least").alias("low"))
    member = joined.join(linked, "root", "left").select("fp", F.coalesce("low", "least").alias("component_id"))
    return fps.join(member, "fp").select(F.col("__id").alias(id), "fp", "component_id")


def kept(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """df without near-duplicates by similar_documents(): of each component one row stays, that with the smallest id.

    A null id comes after all others; of rows with that id the one with the smallest hash of its text stays, and of
    rows that agree in both (copies) any one. Components don't share rows, whatever their ids. Other columns pass through.
    """
    found = similar_documents(df, id, text, words, similarity)
    # rows of an id and a text are in one component
    each = checkpoint(found.groupBy("component", id, "text_hash").agg(F.count(F.lit(1)).alias("copies")))
    least = each.groupBy("component").agg(F.min(F.struct(F.col(id).isNull().alias("nameless"), F.col(id).alias("id"), "text_hash")).alias("__s"))
    stays = (F.col(id).eqNullSafe(F.col("__s.id"))) & (F.col("text_hash") == F.col("__s.text_hash"))
    # what goes, and what stays once of several copies, is less than what just stays: texts needn't move to be told apart
    marks = checkpoint(each.join(least, "component").where(~stays | (F.col("copies") > 1)).select(F.col(id).alias("__gone"), F.col("text_hash").alias("__gone_hash"), stays.alias("__once")))
    rows = df.withColumn("__hash", F.xxhash64(text))
    rows = rows.join(few(marks), F.col(id).eqNullSafe(F.col("__gone")) & (F.col("__hash") == F.col("__gone_hash")), "left")
    alone = rows.where("__once IS NULL").select(*df.columns)
    if marks.where("__once").isEmpty():
        return alone
    return alone.union(rows.where("__once").dropDuplicates([id, "__hash"]).select(*df.columns))
