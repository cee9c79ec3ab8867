"""Detector regions of a frame: equal proposals folded into leaves, then merged while that saves detector pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EDGES = ["left", "top", "right", "bottom"]


def leaves(proposals: DataFrame, frame: list[str]) -> DataFrame:
    """One row for each distinct rectangle of a frame: leaf_no in rectangle order, how many proposals it stands for, and the number of the first of them."""
    folded = proposals.groupBy(*frame, *EDGES).agg(F.count(F.lit(1)).alias("proposals"))
    order = W.partitionBy(*frame).orderBy(*EDGES)
    before = F.coalesce(F.sum("proposals").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return folded.withColumn("leaf_no", (F.row_number().over(order) - 1).cast("long")).withColumn("first_member", before.cast("long"))


def _scale(h: int, w: int) -> tuple[int, int]:
    """The detector's scale of a page as a fraction: the larger of its two axes'."""
    short, long = min(h, w), max(h, w)
    along = ((long * 736 + short // 2) // short + 16) // 32 * 32
    axes = [(736, h), (along, w)] if h <= w else [(along, h), (736, w)]
    return max(axes, key=lambda a: (a[0] * axes[0][1] * axes[1][1] // a[1], a is axes[0]))


class Merger:
    """Merges the pair that saves most, again and again; nothing is merged at a loss.

    Savings stand in a matrix with each row's highest beside it. A merge fills one row anew and looks again only at
    rows whose highest it took away. Ties go by the merged rectangle, its members, then the nodes' numbers.
    """

    def __init__(self, h: int, w: int, rects: np.ndarray, members: list[list[int]]):
        self.up, self.down = _scale(h, w)
        self.rects, self.members, self.ids = rects.astype(np.int64), list(members), list(range(len(members)))
        self.pixels = self._pixels(self.rects)
        n = len(members)
        self.next, self.live = n, np.ones(n, bool)
        self.saving = np.full((n, n), -1, np.int64)
        for i in range(n):
            self.saving[i, i + 1 :] = self._savings(i, np.arange(i + 1, n))
        self.top = self.saving.max(1, initial=-1)
        self.merges = []

    def _pixels(self, r: np.ndarray) -> np.ndarray:
        side = lambda e: -(-e * self.up // (32 * self.down)) * 32
        return side(r[:, 3] - r[:, 1]) * side(r[:, 2] - r[:, 0])

    def _around(self, i: int, others: np.ndarray) -> np.ndarray:
        a, b = self.rects[i], self.rects[others]
        return np.hstack([np.minimum(a[:2], b[:, :2]), np.maximum(a[2:], b[:, 2:])])

    def _savings(self, i: int, others: np.ndarray) -> np.ndarray:
        return np.maximum(self.pixels[i] + self.pixels[others] - self._pixels(self._around(i, others)), -1)

    def run(self) -> Merger:
        while len(self.top) and (best := self.top.max()) >= 0:
            ties = []
            for i in np.flatnonzero(self.top == best):
                for j in np.flatnonzero(self.saving[i] == best):
                    rect = self._around(i, np.array([j]))[0]
                    ties.append((tuple(rect.tolist()), sorted(self.members[i] + self.members[j]), sorted((self.ids[i], self.ids[j])), i, j))
            rect, members, _, i, j = min(ties)
            self.merges.append((len(self.merges), int(best), *rect, members))
            self._join(i, j, rect, members)
        return self

    def _join(self, i: int, j: int, rect: tuple, members: list[int]) -> None:
        hurt = ((self.saving[:, i] == self.top) | (self.saving[:, j] == self.top)) & (self.top >= 0)
        for k in (i, j):
            self.saving[k, :] = self.saving[:, k] = -1
        self.live[j], self.top[i], self.top[j] = False, -1, -1
        self.rects[i], self.members[i], self.ids[i] = rect, members, self.next
        self.next += 1
        self.pixels[i] = self._pixels(self.rects[i : i + 1])[0]
        others = np.flatnonzero(self.live)
        others = others[others != i]
        self.saving[i, others] = self._savings(i, others)
        hurt[i] = True
        for k in np.flatnonzero(hurt & self.live):
            self.top[k] = self.saving[k].max()

    def regions(self) -> list[tuple]:
        rows = sorted((tuple(self.rects[k].tolist()), self.members[k], int(self.pixels[k])) for k in np.flatnonzero(self.live))
        return [(n, *rect, members, pixels) for n, (rect, members, pixels) in enumerate(rows)]


def merged(proposals: DataFrame, frame: list[str], h: int, w: int) -> DataFrame:
    """Regions left of each frame of h x w: region_no, rectangle, numbers of the proposals in it, detector pixels.

    A frame's leaves are one row (a frame holds 3,000 elements at most), so a batch of small frames is one call of Python.
    """
    known = {f.name: f.dataType.simpleString() for f in proposals.schema}
    schema = ", ".join([*(f"{c} {known[c]}" for c in frame), "region_no long", *(f"{c} long" for c in EDGES), "members array<long>", "pixels long"])

    def run(batches):
        for rows in batches:
            out = []
            for key, found in zip(rows[frame].itertuples(index=False, name=None), rows["found"]):
                rects = np.array([[r[c] for c in EDGES] for r in found], np.int64)
                if (rects[:, :2] >= rects[:, 2:]).any() or (rects < 0).any() or (rects[:, 2] > w).any() or (rects[:, 3] > h).any():
                    raise ValueError("a proposal has no area or leaves the frame")
                members = [list(range(r["first_member"], r["first_member"] + r["proposals"])) for r in found]
                out += [(*key, *r) for r in Merger(h, w, rects, members).run().regions()]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    found = F.array_sort(F.collect_list(F.struct("leaf_no", *EDGES, "proposals", "first_member"))).alias("found")
    return leaves(proposals, frame).groupBy(*frame).agg(found).mapInPandas(run, schema)
