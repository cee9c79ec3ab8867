"""Visual-change episodes: changed regions of a frame pair, linked over time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LEAF, LEAST_DIFF, LEAST_CHANGED, NEAR = 16, 24, 8, 16
SCHEMA = "stream_no long, ts_ms long, kind string, episode long, x long, y long, w long, h long, changed long"


COUNTS = ["frames", "comparisons", "resizes", "empty", "changed_pixels", "leaves", "regions", "charged_pixels", "starts", "continuations", "closures", "most_regions", "most_open"]


def regions(before: np.ndarray, now: np.ndarray, leaf: int = LEAF, least: int = LEAST_CHANGED) -> list[tuple[int, int, int, int, int]]:
    """(y, x, h, w, changed) of changed areas: leaves with enough changed pixels, four of a square joined while
    the square is at most twice its changed pixels and nothing in it was finished smaller."""
    h, w = now.shape
    count = np.add.reduceat(np.add.reduceat((abs(now.astype(int) - before) >= LEAST_DIFF).astype(int), range(0, h, leaf), 0), range(0, w, leaf), 1)
    level = {(y, x): int(n) for (y, x), n in np.ndenumerate(count) if n >= least}
    box = lambda y, x, s: (y * s, x * s, min((y + 1) * s, h) - y * s, min((x + 1) * s, w) - x * s)
    out, size, shut = [], leaf, set()
    while level:
        parents: dict = {}
        for (y, x), n in level.items():
            parents.setdefault((y // 2, x // 2), []).append((y, x, n))
        joined, shut_up = {}, {(y // 2, x // 2) for y, x in shut}
        for (y, x), parts in parents.items():
            area = np.prod(box(y, x, 2 * size)[2:])
            total = sum(n for *_, n in parts)
            if size < max(h, w) and (y, x) not in shut_up and area <= 2 * total:
                joined[y, x] = total
            else:
                out += [(*box(b, a, size), n) for b, a, n in parts]
                shut_up.add((y, x))
        level, shut, size = joined, shut_up, 2 * size
    return sorted(out)


def changed_regions(planes: DataFrame, key: str, leaf: int = LEAF, least: int = LEAST_CHANGED) -> DataFrame:
    """(key, x, y, w, h, changed) of regions() of pairs of planes (key, width, before, now: arrays of int, row by row); each pair is a row by itself."""
    names = [key, "x", "y", "w", "h", "changed"]

    def run(frames):
        for f in frames:
            out = []
            for k, width, before, now in f.itertuples(index=False, name=None):
                a, b = (np.asarray(p, np.int64).reshape(-1, int(width)) for p in (before, now))
                out += [(k, x, y, w, h, n) for y, x, h, w, n in regions(a, b, leaf, least)]
            yield pd.DataFrame(out, columns=names)

    return planes.select(key, "width", "before", "now").mapInPandas(run, f"{key} {dict(planes.dtypes)[key]}, x long, y long, w long, h long, changed long")


class Episodes:
    """observe() compares a plane with the last one and returns transitions; finish() closes what is open, once."""

    def __init__(self, leaf: int = LEAF, least: int = LEAST_CHANGED):
        self.open, self.next, self.last, self.leaf, self.least, self.done = {}, 1, None, leaf, least, False
        self.counts = dict.fromkeys(COUNTS, 0)

    def _close(self) -> list[tuple]:
        out = [(r, i, "closed") for i, r in self.open.items()]
        self.open = {}
        self.counts["closures"] += len(out)
        return sorted(out, key=lambda t: (t[0], t[1]))

    def observe(self, plane: np.ndarray) -> list[tuple]:
        if self.done:
            raise ValueError("the stream is finished")
        last, self.last, n = self.last, plane, self.counts
        n["frames"] += 1
        if last is None:
            return []
        if last.shape != plane.shape:
            n["resizes"] += 1
            return self._close()
        now, found = regions(last, plane, self.leaf, self.least), []
        changed = (abs(plane.astype(int) - last) >= LEAST_DIFF).astype(int)
        per_leaf = np.add.reduceat(np.add.reduceat(changed, range(0, plane.shape[0], self.leaf), 0), range(0, plane.shape[1], self.leaf), 1)
        for name, v in (("comparisons", 1), ("empty", not now), ("changed_pixels", changed.sum()), ("leaves", (per_leaf >= self.least).sum()), ("regions", len(now)), ("charged_pixels", sum(h * w for _, _, h, w, _ in now))):
            n[name] += int(v)
        n["most_regions"] = max(n["most_regions"], len(now))
        for i, a in self.open.items():
            for j, b in enumerate(now):
                gap = lambda n: max(a[n], b[n]) - min(a[n] + a[n + 2], b[n] + b[n + 2])
                if gap(0) < 2 * NEAR and gap(1) < 2 * NEAR:
                    shared = max(0, -gap(0)) * max(0, -gap(1))
                    apart = sum((2 * a[n] + a[n + 2] - 2 * b[n] - b[n + 2]) ** 2 for n in (0, 1))
                    found.append((-shared, apart, i, b[:4], j))
        to, used = {}, set()
        for _, _, i, _, j in sorted(found):
            if i not in used and j not in to:
                used.add(i)
                to[j] = i
        out = [(r, i, "closed") for i, r in self.open.items() if i not in used]
        self.open = {}
        for j, r in enumerate(now):
            i = to.get(j)
            kind = "continued"
            if i is None:
                i, self.next, kind = self.next, self.next + 1, "started"
            self.open[i] = r
            out.append((r, i, kind))
        for name, kind in (("starts", "started"), ("continuations", "continued"), ("closures", "closed")):
            n[name] += sum(k == kind for *_, k in out)
        n["most_open"] = max(n["most_open"], len(self.open))
        return sorted(out, key=lambda t: (t[0][:4], t[1], ("started", "continued", "closed").index(t[2])))

    def finish(self) -> list[tuple]:
        if self.done:
            raise ValueError("the stream is finished")
        self.done = True
        return self._close()


def episodes(planes: DataFrame, leaf: int = LEAF, least: int = LEAST_CHANGED) -> DataFrame:
    """Transitions of streams of planes (stream_no, ts_ms, width, luma: array of int, row by row)."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        state, out, ts = Episodes(leaf, least), [], None
        for r in rows.sort_values("ts_ms").itertuples():
            if ts == r.ts_ms:
                raise ValueError("two planes at one time")
            ts = int(r.ts_ms)
            out += [(ts, t) for t in state.observe(np.asarray(r.luma, np.int64).reshape(-1, int(r.width)))]
        out += [(ts, t) for t in state.finish()]
        return pd.DataFrame([(int(key[0]), at, kind, i, x, y, w, h, n) for at, ((y, x, h, w, n), i, kind) in out], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return planes.groupBy("stream_no").applyInPandas(run, SCHEMA)


def episode_metrics(planes: DataFrame, leaf: int = LEAF, least: int = LEAST_CHANGED) -> DataFrame:
    """A row a stream: COUNTS of its planes, and the episodes open at its end (which finishing closes, and counts as closures)."""
    names = ["stream_no", *COUNTS, "open_at_end"]

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        state = Episodes(leaf, least)
        for r in rows.sort_values("ts_ms").itertuples():
            state.observe(np.asarray(r.luma, np.int64).reshape(-1, int(r.width)))
        left = len(state.open)
        state.finish()
        return pd.DataFrame([(int(key[0]), *state.counts.values(), left)], columns=names)

    return planes.groupBy("stream_no").applyInPandas(run, ", ".join(f"{n} long" for n in names))
