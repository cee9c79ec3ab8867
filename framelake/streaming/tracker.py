"""Element tracking: observations to change events with stable ids, per stream.

The state of a stream is sequential, so a stream is one group; streams run in parallel, and everything that
doesn't need the state (adapters, filters, quantising) is done before. batch_events() folds whole streams,
stream_events() the same state machine over micro-batches.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights and thresholds of the match, and the bounds of what is kept.
W_IOU, W_TEXT, W_ROLE = 0.35, 0.60, 0.05
LEAST_SCORE, LEAST_ACTIVE_IOU, LEAST_INACTIVE_IOU = 0.30, 0.10, 0.50
MOST_ELEMENTS, MOST_INACTIVE, MOST_BYTES, MOST_CANDIDATES = 3000, 65_536, 64 << 20, 1_000_000
CHARGE, ID_CHARGE = 512, 32
#: What eviction digests begin with.
DOMAIN = b"framelake.lost-element\0"
BIN, LEAST_ANCHORS = 20, 3
EVENT_SCHEMA = "stream_no long, sequence long, ts_ms long, type string, element_no long, x long, y long, w long, h long, txt string, role string, conf float, from_x long, from_y long, from_w long, from_h long, fw long, fh long"


_OTHER = regex.compile(r"[^\p{Alphabetic}\p{N}]+")


def plain(s: str | None) -> str:
    """Lower case letter by letter, letters (with vowel signs) and numbers only, as functions.texts.normalize()."""
    return _OTHER.sub("", "".join(x.lower() for x in s or ""))


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of all rectangles of a (n, 4) with all of b (m, 4)."""
    a, b = a[:, None, :], b[None, :, :]
    w = np.minimum(a[..., 0] + a[..., 2], b[..., 0] + b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    h = np.minimum(a[..., 1] + a[..., 3], b[..., 1] + b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    both = np.maximum(w, 0) * np.maximum(h, 0)
    union = a[..., 2] * a[..., 3] + b[..., 2] * b[..., 3] - both
    return np.where(both > 0, both / np.maximum(union, 1), 0.0)


def _bin(v: int) -> int:
    return int((abs(v) + BIN // 2) // BIN) * (1 if v >= 0 else -1)


class Element:
    __slots__ = ("box", "conf", "key", "role", "role_key", "txt")

    def __init__(self, box, txt, role, conf):
        self.box, self.txt, self.role = box, txt, role
        self.conf = float(np.floor(np.float32(conf) * np.float32(10) + np.float32(0.5)) / np.float32(10))
        self.key, self.role_key = plain(txt), plain(role)

    def same_role(self, other) -> bool:
        return (self.role is None and other.role is None) or bool(self.role_key and self.role_key == other.role_key)

    def exact_key(self):
        return (self.key, None if self.role is None else self.role_key) if self.key and (self.role is None or self.role_key) else None

    def charge(self) -> int:
        """Bytes that an active element counts for: its texts in UTF-8 and a fixed part."""
        return CHARGE + ID_CHARGE + sum(len(x.encode()) for x in (self.txt, self.role) if x)

    def lost_charge(self) -> int:
        """Bytes that a lost element counts for: its key, held twice, and a fixed part."""
        return CHARGE + 2 * (len(self.key.encode()) + len(self.role_key.encode()))


WORK = ["candidate_pairs", "active_pairs", "key_lookups", "rectangle_scans", "lost_candidates", "largest_bucket", "candidates", "count_evictions", "byte_evictions"]
RETAINED = ["active", "inactive", "active_bytes", "inactive_bytes", "evictions"]


class Tracker:
    """frame() takes the next frame's elements and returns its events; a frame that is refused changes nothing.

    work: counts of the last frame (WORK); retained(): what is held (RETAINED). Lost elements are held by (text, role) key; over
    most_inactive of them, or most_bytes by charge(), those with the largest priority() go. They never expire.
    """

    def __init__(self, most_inactive: int = MOST_INACTIVE, most_bytes: int = MOST_BYTES, domain: bytes = DOMAIN):
        self.active: dict[int, Element] = {}
        self.inactive: dict[int, Element] = {}
        self.by_key: dict[tuple, set[int]] = {}
        self.next_id, self.sequence, self.time, self.size = 1, 0, None, None
        self.most_inactive, self.most_bytes, self.domain, self.charged, self.evictions = most_inactive, most_bytes, domain, 0, 0
        self.pushed, self.order = 0, []  # a heap of (negated priority, -id, ...); entries of elements that came back are passed over
        self.work = dict.fromkeys(WORK, 0)

    def check(self, ts: int, size: tuple[int, int], seen: list[Element]) -> None:
        if min(size) <= 0:
            raise ValueError("a frame must have a size")
        if self.time is not None and ts < self.time:
            raise ValueError("a frame is earlier than the one before")
        for e in seen:
            if not 0 <= e.conf <= 1:
                raise ValueError("a confidence is not in 0..1")
            x, y, w, h = e.box
            if w <= 0 or h <= 0 or x < 0 or y < 0 or x + w > size[0] or y + h > size[1]:
                raise ValueError("a box is not within its frame")
        if len(seen) > MOST_ELEMENTS:
            raise ValueError("too many elements")
        if sum(e.charge() for e in seen) > MOST_BYTES:
            raise ValueError("the elements hold too many bytes")

    def shift(self, ids: list[int], seen: list[Element]) -> tuple[int, int] | None:
        """The dominant movement of elements whose text is unique on both sides: strongest bin, upper medians."""

        def once(keys):
            n = Counter(keys)
            return {k: i for i, k in enumerate(keys) if k and n[k] == 1}

        old, new = once([self.active[i].key for i in ids]), once([e.key for e in seen])
        bins: dict[tuple, list] = {}
        for k, i in old.items():
            if k in new and self.active[ids[i]].same_role(seen[new[k]]):
                a, b = self.active[ids[i]].box, seen[new[k]].box
                d = [int((2 * b[n] + b[n + 2] - 2 * a[n] - a[n + 2]) / 2) for n in (0, 1)]
                bins.setdefault((_bin(d[0]), _bin(d[1])), []).append(d)
        strong = [(-len(v), k) for k, v in bins.items() if len(v) >= LEAST_ANCHORS]
        if not strong:
            return None
        moves = bins[min(strong)[1]]
        return tuple(sorted(m[n] for m in moves)[len(moves) // 2] for n in (0, 1))

    def assign(self, seen: list[Element]) -> dict[int, int]:
        """Index of an element seen -> id of the track it goes on with, active or lost."""
        ids, found = sorted(self.active), []
        work = self.work = dict.fromkeys(WORK, 0)
        if ids and seen:
            work["active_pairs"] = work["candidate_pairs"] = len(ids) * len(seen)
            mine = [self.active[i] for i in ids]
            old, new = np.array([e.box for e in mine]), np.array([e.box for e in seen])
            plain_iou, move = overlap(old, new), self.shift(ids, seen)
            moved = overlap(old + [*move, 0, 0], new) if move else plain_iou
            number: dict = {}
            of = lambda elements, field: np.array([number.setdefault(getattr(e, field), len(number)) if getattr(e, field) else -1 for e in elements])
            equal = lambda field: ((a := of(mine, field))[:, None] == (b := of(seen, field))[None, :]) & (a >= 0)[:, None] & (b >= 0)[None, :]
            text, role = equal("key"), equal("role_key")
            bare = lambda elements: np.array([e.role is None for e in elements])
            fits = role | bare(mine)[:, None] & bare(seen)[None, :]
            score = W_IOU * np.maximum(plain_iou, moved) + np.where(text, W_TEXT, 0.0) + np.where(role, W_ROLE, 0.0)
            over = plain_iou > LEAST_ACTIVE_IOU
            ok = (score >= LEAST_SCORE) & (over | ((moved > LEAST_ACTIVE_IOU) & text & fits))
            rows, cols = np.nonzero(ok)
            found = list(zip((-score[rows, cols]).tolist(), (~over[rows, cols]).tolist(), (ids[i] for i in rows.tolist()), cols.tolist()))
        for j, e in enumerate(seen):
            if (key := e.exact_key()) is None:
                continue
            work["key_lookups"] += 1
            bucket = self.by_key.get(key, ())
            work["largest_bucket"] = max(work["largest_bucket"], len(bucket))
            work["candidate_pairs"] += len(bucket)
            work["rectangle_scans"] += len({self.inactive[i].box for i in bucket})
            if bucket:
                lost = sorted(bucket)
                both = overlap(np.array([self.inactive[i].box for i in lost]), np.array([e.box]))[:, 0]
                near = [(-(W_IOU * float(o) + W_TEXT + (W_ROLE if e.role is not None else 0.0)), False, i, j) for i, o in zip(lost, both) if o >= LEAST_INACTIVE_IOU]
                work["lost_candidates"] += len(near)
                found += near
            if len(found) > MOST_CANDIDATES:
                break
        if len(found) > MOST_CANDIDATES:
            raise ValueError("too many candidates")
        work["candidates"] = len(found)
        taken: dict[int, int] = {}
        used: set[int] = set()
        for _, _, i, j in sorted(found):
            if i not in used and j not in taken:
                used.add(i)
                taken[j] = i
        return taken

    def _lose(self, i: int, e: Element) -> None:
        if (key := e.exact_key()) is not None:
            self.inactive[i] = e
            self.by_key.setdefault(key, set()).add(i)
            self.charged += e.lost_charge()
            self.pushed += 1  # tells entries of one element apart
            heapq.heappush(self.order, (bytes(255 - x for x in priority(e, i, self.domain)), -i, self.pushed, e))

    def _found(self, i: int) -> None:
        e = self.inactive.pop(i)
        self.charged -= e.lost_charge()
        bucket = self.by_key[e.exact_key()]
        bucket.discard(i)
        if not bucket:
            del self.by_key[e.exact_key()]

    def _evict(self) -> None:
        while (many := len(self.inactive) > self.most_inactive) | (big := self.charged > self.most_bytes):
            _, i, _, e = heapq.heappop(self.order)
            if self.inactive.get(-i) is e:
                self._found(-i)
                self.evictions += 1
                self.work["count_evictions"] += many
                self.work["byte_evictions"] += big
        if len(self.order) > 2 * len(self.inactive) + 64:
            self.order = [x for x in self.order if self.inactive.get(-x[1]) is x[3]]
            heapq.heapify(self.order)

    def retained(self) -> dict:
        return dict(zip(RETAINED, (len(self.active), len(self.inactive), sum(e.charge() for e in self.active.values()), self.charged, self.evictions)))

    def activity(self, from_ms: int, ts: int, elements: list[int], moved: list[tuple] = ()) -> list[tuple]:
        """Sequences activity of an interval against the elements there are, which it doesn't change: (sequence, ts, from_ms, kind, element or None, moved or None).

        elements: numbers of elements with a region that changed, each counted once, by number; moved: translations (box, dx, dy), one at most, which come first.
        """
        if self.size is None:
            raise ValueError("activity before the first frame")
        if from_ms >= ts:
            raise ValueError("an interval must have a length")
        if self.time is not None and ts < self.time:
            raise ValueError("activity is earlier than what came before")
        if len(moved) > 1:
            raise ValueError("an interval has one translation at most")
        for i in elements:
            if i not in self.active:
                raise ValueError(f"no element {i}")
        for (x, y, w, h), dx, dy in moved:
            if w <= 0 or h <= 0 or x < 0 or y < 0 or x + w > self.size[0] or y + h > self.size[1]:
                raise ValueError("a box is not within its frame")
            if not dx and not dy:
                raise ValueError("a translation must move")
        self.time = ts
        kinds = [("region_translated", None, m) for m in moved] + [("element_region_changed", i, None) for i in sorted(set(elements))]
        out = [(self.sequence + k, ts, from_ms, *kind) for k, kind in enumerate(kinds)]
        self.sequence += len(out)
        return out

    def frame(self, ts: int, size: tuple[int, int], seen: list[Element]) -> list[tuple]:
        self.check(ts, size, seen)
        out = []
        if self.size is None:
            self.work = dict.fromkeys(WORK, 0)
            for e in seen:
                self.active[self.next_id] = e
                out.append(("snapshot", self.next_id, e, None))
                self.next_id += 1
            if not seen:
                out.append(("snapshot", None, None, None))
        else:
            taken = self.assign(seen)
            if size != self.size:
                out.append(("resized", None, Element((0, 0, *size), None, None, 0), (0, 0, *self.size)))
            gone = {i: self.active[i] for i in sorted(set(self.active) - set(taken.values()))}
            out += [("disappeared", i, e, None) for i, e in gone.items()]
            now = {}
            for j, e in enumerate(seen):
                i = taken.get(j)
                if i in self.active:
                    was = self.active[i]
                    if was.box != e.box:
                        out.append(("moved", i, e, was.box))
                    if (was.txt, was.role, was.conf) != (e.txt, e.role, e.conf):
                        out.append(("content_changed", i, e, None))
                else:
                    if i is None:
                        i, self.next_id = self.next_id, self.next_id + 1
                    else:
                        self._found(i)
                    out.append(("appeared", i, e, None))
                now[i] = e
            self.active = now
            for i, e in gone.items():
                self._lose(i, e)
            self._evict()
        self.time, self.size = ts, size
        rows = []
        for kind, i, e, was in out:
            frame = size if kind in ("snapshot", "resized") else (None, None)
            rows.append((self.sequence, ts, kind, i, *(e.box if e else (None,) * 4), e.txt if e else None, e.role if e else None, e.conf if e and i else None, *(was or (None,) * 4), *frame))
            # the elements of a snapshot are one event
            self.sequence += kind != "snapshot"
        self.sequence += any(k == "snapshot" for k, *_ in out)
        return rows


def priority(e: Element, i: int, domain: bytes = DOMAIN) -> bytes:
    """SHA-256 by which lost elements are given up, the largest first, once there are too many: domain, text and role with their lengths, box, id.

    Lengths and id are 64-bit, the box's parts 32-bit, little-endian; a role has a 1 before it, none is a 0. domain tells uses apart.
    """
    out = hashlib.sha256(domain + struct.pack("<Q", len(e.key.encode())) + e.key.encode())
    role = e.role_key.encode()
    out.update(b"\0" if e.role is None else b"\1" + struct.pack("<Q", len(role)) + role)
    out.update(struct.pack("<4IQ", *e.box, i))
    return out.digest()


def _frames(rows: pd.DataFrame):
    for ts, f in rows.sort_values(["ts_ms", "obs_index"], kind="stable").groupby("ts_ms", sort=True):
        seen = [Element((int(x), int(y), int(w), int(h)), t, r, c) for x, y, w, h, t, r, c in zip(f.x, f.y, f.w, f.h, f.txt, f.role, f.conf)]
        yield int(ts), (int(f.fw.iloc[0]), int(f.fh.iloc[0])), seen


def _as_frame(stream: int, rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in EVENT_SCHEMA.split(", ")]
    out = pd.DataFrame([(stream, *r) for r in rows], columns=names)
    for c in ("element_no", "x", "y", "w", "h", "from_x", "from_y", "from_w", "from_h", "fw", "fh"):
        out[c] = out[c].astype("Int64")
    return out


def batch_events(obs: DataFrame) -> DataFrame:
    """Change events of whole streams (columns of EVENT_SCHEMA)."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        tracker, out = Tracker(), []
        for ts, size, seen in _frames(rows):
            out += tracker.frame(ts, size, seen)
        return _as_frame(int(key[0]), out)

    return obs.groupBy("stream_no").applyInPandas(run, EVENT_SCHEMA)


PROFILE_SCHEMA = "stream_no long, ts_ms long, elements long, events long, " + ", ".join(f"{x} long" for x in [*WORK, *RETAINED])


def batch_profile(obs: DataFrame) -> DataFrame:
    """A row a frame: elements, events, the work that linking them took (WORK) and what is held after it (RETAINED)."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        tracker, out = Tracker(), []
        for ts, size, seen in _frames(rows):
            events = tracker.frame(ts, size, seen)
            out.append((int(key[0]), ts, len(seen), len({r[0] for r in events}), *tracker.work.values(), *tracker.retained().values()))
        return pd.DataFrame(out, columns=[x.split()[0] for x in PROFILE_SCHEMA.split(", ")])

    return obs.groupBy("stream_no").applyInPandas(run, PROFILE_SCHEMA)


def run_profile(profile: DataFrame) -> DataFrame:
    """Per stream: frames, sums of the work (largest values for the largest bucket and buffer), high water of what is held, and what is held at the end."""
    most, last = ("largest_bucket", "candidates"), lambda c: F.max_by(c, "ts_ms").alias(f"last_{c}")
    return profile.groupBy("stream_no").agg(
        F.count(F.lit(1)).alias("frames"), *(F.sum(c).alias(c) for c in ("elements", "events", *WORK) if c not in most), *(F.max(c).alias(c) for c in most),
        *(F.max(c).alias(f"most_{c}") for c in RETAINED), *(last(c) for c in RETAINED),
    )


def stream_events(obs: DataFrame, checkpointed: str = "state binary") -> DataFrame:
    """The same over a streaming frame. A micro-batch holds whole frames of a stream; a frame earlier than the last
    handled is left out (the batch form refuses it)."""
    import pickle

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tracker = pickle.loads(state.get[0]) if state.exists else Tracker()
        rows, out = pd.concat(list(frames)), []
        for ts, size, seen in _frames(rows):
            if tracker.time is None or ts >= tracker.time:
                out += tracker.frame(ts, size, seen)
        state.update((pickle.dumps(tracker),))
        yield _as_frame(int(key[0]), out)

    return obs.groupBy("stream_no").applyInPandasWithState(run, EVENT_SCHEMA, checkpointed, "append", "NoTimeout")
