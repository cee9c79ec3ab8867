"""One sequence and its views, motion, model stages and what is around them, against values worked out by hand or one by one."""

import hashlib
import random
import struct

import numpy as np
import pandas as pd
import pytest
from framelake.functions import geometry as G
from framelake.functions import texts as T
from framelake.operators import activity, detection, frames, manifests, models, motion, planes, scan, series
from framelake.plans import catalog_more, compact, log
from framelake.sources import files, outputs
from framelake.streaming import tracker
from framelake.streaming.episodes import Episodes
from pyspark.sql import functions as F

NAMES = ["stream_no", "sequence", "ts_ms", "type", "element_no", "x", "y", "w", "h", "txt", "role", "conf", "from_x", "from_y", "from_w", "from_h", "fw", "fh", "from_ms", "kind", "dx", "dy"]


def a_log(spark, *rows):
    kinds = {**log.COLUMNS, "sequence": "bigint"}
    return spark.createDataFrame([tuple(({"stream_no": 1} | r).get(n) for n in NAMES) for r in rows], ", ".join(f"{n} {kinds[n]}" for n in NAMES))


def box(x, y=10, w=100, h=30):
    return {"x": x, "y": y, "w": w, "h": h}


def began(x, y=10, w=100, h=30):
    return {"from_x": x, "from_y": y, "from_w": w, "from_h": h}


SNAP = {"sequence": 0, "ts_ms": 0, "type": "snapshot", "element_no": 1, "txt": "Save", "conf": 0.9, "fw": 800, "fh": 600, **box(10)}


def test_activity_comes_before_the_frame_of_its_time(spark):
    structural = a_log(spark, SNAP, {"sequence": 1, "ts_ms": 1000, "type": "moved", "element_no": 1, **box(50), **began(10)})
    acts = spark.createDataFrame([(1, 1000, 800, "element_region_changed", 1), (1, 1000, 800, "element_region_changed", 1), (1, 1000, 800, "region_translated", None), (1, 200, 0, "element_region_changed", 1)], "stream_no long, ts_ms long, from_ms long, kind string, element_no long")
    merged = log.with_activity(structural, log.activity_kinds(acts))
    got = [(r["sequence"], r["type"], r["kind"]) for r in merged.orderBy("sequence").collect()]
    assert got == [(0, "snapshot", None), (1, "activity", "element_region_changed"), (2, "activity", "region_translated"), (3, "activity", "element_region_changed"), (4, "moved", None)]
    assert {r["sequence"]: r["x"] for r in log.subjects(merged).where("kind = 'element_region_changed'").collect()} == {1: 10, 3: 10}


def test_every_class_of_error(spark):
    act = lambda n, **k: {"sequence": n, "ts_ms": 100, "type": "activity", "from_ms": 50} | k
    rows = [
        SNAP | {"sequence": 1}, SNAP | {"sequence": 1, "element_no": 2, **box(790)}, {"sequence": 0, "ts_ms": 0, "type": "disappeared", "element_no": 1},
        {"sequence": 2, "ts_ms": 100, "type": "appeared", "element_no": 1, "conf": 0.5, **box(10)}, {"sequence": 3, "ts_ms": 100, "type": "moved", "element_no": 9, **box(10), **began(10)},
        act(4, kind="element_region_changed", element_no=1, from_ms=100), act(5, kind="element_region_changed", element_no=7), act(6, kind="region_translated", dx=1, dy=0, **box(790)), act(7, kind="region_translated", dx=0, dy=0, **box(0)),
        act(8, kind="element_region_changed", element_no=1), {"sequence": 9, "ts_ms": 100, "type": "moved", "element_no": 1, **box(20), **began(11)}, {"sequence": 10, "ts_ms": 50, "type": "moved", "element_no": 1, **box(30), **began(20)},
        {"sequence": 11, "ts_ms": 100, "type": "resized", "fw": 400, "fh": 300, "from_w": 801, "from_h": 600}, {"sequence": 12, "ts_ms": 100, "type": "appeared", "element_no": 3, "conf": 0.5, **box(301)},
        {"sequence": 13, "ts_ms": 100, "type": "appeared", "element_no": 0, "conf": 0.5, **box(1)}, {"sequence": 14, "ts_ms": 100, "type": "appeared", "element_no": 5, "conf": 1.5, **box(1)},
        {"sequence": 15, "ts_ms": 100, "type": "resized", "fw": 0, "fh": 300, "from_w": 400, "from_h": 300}, act(16, kind="other"), SNAP | {"sequence": 17, "ts_ms": 100}, SNAP | {"sequence": 17, "ts_ms": 100},
        {"sequence": 18, "ts_ms": 100, "type": "moved", "element_no": 2, **box(20), **began(20)}, {"sequence": 30, "ts_ms": 100, "type": "disappeared", "element_no": 1},
    ]
    frame = a_log(spark, *rows)
    plain = {r["sequence"]: r["problem"] for r in log.problems(frame).collect()}
    assert plain == {0: "missing_snapshot", 2: "duplicate_element", 3: "unknown_element", 4: "invalid_activity_interval", 5: "unknown_element", 6: "invalid_activity_box", 7: "zero_activity_translation", 18: "unknown_element"}
    strict = {(r["sequence"], r["element_no"]): r["problem"] for r in log.problems(frame, strict=True).collect()}
    assert strict == {
        (0, 1): "missing_snapshot", (1, 2): "box", (2, 1): "duplicate_element", (3, 9): "unknown_element", (4, 1): "invalid_activity_interval", (5, 7): "unknown_element", (6, None): "invalid_activity_box",
        (7, None): "zero_activity_translation", (9, 1): "moved_from_elsewhere", (10, 1): "time_goes_back", (11, None): "resized_from_elsewhere", (12, 3): "box", (13, 0): "element_number", (14, 5): "confidence",
        (15, None): "frame_size", (16, None): "unknown_kind", (17, 1): "duplicate_element", (18, 2): "unknown_element", (30, 1): "sequence_gap",
    }


def test_view_at_a_time(spark):
    rows = [
        SNAP, SNAP | {"element_no": 2, "txt": None, **box(300)}, {"sequence": 1, "ts_ms": 1000, "type": "moved", "element_no": 1, **box(50), **began(10)},
        {"sequence": 2, "ts_ms": 1400, "type": "activity", "kind": "element_region_changed", "element_no": 1, "from_ms": 1200}, {"sequence": 3, "ts_ms": 1500, "type": "activity", "kind": "element_region_changed", "element_no": 2, "from_ms": 900},
        {"sequence": 4, "ts_ms": 1600, "type": "activity", "kind": "region_translated", "from_ms": 1400, "dx": 4, "dy": 0, **box(0)}, {"sequence": 5, "ts_ms": 2000, "type": "disappeared", "element_no": 2},
        {"sequence": 6, "ts_ms": 2000, "type": "resized", "fw": 400, "fh": 300, "from_w": 800, "from_h": 600}, {"sequence": 7, "ts_ms": 3000, "type": "content_changed", "element_no": 1, "txt": "Saved", "conf": 0.5, **box(50)},
    ]
    see = lambda t: {k: sorted(map(tuple, v.collect()), key=str) for k, v in log.view_at(a_log(spark, *rows), t).items()}
    v = see(1700)
    assert v["frame"] == [(1, 800, 600)] and [(e[1], e[2], e[6]) for e in v["elements"]] == [(1, 50, "Save"), (2, 300, None)]
    assert [t[1:4] for t in v["trails"]] == [(1, 1000, 1)] and [c[1:5] for c in v["changes"]] == [(1, 1000, "moved", 1)]
    assert [(a[1], a[4]) for a in v["activities"]] == [(3, "element_region_changed"), (4, "region_translated")]  # that of 2 ended at 1,600
    assert v["stale"] == [(1, 1)] and v["samples"] == [(1, 1000, 2000, True)]  # 2 has no text
    v = see(2000)
    assert v["frame"] == [(1, 400, 300)] and [e[1] for e in v["elements"]] == [1] and v["stale"] == [] and v["samples"] == [(1, 2000, 3000, False)]
    assert [(c[3], c[5]) for c in v["changes"] if c[3] == "disappeared"] == [("disappeared", 300)]
    assert [e[6] for e in see(9000)["elements"]] == ["Saved"] and see(9000)["samples"] == [(1, 3000, None, False)]


def test_state_text_of_the_whole_sequence(spark):
    rows = [
        SNAP, {"sequence": 1, "ts_ms": 200, "type": "activity", "kind": "element_region_changed", "element_no": 1, "from_ms": 0}, {"sequence": 2, "ts_ms": 500, "type": "activity", "kind": "region_translated", "from_ms": 267, "dx": 4, "dy": -8, **box(0)},
        {"sequence": 3, "ts_ms": 500, "type": "activity", "kind": "element_region_changed", "element_no": 1, "from_ms": 267}, {"sequence": 4, "ts_ms": 1000, "type": "resized", "fw": 400, "fh": 300, "from_w": 800, "from_h": 600},
        SNAP | {"sequence": 5, "ts_ms": 2000, "fw": 400, "fh": 300},
    ]
    lines = [r["line"] for r in compact.state_text(a_log(spark, *rows)).orderBy("line_no").collect()]
    assert lines == [compact.HEADER, "@0", "S800,600", "=1 10,10 Save", "@200 !1", "@500", "^233 0 10 100 30 4 -8", "!233/1", "@1000", "R400,300", "@2000", "S400,300", "=1 10,10 Save"]


def test_discontinuities(spark):
    top = (1 << 63) - 1
    rows = [(1, 0, "a", 5), (1, 1, "a", 6), (1, 2, "b", 7), (1, 3, "a", 9), (2, 0, None, top), (2, 1, None, top), (3, 0, "x", 0)]
    got = log.discontinuities(spark.createDataFrame(rows, "g int, n int, source string, sequence long"), "g", "n").collect()
    assert sorted((r["g"], r["n"], r["problem"]) for r in got) == [(1, 2, "source"), (1, 3, "sequence"), (2, 1, "sequence_overflow")]


def test_tracker_sequences_activity_and_counts_work():
    e = lambda x, t="Save", r="text": tracker.Element((x, 10, 100, 30), t, r, 0.9)
    t = tracker.Tracker()
    with pytest.raises(ValueError, match="before the first"):
        t.activity(0, 1, [])
    t.frame(0, (800, 600), [e(10), e(300, "Other")])
    got = t.activity(100, 300, [2, 1, 2], [((0, 0, 10, 10), 4, 0)])
    assert [(r[0], r[3], r[4]) for r in got] == [(1, "region_translated", None), (2, "element_region_changed", 1), (3, "element_region_changed", 2)] and t.time == 300
    for bad in ((300, 300, [], ()), (0, 200, [], ()), (0, 400, [9], ()), (0, 400, [], [((0, 0, 900, 1), 1, 0)]), (0, 400, [], [((0, 0, 9, 1), 0, 0)]), (0, 400, [], [((0, 0, 9, 1), 1, 0)] * 2)):
        with pytest.raises(ValueError):
            t.activity(*bad)
    assert [r[0] for r in t.frame(400, (800, 600), [e(10)])] == [4]
    assert t.work["active_pairs"] == 2 and t.work["key_lookups"] == 1 and t.retained()["inactive"] == 1
    t.frame(500, (800, 600), [e(10), e(305, "Other")])
    assert t.work["lost_candidates"] == 1 and t.work["largest_bucket"] == 1 and t.retained()["inactive"] == 0 and sorted(t.active) == [1, 2]


def test_eviction_by_count_and_bytes_and_its_digest(spark):
    e = lambda i: tracker.Element((i, 10, 5, 5), f"item{i}", None if i % 2 else "text", 0.9)
    seen = [e(i) for i in range(40)]
    order = sorted(range(40), key=lambda i: (tracker.priority(seen[i], i + 1), i + 1))
    t = tracker.Tracker(most_inactive=10)
    t.frame(0, (800, 600), seen)
    t.frame(1, (800, 600), [])
    assert sorted(t.inactive) == sorted(i + 1 for i in order[:10]) and t.evictions == 30 == t.work["count_evictions"]
    t = tracker.Tracker(most_bytes=6000)
    t.frame(0, (800, 600), seen)
    t.frame(1, (800, 600), [])
    assert t.charged <= 6000 and t.work["byte_evictions"] == 40 - len(t.inactive) and sorted(t.inactive) == sorted(i + 1 for i in order[: len(t.inactive)])
    assert t.charged + max(x.lost_charge() for x in seen) > 6000
    for _ in range(3):  # lost and found again, the order forgets entries that came back
        t.frame(t.time + 1, (800, 600), seen)
        t.frame(t.time + 1, (800, 600), [])
    assert t.charged == sum(x.lost_charge() for x in t.inactive.values()) <= 6000
    rows = [(i, f"item{i}", None if i % 2 else "text") for i in range(40)]
    got = spark.createDataFrame(rows, "i long, t string, r string").select("i", T.lost_priority(F.col("t"), F.col("r"), F.col("i"), F.lit(10), F.lit(5), F.lit(5), F.col("i") + 1, tracker.DOMAIN).alias("p")).collect()
    assert all(r["p"] == tracker.priority(seen[r["i"]], r["i"] + 1).hex() for r in got)
    text = tracker.DOMAIN + struct.pack("<Q", 5) + b"item1" + b"\0" + struct.pack("<4IQ", 1, 10, 5, 5, 2)
    assert tracker.priority(seen[1], 2) == hashlib.sha256(text).digest()


def test_overlap_that_counts_comes_first_and_then_the_lower_id():
    """Equal scores: overlap over the bound before none, then ids, however much the boxes overlap beyond that."""
    t = tracker.Tracker()
    a = tracker.Element((0, 0, 100, 100), "x", None, 1)
    t.frame(0, (800, 600), [a, tracker.Element((0, 0, 100, 100), "x", None, 1)])
    (row,) = [r for r in t.frame(1, (800, 600), [tracker.Element((0, 0, 100, 100), "x", None, 1)]) if r[2] == "disappeared"]
    assert row[3] == 2


def slow_match(before, now, y, x):
    """The closest descriptor of a pixel in its window, looked for one by one, and how far the next one apart from it is."""
    field = planes.census_plane(now.astype(int))
    needle = planes.census_plane(before.astype(int))[y, x]
    h, w = now.shape
    places = [(int(needle ^ field[b, a]).bit_count(), b, a) for b in range(max(3, y - 24), min(h - 3, y + 25)) for a in range(max(3, x - 24), min(w - 3, x + 25))]
    best = min(places)
    return best, min((p[0] for p in places if abs(p[1] - best[1]) > 1 or abs(p[2] - best[2]) > 1), default=255) - best[0]


def test_motion_matches_one_by_one():
    rng = np.random.default_rng(4)
    before = rng.integers(0, 256, (70, 90)).astype(np.uint8)
    now = np.roll(before, (2, -5), (0, 1))
    now[rng.random(now.shape) < 0.03] = 7
    source = motion.anchors(before)
    v, seen = before.astype(int), set()
    for y, x in source.tolist():  # the best corner of its cell
        cell = ((y - 27) // 24, (x - 27) // 24)
        of = [(-min(abs(v[b, a + 1] - v[b, a - 1]), abs(v[b + 1, a] - v[b - 1, a])), b, a) for b in range(27 + 24 * cell[0], min(27 + 24 * cell[0] + 24, 43)) for a in range(27 + 24 * cell[1], min(27 + 24 * cell[1] + 24, 63))]
        assert min(of)[1:] == (y, x)
        seen.add(cell)
    assert len(seen) == len(source) == 2
    place, distance, margin = motion.ranked(planes.census_plane(before.astype(int))[source[:, 0], source[:, 1]], planes.census_plane(now.astype(int)), source)
    for (y, x), p, d, m in zip(source.tolist(), place.tolist(), distance, margin):
        best, gap = slow_match(before, now, y, x)
        assert best == (d, *p) and gap == m
    edge = np.array([[3, 3], [60, 86]])  # windows cut at the border
    place, distance, margin = motion.ranked(planes.census_plane(before.astype(int))[edge[:, 0], edge[:, 1]], planes.census_plane(now.astype(int)), edge)
    assert all(slow_match(before, now, y, x) == ((d, *p), m) for (y, x), p, d, m in zip(edge.tolist(), place.tolist(), distance, margin))


def test_motion_of_a_stream(spark):
    rng = np.random.default_rng(9)
    small = rng.integers(0, 256, (160, 200)).astype(np.uint8)
    plane = np.kron(small, np.ones((4, 4), np.uint8))[:638, :797]  # borders that aren't whole boxes
    moved = plane.copy()
    moved[300:] = np.roll(plane[300:], 24, 1)
    frames_ = [(0, plane), (100, plane), (250, plane), (500, moved), (740, plane), (800, plane[:400]), (2000, rng.integers(0, 256, (400, 797)).astype(np.uint8))]
    rows = [(s, t + s, p.shape[1], p.shape[0], bytearray(p.tobytes())) for s in (1, 2) for t, p in frames_]
    got = motion.observed(spark.createDataFrame(rows, "stream_no long, ts_ms long, width int, height int, luma binary").repartition(5)).orderBy("stream_no", "ts_ms").collect()
    for s in (1, 2):
        mine = [r for r in got if r["stream_no"] == s]
        assert [r["disposition"] for r in mine] == ["initialized", "skipped_interval", "stationary", "coherent_translation", "skipped_interval", "initialized", "ambiguous_motion" if mine[6]["accepted"] >= 12 else "insufficient_support"]
        assert [r["from_ms"] for r in mine] == [None, None, s, 250 + s, None, None, 800 + s] and [r["resized"] for r in mine] == [False] * 5 + [True, False]
        m = mine[3]
        assert (m["dx"], m["dy"], m["residual"]) == (6, 0, 0) and m["eligible"] == m["accepted"] + sum(m[c] for c in motion.REJECTIONS) and len(m["matches"]) == m["accepted"]
        assert m["y"] >= 300 and m["x"] + m["w"] <= 797 and m["y"] + m["h"] <= 638 and m["survival_ppm"] == m["accepted"] * 1_000_000 // m["eligible"]
    (first, _) = motion.motions(spark.createDataFrame(got, motion.observed(spark.createDataFrame(rows, "stream_no long, ts_ms long, width int, height int, luma binary")).schema)).orderBy("stream_no").collect()
    assert (first["dx"], first["dy"], first["from_ms"]) == (24, 0, 251)
    metrics = motion.run_metrics(spark.createDataFrame(got, motion.observed(spark.createDataFrame(rows, "stream_no long, ts_ms long, width int, height int, luma binary")).schema)).orderBy("stream_no").first()
    assert (metrics["frames"], metrics["resets"], metrics["initialized_frames"], metrics["skipped_interval_frames"], metrics["comparisons"], metrics["coherent_translation_frames"]) == (7, 1, 2, 2, 3, 1)
    with pytest.raises(Exception, match="must increase"):
        motion.schedule(spark.createDataFrame([(1, 5, 8, 8), (1, 5, 8, 8)], "stream_no long, ts_ms long, width int, height int")).collect()


def test_translation_and_quarter():
    dy, dx = np.array([0, 4, 5, 4, -3, -3, 1]), np.array([1, 0, 1, 1, 8, 9, -1])
    y, x, n, members = motion.translation(dy, dx)
    assert (y, x, n) == (4, 1, 3) and members.tolist() == [1, 2, 3]
    assert motion.translation(np.array([0, 1]), np.array([1, -1])) is None
    assert motion.translation(np.array([2, -2]), np.array([0, 0]))[:3] == (-2, 0, 1)  # equal support and size: the smaller cluster
    plane = np.arange(35, dtype=np.uint8).reshape(5, 7)
    assert motion.quarter(plane).tolist() == [[12, 15], [29, 33]]
    assert motion.residual(np.zeros((4, 4), np.uint8), np.full((4, 4), 200, np.uint8), 0, 5) == (0, 0)


def test_large_planes_and_long_streams(spark):
    """A 480 x 270 plane's descriptors and matches, and a stream of a million times."""
    rng = np.random.default_rng(2)
    plane = rng.integers(0, 256, (270, 480))
    y, x = np.mgrid[0:270, 0:480]
    rows = spark.createDataFrame(pd.DataFrame({"frame_id": 1, "x": x.ravel(), "y": y.ravel(), "luma": plane.ravel()}))
    described = planes.census(rows).toPandas()
    want = planes.census_plane(plane)
    assert len(described) == 480 * 270 and (want[described.y, described.x].view(np.int64) == described.descriptor).all()
    inner = spark.createDataFrame(described.rename(columns={"frame_id": "pair_id", "descriptor": "d"})).where("x between 3 and 476 and y between 3 and 266")
    found = planes.nearest(inner.where("x % 16 = 5 and y % 16 = 7"), inner, 24).toPandas()
    assert len(found) > 400 and (found.distance == 0).all() and ((found.ax == found.bx) & (found.ay == found.by)).mean() > 0.9  # others have an equal one before them
    times = spark.range(1_000_000).select(F.lit(1).cast("long").alias("stream_no"), (F.col("id") * 3).alias("t_ms"))
    taken = series.sampled_times(times, 1000).toPandas()
    assert taken.t_ms.diff().dropna()[:-1].eq(1002).all() and taken.t_ms.max() == 2_999_997 and taken.terminal.sum() == 1


def test_groups_in_order(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None, "é"]), rnd.randrange(5), i, rnd.random()) for i in range(5000)]
    frame = spark.createDataFrame(rows, "k string, n int, i long, v double").repartition(7)
    got = scan.each_group(frame, ["k", "n"], ["i"], ["i", "v"], lambda c: {"i": [c["i"][0]], "total": [float(sum(c["v"]))]} if len(c["i"]) > 1 else None, "k string, n int, i bigint, total double").collect()
    want = {}
    for k, n, i, v in rows:
        want.setdefault((k, n), []).append((i, v))
    assert {(r["k"], r["n"]): (r["i"], round(r["total"], 6)) for r in got} == {g: (min(x)[0], round(sum(v for _, v in x), 6)) for g, x in want.items()} and len(got) == len(want)
    assert scan.each_group(frame.where("false"), ["k"], ["i"], ["i"], lambda c: {"i": c["i"]}, "k string, i bigint").count() == 0


def test_likely_pairs_lose_none(spark):
    rnd = random.Random(1)
    rows = [(1, t, 2000, 2000, i, rnd.randrange(0, 1800), rnd.randrange(0, 1800), rnd.randrange(1, 200), rnd.randrange(1, 200), rnd.choice(["a", "b", "c", "!", None, "Áb"]), rnd.choice([None, "x"]), 0.5) for t in range(4) for i in range(60)]
    obs = spark.createDataFrame(rows, "stream_no long, ts_ms long, fw long, fh long, obs_index long, x long, y long, w long, h long, txt string, role string, conf double")
    key = ["stream_no", "frame_no", "p_obs_index", "n_obs_index"]
    every = frames.match_scores(frames.frame_pairs(obs), dx=30, dy=-20).where("eligible or iou > 0").select(*key, "score", "eligible")
    likely = frames.match_scores(frames.likely_pairs(obs), dx=30, dy=-20).where("eligible or iou > 0").select(*key, "score", "eligible")
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, likely.collect())) and every.count() > 50


def test_lost_elements_and_arrivals(spark):
    seen = spark.createDataFrame([(1, 5, 0, 0, 0, 10, 10, "Save", None), (1, 5, 1, 0, 0, 10, 10, "Save", "b"), (1, 5, 2, 50, 50, 10, 10, "new", None), (1, 5, 3, 0, 0, 10, 10, "--", None)], "s int, f int, obs_index long, x long, y long, w long, h long, txt string, role string")
    lost = spark.createDataFrame([(1, 5, 7, 0, 0, 10, 10, "save!", None), (1, 5, 8, 3, 0, 10, 10, "SAVE", "B"), (1, 5, 9, 8, 0, 10, 10, "save", None)], "s int, f int, element_no long, x long, y long, w long, h long, txt string, role string")
    got = frames.lost_matches(seen, lost, ["s", "f"]).collect()
    assert sorted((r["obs_index"], r["element_no"], round(r["overlap"], 4), round(r["score"], 4)) for r in got) == [(0, 7, 1.0, 0.95), (1, 8, round(7 / 13, 4), round(0.35 * 7 / 13 + 0.65, 4))]
    new = frames.arrivals(seen.select("s", "f", "obs_index"), seen.where("obs_index = 3"), frames.lost_matches(seen, lost, ["s", "f"]), ["s", "f"]).collect()
    assert sorted((r["obs_index"], r["element_no"]) for r in new if r["element_no"]) == [(0, 7), (1, 8)] and [r["obs_index"] for r in new if r["element_no"] is None] == [2]


def test_activity_counts_what_is_latched(spark):
    regions = spark.createDataFrame([(1, b, 0, 10, 10, 4, 4, b in (1, 5)) for b in (1, 2, 3, 5)] + [(1, 2, 1, 90, 90, 4, 4, True)], "stream_no long, boundary long, region_no long, x long, y long, w long, h long, started boolean")
    elements = spark.createDataFrame([(1, b, 7, 0, 0, 50, 50) for b in range(6)] + [(1, b, 8, 80, 80, 40, 40) for b in range(6)], "stream_no long, boundary long, element_no long, x long, y long, w long, h long")
    none = spark.createDataFrame([], "stream_no long, boundary long")
    outcomes = activity.onset_outcomes(regions, elements, none)
    held = {(r["boundary"], r["element_no"]) for r in activity.latched(regions, elements, outcomes).collect()}
    assert held == {(1, 7), (2, 7), (2, 8), (3, 7), (5, 7)}
    m = activity.activity_metrics(spark.range(6).select(F.lit(1).cast("long").alias("stream_no"), F.col("id").alias("boundary")), regions, elements, none).first()
    assert (m["boundaries"], m["regions"], m["onsets"], m["events"], m["most_latched"], m["translations"]) == (6, 5, 3, 3, 2, 0)


def test_polygons_as_drawn():
    for a, b in (((0, 0), (7, 3)), ((7, 3), (0, 0)), ((2, 9), (4, 0)), ((5, 1), (5, 6)), ((1, 1), (1, 1)), ((0, 6), (9, 0))):
        x, y = detection.line_pixels(a, b)
        long = max(abs(a[0] - b[0]), abs(a[1] - b[1]))
        assert len(x) == long + 1 and {(int(x[0]), int(y[0])), (int(x[-1]), int(y[-1]))} == {a, b}
        assert (abs(np.diff(x)) <= 1).all() and (abs(np.diff(y)) <= 1).all()
    square = detection.polygon_mask(6, 6, np.array([[1, 1], [4, 1], [4, 4], [1, 4]]))
    assert square.sum() == 16 and square[1:5, 1:5].all()
    kite = detection.polygon_mask(7, 7, np.array([[3, 0], [6, 3], [3, 6], [0, 3]]))
    assert [int(r.sum()) for r in kite] == [1, 3, 5, 7, 5, 3, 1]
    scores = np.arange(36, dtype=np.float32).reshape(6, 6) / 36
    assert detection.mean_inside(scores, np.array([[1.2, 1.9], [4.0, 1.0], [4.0, 4.0], [1.0, 4.0]])) > 0


def test_pages_are_read(spark):
    page = np.zeros((200, 300), np.uint8)
    page[40:70, 30:200] = 255
    page[120:150, 60:270] = 200
    rows = [(1, 300, 200, bytearray(page.tobytes())), (2, 300, 200, bytearray(bytes(300 * 200)))]
    pages = spark.createDataFrame(rows, "page_id long, width int, height int, luma binary")

    def detector(tensor):
        assert tensor.dtype == np.float32 and tensor.shape[:2] == (1, 3)
        return (tensor[:, :1] > 1).astype(np.float32) * np.float32(0.9)

    def recogniser(tensor):
        assert tensor.shape[2] == 48 and abs(tensor).max() <= 1
        steps = np.zeros((1, 6, 4), np.float32)
        steps[0, range(6), [1, 1, 0, 1, 2, 0]] = 1
        return steps

    got = models.read_pages(pages, "page_id", detector, recogniser, ["a", "b", " "]).orderBy("line_no").collect()
    assert [(r["page_id"], r["obs_index"], r["txt"], r["role"], r["disposition"], r["steps"]) for r in got] == [(1, k, "aab", "text", "emitted", 6) for k in range(2)]
    boxes = sorted((r["y"], r["x"], r["w"], r["h"]) for r in got)
    assert abs(boxes[0][0] - 40) < 20 and boxes[0][2] >= 165 and boxes[1][0] > 95 and all(abs(r["conf"] - 0.9) < 0.1 for r in got)
    p = models.profile(models.read_pages(pages, "page_id", detector, recogniser, ["a", "b", " "]), "page_id").first()
    assert (p["lines"], p["emitted"], p["calls"], p["steps"], p["capped"]) == (2, 2, 2, 12, 0) and p["input_pixels"] == sum(3 * 48 * r["input_width"] for r in got)
    for bad in (lambda t: t[:, :1] * 9, lambda t: t):
        with pytest.raises(Exception, match="another shape|from 0 to 1"):
            models.score_maps(pages, "page_id", bad).collect()
    with pytest.raises(Exception, match="number of pixels"):
        models.score_maps(pages.withColumn("width", F.lit(299)), "page_id", detector).collect()


def test_tensors_seams_and_lanes():
    page = np.tile(np.arange(40, dtype=np.uint8) * 6, (20, 1))
    t = models.page_tensor(page, (32, 64))
    assert t.shape == (1, 3, 32, 64) and t.dtype == np.float32
    one = (models.resized(page, (32, 64))[5, 9] * models.SCALE - models.MEAN[1]) / models.DEVIATION[1]
    assert t[0, 1, 5, 9] == one and np.allclose(models.resized(page, page.shape), page)
    s = models.checked_seam(models.seam(page, [(0, 0), (40, 0), (40, 20), (0, 20)]))
    assert s.shape == (64, 128) and abs(s[:, 0] - (0 / 255 - 0.5)).max() < 0.03 and (np.diff(s[10]) >= 0).all()
    tensor, cut = models.line_tensor(s)
    assert tensor.shape == (1, 3, 48, 320) and not cut and not tensor[:, :, :, 96:].any()
    assert models.line_tensor(np.zeros((64, 9000), np.float32))[1]
    for bad in (np.zeros((63, 5)), np.zeros((64, 0)), np.full((64, 4), 0.6), np.full((64, 4), np.nan)):
        with pytest.raises(ValueError):
            models.checked_seam(bad)
    assert models.lanes(5, 2) == [[0, 2, 4], [1, 3]]
    assert models.reconciled([[(0, "a"), (2, "c")], [(1, "b")]], 3) == ["a", "b", "c"]
    for bad, n in (([[(1, "b")], []], 2), ([[(0, "a"), (0, "a")], [(1, "b")]], 2), ([[(0, "a")], []], 2), ([[(4, "a")]], 2)):
        with pytest.raises(ValueError):
            models.reconciled(bad, n)
    with pytest.raises(ValueError):
        models.lanes(3, 5)


def test_bits_of_corners(spark):
    lines = spark.createDataFrame([(1, 0, [(1, 2), (3, 4), (5, 6), (7, 8)])], "page_id long, line_no long, quad array<struct<x:long,y:long>>")
    assert models.geometry_bits(lines, "page_id").first()["bits"] == [struct.unpack("<I", struct.pack("<f", v))[0] for v in range(1, 9)]


def test_bounded_numbers_and_cells(spark):
    top = (1 << 63) - 1
    v = spark.createDataFrame([(top, 1), (5, 7), (top, top), (0, 0)], "a long, b long")
    a, b = F.col("a"), F.col("b")
    got = v.select(G.saturating("+", a, b), G.saturating("-", a, b), G.saturating("*", a, b), G.checked("+", a, b), G.checked("-", a, b)).collect()
    assert [tuple(r) for r in got] == [(top, top - 1, top, None, top - 1), (12, 0, 35, 12, None), (top, 0, top, None, 0), (0, 0, 0, 0, 0)]
    cells = spark.createDataFrame([(42, 26), (1920 // 4 - 54, 270 - 54), (1920 - 54, 1080 - 54), (1, 1)], "w long, h long").select(G.corner_cell(F.col("w"), F.col("h"))).collect()

    def slow(w, h):
        c = 24
        while -(-w // c) * -(-h // c) > 1024:
            c += 1
        return c

    assert [c[0] for c in cells] == [slow(42, 26), slow(426, 216), slow(1866, 1026), 24]
    with pytest.raises(Exception, match="more than 2 things"):
        series.guarded(v.withColumn("g", F.lit(1)), ["g"], 2, "things").collect()
    z = lambda rows, c: spark.createDataFrame(rows, f"g int, i int, {c} string")
    assert series.zipped(z([(1, 0, "a")], "l"), z([(1, 0, "b")], "r"), ["g"], "i").first().asDict() == {"g": 1, "i": 0, "l": "a", "r": "b"}
    for right in ([(1, 1, "b")], [(1, 0, "b"), (1, 0, "c")]):
        with pytest.raises(Exception, match="a position is"):
            series.zipped(z([(1, 0, "a")], "l"), z(right, "r"), ["g"], "i").collect()


def test_decoding_goes_on_over_batches(spark):
    class Copies:
        """A decoder that shows each packet's bytes once the next packet is there, and the last at the end."""

        def __init__(self):
            self.held = None

        def packet(self, data, timestamp):
            out, self.held = ([self.held] if self.held else []), (timestamp, data)
            return out

        def drain(self):
            return [self.held]

    rows = [(s, n, n * 10, bytearray(f"{s}{n}".encode())) for s in ("a", "b", "c") for n in range(50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = files.decoded(spark.createDataFrame(rows, "path string, packet_no long, timestamp long, data binary").repartition(4), Copies, "path string, timestamp long, data binary").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["path"], r["timestamp"], bytes(r["data"])) for r in got) == sorted((s, t, bytes(d)) for s, _, t, d in rows)


def test_luma_planes():
    data = bytes(range(60))
    assert files.luma_plane(data, 2, 10, 4, 3) == bytes([2, 3, 4, 5, 12, 13, 14, 15, 22, 23, 24, 25])
    assert files.luma_plane(data, 22, -10, 4, 3) == bytes([22, 23, 24, 25, 12, 13, 14, 15, 2, 3, 4, 5]) and files.luma_plane(data, 56, 9, 4, 1) == bytes([56, 57, 58, 59])
    for bad in ((0, 3, 4, 3), (0, 10, 0, 3), (0, 10, 4, 7), (10, -10, 4, 3), (57, 10, 4, 1)):
        with pytest.raises(ValueError):
            files.luma_plane(data, *bad)
    with pytest.raises(ValueError, match="10 bits"):
        files.luma_plane(data, 0, 10, 4, 3, bits=10)


def test_lines_have_their_numbers(spark, tmp_path):
    for name, n in (("a.txt", 5000), ("b.txt", 3)):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = files.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5003 and all(r["value"] == f"{r['file'].rsplit('/', 1)[1]} line {r['line_no']}" for r in got)


def test_paths_must_be_distinct(spark, tmp_path):
    (tmp_path / "in").mkdir()
    at = lambda *names: [f"{tmp_path}/{n}" for n in names]
    assert len(outputs.distinct_paths(spark, at("in"), at("a", "ab", "c/d"))) == 3
    for new in (("a", "a"), ("a", "a/"), ("a", "a/b"), ("in/x",)):
        with pytest.raises(ValueError, match="distinct"):
            outputs.distinct_paths(spark, at("in"), at(*new))
    with pytest.raises(FileExistsError):
        outputs.distinct_paths(spark, [], at("in"))


def test_catalogues_and_demo_manifests(spark, tmp_path):
    import json

    entry = lambda s, **k: {"slug": s, "title": "T", "subtitle": "S", "manifest": f"{s}.manifest.json"} | k
    book = {"schema_version": "v1", "recordings": [entry("a-b"), entry("A"), entry("a-b"), entry("c", title=" "), entry("d", subtitle="x" * 141), entry("e", manifest="f"), entry("g", extra="1"), entry("h")]}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "good.json").write_text(json.dumps(book))
    (tmp_path / "c" / "bad.json").write_text(json.dumps({"schema_version": "v2", "recordings": []}))
    (tmp_path / "c" / "keys.json").write_text("{}")
    got = list((r["file"], r["position"], r["problem"]) for r in manifests.catalog_problems(spark, f"{tmp_path}/c", "v1").collect())
    assert sorted(g for g in got if g[1] is not None) == [("good.json", 1, "slug"), ("good.json", 2, "repeated_slug"), ("good.json", 3, "title"), ("good.json", 4, "subtitle"), ("good.json", 5, "manifest"), ("good.json", 6, "keys")]
    assert {(f, p) for f, k, p in got if k is None} == {("bad.json", "version"), ("keys.json", "keys")}
    file = lambda n: {"path": n, "bytes": 5, "sha256": "0" * 64}
    demo = {"schema_version": "m1", "presentation": {"width": 4, "height": 3, "duration_ms": 900, "media": file("a-b.mp4"), "note": "n"}, "output": {
        "stream_id": "s", "events": file("a-b.events.ndjson"), "state": file("a-b.screen.txt"), "event_count": 3, "event_family_counts": {"moved": 2}, "structural_sample_times_ms": [0, 5, 900], "first_event_ms": 0, "last_event_ms": 900}}
    (tmp_path / "m").mkdir()
    bad = {"": (), "version": ("schema_version", "m2"), "media": ("presentation.media.path", "x.mp4"), "events": ("output.events.sha256", "0"), "sample_times": ("output.structural_sample_times_ms", [5, 5]), "event_times": ("output.last_event_ms", 901),
           "presentation": ("presentation.width", 0), "presentation_keys": ("presentation.more", 1), "family_counts": ("output.event_family_counts", {"moved": -1}), "output": ("output.event_count", 0)}
    for problem, change in bad.items():
        value = json.loads(json.dumps(demo))
        if change:
            *path, last = change[0].split(".")
            inner = value
            for p in path:
                inner = inner[p]
            inner[last] = change[1]
        folder = tmp_path / "m" / (problem or "good")
        folder.mkdir()
        (folder / "a-b.manifest.json").write_text(json.dumps(value))
        found = manifests.demo_problems(spark, f"{folder}/a-b.manifest.json", "m1").collect()
        assert [r["problem"] for r in found] == ([problem] if problem else [])


def test_episode_counts():
    still, hot = np.zeros((32, 32), int), np.zeros((32, 32), int)
    hot[:16, :16] = 100
    e = Episodes()
    for plane in (still, hot, hot, still, np.zeros((16, 16), int)):
        e.observe(plane)
    assert e.counts == {"frames": 5, "comparisons": 3, "resizes": 1, "empty": 1, "changed_pixels": 512, "leaves": 2, "regions": 2, "charged_pixels": 512, "starts": 2, "continuations": 0, "closures": 2, "most_regions": 1, "most_open": 1}


def test_same_content(spark):
    rows = [("a", None, 0.31, {"k": "1"}, "a", None, 0.29, {"k": "1"}), ("a", None, 0.31, None, "a", "", 0.3, None), (None, "r", 0.5, {}, None, "r", 0.5, None), ("a", "r", 0.5, {"a": "1", "b": "2"}, "a", "r", 0.5, {"b": "2", "a": "1"})]
    frame = spark.createDataFrame(rows, "p_txt string, p_role string, p_conf double, p_state map<string,string>, n_txt string, n_role string, n_conf double, n_state map<string,string>")
    assert [tuple(r) for r in frame.select(T.same_content("p_", "n_"), T.same_content("p_", "n_", state=True)).collect()] == [(True, True), (False, False), (True, False), (True, True)]


def test_stand_in_models_read_the_sample(spark):
    d = "/root/testdata/sf0.01"
    read = catalog_more.pages_read(spark, d).collect()
    assert len(read) > 10 and {r["disposition"] for r in read} >= {"emitted"}
    found = catalog_more.motion_observed(spark, d).collect()
    assert {r["disposition"] for r in found} >= {"initialized", "skipped_interval", "stationary"}
