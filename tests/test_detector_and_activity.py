"""Detector shapes, contours, activity, manifests and the Matroska reader, against values worked out by hand or one by one."""

import itertools
import math
import random
import struct
from fractions import Fraction

import numpy as np
import pytest
from framelake.functions import detector as D
from framelake.functions import recognition
from framelake.operators import activity, contours, detection, manifests, quality, regions
from framelake.plans import compact
from framelake.sources import files, outputs
from framelake.sources.tables import observations
from framelake.streaming import tracker
from pyspark.sql import functions as F


def test_shapes(spark):
    rows = spark.createDataFrame([(1080, 1920), (1920, 1080), (736, 736), (10, 4000), (1, 1)], "h long, w long")
    h, w = F.col("h"), F.col("w")
    got = rows.select(*(c.alias(n) for n, c in zip("abcd", (*D.nominal_shape(h, w), *D.input_shape(h, w)))), D.regional_extent(F.lit(540).cast("long"), h, w).alias("r")).collect()
    # 1920 * 736 / 1080 = 1308.4: 40.9 strides, so 41; 540 of 1080 lines are 368 of 736, up to 384
    assert tuple(got[0]) == (736, 1312, 736, 1312, 384) and tuple(got[1])[:4] == (1312, 736, 1312, 736)
    assert tuple(got[2])[:4] == (736, 736, 736, 736)
    assert (got[3]["a"], got[3]["b"], got[3]["c"], got[3]["d"]) == (736, 294400, 32, 4000)  # the cap: 294,400 becomes 4,000 and 736 ten
    one = spark.range(1).select(D.line_width(F.lit(101), F.lit(50)), D.batch_width(F.lit(97)), D.batch_width(F.lit(97), True), D.batch_width(F.lit(3201)), D.batch_width(F.lit(3200)))
    assert tuple(one.first()) == (97, 320, 104, None, 3200)


def test_quads(spark):
    q = spark.createDataFrame([([(4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (0.0, 0.0)],), ([(0.0, 0.0), (float("nan"), 1.0), (1.0, 1.0), (1.0, 0.0)],), (None,)], "p array<struct<x:double,y:double>>")
    got = q.select(D.area_perimeter(F.col("p")).alias("m"), D.ordered_quad(F.col("p")).alias("o"), D.quad_fits(F.col("p"), F.lit(4), F.lit(3)).alias("f")).collect()
    assert tuple(got[0]["m"]) == (12.0, 14.0) and [tuple(p) for p in got[0]["o"]] == [(0, 0), (4, 0), (4, 3), (0, 3)]
    assert [g["f"] for g in got] == [True, False, False]


def test_gates_and_verdicts(spark):
    rows = [(2.9, 1.0, 9.0), (3.0, 0.39, 9.0), (3.0, 0.4, 4.9), (3.0, 0.4, 5.0), (None, 1.0, 9.0), (3.0, float("nan"), 9.0)]
    c = spark.createDataFrame([("g", *r) for r in rows], "g string, first_side double, score double, second_side double")
    assert [r[0] for r in c.select(D.gate(F.col("first_side"), F.col("score"), F.col("second_side"))).collect()] == ["first_side", "score", "second_side", "admitted", "first_side", "score"]
    assert tuple(contours.gate_counts(c, ["g"]).first()) == ("g", 6, 4, 2, 1)
    v = [(15, 12, 900000, 12, None, None, None, None), (16, 12, 350000, 12, None, None, None, None), (40, 20, 350000, 12, 12, 2, 0, 250000), (40, 20, 350000, 8, 12, 1, 1, 0), (40, 20, 350000, 8, 12, 0, -2, None), (40, 20, 349999, 20, None, None, None, None), (40, 20, 350000, 11, None, None, None, None)]
    t = spark.createDataFrame(v, "e long, a long, s long, z long, m long, dx long, dy long, r long")
    assert [r[0] for r in t.select(D.motion_verdict(*map(F.col, ("e", "a", "s", "z", "m", "dx", "dy", "r")))).collect()] == [
        "insufficient_support", "stationary", "coherent_translation", "ambiguous_motion", "ambiguous_motion", "ambiguous_motion", "ambiguous_motion"]
    words = spark.range(1).select(D.clock(F.lit(59_500)), D.clock(F.lit(-9)), D.duration_label(F.lit(10)), D.duration_label(F.lit(61_499)), D.plural(F.lit(1), "event"), D.plural(F.lit(0), "box", "boxes"))
    assert tuple(words.first()) == ("1:00", "0:00", "1 seconds", "1:01", "1 event", "0 boxes")


def test_turning_points(spark):
    square = [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1)]
    rows = [(1, i, *p) for i, p in enumerate(square)] + [(2, 0, 5, 5)] + [(3, 0, 0, 0), (3, 1, 3, 0)]
    got = contours.turning_points(spark.createDataFrame(rows, "c long, i long, x long, y long"), ["c"], "i").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0), (1, 2, 2, 0), (1, 4, 2, 2), (1, 6, 0, 2), (2, 0, 5, 5), (3, 0, 0, 0), (3, 1, 3, 0)]
    assert contours.turning_points(spark.createDataFrame([], "c long, i long, x long, y long"), ["c"], "i").count() == 0


def one_by_one(regions, elements, moving):
    """The policy with its latch, boundary after boundary."""
    out, latched = [], {}
    for s, b in sorted({r[:2] for r in regions} | {e[:2] for e in elements} | set(moving)):
        inside = lambda r: [e[2] for e in elements if e[:2] == (s, b) and e[3] <= r[3] + r[5] // 2 < e[3] + e[5] and e[4] <= r[4] + r[6] // 2 < e[4] + e[6]]
        here = [r for r in regions if r[:2] == (s, b)]
        held, gone_to = latched.setdefault(s, [set(), -1])
        held = held & {e for r in here for e in inside(r)} if gone_to == b - 1 else set()
        new = set()
        for r in sorted(r for r in here if r[7]):
            found = inside(r)
            only = found[0] if len(found) == 1 else None
            if (s, b) in moving:
                what = "suppressed_by_translation"
            elif only is None:
                what = "ambiguous" if found else "unassociated"
            else:
                what = "latched" if only in held else "duplicate" if only in new else "event"
                new |= {only}
            out.append((s, b, r[2], only, what))
        latched[s] = [held | new, b]
    return sorted(out, key=str)


def test_activity_policy(spark):
    rnd = random.Random(5)
    elements = [(s, b, e, 40 * e, 0, 50, 60) for s in (1, 2) for b in range(30) for e in range(4)]
    regions = [(s, b, i, rnd.randrange(170), rnd.randrange(70), 10, 10, rnd.random() < 0.6) for s in (1, 2) for b in range(1, 30) for i in range(rnd.choice((0, 1, 3, 5)))]
    moving = [(1, 7), (1, 8), (2, 20)]
    r = spark.createDataFrame(regions, "stream_no long, boundary long, region_no long, x long, y long, w long, h long, started boolean")
    e = spark.createDataFrame(elements, "stream_no long, boundary long, element_no long, x long, y long, w long, h long")
    m = spark.createDataFrame([(*k, -3, 2) for k in moving], "stream_no long, boundary long, dx long, dy long")
    out = activity.onset_outcomes(r, e, m)
    got = [tuple(x) for x in out.collect()]
    assert sorted(got, key=str) == one_by_one(regions, elements, moving)
    assert {x[4] for x in got} == {"event", "latched", "duplicate", "ambiguous", "unassociated", "suppressed_by_translation"}
    events = activity.activities(out, m).where("stream_no = 1 AND boundary = 7").collect()
    assert [(x["kind"], x["dx"], x["dy"], x["ordinal"]) for x in events] == [("region_translated", -12, 8, 0)]
    assert activity.onset_outcomes(r.limit(0), e, m).count() == 0 and activity.onset_outcomes(r, e.limit(0), m.limit(0)).where("outcome <> 'unassociated'").count() == 0


def test_awaiting_refresh(spark):
    look = "stream_no long, element_no long, x long, y long, w long, h long, txt string, role string"
    live = spark.createDataFrame([(1, 1, 0, 0, 9, 9, "a", None), (1, 2, 0, 0, 9, 9, "b", None), (1, 3, 0, 0, 9, 9, None, None), (1, 4, 0, 0, 9, 9, "d", None)], look)
    seen = spark.createDataFrame([(110, 1, 1, 0, 0, 9, 9, "a", None), (110, 1, 1, 0, 0, 9, 9, "a", None), (110, 1, 2, 1, 0, 9, 9, "b", None), (110, 1, 3, 0, 0, 9, 9, None, None), (100, 1, 4, 0, 0, 9, 9, "d", None)], "ts_ms long, " + look)
    got = activity.awaiting_refresh(live, seen, spark.createDataFrame([(1, 100), (1, 200)], "stream_no long, ts_ms long"), 150).collect()
    assert {r["element_no"]: r["awaiting_refresh"] for r in got} == {1: True, 2: False, 3: False, 4: False} and len(got) == 4


def test_manifests(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "sub" / "b.bin").write_bytes(b"x")
    found = manifests.folder(spark, str(tmp_path))
    digests = {r["path"]: (r["bytes"], r["digest"]) for r in found.collect()}
    assert set(digests) == {"a.bin", "sub/b.bin"} and digests["a.bin"] == (3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")
    told = spark.createDataFrame([("a.bin", 3, "0" * 64), ("sub/b.bin", *digests["sub/b.bin"]), ("c", 1, "")], "path string, bytes long, digest string")
    assert {tuple(r) for r in manifests.differences(told, found, "path").collect()} == {("a.bin", "wrong_digest"), ("c", "missing")}
    rows = [(0, "m", "x/a", 1, "0" * 64), (1, "d", "../a", 1, "0" * 64), (2, "x", "b", 1, "0" * 64), (3, "e", "c", 0, "0" * 64), (4, "f", "d", 1, "0" * 63 + "A"), (5, "g", "x/a", 1, None)]
    bad = manifests.malformed(spark.createDataFrame(rows, "position long, role string, path string, bytes long, digest string"), list("mdtefg"))
    assert {tuple(r) for r in bad.collect()} == {(0, "repeated_path"), (1, "path"), (2, "role"), (3, "bytes"), (4, "digest"), (5, "repeated_path")}


def box(number: int, payload: bytes, unknown: bool = False) -> bytes:
    n = (number.bit_length() + 7) // 8
    return number.to_bytes(n, "big") + (b"\x01" + b"\xff" * 7 if unknown else (len(payload) | 1 << 56).to_bytes(8, "big")) + payload


def movie(codec=b"V_AV1", tracks=1, delay=0, unknown=False, encoded=False) -> bytes:
    video = box(files.VIDEO, box(files.WIDTH, b"\x02\x80") + box(files.HEIGHT, b"\x01\xe0"))
    track = box(files.NUMBER, b"\x01") + box(files.KIND, b"\x01") + box(files.CODEC, codec) + box(files.DELAY, bytes([delay])) + video
    track += box(files.ENCODINGS, box(files.ENCODING, b"")) if encoded else b""
    block = lambda t, flags, data: b"\x81" + struct.pack(">hB", t, flags) + data
    one = box(files.TIME, b"\x64") + box(files.SIMPLE_BLOCK, block(0, 0x80, b"key")) + box(files.SIMPLE_BLOCK, b"\x82" + block(0, 0, b"other track")[1:])
    two = box(files.TIME, b"\x03\xe8") + box(files.BLOCK_GROUP, box(files.BLOCK, block(-5, 0x08, b"hidden")) + box(files.REFERENCE, b"\x01"))
    laced = [block(1, 2, b"\x02\x01\x02" + b"abbccc"), block(2, 4, b"\x01" + b"aabb"), block(3, 6, b"\x02\x81" + b"\xc0" + b"abbccc")]
    two += b"".join(box(files.SIMPLE_BLOCK, x) for x in laced)
    body = box(files.INFO, box(files.SCALE, b"\x0f\x42\x40")) + box(files.TRACKS, box(files.TRACK, track) * tracks) + box(files.CLUSTER, one, unknown) + box(files.CLUSTER, two, unknown)
    return box(files.EBML_HEADER, b"") + box(files.SEGMENT, body, unknown)


def test_matroska(spark, tmp_path):
    for unknown in (False, True):
        got = list(files.parse_matroska(movie(unknown=unknown)))
        assert got[0] == (640, 480, 1_000_000, 0, 100, True, False, b"key") and got[1][3:] == (1, 995, False, True, b"hidden")
        assert [(g[4], g[7]) for g in got[2:]] == [(1001, b"a"), (1001, b"bb"), (1001, b"ccc"), (1002, b"aa"), (1002, b"bb"), (1003, b"a"), (1003, b"bb"), (1003, b"ccc")]
    for bad in (movie(codec=b"V_VP9"), movie(tracks=2), movie(tracks=0), movie(delay=1), movie(encoded=True), movie()[:-2], b"RIFF" + b"\x81\x00" * 9):
        with pytest.raises(ValueError):
            list(files.parse_matroska(bad))
    (tmp_path / "a.mkv").write_bytes(movie())
    packets = files.matroska_packets(spark, str(tmp_path / "a.mkv"))
    assert files.seek(packets, 1000).count() == 8 and packets.count() == 10

    class Late:
        """Gives a packet's size one packet later, as decoders do."""

        def __init__(self):
            self.kept = []

        def packet(self, data, ts):
            out, self.kept = self.kept, [(ts, len(data))]
            return out

        def drain(self):
            return self.kept

    frames = files.decoded(packets, Late, "path string, ts_ms long, size long").orderBy("ts_ms", "size").collect()
    assert len(frames) == 10 and (frames[0]["ts_ms"], frames[0]["size"]) == (100, 3) and frames[-1]["size"] == 3


def slowest_merge(h, w, proposals):
    """Every pair looked at before each merge."""
    nh, nw = (736, ((w * 736 + h // 2) // h + 16) // 32 * 32) if h <= w else (((h * 736 + w // 2) // w + 16) // 32 * 32, 736)
    scale = max(Fraction(nh, h), Fraction(nw, w))
    pixels = lambda r: math.prod(math.ceil((r[k + 2] - r[k]) * scale / 32) * 32 for k in (0, 1))
    nodes, at = [], 0
    for n, r in enumerate(sorted(set(proposals))):
        nodes.append((n, r, list(range(at, at + proposals.count(r)))))
        at += proposals.count(r)
    n = len(nodes)
    while True:
        best = []
        for a, b in itertools.combinations(nodes, 2):
            r = (*map(min, a[1][:2], b[1][:2]), *map(max, a[1][2:], b[1][2:]))
            saved = pixels(a[1]) + pixels(b[1]) - pixels(r)
            if saved >= 0:
                best.append((-saved, r, sorted(a[2] + b[2]), a[0], b[0]))
        if not best:
            return sorted((*r, m, pixels(r)) for _, r, m in nodes)
        _, r, m, a, b = min(best)
        nodes = [x for x in nodes if x[0] not in (a, b)] + [(n, r, m)]
        n += 1


def test_merged_regions(spark):
    rnd = random.Random(3)
    sizes = [0, 1, 2, 12, 25, 25]
    frames = {}
    for f, n in enumerate(sizes):
        grid = [(x := rnd.randrange(30) * 10, y := rnd.randrange(20) * 10, x + rnd.choice((20, 60)), y + 20) for _ in range(n)]
        frames[f] = grid + grid[: n // 3]
    rows = spark.createDataFrame([(f, *map(int, r)) for f, rs in frames.items() for r in rs], "f long, left long, top long, right long, bottom long")
    for h, w in ((240, 400), (400, 380)):
        got = {}
        for r in regions.merged(rows, ["f"], h, w).orderBy("region_no").collect():
            got.setdefault(r["f"], []).append((r["left"], r["top"], r["right"], r["bottom"], list(r["members"]), r["pixels"]))
        assert got == {f: slowest_merge(h, w, rs) for f, rs in frames.items() if rs}
    with pytest.raises(Exception, match="leaves the frame"):
        regions.merged(rows, ["f"], 100, 400).collect()
    assert regions.merged(rows.limit(0), ["f"], 240, 400).count() == 0


def test_frame_problems(spark):
    schema = "stream_no long, n long, ts_ms long, fw long, fh long, obs_index long, x long, y long, w long, h long, txt string, role string, conf double"
    ok = (0, 0, 5, 5, "t", None, 0.5)
    rows = [(1, 0, 10, 9, 9, 0, *ok), (1, 1, 10, 9, 9, 0, *ok), (1, 2, 9, 9, 9, 0, *ok), (1, 3, 50, 9, 9, 0, 5, 0, 5, 5, "t", None, 0.5), (1, 3, 50, 9, 9, 1, *ok[:6], 2.0), (1, 4, 20, 9, 9, None, *[None] * 7), (1, 5, 15, 0, 9, 0, *ok)]
    rows += [(1, 6, 30, 9, 9, k, *ok) for k in range(3)] + [(1, 7, 31, 9, 9, 0, *ok[:6], float("nan")), (1, 8, 32, 9, 9, 0, *ok[:4], "x" * 99, None, 0.1), (1, 9, 19, 9, 9, 0, *ok[:6], None)]
    got = quality.frame_problems(spark.createDataFrame(rows, schema), "n", most=2, most_bytes=50).orderBy("n").collect()
    assert [tuple(r)[1:] for r in got] == [(2, "time_goes_back", None), (3, "box", 0), (5, "frame_size", None), (6, "too_many_elements", None), (7, "confidence", 0), (8, "too_many_bytes", None), (9, "time_goes_back", None)]


def test_ctc(spark):
    hot = lambda *ids: [[float(k == i) for k in range(4)] for i in ids]
    rows = [(hot(1, 1, 0, 1, 2, 2, 3),), (hot(0, 0),), ([],), (None,), ([[0.5, 0.5, 0.0, 0.5], [0.0, 0.7, 0.7, 0.0]],)]
    labels = recognition.dictionary(["a", "b"])
    got = spark.createDataFrame(rows, "s array<array<double>>").select(recognition.ctc_text(F.col("s"), labels)).collect()
    assert [r[0] for r in got] == ["aab ", "", "", None, "a"]
    for bad in ([[0.0, float("nan"), 0.0, 0.0]], [[0.0, 1.0]]):
        with pytest.raises(Exception, match="finite|classes"):
            spark.createDataFrame([(bad,)], "s array<array<double>>").select(recognition.ctc_text(F.col("s"), labels)).collect()
    for entries in (["a", "a"], ["a", ""], ["a", " "]):
        with pytest.raises(ValueError):
            recognition.dictionary(entries)
    with pytest.raises(ValueError):
        recognition.dictionary(["a"], sha256="0" * 64)


def test_write_run(spark, tmp_path):
    events = tracker.batch_events(observations(spark, "/root/testdata/sf0.001").where("stream_no < 5")).cache()
    lines = compact.state_text(events).cache()
    out = str(tmp_path / "run")
    outputs.write_run(events, lines, out)
    read = files.event_lines(spark, out + "/events")
    assert read.count() == events.count() and read.where("problem IS NOT NULL").count() == 0
    told = spark.read.json(out + "/metrics").first()
    assert (told["events"], told["streams"]) == (events.count(), events.select("stream_no").distinct().count())
    assert spark.read.text(out + "/state").where("value = 'screenevents-state'").count() == told["streams"]
    with pytest.raises(FileExistsError):
        outputs.write_run(events, lines, out)
    with pytest.raises(Exception):
        outputs.write_run(events, lines.select("stream_no"), out + "2")
    assert not (tmp_path / "run2").exists()


def test_components():
    rnd = np.random.default_rng(1)
    for share in (0.2, 0.4, 0.6):
        active = rnd.random((17, 23)) < share
        left, want = set(zip(*np.nonzero(active))), []
        for start in sorted(left):
            if start in left:
                todo, own = [start], set()
                left.discard(start)
                while todo:
                    y, x = todo.pop()
                    own.add((x, y))
                    near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                    left -= near
                    todo += near
                want.append(own)
        got = detection.components(active)
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert set(map(tuple, g.astype(int).tolist())) <= w and set(map(tuple, detection.hull(g).tolist())) == set(map(tuple, detection.hull(np.array(sorted(w))).tolist()))


def test_offsets_are_round():
    square = np.array([(10.9, 10.2), (50.0, 10.0), (50.7, 40.0), (10.0, 40.9)])
    for by in (0.6, 2.3, 7.5, 30.0):
        got = detection.grown(square, by)
        gap = lambda q: np.hypot(max(10 - q[0], 0, q[0] - 50), max(10 - q[1], 0, q[1] - 40))
        assert all(abs(gap(q) - by) < 0.75 for q in got) and (got == np.rint(got)).all() and (detection.grown(square[::-1], by).min(0) == got.min(0)).all()
        edge = [np.trunc(v + 0.5) for v in (50 + by, 40 + by)]
        assert got.max(0).tolist() == edge
    assert len(detection.grown(square, 30.0)) > len(detection.grown(square, 2.3)) >= 8
    with pytest.raises(ValueError):
        detection.grown(square * 1000, 1e7)


def test_detection(spark):
    turned = np.array([(0, 0), (8, 6), (5, 10), (-3, 4)], float)
    corners, a, b = detection.smallest_rectangle(turned)
    assert sorted((round(a, 9), round(b, 9))) == [5, 10] and {tuple(p) for p in np.rint(corners).tolist()} == {tuple(p) for p in turned.tolist()}
    page = np.zeros((40, 60), np.float32)
    page[5:10, 10:31] = 0.9  # 20 x 4 between pixel centres: grown by 80 * 1.4 / 48 = 2.33, to whole pixels 8..32 and 3..11
    page[20:22, 5:30] = 0.9  # too flat
    page[30:36, 40:50] = 0.3  # too faint
    blank, wrong = np.zeros((40, 60), np.float32), page + 1
    rows = lambda *ps: spark.createDataFrame([(i, 40, 60, 80, 120, p.ravel().tolist()) for i, p in enumerate(ps)], "k long, map_h int, map_w int, src_h int, src_w int, scores array<float>")
    got = detection.detect(rows(page, blank), "k").collect()
    assert [(r["k"], r["contour_no"], r["disposition"]) for r in got] == [(0, 2, "score"), (0, 1, "first_side"), (0, 0, "admitted")]
    assert abs(got[2]["score"] - 0.9) < 1e-6 and [tuple(p) for p in got[2]["quad"]] == [(16, 6), (64, 6), (64, 22), (16, 22)]
    with pytest.raises(Exception, match="from 0 to 1"):
        detection.detect(rows(wrong), "k").collect()
