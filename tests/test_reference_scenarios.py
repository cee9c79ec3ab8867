"""Scenarios of FIXTURES.md, re-derived."""

import struct

import numpy as np
import pytest
from framelake.functions import geometry as G
from framelake.functions import texts as T
from framelake.operators import evaluation, series
from framelake.plans import catalog, compact, state
from framelake.sources import files
from framelake.sources.tables import observations
from framelake.streaming import tracker
from framelake.streaming.episodes import Episodes, regions
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
OBS = "stream_no long, ts_ms long, fw long, fh long, obs_index long, x long, y long, w long, h long, txt string, role string, conf double"


def obs(spark, *frames):
    rows = [(1, ts, 800, 600, i, *e) for ts, seen in frames for i, e in enumerate(seen)]
    return spark.createDataFrame(rows, OBS)


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_geometry_at_the_limits(spark):
    top = 4294967295
    r = spark.createDataFrame([(top, top, 1, 1, top, top)], "x long, y long, w long, h long, fw long, fh long").select("*", *(F.col(c).alias("b" + c) for c in "xywh"))
    got = r.select(G.fits().alias("fits"), G.iou("", "b").alias("iou")).first()
    assert (got["fits"], got["iou"]) == (False, 1.0)
    bins = spark.createDataFrame([(v,) for v in (-30, -10, -9, 9, 10, 30)], "v long").select(G.rounded_bin("v", 20)).collect()
    assert [b[0] for b in bins] == [-2, -1, 0, 0, 1, 2]
    assert [b[0] for b in spark.createDataFrame([(-3,), (-1,)], "v long").select(G.floor_half("v")).collect()] == [-2, -1]
    assert one(spark, a=G.log2_bin(F.lit(0)), b=G.log2_bin(F.lit(8))).asDict() == {"a": 0, "b": 3}


def test_texts(spark):
    got = one(spark, a=T.normalize(F.lit("ΟΔΟΣ")), b=T.normalize(F.lit("½ № 汉字 a-B!")), e=T.state_text(F.lit("")), c=T.state_text(F.lit('q"\\\x1f\n')), n=T.element_number(F.lit("e0000001")), m=T.element_number(F.lit("e1000000")), z=T.element_number(F.lit("e000000")), i=T.element_id(F.lit(1000000)), q=T.quantized(F.lit(0.25)))
    assert (got["a"], got["b"], got["e"], got["c"]) == ("οδοσ", "½汉字ab", "\\e", 'q\\"\\\\\\u001f\\n')
    assert (got["n"], got["m"], got["z"], got["i"]) == (None, 1_000_000, None, "e1000000") and abs(got["q"] - 0.3) < 1e-6


def test_texts_are_normalised_alike(spark):
    rows = ["कि ", "ΟΔΟΣ", "½ № 汉字", "a\u0301B", "İx", "ǅ", "٣-४", "ⅷ", "ⓐ", "ﬃ", "", None, "_ .!", "क्षि", "ไทยที่", "🙂 ok", "ß ẞ"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", T.normalize(F.col("t")).alias("n")).collect()
    assert {r["i"]: r["n"] or "" for r in got} == {i: tracker.plain(t) for i, t in enumerate(rows)} and tracker.plain("कि ") == "कि"


def test_one_element_through_four_frames(spark):
    o = obs(spark, (0, [(10, 10, 100, 30, "Save", "text", 0.9)]), (33, [(20, 10, 100, 30, "Saved", "text", 0.9)]), (99, [(20, 10, 100, 30, "saved", "text", 0.9)]))
    events = tracker.batch_events(o)
    (row,) = state.state_at(events).collect()
    assert (row["element_no"], row["txt"], row["x"], row["y"]) == (1, "saved", 20, 10)
    assert state.violations(events).count() == 0
    assert [r["type"] for r in events.orderBy("sequence").collect()] == ["snapshot", "moved", "content_changed", "content_changed"]


def test_lost_elements_come_back_under_their_id():
    e = lambda x, t="Save": tracker.Element((x, 10, 100, 30), t, "text", 0.9)
    t = tracker.Tracker()
    t.frame(0, (800, 600), [e(10)])
    assert [r[2] for r in t.frame(1, (800, 600), [])] == ["disappeared"]
    assert [r[2:4] for r in t.frame(2, (800, 600), [e(40)])] == [("appeared", 1)]  # 70 of 130 pixels shared
    assert [r[2:4] for r in t.frame(3, (800, 600), [e(400)])] == [("disappeared", 1), ("appeared", 2)]
    with pytest.raises(ValueError):
        t.frame(2, (800, 600), [])
    with pytest.raises(ValueError):
        t.frame(5, (800, 600), [e(750)])
    assert [r[2] for r in t.frame(5, (900, 600), [e(400)])] == ["resized"]


def test_translation_links_disjoint_boxes():
    seen = lambda dx: [tracker.Element((10 + dx, 10 + 50 * i, 30, 20), f"item{i}", "text", 1.0) for i in range(3)]
    t = tracker.Tracker()
    t.frame(0, (800, 600), seen(0))
    assert [r[2:4] for r in t.frame(1, (800, 600), seen(40))] == [("moved", 1), ("moved", 2), ("moved", 3)]


def test_state_is_the_last_frame(spark):
    o = observations(spark, SF)
    events = tracker.batch_events(o).cache()
    assert state.violations(events).count() == 0
    last = o.join(o.groupBy("stream_no").agg(F.max("ts_ms").alias("ts_ms")), ["stream_no", "ts_ms"])
    want = sorted((r["stream_no"], r["x"], r["y"], r["txt"]) for r in last.collect())
    assert sorted((r["stream_no"], r["x"], r["y"], r["txt"]) for r in state.state_at(events).collect()) == want
    again = tracker.batch_events(o.repartition(7, "obs_index"))
    assert sorted(map(str, again.collect())) == sorted(map(str, events.collect()))
    lines = compact.state_text(events)
    blocks = files.state_blocks(lines)
    assert blocks.where("block_ms IS NULL").count() == 0 and lines.where("line_no = 0 and line <> 'screenevents-state'").count() == 0


def test_strict_and_lenient_validation(spark):
    rows = [(1, 0, 0, "snapshot", 1, 10, 10, None, None), (1, 1, 1, "moved", 1, 30, 10, 11, 10), (1, 3, 2, "moved", 2, 0, 0, 0, 0), (2, 0, 0, "resized", None, None, None, None, None)]
    e = spark.createDataFrame(rows, "stream_no long, sequence long, ts_ms long, type string, element_no long, x long, y long, from_x long, from_y long")
    assert {(r["stream_no"], r["sequence"], r["problem"]) for r in state.violations(e).collect()} == {(1, 1, "moved_from_elsewhere"), (1, 3, "unknown_element"), (2, 0, "missing_snapshot")}
    assert {r["problem"] for r in state.violations(e, strict=False).collect()} == {"unknown_element", "missing_snapshot"}


def test_streaming_equals_batch(spark, tmp_path):
    o = observations(spark, SF)
    times = sorted({r["ts_ms"] for r in o.select("ts_ms").distinct().collect()})
    cut = times[len(times) // 2]
    for n, part in enumerate((o.where(F.col("ts_ms") < cut), o.where(F.col("ts_ms") >= cut))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"batch={n}"))
    read = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = tracker.stream_events(read).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("tracked").collect())) == sorted(map(str, tracker.batch_events(o).collect()))


def test_sampler(spark):
    times = spark.createDataFrame([(1, t) for t in (0, 999, 1000, 1999, 2001)], "stream_no long, t_ms long")
    assert sorted(r["t_ms"] for r in series.sampled_times(times, 1000).collect()) == [0, 1000, 2001]
    more = times.union(spark.createDataFrame([(1, 2500)], times.schema))
    assert [(r["t_ms"], r["terminal"]) for r in series.sampled_times(more, 1000).orderBy("t_ms").collect()][-1] == (2500, True)


def test_regions_and_episodes():
    zero = np.zeros((64, 64), int)
    whole = zero + 100
    assert regions(zero, whole) == [(0, 0, 64, 64, 4096)]
    part = zero.copy()
    part[:32, :48] = 100
    found = regions(zero, part)
    assert found == [(0, 0, 32, 32, 1024), (0, 32, 32, 32, 512)]
    small = np.zeros((32, 48), int)
    one = small.copy()
    one[17:21, 33:37] = 100
    e = Episodes()
    assert e.observe(small) == [] and e.observe(one) == [((16, 32, 16, 16, 16), 1, "started")]
    two = one.copy()
    two[17:21, 17:21] = 100
    assert [t[1:] for t in e.observe(two)] == [(1, "continued")]
    assert [t[1:] for t in e.observe(two)] == [(1, "closed")] and e.finish() == []
    with pytest.raises(ValueError):
        e.finish()


def test_compact_text():
    r = compact.Renderer()
    r.add(0, "screen", size=(800, 600))
    for i, x, t in ((1, 10, 'a"b'), (2, 20, ""), (3, 30, "c"), (5, 50, "d")):
        r.add(0, "snapshot", i, (x, 5, 9, 9), t)
    r.add(100, "moved", 1, (25, 5, 9, 9), 'a"b', was=(10, 5))  # 15 px: silent
    r.add(100, "content_changed", 1, (25, 5, 9, 9), "new")
    r.add(200, "content_changed", 1, (25, 5, 9, 9), "newer")
    r.add(200, "moved", 9, (99, 5, 9, 9), None, was=(10, 5))
    for i in (1, 2, 3, 5):
        r.add(400, "activity", i, duration=200)
    r.add(400, "activity", 7, duration=233)
    for i in (1, 2, 3, 5):
        r.add(500, "disappeared", i)
    r.add(600, "translated", box=(0, 4, 8, 12), move=(0, -24), duration=200)
    r.add(600, "resized", size=(600, 800))
    assert r.lines() == ["screenevents-state", "@0", "S800,600", '=1 10,5 a\\"b', " 20,5 \\e", " 30,5 c", "5 50,5 d", "@100", "~1 25,5 new", "@200", "~1:newer", ">9 99,5 e000009", "@400 !1-3,5", "!233/7", "@500", "-1-3,5", "@600", "^200 0 4 8 12 0 -24", "R600,800"]


def test_ivf(tmp_path, spark):
    head = b"DKIF" + struct.pack("<HH4sHHIIII", 0, 32, b"AV01", 64, 32, 30, 1, 1, 0)
    raw = head + struct.pack("<IQ", 3, 7) + b"abc"
    assert list(files.parse_ivf(raw)) == [(64, 32, 30, 1, 0, 7, b"abc")]
    for bad in (raw.replace(b"AV01", b"VP90"), raw[:-5], head + b"\0" * 5, b"", head + struct.pack("<IQ", 0, 7)):
        with pytest.raises(ValueError):
            list(files.parse_ivf(bad))
    (tmp_path / "a.ivf").write_bytes(raw)
    packets = files.ivf_packets(spark, str(tmp_path / "a.ivf"))
    assert packets.count() == 1 and files.seek(packets, 8).count() == 0


def test_event_lines(spark, tmp_path):
    o = observations(spark, SF).where("stream_no < 3")
    files.write_events(tracker.batch_events(o), str(tmp_path / "out"))
    back = files.event_lines(spark, str(tmp_path / "out"))
    assert back.where("problem IS NOT NULL").count() == 0 and back.count() == tracker.batch_events(o).count()
    with pytest.raises(Exception, match="(?i)already exists"):
        files.write_events(tracker.batch_events(o), str(tmp_path / "out"))
    (tmp_path / "bad").write_text('{"specversion":"1.0","odd":1}\n\n{"id":"1"}\nnot json\n')
    assert [r["problem"] for r in files.event_lines(spark, str(tmp_path / "bad")).collect()] == ["unknown_key", "blank", "missing_key", "not_json"]


def test_evaluation(spark):
    trials = spark.createDataFrame([("s1", t, k, (t + k) % 2 == 0) for t in range(4) for k in range(3)], "scenario string, task int, trial int, correct boolean")
    m = evaluation.majority(trials, ["scenario", "task"])
    assert {r["task"]: r["correct"] for r in m.collect()} == {0: True, 1: False, 2: True, 3: False}
    p = evaluation.paired(m, m.withColumn("correct", F.lit(False)), ["scenario", "task"]).first()
    assert (p["wins"], p["losses"], p["ties"], p["delta"]) == (2, 0, 2, 0.5) and evaluation.macro(m, "scenario").first()["macro"] == 0.5
    values = spark.createDataFrame([("s", i, float(i % 2)) for i in range(100)], "s string, c int, v double")
    ci = evaluation.bootstrap(values, "s", "c", "v", replicates=500).first()
    assert 0.38 < ci["low"] < 0.45 and 0.55 < ci["high"] < 0.62


def test_catalog_runs_and_has_oracles(spark):
    assert len(catalog.QUERIES) >= 30 and len(catalog.ORACLE) >= 28
    assert catalog.entry(spark).count() == 4
