"""File sources and sinks: IVF and Matroska packets, event streams, state text."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MOST_PACKET = 64 << 20
ENVELOPE = {"specversion", "id", "source", "sequence", "frametime", "datacontenttype", "type", "data"}


def parse_ivf(raw: bytes):
    """Yields (width, height, rate, scale, packet_no, timestamp, data) of an IVF file of AV1 packets."""
    if raw[:4] != b"DKIF" or len(raw) < 32:
        raise ValueError("not an IVF file")
    size, codec, width, height, rate, scale = struct.unpack_from("<H4sHHII", raw, 6)
    if codec != b"AV01":
        raise ValueError("the codec is not AV1")
    at, n = size, 0
    while at < len(raw):
        if len(raw) - at < 12:
            raise ValueError("a packet header is cut off")
        length, ts = struct.unpack_from("<IQ", raw, at)
        if not 0 < length <= MOST_PACKET:
            raise ValueError("a packet has no valid length")
        if len(raw) - at - 12 < length:
            raise ValueError("a packet is cut off")
        yield width, height, rate, scale, n, ts, raw[at + 12 : at + 12 + length]
        at, n = at + 12 + length, n + 1


def ivf_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets of the IVF files at path, one file a row of work."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames):
        for f in frames:
            rows = [(p, *x) for p, raw in zip(f["path"], f["content"]) for x in parse_ivf(raw)]
            yield pd.DataFrame(rows, columns=["path", "width", "height", "rate", "scale", "packet_no", "timestamp", "data"])

    return files.mapInPandas(run, "path string, width int, height int, rate long, scale long, packet_no long, timestamp long, data binary")


# Element numbers of the container format.
SEGMENT, INFO, TRACKS, CLUSTER, BLOCK_GROUP = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0xA0
EBML_HEADER, SCALE, TRACK, TIME, SIMPLE_BLOCK, BLOCK, REFERENCE = 0x1A45DFA3, 0x2AD7B1, 0xAE, 0xE7, 0xA3, 0xA1, 0xFB
NUMBER, KIND, CODEC, ENCODINGS, ENCODING, DELAY, PREROLL, VIDEO, WIDTH, HEIGHT = 0xD7, 0x83, 0x86, 0x6D80, 0x6240, 0x56AA, 0x56BB, 0xE0, 0xB0, 0xBA


def _vint(raw: bytes, at: int, marked: bool) -> tuple[int | None, int]:
    """(value, next place) of a number whose first byte's leading zeros give its length; marked keeps the marker bit. None: size unknown."""
    if at >= len(raw) or not raw[at]:
        raise ValueError("an element is cut off or malformed")
    n = 9 - raw[at].bit_length()
    if at + n > len(raw):
        raise ValueError("an element is cut off or malformed")
    v, bits = int.from_bytes(raw[at : at + n], "big"), 7 * n
    if marked:
        return v, at + n
    v &= (1 << bits) - 1
    return (None if v == (1 << bits) - 1 else v), at + n


def _elements(raw: bytes, at: int, end: int, entered: tuple = ()):
    """Yields (number, start, end) of the elements from at to end; the children of entered ones follow them in the same row."""
    while at < end:
        number, at = _vint(raw, at, True)
        size, at = _vint(raw, at, False)
        if number in entered:
            yield number, at, at
            continue
        if size is None or at + size > end:
            raise ValueError("an element is cut off or malformed")
        yield number, at, at + size
        at += size


def _laced(raw: bytes, at: int, end: int, lacing: int):
    """The frames of a block's payload."""
    if not lacing:
        return [raw[at:end]]
    n, at = raw[at] + 1, at + 1
    sizes = []
    if lacing == 2:
        sizes = [(end - at) // n] * (n - 1)
        if (end - at) % n:
            raise ValueError("a block's frames are not of one size")
    for k in range(n - 1 if lacing != 2 else 0):
        if lacing == 1:
            v = 0
            while raw[at] == 255:
                v, at = v + 255, at + 1
            v, at = v + raw[at], at + 1
        else:
            before = at
            v, at = _vint(raw, at, False)
            v = v if not k else sizes[-1] + v - ((1 << (7 * (at - before) - 1)) - 1)
        sizes.append(v)
    out = []
    for size in sizes:
        out.append(raw[at : at + size])
        at += size
    if at > end or min(sizes, default=0) < 0:
        raise ValueError("a block's frames are cut off")
    return [*out, raw[at:end]]


def parse_matroska(raw: bytes):
    """Yields (width, height, scale_ns, packet_no, timestamp, keyframe, invisible, data) of a file with one AV1 video track and no other.

    Timestamps are in units of scale_ns. Encoded content, codec delay and pre-roll are errors, as are cut-off elements.
    """
    number = lambda a, b: int.from_bytes(raw[a:b], "big")
    scale, tracks, now, n = 1_000_000, [], 0, 0
    for e, a, b in _elements(raw, 0, len(raw), (SEGMENT, INFO, TRACKS, CLUSTER)):
        if e != EBML_HEADER and a and not raw.startswith(EBML_HEADER.to_bytes(4, "big")):
            raise ValueError("not a Matroska file")
        if e == SCALE:
            scale = number(a, b)
        elif e == TRACK:
            tracks.append({x: (c, d) for x, c, d in _elements(raw, a, b)})
        elif e == TIME:
            now = number(a, b)
        elif e == CLUSTER and not n:
            track, width, height = _checked(raw, tracks)
        elif e in (SIMPLE_BLOCK, BLOCK_GROUP):
            inside = {x: (c, d) for x, c, d in _elements(raw, a, b)} if e == BLOCK_GROUP else {BLOCK: (a, b)}
            if BLOCK not in inside:
                raise ValueError("a group has no block")
            c, d = inside[BLOCK]
            of, c = _vint(raw, c, False)
            if c + 3 > d:
                raise ValueError("a block is cut off")
            shift, flags = int.from_bytes(raw[c : c + 2], "big", signed=True), raw[c + 2]
            if of != track:
                continue
            key = bool(flags & 0x80) if e == SIMPLE_BLOCK else REFERENCE not in inside
            for data in _laced(raw, c + 3, d, flags >> 1 & 3):
                yield width, height, scale, n, now + shift, key, bool(flags & 8), data
                n += 1


def _checked(raw: bytes, tracks: list[dict]) -> tuple[int, int, int]:
    """(number, width, height) of the only track."""
    if len(tracks) != 1:
        raise ValueError(f"{len(tracks)} tracks, not one")
    (t,) = tracks
    number = lambda e, of=t: int.from_bytes(raw[slice(*of[e])], "big") if e in of else 0
    if number(KIND) != 1:
        raise ValueError("the track is not video")
    if raw[slice(*t.get(CODEC, (0, 0)))].rstrip(b"\0") != b"V_AV1":
        raise ValueError("the codec is not AV1")
    if ENCODINGS in t and any(x == ENCODING for x, _, _ in _elements(raw, *t[ENCODINGS])):
        raise ValueError("the content is encoded")
    if number(DELAY) or number(PREROLL):
        raise ValueError("the codec has a delay")
    if VIDEO not in t:
        raise ValueError("the track has no video settings")
    video = {x: (c, d) for x, c, d in _elements(raw, *t[VIDEO])}
    size = number(WIDTH, video), number(HEIGHT, video)
    if not all(0 < v < 1 << 32 for v in size):
        raise ValueError("the frame has no valid size")
    return number(NUMBER), *size


def matroska_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets of the Matroska files at path, one file a row of work (binaryFile holds a file whole: 2 GB at most)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    columns = ["path", "width", "height", "scale_ns", "packet_no", "timestamp", "keyframe", "invisible", "data"]

    def run(frames):
        for f in frames:
            for p, raw in zip(f["path"], f["content"]):
                yield pd.DataFrame([(p, *x) for x in parse_matroska(raw)], columns=columns)

    return files.mapInPandas(run, "path string, width long, height long, scale_ns long, packet_no long, timestamp long, keyframe boolean, invisible boolean, data binary")


def decoded(packets: DataFrame, decoder, schema: str, stream: str = "path") -> DataFrame:
    """Frames of each stream by an injected decoder: decoder() gives an object whose packet(data, timestamp) and drain() list rows of schema.

    A stream's packets go through one decoder in order, drained at the end; schema starts with the stream's column. Packets and frames pass by in
    batches: what is held of a stream is what its decoder holds.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        d, now, fresh = None, None, True
        for f in frames:
            out = []
            for key, data, timestamp in zip(f[stream], f["data"], f["timestamp"]):
                if fresh or key != now:
                    if d is not None:
                        out += [(now, *x) for x in d.drain()]
                    d, now, fresh = decoder(), key, False
                out += [(now, *x) for x in d.packet(bytes(data), int(timestamp))]
            yield pd.DataFrame(out, columns=names)
        if d is not None:
            yield pd.DataFrame([(now, *x) for x in d.drain()], columns=names)

    return packets.select(stream, "packet_no", "data", "timestamp").repartition(stream).sortWithinPartitions(stream, "packet_no").mapInPandas(run, schema)


def luma_plane(data: bytes | memoryview, offset: int, stride: int, width: int, height: int, bits: int = 8) -> bytes:
    """A picture's pixels row by row without padding: row k is at offset + k * stride, and the stride may be negative. An error where it isn't 8-bit, has no
    size, a stride is shorter than a row, or a row lies outside data."""
    if width <= 0 or height <= 0:
        raise ValueError("a picture must have a size")
    if bits != 8:
        raise ValueError(f"{bits} bits a pixel, not 8")
    if abs(stride) < width:
        raise ValueError("a stride is shorter than a row")
    last = offset + (height - 1) * stride
    if min(offset, last) < 0 or max(offset, last) + width > len(data):
        raise ValueError("a row is outside the picture's data")
    return b"".join(bytes(data[at : at + width]) for at in range(offset, last + (1 if stride > 0 else -1), stride)) if height > 1 else bytes(data[offset : offset + width])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files, lines counted from 1 in each file: by the place of the block that a line was read in, then in the order of reading."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), "value").withColumn("__at", F.monotonically_increasing_id())
    return rows.withColumn("line_no", F.row_number().over(W.partitionBy("file").orderBy("__block", "__at")).cast("long")).select("file", "line_no", "value")


def seek(packets: DataFrame, timestamp: int) -> DataFrame:
    return packets.where(F.col("timestamp") >= timestamp)


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, event, problem) of an NDJSON event stream: the line, its fields as a map of JSON texts, and what is wrong with it.

    Keys outside the envelope are a problem here; Spark's reader alone would pass them over.
    """
    lines = spark.read.text(path)
    keys = F.json_object_keys("value")
    problem = F.when(F.trim("value") == "", "blank").when(F.instr("value", "\r") > 0, "carriage_return").when(keys.isNull(), "not_json").when(
        F.size(F.array_except(keys, F.array(*map(F.lit, sorted(ENVELOPE))))) > 0, "unknown_key").when(F.size(F.array_distinct(keys)) < len(ENVELOPE), "missing_key")
    return lines.select("value", F.from_json("value", "map<string,string>").alias("event"), problem.alias("problem"))


def state_blocks(lines: DataFrame) -> DataFrame:
    """Rows (stream_no, line_no, line) of state text with the time of their block: the last @t line at or before them."""
    time = F.regexp_extract("line", r"^@([0-9]+)", 1)
    own = W.partitionBy("stream_no").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    marked = lines.where("line_no > 0").withColumn("at", F.when(time != "", time.cast("long")))
    return marked.withColumn("block_ms", F.last("at", ignorenulls=True).over(own)).drop("at")


def event_line(events: DataFrame, source: str = "urn:framelake:stream:"):
    """An event's line of NDJSON as a column: the envelope, and the columns of events that are data of it; nulls are left out."""
    data = F.struct(*(c for c in ("element_no", "x", "y", "w", "h", "txt", "role", "conf", "from_x", "from_y", "from_w", "from_h", "fw", "fh", "from_ms", "kind", "dx", "dy") if c in events.columns))
    return F.to_json(F.struct(
        F.lit("1.0").alias("specversion"), F.concat_ws(":", "stream_no", "sequence").alias("id"), F.concat(F.lit(source), F.col("stream_no")).alias("source"), "sequence",
        F.col("ts_ms").alias("frametime"), F.lit("application/json").alias("datacontenttype"), "type", data.alias("data"),
    ))


def write_events(events: DataFrame, path: str, source: str = "urn:framelake:stream:") -> None:
    """NDJSON, one event a line, nulls left out; refuses to overwrite."""
    line = event_line(events, source)
    events.repartitionByRange("stream_no", "sequence").sortWithinPartitions("stream_no", "sequence").select(line.alias("value")).write.mode("errorifexists").text(path)
