"""Media columns: baseline JPEG, DC-only luminance thumbnails.

The decoder reads any baseline (SOF0, 8-bit, Huffman) JPEG, in one scan or several: marker parsing, byte unstuffing, Huffman
decoding of whole scans, and from each luminance block its DC value, which is eight times the block's mean. What it can't read has a
status of its own. Scans are decoded
in lockstep: all restart intervals of all images of a batch that share tables and sampling advance one
symbol a step, each as one lane of numpy arrays. The writer stores bytes so that this thumbnail is exactly the bytes:
one flat 8x8 block each, quantiser 8, DC = byte - 128, a restart interval for each row of blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import bounded_batches

#: Blocks in a row and rows in one image (its height stays under 65,536); longer payloads are several images.
ROW, MOST_ROWS = 64, 8191
#: Rows of blocks that are packed at once.
ROWS_AT_ONCE = 256
_DC = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
_DC_CODES = [(0, 2), (2, 3), (3, 3), (4, 3), (5, 3), (6, 3), (14, 4), (30, 5), (62, 6)]


def _table(counts, symbols) -> np.ndarray:
    """For each 16 bits ahead: symbol and code length, as symbol * 32 + length; 0 where no code fits."""
    out, code, k = np.zeros(65_536, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << 16 - length
            out[first : first + (1 << 16 - length)] = symbols[k] * 32 + length
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _pack(scan: bytearray, bits: np.ndarray, count: np.ndarray, first: int, rows: int) -> None:
    """Appends rows of blocks from row `first` on, each padded to whole bytes by ones, stuffed, a restart marker after each but the image's last."""
    row_bits = count.reshape(-1, ROW).sum(axis=1)
    room = (row_bits + 7) // 8 * 8
    row_start = np.cumsum(room) - room
    before = np.cumsum(count) - count
    start = before.reshape(-1, ROW)
    start = (start - start[:, :1] + row_start[:, None]).ravel()
    stream, within = np.ones(int(room.sum()), np.uint8), np.arange(count.sum()) - np.repeat(before, count)
    stream[np.repeat(start, count) + within] = np.repeat(bits, count) >> np.repeat(count, count) - 1 - within & 1
    packed = np.packbits(stream).tobytes()
    cuts = (row_start // 8).tolist() + [len(packed)]
    for i, (s, e) in enumerate(zip(cuts, cuts[1:]), first):
        scan += packed[s:e].replace(b"\xff", b"\xff\x00")
        if i + 1 < rows:
            scan += bytes((0xFF, 0xD0 + i % 8))


def _image(values: np.ndarray) -> bytes:
    """A grey baseline JPEG whose DC thumbnail (ROW blocks a row) is values (uint8, a multiple of ROW of them)."""
    dc = values.reshape(-1, ROW).astype(np.int64) - 128
    step = np.diff(dc, axis=1, prepend=0).ravel()
    size = np.zeros(len(step), np.int64)
    rest = np.abs(step)
    while rest.any():
        size += rest > 0
        rest >>= 1
    codes = np.array(_DC_CODES)
    # Huffman code of the size, the step's bits, then the end-of-block code, a single 0 bit
    bits = ((codes[size, 0] << size) + np.where(step < 0, step + (1 << size) - 1, step)) << 1
    count = codes[size, 1] + size + 1
    scan = bytearray()
    for row in range(0, len(dc), ROWS_AT_ONCE):
        _pack(scan, bits[row * ROW : (row + ROWS_AT_ONCE) * ROW], count[row * ROW : (row + ROWS_AT_ONCE) * ROW], row, len(dc))
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, b"\x00" + b"\x08" * 64),
        _segment(0xC0, struct.pack(">BHHB", 8, len(dc) * 8, ROW * 8, 1) + b"\x01\x11\x00"),
        _segment(0xC4, b"\x00" + bytes(_DC) + bytes(range(12))),
        _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00"),
        _segment(0xDD, struct.pack(">H", ROW)),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        bytes(scan),
        b"\xff\xd9",
    ))


def store(payload: bytes) -> bytes:
    """Baseline JPEG images, one after another, that hold payload (a positive multiple of 64 bytes)."""
    if not payload or len(payload) % ROW:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    values = np.frombuffer(payload, np.uint8)
    return b"".join(_image(values[at : at + ROW * MOST_ROWS]) for at in range(0, len(values), ROW * MOST_ROWS))


class Broken(ValueError):
    """Bytes that aren't a baseline image that this decoder reads."""


class _Scan:
    """What the markers of one image say; raw: the entropy-coded bytes of its luminance scan, still stuffed; end: where the image ends.

    A scan holds all components or some; the scan that luminance is in is kept, others are passed over. Tables and restart
    intervals are those defined before that scan.
    """

    def __init__(self, data: bytes, at: int):
        self.data, quant, huff, self.restart, self.comps, self.raw = data, {}, {}, 0, None, None
        if data[at : at + 2] != b"\xff\xd8":
            raise Broken("no start of image")
        at += 2
        while True:
            marker, body, at = self.segment(at)
            if marker == 0xD9:
                break
            if marker == 0xDB:
                while body:
                    wide, k = body[0] >> 4, body[0] & 15
                    if len(body) < 65 + 64 * (wide > 0):
                        raise Broken("a quantiser is cut off")
                    quant[k] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[65 + 64 * (wide > 0) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    if len(body) < 17 + n or sum(c << 16 - i for i, c in enumerate(body[1:17], 1)) > 65_536:
                        raise Broken("a Huffman table is cut off or over-full")
                    huff[body[0]] = bytes(body[1 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC0:
                self.frame(body)
            elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise Broken("not a baseline image")
            elif marker == 0xDD:
                if len(body) != 2:
                    raise Broken("a restart interval is cut off")
                (self.restart,) = struct.unpack(">H", body)
            elif marker == 0xDA:
                at = self.scan(body, at, quant, huff)
        if self.raw is None:
            raise Broken("no luminance scan")
        self.end = at

    def segment(self, at: int) -> tuple[int, bytes, int]:
        """The marker at `at` (fill bytes before it are passed over), its body, and where the next one is."""
        while self.data[at : at + 2] == b"\xff\xff":
            at += 1
        if len(self.data) < at + 2 or self.data[at] != 0xFF:
            raise Broken("a marker is missing")
        marker = self.data[at + 1]
        if marker == 0xD9 or marker == 0x01 or 0xD0 <= marker <= 0xD7:
            return marker, b"", at + 2
        length = int.from_bytes(self.data[at + 2 : at + 4], "big")
        if length < 2 or len(self.data) < at + 2 + length:
            raise Broken("a segment is cut off")
        return marker, self.data[at + 4 : at + 2 + length], at + 2 + length

    def frame(self, body: bytes) -> None:
        if self.comps is not None or len(body) < 6 or len(body) != 6 + 3 * body[5]:
            raise Broken("a frame header is wrong")
        bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if bits != 8 or not self.width or not self.height or not n:
            raise Broken("only 8-bit images of known size")
        self.comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        if any(not 1 <= c[1] <= 4 or not 1 <= c[2] <= 4 for c in self.comps):
            raise Broken("a sampling factor is wrong")

    def scan(self, body: bytes, at: int, quant: dict, huff: dict) -> int:
        """Takes what the luminance scan needs; returns where the entropy-coded bytes end."""
        if self.comps is None or not body or len(body) != 4 + 2 * body[0]:
            raise Broken("a scan header is wrong")
        whole = np.frombuffer(self.data, np.uint8)[at:]
        # in pieces, so that an image of many needn't look at all that follows
        start, step = 0, 1 << 16
        while True:
            piece = whole[start : start + step + 1]
            marks = np.nonzero((piece[:-1] == 0xFF) & (piece[1:] != 0) & (piece[1:] != 0xFF) & ((piece[1:] & 0xF8) != 0xD0))[0]
            if len(marks):
                break
            if start + step >= len(whole):
                raise Broken("the scan does not end")
            start += step
        end = start + int(marks[0])
        used = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
        mine = [c for c in self.comps if c[0] in used]
        if len(mine) != len(used) or body[0] != len(used):
            raise Broken("a scan has unknown components")
        if self.comps[0] in mine and self.raw is None:
            single = len(mine) == 1
            hmax, vmax = max(c[1] for c in self.comps), max(c[2] for c in self.comps)
            first = self.comps[0]
            self.size = -(-self.width * first[1] // (8 * hmax)), -(-self.height * first[2] // (8 * vmax))
            self.lum = (1, 1) if single else first[1:3]
            # a scan of one component holds its own blocks only, one an MCU
            self.across, self.down = self.size if single else (-(-self.width // (8 * hmax)), -(-self.height // (8 * vmax)))
            if first[3] not in quant or any(used[c[0]] >> 4 not in huff or 16 + (used[c[0]] & 15) not in huff for c in mine):
                raise Broken("a table is missing")
            self.quant, self.every = quant[first[3]], self.restart
            order = [c for x in used for c in mine if c[0] == x]
            #: for each block of an MCU: whether it is luminance's (0) or another component's number, DC table, AC table
            self.plan = tuple((self.comps.index(c), huff[used[c[0]] >> 4], huff[16 + (used[c[0]] & 15)]) for c in order for _ in range(1 if single else c[1] * c[2]))
            self.raw = whole[:end]
        return at + end

    def lanes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The unstuffed bytes, where each restart interval starts in them, and its number of MCUs."""
        ff = np.concatenate((self.raw[:-1] == 0xFF, [False])) if len(self.raw) else np.zeros(0, bool)
        after = np.concatenate((self.raw[1:], [0])) if len(self.raw) else self.raw
        restart, stuffed = ff & ((after & 0xF8) == 0xD0), np.concatenate(([False], (ff & (after == 0))[:-1]))
        drop = stuffed | restart | np.concatenate(([False], restart[:-1]))
        kept = np.cumsum(~drop) - ~drop
        starts = np.concatenate(([0], kept[np.nonzero(restart)[0]]))
        total, every = self.across * self.down, self.every or self.across * self.down
        if len(starts) != -(-total // every):
            raise Broken("restart markers are missing")
        # a block takes two bits at least (a DC and an AC code)
        if total * len(self.plan) * 2 > 8 * len(self.raw):
            raise Broken("the scan is cut off")
        return self.raw[~drop], starts, np.minimum(every, total - every * np.arange(len(starts)))


def _decode_lanes(plan, bits: np.ndarray, at: np.ndarray, mcus: np.ndarray, lum: int) -> list[np.ndarray]:
    """DC values of component 0 for each lane, by MCU and block: arrays (lanes, lum), one for each MCU."""
    tables = {x: _table(x[:16], x[16:]) for _, d, a in plan for x in (d, a)}
    words = np.zeros(len(bits) + 8, np.int64)
    for k in range(5):
        words[: len(bits)] |= np.concatenate((bits[k:], np.full(min(k, len(bits)), 255, np.uint8))).astype(np.int64) << (32 - 8 * k)
    words[len(bits) :] = (1 << 40) - 1
    pos, last = at * 8, (len(bits) + 7) * 8

    def ahead(p):
        return words[p >> 3] >> (24 - (p & 7)) & 0xFFFF

    def extra(p, n):
        v = ahead(p) >> (16 - n)
        return np.where((n > 0) & (v < (1 << np.maximum(n, 1) - 1)), v - (1 << n) + 1, v) * (n > 0)

    before = np.zeros((max(c for c, _, _ in plan) + 1, len(at)), np.int64)
    out = []
    for m in range(int(mcus.max(initial=0))):
        live = np.nonzero(mcus > m)[0]
        dcs = []
        for comp, dc, ac in plan:
            p = pos[live]
            code = tables[dc][ahead(p)]
            n = code >> 5
            if not code.all() or (n > 11).any():
                raise Broken("a DC code is not in its table")
            p += code & 31
            before[comp, live] += extra(p, n)
            p += n
            if comp == 0:
                dcs.append(before[0].copy())
            todo, k = np.arange(len(live)), np.ones(len(live), np.int64)
            while len(todo):
                code = tables[ac][ahead(p[todo])]
                if not code.all():
                    raise Broken("an AC code is not in its table")
                run, size = code >> 9, code >> 5 & 15
                p[todo] += (code & 31) + size
                k[todo] = np.where(size > 0, k[todo] + run + 1, np.where(run == 15, k[todo] + 16, 64))
                todo = todo[k[todo] < 64]
            if (p > last).any() or (k > 64 + 15).any():
                raise Broken("the scan is cut off")
            pos[live] = p
        out.append(np.stack(dcs, axis=1))
    return out


def thumbnails(images: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each value, each image it holds, one after another: width, height, and the DC-only luminance thumbnail (rows, columns; uint8).

    Broken, a ValueError, where a value has no image, or one that is broken or of another kind.
    """
    scans, groups = [], {}
    for k, raw in enumerate(images):
        at, raw = 0, bytes(raw)
        while at < len(raw) or not at:
            s = _Scan(raw, at)
            groups.setdefault(s.plan, []).append(len(scans))
            scans.append((k, s))
            at = s.end
    found = {}
    for plan, members in groups.items():
        pieces, starts, mcus, owner, base = [], [], [], [], 0
        for x in members:
            bits, at, n = scans[x][1].lanes()
            pieces.append(bits)
            starts.append(at + base)
            mcus.append(n)
            owner.append(len(at))
            base += len(bits)
        lum = sum(1 for c, _, _ in plan if c == 0)
        lanes = np.stack(_decode_lanes(plan, np.concatenate(pieces), np.concatenate(starts), np.concatenate(mcus), lum), axis=1)
        ends = np.cumsum([0, *owner])
        for x, s, e, n in zip(members, ends, ends[1:], mcus):
            scan = scans[x][1]
            dc = lanes[s:e].reshape(-1, lum) if e - s == 1 or (n == lanes.shape[1]).all() else np.concatenate([lanes[s + i, :c] for i, c in enumerate(n)])
            h, v = scan.lum
            dc = dc[: scan.across * scan.down].reshape(scan.down, scan.across, v, h).transpose(0, 2, 1, 3).reshape(scan.down * v, scan.across * h)
            w, t = scan.size
            found[x] = scan.width, scan.height, np.clip((dc[:t, :w] * scan.quant + 4) // 8 + 128, 0, 255).astype(np.uint8)
    out = [[] for _ in images]
    for x, (k, _) in enumerate(scans):
        out[k].append(found[x])
    return out


def thumbnail_hash(thumbs: list[np.ndarray]) -> str:
    """Average hash of thumbnails that stand one below the other (narrower ones with zeros on their right): 64 bits, one for each cell of
    an 8x8 grid over them, set where its mean is over the grid's."""
    wide = max(t.shape[1] for t in thumbs)
    thumb = thumbs[0] if len(thumbs) == 1 else np.concatenate([np.pad(t, ((0, 0), (0, wide - t.shape[1]))) for t in thumbs])
    rows, cols = (np.arange(9) * n // 8 for n in thumb.shape)
    total = np.zeros((9, wide + 1), np.int64)
    for i, (s, e) in enumerate(zip(rows, rows[1:])):
        total[i + 1, 1:] = thumb[s:e].sum(axis=0, dtype=np.int64)
    total = np.cumsum(np.cumsum(total, 0), 1)
    area = np.maximum(1, np.diff(rows)[:, None] * np.diff(cols)[None, :])
    mean = np.diff(np.diff(total[:, cols], axis=0), axis=1) / area
    return np.packbits(mean > mean.mean()).tobytes().hex()


def _stored(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and its padded payload as images."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), store(raw + bytes(-len(raw) % ROW or (0 if raw else ROW)))


def with_media(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by n_bytes (unpadded UTF-8) and media (binary): the padded payload as baseline JPEG.

    Null text: as the empty text, which is 64 zero bytes. Other columns named n_bytes or media are replaced.
    """
    bounded_batches(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name not in (text, "n_bytes", "media")]
    schema = T.StructType([*keep, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches):
        for batch in batches:
            at, texts = 0, batch.column(text).to_pylist()
            while at < len(texts):
                first, size, sizes, media = at, 0, [], []
                while at < len(texts) and size < 2_000_000:
                    n, stored = _stored(texts[at])
                    sizes.append(n)
                    media.append(stored)
                    size, at = size + len(stored), at + 1
                part = batch.slice(first, at - first)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], schema.names)

    return df.mapInArrow(run, schema)


_READ = [
    ("payload", T.BinaryType()), ("width", T.IntegerType()), ("height", T.LongType()), ("images", T.IntegerType()), ("thumb_hash", T.StringType()),
    ("thumb_crc32", T.LongType()), ("status", T.StringType()),
]


def _read(values: list[bytes]) -> list:
    """thumbnails() of each value, None for one that can't be read."""
    try:
        return thumbnails(values)
    except (ValueError, IndexError, KeyError, struct.error):
        if len(values) == 1:
            return [None]
        half = len(values) // 2  # so that a broken value costs others but a few more calls
        return _read(values[:half]) + _read(values[half:])


def _read_back(values: list) -> list[pa.Array]:
    """Columns _READ of stored images."""
    rows, found = [], iter(_read([x for x in values if x is not None]) if any(x is not None for x in values) else [])
    for x in values:
        got = None if x is None else next(found)
        if got is None:
            rows.append((None,) * 6 + ("null" if x is None else "broken",))
        else:
            payload = b"".join(t.tobytes() for _, _, t in got)
            rows.append((payload, max(w for w, _, _ in got), sum(h for _, h, _ in got), len(got), thumbnail_hash([t for _, _, t in got]), zlib.crc32(payload), "ok"))
    return [pa.array(x, k) for x, k in zip(zip(*rows), (pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()))]


def media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Reads stored images back: adds payload (binary, all thumbnails' samples), images (their number), width (the widest one's), height (all
    together), thumb_hash and thumb_crc32 (of all thumbnails, one below the other), and status: `ok`, `null`, or `broken`, for which
    the others are null. Columns of these names are replaced, others pass through; repeated rows repeat their values.
    """
    bounded_batches(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name not in dict(_READ)]
    schema = T.StructType([*keep, *(T.StructField(*x) for x in _READ)])

    def run(batches):
        for batch in batches:
            values, at = batch.column(media).to_pylist(), 0
            while at < len(values):
                first, size = at, 0
                while at < len(values) and size < 1_000_000:
                    size, at = size + len(values[at] or b""), at + 1
                part = batch.slice(first, at - first)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), *_read_back(values[first:at])], schema.names)

    return df.mapInArrow(run, schema)


def stored_features(df: DataFrame, text: str = "text") -> DataFrame:
    """media_features(with_media(df)) in one pass through Python: each text is stored, and its features come from the stored bytes."""
    bounded_batches(df.sparkSession)
    new = [("n_bytes", T.LongType()), ("media", T.BinaryType()), *_READ]
    keep = [f for f in df.schema.fields if f.name != text and f.name not in dict(new)]
    schema = T.StructType([*keep, *(T.StructField(*x) for x in new)])

    def run(batches):
        for batch in batches:
            at, texts = 0, batch.column(text)
            while at < len(texts):
                first, size, sizes, media = at, 0, [], []
                while at < len(texts) and size < 1_000_000:
                    n, stored = _stored(texts[at].as_py())
                    sizes.append(n)
                    media.append(stored)
                    size, at = size + len(stored), at + 1
                part = batch.slice(first, at - first)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), *_read_back(media)], schema.names)

    return df.mapInArrow(run, schema)


def digests() -> list:
    """The query's columns from those of media_features()."""
    return [
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", F.greatest(F.lit(1), F.octet_length("payload") - 63), F.lit(64))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("%dx%d:%d:%s:%08x", "width", "height", "images", "thumb_hash", "thumb_crc32").alias("feature"),
    ]
