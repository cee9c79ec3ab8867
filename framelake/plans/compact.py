"""Compact state text of an event log: one line group a time, one row a fact.

The text depends on what was printed before (projected places, open row kinds), so a stream is one group.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame

HEADER, GATE_MS, LEAST_MOVE, CHUNK = "screenevents-state", 200, 16, 3000


def shown(text: str) -> str:
    """One line: \\e for empty, else JSON's escapes without the quotes."""
    return "\\e" if text == "" else json.dumps(text, ensure_ascii=False)[1:-1]


def ranges(ids: list[int]) -> str:
    """1-3,5: runs of three or more as a range."""
    out, at = [], 0
    while at < len(ids):
        end = at
        while end + 1 < len(ids) and ids[end + 1] == ids[end] + 1:
            end += 1
        out += [f"{ids[at]}-{ids[end]}"] if end - at >= 2 else [str(i) for i in ids[at : end + 1]]
        at = end + 1
    return ",".join(out)


class Renderer:
    """add() takes events in order; lines() ends the open row group and returns the text's lines."""

    def __init__(self):
        self.out, self.text, self.place, self.printed = [HEADER], {}, {}, None
        self.kind, self.time, self.rows = None, None, []

    def _flush(self) -> None:
        if not self.rows:
            return
        op, *rest = self.kind
        if op in "-!":
            ids = ranges(sorted(r[0] for r in self.rows) if op == "!" else [r[0] for r in self.rows])
            body = ids if op == "-" else ids if rest[0] == GATE_MS else f"{rest[0]}/{ids}"
            if op == "!" and self.printed != self.time:
                self.out.append(f"@{self.time} !{body}")
                self.printed = self.time
            else:
                self._line(op + body)
        else:
            last = None
            for n, (i, value) in enumerate(self.rows):
                # an id that follows the one before is left out
                name = "" if last is not None and last + 1 == i else str(i)
                self._line((op if n == 0 else "") + name + value)
                last = i
        self.rows = []

    def _line(self, line: str) -> None:
        if self.printed != self.time:
            self.out.append(f"@{self.time}")
            self.printed = self.time
        self.out.append(line)

    def _fact(self, ts: int, kind: tuple, i: int, value: str = "") -> None:
        if (ts, kind) != (self.time, self.kind) or len(self.rows) >= CHUNK:
            self._flush()
            self.time, self.kind = ts, kind
        self.rows.append((i, value))

    def _now(self, ts: int, line: str) -> None:
        self._flush()
        self.time, self.kind = ts, None
        self._line(line)

    def add(self, ts: int, kind: str, i=None, box=None, text=None, was=None, size=None, duration=None, move=None) -> None:
        if kind == "screen":
            self.text, self.place = {}, {}
            self._now(ts, f"S{size[0]},{size[1]}")
        elif kind == "resized":
            self._now(ts, f"R{size[0]},{size[1]}")
        elif kind in ("snapshot", "appeared"):
            if text is not None:
                self._fact(ts, ("=" if kind == "snapshot" else "+",), i, f" {box[0]},{box[1]} {shown(text)}")
                self.text[i], self.place[i] = text, tuple(box[:2])
        elif kind == "content_changed":
            if text is not None and self.text.get(i) != text:
                here = tuple(box[:2])
                self._fact(ts, ("~",), i, f":{shown(text)}" if self.place.get(i) == here else f" {here[0]},{here[1]} {shown(text)}")
                self.text[i], self.place[i] = text, here
        elif kind == "moved":
            if max(abs(box[0] - was[0]), abs(box[1] - was[1])) >= LEAST_MOVE:
                text = f"e{i:06d}" if text is None else text
                same = self.text.get(i) == text
                self._fact(ts, (">",), i, f" {box[0]},{box[1]}" + ("" if same else f" {shown(text)}"))
                self.text[i], self.place[i] = text, tuple(box[:2])
        elif kind == "disappeared":
            if i in self.text:
                self._fact(ts, ("-",), i)
                del self.text[i]
                self.place.pop(i, None)
        elif kind == "activity":
            self._fact(ts, ("!", duration), i)
        elif kind == "translated":
            self._now(ts, f"^{duration} " + " ".join(map(str, (*box, *move))))
        else:
            raise ValueError(f"unknown event {kind}")

    def lines(self) -> list[str]:
        self._flush()
        return self.out


def state_text(events: DataFrame, width: int = 640, height: int = 480) -> DataFrame:
    """(stream_no, line_no, line) of the log that streaming.tracker gives, or of one with activity (plans.log.with_activity).

    A snapshot's size is its own (fw, fh); width and height stand in for one without.
    """
    has = set(events.columns)

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        r, shown_as = Renderer(), None
        whole = lambda v: None if pd.isna(v) else int(v)
        for e in rows.sort_values(["sequence", "element_no"], kind="stable").itertuples():
            size = (whole(e.fw), whole(e.fh)) if {"fw", "fh"} <= has and not pd.isna(e.fw) else None
            if shown_as is None or e.type == "snapshot" and e.sequence != shown_as:
                r.add(e.ts_ms, "screen", size=size or (width, height))
                shown_as = e.sequence
            box = None if pd.isna(e.x) else tuple(map(whole, (e.x, e.y, e.w, e.h)))
            was = None if pd.isna(e.from_x) else (whole(e.from_x), whole(e.from_y))
            if e.type == "resized":
                r.add(e.ts_ms, "resized", size=size or box[2:])
            elif e.type == "activity":
                lasted = e.ts_ms - whole(e.from_ms)
                if e.kind == "region_translated":
                    r.add(e.ts_ms, "translated", box=box, duration=lasted, move=(whole(e.dx), whole(e.dy)))
                else:
                    r.add(e.ts_ms, "activity", whole(e.element_no), duration=lasted)
            elif not pd.isna(e.element_no):
                r.add(e.ts_ms, e.type, whole(e.element_no), box, e.txt if isinstance(e.txt, str) else None, was)
        return pd.DataFrame([(int(key[0]), n, x) for n, x in enumerate(r.lines())], columns=["stream_no", "line_no", "line"])

    return events.groupBy("stream_no").applyInPandas(run, "stream_no long, line_no long, line string")


def parse_ids(text: str) -> list[int]:
    """The ids of a range list."""
    out = []
    for part in text.split(","):
        a, _, b = part.partition("-")
        out += range(int(a), int(b or a) + 1)
    if not re.fullmatch(r"[0-9,\-]+", text):
        raise ValueError("not a list of ids")
    return out
