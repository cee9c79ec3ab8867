"""WARC revisit resolution: an as-of join by canonical URL to the latest earlier full response.

Captures are rows: id, url, ts (seconds), kind (`response` or `revisit`), etag, last_modified, digest (of the
payload; a revisit's is the one it claims, or null) and headers (map of lower-case names). A server-not-modified
revisit stands for the latest full response of its canonical URL before it. Captures of a URL are cut into
stretches of time, the last response of a stretch is carried to the next by a window over the stretches
alone, and the as-of within a stretch is a window of its own: one URL with very many captures is many small groups.
"""

from __future__ import annotations

import math
import zlib
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A stretch of time; captures of one address in it from which on it is cut finer.
STRETCH_SECONDS, STRETCH_ROWS = 86_400, 20_000
#: Fixed: header fields that a 304 response may not replace in the stored response (RFC 9111, section 3.2, and hop-by-hop fields).
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-location", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Lower-case host without scheme, user, default port and www. or m.; path without closing slashes; query without
    utm_ and ref parameters, the rest sorted; no fragment. Null stays null."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def lower_names(headers: Column) -> Column:
    """The map with lower-case names. Fields whose names differ in case only are one: their values, in the order of the names as
    written, joined by a comma. A null value counts as empty beside others; a null map is an empty one."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    values = lambda n: F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == n), lambda e: e["value"])
    one = lambda n: F.when(F.size(values(n)) == 1, values(n)[0]).otherwise(F.array_join(F.transform(values(n), lambda v: F.coalesce(v, F.lit(""))), ", "))
    return F.map_from_arrays(names, F.transform(names, one))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored response's headers, with those of the 304 that may replace them; names as in lower_names()."""
    allowed = F.map_filter(lower_names(fresh), lambda k, _: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(lower_names(stored), lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def resolve_revisits(captures: DataFrame, stretch_seconds: int = STRETCH_SECONDS, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """One row for each capture: id, canonical, kind, ts, state, resolved_id, digest, headers.

    state of a revisit: `resolved`; `mismatch` if the latest earlier response's validators differ (etag where both
    have one, compared weakly; else last_modified where both have one; and digest where both have one); `no_validator` if
    nothing could be compared; `missing` if there is no earlier response. A response is `full`. Unresolved revisits keep their own headers and have a
    null resolved_id. Earlier is by (ts, id); a null ts is before all others. A capture without URL is `missing` or `full`
    and is never joined; one with a null kind counts as a response. Repeated rows each have their row. Other columns are left out,
    whatever their names; values may be of any length. An empty table gives an empty result.
    """
    rows = captures.select(
        "id", F.coalesce("kind", F.lit("response")).alias("kind"), F.col("ts").cast("long").alias("ts"), "etag", "last_modified", "digest", "headers",
        canonical_url(F.col("url")).alias("canonical"),
    )
    # captures without URL are dealt by id, as they are never joined
    key = F.coalesce("canonical", F.concat(F.lit(" "), F.coalesce(F.col("id").cast("string"), F.lit("")))).alias("key")
    day = F.coalesce(F.floor(F.col("ts") / F.lit(stretch_seconds)), F.lit(-(1 << 40))).alias("day")
    full = F.when((F.col("kind") == "response") & F.col("canonical").isNotNull(), F.struct("ts", "id", "etag", "last_modified", "digest", "headers"))
    rows = rows.select("*", key, day, full.alias("full"))
    # a stretch with very many captures (a hot address's hot day) is cut finer, down to a second
    hot = rows.groupBy("key", "day").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > stretch_rows)
    hot = hot.select("key", "day", F.least(F.ceil(F.col("n") / stretch_rows), F.lit(stretch_seconds)).alias("cuts"))
    part = F.floor((F.col("ts") - F.col("day") * stretch_seconds) * F.coalesce("cuts", F.lit(1)) / stretch_seconds)
    rows = rows.join(hot, ["key", "day"], "left").withColumn("stretch", F.struct("day", F.coalesce(part, F.lit(0)).alias("part"))).drop("day", "cuts")
    # the response itself is left out of ordering keys: a map can't be compared
    last = rows.groupBy("key", "stretch").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.struct("ts", "id"))).alias("last"))
    earlier = W.partitionBy("key").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("key", "stretch", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    within = W.partitionBy("key", "stretch").orderBy(F.asc_nulls_first("ts"), F.asc_nulls_first("id"), F.desc("kind")).rowsBetween(W.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last("full", ignorenulls=True).over(within)).drop("full")
    found = near.join(carried, ["key", "stretch"], "left").withColumn("r", F.coalesce("near", "carried"))
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    both = lambda c: F.col(c).isNotNull() & F.col(f"r.{c}").isNotNull()
    tag = F.when(both("etag"), weak(F.col("etag")) == weak(F.col("r.etag"))).when(both("last_modified"), F.col("last_modified") == F.col("r.last_modified"))
    body = F.when(both("digest"), F.col("digest") == F.col("r.digest"))
    state = (
        F.when(F.col("kind") != "revisit", "full").when(F.col("r").isNull() | F.col("canonical").isNull(), "missing")
        .when(tag.isNull() & body.isNull(), "no_validator").when(F.coalesce(tag, F.lit(True)) & F.coalesce(body, F.lit(True)), "resolved").otherwise("mismatch")
    )
    done = F.col("state") == "resolved"
    return found.withColumn("state", state).select(
        "id", "canonical", "kind", "ts", "state", F.when(done, F.col("r.id")).alias("resolved_id"),
        F.when(done, F.col("r.digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(done, merged_headers(F.col("r.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def with_payload(resolved: DataFrame, bodies: DataFrame, id: str = "id", payload: str = "payload") -> DataFrame:
    """Adds the payload of each full or resolved capture, from bodies (id, payload) of full responses; null otherwise."""
    holder = F.when(F.col("state") == "full", F.col("id")).otherwise(F.col("resolved_id"))
    own = bodies.select(F.col(id).alias("__body"), F.col(payload).alias("payload"))
    return resolved.drop("payload").withColumn("__holder", holder).join(own, F.col("__holder") == F.col("__body"), "left").drop("__holder", "__body")


def read_warc(binary: DataFrame, content: str = "content") -> DataFrame:
    """Captures (id is the record id) of uncompressed or per-record gzip WARC files, one file a row: columns as above, payload and problem.

    Records other than response and revisit are passed over. What can't be read doesn't stop the rest: a record that is cut off, or
    lacks its length or a date, is a row whose problem says so and which has what could be read; after a gzip member that is broken, or a
    record without length, the file ends. Repeated fields are joined by a comma. A null file has no records.
    Files are read whole, one at a time in each task.
    """

    def unpacked(raw: bytes) -> tuple[bytes, bool]:
        if raw[:2] != b"\x1f\x8b":
            return raw, False
        parts, rest = [], raw
        while rest:
            d = zlib.decompressobj(31)
            try:
                parts.append(d.decompress(rest))
            except zlib.error:
                return b"".join(parts), True
            if not d.eof:
                return b"".join(parts), True
            rest = d.unused_data
        return b"".join(parts), False

    def fields_of(head: str) -> dict:
        out: dict = {}
        for line in head.split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon and name.strip():
                name = name.strip().lower()
                out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
        return out

    def records(raw: bytes):
        raw, cut = unpacked(raw)
        at = 0
        while raw[at:].strip():
            head = raw.find(b"\r\n\r\n", at)
            fields = fields_of(raw[at : head if head >= 0 else len(raw)].decode("utf-8", "replace"))
            length = fields.get("content-length", "")
            if head < 0 or not length.isascii() or not length.isdigit():
                yield fields, b"", "cut off" if head < 0 else "no length"
                return
            end = head + 4 + int(length)
            yield fields, raw[head + 4 : end], "cut off" if end > len(raw) else None
            at = end + 4
        if cut:
            yield {}, b"", "broken gzip"

    def seconds(date: str | None) -> int | None:
        try:
            when = datetime.fromisoformat((date or "").replace("Z", "+00:00"))
        except ValueError:
            return None
        return math.floor((when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp())

    def run(frames):
        import pandas as pd

        for frame in frames:
            for raw in frame[content]:
                rows = []
                for fields, block, problem in records(raw if isinstance(raw, bytes) else bytes(raw or b"")):
                    if not problem and fields.get("warc-type") not in ("response", "revisit"):
                        continue
                    head, _, body = block.partition(b"\r\n\r\n")
                    http, ts = fields_of(head.decode("latin-1")), seconds(fields.get("warc-date"))
                    problem = problem or ("no date" if ts is None else None)
                    rows.append((fields.get("warc-record-id"), fields.get("warc-target-uri"), ts, fields.get("warc-type"), http.get("etag"), http.get("last-modified"), fields.get("warc-payload-digest"), http, body, problem))
                made = pd.DataFrame(rows, columns=["id", "url", "ts", "kind", "etag", "last_modified", "digest", "headers", "payload", "problem"])
                made["ts"] = made["ts"].astype("Int64")
                yield made

    return binary.select(content).mapInPandas(run, "id string, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, payload binary, problem string")
