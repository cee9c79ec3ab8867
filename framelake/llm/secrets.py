"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Base spans come from three fixed patterns. Their values, and other credential-shaped tokens, are candidates: hashed
and aggregated over the whole corpus by distinct repositories and owners. A candidate that at least EXAMPLE_OWNERS owners hold, or
several owners in at least EXAMPLE_REPOS repositories, is a widely copied example; any other, one owner's however many repositories
repeat it, looks live. Credential-shaped tokens outside the base patterns become spans of kind `live` where they look live. Base
spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import FEW_ROWS, checkpoint

EXAMPLE_OWNERS, EXAMPLE_REPOS = 4, 10
#: Fixed patterns, by kind in the order in which spans with one start are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the run's first AKIA decides: if it is too short, so are all later ones in the run
HEX = r"[0-9a-f]{32,}"  # runs are maximal, so the length can stand in the pattern
SHAPED = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+"
KINDS = ("assign", "access", "hex", "live")
_VALUE = r"""^[^:=]*[:=]\x20*["']?"""
#: Spans of a text that are placed by one running sum.
CHUNK = 256
_SPANS = "array<struct<start:int,ord:int,kind:string,end:int,value:string>>"


def _found(text: Column, kind: str, pattern: str) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points, end exclusive.

    split() cuts at the same matches that regexp_extract_all() returns, so the lengths of pieces and matches add up
    to positions.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    both = F.zip_with(F.transform(F.slice(pieces, 1, F.size(whole)), lambda p: F.char_length(p)), whole, lambda n, m: F.struct(n.alias("gap"), m.alias("m"), (n + F.char_length(m)).alias("both")))
    return F.when(text.rlike(pattern), _placed(both, kind)).otherwise(F.array().cast(_SPANS))


def _placed(both: Column, kind: str) -> Column:
    """Spans of (gap, match, both lengths), by running sums.

    Appending to an array copies it, so sums run within runs of CHUNK spans, and over the runs; a text with n spans costs
    n * CHUNK + (n / CHUNK) squared copies.
    """
    none = F.array().cast(_SPANS)
    # inner arrays are named once: a column stands for its whole expression wherever it is used
    starts = lambda chunks: F.aggregate(
        chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, c: F.struct((acc["at"] + F.aggregate(c, F.lit(0), lambda n, x: n + x["both"])).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
    )["all"]

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = acc["at"] + x["both"]
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    inner = lambda chunk, start: F.aggregate(chunk, F.struct(start.alias("at"), none.alias("spans")), step)["spans"]
    cut = lambda whole: F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / CHUNK).cast("int")), lambda i: F.slice(whole, i * CHUNK + 1, CHUNK))
    # a transform over one element names its value
    named = lambda value, f: F.transform(F.array(value), f)[0]
    return named(both, lambda whole: named(cut(whole), lambda chunks: F.flatten(F.zip_with(chunks, starts(chunks), inner))))


def scanned(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by base (its base spans) and shaped (credential-shaped tokens outside them); null: empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    value = F.regexp_replace
    assign = F.transform(_found(t, "assign", ASSIGN), lambda s: s.withField("value", value(s["value"], F.lit(_VALUE), F.lit(""))))
    base = F.concat(F.filter(assign, lambda s: F.char_length(s["value"]) >= 8), _found(t, "access", ACCESS), _found(t, "hex", HEX))
    mixed = lambda s: s["value"].rlike("[0-9].*[0-9].*[0-9].*[0-9]") & s["value"].rlike("[A-Za-z].*[A-Za-z].*[A-Za-z].*[A-Za-z]")
    out = df.withColumn("base", F.array_sort(base)).withColumn("shaped", F.filter(_found(t, "live", SHAPED), mixed))
    # runs of access and hex characters are part of one token, so it shows them itself; assigned values may be part of it or overlap it
    assigned = F.filter("base", lambda b: b["kind"] == "assign")
    apart = lambda s: ~s["value"].rlike(f"{ACCESS}|{HEX}") & ~F.exists("__assigned", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return out.withColumn("__assigned", assigned).withColumn("shaped", F.filter("shaped", apart)).drop(text, "__assigned")


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos) of candidates (hash, owner, repo), each counted once; null owners and repos count as one.

    Distinct by three grouped aggregations, each with partial sums, so that a value held by a third of all rows is
    a few rows from each task.
    """
    once = candidates.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(df: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row for each row of df: id, text_hash, base and spans (arrays of start, ord, kind, end, value, by start and
    kind), n_live and n_example (candidates by verdict).

    Null and empty texts have no spans. Null ids, owners and repositories are values like any other; repeated rows
    each have their row. Other columns are left out, whatever their names. An empty table gives an empty result.
    """
    own = df.select(F.col(id).alias("id"), F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("__text"))
    rows = checkpoint(scanned(own, "__text").withColumn("row", F.monotonically_increasing_id()))
    # only rows with candidates go through the corpus-wide part
    each = rows.where((F.size("base") > 0) | (F.size("shaped") > 0)).select("row", "owner", "repo", F.explode(F.concat("base", "shaped")).alias("s"))
    each = each.withColumn("hash", F.sha2(F.col("s.value"), 256))
    known = ownership(each.select("hash", "owner", "repo"))
    judged = each.join(known, "hash").withColumn("live", (F.col("n_owners") < example_owners) & ((F.col("n_owners") < 2) | (F.col("n_repos") < example_repos)))
    by_row = judged.groupBy("row").agg(
        F.collect_list(F.when((F.col("s.kind") == "live") & F.col("live"), F.col("s"))).alias("added"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"),
    )
    zero = F.lit(0).cast("long")
    return rows.join(by_row, "row", "left").select(
        F.col("id").alias(id), "text_hash", "base",
        F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPANS)))).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"),
    )


def digests(id: str = "doc_id") -> list:
    """The query's columns from those of find_secrets()."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return [id, n("assign"), n("access"), n("hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), "n_live", "n_example"]


def redacted(df: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id", mark: str = "<secret>", length: str | None = "n_chars") -> DataFrame:
    """df with every span of find_secrets() replaced by mark; overlapping spans become one mark.

    length: a column that is set to the new text's code points where text changes. Rows and columns stay as they are
    otherwise. Widely copied examples of base kinds are replaced too. Null and empty texts stay as they are; rows with a null id are rows
    like any other; repeated rows are changed alike. An empty table stays empty.
    """
    spans = find_secrets(df, id, text, owner, repo).where(F.size("spans") > 0)
    places = F.transform("spans", lambda s: F.struct(s["start"], s["end"]))
    cuts = checkpoint(spans.select(F.col(id).alias("__id"), "text_hash", places.alias("spans")).dropDuplicates(["__id", "text_hash"]))
    many = cuts.agg(F.coalesce(F.sum(F.size("spans") + 8), F.lit(0)).alias("n")).first()["n"]
    # texts with spans are few: while their places are, the others' texts needn't move
    cuts = F.broadcast(cuts) if many <= FEW_ROWS else cuts
    step = lambda acc, s: F.when(
        s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))
    ).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(F.struct(acc["at"].alias("s"), s["start"].alias("e")))).alias("parts")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("parts"))
    keep = F.aggregate("spans", none, step)
    piece = F.transform(F.col("__keep.parts"), lambda p: F.substring(F.col(text), p["s"] + 1, p["e"] - p["s"]))
    tail = F.substring(F.col(text), F.col("__keep.at") + 1, F.char_length(F.col(text)))
    new = F.concat(F.array_join(piece, mark), F.lit(mark), tail)
    joined = df.withColumn("__h", F.xxhash64(F.col(text))).join(cuts, F.col(id).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("text_hash")), "left")
    out = joined.withColumn("__keep", F.when(F.col("spans").isNotNull(), keep)).withColumn(text, F.when(F.col("spans").isNotNull(), new).otherwise(F.col(text)))
    if length in df.columns:
        out = out.withColumn(length, F.when(F.col("spans").isNotNull(), F.char_length(text).cast(df.schema[length].dataType)).otherwise(F.col(length)))
    return out.select(*df.columns)
