"""Language ID by Bayesian evidence fusion.

Four pieces of evidence, multiplied: the text's likelihood under each language's byte trigrams; the declared markup language and
the address suffix, each by how often it goes with a language; and a prior for the host, its counts smoothed towards those of
its domain (the last two labels) and these towards the whole corpus's. The trigram model is fitted on a bounded sample
of labelled rows (SAMPLE_ROWS a language, every labelled language). Counts for declarations, suffixes, domains and hosts are
grouped aggregations over all rows, of what the text alone says; labels take no part in them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .runtime import FEW_ROWS, bounded_batches, checkpoint, few

#: Rows of each language that the model is fitted on; trigram buckets.
SAMPLE_ROWS, BUCKETS = 500, 1 << 15
#: Trigrams that count as independent: longer texts are weighed as if they had this many (README has figures). Rows that a coarser level of
#: counts is worth.
EVIDENCE, WEIGHT = 20, 20.0
#: A row is rejected below this posterior, or with too little that could be a language's text.
LEAST_POSTERIOR, LEAST_LETTERS = 0.5, 0.25
_A, _B = 0x9E3779B1, 0x85EBCA6B


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the lower-case text's byte trigrams, a blank before and after; digits and ASCII signs count as blanks."""
    raw = np.frombuffer(f" {(text or '').lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    letter = (raw >= 128) | ((raw >= 97) & (raw <= 122))
    raw = np.where(letter, raw, 32).astype(np.uint32)
    raw = raw[np.concatenate(([True], letter[1:] | letter[:-1]))]  # one blank for a run of them
    key = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
    return (key * np.uint32(_A) ^ (key >> np.uint32(7)) * np.uint32(_B)) >> np.uint32(32 - 15)


def letters(text: str | None) -> float:
    """Share of letters among the characters that aren't white space; 0 for none."""
    solid = "".join((text or "").split())
    return sum(map(str.isalpha, solid)) / len(solid) if solid else 0.0


class Model:
    """languages (at least one), and log likelihoods of trigrams, add-a-tenth smoothed, kept for the buckets that occur in a language."""

    def __init__(self, languages: list[str], language: np.ndarray, bucket: np.ndarray, count: np.ndarray):
        self.languages = languages
        order = np.argsort(language, kind="stable")
        language, self.bucket = language[order], bucket[order].astype(np.int32)
        total = np.bincount(language, weights=count[order], minlength=len(languages)) + 0.1 * BUCKETS
        self.unseen = np.log(0.1 / total)
        self.more = (np.log((count[order] + 0.1) / total[language]) - self.unseen[language]).astype(np.float32)
        self.starts = np.searchsorted(language, np.arange(len(languages) + 1))

    def score(self, text: str | None) -> np.ndarray:
        """Log likelihood of each language, weighed down to EVIDENCE trigrams."""
        found = trigrams(text)
        if not len(found):
            return np.zeros(len(self.languages))
        had = np.bincount(found, minlength=BUCKETS)[self.bucket] * self.more.astype(np.float64)
        upto = np.concatenate(([0.0], np.cumsum(had)))
        total = upto[self.starts[1:]] - upto[self.starts[:-1]] + len(found) * self.unseen
        return total * min(1.0, EVIDENCE / len(found))


def fit(labelled: DataFrame, text: str, label: str, id: str, rows: int = SAMPLE_ROWS) -> Model:
    """Fits the trigram model on at most `rows` rows of each label, those with the smallest hashes of their id.

    Counting runs on the executors; the labels and their counts by bucket reach the driver. Null labels are passed over; without any
    label the model knows one language, `und`.
    """
    bounded_batches(labelled.sparkSession)
    own = labelled.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("__l"), F.col(id).alias("__i"), F.col(text).alias("__t"))
    counts = checkpoint(own.groupBy("__l").agg(F.count(F.lit(1)).alias("__n")))
    names = sorted(r["__l"] for r in counts.collect())
    if not names:
        return Model(["und"], *(np.zeros(0, np.int64) for _ in range(3)))
    place = F.pmod(F.xxhash64("__i", F.lit(11)), F.lit(1 << 30))
    # a little more than enough by the hash first, so that no window holds all rows of a label
    known = F.broadcast(counts) if len(names) <= FEW_ROWS else counts
    drawn = own.select("__l", "__i", place.alias("__h")).join(known, "__l").where(F.col("__h") < (1.5 * rows + 20) / F.col("__n") * (1 << 30))
    picked = drawn.withColumn("__r", F.row_number().over(W.partitionBy("__l").orderBy("__h", "__i"))).where(F.col("__r") <= rows)
    # at most `rows` ids a label: texts are picked by them where they are
    picked = few(checkpoint(picked.select(F.col("__l").alias("__pl"), F.col("__i").alias("__pi")).distinct()))
    sample = own.join(picked, (F.col("__l") == F.col("__pl")) & F.col("__i").eqNullSafe(F.col("__pi")), "left_semi").select("__l", "__t")
    at = {x: i for i, x in enumerate(names)}

    def run(batches):
        for batch in batches:
            held: dict = {}
            for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[at[x]] = held.get(at[x], 0) + np.bincount(trigrams(t), minlength=BUCKETS)
            for i, total in held.items():
                (b,) = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), i), pa.int32()), pa.array(b, pa.int32()), pa.array(total[b], pa.int64())], ["i", "b", "n"])

    found = sample.mapInArrow(run, "i int, b int, n long").groupBy("i", "b").agg(F.sum("n").alias("n")).toArrow()
    return Model(names, *(found.column(x).to_numpy().astype(np.int64) for x in ("i", "b", "n")))


def _text_scores(df: DataFrame, model: Model, text: str) -> DataFrame:
    """df with __ll and __letters in place of the text. The model's size is bounded by labels and their sampled rows."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != text), T.StructField("__ll", T.ArrayType(T.DoubleType())), T.StructField("__letters", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            ll = np.array([own.score(t) for t in texts]).reshape(len(texts), len(own.languages))
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * ll.shape[1], pa.int32()), pa.array(ll.ravel()))
            keep = [i for i, x in enumerate(batch.schema.names) if x != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), made, pa.array([letters(t) for t in texts], pa.float64())], schema.names)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def markup_language(html: Column) -> Column:
    """The primary subtag of the lang attribute of the html element, lower-case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1)), F.lit(""))


def markup_text(html: Column) -> Column:
    """What markup shows: without comments, scripts, styles and tags, character references as blanks; null stays null."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&#?[A-Za-z0-9]{1,31};", " ")


def address_host(url: Column) -> Column:
    """The lower-case host of a URL or host name; null stays null."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]*)", 1))


def address_suffix(host: Column) -> Column:
    """What follows the host's last dot; null without a dot."""
    return F.nullif(F.regexp_extract(host, r"\.([A-Za-z]+)$", 1), F.lit(""))


def address_domain(host: Column) -> Column:
    """The host's last two labels; null without a dot."""
    return F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit(""))


def _tally(scored: DataFrame, key: str, n: int, out: str) -> DataFrame:
    """(key, out): for each value, rows by the language that their text alone speaks for. Null values and rows without letters don't count."""
    each = scored.where(F.col(key).isNotNull() & F.col("__best").isNotNull()).groupBy(key, "__best").agg(F.count(F.lit(1)).cast("double").alias("n"))
    by = each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("__best", "n"))).alias("by"))
    return by.select(key, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.col("by")[i], F.lit(0.0))).alias(out))


def _sum(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _shares(counts: Column, coarse: Column) -> Column:
    """Shares of counts, smoothed by WEIGHT rows dealt out by coarse."""
    return F.zip_with(counts, coarse, lambda c, w: (c + w * WEIGHT) / (_sum(counts) + WEIGHT))


def _likelihoods(tally: DataFrame, key: str, n: int, out: str) -> DataFrame:
    """(key, out): the log probability of each value given each language, smoothed by WEIGHT rows dealt out as the value is over all languages."""
    spoken = tally.agg(*(F.sum(F.col("c")[i]).alias(f"s{i}") for i in range(n))).select(F.array(*(F.col(f"s{i}") for i in range(n))).alias("spoken"))  # one row
    each = lambda c, w: F.log((c + F.lit(WEIGHT) * _sum(F.col("c")) / _sum(F.col("spoken"))) / (w + WEIGHT))
    return tally.crossJoin(F.broadcast(spoken)).select(key, F.zip_with("c", "spoken", each).alias(out))


def identify(df: DataFrame, model: Model, id: str, text: str, declared: Column, host: Column) -> DataFrame:
    """(id, text_hash, lang_id, posterior, letters, text_lang, accepted), one row for each row of df; text_lang is what the text alone says (null without letters).

    Null or empty declarations, hosts and texts give no evidence of their kind; a host without a dot has no domain and no suffix. A row is
    accepted if its posterior reaches LEAST_POSTERIOR and letters LEAST_LETTERS. Ties go to the language first in the
    alphabet. Repeated rows each have their row. Other columns are left out. An empty table gives an empty result.
    """
    n = len(model.languages)
    zero = F.array(*[F.lit(0.0)] * n)
    own = df.select(F.col(id).alias("__id"), F.xxhash64(F.col(text)).alias("text_hash"), F.nullif(F.lower(declared), F.lit("")).alias("__declared"), F.nullif(host, F.lit("")).alias("__host"), F.col(text).alias("__text"))
    scored = _text_scores(own, model, "__text")
    best = F.array_position(F.col("__ll"), F.array_max("__ll")).cast("int") - 1
    scored = scored.withColumn("__best", F.when(F.col("__letters") > 0, best))
    scored = checkpoint(scored.withColumn("__suffix", address_suffix(F.col("__host"))).withColumn("__domain", address_domain(F.col("__host"))))
    had = {r["__best"]: r["n"] for r in scored.where("__best IS NOT NULL").groupBy("__best").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = [had.get(i, 0) + 1.0 for i in range(n)]
    base = F.array(*(F.lit(x / sum(whole)) for x in whole))
    domains = _tally(scored, "__domain", n, "c").select("__domain", _shares(F.col("c"), base).alias("__dp"))
    hosts = _tally(scored, "__host", n, "c").withColumn("__domain", address_domain(F.col("__host"))).join(domains, "__domain", "left")
    hosts = hosts.select("__host", F.transform(_shares(F.col("c"), F.coalesce("__dp", base)), lambda x: F.log(x)).alias("__prior"))
    suffixes = _likelihoods(_tally(scored, "__suffix", n, "c"), "__suffix", n, "__of_suffix")
    given = _likelihoods(_tally(scored, "__declared", n, "c"), "__declared", n, "__of_declared")
    joined = scored.join(hosts, "__host", "left").join(suffixes, "__suffix", "left").join(given, "__declared", "left")
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    prior = F.coalesce("__prior", F.transform(base, lambda x: F.log(x)))
    joined = joined.withColumn("__sum", plus(plus(plus(F.col("__ll"), prior), F.coalesce("__of_suffix", zero)), F.coalesce("__of_declared", zero)))
    top = F.array_max("__sum")
    names = F.array(*(F.lit(x) for x in model.languages))
    out = joined.select(
        F.col("__id").alias(id), "text_hash", F.element_at(names, F.array_position(F.col("__sum"), top).cast("int")).alias("lang_id"),
        (1.0 / _sum(F.transform("__sum", lambda x: F.exp(x - top)))).alias("posterior"), F.col("__letters").alias("letters"),
        F.get(names, F.col("__best")).alias("text_lang"),
    )
    return out.withColumn("accepted", (F.col("posterior") >= LEAST_POSTERIOR) & (F.col("letters") >= LEAST_LETTERS))
