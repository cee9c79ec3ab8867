"""From raw documents to encoded training data: five stages, each one of the training-data operators.

Part of subpackage llm and deleted with it. Every stage reads all that its predecessor kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import bpe, langid, mixing, secrets, simhash
from framelake.llm.queries import vocabulary
from framelake.llm.runtime import checkpoint, dropped, few, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not established (letters too few, or posterior too low) go; lang becomes the language found.

    Null, empty and letterless texts go. lang is what the model is fitted on, so it is no evidence besides. Rows with a null id are
    documents like any other; repeated rows stay or go together; an empty table stays empty.
    """
    model = langid.fit(docs, "text", "lang", "doc_id")
    keyed = docs.select(F.struct("doc_id", "lang").alias("key"), "text", "source")
    found = langid.identify(keyed, model, "key", "text", F.lit(None).cast("string"), F.col("source")).select("key.doc_id", "key.lang", "text_hash", "lang_id", "posterior", "accepted")
    # rows of equal id and text, whose sources may differ, share the likelier language
    sure = F.when(F.col("accepted"), F.struct("posterior", "lang_id"))
    each = found.groupBy("doc_id", "text_hash").agg(F.max_by("lang_id", sure).alias("new"), F.max(sure).isNotNull().alias("stays"), F.min("lang").alias("low"), F.max("lang").alias("high"), F.count("lang").alias("had"), F.count(F.lit(1)).alias("n"))
    # most texts are in the language they are said to be in: only the others are joined to the documents
    same = (F.col("low") == F.col("new")) & (F.col("high") == F.col("new")) & (F.col("had") == F.col("n"))
    other = checkpoint(each.where(~F.col("stays") | ~F.coalesce(same, F.lit(False))).select(F.col("doc_id").alias("__id"), "text_hash", F.when(F.col("stays"), F.col("new")).alias("__lang"), F.col("stays").alias("__stays")))
    joined = docs.join(few(other), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("text_hash")), "left").where(F.coalesce("__stays", F.lit(True)))
    return joined.withColumn("lang", F.coalesce("__lang", "lang")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose sets of five-word shingles are similar by 0.8 or more the document with the smallest id stays.

    Operator 4's fingerprints and links come first, checked by the sets; pairs whose fingerprints differ in more bits are found exactly after that. Nulls, empty texts, ties, repeated rows, an empty table: as simhash.kept() says.
    """
    return simhash.kept(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark and n_chars follows; every document stays. Nulls, repeated rows, an empty table: as secrets.redacted() says."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the Pfair schedule: the written files hold consecutive ranges of it. None is dropped.

    The text's hash tells rows apart that have no id or share one; repeated rows stand next to one another. A null source is a source, null
    and empty texts are documents like any other; an empty table stays empty.
    """
    return mixing.ordered(docs.withColumn("text_hash", F.xxhash64("text")), "source", ["doc_id", "text_hash"]).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, and digests of them and of what they decode to, with its place in the mixed order.

    Reading files again doesn't keep the order of rows, so the places that the mixing stage put them by are found once more from
    the same columns. A null or empty text has no ids. Repeated rows have a row and a place each; an empty table gives no rows.
    """
    ranks, pattern = vocabulary()
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text_hash", "text"), ranks, pattern)
    coded = coded.select("doc_id", "lang", "source", "text_hash", *bpe.digests(coded), F.sha2("decoded", 256).alias("decoded_sha256"))
    return mixing.with_places(coded, docs, "source", ["doc_id", "text_hash"]).drop("text_hash")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("encode", encode),
]

#: No stage but the redaction of base spans can be put in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each but the last is written as Parquet in the shared folder and reread. The last of these folders stays, as the
    result is read from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            dropped(spark, before)
        before = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
