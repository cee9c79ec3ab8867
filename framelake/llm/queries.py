"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jpeg, langid, lengths, mixing, revisits, secrets, shards, simhash, topk

TOKENIZER = "byte_bpe_50k.tiktoken"


def vocabulary(path: str | None = None) -> tuple[dict[bytes, int], str]:
    """Ranks and word pattern; path: another file of ranks."""
    import public_tokenizers

    return bpe.load_ranks(path or public_tokenizers.path(TOKENIZER)), public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = vocabulary()
    done = bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    return done.select("doc_id", *bpe.digests(done), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents")).select(*secrets.digests())


def op3_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = jpeg.stored_features(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return media.select("doc_id", "n_bytes", *jpeg.digests())


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mixed(docs, "source", ["doc_id"]).select("doc_id", "source", "block", "slot", "mix_pos")


def op6_dual_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", topk.whole_numbers("embedding").alias("whole"))
    return topk.top_products(rows, F.col("vec_id") % 50 == 0)


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(_table(spark, sf_dir, "documents"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures from crawled pages, one a minute in the order of page_id. Every fourth is written as a not-modified revisit.
    The etag names the canonical address and its markup's language; one page in seven has none."""
    url, lang = revisits.canonical_url(F.col("url")), F.coalesce(F.regexp_extract("html", '<html lang="([a-z]*)"', 1), F.lit(""))
    kind = F.when(F.col("page_id") % 4 == 3, "revisit").otherwise("response")
    tag = F.when(F.col("page_id") % 7 != 0, F.concat(F.lit('"'), F.substring(F.md5(F.concat_ws("|", url, lang).cast("binary")), 1, 16), F.lit('"')))
    modified = F.concat(F.lit("day "), F.expr("page_id div 20000").cast("string"))
    header = F.map_from_entries(F.array(
        F.struct(F.lit("date"), F.concat(F.lit("minute "), F.col("page_id").cast("string"))), F.struct(F.lit("content-language"), lang),
        F.struct(F.lit("content-length"), F.when(kind == "revisit", F.lit("0")).otherwise(F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"))),
    ))
    return pages.select(
        F.col("page_id").alias("id"), "url", (F.col("page_id") * 60).alias("ts"), kind.alias("kind"), tag.alias("etag"), modified.alias("last_modified"),
        F.when(kind == "response", F.sha2(F.coalesce("html", F.lit("")), 256)).alias("digest"), header.alias("headers"),
    )


def op8_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = revisits.resolve_revisits(page_captures(_table(spark, sf_dir, "pages")))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "; ")
    return done.select(F.col("id").alias("page_id"), "canonical", "kind", "state", F.col("resolved_id"), "digest", listed.alias("headers"))


OP8_SQL = r"""
WITH c AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages
), d AS (
  SELECT page_id, html,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^(www|m)\.', '') AS host,
    regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)'))) AS kept
  FROM c
), e AS (
  SELECT page_id, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical,
    coalesce(regexp_extract(html, '<html lang="([a-z]*)"', 1), '') AS lang,
    CASE WHEN page_id % 4 = 3 THEN 'revisit' ELSE 'response' END AS kind, coalesce(html, '') AS html
  FROM d
), f AS (
  SELECT *, CASE WHEN page_id % 7 <> 0 THEN '"' || substr(md5(canonical || '|' || lang), 1, 16) || '"' END AS etag, page_id // 20000 AS modified,
    CASE WHEN kind = 'response' THEN sha256(html) END AS digest
  FROM e
), g AS (
  SELECT *, max(CASE WHEN kind = 'response' THEN page_id END) OVER (PARTITION BY canonical ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f
), h AS (
  SELECT g.*, r.page_id AS rid, r.digest AS rdigest, r.lang AS rlang, r.html AS rhtml,
    CASE WHEN g.kind <> 'revisit' THEN 'full' WHEN r.page_id IS NULL THEN 'missing'
      WHEN CASE WHEN g.etag IS NOT NULL AND r.etag IS NOT NULL THEN g.etag = r.etag ELSE g.modified = r.modified END THEN 'resolved' ELSE 'mismatch' END AS state
  FROM g LEFT JOIN f r ON r.page_id = g.before
)
SELECT page_id, canonical, kind, state, CASE WHEN state = 'resolved' THEN rid END AS resolved_id,
  CASE WHEN state = 'resolved' THEN rdigest ELSE digest END AS digest,
  'content-language=' || lang || '; content-length=' || CASE WHEN state = 'resolved' THEN strlen(rhtml) WHEN kind = 'revisit' THEN 0 ELSE strlen(html) END || '; date=minute ' || page_id AS headers
FROM h
"""


def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = vocabulary()
    counted = bpe.count_tokens(_table(spark, sf_dir, "documents").select("text"), ranks, pattern)
    from .runtime import checkpoint

    return lengths.answers(checkpoint(lengths.histogram(counted)))


def op10_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (no declaration, their source as the host) and pages (markup's language, URL's host and suffix), each table by itself;
    the model is fitted on the documents' labels, which are evidence nowhere."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    model, null = langid.fit(docs, "text", "lang", "doc_id"), F.lit(None)
    shown = pages.select("page_id", langid.markup_text(F.col("html")).alias("text"), langid.markup_language(F.col("html")).alias("declared"), langid.address_host(F.col("url")).alias("host"))
    out = ["lang_id", "posterior", "letters", "text_lang", "accepted"]
    of_docs = langid.identify(docs, model, "doc_id", "text", null.cast("string"), F.col("source")).select("doc_id", null.cast("long").alias("page_id"), *out)
    of_pages = langid.identify(shown, model, "page_id", "text", F.col("declared"), F.col("host")).select(null.cast("long").alias("doc_id"), "page_id", *out)
    return of_docs.union(of_pages)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(r.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0
), n AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 5
"""


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_bpe_roundtrip, op2_secret_scan, op3_jpeg_media, op4_simhash_dedup, op5_pfair_mix, op6_dual_tree_topk, op7_kd_shards,
        op8_revisit_resolution, op9_length_histogram, op10_language_fusion,
    )}


def oracle_sql() -> dict:
    return {"op6_dual_tree_topk": OP6_SQL, "op8_revisit_resolution": OP8_SQL}
