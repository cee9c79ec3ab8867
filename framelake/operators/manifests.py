"""Manifests: what a folder should hold, against what it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Fixed values.
DIGEST, CLEAN_PATH, SLUG = "^[0-9a-f]{64}$", r"^(?!/)(?!.*(?:^|/)\.{0,2}(?:/|$))[^\\\x00]+$", "^[a-z0-9]+(?:-[a-z0-9]+)*$"


def differences(told: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """(name, problem) of members missing, unexpected, or of another size or digest; none is a match. Both have name, bytes, digest."""
    e, f = (d.select(F.col(name).alias(p + name), F.col("bytes").alias(p + "bytes"), F.col("digest").alias(p + "digest")) for d, p in ((told, "e_"), (found, "f_")))
    both = e.join(f, F.col("e_" + name) == F.col("f_" + name), "full")
    unlike = lambda c: ~F.col("e_" + c).eqNullSafe(F.col("f_" + c))
    problem = (
        F.when(F.col("f_" + name).isNull(), "missing").when(F.col("e_" + name).isNull(), "unexpected").when(unlike("bytes"), "wrong_size").when(unlike("digest"), "wrong_digest")
    )
    return both.select(F.coalesce("e_" + name, "f_" + name).alias(name), problem.alias("problem")).where("problem IS NOT NULL")


def malformed(told: DataFrame, roles: list[str]) -> DataFrame:
    """(position, problem) of rows of a manifest (position, role, path, bytes, digest) that break its rules: roles in their order, clean
    relative paths, each path once, positive sizes, digests in lower-case hex."""
    # get(), as element_at() gives the last role for a null place
    wanted = F.get(F.array(*map(F.lit, roles)), F.when(F.col("position").between(0, len(roles) - 1), F.col("position").cast("int")))
    often = told.groupBy("path").agg(F.count(F.lit(1)).alias("__n"))
    known = lambda c: F.coalesce(c, F.lit(False))
    problem = (
        F.when(~known(F.col("role") == wanted), "role").when(~known(F.col("path").rlike(CLEAN_PATH)), "path").when(F.col("__n") > 1, "repeated_path")
        .when(~known(F.col("bytes") > 0), "bytes").when(~known(F.col("digest").rlike(DIGEST)), "digest")
    )
    return told.join(often, "path", "left").select("position", problem.alias("problem")).where("problem IS NOT NULL")


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, digest) of the files under a folder, paths relative to it. Spark's source leaves out empty files, which no manifest may list."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    relative = F.regexp_replace(F.col("path"), "^.*?" + path.rstrip("/").replace(".", r"\.") + "/", "")
    return files.select(relative.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def catalog_problems(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(file, position, problem) of catalogue files: {schema_version, recordings: [{slug, title, subtitle, manifest}]}, no other keys, at least one recording, slugs of the
    right form and each once, texts not empty (100 and 140 characters at most), manifest named after the slug. position is null for the whole file's problems."""
    entry = "array<map<string,string>>"
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    whole = whole.withColumn("keys", F.array_sort(F.json_object_keys("value"))).withColumn("recordings", F.from_json(F.get_json_object("value", "$.recordings"), entry)).withColumn("version", F.get_json_object("value", "$.schema_version"))
    known = lambda c: F.coalesce(c, F.lit(False))
    wrong = F.when(~known(F.col("keys") == F.array(F.lit("recordings"), F.lit("schema_version"))), "keys").when(~known(F.col("version") == version), "version").when(~known(F.size("recordings") > 0), "no_recordings")
    files = whole.select("file", F.lit(None).cast("int").alias("position"), wrong.alias("problem"))
    each = whole.select("file", F.posexplode("recordings").alias("position", "e"))
    of = lambda k: F.col("e")[k]
    often = F.row_number().over(W.partitionBy("file", of("slug")).orderBy("position"))
    filled = lambda k, most: known((F.length(F.trim(of(k))) > 0) & (F.char_length(of(k)) <= most))
    problem = (
        F.when(~known(F.array_sort(F.map_keys("e")) == F.array(*map(F.lit, ("manifest", "slug", "subtitle", "title")))), "keys").when(~known(of("slug").rlike(SLUG)), "slug")
        .when(F.col("nth") > 1, "repeated_slug").when(~filled("title", 100), "title").when(~filled("subtitle", 140), "subtitle").when(~known(of("manifest") == F.concat(of("slug"), F.lit(".manifest.json"))), "manifest")
    )
    rows = each.withColumn("nth", often).select("file", "position", problem.alias("problem"))
    return files.union(rows).where("problem IS NOT NULL")


def demo_problems(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(file, problem) of demo manifests, <slug>.manifest.json: the first rule broken. presentation (width, height, duration_ms, media, note) has positive sizes and its media is
    named after the slug; output's events and state files likewise, with positive bytes and a digest; sample times strictly increase within the duration; the first event is not
    after the last, nor that after the end; counts of event families are whole numbers."""
    file = "struct<path:string,bytes:bigint,sha256:string>"
    schema = f"schema_version string, presentation struct<width:bigint,height:bigint,duration_ms:bigint,media:{file},note:string>, output struct<stream_id:string,events:{file},state:{file},event_count:bigint,event_family_counts:map<string,bigint>,structural_sample_times_ms:array<bigint>,first_event_ms:bigint,last_event_ms:bigint>"
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.json_object_keys(F.get_json_object("value", "$.presentation")).alias("keys"), F.from_json("value", schema).alias("m")).select("file", "keys", "m.*")
    known = lambda c: F.coalesce(c, F.lit(False))
    slug = F.regexp_extract("file", r"^(.*)\.manifest\.json$", 1)
    named = lambda c, end: known((F.col(f"{c}.path") == F.concat(slug, F.lit(end))) & (F.col(f"{c}.bytes") > 0) & F.col(f"{c}.sha256").rlike(DIGEST))
    p, o = (lambda c: F.col(f"presentation.{c}")), (lambda c: F.col(f"output.{c}"))
    times = o("structural_sample_times_ms")
    rising = F.forall(F.transform(times, lambda t, i: (t >= 0) & (t <= p("duration_ms")) & ((i == 0) | (t > F.get(times, i - 1)))), lambda ok: F.coalesce(ok, F.lit(False)))
    problem = (
        F.when(~known(slug.rlike(SLUG)), "name").when(~known(F.col("schema_version") == version), "version")
        .when(~known(F.array_sort("keys") == F.array(*map(F.lit, ("duration_ms", "height", "media", "note", "width")))), "presentation_keys")
        .when(~known((p("width") > 0) & (p("height") > 0) & (p("duration_ms") > 0) & (F.length(p("note")) > 0)), "presentation").when(~named("presentation.media", ".mp4"), "media")
        .when(~named("output.events", ".events.ndjson"), "events").when(~named("output.state", ".screen.txt"), "state").when(~known((o("event_count") > 0) & (F.length(o("stream_id")) > 0)), "output")
        .when(~known(rising), "sample_times").when(~known((o("first_event_ms") >= 0) & (o("first_event_ms") <= o("last_event_ms")) & (o("last_event_ms") <= p("duration_ms"))), "event_times")
        .when(~known(F.forall(F.map_values(o("event_family_counts")), lambda v: F.coalesce(v >= 0, F.lit(False)))), "family_counts")
    )
    return rows.select("file", problem.alias("problem")).where("problem IS NOT NULL")
