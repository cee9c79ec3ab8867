"""The outputs of a run in one new folder: events, state text, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import write_events


def metrics(events: DataFrame) -> DataFrame:
    """One row: streams, events, events by type, first and last time."""
    kinds = events.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"))
    listed = F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n"))))
    streams = events.agg(F.countDistinct("stream_no").alias("streams"))
    folded = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), listed.alias("by_type"), F.min("a").alias("first_ms"), F.max("b").alias("last_ms"))
    return streams.join(folded, how="cross")  # one row beside one row


def distinct_paths(spark: SparkSession, inputs: list[str], outputs: list[str]) -> list[str]:
    """outputs, resolved, if they are new, differ from one another and from the inputs, and none lies in another; else an error."""
    def resolved(path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        return fs, fs.makeQualified(p)

    known, new = [resolved(p)[1].toString().rstrip("/") for p in inputs], []
    for path in outputs:
        fs, p = resolved(path)
        if fs.exists(p):
            raise FileExistsError(f"refusing to write over {path}")
        new.append(p.toString().rstrip("/"))
    for i, a in enumerate(new):
        for b in [*known, *new[:i]]:
            if a == b or f"{a}/".startswith(f"{b}/") or f"{b}/".startswith(f"{a}/"):
                raise ValueError(f"input and output paths must be distinct: {a}, {b}")
    return new


def write_run(events: DataFrame, lines: DataFrame, folder: str) -> None:
    """Writes folder/events, folder/state and, last, folder/metrics; the folder must be new and is removed again if a write fails.

    events is read three times and lines once, so hand over written or cached tables where they are dear.
    """
    spark = events.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(path):
        raise FileExistsError(f"refusing to write over {folder}")
    try:
        write_events(events, f"{folder}/events")
        ordered = lines.repartitionByRange("stream_no", "line_no").sortWithinPartitions("stream_no", "line_no")
        ordered.select("stream_no", F.col("line").alias("value")).write.partitionBy("stream_no").text(f"{folder}/state")
        metrics(events).coalesce(1).write.json(f"{folder}/metrics")
    except Exception:
        fs.delete(path, True)
        raise
