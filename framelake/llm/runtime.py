"""Shared plumbing of the training-data operators: checkpoints, Arrow batch size, distributed numbering."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Bytes of an Arrow batch that reaches Python, the same for every operator; rows that are broadcast at most.
BATCH_BYTES, FEW_ROWS = 4 << 20, 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    It is set here only where the session has none and all tasks run in this process (tests).
    """
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not given:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="framelake-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
        given = sc.getCheckpointDir()
    return given.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and cuts its lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def few(rows: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """rows (a checkpoint, of short values), to be broadcast if they are no more than `most`; joins are by shuffle beyond that."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is read no more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch for Python stages over whole texts (a batch has a row at least)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal table, made in the JVM. Cells: None, numbers, strings, lists of whole numbers."""

    def cell(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(x, (list, tuple)):
            return "array(" + ", ".join(map(cell, x)) + ")"
        return f"CAST('{x!r}' AS DOUBLE)" if isinstance(x, float) else repr(x)

    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    if not rows:
        return spark.range(0).selectExpr(*(f"CAST(NULL AS {kind}) AS {name}" for name, kind in fields))
    values = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    cast = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    return spark.sql(f"SELECT {cast} FROM VALUES {values} AS t({', '.join(name for name, _ in fields)})")


def with_field(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    """schema with a field of that name at its end; one of the same name is replaced."""
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def numbered(df: DataFrame, group: str, order: list, out: str, bucket_rows: int = 50_000) -> DataFrame:
    """Adds out: 0, 1, 2, ... without gaps in each group, without a task that holds a whole group.

    Rows of a group are dealt to hash buckets of their order columns, the buckets are counted, and each
    bucket starts where those before it end. df must be cheap to compute twice (or a checkpoint), and rows that
    agree in all order columns must be interchangeable. A null group is a group.
    """
    sizes = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / F.lit(bucket_rows)).cast("long").alias("__parts"))
    key = F.pmod(F.xxhash64(*order), F.col("__parts"))
    dealt = df.join(sizes.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g"))).drop("__g").withColumn("__bucket", key).drop("__parts")
    before = W.partitionBy(group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
        .select(F.col(group).alias("__g"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    within = W.partitionBy(group, "__bucket").orderBy(*order)
    return (
        dealt.withColumn("__row", F.row_number().over(within) - 1)
        .join(starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__bucket") == F.col("__b")))
        .withColumn(out, (F.col("__start") + F.col("__row")).cast("long"))
        .drop("__g", "__b", "__start", "__row", "__bucket")
    )
