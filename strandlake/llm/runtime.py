"""What all operators here share: the cluster's shared folder, written intermediate tables, gapless numbering."""

from __future__ import annotations

import gc
import math
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one task of a numbering window sorts.
ROWS_PER_BUCKET = 20_000
#: Numbered buckets at most: their table of offsets is broadcast, and so stays below some 16 MB. Beyond that, buckets grow.
MOST_BUCKETS = 1 << 18

#: Rows of whole texts that Python gets at once: a batch lies in the executor's memory outside its heap, and again in the Python worker.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own on a local master; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is unset: steps are written to a folder that driver and executors share")
        where = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*steps: DataFrame) -> None:
    """Delete what written() made, once nothing reads it any more."""
    for df in steps:
        spark = df.sparkSession
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            target = fs_path(folder)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of written steps that nothing refers to any more: it does so when the driver collects its garbage, which may else be long after."""
    for _ in range(2):  # what the first round frees may hold what the second one can
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_table(spark: SparkSession, rows: list[tuple], kinds: dict[str, pa.DataType]) -> DataFrame:
    """A table of the driver's rows (kinds: the type of each column). It goes to the JVM by Arrow: createDataFrame of a list has executors start Python workers for it."""
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds)))


def small_batches(spark: SparkSession) -> None:
    """From now on Python gets BATCH_ROWS rows at a time at most; a smaller number that is set stays. The rows are the same, only fewer lie in memory at once."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def buckets_for(rows: int, groups: int = 1) -> int:
    """A power of two of buckets with about ROWS_PER_BUCKET rows each, MOST_BUCKETS at most in all groups."""
    return 1 << max(0, min(math.ceil(math.log2(max(1, rows / ROWS_PER_BUCKET))), int(math.log2(max(1, MOST_BUCKETS / groups)))))


def numbered(df: DataFrame, group: list[str], bucket: str, order: list[Column], out: str, weight: Column | None = None, ranged: bool = False) -> DataFrame:
    """Add `out`: how much lies before the row in its group, counted from 0.

    Without weight this is the gapless row number, with weight the sum of weight over the rows before.
    Rows are ordered by (bucket, order); a group is never gathered in one task, only a bucket of it is:
    windows number each bucket, and a table with one row for each bucket has what lies before it.
    df is computed twice, the second time for its keys and weight only. Rows that tie in `order` get their numbers in any order.
    The caller bounds the buckets (MOST_BUCKETS): their offsets are broadcast. ranged: partitions follow each other in the order of bucket.
    """
    one = F.lit(1).cast("long") if weight is None else weight
    keys = [*group, bucket]
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(F.sum(one).alias("_n_all"))
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_n_all").over(before), F.lit(0)).alias("_n_off"))
    df = df.repartitionByRange(*keys) if ranged else df
    inside = Window.partitionBy(*keys).orderBy(*order)
    if weight is None:
        rows = df.withColumn("_n_in", (F.row_number().over(inside) - 1).cast("long"))
    else:
        rows = df.withColumn("_n_in", F.coalesce(F.sum(one).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) if i < len(group) else F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    return rows.join(F.broadcast(sums), cond).withColumn(out, F.col("_n_in") + F.col("_n_off")).drop("_n_in", "_n_off", *[f"_k{i}" for i in range(len(keys))])
