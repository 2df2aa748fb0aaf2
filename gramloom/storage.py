"""Scratch tables in the shared folder, size-checked broadcasts, and ranks over whole tables without a single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramloom.errors import ConfigError

#: Bytes up to which a table may be broadcast: its values, and so many more for each row.
BROADCAST_BYTES, ROW_BYTES = 32_000_000, 32


#: Bytes of files up to which their rows are dealt out anew.
SPREAD_BYTES = 64_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, path: str) -> DataFrame:
    """df, read from path, dealt to all cores if its files are so few and small that their splits don't reach them."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one is made only where all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ConfigError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gramloom-shared-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, and lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/gramloom/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame) -> bool:
    """Whether a table of plain columns has few bytes, as measured."""
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in df.schema.fields):
        return False
    width = ROW_BYTES + 8 * len(df.columns)
    most = BROADCAST_BYTES // width
    texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)).cast("long") for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    rows, letters = df.limit(most + 1).agg(F.count(F.lit(1)), F.sum(sum(texts[1:], texts[0])) if texts else F.lit(0)).first()
    return rows <= most and rows * width + (letters or 0) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """Marks df for broadcast if it has been measured as small; else the planner shuffles."""
    return F.broadcast(df) if is_small(df) else df


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's place (from 1) in the given order over the whole table.

    Ranges are sorted by all tasks and numbered within; only one count per range is summed up in one place. df is stored
    first, since its ranges are found by a sample.
    """
    keys = [c.alias(f"__key{k}") for k, c in enumerate(order)]
    stored = scratch(df.select("*", *keys), "to-rank")
    names = [f"__key{k}" for k in range(len(order))]
    placed = scratch(stored.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumn("__part", part)
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("__part", before.alias("__base"))
    return placed.join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + row + 1).drop("__part", "__at", "__base")  # one row for each range
