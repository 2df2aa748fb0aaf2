"""What the operators of this folder share: scratch tables, size-checked broadcasts, bounded batches, row removal."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a table may be broadcast: its values, and so many more for each row.
BROADCAST_BYTES, ROW_BYTES = 16_000_000, 32
#: Bytes of the batches that tasks exchange with Python (Spark's own bound is 64 MB, held several times over).
BATCH_BYTES = 8_000_000
#: Bytes that a task holds of a scratch table before it writes them.
ROW_GROUP = 16_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. One is made only where all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gramloom-shared-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/gramloom/{what}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, so a lost executor costs only its own tasks."""
    path = scratch_path(df.sparkSession, what)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's batches between tasks and Python to BATCH_BYTES, where it allows more, and lets small shuffles end in

    as few tasks and files as the session's partition size says, not in one for each core.
    """
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker, which waits for further tasks, gives its free memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of GNU's library
        if trim:
            trim(0)

    return whole


def _sizes(kind: T.DataType, column: Column) -> tuple[int, list[Column]] | None:
    """Bytes of a value's parts of fixed width, and the columns whose bytes must be measured; None: can't be measured."""
    if isinstance(kind, T.StructType):
        parts = [_sizes(f.dataType, column.getField(f.name)) for f in kind.fields]
        return None if None in parts else (sum(p[0] for p in parts), [c for p in parts for c in p[1]])
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 8, [column]
    return None if isinstance(kind, (T.ArrayType, T.MapType, T.VariantType)) else (16 if isinstance(kind, T.DecimalType) else 8, [])


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """Marks df for broadcast only if it has been measured and is small; else the planner shuffles."""
    sizes = [_sizes(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields]
    if None in sizes:
        return df
    width = ROW_BYTES + sum(s[0] for s in sizes)
    most = BROADCAST_BYTES // width
    varied = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for s in sizes for c in s[1]]
    some = df.limit(most + 1)
    rows, more = some.agg(F.count(F.lit(1)), F.sum(sum(varied[1:], varied[0]))).first() if varied else (some.count(), 0)
    return F.broadcast(df) if rows <= most and rows * width + (more or 0) <= BROADCAST_BYTES else df


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id is in dropped(doc_id); rows with a null id stay.

    The dropped ids are broadcast when measured small, so that the texts aren't shuffled.
    """
    ids = dropped.select(F.col("doc_id").alias("__dropped_id"))
    return docs.join(maybe_broadcast(ids), docs["doc_id"] == F.col("__dropped_id"), "left_anti")


def _cuts(sizes: list[int], most: int, rows: int | None) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, n in enumerate(sizes):
        size += n
        if size >= most or k + 1 - at == rows:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def chunks(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Slices (from, to) of texts of about so many characters, one text at least."""
    return _cuts([len(t) for t in texts], most, None)


def slices(batch: pa.RecordBatch, column: str, most: int, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many bytes in a column of texts, one row at least, and of at most so many rows."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    return (batch.slice(a, b - a) for a, b in _cuts(sizes, most, rows))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
