"""Exact top-k inner products by block-at-a-time pruning.

Rows in order of their ids form blocks, each with its rows' whole components (a block forward index) and, for every
component as a term, the block's largest and smallest weight. A query bounds each block by the sum of its terms' maxima,
visits blocks from the highest bound on, and stops when a bound falls below its k-th score; a bound that equals it is still
visited, since ties go to the smaller id. Queries are taken in blocks of a bounded size against all rows, one block after
the other; a task keeps k rows for each of them, and the k best of all tasks' rows are the result.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id;
missing trailing components count as 0, so an empty vector scores 0 with all; rows that repeat an id are candidates each,
and one query; a query's own row is every row of its id; products are of whole numbers of any size, and a score beyond 64
bits is the nearest number of 64 bits; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramloom.llm.common import bounded_batches, scratch, scratch_path

#: Rows of a block, and queries that are sent to the tasks at once (at most QUERY_BLOCK * components * 8 bytes).
BLOCK_ROWS, QUERY_BLOCK = 128, 8192
_LEAST, _MOST = -(2**63), 2**63 - 1

_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, x: the components floor(scale * x), a power of two, as doubles, which hold them exactly; rows that take part only."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    # From 2 ** 53 on doubles are whole, and beyond all doubles they are the largest one.
    most = float(np.finfo(np.float64).max)
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(F.greatest(F.least(y, F.lit(most)), F.lit(-most)))
    return rows.select("vec_id", F.transform("v", lambda v: whole(v * float(scale))).alias("x"))


def _matrix(rows: pa.ListArray | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """The lists as rows of a matrix of doubles, filled up with 0."""
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(int(sizes.max(initial=0)), width or 0)
    out = np.zeros((len(rows), width))
    out[np.arange(width) < sizes[:, None]] = rows.flatten().to_numpy(zero_copy_only=False)
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products of all rows: by doubles where they're exact, else by whole numbers of any size."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)
    return whole(a) @ whole(b).T


def _bounded(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == np.int64 else np.clip(x, _LEAST, _MOST).astype(np.int64)


class Best:
    """The k best rows so far of each query: score and id, best first; real tells which places are taken."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.score, self.id = np.full((len(query_ids), k), _LEAST), np.zeros((len(query_ids), k), np.int64)
        self.real = np.zeros((len(query_ids), k), bool)
        self.scored = 0  # pairs of a query and a block

    def look(self, ids: np.ndarray, rows: np.ndarray, block_rows: int = BLOCK_ROWS) -> None:
        """Takes in further rows, block by block, as far as their bounds reach."""
        by = np.argsort(ids, kind="stable")
        ids, rows = ids[by], rows[by]
        width = max(rows.shape[1], self.queries.shape[1])
        rows, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (rows, self.queries))
        cuts = np.arange(0, len(ids), block_rows)
        highest, lowest = np.maximum.reduceat(rows, cuts), np.minimum.reduceat(rows, cuts)
        bounds = _bounded(_products(np.maximum(queries, 0), highest) + _products(np.minimum(queries, 0), lowest))
        order = np.argsort(~bounds, axis=1, kind="stable")
        going = np.arange(len(queries))
        for step in range(len(cuts)):
            block = order[going, step]
            still = (bounds[going, block] >= self.score[going, -1]) | ~self.real[going, -1]
            going, block = going[still], block[still]
            if not len(going):
                break
            self.scored += len(going)
            for b in np.unique(block):
                q = going[block == b]
                at = slice(cuts[b], cuts[b] + block_rows)
                scores = _bounded(_products(queries[q], rows[at]))
                other = ids[at] != self.query_ids[q][:, None]
                score, real = np.concatenate([self.score[q], scores], 1), np.concatenate([self.real[q], other], 1)
                own = np.concatenate([self.id[q], np.broadcast_to(ids[at], scores.shape)], 1)
                best = np.lexsort((own, ~score, ~real), axis=1)[:, : self.k]
                self.score[q], self.id[q], self.real[q] = (np.take_along_axis(x, best, 1) for x in (score, own, real))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, task_rows: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products. Both tables are of whole_vectors().

    task_rows: rows whose blocks a task holds at once.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = scratch(vectors, "topk-rows")
    asked = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("x").alias("q"))
    blocks = max(1, -(-asked.count() // query_block))
    asked = scratch(asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "topk-queries")
    path = scratch_path(spark, "topk-found")
    for b in range(blocks):  # one block of queries at a time is on the driver and with the tasks: about query_block of them
        part = asked.where(F.col("part") == b).select("query_id", "q").toArrow()
        sent = spark.sparkContext.broadcast((part["query_id"].to_numpy(), _matrix(part["q"])))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best = Best(*sent.value, k)
            held: list[pa.RecordBatch] = []

            def look() -> None:
                part = pa.Table.from_batches(held)
                best.look(part["vec_id"].to_numpy(), _matrix(part["x"]))
                held.clear()

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                if sum(b.num_rows for b in held) >= task_rows:
                    look()
            if held:
                look()
            q, place = np.nonzero(best.real)
            yield pa.RecordBatch.from_arrays([pa.array(best.query_ids[q]), pa.array(best.id[q, place]), pa.array(best.score[q, place])], schema=_OUT)

        rows.mapInArrow(search, "query_id long, vec_id long, score long").write.mode("append").parquet(path)
        sent.destroy()
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
