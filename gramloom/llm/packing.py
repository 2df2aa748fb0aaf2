"""Best-fit packing of documents into sequences under several capacities: tokens, documents and attention cost.

A document's ids end with an end id; longer ones than a sequence are cut into full pieces after a first, shorter one.
Pieces are dealt to tasks by a hash of the row and packed there largest first, each into the open bin that fits under
every capacity and has the smallest weighted norm of its residuals after it (or the largest weighted dot product). A task
wastes one bin at most beyond what its own pieces need, so tasks are given tens of thousands of pieces, whose open bins
are looked at all at once.

Defined cases: a null or empty text is one piece that holds the end id; rows with equal or null ids are packed on their
own; pieces of one row may lie in different sequences; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import bounded_batches, released, scratch, text_or_empty
from gramloom.llm.tokens import token_ids

SEQUENCE = 2048
#: Pieces that one task packs.
PIECES_A_TASK = 20_000
#: What the residuals of tokens, documents and attention cost weigh in the choice of a bin; documents as if a sequence held
#: an eighth of what its capacity says.
WEIGHTS = (1.0, 64.0, 1.0)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PACKED = f"{PIECES}, sequence_id long, offset long"
_DEALT = pa.schema([*_PIECES, ("uid", pa.int64())])
_PACKED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cuts(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones after a first that may be shorter."""
    first = n % most or most
    return [(0, first), *((at, most) for at in range(first, n, most))]


def best_fit(
    items: Iterable[tuple[int, int]], capacity: tuple[int, int, int] = (SEQUENCE, SEQUENCE, SEQUENCE**2), weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm"
) -> list[list[int]]:
    """Bins of item numbers. items: (number, tokens); each costs its tokens, one document, and its tokens squared.

    Items come largest first; each goes to the first of the open bins that fit under every capacity and have the smallest
    weighted norm of what would be left ("norm") or the largest weighted product of needs and residuals ("dot").
    """
    size = np.maximum(capacity, 1).astype(float)
    scale = np.array(weights) / size**2
    bins: list[list[int]] = []
    rest = np.empty((3, 64))  # residuals of the open bins, and which bins they are
    which = np.empty(64, np.int64)
    n_open = shut = 0
    for number, tokens in sorted(items, key=lambda x: (-x[1], x[0])):
        need = np.array((tokens, 1, tokens * tokens), float)
        if (need > capacity).any():
            raise ValueError(f"an item of {tokens} tokens is larger than a bin")
        left = rest[:, :n_open] - need[:, None]
        score = scale @ (left * left) if rule == "norm" else -((scale * need) @ rest[:, :n_open])
        score[left.min(0) < 0] = np.inf
        at = int(score.argmin()) if n_open else 0
        if not n_open or score[at] == np.inf:
            if n_open == rest.shape[1]:
                if 2 * shut >= n_open:  # bins that are full make room
                    keep = np.flatnonzero(rest[0, :n_open] >= 0)
                    rest[:, : len(keep)], which[: len(keep)] = rest[:, keep], which[keep]
                    n_open, shut = len(keep), 0
                else:
                    rest, which = np.concatenate([rest, np.empty_like(rest)], 1), np.concatenate([which, np.empty_like(which)])
            at = n_open
            rest[:, at], which[at] = capacity, len(bins)
            bins.append([])
            n_open += 1
        bins[which[at]].append(number)
        rest[:, at] -= need
        if rest[0, at] < 1 or rest[1, at] < 1 or rest[2, at] < 1:
            rest[0, at] = -1
            shut += 1
    return bins


def piece_rows(docs: DataFrame, tokenizer: str, end_id: int = 0, most: int = SEQUENCE) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(tokenizer)
        for batch in batches:
            columns: list[list] = [[] for _ in _PIECES]
            for doc, ids in zip(batch.column(0).to_pylist(), encode.ids(batch.column(1).to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, (start, n) in enumerate(cuts(len(ids), most)):
                    for column, x in zip(columns, (doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes())), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(released(cut), PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, most: int = SEQUENCE, docs_a_sequence: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs_a_sequence, attention (the sum of squared piece lengths): further capacities of a sequence; None: what the tokens
    allow at most. Their residuals weigh in the choice of a bin in any case.
    """
    capacity = (most, docs_a_sequence or most, attention or most * most)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(list(batches), _DEALT).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("uid", "ascending")]).drop(["uid"])
        lengths = part["length"].to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = TaskContext.get().partitionId() << 32
        for n, numbers in enumerate(best_fit(enumerate(lengths), capacity, weights, rule)):
            at = 0
            for k in numbers:
                sequence[k], offset[k] = base + n, at
                at += lengths[k]
        yield from pa.Table.from_arrays([*part.columns, pa.array(sequence), pa.array(offset)], schema=_PACKED).to_batches()

    bounded_batches(docs.sparkSession)
    pieces = scratch(piece_rows(docs, tokenizer, end_id, most).withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    tasks = max(1, math.ceil(pieces.count() / PIECES_A_TASK))
    return pieces.repartition(tasks, "uid").mapInArrow(released(fill), PACKED)  # by row: rows that share an id, or have none, are dealt out too
