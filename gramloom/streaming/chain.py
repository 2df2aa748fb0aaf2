"""Chains of steps from rows to rows, over tables and streams alike.

A step is a function from a DataFrame to one; Spark runs what lies between two shuffles as one stage, so nothing is queued
or copied between steps. What bounds the rows under way are the batches' sizes and, for a stream, the files of a
micro-batch: a source is read no faster than its chain takes.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gramloom.errors import ConfigError
from gramloom.operators.ordering import sorted_distinct

Step = Callable[[DataFrame], DataFrame]


@dataclasses.dataclass(frozen=True)
class ChainConfig:
    """batch_rows: rows of a batch that goes to Python. files_per_trigger: files of a micro-batch. partitions: tasks of a shuffle (0: the session's)."""

    batch_rows: int = 10_000
    files_per_trigger: int = 16
    partitions: int = 0

    def __post_init__(self):
        if min(self.batch_rows, self.files_per_trigger) < 1 or self.partitions < 0:
            raise ConfigError("batch_rows and files_per_trigger must be 1 or more, partitions 0 or more")

    def apply(self, spark: SparkSession) -> None:
        """Sets what the session must know."""
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(self.batch_rows))
        if self.partitions:
            spark.conf.set("spark.sql.shuffle.partitions", str(self.partitions))


@dataclasses.dataclass(frozen=True)
class Chain:
    """Named steps in their order. Adding one gives another chain; this one stays as it is."""

    steps: tuple[tuple[str, Step], ...] = ()

    def add(self, name: str, step: Step) -> Chain:
        if name in dict(self.steps):
            raise ConfigError(f"the chain has a step {name!r}")
        return Chain((*self.steps, (name, step)))

    def sort(self, *keys: str, distinct: bool = False) -> Chain:
        """With a step that sorts by keys, and leaves one of equal rows if distinct; both spill to disk by themselves."""
        return self.add("sort", lambda rows: sorted_distinct(rows, *keys) if distinct else rows.orderBy(*keys))

    def position(self, name: str) -> int:
        return [n for n, _ in self.steps].index(name)

    def run(self, rows: DataFrame, upto: str | None = None) -> DataFrame:
        """What the steps make of rows, all of them or up to one."""
        last = len(self.steps) if upto is None else self.position(upto) + 1
        for _, step in self.steps[:last]:
            rows = step(rows)
        return rows


def source(spark: SparkSession, path: str, schema: str, config: ChainConfig = ChainConfig(), kind: str = "parquet") -> DataFrame:
    """A stream of a folder's files, so many to a micro-batch: files that come faster wait."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", config.files_per_trigger).format(kind).load(path)
