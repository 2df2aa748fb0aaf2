"""Filters over model text and phrase tables: which lines stay, and how they are put out.

A line is "probability TAB words [TAB backoff]", or words alone. A predicate is any function from a line column to a
boolean one; vocabularies of any size go through an anti-join on the words instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramloom.functions import text as T
from gramloom.storage import is_small, scratch

MODES = ("copy", "unset", "single", "multiple", "union")
#: Lines of one range within which order is kept by a window.
RANGE_LINES = 500_000


def line_words(line: Column | str = "line") -> Column:
    """The words of a line: of its second TAB field, or of all of it where it has no TAB."""
    c = F.col(line) if isinstance(line, str) else line
    fields = F.split(c, "\t", 3)
    return T.words(F.when(F.size(fields) > 1, F.element_at(fields, 2)).otherwise(c))


def judged_words(line: Column | str = "line", context_only: bool = False) -> Column:
    """The words that must be known: all, or with context_only all but the last of several."""
    w = line_words(line)
    return F.when(F.size(w) > 1, F.slice(w, 1, F.size(w) - 1)).otherwise(w) if context_only else w


def copy_filter(line: Column) -> Column:
    return F.lit(True)


def word_list_filter(words: list[str], context_only: bool = False) -> Callable[[Column], Column]:
    """A predicate by a short list of words, held in the plan itself."""
    known = F.array(*[F.lit(w) for w in words]).cast("array<string>")

    def passes(line: Column) -> Column:
        w = judged_words(line, context_only)
        return (F.size(w) > 0) & (F.size(F.array_except(w, known)) == 0)

    return passes


def passing(lines: DataFrame, vocab: DataFrame | Callable[[Column], Column], context_only: bool = False) -> DataFrame:
    """The non-empty lines(line_no, line) that pass: whose judged words are all in vocab(word), and at least one is there."""
    lines = lines.where(F.col("line") != "")
    if callable(vocab):
        return lines.where(vocab(F.col("line")))
    words = vocab.select("word").distinct()
    if is_small(words):
        return _passing_small(lines, words.toArrow()["word"].combine_chunks(), context_only)
    known = words
    judged = lines.select("line_no", F.explode(judged_words("line", context_only)).alias("word"))
    bad = judged.join(known, "word", "left_anti").select("line_no").distinct()
    return lines.where(F.size(line_words("line")) > 0).join(bad, "line_no", "left_anti")


def _passing_small(lines: DataFrame, known: pa.Array, context_only: bool) -> DataFrame:
    """As passing(), where the vocabulary has been measured as small and goes to all tasks: one narrow pass."""
    sent = lines.sparkSession.sparkContext.broadcast(known.cast(pa.string()))
    rows = lines.select("line_no", "line", judged_words("line", context_only).alias("words"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.drop("words").dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            good = pc.is_in(pc.cast(lists.flatten(), pa.string()), value_set=sent.value).to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~good)])
            ends = np.cumsum(sizes)
            passed = (sizes > 0) & (bad[ends] == bad[ends - sizes])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["line_no", "line"]).filter(pa.array(passed))

    return rows.mapInArrow(run, schema)


def union(lines: DataFrame) -> DataFrame:
    """The first of equal lines; pre-aggregated, so that a line with a third of all rows meets no single task."""
    return lines.groupBy("line").agg(F.min("line_no").alias("line_no")).select("line_no", "line")


def blocks(lines: DataFrame, passed: DataFrame, range_lines: int = RANGE_LINES) -> DataFrame:
    """The passing lines, and each blank line that follows a block of which something passed.

    Ranges of about range_lines of these lines, however their numbers lie, are sorted by all tasks; what lies before a range
    is known from one row for each range.
    """
    marks = passed.select("line_no", "line", F.lit(True).alias("passed")).unionByName(lines.where(F.col("line") == "").select("line_no", "line", F.lit(False).alias("passed")))
    marks = scratch(marks, "marks")
    ranges = max(1, -(-marks.count() // range_lines))
    placed = scratch(marks.repartitionByRange(ranges, "line_no").sortWithinPartitions("line_no").withColumn("part", F.spark_partition_id()), "placed")
    w = Window.partitionBy("part").orderBy("line_no")
    last = placed.groupBy("part").agg(F.max_by("passed", "line_no").alias("last")).withColumn("before_part", F.lag("last").over(Window.orderBy("part")))
    found = placed.withColumn("before", F.lag("passed").over(w)).join(F.broadcast(last.select("part", "before_part")), "part")
    return found.where(F.col("passed") | F.coalesce("before", "before_part", F.lit(False))).select("line_no", "line")


def run_filter(lines: DataFrame, vocab: DataFrame | Callable[[Column], Column], mode: str = "copy", context_only: bool = False) -> DataFrame:
    """line_no, line of what a filter puts out, in the order of line_no. Partitions filter at once, whatever their number."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    passed = passing(lines, vocab, context_only)
    if mode == "union":
        return union(passed)
    return blocks(lines, passed) if mode == "multiple" else passed


def phrase_ngrams(lines: DataFrame) -> DataFrame:
    """line_no, ngram: the set of all runs of words in the source phrase of each line of a phrase table."""
    source = lines.select("line_no", T.words(F.substring_index("line", "|||", 1)).alias("w"))
    return source.select("line_no", F.explode(T.all_runs("w")).alias("ngram"))
