"""Orders of n-grams as sort keys (texts that sort as lists of words do), sorted and distinct runs, and the walk over all orders in one."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from gramloom.functions import text as T
from gramloom.operators.model import orphans
from gramloom.storage import ranked


def _backwards(key: Column) -> Column:
    return F.array_join(F.reverse(F.split(key, "\x00")), "\x00")


def suffix_order(ngram: Column | str = "ngram") -> list[Column]:
    """By the words from the last to the first. Of n-grams of several lengths a shorter one comes before those it ends."""
    return [_backwards(T.sort_text(ngram))]


def context_order(ngram: Column | str = "ngram") -> list[Column]:
    """By the context's words from its last to its first, then by the last word."""
    key = T.sort_text(ngram)
    last = F.substring_index(key, "\x00", -1)
    context = F.substring(key, F.lit(1), F.greatest(F.length(key) - F.length(last) - 1, F.lit(0)))
    return [_backwards(context), last]


def prefix_order(ngram: Column | str = "ngram") -> list[Column]:
    """By the words from the first on, by code points; also the order of model text."""
    return [T.sort_text(ngram)]


ORDERS = {"suffix": suffix_order, "context": context_order, "prefix": prefix_order}


def ranked_by(rows: DataFrame, order: str, name: str = "rank") -> DataFrame:
    """rows(n, ngram, ...) with their place (from 1) within their n, in an order of ORDERS; no task sees all of an order."""
    placed = ranked(rows, [F.col("n"), *ORDERS[order]("ngram")], "__place")
    first = placed.groupBy("n").agg(F.min("__place").alias("__first"))  # a row for each order
    return placed.join(F.broadcast(first), "n").withColumn(name, F.col("__place") - F.col("__first") + 1).drop("__place", "__first")


def sorted_distinct(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows in the order of keys (all columns, if none are given); sorting spills to disk by itself."""
    out = rows.distinct()
    return out.orderBy(*(keys or rows.columns))


def hash_order(h: Column | str = "h") -> list[Column]:
    """By a hash as a number from 0: longs with the sign bit flipped."""
    return [(F.col(h) if isinstance(h, str) else h).bitwiseXOR(F.lit(-(2**63)))]


def _whole(rows: DataFrame) -> None:
    lost = orphans(rows).select("ngram").first()
    if lost:
        raise ValueError(f"the prefix of {lost[0]!r} is missing")


class Ngrams:
    """rows of n-grams one by one, in their order, and how many there are; a partition at a time is on the driver."""

    def __init__(self, rows: DataFrame):
        self.rows, self.n = rows, rows.count()

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[Row]:
        return self.rows.toLocalIterator()


def joint_walk(rows: DataFrame) -> DataFrame:
    """n, ngram in the order of a walk that enters each n-gram after its prefix; an n-gram whose prefix is missing is an error."""
    _whole(rows)
    return rows.orderBy(*prefix_order())


def walk_events(rows: DataFrame) -> DataFrame:
    """n, ngram, event, key in the walk's order: "enter" where it comes to an n-gram, "exit" once all that begin with it are done.

    The end of an n-gram's part of the order is its sort text and \\x01, which lies behind all that continue it.
    """
    _whole(rows)
    key = T.sort_text("ngram")
    both = [("enter", key), ("exit", F.concat(key, F.lit("\x01")))]
    events = F.explode(F.array(*[F.struct(F.lit(event).alias("event"), at.alias("key")) for event, at in both]))
    return rows.select("n", "ngram", events.alias("x")).select("n", "ngram", "x.event", "x.key").orderBy("key")
