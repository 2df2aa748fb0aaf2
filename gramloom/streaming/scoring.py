"""Models over streams: n-gram counts in event-time windows, and scores of sentences as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gramloom.functions import text as T
from gramloom.operators.counts import marked
from gramloom.operators.model import Model
from gramloom.operators.score import score_tokens, sentence_scores


def windowed_counts(stream: DataFrame, order: int, window: str = "10 minutes", slide: str | None = None, late: str = "10 minutes", ts: str = "ts", text: str = "text") -> DataFrame:
    """start, n, ngram, c of a stream(ts, text), one sentence per row; rows later than `late` are dropped with their windows' state."""
    rows = stream.withWatermark(ts, late).select(ts, T.words(text).alias("words")).where(F.size("words") > 0).select(ts, marked().alias("t"))
    found = T.exploded_ngrams(rows, "t", order)
    when = F.window(ts, window, slide) if slide else F.window(ts, window)
    counted = found.groupBy(when.alias("w"), "n", "ngram").agg(F.count(F.lit(1)).alias("c"))
    return counted.select(F.col("w.start").alias("start"), "n", "ngram", "c")


def score_stream(stream: DataFrame, by: list[str], model: Model, write: Callable[[DataFrame, int], None], checkpoint: str, text: str = "text", trigger: dict | None = None) -> StreamingQuery:
    """Scores each micro-batch of stream(by, text) and hands (by, total, oov, tokens) to write(batch, number)."""

    def score(batch: DataFrame, number: int) -> None:
        sents = batch.select(*by, T.words(text).alias("words")).where(F.size("words") > 0)
        write(sentence_scores(score_tokens(sents, by, model), by), number)

    return stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
