"""Corpora as sentences, and the words that they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramloom.config import SPECIALS
from gramloom.functions import text as T
from gramloom.operators import grams
from gramloom.storage import ranked, scratch, small


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line of a text file or of a folder's: line_no, a long, rises along each file and from file to file by name.

    Files may be read in several splits and in any order; a line's number is its split's place, and its own within it.
    """
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    rows = spark.read.text(path)
    splits = scratch(rows.select(*at).distinct(), "splits")  # a row for each part of a file that a task reads
    number = (F.row_number().over(Window.orderBy("file", "start")) - 1).cast("long")
    splits = splits.select("file", "start", number.alias("split"))
    found = rows.select(*at, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"), F.col("value").alias("line"))
    return found.join(small(splits), ["file", "start"]).select("file", (F.shiftleft("split", 33) + F.col("row")).alias("line_no"), "line")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line of text files (gz and bz2 are inflated by Spark), a trailing CR cut off."""
    return numbered_lines(spark, path).withColumn("line", F.regexp_replace("line", "\\r$", ""))


def sentences(docs: DataFrame, text: str = "text", by: str = "doc_id", blank: str = "skip") -> DataFrame:
    """by, line_no (from 0), words: one row per line. blank: "skip" drops lines without words, "keep" only empty lines."""
    rows = docs.select(by, F.posexplode(T.lines(text)).alias("line_no", "line"))
    rows = rows.where(F.col("line") != "").select(by, "line_no", T.words("line").alias("words"))
    return rows.where(F.size("words") > 0) if blank == "skip" else rows


def token_rows(sents: DataFrame, *by: str) -> DataFrame:
    """by, pos (from 0), word."""
    return sents.select(*by, F.posexplode("words").alias("pos", "word"))


def vocab_ids(sents: DataFrame, *by: str) -> DataFrame:
    """word, word_id: the special words first, then all others in the order of their first place. by: the order of sentences."""
    place = F.struct(*by, "pos")
    firsts = token_rows(sents, *by).where(~F.col("word").isin(*SPECIALS)).groupBy("word").agg(F.min(place).alias("place"))
    numbered = ranked(firsts, [F.col("place")], "rank").select("word", (F.col("rank") + len(SPECIALS) - 1).cast("int").alias("word_id"))
    fixed = sents.sparkSession.createDataFrame(list(SPECIALS.items()), "word string, word_id int")
    return fixed.unionByName(numbered)


def text_vocab_ids(docs: DataFrame) -> DataFrame:
    """As vocab_ids() of the sentences of docs(key, text), where keys are whole numbers."""
    firsts = grams.first_places(docs).where(~F.col("word").isin(*SPECIALS))
    numbered = ranked(firsts, [F.col("place")], "rank").select("word", (F.col("rank") + len(SPECIALS) - 1).cast("int").alias("word_id"))
    return docs.sparkSession.createDataFrame(list(SPECIALS.items()), "word string, word_id int").unionByName(numbered)


def lookup_ids(rows: DataFrame, vocab: DataFrame, word: str = "word") -> DataFrame:
    """rows with word_id; words that the vocabulary lacks, and any spelling of the unknown word, have id 0."""
    known = vocab.select(F.col("word").alias("__word"), "word_id")
    found = rows.join(known, F.col(word) == F.col("__word"), "left").drop("__word")
    return found.withColumn("word_id", F.when(F.col(word).isin("<unk>", "<UNK>"), 0).otherwise(F.coalesce("word_id", F.lit(0))).cast("int"))


def lookup_words(rows: DataFrame, vocab: DataFrame, word_id: str = "word_id") -> DataFrame:
    """rows with word; null for ids beyond the vocabulary."""
    known = vocab.select(F.col("word_id").alias("__id"), "word")
    return rows.join(known, F.col(word_id) == F.col("__id"), "left").drop("__id")


def vocab_bound(vocab: DataFrame) -> int:
    """One more than the highest id."""
    return vocab.agg(F.coalesce(F.max("word_id"), F.lit(-1))).first()[0] + 1


def saw_unk(vocab: DataFrame) -> bool:
    return not vocab.where(F.col("word").isin("<unk>", "<UNK>")).isEmpty()


def add_words(vocab: DataFrame, words: DataFrame) -> DataFrame:
    """vocab with the words(word) that it lacks, numbered after its last id in code-point order."""
    new = words.select("word").distinct().join(vocab.select("word"), "word", "left_anti")
    base = vocab_bound(vocab)
    new = ranked(new, [F.col("word")], "rank").select("word", (F.col("rank") + base - 1).cast("int").alias("word_id"))
    return vocab.select("word", "word_id").unionByName(new)


def is_special(word: Column | str) -> Column:
    return (F.col(word) if isinstance(word, str) else word).isin(*SPECIALS)
