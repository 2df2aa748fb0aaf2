"""Exact dedup by a 128-bit content hash, with the bytes compared inside each group.

Texts are equal when identical after deleting space and \\x09-\\x0D. One pass over the texts makes a narrow table of
hashes; only texts whose hash occurs more than once are read again, pre-aggregated by their bytes before the shuffle, so
that a group of copies with a third of all rows sends one row per task.

Defined cases: a null text is an empty one; a null doc_id is the last to be kept and gives keep_id null; of rows that
agree in text, length and doc_id one is kept; an empty table gives an empty result; columns other than doc_id and text
aren't looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import bounded_batches, maybe_broadcast, scratch, text_or_empty

BLANKS = "[\\x20\\x09-\\x0D]+"


def hash128(normalised: Column) -> Column:
    return F.unhex(F.md5(normalised))


def _normalised(docs: DataFrame, hash_of: Callable[[Column], Column]) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", F.char_length("text").alias("n_cp"), F.regexp_replace("text", BLANKS, "").alias("norm"))
    return rows.withColumn("h", hash_of(F.col("norm")))


def _best(*by: str) -> list[Column]:
    """Aggregates with fixed-width buffers (hash aggregation): the length and id of the row that stays are one decimal."""
    rank = F.col("n_cp").cast("decimal(10,0)") * F.lit(Decimal(2**65)) + F.coalesce(F.lit(Decimal(2**63)) - F.col("doc_id").cast("decimal(19,0)"), F.lit(Decimal(-1)))
    rank = rank.cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("group_size"), F.max_by("doc_id", rank).alias("keep_id"), F.max_by("uid", rank).alias("keep_uid")]


def _labelled(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """rows with their group's figures; groups holds only those of more than one row."""
    found = rows.join(groups, on, "left")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"), "text_sha256",
    )


def exact_dedup(docs: DataFrame, hash_of: Callable[[Column], Column] = hash128) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. hash_of: the 128-bit hash (tests pass a weak one)."""
    bounded_batches(docs.sparkSession)
    keys = _normalised(docs, hash_of).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "n_cp", "h", F.sha2("norm", 256).alias("text_sha256"))
    keys = scratch(keys, "exact-keys")
    groups = scratch(keys.groupBy("h").agg(*_best()).where("group_size > 1"), "exact-groups")
    if groups.isEmpty():
        return _labelled(keys, groups, ["h"])
    # Compare the bytes: rows of one hash but of more than one text are collisions.
    again = _normalised(docs, hash_of).join(maybe_broadcast(groups.select("h")), "h", "left_semi")
    clashes = again.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    clashes = scratch(clashes, "exact-clashes")
    if clashes.isEmpty():
        return _labelled(keys, groups, ["h"])
    clashes = maybe_broadcast(clashes)
    apart = scratch(_normalised(docs, hash_of).join(clashes, "h", "left_semi").select(F.monotonically_increasing_id().alias("uid"), "doc_id", "n_cp", "h", "norm"), "exact-apart")
    texts = scratch(apart.groupBy("h", "norm").agg(*_best()).where("group_size > 1"), "exact-texts")
    apart = apart.withColumn("text_sha256", F.sha2("norm", 256))
    return _labelled(keys.join(clashes, "h", "left_anti"), groups, ["h"]).unionByName(_labelled(apart, texts, ["h", "norm"]))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept."""
    found = scratch(exact_dedup(docs).select("doc_id", "kept"), "exact-found")
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("stay"))
    gone = ids.where("stay = 0 and doc_id is not null").select("doc_id")
    mixed = scratch(ids.where("(stay > 0 and stay < n) or doc_id is null").select(F.col("doc_id").alias("__mixed_id")), "exact-mixed")
    gone = gone.select(F.col("doc_id").alias("__gone_id"))
    left = docs.join(maybe_broadcast(gone), docs["doc_id"].eqNullSafe(F.col("__gone_id")), "left_anti")
    if mixed.isEmpty():
        return left
    # Ids that stand on several rows, or on none: these rows are told apart by their text.
    small = maybe_broadcast(mixed)
    some = docs.join(small, docs["doc_id"].eqNullSafe(F.col("__mixed_id")), "left_semi")
    texts = F.regexp_replace(text_or_empty(), BLANKS, "")
    wanted = scratch(exact_dedup_classes(docs), "exact-wanted")
    some = some.withColumn("__norm", texts).withColumn("__cp", F.char_length(text_or_empty()))
    some = some.join(wanted, some["__norm"].eqNullSafe(wanted["__w_norm"]) & some["doc_id"].eqNullSafe(wanted["__w_id"]) & (some["__cp"] == wanted["__w_cp"]), "left_semi")
    some = some.dropDuplicates(["doc_id", "__norm"]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return left.join(small, left["doc_id"].eqNullSafe(F.col("__mixed_id")), "left_anti").unionByName(some)


def exact_dedup_classes(docs: DataFrame) -> DataFrame:
    """(text, id, length) of the row that stays of each text; used only where ids repeat or are null."""
    rows = _normalised(docs, hash128).withColumn("uid", F.lit(0).cast("long"))
    best = rows.groupBy("norm").agg(F.max("n_cp").alias("__w_cp"), *_best())
    return best.select(F.col("norm").alias("__w_norm"), "__w_cp", F.col("keep_id").alias("__w_id"))
