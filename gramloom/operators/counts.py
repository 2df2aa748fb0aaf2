"""Counts of n-grams, and what an estimator reads off them. Every aggregate is combined before its shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.config import BOS, EOS, SPECIALS, check_order
from gramloom.errors import DiscountError
from gramloom.functions import hashing
from gramloom.functions import text as T
from gramloom.operators import grams
from gramloom.storage import scratch


def marked(words: Column | str = "words", bos: bool = True, eos: bool = True) -> Column:
    w = F.col(words) if isinstance(words, str) else words
    return F.concat(*[F.array(F.lit(BOS))] * bos, w, *[F.array(F.lit(EOS))] * eos)


def count_ngrams(sents: DataFrame, order: int, least: int = 1) -> DataFrame:
    """n, ngram, c over all sentences(words), or lines of texts(text), each between its markers, for n of `least` to `order`."""
    check_order(order)
    if order <= grams.MOST:
        return grams.counted(sents.select("words" if "words" in sents.columns else "text"), order, least)
    return T.exploded_ngrams(sents.select(marked().alias("t")), "t", order, least).groupBy("n", "ngram").agg(F.count(F.lit(1)).alias("c"))


def corpus_size(sents: DataFrame) -> DataFrame:
    """One row: token_count (words without markers), type_count (distinct words and the three special ones)."""
    words = sents.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    types = F.count_if(~F.col("word").isin(*SPECIALS)) + len(SPECIALS)
    return words.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("token_count"), types.cast("long").alias("type_count"))


def hashed_counts(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """h (the hash of the word ids), c: the counts under fixed-width keys. Equal hashes of different n-grams are one key, as in such a table."""
    parts = counts.select("n", "ngram", "c", F.posexplode(F.split("ngram", " ")).alias("pos", "word"))
    known = vocab.select("word", "word_id")
    ids = parts.join(known, "word", "left").groupBy("n", "ngram", "c").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("word_id", F.lit(0)).alias("id")))).alias("x"))
    keyed = ids.select(hashing.fnv1a(F.col("x.id")).alias("h"), "c")
    return keyed.groupBy("h").agg(F.sum("c").alias("c"))


def text_hashed_counts(texts: DataFrame, order: int, vocab: DataFrame) -> DataFrame:
    """As hashed_counts() of the counts of texts(text), up to three words, with ids looked up for each bucket of n-grams."""

    def keyed(n, words, codes, ids, c):
        yield pa.RecordBatch.from_arrays([pa.array(hashing.fnv1a_columns(ids).view(np.int64)), pa.array(c)], ["h", "c"])

    return grams.numbered(texts.select("text"), order, vocab, keyed, "h long, c long", scratch).groupBy("h").agg(F.sum("c").alias("c"))


def ngram_hashes(texts: DataFrame, order: int, vocab: DataFrame) -> DataFrame:
    """ngram, fnv, chained: both hashes of the ids of each different n-gram of texts(text); any spelling of the unknown word has the id 0."""

    def hashed(n, words, codes, ids, c):
        unk = pc.is_in(words, value_set=pa.array(["<unk>", "<UNK>"])).to_numpy(zero_copy_only=False)
        ids = [np.where(unk[k], 0, x) for k, x in zip(codes, ids, strict=True)]
        found = [hashing.fnv1a_columns(ids).view(np.int64), hashing.chain_columns(ids).view(np.int64)]
        for batch in grams.text_batches(n, words, codes, found, ["n", "ngram", "fnv", "chained"]):
            yield batch.select(["ngram", "fnv", "chained"])

    return grams.numbered(texts.select("text"), order, vocab, hashed, "ngram string, fnv long, chained long", scratch)


def continuation_counts(counts: DataFrame) -> DataFrame:
    """n, ngram, cc: how many different n-grams of the next order end with this one."""
    longer = counts.where("n > 1").select((F.col("n") - 1).alias("n"), T.suffix("ngram").alias("ngram"))
    return longer.groupBy("n", "ngram").agg(F.count(F.lit(1)).alias("cc"))


def effective_counts(counts: DataFrame, order: int, marked_raw: bool = False, unigrams_raw: bool = True, store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """n, ngram, c, e: the count at the highest order (and of single words, if unigrams_raw), else the continuation count.

    marked_raw: n-grams that begin with <s>, which nothing can precede, keep their count. store: keeps what had to be
    counted anew, for callers that read the result several times.
    """
    raw = F.col("n") == order
    raw = raw | (F.col("n") == 1) if unigrams_raw else raw
    plain = counts.where(raw).select("n", "ngram", "c", F.col("c").alias("e"))
    none = F.lit(0).cast("long")
    # A count and the longer n-grams that continue it meet in one aggregate, combined before its shuffle.
    longer = counts.where(F.col("n") > (2 if unigrams_raw else 1)).select((F.col("n") - 1).alias("n"), T.suffix("ngram").alias("ngram"), none.alias("c"), F.lit(1).cast("long").alias("cc"))
    met = counts.where(~raw).select("n", "ngram", "c", none.alias("cc")).unionByName(longer).groupBy("n", "ngram").agg(F.sum("c").alias("c"), F.sum("cc").alias("cc")).where("c > 0")
    e = F.when(T.first_word("ngram") == BOS, F.col("c")).otherwise(F.col("cc")) if marked_raw else F.col("cc")
    met = met.select("n", "ngram", "c", e.alias("e"))
    return plain.unionByName(store(met) if store else met)


def context_stats(effective: DataFrame) -> DataFrame:
    """n, context, total (of effective counts), followers (n-grams of a positive one). One row per context, pre-aggregated."""
    rows = effective.where("n > 1").select("n", T.prefix("ngram").alias("context"), "e")
    return rows.groupBy("n", "context").agg(F.sum("e").alias("total"), F.count_if(F.col("e") > 0).alias("followers"))


def count_of_counts(effective: DataFrame, count: str = "e", pruned: Column | None = None) -> DataFrame:
    """n, types, unpruned, n0 to n4: how many n-grams there are, how many aren't pruned, and how many have each small count."""
    kept = F.count_if(~pruned) if pruned is not None else F.count(F.lit(1))
    return effective.groupBy("n").agg(F.count(F.lit(1)).alias("types"), kept.alias("unpruned"), *[F.count_if(F.col(count) == k).alias(f"n{k}") for k in range(5)])


def kn_discounts(stats: DataFrame) -> DataFrame:
    """n, y, d1, d2, d3, ok: modified Kneser-Ney discounts in single precision; null and not ok where the counts allow none."""
    f = lambda c: F.col(c).cast("float")
    usable = (F.col("n1") != 0) & (F.col("n2") != 0) & (F.col("n3") != 0)
    y = F.when(usable, (f("n1") / (f("n1") + F.lit(2.0).cast("float") * f("n2"))).cast("float"))
    rows = stats.select("n", "n1", "n2", "n3", "n4", y.alias("y"))
    d = [F.when(usable, (F.lit(float(j)).cast("float") - (((F.lit(float(j + 1)).cast("float") * F.col("y")).cast("float") * f(f"n{j + 1}")).cast("float") / f(f"n{j}")).cast("float")).cast("float")) for j in (1, 2, 3)]
    rows = rows.select("n", "y", *[x.alias(f"d{j}") for j, x in enumerate(d, 1)])
    ok = F.coalesce(F.col("d1").between(0, 1) & F.col("d2").between(0, 2) & F.col("d3").between(0, 3), F.lit(False))
    return rows.withColumn("ok", ok)


def discounts_of(stats: DataFrame, order: int, overrides: dict[int, tuple[float, float, float]] | None = None) -> tuple[tuple[float, float, float], ...]:
    """The discounts of all orders (six rows at most come to the driver); overrides win, and without either it's an error."""
    found = {r["n"]: r for r in kn_discounts(stats).collect()}
    out = []
    for n in range(1, order + 1):
        if overrides and n in overrides:
            out.append(tuple(overrides[n]))
        elif n in found and found[n]["ok"]:
            out.append((found[n]["d1"], found[n]["d2"], found[n]["d3"]))
        else:
            raise DiscountError(f"no discounts for order {n}: the counts of counts don't allow any")
    return tuple(out)


def discount_of(count: Column, amounts: tuple[float, float, float]) -> Column:
    """The discount of an effective count: D1, D2, or D3 for 3 and more."""
    return F.when(count <= 1, amounts[0]).when(count == 2, amounts[1]).otherwise(amounts[2])


def discounted(count: Column, amounts: tuple[float, float, float]) -> Column:
    """max(count - discount, 0); 0 for a count of 0."""
    return F.when(count == 0, 0.0).otherwise(F.greatest(count - discount_of(count, amounts), F.lit(0.0)))


def initial_probs(counts: DataFrame, discounts: dict[int, float] | None = None, default: float = 0.75) -> DataFrame:
    """n, ngram, uninterp, gamma: discounted shares of a context before interpolation. A single word is its own denominator."""
    d = F.lit(default)
    for n, amount in (discounts or {}).items():
        d = F.when(F.col("n") == n, float(amount)).otherwise(d)
    rows = counts.select("n", "ngram", "c", T.prefix("ngram").alias("context"))
    stats = context_stats(counts.select("n", "ngram", F.col("c").alias("e")))
    joined = rows.join(stats, ["n", "context"], "left")
    total, followers = F.coalesce("total", "c").cast("double"), F.coalesce("followers", F.lit(1)).cast("double")
    return joined.select("n", "ngram", (F.greatest(F.col("c") - d, F.lit(0.0)) / total).cast("float").alias("uninterp"), (d * followers / total).cast("float").alias("gamma"))


def initial_probs_global(keyed: DataFrame, discount: float = 0.75) -> DataFrame:
    """keyed(h, c) with uninterp and gamma over one denominator, the sum of all counts, in single precision. The sum is one row."""
    f = lambda x: x.cast("float")
    total = keyed.agg(F.sum("c").alias("total"))
    rows = keyed.crossJoin(F.broadcast(total))
    d = f(F.lit(discount))
    return rows.select("h", "c", f(F.greatest(f(F.col("c")) - d, f(F.lit(0.0))) / f(F.col("total"))).alias("uninterp"), f(d / f(F.col("total"))).alias("gamma"))


def pruned_by(thresholds: tuple[int, ...] | list[int]) -> Column:
    """Whether a row(n, c) isn't above its order's threshold."""
    out = F.lit(False)
    for n, least in enumerate(thresholds, 1):
        if least > 0:
            out = out | ((F.col("n") == n) & (F.col("c") <= least))
    return out


def cutoff_count(count: Column, pruned: Column) -> Column:
    """A count that is 0 where the n-gram is marked as pruned."""
    return F.when(pruned, 0).otherwise(count)


def dedupe_multiplier(order: int) -> float:
    """Bytes that deduplication of n-grams takes for each byte of a block."""
    return (4 * order + 12) / 8


def vocab_bytes(words: int) -> int:
    """Bytes of a vocabulary's hash table."""
    return 8 * words + 1024
