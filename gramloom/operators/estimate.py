"""Estimation of back-off models from counts: one join by context and one by suffix for each order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.config import BOS, UNK, BuildConfig
from gramloom.functions import text as T
from gramloom.operators import counts as C
from gramloom.operators import grams
from gramloom.operators.model import Model
from gramloom.storage import scratch, small

LEAST = 1e-300
ROWS = ("n", "ngram", "prob", "backoff", "has_backoff")


def _log10(p: Column) -> Column:
    return F.log10(F.greatest(p, F.lit(LEAST))).cast("float")


def unigram_probs(counts: DataFrame, discount: float = 0.75) -> DataFrame:
    """n, ngram, c, prob of single words: the discounted share plus an equal part of what the discount leaves."""
    words = counts.where("n = 1")
    total, types = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total, bound = float(max(total, 1)), float(max(types + 1, 3))  # all distinct words, markers included, and the unknown one
    p = F.greatest(F.col("c") - discount, F.lit(0.0)) / total + F.lit(discount) * float(types) / total / bound
    return words.select("n", "ngram", "c", _log10(p).alias("prob"))


def _reference(counts: DataFrame, config: BuildConfig) -> DataFrame:
    d, order = config.discount, config.order
    effective = C.effective_counts(counts, order, store=(lambda df: scratch(df, "effective")) if order > 2 else None)  # of two orders all counts are raw ones
    stats = C.context_stats(effective)
    lower = unigram_probs(counts, d).select("n", "ngram", "prob")
    made = [lower]
    for n in range(2, order + 1):
        # Each order is read by the next one and by the result.
        lower = lower if n == 2 else scratch(lower, "lower")
        made[-1] = lower
        below = small(lower.select(F.col("ngram").alias("suffix"), F.col("prob").alias("below")))
        rows = effective.where(F.col("n") == n).select("n", "ngram", "e", T.prefix("ngram").alias("context"), T.suffix("ngram").alias("suffix"))
        rows = rows.join(stats.where(F.col("n") == n).drop("n"), "context").join(below, "suffix")
        total = F.col("total").cast("double")
        share = F.greatest(F.col("e") - d, F.lit(0.0)) / total + F.lit(d) * F.col("followers") / total * F.pow(F.lit(10.0), F.col("below").cast("double"))
        # A context that only <s> opens has no continuation: its probabilities are the floor.
        p = F.when(F.col("total") == 0, LEAST).otherwise(share)
        lower = rows.select("n", "ngram", _log10(p).alias("prob"))
        made.append(lower)
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    inner = F.col("n") < order
    return out.select("n", "ngram", "prob", F.when(inner | (F.col("n") == 1), F.lit(0.0)).cast("float").alias("backoff"), (inner | (F.col("n") == 1)).alias("has_backoff"))


def _corrected(counts: DataFrame, config: BuildConfig) -> DataFrame:
    """Interpolated Kneser-Ney with true backoffs: what a context's followers don't take is its weight for the lower order."""
    order = config.order
    amounts = config.discounts or ((config.discount,) * 3,) * order
    effective = scratch(C.effective_counts(counts, order, marked_raw=True, unigrams_raw=order == 1).where(~((F.col("n") == 1) & (F.col("ngram") == BOS))), "effective")
    gone = C.pruned_by(config.prune_thresholds)
    d = F.lit(0.0)
    for n, a in enumerate(amounts, 1):
        d = F.when(F.col("n") == n, C.discounted(F.col("e"), a)).otherwise(d)
    kept = F.when(~gone, d).otherwise(0.0)
    rows = effective.select("n", "ngram", "e", kept.alias("kept"), gone.alias("gone"), T.prefix("ngram").alias("context"))
    stats = rows.groupBy("n", "context").agg(F.sum("e").alias("total"), F.sum("kept").alias("kept_total"))
    stats = scratch(stats.select("n", "context", F.col("total").cast("double").alias("total"), F.greatest(1 - F.col("kept_total") / F.nullif("total", F.lit(0)), F.lit(0.0)).alias("gamma")), "contexts")
    one = stats.where("n = 1").first()
    types = effective.where("n = 1").where(F.col("ngram") != UNK).count() + 1  # with the unknown word, without <s>
    even = (one["gamma"] if one and one["gamma"] is not None else 1.0) / types
    words = rows.where((F.col("n") == 1) & (F.col("ngram") != UNK)).select("n", "ngram", (F.col("kept") / (one["total"] if one and one["total"] else 1.0) + even).alias("p"))
    lower = words.unionByName(counts.sparkSession.createDataFrame([(1, UNK, float(even))], "n int, ngram string, p double"))
    made = [lower]
    for n in range(2, order + 1):
        below = scratch(lower, "lower").select(F.col("ngram").alias("suffix"), F.col("p").alias("below"))
        found = rows.where((F.col("n") == n) & ~F.col("gone")).select("n", "ngram", "kept", "context", T.suffix("ngram").alias("suffix"))
        found = found.join(stats.where(F.col("n") == n).drop("n"), "context").join(below, "suffix")
        lower = found.select("n", "ngram", (F.col("kept") / F.col("total") + F.col("gamma") * F.col("below")).alias("p"))
        made.append(lower)
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    out = out.select("n", "ngram", _log10(F.col("p")).alias("prob"))
    out = out.unionByName(counts.sparkSession.createDataFrame([(1, BOS, -99.0)], "n int, ngram string, prob float"))
    weights = stats.where("n > 1").select(F.col("context").alias("ngram"), F.log10(F.greatest("gamma", F.lit(LEAST))).cast("float").alias("backoff"))
    out = out.join(weights, "ngram", "left")
    return out.select("n", "ngram", "prob", "backoff", F.col("backoff").isNotNull().alias("has_backoff"))


def estimate(counts: DataFrame, config: BuildConfig = BuildConfig()) -> DataFrame:
    """n, ngram, prob, backoff, has_backoff of all n-grams of counts(n, ngram, c).

    "reference": fixed discount, raw counts at the highest order and for single words, continuation counts between,
    backoffs of 0. "corrected": interpolated Kneser-Ney whose probabilities add up to 1 in every context.
    """
    return _reference(counts, config) if config.semantics == "reference" else _corrected(counts, config)


def estimated(source: DataFrame, config: BuildConfig = BuildConfig()) -> DataFrame:
    """As estimate(), of the n-grams of source's sentences(words) or, without such a column, of its texts' lines (text)."""
    source = source.select("words" if "words" in source.columns else "text")
    if config.semantics == "reference" and config.order in (2, 3):
        return grams.reference_model(grams.statistics(source, config.order, scratch), config.discount, LEAST)
    return estimate(scratch(C.count_ngrams(source, config.order), "counts"), config)


def build(source: DataFrame, config: BuildConfig = BuildConfig()) -> Model:
    """A model from sentences(words) or texts(text). Every n-gram's prefix and suffix are counted too, so the model has no gaps."""
    rows = scratch(estimated(source, config), "model")
    return Model.from_rows(rows, config.order, semantics=config.semantics, complete=True, flat=config.semantics == "reference")


def interpolate(uninterp: DataFrame, order: int, vocab_size: int, floor: float = LEAST) -> DataFrame:
    """n, ngram, p: uninterp(n, ngram, uninterp, gamma) mixed with each n-gram's suffix, from the uniform probability upwards."""
    lower, made = None, []
    for n in range(1, order + 1):
        rows = uninterp.where(F.col("n") == n).select("n", "ngram", "uninterp", "gamma", T.suffix("ngram").alias("suffix"))
        if lower is None:
            rows = rows.withColumn("below", F.lit(1.0 / vocab_size))
        else:
            rows = rows.join(scratch(lower, "lower").select(F.col("ngram").alias("suffix"), F.col("p").alias("below")), "suffix", "left")
        below = F.coalesce("below", F.lit(1.0 / vocab_size))
        lower = rows.select("n", "ngram", F.least(F.greatest(F.col("uninterp") + F.col("gamma") * below, F.lit(floor)), F.lit(1.0)).alias("p"))
        made.append(lower)
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def output_prob_backoff(p: Column, full_backoff: Column) -> tuple[Column, Column]:
    """Log probability (at most 0) and log backoff of an interpolated n-gram."""
    return F.least(F.log10(p), F.lit(0.0)).cast("float"), F.log10(full_backoff).cast("float")


def output_q(p: Column, full_backoff: Column, below_q: Column | None = None, backoff: Column | None = None) -> tuple[Column, Column]:
    """(log of p times q, q): q is the backoff at order 1, then the lower order's q by its backoff times the new one."""
    q = full_backoff if below_q is None else below_q / backoff * full_backoff
    return F.log10(p * q).cast("float"), q
