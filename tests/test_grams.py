"""N-grams coded as numbers, against the same tables made by joins and aggregates of texts."""

import pytest
from pyspark.sql import functions as F

from gramloom.config import BuildConfig
from gramloom.functions import text as T
from gramloom.operators import corpus, estimate, grams
from gramloom.operators import counts as C
from gramloom.storage import scratch

TEXTS = ["a b c a b\n<s> a </s> b\nx </s>\n\n  \na <s> b <unk>", None, "", "a b c\r\n</s>\n<s>\n<s> <s>\n</s> </s>", "x y　z \u0085w\x1cv", "é ü é ü\ta  b\x0bc", "lone"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS * 3)), "doc_id long, text string")


def plain(docs, order):
    marked = corpus.sentences(docs).select(C.marked().alias("t"))
    return scratch(T.exploded_ngrams(marked, "t", order).groupBy("n", "ngram").agg(F.count(F.lit(1)).alias("c")), "plain")


def same(a, b):
    assert a.dtypes == b.dtypes
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_counts(docs, order, monkeypatch):
    monkeypatch.setattr(grams, "TOKENS", 7)  # many chunks
    same(plain(docs, order), grams.counted(docs.select("text"), order))
    same(plain(docs, order), C.count_ngrams(corpus.sentences(docs), order))
    same(plain(docs, order).where(F.col("n") == order), C.count_ngrams(docs, order, order))


def test_no_row_of_text_is_shuffled(docs):
    plan = C.count_ngrams(docs, 3)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("Exchange") == 1


def test_statistics(docs):
    counts, s = plain(docs, 3), grams.statistics(docs.select("text"), 3, scratch)
    effective = C.effective_counts(counts, 3)
    same(effective, grams.effective_counts(s))
    same(C.continuation_counts(counts).select(F.col("n").cast("int"), "ngram", "cc"), grams.continuation_counts(s))
    same(C.context_stats(effective), grams.context_stats(s))
    same(C.count_of_counts(C.effective_counts(counts, 3, marked_raw=True, unigrams_raw=False)), grams.marked_count_of_counts(s))


@pytest.mark.parametrize("order", [2, 3])
def test_reference_models(docs, order):
    config = BuildConfig(order=order)
    same(estimate.estimate(plain(docs, order), config), estimate.estimated(docs, config))


def test_keys_of_many_words():
    a, b, c = (grams.np.array(x) for x in ([3, 1, 3], [2, 2, 1 << 22], [1 << 22, 5, 0]))
    keys, back = grams.triples(a, b, c, (1 << 22) + 1)
    assert [list(x) for x in back(keys)] == [list(a), list(b), list(c)] and len(set(keys)) == 3


@pytest.mark.parametrize("order", [2, 3])
def test_document_scores_of_large_models(docs, order, monkeypatch):
    """Texts that ask for their n-grams get the scores that arrays give, unknown words and repeated keys among them."""
    from gramloom.operators import lookup, score

    known = docs.where("doc_id % 6 < 4")
    asks = docs.unionByName(docs.where("doc_id < 3")).unionByName(docs.sparkSession.createDataFrame([(99, "q a b\nb c a\n<unk> x")], docs.schema))
    rounded = lambda df: df.select("doc_id", F.round("total", 4).alias("total"), "oov", "tokens")
    small = rounded(score.document_scores(asks, estimate.build(known, BuildConfig(order=order))))
    small = small.localCheckpoint()
    monkeypatch.setattr(lookup, "ARRAY_BYTES", 0)
    monkeypatch.setattr(grams, "TOKENS", 30)
    calls, real = [], grams.document_scores
    monkeypatch.setattr(grams, "document_scores", lambda *a: calls.append(1) or real(*a))
    same(small, rounded(score.document_scores(asks, estimate.build(known, BuildConfig(order=order)))))
    assert calls
    same(small, rounded(score.estimated_scores(asks, known, BuildConfig(order=order))))


@pytest.mark.parametrize("order", ["suffix", "context", "prefix"])
def test_ranks(docs, order, monkeypatch):
    """Ranges of a few n-grams each give the places of a sort by all."""
    from gramloom.operators import ordering

    monkeypatch.setattr(grams, "TOKENS", 30)
    monkeypatch.setattr(grams, "buckets_of", lambda _: 9)
    same(ordering.ranked_by(plain(docs, 3), order).select("n", "ngram", F.col("rank").cast("long")), grams.ranked(docs.select("text"), order, scratch))


def test_ids_and_hashes(docs, monkeypatch):
    """Ids that buckets ask for give the hashes that joins of single words give; keys come unsorted and twice."""
    from gramloom.functions import hashing

    rows = docs.orderBy(F.col("doc_id") % 5).unionByName(docs.where("doc_id = 4")).unionByName(docs.sparkSession.createDataFrame([(2, "z <UNK> new\n\nlate")], docs.schema))
    sents = corpus.sentences(rows)
    vocab = scratch(corpus.vocab_ids(sents, "doc_id", "line_no"), "vocab")
    same(vocab, corpus.text_vocab_ids(rows))
    counts = plain(rows, 3)
    same(C.hashed_counts(counts.where("n < 3"), vocab), C.text_hashed_counts(rows, 2, vocab))
    parts = counts.select("ngram", F.posexplode(F.split("ngram", " ")).alias("pos", "word"))
    ids = corpus.lookup_ids(parts, vocab).groupBy("ngram").agg(F.array_sort(F.collect_list(F.struct("pos", "word_id"))).alias("x"))
    same(ids.select("ngram", hashing.fnv1a(F.col("x.word_id")).alias("fnv"), hashing.chain(F.col("x.word_id")).alias("chained")), C.ngram_hashes(rows, 3, vocab))


def test_bins_of_counted_values(spark, monkeypatch):
    """Equal values in several bins, and spans of few values."""
    from gramloom.operators import quantize

    monkeypatch.setattr(quantize, "SPAN", 3)
    values = [(n, float(v)) for n, count in ((2, 57), (3, 5)) for v in (k * k % 11 for k in range(count))]
    for size in (1, 4, 16):
        found = {(r["n"], r["bin"]): r["centre"] for r in quantize.bins(spark.createDataFrame(values, "n int, value float"), size).collect()}
        for n in (2, 3):
            held = sorted(v for k, v in values if k == n)
            parts = {i: held[len(held) * i // size : len(held) * (i + 1) // size] for i in range(size)}
            assert {i: round(sum(x) / len(x), 5) for i, x in parts.items() if x} == {i: round(c, 5) for (k, i), c in found.items() if k == n}
