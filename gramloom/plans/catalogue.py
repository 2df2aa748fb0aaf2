"""One query for each operator over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.config import BuildConfig
from gramloom.functions import hashing
from gramloom.functions import text as T
from gramloom.operators import corpus, estimate, filters, grams, model, ordering, quantize, score
from gramloom.operators import counts as C
from gramloom.plans import sql as S
from gramloom.sources import arpa, store
from gramloom.storage import ranked, scratch, shared_dir, spread, table
from gramloom.streaming.scoring import windowed_counts

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), f"{sf_dir}/documents.parquet")


def _sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sentences(_docs(spark, sf_dir))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("text"), f"{sf_dir}/documents.parquet")


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sentences(table(spark, sf_dir, "benchmark"), by="item_id")


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    return corpus.sentences(rows, by="id").select("id.conv_id", "id.turn", "line_no", "words")


def _counts(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    return scratch(C.count_ngrams(_texts(spark, sf_dir), order), "counts")


def _statistics(spark: SparkSession, sf_dir: str, order: int) -> grams.Statistics:
    return grams.statistics(_texts(spark, sf_dir), order, scratch)


def _model(spark: SparkSession, sf_dir: str, order: int, semantics: str = "reference") -> model.Model:
    return estimate.build(_texts(spark, sf_dir), BuildConfig(order=order, semantics=semantics))


_DOCS = S.sents()
_HELD = S.sents("benchmark", "item_id", "b")
_TALK = S.sents("conversations", "conv_id turn", "b")

# --- corpus and counts ----------------------------------------------------------------------------------------------


@query(S.with_(_DOCS) + "SELECT doc_id, line_no, CAST(unnest(range(len(words))) AS INTEGER) AS pos, unnest(words) AS word FROM s")
def sentence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.token_rows(_sents(spark, sf_dir), "doc_id", "line_no")


def _add_counts(n: int) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.count_ngrams(_texts(spark, sf_dir), n, n).select("ngram", "c")

    f.__name__ = f"ngram_counts_{n}"
    query(S.with_(_DOCS, S.counts(n, n)) + "SELECT ngram, c FROM c")(f)


for _n in (1, 2, 3):
    _add_counts(_n)


@query(S.with_(_DOCS) + "SELECT count(*) AS token_count, count(DISTINCT word) FILTER (word NOT IN ('<unk>', '<s>', '</s>')) + 3 AS type_count FROM (SELECT unnest(words) AS word FROM s)")
def token_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.corpus_size(_sents(spark, sf_dir))


@query(S.with_(_DOCS, S.vocab()) + "SELECT word, word_id FROM v")
def vocab_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.text_vocab_ids(_docs(spark, sf_dir))


@query(S.with_(_DOCS, S.counts(3), S.effective(3)) + "SELECT CAST(n AS INTEGER) AS n, ngram, cc FROM e_cc")
def continuation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.continuation_counts(_statistics(spark, sf_dir, 3))


@query(S.with_(_DOCS, S.counts(3), S.effective(3)) + "SELECT n, ngram, c, e FROM e")
def effective_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.effective_counts(_statistics(spark, sf_dir, 3))


@query(S.with_(_DOCS, S.counts(3), S.effective(3), S.contexts()) + "SELECT n, context, total, followers FROM x")
def context_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.context_stats(_statistics(spark, sf_dir, 3))


_STATS = "st AS (SELECT n, count(*) AS types, count(*) AS unpruned, " + ", ".join(f"count(*) FILTER (e = {k}) AS n{k}" for k in range(5)) + " FROM e GROUP BY n)"


@query(S.with_(_DOCS, S.counts(3), S.effective(3, raw="c.n = 3 OR starts_with(c.ngram, '<s>')"), _STATS) + "SELECT * FROM st")
def count_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.marked_count_of_counts(_statistics(spark, sf_dir, 3))


@query(
    S.with_(_DOCS, S.counts(3), S.effective(3, raw="c.n = 3 OR starts_with(c.ngram, '<s>')"), _STATS, "y AS (SELECT *, CAST(n1 AS FLOAT) / (CAST(n1 AS FLOAT) + CAST(2 AS FLOAT) * CAST(n2 AS FLOAT)) AS y FROM st WHERE n1 <> 0 AND n2 <> 0 AND n3 <> 0)",
            "d AS (SELECT n, y, " + ", ".join(f"CAST({j} AS FLOAT) - CAST({j + 1} AS FLOAT) * y * CAST(n{j + 1} AS FLOAT) / CAST(n{j} AS FLOAT) AS d{j}" for j in (1, 2, 3)) + " FROM y)")
    + "SELECT n, y, d1, d2, d3, d1 BETWEEN 0 AND 1 AND d2 BETWEEN 0 AND 2 AND d3 BETWEEN 0 AND 3 AS ok FROM d"
)
def kn_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.kn_discounts(grams.marked_count_of_counts(_statistics(spark, sf_dir, 3)))


_DIRECT = f"""i AS (SELECT c.n, c.ngram, CAST(greatest(c.c - 0.75e0, 0e0) / coalesce(x.total, c.c) AS FLOAT) AS uninterp, CAST(0.75e0 * coalesce(x.f, 1) / coalesce(x.total, c.c) AS FLOAT) AS gamma
FROM c LEFT JOIN (SELECT n, {S.prefix()} AS context, sum(c)::DOUBLE AS total, count(*)::DOUBLE AS f FROM c WHERE n > 1 GROUP BY 1, 2) x ON x.n = c.n AND x.context = {S.prefix('c.ngram')})"""


@query(S.with_(_DOCS, S.counts(2), _DIRECT) + "SELECT * FROM i")
def initial_probs_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.initial_probs(_counts(spark, sf_dir, 2))


_IDS = "w AS (SELECT n, ngram, c, list(coalesce(v.word_id, 0) ORDER BY k) AS ids FROM (SELECT n, ngram, c, unnest(string_split(ngram, ' ')) AS word, unnest(range(n)) AS k FROM c) g LEFT JOIN v ON v.word = g.word GROUP BY n, ngram, c)"
_HASHED = f"hh AS (SELECT {S.SIGNED.format('h')} AS h, CAST(sum(c) AS BIGINT) AS c FROM (SELECT {S.fnv('ids')} AS h, c FROM w) GROUP BY 1)"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.text_hashed_counts(_texts(spark, sf_dir), 2, corpus.text_vocab_ids(_docs(spark, sf_dir)))


@query(S.with_(_DOCS, S.counts(2), S.vocab(), _IDS, _HASHED) + "SELECT h, c FROM hh")
def hashed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir)


@query(S.with_(_DOCS, S.counts(2), S.vocab(), _IDS, _HASHED) + "SELECT h, c, greatest(CAST(c AS FLOAT) - CAST(0.75 AS FLOAT), CAST(0 AS FLOAT)) / CAST(t AS FLOAT) AS uninterp, CAST(0.75 AS FLOAT) / CAST(t AS FLOAT) AS gamma FROM hh, (SELECT sum(c) AS t FROM hh)")
def initial_probs_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.initial_probs_global(scratch(_hashed(spark, sf_dir), "hashed"))


# --- models ---------------------------------------------------------------------------------------------------------


@query(S.with_(_DOCS, S.counts(1), S.unigrams()) + "SELECT ngram, prob FROM p1")
def unigram_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate.unigram_probs(_counts(spark, sf_dir, 1)).select("ngram", "prob")


def _add_model(order: int, name: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return estimate.estimated(_texts(spark, sf_dir), BuildConfig(order=order)).select("n", "ngram", "prob", "backoff")

    f.__name__ = name
    query(S.with_(_DOCS, S.counts(order), S.model(order)) + f"SELECT n, ngram, prob, CASE WHEN n < {order} THEN CAST(0 AS FLOAT) END AS backoff FROM p")(f)


_add_model(2, "bigram_model")
_add_model(3, "trigram_model")

_KN = f"""q AS (SELECT n, ngram, e, CASE WHEN e = 0 THEN 0e0 ELSE greatest(e - 0.75e0, 0e0) END AS kept, {S.prefix()} AS context FROM e WHERE NOT (n = 1 AND ngram = '<s>')),
k AS (SELECT n, context, sum(e)::DOUBLE AS total, greatest(1 - sum(kept) / sum(e), 0) AS gamma FROM q GROUP BY 1, 2),
k1 AS (SELECT total, gamma / (SELECT count(*) + 1 FROM q WHERE n = 1 AND ngram <> '<unk>') AS even FROM k WHERE n = 1),
r1 AS (SELECT 1 AS n, ngram, kept / total + even AS p FROM q, k1 WHERE n = 1 AND ngram <> '<unk>' UNION ALL SELECT 1, '<unk>', even FROM k1),
r2 AS (SELECT q.n, q.ngram, q.kept / k.total + k.gamma * r1.p AS p FROM q JOIN k ON k.n = 2 AND k.context = q.context JOIN r1 ON r1.ngram = {S.suffix('q.ngram')} WHERE q.n = 2),
r AS (SELECT n, ngram, log10(greatest(p, 1e-300)) AS prob FROM r1 UNION ALL SELECT n, ngram, log10(greatest(p, 1e-300)) FROM r2 UNION ALL SELECT 1, '<s>', -99)"""


@query(
    S.with_(_DOCS, S.counts(2), S.effective(2, raw="c.n = 2 OR starts_with(c.ngram, '<s>')"), _KN)
    + "SELECT CAST(r.n AS INTEGER) AS n, r.ngram, round(CAST(CAST(r.prob AS FLOAT) AS DOUBLE), 4) AS prob, CASE WHEN k.gamma IS NOT NULL THEN round(CAST(CAST(log10(greatest(k.gamma, 1e-300)) AS FLOAT) AS DOUBLE), 4) END AS backoff FROM r LEFT JOIN k ON k.n = 2 AND k.context = r.ngram"
)
def corrected_bigram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = estimate.estimate(_counts(spark, sf_dir, 2), BuildConfig(order=2, semantics="corrected"))
    return rows.select("n", "ngram", F.round(F.col("prob").cast("double"), 4).alias("prob"), F.round(F.col("backoff").cast("double"), 4).alias("backoff"))


@query(
    S.with_(_DOCS, S.counts(2), _DIRECT, "z AS (SELECT count(*) + 1 AS v FROM c WHERE n = 1)", "j1 AS (SELECT n, ngram, least(greatest(CAST(uninterp AS DOUBLE) + CAST(gamma AS DOUBLE) * (1e0 / v), 1e-300), 1) AS p FROM i, z WHERE n = 1)",
            f"j2 AS (SELECT i.n, i.ngram, least(greatest(CAST(i.uninterp AS DOUBLE) + CAST(i.gamma AS DOUBLE) * coalesce(j1.p, 1e0 / v), 1e-300), 1) AS p FROM i LEFT JOIN j1 ON j1.ngram = {S.suffix('i.ngram')}, z WHERE i.n = 2)")
    + "SELECT n, ngram, round(p, 6) AS p FROM j1 UNION ALL SELECT n, ngram, round(p, 6) FROM j2"
)
def interpolated_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(spark, sf_dir, 2)
    size = counts.where("n = 1").count() + 1
    return estimate.interpolate(C.initial_probs(counts), 2, size).select("n", "ngram", F.round("p", 6).alias("p"))


# --- scores ---------------------------------------------------------------------------------------------------------


@query(S.with_(_DOCS, _HELD) + "SELECT item_id, line_no, pos, word FROM (SELECT item_id, line_no, CAST(unnest(range(len(words))) AS INTEGER) AS pos, unnest(words) AS word FROM b) WHERE word NOT IN (SELECT unnest(words) FROM s)")
def oov_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.oov_tokens(_held(spark, sf_dir), ["item_id", "line_no"], _model(spark, sf_dir, 1))


@query(S.with_(_DOCS, _HELD, S.counts(2), S.model(2), S.scores(2, "item_id", "b")) + "SELECT * FROM t")
def token_scores_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.score_tokens(_held(spark, sf_dir), ["item_id", "line_no"], _model(spark, sf_dir, 2))


@query(S.with_(_DOCS, _HELD, S.counts(3), S.model(3), S.scores(3, "item_id", "b")) + "SELECT * FROM t")
def token_scores_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.score_tokens(_held(spark, sf_dir), ["item_id", "line_no"], _model(spark, sf_dir, 3))


@query(S.with_(_DOCS, _TALK, S.counts(2), S.model(2), S.scores(2, "conv_id turn", "b")) + "SELECT conv_id, turn, line_no, round(sum(CAST(prob AS DOUBLE)), 4) AS total, count(*) FILTER (oov) AS oov, count(*) AS tokens FROM t GROUP BY conv_id, turn, line_no")
def sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["conv_id", "turn", "line_no"]
    found = score.sentence_scores(score.score_tokens(_talk(spark, sf_dir), by, _model(spark, sf_dir, 2)), by)
    return found.select(*by, F.round("total", 4).alias("total"), "oov", "tokens")


@query(S.with_(_DOCS, _HELD, S.counts(2), S.model(2), S.scores(2, "item_id", "b", bos=False)) + "SELECT * FROM t")
def score_no_bos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.score_tokens(_held(spark, sf_dir), ["item_id", "line_no"], _model(spark, sf_dir, 2), bos=False)


def _doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.estimated_scores(_docs(spark, sf_dir), _texts(spark, sf_dir), BuildConfig(order=2))


_DOC_SCORES = (_DOCS, S.counts(2), S.model(2), S.scores(2, "doc_id", "s"), "ds AS (SELECT doc_id, sum(CAST(prob AS DOUBLE)) AS total, count(*) FILTER (oov) AS oov, count(*) AS tokens FROM t GROUP BY doc_id)")


@query(S.with_(*_DOC_SCORES) + "SELECT doc_id, round(total, 4) AS total, tokens, round(pow(10e0, -total / tokens), 4) AS perplexity FROM ds")
def doc_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = _doc_scores(spark, sf_dir)
    return ds.select("doc_id", F.round("total", 4).alias("total"), "tokens", F.round(score.perplexity(F.col("total"), F.col("tokens")), 4).alias("perplexity"))


@query(S.with_(*_DOC_SCORES) + "SELECT lang, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens, round(pow(10e0, -sum(total) / sum(tokens)), 4) AS perplexity FROM ds JOIN documents d ON d.doc_id = ds.doc_id GROUP BY lang")
def perplexity_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = table(spark, sf_dir, "documents").select("doc_id", "lang")
    sums = _doc_scores(spark, sf_dir).join(about, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"), F.sum("total").alias("total"))
    return sums.select("lang", "docs", "tokens", F.round(score.perplexity(F.col("total"), F.col("tokens")), 4).alias("perplexity"))


@query(S.with_(*_DOC_SCORES) + "SELECT quality, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens, round(pow(10e0, -sum(total) / sum(tokens)), 4) AS perplexity FROM ds JOIN labels l ON l.doc_id = ds.doc_id GROUP BY quality")
def perplexity_quality_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    sums = _doc_scores(spark, sf_dir).join(labels, "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"), F.sum("total").alias("total"))
    return sums.select("quality", "docs", "tokens", F.round(score.perplexity(F.col("total"), F.col("tokens")), 4).alias("perplexity"))


@query(
    S.with_(_DOCS, _HELD, S.counts(3), "a AS (SELECT item_id, line_no, words[-2:] AS w FROM b)")
    + """SELECT item_id, line_no, CAST(CASE WHEN len(w) = 2 AND c2.ngram IS NOT NULL THEN 2 ELSE 1 END AS INTEGER) AS state_len,
  CASE WHEN len(w) = 2 AND c2.ngram IS NOT NULL THEN w[2] || ' ' || w[1] ELSE w[-1] END AS state_words
FROM a LEFT JOIN c c2 ON c2.n = 2 AND c2.ngram = array_to_string(w, ' ')"""
)
def get_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["item_id", "line_no"]
    found = score.states(_held(spark, sf_dir), by, _model(spark, sf_dir, 3))
    return found.select(*by, "state_len", F.array_join("state_words", " ").alias("state_words"))


@query(
    S.with_(_DOCS, _HELD, S.counts(2), S.model(2), S.scores(2, "item_id", "b"))
    + """SELECT item_id, line_no, pos AS line_no_out, 'p=' || printf('%.6f', CAST(prob AS DOUBLE)) || ' [' || ngram_length || '] ' || word AS line FROM t
UNION ALL SELECT item_id, line_no, CAST(count(*) + 1 AS INTEGER), 'Total: ' || printf('%.6f', sum(CAST(prob AS DOUBLE))) || ' OOV: ' || count(*) FILTER (oov) || ' Tokens: ' || count(*) FROM t GROUP BY item_id, line_no"""
)
def query_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["item_id", "line_no"]
    tokens = score.score_tokens(_held(spark, sf_dir), by, _model(spark, sf_dir, 2)).withColumnRenamed("line_no", "sentence")
    lines = score.query_lines(tokens, ["item_id", "sentence"])
    return lines.select("item_id", F.col("sentence").alias("line_no"), F.col("line_no").alias("line_no_out"), "line")


_CORRECTED_SCORES = """cm AS (SELECT conv_id, turn, line_no, list_concat(['<s>'], words, ['</s>']) AS m FROM b),
ct AS (SELECT conv_id, turn, line_no, CAST(i - 1 AS INTEGER) AS pos, m[i] AS word, m[i - 1] AS context FROM cm, LATERAL (SELECT unnest(range(2, len(m) + 1)) AS i) u),
co AS (SELECT ct.*, x2.prob AS p2, coalesce(x1.prob, u.prob) AS p1, x1.ngram IS NULL OR ct.word = '<unk>' AS oov, k.gamma FROM ct
  LEFT JOIN r x2 ON x2.n = 2 AND x2.ngram = ct.context || ' ' || ct.word LEFT JOIN r x1 ON x1.n = 1 AND x1.ngram = ct.word LEFT JOIN k ON k.n = 2 AND k.context = ct.context, (SELECT prob FROM r WHERE ngram = '<unk>') u)"""


@query(
    S.with_(_DOCS, _TALK, S.counts(2), S.effective(2, raw="c.n = 2 OR starts_with(c.ngram, '<s>')"), _KN, _CORRECTED_SCORES)
    + """SELECT conv_id, turn, line_no, pos, word, CASE WHEN p2 IS NULL THEN 1 ELSE 2 END AS ngram_length, oov,
  round(CASE WHEN p2 IS NOT NULL THEN CAST(CAST(p2 AS FLOAT) AS DOUBLE) ELSE CAST(CAST(p1 AS FLOAT) AS DOUBLE) + CASE WHEN gamma IS NULL THEN 0 ELSE CAST(CAST(log10(greatest(gamma, 1e-300)) AS FLOAT) AS DOUBLE) END END, 3) AS prob FROM co"""
)
def token_scores_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a model with true backoffs, also of words that it doesn't know."""
    by = ["conv_id", "turn", "line_no"]
    found = score.score_tokens(_talk(spark, sf_dir), by, _model(spark, sf_dir, 2, "corrected"))
    return found.select(*by, "pos", "word", "ngram_length", "oov", F.round(F.col("prob").cast("double"), 3).alias("prob"))


@query()
def token_scores_gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a model whose longer n-grams lack prefixes; tests hold them against the walk from word to word."""
    rows = _gappy(spark, sf_dir).select("n", "ngram", (-F.log10(F.col("c") + 1.0) / F.col("n")).cast("float").alias("prob"), F.lit(-0.25).cast("float").alias("backoff"), (F.col("n") < 3).alias("has_backoff"), "line_no")
    return score.score_tokens(_held(spark, sf_dir), ["item_id", "line_no"], model.derive(rows, 3), detail=True)


@query(S.with_(_DOCS, S.counts(3), S.model(3), S.scores(3, "doc_id", "s")) + "SELECT doc_id, round(sum(CAST(prob AS DOUBLE)), 3) AS total, count(*) FILTER (oov) AS oov, count(*) AS tokens FROM t GROUP BY doc_id")
def doc_scores_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.estimated_scores(_docs(spark, sf_dir), _texts(spark, sf_dir), BuildConfig(order=3)).select("doc_id", F.round("total", 3).alias("total"), "oov", "tokens")


# --- filters --------------------------------------------------------------------------------------------------------

_FREQUENT = "fv AS (SELECT ngram AS word FROM c WHERE c >= 20 AND ngram NOT IN ('<s>', '</s>'))"
_LINES = "ln AS (SELECT doc_id * 1000000 + line_no AS line_no, line FROM s_l)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines("text")).alias("p", "line"))
    return rows.select((F.col("doc_id") * 1_000_000 + F.col("p")).alias("line_no"), "line")


def _frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.count_ngrams(_texts(spark, sf_dir), 1).where("c >= 20 and ngram not in ('<s>', '</s>')")
    return scratch(rows.select(F.col("ngram").alias("word")), "frequent")


_JUDGED = f"ju AS (SELECT line_no, line, {S._WORDS.format('line')} AS w FROM ln WHERE line <> '')"
_PASS = "pa AS (SELECT j.line_no, j.line FROM ju j LEFT JOIN (SELECT DISTINCT line_no FROM (SELECT line_no, unnest({0}) AS word FROM ju) u WHERE NOT EXISTS (SELECT 1 FROM fv WHERE fv.word = u.word)) x ON x.line_no = j.line_no WHERE x.line_no IS NULL AND len(j.w) > 0)"
_ALL, _CONTEXT = _PASS.format("w"), _PASS.format("CASE WHEN len(w) > 1 THEN w[1:len(w) - 1] ELSE w END")


@query(S.with_(_DOCS, S.counts(1), _FREQUENT, _LINES, _JUDGED, _ALL) + "SELECT * FROM pa")
def filter_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.run_filter(_lines(spark, sf_dir), _frequent(spark, sf_dir), "copy")


@query(S.with_(_DOCS, S.counts(1), _FREQUENT, _LINES, _JUDGED, _CONTEXT) + "SELECT * FROM pa")
def filter_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.run_filter(_lines(spark, sf_dir), _frequent(spark, sf_dir), "single", context_only=True)


@query(S.with_(_DOCS, S.counts(1), _FREQUENT, _LINES, _JUDGED, _ALL) + "SELECT min(line_no) AS line_no, line FROM pa GROUP BY line")
def filter_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.run_filter(_lines(spark, sf_dir), _frequent(spark, sf_dir), "union")


@query(
    S.with_(_DOCS, S.counts(1), _FREQUENT, _LINES, _JUDGED, _ALL, "mk AS (SELECT line_no, line, true AS ok FROM pa UNION ALL SELECT line_no, line, false FROM ln WHERE line = '')")
    + "SELECT line_no, line FROM (SELECT *, lag(ok) OVER (ORDER BY line_no) AS before FROM mk) WHERE ok OR coalesce(before, false)"
)
def filter_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.run_filter(_lines(spark, sf_dir), _frequent(spark, sf_dir), "multiple")


@query(S.with_(_HELD) + "SELECT DISTINCT item_id, line_no, array_to_string(words[a.i:z.j], ' ') AS ngram FROM b, LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i) a, LATERAL (SELECT unnest(range(a.i, len(words) + 1)) AS j) z")
def phrase_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of the benchmark as the source side of a phrase table's line."""
    held = _held(spark, sf_dir)
    lines = held.select(F.struct("item_id", "line_no").alias("line_no"), F.concat(F.array_join("words", " "), F.lit(" ||| x y")).alias("line"))
    return filters.phrase_ngrams(lines).select("line_no.item_id", "line_no.line_no", "ngram")


# --- orders, text and derivation ------------------------------------------------------------------------------------


def _add_rank(order: str, key: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return grams.ranked(_texts(spark, sf_dir), order, scratch)

    f.__name__ = f"{order}_sorted_rank"
    query(S.with_(_DOCS, S.counts(3)) + f"SELECT n, ngram, row_number() OVER (PARTITION BY n ORDER BY {key}) AS rank FROM c")(f)


_add_rank("suffix", "list_reverse(string_split(ngram, ' '))")
_add_rank("context", "list_reverse(string_split(ngram, ' ')[1:n - 1]), string_split(ngram, ' ')[n]")
_add_rank("prefix", "string_split(ngram, ' ')")


@query(S.with_(_DOCS, S.counts(2), "ev AS (SELECT n, ngram, 'enter' AS event, string_split(ngram, ' ') AS k FROM c UNION ALL SELECT n, ngram, 'exit', list_append(string_split(ngram, ' '), chr(1114111)) FROM c)") + "SELECT n, ngram, event, row_number() OVER (ORDER BY k) AS rank FROM ev")
def walk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk over all orders at once: where it enters and leaves each n-gram."""
    return ranked(ordering.walk_events(_counts(spark, sf_dir, 2)), [F.col("key")]).select("n", "ngram", "event", "rank")


@query(S.with_(_DOCS) + "SELECT line, count(*) AS c FROM s_l GROUP BY line")
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' lines written as text files and read back."""
    path = f"{shared_dir(spark)}/gramloom/corpus-{uuid.uuid4().hex}"
    _lines(spark, sf_dir).select("line").write.text(path)
    return corpus.read_corpus(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("c"))


@query(S.with_(_DOCS, S.counts(2), "sz AS (SELECT n, ngram FROM c UNION ALL SELECT 1, '<unk>')") + "SELECT n, count(*) AS entries, CAST(sum(octet_length(encode(ngram))) AS BIGINT) AS text_bytes, CAST(ceil(count(*) * CASE WHEN n = 1 THEN 67 ELSE 35 END / 8) AS BIGINT) AS value_bytes FROM sz GROUP BY n")
def model_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.sizes(_model(spark, sf_dir, 2))


@query(S.with_(_DOCS, S.counts(2)) + "SELECT DISTINCT line FROM s_l WHERE line <> ''")
def distinct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.sorted_distinct(_lines(spark, sf_dir).where("line <> ''").select("line"))


_TEXT = r"""tx AS (SELECT 0 AS section, 0 AS kind, CAST([] AS VARCHAR[]) AS words, '\data\' AS line UNION ALL SELECT 0, n, [], 'ngram ' || n || '=' || count(*) FROM p GROUP BY n UNION ALL SELECT 0, 99, [], '' UNION ALL SELECT 3, 0, [], '\end\'
UNION ALL SELECT u.n, 0, [], '\' || u.n || '-grams:' FROM (VALUES (1), (2)) u(n) UNION ALL SELECT u.n, 99, [], '' FROM (VALUES (1), (2)) u(n)
UNION ALL SELECT n, 1, string_split(ngram, ' '), printf('%.7f', CAST(prob AS DOUBLE)) || chr(9) || replace(ngram, ' ', chr(9)) || CASE WHEN n = 1 THEN chr(9) || '0.0000000' ELSE '' END FROM p)"""


@query(S.with_(_DOCS, S.counts(2), S.model(2), _TEXT) + "SELECT section, line, row_number() OVER (ORDER BY section, kind, words) AS rank FROM tx")
def arpa_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text's lines with their places."""
    rows = scratch(estimate.estimated(_texts(spark, sf_dir), BuildConfig(order=2)), "model")
    counts = {r["n"]: r["c"] for r in rows.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    return ranked(arpa.arpa_lines(rows, 2, counts), [F.col("section"), F.col("kind"), F.col("key")]).select("section", "line", "rank")


@query(S.with_(_DOCS, S.counts(2), S.model(2)) + "SELECT n, ngram, CAST(printf('%.7f', CAST(prob AS DOUBLE)) AS FLOAT) AS prob FROM p")
def arpa_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scratch(estimate.estimated(_texts(spark, sf_dir), BuildConfig(order=2)), "model")
    path = f"{shared_dir(spark)}/gramloom/roundtrip-{uuid.uuid4().hex}.arpa"
    arpa.write_rows(rows, 2, path)
    return arpa.read_arpa(spark, path).rows.select("n", "ngram", "prob")


@query(S.with_(_DOCS, S.counts(2), S.model(2)) + "SELECT n, ngram, prob, CAST(0 AS FLOAT) AS backoff FROM p UNION ALL SELECT 1, '<unk>', CAST(0 AS FLOAT), CAST(0 AS FLOAT)")
def stored_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/gramloom/stored-{uuid.uuid4().hex}"
    store.save_model(_model(spark, sf_dir, 2), path)
    return store.load_model(spark, path).rows.select("n", "ngram", "prob", "backoff")


#: A model with gaps: longer n-grams may be rarer than the shorter ones that stay.
_GAPPY = "g AS MATERIALIZED (SELECT n, ngram, c FROM c WHERE n = 1 OR (n = 2 AND c >= 3) OR (n = 3 AND c >= 2))"


def _gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir, 3).where("n = 1 or (n = 2 and c >= 3) or (n = 3 and c >= 2)").withColumn("line_no", F.lit(0).cast("long"))


@query(S.with_(_DOCS, S.counts(3), _GAPPY) + f"SELECT DISTINCT CAST(2 AS INTEGER) AS n, {S.suffix()} AS ngram FROM g WHERE n = 3 AND NOT EXISTS (SELECT 1 FROM g h WHERE h.n = 2 AND h.ngram = {S.suffix('g.ngram')})")
def blank_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.blank_entries(_gappy(spark, sf_dir)).select("n", "ngram")


@query(S.with_(_DOCS, S.counts(3), _GAPPY) + f"SELECT n, ngram FROM g WHERE n = 3 AND NOT EXISTS (SELECT 1 FROM g h WHERE h.n = 2 AND h.ngram = {S.prefix('g.ngram')})")
def orphan_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.orphans(_gappy(spark, sf_dir)).select("n", "ngram")


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gappy(spark, sf_dir).select("n", "ngram", F.lit(-1.0).cast("float").alias("prob"), F.lit(None).cast("float").alias("backoff"), F.lit(False).alias("has_backoff"), "line_no")
    return model.derive(rows, 3).rows.where("not is_blank and ngram <> '<unk>'")


@query(S.with_(_DOCS, S.counts(3), _GAPPY) + f"SELECT g.n, g.ngram, x.ngram IS NOT NULL AS extends_right FROM g LEFT JOIN (SELECT DISTINCT {S.prefix()} AS ngram FROM g WHERE n > 1) x ON x.ngram = g.ngram")
def extends_right_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).select("n", "ngram", "extends_right")


@query(S.with_(_DOCS, S.counts(3), _GAPPY) + f"SELECT g.n, g.ngram, x.ngram IS NULL AS independent_left FROM g LEFT JOIN (SELECT {S.suffix()} AS ngram FROM g WHERE n > 1 UNION SELECT regexp_extract(ngram, '([^ ]+)$', 1) FROM g WHERE n = 3) x ON x.ngram = g.ngram")
def extends_left_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).select("n", "ngram", "independent_left")


# --- quantisation and hashes ----------------------------------------------------------------------------------------

_PLACED = "pl AS (SELECT n, prob, row_number() OVER (PARTITION BY n ORDER BY prob) - 1 AS r, count(*) OVER (PARTITION BY n) AS k FROM p WHERE n > 1)"
_BINS = "bi AS (SELECT n, CAST(((r + 1) * 16 + k - 1) // k - 1 AS INTEGER) AS bin, CAST(avg(CAST(prob AS DOUBLE)) AS FLOAT) AS centre FROM pl GROUP BY 1, 2)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scratch(estimate.estimated(_texts(spark, sf_dir), BuildConfig(order=3)), "model")


@query(S.with_(_DOCS, S.counts(3), S.model(3), _PLACED, _BINS) + "SELECT n, bin, round(CAST(centre AS DOUBLE), 4) AS centre FROM bi")
def quant_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantize.bins(_entries(spark, sf_dir).where("n > 1"), 16, "prob")
    return found.select("n", "bin", F.round(F.col("centre").cast("double"), 4).alias("centre"))


@query(
    S.with_(_DOCS, S.counts(3), S.model(3), _PLACED, _BINS, "tb AS (SELECT n, list(centre ORDER BY bin) AS t FROM bi GROUP BY n)", "lk AS (SELECT n, ngram, prob, list_min(list_transform(t, lambda x: abs(CAST(x AS DOUBLE) - CAST(p.prob AS DOUBLE)))) AS off FROM p JOIN tb USING (n) WHERE n > 1)")
    + "SELECT n, ngram, round(off, 4) AS off FROM lk"
)
def quantized_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each probability is from its code's centre, the nearest one."""
    rows = _entries(spark, sf_dir)
    tables = quantize.train(rows, 3, 4, 4)
    coded = quantize.encode(rows, scratch(tables, "centres"), 4, 4).where("n > 1").withColumn("raw", F.col("prob"))
    near = quantize.decode(coded, tables)
    return near.select("n", "ngram", F.round(F.abs(F.col("prob").cast("double") - F.col("raw").cast("double")), 4).alias("off"))


@query(S.with_(_DOCS, S.counts(3), S.vocab(), _IDS) + f"SELECT ngram, {S.SIGNED.format('h')} AS fnv, {S.SIGNED.format('k')} AS chained FROM (SELECT ngram, {S.fnv('ids')} AS h, {S.chain('ids')} AS k FROM w)")
def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ngram_hashes(_texts(spark, sf_dir), 3, corpus.text_vocab_ids(_docs(spark, sf_dir)))


@query(S.with_(_DOCS, "mw AS (SELECT DISTINCT word FROM (SELECT unnest(words) AS word FROM s))", S.murmur("word", "mw")) + "SELECT word, h FROM mu")
def murmur_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _sents(spark, sf_dir).select(F.explode("words").alias("word")).distinct()
    return words.select("word", hashing.vocab_hash("word").alias("h"))


# --- text functions and windows -------------------------------------------------------------------------------------


@query(
    r"""SELECT item_id, CAST(nullif(strpos(text, 'the'), 0) - 1 AS INTEGER) AS found, CAST(CASE WHEN contains(text, 'the') THEN length(text) - strpos(reverse(text), 'eht') - 2 END AS INTEGER) AS last_found,
  array_to_string(list_filter(string_split(text, ', '), lambda x: x <> ''), '|') AS parts, array_to_string(list_filter(string_split_regex(text, '[.,;]'), lambda x: x <> ''), '|') AS pieces, trim(text, 'abc .') AS trimmed,
  CAST(nullif(length(regexp_extract(text, '(?s)^([^.,;]*[.,;])', 1)), 0) - 1 AS INTEGER) AS first_of, CAST(nullif(length(regexp_extract(text, '(?s)^(.*[.,;])', 1)), 0) - 1 AS INTEGER) AS last_of FROM benchmark"""
)
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(
        "item_id", T.find("text", F.lit("the")).alias("found"), T.rfind("text", "the").alias("last_found"), F.array_join(T.split_on("text", ", "), "|").alias("parts"), F.array_join(T.split_on("text", ".,;", "any"), "|").alias("pieces"),
        T.trim_of("text", "abc .").alias("trimmed"), T.find_first_of("text", ".,;").alias("first_of"), T.find_last_of("text", ".,;").alias("last_of"),
    )


@query(
    """WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS start, ['<s>', event_type, '</s>'] AS m FROM events WHERE event_type <> ''),
g AS (SELECT start, CAST(k.n AS INTEGER) AS n, array_to_string(m[u.i:u.i + k.n - 1], ' ') AS ngram FROM e, (SELECT unnest([1, 2]) AS n) k, LATERAL (SELECT unnest(range(1, 5 - k.n)) AS i) u)
SELECT epoch(start)::BIGINT AS start, n, ngram, count(*) AS c FROM g GROUP BY ALL"""
)
def windowed_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windowed_counts(table(spark, sf_dir, "events"), 2, "1 hour", text="event_type")
    return found.select(F.unix_timestamp("start").alias("start"), "n", "ngram", "c")
