"""Near-dedup, packing, sorted tables, top-k, tokens, the language model, the classifier and the pipeline against plain versions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

import corpus_pipeline
from gramloom.llm import graph, near_dedup, packing, quality, queries, rnn_lm, sstable, tokens, topk
from test_text_operators import DOCS, clashing, filled, frame, plain_dedup

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"

# --- near-duplicates --------------------------------------------------------------------------------------------------


def plain_shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def plain_similarity(a, b):
    if not a and not b:
        return 1.0
    x, y = ({k: 1 + math.log(n) for k, n in c.items()} for c in (a, b))
    plain = len(a.keys() & b.keys()) / max(1, len(a.keys() | b.keys()))
    prob = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
    return max(plain, prob)


def plain_classes(texts):
    shingles = [plain_shingles(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "").lower().split() == (texts[j] or "").lower().split()
            if same or plain_similarity(shingles[i], shingles[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(texts))]


def near_texts(seed=3):
    r = random.Random(seed)
    word = lambda: r.choice(["ab", "cd", "é", "Xy", "foo", "bar", "qux", "zap"]) + str(r.randint(0, 40))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(r.randint(20, 150))]
        for _ in range(r.randint(1, 7)):
            own = [word() if r.random() < r.choice([0, 0.005, 0.02, 0.04]) else w for w in base]
            texts.append(r.choice([" ", "\n", "  "]).join(own))
    return texts + ["one two", "ONE  two", "", None, " \n", "tail " * 400, "tail " * 380, texts[0] + " x"]


def test_shingles_and_similarity():
    texts = near_texts()
    norm = [" ".join((t or "").lower().split()) for t in texts]
    text_of, hashes, counts = near_dedup.shingles(norm)
    own = [(hashes[text_of == k], counts[text_of == k]) for k in range(len(texts))]
    plain = [plain_shingles(t) for t in texts]
    assert [sorted(c.tolist()) for _, c in own] == [sorted(p.values()) for p in plain]
    r = random.Random(1)
    for _ in range(400):
        i, j = r.randrange(len(texts)), r.randrange(len(texts))
        assert math.isclose(near_dedup.similarity(*own[i], *own[j]), plain_similarity(plain[i], plain[j]), abs_tol=1e-9)


def test_registers_estimate_the_probability_jaccard():
    a = {k: 1 + math.log(1 + k % 4) for k in range(60)}
    b = {k: 1 + math.log(1 + k % 3) for k in range(15, 80)}
    want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
    mix = lambda ks: near_dedup._mix(np.array(ks, np.uint64) * near_dedup._P)
    got = near_dedup.prob_minhash(np.repeat([0, 1], [60, 65]), np.concatenate([mix([*a]), mix([*b])]), np.array([*a.values(), *b.values()]), 2, 4096)
    assert abs((got[0] == got[1]).mean() - want) < 0.03


def test_near_classes(spark):
    texts = near_texts()
    label = plain_classes(texts)
    got = {r.doc_id: r for r in near_dedup.near_classes(clashing(frame(spark, texts))).collect()}
    assert [got[i].class_id for i in range(len(texts))] == label
    assert all(got[i].class_size == label.count(label[i]) and got[i].kept == (label[i] == i) for i in range(len(texts)))
    left = near_dedup.keep_one(clashing(frame(spark, texts)))
    assert {r.doc_id for r in left.collect()} == set(label) and left.columns == clashing(frame(spark, [])).columns


def test_near_defined_cases(spark):
    assert near_dedup.near_classes(frame(spark, [])).count() == 0 and near_dedup.keep_one(frame(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "a b c"), (7, "A  b c"), (7, long), (7, "a b c"), (9, long + " end"), (None, "q"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = near_dedup.near_classes(docs).collect()
    assert len(got) == 7 and sum(r.kept for r in got) == 4
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in near_dedup.keep_one(docs).collect()) == [(0, ""), (0, "q"), (7, "a  b c") if any(r.text == "A  b c" for r in near_dedup.keep_one(docs).collect()) else (7, "a b c"), (7, long)]


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)]
    label = {}
    for a, b in pairs:
        x, y = label.setdefault(a, {a}), label.setdefault(b, {b})
        if x is not y:
            x |= y
            for k in y:
                label[k] = x
    got = {x.node: x.label for x in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: min(v) for k, v in label.items() if len(v) > 1}


# --- tokens, packing, sorted tables -----------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_token_ids_are_the_library_s(spark, path):
    r = random.Random(8)
    bits = ["word", " ", "  ", "\n", "\t", "12", "3456", "don't", "É", "ç", "ß", "ñ", "!!", "a" * 300, "x" * 40, "中文", "𝄞", "###", "'s", "İ", " ", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "The", "ing"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(600)]
    texts += [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)  # as it comes
    got = tokens.token_ids(path).ids(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text[:200]


def check_packed(rows, lengths, most):
    """Pieces make up their documents; sequences have no gaps and no overflow. Number of sequences."""
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= most
    for doc, n in lengths.items():
        own = sorted(pieces[doc])
        assert [p for p, _, _ in own] == list(range(len(own))) and [s for _, s, _ in own] == [sum(n for _, _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, _, n in own) == n and all(x == most for _, _, x in own[1:]) and (n > most or len(own) == 1)
    return len(places)


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, "", "", "", 0), (-3, "word " * 9000, "", "", 0)], DOCS))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = {d: np.append(x, 0).astype("<u4") for d, x in zip(texts, tokens.token_ids(BYTES).ids([*texts.values()]), strict=True)}
    rows = packing.pack(clashing(docs), BYTES).collect()
    n = check_packed(rows, {d: len(x) for d, x in ids.items()}, 2048)
    assert n <= math.ceil(sum(map(len, ids.values())) / 2048) + 1
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in rows)
    assert packing.pack(frame(spark, []), BYTES).count() == 0
    twice = packing.pack(frame(spark, ["same text"] * 3).withColumn("doc_id", F.lit(None).cast("long")), BYTES).collect()
    assert len(twice) == 3 and len({(r.sequence_id, r.offset) for r in twice}) == 3


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("weights", [(1.0, 0.0, 0.0), (1.0, 0.5, 2.0)])
def test_best_fit_under_every_constraint(rule, weights):
    r = random.Random(6)
    items = [(k, min(64, int(r.paretovariate(0.9)))) for k in range(500)]
    capacity = (64, 9, 2500) if weights[1] else (64, 64, 64 * 64)
    size = dict(items)

    def fits(bins):
        return all(sum(size[k] for k in b) <= capacity[0] and len(b) <= capacity[1] and sum(size[k] ** 2 for k in b) <= capacity[2] for b in bins)

    if weights[1]:
        items = [(k, min(n, 50)) for k, n in items]
        size = dict(items)
    bins = packing.best_fit(items, capacity, weights, rule)
    assert sorted(k for b in bins for k in b) == [k for k, _ in items] and fits(bins)

    # The rule itself, looking at every open bin each time.
    open_, plain = [], []
    for k, n in sorted(items, key=lambda x: (-x[1], x[0])):
        need = (n, 1, n * n)
        can = [b for b, rest in enumerate(open_) if all(x >= y for x, y in zip(rest, need, strict=True))]
        score = (lambda b, need=need: sum(w * ((x - y) / c) ** 2 for w, x, y, c in zip(weights, open_[b], need, capacity, strict=True))) if rule == "norm" else (lambda b, need=need: -sum(w * x * y / c**2 for w, x, y, c in zip(weights, open_[b], need, capacity, strict=True)))
        best = min(can, key=score) if can else len(open_)
        if not can:
            open_.append(capacity)
            plain.append([])
        open_[best] = tuple(x - y for x, y in zip(open_[best], need, strict=True))
        plain[best].append(k)
    assert abs(len(bins) - len(plain)) <= 1


def test_sorted_tables(spark, tmp_path):
    texts = ["a b", None, "", "word " * 3000, "ünï", "zz"] * 40
    docs = clashing(frame(spark, texts).withColumn("doc_id", F.col("doc_id") * 7 - 500))
    rows = sorted(sstable.round_trip(docs, WORDS, shard_docs=50).collect(), key=lambda r: r.doc_id)
    ids = [np.append(x, 1).astype("<u4") for x in tokens.token_ids(WORDS).ids([t or "" for t in texts])]
    at = 0
    for r, x in zip(rows, ids, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    path = f"file://{tmp_path}/sst"
    manifest = sstable.write_shards(docs, WORDS, path, shard_docs=50).collect()
    assert len(manifest) > 2 and sum(m.n_docs for m in manifest) == len(texts)
    store, _ = fs.FileSystem.from_uri(path)
    found = {}
    for m in manifest:
        with store.open_input_file(m.path) as f:
            reader = sstable.Reader(f)
            for k in range(len(texts)):
                for x in reader.get(sstable.key_of(k * 7 - 500)):
                    found[k] = x.tolist()
            assert reader.get(sstable.key_of(1)) == [] and reader.get(sstable.key_of(None)) == []
    assert found == {k: x.tolist() for k, x in enumerate(ids)}
    assert sstable.round_trip(frame(spark, []), WORDS).count() == 0
    odd = spark.createDataFrame([(None, "a"), (5, "b"), (5, "c"), (None, "a")], "doc_id long, text string")
    assert sorted((r.doc_id is not None, r.start) for r in sstable.round_trip(odd, WORDS).collect()) == [(False, 0), (False, 2), (True, 4), (True, 6)]


def test_bloom_filter_and_prefixes(tmp_path):
    path = str(tmp_path / "x.sst")
    store = fs.LocalFileSystem()
    with store.open_output_stream(path) as out:
        w = sstable.Writer(out, 4)
        for k in range(0, 20_000, 2):
            w.add(sstable.key_of(k), np.arange(k % 5, dtype=np.uint32))
        w.close()
    with store.open_input_file(path) as f:
        reader = sstable.Reader(f)
        assert [sstable.id_of(k) for k, _ in reader.scan()] == list(range(0, 20_000, 2)) and len(reader.index) > 1
        passed = sum(all(reader.bits[b] for b in sstable._bloom_bits(sstable.key_of(k), len(reader.bits))) for k in range(1, 20_000, 2))
        assert passed < 300 and reader.get(sstable.key_of(19_998))[0].tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        sstable.Writer(None, 4).__class__.add(_after(5), sstable.key_of(4), np.zeros(0))


def _after(k):
    w = sstable.Writer(None, 4)
    w.add(sstable.key_of(k), np.zeros(0, np.uint32))
    return w


# --- top-k ------------------------------------------------------------------------------------------------------------


def test_top_k(spark):
    r = random.Random(9)
    vector = lambda: [r.choice([0.0, -1.5, 0.25, r.uniform(-2, 2)]) for _ in range(6)]
    rows = [(k, vector()) for k in range(160)] + [(200, None), (250, []), (300, [1.0, None]), (350, [float("nan")] * 6), (400, [float("inf")] * 6), (450, [0.5]), (None, vector()), (10, vector())]
    rows += [(500 + k, [1.0] * 6) for k in range(20)]  # ties
    rows += [(600, [1e17, 1.0]), (601, [-3e18]), (650, []), (700, [2.0**60, -(2.0**60), 3.0])]  # beyond 2 ** 53
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS x", "3 AS rank")
    whole = topk.whole_vectors(table)
    good = [(k, [math.floor(256 * float(np.float32(x))) for x in v]) for k, v in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for block, task_rows in ((8192, 16384), (3, 40)):
        got = defaultdict(list)
        for t in topk.top_k(whole, whole.where("vec_id % 50 = 0"), 5, block, task_rows).collect():
            got[t.query_id].append((t.rank, t.vec_id, t.score))
        want = {}
        for q, x in good:
            if q % 50 == 0:
                scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y, strict=False)))), v) for v, y in good if v != q)[:5]
                want[q] = [(k, v, -s) for k, (s, v) in enumerate(scores, 1)]
        assert {q: sorted(x) for q, x in got.items()} == want
    assert topk.top_k(whole.where("false"), whole.where("false")).count() == 0


def test_top_k_prunes_and_stays_exact():
    r = np.random.default_rng(1)
    rows = (r.normal(size=(4000, 8)) * 100).astype(np.int64)
    rows[:300] += 500  # one range of documents is better than the rest
    ids = np.arange(4000)
    best = topk.Best(ids[:40], np.abs(rows[:40]).astype(float), 5)
    best.look(ids, rows.astype(float), 100)
    full = np.abs(rows[:40]) @ rows.T
    full[np.arange(40), np.arange(40)] = np.iinfo(np.int64).min
    assert np.array_equal(np.sort(best.score, 1), np.sort(full, 1)[:, -5:]) and best.scored < 40 * 40 / 2
    parts = topk.Best(ids[:40], np.abs(rows[:40]).astype(float), 5)
    for at in range(0, 4000, 900):  # rows that come in parts
        parts.look(ids[at : at + 900], rows[at : at + 900].astype(float), 100)
    assert np.array_equal(parts.score, best.score) and np.array_equal(parts.id, best.id)


# --- the language model -----------------------------------------------------------------------------------------------


def test_language_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*[c.split(" ")[0] for c in DOCS.split(", ")])
    docs = docs.unionByName(spark.createDataFrame([(100_000, None, "", "", 0), (100_001, "", "", "", 0), (None, "lone words here", "", "", 0)], DOCS))
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = {r.doc_id: r for r in rnn_lm.score(clashing(docs), known=500).collect()}
    words = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in __import__("re").findall(r"[^\x20\x09-\x0d]+", t)] + [None]
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in texts}
    counts = Counter(w for d, t in texts if not held[d] for w in words(t))
    total, types = sum(counts.values()), len(counts)
    for d, t in texts:
        r, w = got[d], words(t)
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(counts[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and math.isfinite(r.score) and r.score < 0
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # better than the word counts on unseen texts
    assert rnn_lm.score(frame(spark, [])).count() == 0


def small_vocabulary():
    words = [b"\n", b"the", b"of", b"a", b"cat", b"dog"]
    sums = np.zeros((rnn_lm.SHAPES, 2), np.int64)
    sums[5] = 7, 3
    return rnn_lm.Vocabulary(words, np.array([50, 40, 30, 20, 10, 5]), np.array([-1, 1, 1, 2, 4, 4]), 6, 162, 9, sums)


def test_chances_add_up_and_the_state_is_carried():
    v = small_vocabulary()
    w = rnn_lm.start_weights(v, 8)
    symbols = np.arange(v.head + rnn_lm.SHAPES)
    h = np.random.default_rng(0).normal(size=(1, 8)).astype(np.float32)
    assert math.isclose(np.exp(rnn_lm.log_chances(v, w, np.repeat(h, len(symbols), 0), symbols)).sum(), 1, abs_tol=1e-4)
    r = np.random.default_rng(1)
    docs = [r.integers(0, v.head, n) for n in (1, 300, 40, 7, 129)]
    got = rnn_lm.text_log_chances(v, w, docs, 0, lanes=2)
    for d, total in zip(docs, got, strict=True):
        h, before, want = np.zeros((1, 8), np.float32), 0, 0.0
        for s in d:
            h = rnn_lm._cell(w, w["embed"][[before]], h)[-1]
            want += rnn_lm.log_chances(v, w, h, np.array([s]))[0]
            before = s
        assert math.isclose(total, want, rel_tol=1e-4)


def test_truncated_backpropagation_has_the_true_slopes():
    v = small_vocabulary()
    w = {k: x.astype(np.float64) for k, x in rnn_lm.start_weights(v, 4).items()}
    docs = [np.array([1, 4, 2, 0]), np.array([3, 1, 5, v.head + 5, 0])]
    inputs, targets, text, opens, going = rnn_lm._lanes(docs, 2, 0)
    slopes = {k: np.zeros_like(x) for k, x in w.items()}

    class Spy(rnn_lm.Trainer):
        def _step(self, name, slope, rows=slice(None)):
            slopes[name][rows] += slope

    Spy(v, w).window(inputs, targets, opens, going, np.zeros((2, 4)))
    loss = lambda: -rnn_lm.text_log_chances(v, w, docs, 0, 2).sum()
    r = random.Random(2)
    for name, x in w.items():
        for _ in range(6):
            at = tuple(r.randrange(n) for n in x.shape)
            old, step = x[at], 1e-3
            x[at] = old + step
            up = loss()
            x[at] = old - step
            down = loss()
            x[at] = old
            assert abs((up - down) / (2 * step) - slopes[name][at]) < 2e-2, name


# --- the classifier and the pipeline ----------------------------------------------------------------------------------


def test_co_training(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit_on, held = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    m = quality.fit(docs, fit_on)
    rows = quality.score(clashing(docs).drop("score"), m).join(held, "doc_id").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1]
    assert sum(not r.keep for r in bad) / len(bad) > 0.85 and sum(r.keep for r in good) / len(good) > 0.98
    assert all(0 <= x <= 1 for r in rows for x in (r.text_score, r.meta_score, r.score))
    assert m.text_scale is not None and m.both is not None


def test_co_training_defined_cases(spark):
    docs = frame(spark, ["plain words", None, "", "x" * 100_000])
    odd = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(0, 1, 0), (0, None, 0), (None, 0, 0), (1, 1, 1)], none.schema)):
        m = quality.fit(odd, labels)
        assert [r.keep for r in quality.score(odd, m).collect()] == [True] * 4 and quality.keep_good(clashing(odd), m).count() == 4
    empty = frame(spark, [])
    m = quality.fit(empty, none)
    assert quality.score(empty, m).count() == 0


def test_views_teach_each_other():
    """One view alone can't tell the classes apart where it has no labels; the other's confident ones show it how."""
    r = np.random.default_rng(3)
    n = 3000
    y = r.integers(0, 2, n)
    text = np.zeros((n, quality.N_TEXT), np.float32)
    text[:, 0] = y * 2 + r.normal(size=n) * 0.3
    meta = np.zeros((n, quality.N_META), np.float32)
    meta[np.arange(n), (y * 20 + r.integers(0, 20, n))] = 1
    few = np.arange(40)
    with_rounds = quality.co_train(text[few], meta[few], y[few], text[40:1500], meta[40:1500])
    without = quality.co_train(text[few], meta[few], y[few], text[40:1500], meta[40:1500], rounds=0)
    right = lambda m: ((m.score(text[1500:], meta[1500:])[1] > 0.5) == y[1500:]).mean()
    assert right(with_rounds) > right(without) and right(with_rounds) > 0.97


def test_pipeline_stages(spark):
    sf, docs = SF, spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    after = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.scratch(stage(spark, after[-1], sf), "stage")
        assert k == 4 or out.columns == columns
        after.append(out)
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in after]
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    assert ids[1] == sorted(r.doc_id for r in scores.where("keep").collect()) and len(ids[1]) >= 0.75 * len(ids[0])
    assert ids[2] == sorted(d for d, v in plain_dedup((d, texts[d]) for d in ids[1]).items() if v[2])
    label = plain_classes([texts[d] for d in ids[2]])
    assert ids[3] == sorted({ids[2][k] for k in label})
    rows = after[3].collect()
    sizes, size = defaultdict(int), {}
    for r in rows:
        size[r.doc_id] = len(r.text.split())
        sizes[r.source] += size[r.doc_id]
    target = filled(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}, 1.5, 2)
    taken = defaultdict(int)
    for r in after[4].collect():
        taken[r.source] += size[r.doc_id]
    largest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= largest for s in sizes) and max(Counter(ids[4]).values()) <= 2
    lengths = Counter(ids[4])
    packed = after[5].collect()
    per = defaultdict(int)
    for r in packed:
        per[r.doc_id] += r.length
    encoded = dict(zip(lengths, tokens.token_ids(BYTES).ids([texts[d] for d in lengths]), strict=True))
    assert per == {d: n * (len(encoded[d]) + 1) for d, n in lengths.items()}
    assert len({r.sequence_id for r in packed}) <= math.ceil(sum(per.values()) / 2048) + 1
    again = corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length").collect()
    assert Counter(again) == Counter(after[5].select("doc_id", "piece", "length").collect())


def test_every_operator_is_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
