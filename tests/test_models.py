import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramloom.config import BuildConfig, ModelConfig
from gramloom.errors import ArpaError, DiscountError, FormatError, PositiveProbabilityError, VersionError, VocabularyError
from gramloom.operators import corpus, estimate, filters, model, ordering, quantize, score
from gramloom.operators import counts as C
from gramloom.sources import arpa, store

C1 = ["the cat sat on the mat", "the dog sat on the log", "the cat sat on the hat"]
C2 = ["the cat sat on the mat", "the cat sat on the mat", "the dog ran on the road"]

HEADER = "\\data\\\nngram 1={0}\nngram 2={1}\nngram 3={2}\n\n"
#: A model with steps missing (suffixes of "a b c", "d a b"), <unk> in longer rows, and backoffs absent, 0.0 and -0.0.
TEXT = HEADER.format(7, 4, 3) + """\\1-grams:
-1.5\t<unk>\t-0.5
-99\t<s>\t-0.25
-1.25\t</s>
-1\ta\t-0.125
-1.125\tb\t0.0
-2\tc\t-0.0
-2.5\td

\\2-grams:
-0.5\t<s> a\t-0.0625
-0.75\ta b\t-0.375
-0.875\t<unk> <unk>\t-0.2
-0.625\td a

\\3-grams:
-0.3\ta b c
-0.4 \td a <unk>
-0.2\t<unk> <unk> a

\\end\\
"""


def sents(spark, lines):
    return spark.createDataFrame([(i, x.split()) for i, x in enumerate(lines)], "id int, words array<string>")


@pytest.fixture(scope="module")
def gappy(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("arpa") / "gappy.arpa"
    path.write_text(TEXT)
    return arpa.load_arpa(spark, f"file://{path}")


def loaded(text):
    """Entries and flags, derived line by line: {words: [prob, backoff, extends right, extends left]}."""
    entries, n = {}, 0
    for line in text.split("\n"):
        if line.endswith("-grams:"):
            n = int(line[1:-7])
        elif n and line and line[0] != "\\":
            parts = line.replace("\t", " ").split()
            words = tuple(parts[1 : n + 1])
            if n > 1:
                words = tuple(w if (w,) in entries else "<unk>" for w in words)
            given = parts[n + 1] if len(parts) > n + 1 else "-0.0"
            entries[words] = [min(float(parts[0]), 0), float(given), float(given) != 0 or given[0] != "-", False]
            for k in range(n - 1, 0, -1):
                end = words[n - k :]
                there = end in entries
                entries.setdefault(end, [0.0, 0.0, False, False])[3] = True
                if there:
                    break
            if words[:-1] in entries:
                entries[words[:-1]][2] = True
    return entries


def walk(entries, words, order, bos=True, eos=True):
    """(prob, matched length, state length) of each token, by the state kept from word to word."""
    state = ["<s>"] if bos else []
    out = []
    for word in [*words, "</s>"] if eos else words:
        word = word if (word,) in entries else "<unk>"
        hit, prob = 1, entries[(word,)][0]
        levels = [(word,)]
        while hit < order and hit <= len(state) and entries[levels[-1]][3] and (key := (*state[-hit:], word)) in entries:
            levels.append(key)
            hit, prob = hit + 1, entries[key][0]
        prob = np.float32(prob)
        for k in range(hit, len(state) + 1):
            prob = np.float32(prob + np.float32(entries[tuple(state[-k:])][1]))
        keep = max([0, *(len(g) for g in levels if len(g) < order and entries[g][2])])
        state = (state + [word])[-keep:] if keep else []
        out.append((round(float(prob), 4), hit, keep))
    return out


@pytest.mark.parametrize("bos", [True, False])
def test_scores_of_a_model_with_gaps(spark, gappy, bos):
    r = random.Random(3)
    lines = [" ".join(r.choice("a a b b c d x <unk>".split()) for _ in range(r.randint(1, 9))) for _ in range(120)]
    entries = loaded(TEXT)
    assert {tuple(x.ngram.split()) for x in gappy.rows.where("is_blank").collect()} == {("b", "c"), ("a", "<unk>"), ("<unk>", "a")}
    assert not gappy.rows.where("n > 1").join(gappy.rows, "ngram", "left_anti").count() and gappy.unk_inside
    import dataclasses

    for m in (gappy, dataclasses.replace(gappy, complete=False)):
        got = defaultdict(list)
        for t in score.score_tokens(sents(spark, lines), ["id"], m, bos=bos, detail=True).orderBy("id", "pos").collect():
            got[t.id].append((round(t.prob, 4), t.ngram_length, t.state_len))
        want = {i: walk(entries, x.split(), 3, bos) for i, x in enumerate(lines)}
        assert dict(got) == want


def test_prefix_gaps_need_the_walk(spark, tmp_path):
    """Random models in which prefixes are missing: the walk along sorted partitions agrees with the one word by word."""
    r = random.Random(11)
    words = list("abcd")
    ones = ["<unk>", "<s>", "</s>", *words]
    twos = sorted({(r.choice(words), r.choice(words)) for _ in range(7)})
    threes = sorted({tuple(r.choice(words) for _ in range(3)) for _ in range(12)})
    row = lambda g, last: f"{-r.randint(1, 40) / 8}\t{' '.join(g)}" + ("" if last or r.random() < 0.3 else f"\t{-r.randint(0, 16) / 16}")
    text = HEADER.format(len(ones), len(twos), len(threes))
    for n, rows in enumerate((([w] for w in ones), twos, threes), 1):
        text += f"\\{n}-grams:\n" + "".join(row(g, n == 3) + "\n" for g in rows) + "\n"
    (tmp_path / "m.arpa").write_text(text + "\\end\\\n")
    m = arpa.load_arpa(spark, f"file://{tmp_path}/m.arpa")
    assert not m.complete
    lines = [" ".join(r.choice(words + ["z"]) for _ in range(r.randint(1, 12))) for _ in range(150)]
    got = defaultdict(list)
    for t in score.score_tokens(sents(spark, lines), ["id"], m, detail=True).orderBy("id", "pos").collect():
        got[t.id].append((round(t.prob, 4), t.ngram_length, t.state_len))
    assert dict(got) == {i: walk(loaded(text), x.split(), 3) for i, x in enumerate(lines)}


def test_states_and_contexts(spark, gappy):
    rows = spark.createDataFrame([(0, ["<s>", "a"]), (1, ["a", "b"]), (2, ["c"]), (3, []), (4, ["z", "z"])], "id int, words array<string>")
    got = {r.id: (r.state_words, [round(x, 4) for x in r.state_backoffs]) for r in score.states(rows, ["id"], gappy).collect()}
    assert got == {0: (["a", "<s>"], [-0.125, -0.0625]), 1: (["b", "a"], [0.0, -0.375]), 2: ([], []), 3: ([], []), 4: (["z", "z"], [-0.5, -0.2])}
    asked = spark.createDataFrame([(0, ["x", "a", "b"], "c"), (1, [], "c")], "id int, context array<string>, word string")
    assert {r.id: (round(r.prob, 4), r.ngram_length) for r in score.score_in_context(asked, ["id"], gappy).collect()} == {0: (-0.3, 3), 1: (-2.0, 1)}
    assert [(r.pos, r.word) for r in score.oov_tokens(sents(spark, ["a zz <unk>"]), ["id"], gappy).orderBy("pos").collect()] == [(1, "zz"), (2, "<unk>")]
    found = score.lookup(spark.createDataFrame([("a b",), ("b c",)], "ngram string"), gappy).collect()
    assert {r.ngram: (r.found, r.prob) for r in found} == {"a b": (True, -0.75), "b c": (False, None)}


def test_corrected_blanks(spark, tmp_path):
    (tmp_path / "m.arpa").write_text(TEXT)
    m = arpa.load_arpa(spark, f"file://{tmp_path}/m.arpa", ModelConfig(semantics="corrected"))
    blanks = {r.ngram: round(r.prob, 4) for r in m.rows.where("is_blank").collect()}
    assert blanks == {"b c": -2.0, "a <unk>": -1.625, "<unk> a": -1.5}


def test_perplexity_and_output(spark, gappy):
    tokens = score.score_tokens(sents(spark, ["a b z"]), ["id"], gappy)
    row = score.perplexities(tokens, ["id"]).first()
    assert math.isclose(row.perplexity, 10 ** (-row.total / 4)) and (row.oov, row.tokens) == (1, 4)
    assert score.perplexities(tokens, ["id"], with_oov=False, with_eos=False).first().tokens == 2
    lines = [r.line for r in score.query_lines(tokens, ["id"]).orderBy("line_no").collect()]
    assert lines[0] == "p=-0.500000 [2] a" and lines[-1].startswith("Total: ") and lines[-1].endswith(" OOV: 1 Tokens: 4")


def log_probs(spark, lines, order, semantics="reference", **how):
    rows = estimate.estimate(C.count_ngrams(sents(spark, lines), order), BuildConfig(order=order, semantics=semantics, **how))
    return {r.ngram: (r.prob, r.backoff) for r in rows.collect()}


def test_reference_estimates(spark):
    two, three, other = log_probs(spark, C1, 2), log_probs(spark, C1, 3), log_probs(spark, C2, 2)
    near = lambda got, want: all(abs(got[k][0] - v) < 1e-6 for k, v in want.items())
    assert near(two, {"</s>": -0.9130742, "the": -0.6070234, "cat": -1.0942450, "dog": -1.4108801, "<s> the": -0.0905564, "cat sat": -0.1734007, "the cat": -0.5873024, "the hat": -1.1808987})
    assert near(three, {"<s> the": -300, "on the": -0.3611422, "the cat": -0.9571516, "<s> the cat": -0.3261948, "on the mat": -0.8456588, "the cat sat": -0.1231432})
    assert near(other, {"mat": -1.0942450, "dog ran": -0.5542101, "mat </s>": -0.1734007, "the road": -1.2141042})
    assert {b for k, (_, b) in three.items() if " " not in k} == {0.0} and three["the cat sat"][1] is None


@pytest.mark.parametrize("how", [{}, {"discounts": ((0.5, 1.0, 1.5),) * 3}, {"prune_thresholds": (0, 0, 1)}])
def test_corrected_estimates_add_up(spark, how):
    m = log_probs(spark, C1 + C2 + ["a rat", "the cat ran"], 3, "corrected", **how)
    words = [k for k in m if " " not in k and k != "<s>"]

    def p(context, w):
        if (g := " ".join([*context, w])) in m:
            return 10 ** m[g][0]
        back = m.get(" ".join(context), (0, None))[1]
        return (10**back if back is not None else 1) * p(context[1:], w)

    for context in ([], ["the"], ["<s>"], ["<s>", "the"], ["on", "the"], ["cat", "sat"], ["mat", "</s>"], ["nothing"]):
        assert math.isclose(sum(p(context, w) for w in words), 1, abs_tol=1e-5), context


def test_counts(spark):
    s = sents(spark, C1 + ["</s> x"])
    got = {r.ngram: r.c for r in C.count_ngrams(s, 2).collect()}
    want = Counter()
    for line in C1 + ["</s> x"]:
        t = ["<s>", *line.split(), "</s>"]
        want.update(t)
        want.update(" ".join(x) for x in zip(t, t[1:], strict=False))
    assert got == dict(want)
    size = C.corpus_size(s).first()
    assert (size.token_count, size.type_count) == (20, 8 + 1 + 3)
    ids = corpus.vocab_ids(s, "id")
    assert [r.word for r in ids.orderBy("word_id").collect()] == ["<unk>", "<s>", "</s>", "the", "cat", "sat", "on", "mat", "dog", "log", "hat", "x"]
    assert corpus.vocab_bound(ids) == 12 and corpus.saw_unk(ids)
    more = corpus.add_words(ids, spark.createDataFrame([("cat",), ("zoo",), ("yak",)], "word string"))
    assert {r.word: r.word_id for r in more.where("word_id > 11").collect()} == {"yak": 12, "zoo": 13}
    found = corpus.lookup_ids(spark.createDataFrame([("cat",), ("no",), ("<UNK>",)], "word string"), ids)
    assert {r.word: r.word_id for r in found.collect()} == {"cat": 4, "no": 0, "<UNK>": 0}
    assert {r.word for r in corpus.lookup_words(spark.createDataFrame([(4,), (99,)], "word_id int"), ids).collect()} == {"cat", None}
    both = spark.createDataFrame([(0, " \n\na b\r\n \t")], "doc_id int, text string")
    assert [(r.line_no, r.words) for r in corpus.sentences(both).collect()] == [(2, ["a", "b"])]
    assert [r.line_no for r in corpus.sentences(both, blank="keep").orderBy("line_no").collect()] == [0, 2, 3]


def test_discounts(spark):
    stats = spark.createDataFrame([(1, 9, 9, 0, 4, 2, 1, 1), (2, 3, 3, 0, 3, 0, 0, 0)], "n int, types long, unpruned long, n0 long, n1 long, n2 long, n3 long, n4 long")
    got = {r.n: r for r in C.kn_discounts(stats).collect()}
    assert [round(got[1][f"d{j}"], 6) for j in (1, 2, 3)] == [0.5, 1.25, 1.0] and got[1].ok and not got[2].ok
    with pytest.raises(DiscountError):
        C.discounts_of(stats, 2)
    assert C.discounts_of(stats, 2, {2: (0.1, 0.2, 0.3)})[1] == (0.1, 0.2, 0.3)
    rows = spark.createDataFrame([(0,), (1,), (2,), (10,)], "c long")
    assert [r[0] for r in rows.select(C.discount_of(F.col("c"), (0.5, 1.0, 1.5))).collect()] == [0.5, 0.5, 1.0, 1.5]
    assert [r[0] for r in rows.select(C.discounted(F.col("c"), (0.75,) * 3)).collect()] == [0, 0.25, 1.25, 9.25]
    keyed = C.initial_probs_global(spark.createDataFrame([(42, 10), (99, 5)], "h long, c long")).collect()
    assert {r.h: (round(r.uninterp, 6), round(r.gamma, 6)) for r in keyed} == {42: (round(9.25 / 15, 6), 0.05), 99: (round(4.25 / 15, 6), 0.05)}
    pruned = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "n int, c long").select(C.cutoff_count(F.col("c"), C.pruned_by([0, 1])))
    assert sorted(r[0] for r in pruned.collect()) == [0, 1, 2]
    assert (C.dedupe_multiplier(3), C.vocab_bytes(10)) == (3.0, 1104)
    p, q = estimate.output_q(F.lit(0.5), F.lit(0.2), F.lit(0.4), F.lit(0.8))
    assert [round(x, 5) for x in spark.range(1).select(p, q, *estimate.output_prob_backoff(F.lit(0.5), F.lit(0.1))).first()] == [-1.30103, 0.1, -0.30103, -1.0]


def test_model_text_round_trip(spark, tmp_path):
    m = estimate.build(sents(spark, C1), BuildConfig(order=3, semantics="corrected"))
    path = f"file://{tmp_path}/m.arpa"
    arpa.write_arpa(m, path, single_file=True)
    text = (tmp_path / "m.arpa").read_text().split("\n")
    assert text[0] == "\\data\\" and text[1] == f"ngram 1={m.counts()[1]}" and text[-2] == "\\end\\"
    ones = [x.split("\t")[1] for x in text[text.index("\\1-grams:") + 1 : text.index("\\2-grams:") - 1]]
    assert ones == sorted(ones) and arpa.is_arpa(spark, path) and store.recognise(spark, path) is None
    back = store.load_model(spark, path, ModelConfig(semantics="corrected"))
    rows = lambda x: {r.ngram: (round(r.prob, 5), round(r.backoff, 5), r.extends_right, r.independent_left) for r in x.rows.collect()}
    assert rows(back).keys() == rows(m).keys()
    # Text can't tell a backoff of 0 that is given from one that isn't; all else comes back.
    assert {k: v[:2] for k, v in rows(back).items()} == {k: v[:2] for k, v in rows(m).items()}
    folder = f"file://{tmp_path}/parts"
    arpa.write_arpa(m, folder)
    assert [r.line for r in corpus.numbered_lines(spark, folder).orderBy("line_no").collect()] == text[:-1]
    parts = store.load_model(spark, folder, ModelConfig(semantics="corrected"))
    assert rows(parts) == rows(back)


@pytest.mark.parametrize(
    "change, error",
    [
        (lambda t: t.replace("ngram 2", "ngram 3", 1), ArpaError),
        (lambda t: t.replace("ngram 1", "gram 1", 1), ArpaError),
        (lambda t: "\\data\\\n\n" + t.split("\n\n", 1)[1], ArpaError),
        (lambda t: "x\n" + t, ArpaError),
        (lambda t: t.replace("\\2-grams:", "\\5-grams:"), ArpaError),
        (lambda t: t.replace("\\end\\", ""), ArpaError),
        (lambda t: t.replace("ngram 2=4", "ngram 2=5"), ArpaError),
        (lambda t: t.replace("-0.75\ta b\t-0.375", "-0.75\ta b\tNaN"), ArpaError),
        (lambda t: t.replace("-0.75\ta b", "odd\ta b"), ArpaError),
        (lambda t: t.replace("-0.75\ta b", "0.75\ta b"), PositiveProbabilityError),
        (lambda t: t.replace("-0.3\ta b c", "-0.3\ta b zz"), ArpaError),
        (lambda t: "", ArpaError),
    ],
)
def test_malformed_text(spark, tmp_path, change, error):
    (tmp_path / "m.arpa").write_text(change(TEXT))
    with pytest.raises(error):
        arpa.read_arpa(spark, f"file://{tmp_path}/m.arpa", strict_words=True, positive="throw")


def test_lenient_text(spark, tmp_path):
    (tmp_path / "m.arpa").write_text("# note\n\n" + TEXT.replace("-0.3\ta b c", "0.3\ta\tb\tc").replace("\n", "\r\n") + "trailing\n")
    with pytest.warns(UserWarning):
        got = arpa.read_arpa(spark, f"file://{tmp_path}/m.arpa")
    assert got.counts == [7, 4, 3] and {r.ngram: r.prob for r in got.rows.where("n = 3").collect()}["a b c"] == 0
    (tmp_path / "n.arpa").write_text(TEXT.replace("-99\t<s>\t-0.25\n", "").replace("ngram 1=7", "ngram 1=6").replace("-0.5\t<s> a\t-0.0625\n", "").replace("ngram 2=4", "ngram 2=3"))
    with pytest.raises(VocabularyError):
        arpa.load_arpa(spark, f"file://{tmp_path}/n.arpa", ModelConfig(sentence_marker_missing="throw"))
    assert arpa.load_arpa(spark, f"file://{tmp_path}/n.arpa").rows.where("ngram = '<s>'").first().prob == 0


@pytest.mark.parametrize("variant", ["probing", "quant_trie"])
def test_stored_models(spark, tmp_path, variant):
    m = estimate.build(sents(spark, C1 + C2), BuildConfig(order=3, semantics="corrected"))
    path = f"file://{tmp_path}/model"
    with pytest.raises(FormatError):
        store.load_stored(spark, path)
    store.save_model(m, path, variant)
    with pytest.raises(FormatError):
        store.load_stored(spark, path, "array_trie")
    back = store.load_model(spark, path)
    lines = sents(spark, ["the cat sat on the road", "a zoo"])
    total = lambda x: [round(r.total, 4) for r in score.sentence_scores(score.score_tokens(lines, ["id"], x), ["id"]).orderBy("id").collect()]
    assert total(back) == total(m)  # fewer values than bins: no loss
    assert store.stored_vocab(spark, path).count() == m.counts()[1] and store.header(spark, path)["order"] == 3
    about = tmp_path / "model/about"
    part = next(about.glob("part-*.txt"))
    part.write_text(part.read_text().replace('"version": 1', '"version": 9'))
    for crc in about.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(VersionError):
        store.load_stored(spark, path)


def test_sizes(spark, tmp_path):
    import dataclasses

    m = estimate.build(sents(spark, C1), BuildConfig(order=3))
    got = {r.n: (r.entries, r.text_bytes, r.value_bytes) for r in model.sizes(m).collect()}
    grams = [r.ngram for r in m.rows.collect()]
    for n, bits in ((1, 67), (2, 67), (3, 35)):
        own = [g for g in grams if g.count(" ") == n - 1]
        assert got[n] == (len(own), sum(map(len, own)), math.ceil(len(own) * bits / 8))
    small = dataclasses.replace(m, config=ModelConfig(variant="quant_trie", prob_bits=4, backoff_bits=6))
    assert {r.n: r.value_bytes for r in model.sizes(small).collect()}[2] == math.ceil(got[2][0] * 13 / 8)
    path = f"file://{tmp_path}/m"
    store.save_model(m, path)
    assert store.header(spark, path)["bytes"] == sum(f.stat().st_size for f in (tmp_path / "m").rglob("*") if f.is_file() and not f.name.endswith(".crc")) > 0


def test_walk_events(spark):
    grams = ["a", "a a", "a b", "ab", "b", "b a", "b a a"]
    rows = spark.createDataFrame([(g.count(" ") + 1, g) for g in grams], "n int, ngram string")
    got = [(r.event, r.ngram) for r in ordering.walk_events(rows).collect()]
    assert got == [("enter", "a"), ("enter", "a a"), ("exit", "a a"), ("enter", "a b"), ("exit", "a b"), ("exit", "a"), ("enter", "ab"), ("exit", "ab"), ("enter", "b"), ("enter", "b a"), ("enter", "b a a"), ("exit", "b a a"), ("exit", "b a"), ("exit", "b")]
    with pytest.raises(ValueError, match="missing"):
        ordering.walk_events(rows.where("ngram <> 'b a'"))


def test_state_slots_and_orders(spark):
    rows = spark.createDataFrame([([5, 7], False, [1, 2]), ([5, 7], True, []), ([9], False, [3]), ([], False, [])], "p array<long>, full boolean, w array<long>")
    assert [r[0] for r in rows.select(model.padded(F.col("p"), 3)).collect()] == [[5, 7, 0], [5, 7, 0], [9, 0, 0], [0, 0, 0]]
    p, full, w = F.col("p"), F.col("full"), F.col("w")
    assert [(r.p, r.full) for r in rows.orderBy(*model.left_state_key(p, full)).collect()] == [([], False), ([9], False), ([5, 7], False), ([5, 7], True)]
    assert [r.w for r in rows.orderBy(*model.chart_state_key(p, full, w)).collect()] == [[], [3], [1, 2], []]


def test_corpus_files(spark, tmp_path):
    import gzip

    for name, lines in (("b.txt", ["three words here", "", "x\r"]), ("a.txt", ["one", "two"])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    (tmp_path / "c.txt.gz").write_bytes(gzip.compress(b"packed line\n"))
    (tmp_path / "big.txt").write_text("".join(f"line {i}\n" for i in range(30_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")  # several splits of a file
    try:
        got = corpus.read_corpus(spark, f"file://{tmp_path}").orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.line for r in got] == ["one", "two", "three words here", "", "x", *(f"line {i}" for i in range(30_000)), "packed line"]
    assert len({r.line_no for r in got}) == len(got) and {r.file.rsplit("/", 1)[1] for r in got} == {"a.txt", "b.txt", "big.txt", "c.txt.gz"}


def test_quantiser(spark):
    values = spark.createDataFrame([(2, float(x)) for x in (5, 3, 1, 4, 2)] + [(3, 1.0)], "n int, value float")
    got = defaultdict(dict)
    for r in quantize.bins(values, 3).collect():
        got[r.n][r.bin] = r.centre
    assert got == {2: {0: 1.0, 1: 2.5, 2: 4.5}, 3: {2: 1.0}}
    assert [r.centre for r in quantize.full_table(quantize.bins(values, 3), 3).where("n = 3").orderBy("code").collect()] == [-math.inf, -math.inf, 1.0]
    centres = np.array([1, 2.5, 4.5], np.float32)
    assert quantize.nearest(np.array([0, 1, 1.7, 1.75, 2.5, 3.5, 9]), centres).tolist() == [0, 0, 0, 1, 1, 2, 2]
    assert quantize.table_bytes(3) == 1024 + 1024 + 1024 + 8
    m = log_probs(spark, C1 + C2, 3, "corrected")
    rows = spark.createDataFrame([(k.count(" ") + 1, k, float(p), None if b is None else float(b)) for k, (p, b) in m.items()], "n int, ngram string, prob float, backoff float")
    once = quantize.quantised_rows(rows, 3, 2, 2)
    twice = quantize.quantised_rows(once, 3, 2, 2)
    few = {r.n: r.k for r in once.groupBy("n").agg(F.countDistinct("prob").alias("k")).collect()}
    assert few[2] <= 4 and few[3] <= 4 and few[1] == len({p for k, (p, _) in m.items() if " " not in k})
    assert twice.count() == once.count()
    for bad in (0, 26):
        with pytest.raises(Exception, match="1 to 25"):
            quantize.train(rows, 3, bad, 8)


def test_filters(spark):
    lines = lambda *x: spark.createDataFrame(list(enumerate(x)), "line_no long, line string")
    words = lambda *x: spark.createDataFrame([(w,) for w in x], "word string")
    kept = lambda df: [r.line for r in df.orderBy("line_no").collect()]
    some = lines("-1.5\tred fish\t-0.25", "-1.5\tred boat\t-0.25", "", "-1\t\t", "red", "boat red")
    for vocab in (words("red", "fish"), filters.word_list_filter(["red", "fish"])):
        assert kept(filters.run_filter(some, vocab)) == ["-1.5\tred fish\t-0.25", "red"]
    for vocab in (words("red"), filters.word_list_filter(["red"], context_only=True)):
        assert kept(filters.run_filter(some, vocab, "single", context_only=True)) == ["-1.5\tred fish\t-0.25", "-1.5\tred boat\t-0.25", "red"]
    assert len(kept(filters.run_filter(some, filters.copy_filter, "unset"))) == 5
    assert kept(filters.run_filter(lines("p q", "r", "p q", "s", "r"), filters.copy_filter, "union")) == ["p q", "r", "s"]
    many = ["", "a", "b", "", "", "x", "", "c", "d"]
    for size in (1, 2, 3, 100):
        passed = filters.passing(lines(*many), filters.word_list_filter(list("abcd")))
        assert kept(filters.blocks(lines(*many), passed, size)) == ["a", "b", "", "c", "d"]
    with pytest.raises(ValueError):
        filters.run_filter(some, filters.copy_filter, "odd")


def test_orders(spark):
    grams = [("b a", 2), ("a b", 2), ("c b", 2), ("a a", 2), ("a", 1), ("b", 1)]
    rows = spark.createDataFrame([(n, g) for g, n in grams], "n int, ngram string")
    by = lambda order: [r.ngram for r in ordering.ranked_by(rows, order).where("n = 2").orderBy("rank").collect()]
    assert by("suffix") == ["a a", "b a", "a b", "c b"] and by("context") == ["a a", "a b", "b a", "c b"] and by("prefix") == ["a a", "a b", "b a", "c b"]
    assert [r.ngram for r in rows.orderBy(*ordering.suffix_order()).collect()] == ["a", "a a", "b a", "b", "a b", "c b"]
    assert [r.x for r in ordering.sorted_distinct(spark.createDataFrame([(1,), (1,), (2,), (0,)], "x int")).collect()] == [0, 1, 2]
    assert [r.h for r in spark.createDataFrame([(-1,), (0,), (5,)], "h long").orderBy(*ordering.hash_order()).collect()] == [0, 5, -1]
    with pytest.raises(ValueError, match="prefix of 'c b'"):
        ordering.joint_walk(rows)
    assert [r.ngram for r in ordering.joint_walk(rows.where("ngram <> 'c b'")).collect()] == ["a", "a a", "a b", "b", "b a"]
    states = spark.createDataFrame([(["b"],), (["a", "c"],), ([],), (["a"],)], "w array<string>")
    assert [r.w for r in states.orderBy(*model.state_key(F.col("w"))).collect()] == [[], ["a"], ["b"], ["a", "c"]]


def test_empty_corpus(spark):
    none = sents(spark, [])
    assert C.count_ngrams(none, 3).count() == 0 and estimate.estimate(C.count_ngrams(none, 2), BuildConfig(order=2)).count() == 0
    m = estimate.build(none, BuildConfig(order=2))
    assert [(r.prob, r.oov) for r in score.score_tokens(sents(spark, ["a"]), ["id"], m).collect()] == [(0, True), (0, False)]  # the markers are always known


@pytest.mark.parametrize("bos", [True, False])
@pytest.mark.parametrize("detail", [True, False])
def test_arrays_and_joins_score_alike(spark, gappy, tmp_path, monkeypatch, bos, detail):
    """Small models as arrays, and the joins that larger ones go through, on models with and without gaps and backoffs."""
    import dataclasses

    from gramloom.operators import lookup

    r = random.Random(5)
    built = [estimate.build(sents(spark, C1 + C2), BuildConfig(order=n, semantics=s)) for n, s in ((1, "reference"), (3, "reference"), (2, "corrected"), (4, "corrected"))]
    lines = [" ".join(r.choice("the cat sat on mat dog a b c d x <unk>".split()) for _ in range(r.randint(0, 9))) for _ in range(60)]
    text = spark.createDataFrame([(None if i == 3 else i, f"k{i}", x.split() if i != 7 else None) for i, x in enumerate(lines)], "id int, key string, words array<string>")
    plain = lambda df: sorted((str(x.key), x.pos, *[round(v, 5) if isinstance(v, float) else v for v in x[3:]]) for x in df.collect())
    for m in (gappy, dataclasses.replace(gappy, complete=False), *built):
        held = score.score_tokens(text, ["id", "key"], m, bos=bos, detail=detail)
        with monkeypatch.context() as patch:
            patch.setattr(lookup, "TEXT_BYTES", -1)
            joined = score.score_tokens(text, ["id", "key"], dataclasses.replace(m), bos=bos, detail=detail)
        assert lookup.arrays_of(m) is not None and held.columns == joined.columns and [t for _, t in held.dtypes] == [t for _, t in joined.dtypes]
        assert plain(held) == plain(joined)


def test_ngrams_one_by_one(spark):
    from gramloom.operators import lookup

    m = estimate.build(sents(spark, C1), BuildConfig(order=2))
    some = ordering.Ngrams(ordering.joint_walk(m.rows.where("ngram <> '<unk>'")))
    grams = [r.ngram for r in some]
    assert len(grams) == len(some) == m.rows.count() - 1 and grams == sorted(grams, key=lambda g: g.split(" "))
    held = lookup.arrays_of(m)
    assert held.nbytes > lookup.ENTRY_BYTES * len(some)
