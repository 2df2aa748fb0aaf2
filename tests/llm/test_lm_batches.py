"""The language model's words, counts and states, taken for many texts at once, against the plain definitions."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from test_index_operators import frame, small_vocabulary

from gramloom.llm import rnn_lm

ODD = [chr(c) for c in range(128)] + list("  \n\t\x0b\x85\xa0　éİKßÀ😀.!?,;")


def odd_texts() -> list[str]:
    r = random.Random(4)
    return ["", " ", "\n", "a", " a ", "...", "Ab\x00c"] + ["".join(r.choice(ODD) for _ in range(r.randrange(14))) for _ in range(3000)] + [""]


def plain_words(text: str) -> list[bytes]:
    return [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(rb"[^\x20\x09-\x0d]+", text.encode())]


def plain_shape(word: bytes) -> int:
    groups = (b".!?", b",;:", b"0123456789", bytes(c for c in range(33, 127) if not chr(c).isalnum()))
    end = next((g for g, marks in enumerate(groups, 1) if word[-1:] in [bytes([m]) for m in marks]), 0)
    core = word.rstrip(b".!?,;:#$%&*|")
    last = next((g for g, marks in enumerate((b"e", b"aiouy", b"ns", b"rltd", b"bcfghjkmpqvwxz"), 1) if core and core[-1] in marks), 0)
    return (end * 2 + any(c > 127 for c in word)) * 6 + last


def test_words_and_their_shapes_of_many_texts():
    texts = odd_texts()
    numbers, words = rnn_lm.split(pa.array(texts))
    want = [plain_words(t) for t in texts]
    assert numbers.tolist() == [len(w) for w in want] and [w.encode() for w in words.to_pylist()] == [w for own in want for w in own]
    assert rnn_lm.shapes(words).tolist() == [plain_shape(w) for own in want for w in own]
    assert rnn_lm.shapes(words.slice(7, 50)).tolist() == rnn_lm.shapes(words).tolist()[7:57]
    assert rnn_lm.shapes(words.slice(0, 0)).tolist() == [] and rnn_lm.split(pa.array([""]))[0].tolist() == [0]


def test_many_texts_are_read_as_one_by_one():
    texts = odd_texts() + ["the cat a rare rare word, the dog of", "rare. Éa"]
    v = small_vocabulary()
    v.head = 4  # cat and dog are known, but not the network's own
    reader = rnn_lm.Reader(v)
    parts = [pa.array(texts[a : a + 500]) for a in range(0, len(texts), 500)]
    got = list(reader.read(parts))
    assert list(reader.read([])) == [] and len(got) == len(parts)
    place = {w: k for k, w in enumerate(v.words)}
    for part, (sizes, symbols, (known, base, tail), (rare, numbers, cuts)) in zip(parts, got, strict=True):
        at, rare = 0, [w.encode() for w in rare.to_pylist()]
        for k, text in enumerate(part.to_pylist()):
            words = [*plain_words(text), rnn_lm.END]
            places = [place.get(w, -1) for w in words]
            of = [p if 0 <= p < v.head else v.head + (v.shapes[p] if p >= 0 else plain_shape(w)) for p, w in zip(places, words, strict=True)]
            assert sizes[k] == len(words) and symbols[at : at + len(words)].tolist() == of and known[k] == sum(p >= 0 for p in places)
            logs = [np.log10(v.counts[p] + 0.5) if p >= 0 else 0.0 for p in places]
            assert np.isclose(base[k], sum(logs) - v.base_log * len(words))
            assert np.isclose(tail[k], sum(x - v.shape_log[s - v.head] for x, s in zip(logs, of, strict=True) if s >= v.head))
            own = slice(cuts[k], cuts[k + 1])
            assert len(rare[own]) == len(set(rare[own])) and dict(zip(rare[own], numbers[own].tolist(), strict=True)) == Counter(w for w, p in zip(words, places, strict=True) if p < 0)
            at += len(words)


def test_known_words_are_hashed_once_for_many_parts(monkeypatch):
    calls, plain = [], rnn_lm.pc.index_in
    monkeypatch.setattr(rnn_lm.pc, "index_in", lambda *a, **k: calls.append(1) or plain(*a, **k))
    assert len(list(rnn_lm.Reader(small_vocabulary()).read([pa.array(["the cat"]), pa.array(["a", ""]), pa.array(["of"])]))) == 3
    assert len(calls) == 1


def test_counts_do_not_depend_on_when_they_are_sent(spark):
    texts = odd_texts()
    want = Counter(w for t in texts for w in [*plain_words(t), rnn_lm.END])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        for most in (1, 300, 500_000):
            rows = rnn_lm.count_words(frame(spark, [*texts, None]), most).collect()
            assert {bytes(r.word): r.c for r in rows} == want + Counter([rnn_lm.END]) and len(rows) == len(want)
            assert all(r["shape"] == (-1 if r.word == rnn_lm.END else plain_shape(bytes(r.word))) for r in rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_steps_of_many_lanes_are_those_of_one_step():
    v = small_vocabulary()
    w = rnn_lm.start_weights(v, 8)
    r = np.random.default_rng(6)
    inputs, opens = r.integers(0, v.head, (30, 5)), r.random((30, 5)) < 0.1
    h = start = r.normal(size=(5, 8)).astype(np.float32)
    goes, gates, new, hu, before, after = rnn_lm._forward(w, inputs, opens, start)
    for t in range(30):
        h = np.where(opens[t][:, None], 0, h).astype(np.float32)
        keep, reset, value, part, then = rnn_lm._cell(w, w["embed"][inputs[t]], h)
        for x, y in ((before[t], h), (gates[0, t], keep), (gates[1, t], reset), (new[t], value), (hu[t], part), (after[t], then)):
            assert np.allclose(x, y, atol=1e-5)
        h = then
    assert np.array_equal(rnn_lm._forward(w, inputs, opens, start, False)[-1], after)


def test_a_window_changes_each_array_once():
    v = small_vocabulary()
    names = []

    class Spy(rnn_lm.Trainer):
        def _step(self, name, slope, rows=slice(None)):
            names.append(name)
            super()._step(name, slope, rows)

    inputs, targets, _, opens, going = rnn_lm._lanes([np.array([1, 4, 2, 3, 5, 0]), np.array([3, 1, 0])], 2, 0)
    Spy(v, rnn_lm.start_weights(v, 4)).window(inputs, targets, opens, going, np.zeros((2, 4), np.float32))
    assert sorted(names) == ["class", "class_bias", "embed", "state", "word", "word_bias"]
