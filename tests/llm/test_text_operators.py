"""Licence scan, exact dedup, mixing and personal data against plain versions, with nulls, ties, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramloom.llm import exact_dedup, licenses, mixing, pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, sources=None):
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], DOCS)


def clashing(docs):
    """docs with columns that have the names of what operators make."""
    return docs.selectExpr("*", "1 AS kept", "'x' AS h", "2 AS uid", "3 AS norm", "4 AS size", "5 AS target", "6 AS key", "7 AS bands", "8 AS score")


# --- licences ---------------------------------------------------------------------------------------------------------


def test_licences(spark):
    mit = "\n\n".join(s for k in ("mit-grant", "mit-notice", "mit-as-is", "mit-liability") for s in licenses.SENTENCES[k])
    wrapped = re.sub(r"(.{60}) (?=[a-z])", r"\1\n", mit)
    texts = [mit, wrapped, "Some prose. Released under the MIT License. More.", "All rights reserved.", None, "", "MIT", "Licensed under CC BY 4.0.\nThis work is dedicated to the public domain.", "x. " * 50_000]
    got = {r.doc_id: r for r in licenses.scan(clashing(frame(spark, texts))).collect()}
    assert [got[i].licences for i in range(9)] == ["MIT", "MIT", "MIT", "", "", "", "", "CC-BY-4.0,CC0-1.0", ""]
    assert got[0].sequence == "mit-grant mit-notice mit-as-is mit-liability" and got[0].unmatched == ""
    assert got[3].unmatched == "reserved" and (got[4].n_sentences, got[5].n_sentences, got[8].n_sentences) == (0, 0, 50_000)
    assert licenses.scan(frame(spark, [])).count() == 0


def test_every_known_sentence_is_found(spark):
    rows = [(k, s) for k, sentences in licenses.SENTENCES.items() for s in sentences]
    got = licenses.scan(frame(spark, ["Before this. " + s + "\n\nAfter that." for _, s in rows])).collect()
    assert {r.doc_id for r in got if rows[r.doc_id][0] in r.sequence.split(" ")} >= {i for i, (k, s) in enumerate(rows) if not re.search(r"[.:;] ", s[:-1])}


def test_licences_match_only_whole_sentences(spark):
    got = licenses.scan(frame(spark, ["It is released under the MIT License by us.", "released under the mit license"])).orderBy("doc_id").collect()
    assert [r.licences for r in got] == ["", "MIT"]


# --- exact dedup ------------------------------------------------------------------------------------------------------


def plain_dedup(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", text or "")].append((doc, text or ""))
    out = {}
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0]))[0]
        for doc, _ in members:
            out[doc] = (keep, len(members), doc == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def messy(n, seed=1):
    r = random.Random(seed)
    base = ["alpha beta", "alphabeta", "a", "", None, "Ünï cödé", "x y", "long " * 2000, "𝄞 music"]
    return [None if (b := r.choice(base)) is None else "".join(c + r.choice(["", "", " ", "\n\t"]) if c == " " or r.random() < 0.1 else c for c in b) for _ in range(n)]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    texts = messy(300)
    how = {"hash_of": lambda c: F.unhex(F.substring(F.md5(c), 1, 1))} if weak else {}  # 16 hashes only: collisions
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(clashing(frame(spark, texts)), **how).collect()}
    assert got == plain_dedup(enumerate(texts))


def test_exact_dedup_defined_cases(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    rows = [(None, "a b"), (None, "a b"), (3, "ab"), (3, "a b"), (3, "a b"), (4, "z"), (None, "q")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == 7 and sum(r.kept for r in got) == 3 and {r.keep_id for r in got if r.group_size == 5} == {3}
    left = exact_dedup.drop_copies(clashing(docs))
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in left.collect()) == [(False, 3, "a b"), (False, 4, "z"), (True, None, "q")]
    assert left.columns == clashing(docs).columns
    plain = frame(spark, messy(100))
    kept = {r.doc_id for r in exact_dedup.drop_copies(plain).collect()}
    assert kept == {d for d, v in plain_dedup((r.doc_id, r.text) for r in plain.collect()).items() if v[2]}


# --- mixing -----------------------------------------------------------------------------------------------------------


def filled(sizes, weights, budget, epochs):
    """Targets by clamping and resharing in rounds."""
    left, target, full = budget * sum(sizes.values()), {}, set()
    while True:
        rest = left - sum(sizes[s] * epochs for s in full)
        open_ = {s: weights[s] for s in sizes if s not in full}
        if not open_:
            break
        target = {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        over = {s for s in open_ if target[s] > sizes[s] * epochs + 1e-9}
        if not over:
            break
        full |= over
    return {s: sizes[s] * epochs if s in full else target[s] for s in sizes}


@pytest.mark.parametrize("seed", range(4))
def test_mixing(spark, seed):
    r = random.Random(seed)
    names = ["b", "a", "Z", "é", None, "empty"][: 3 + seed % 4]
    sources = [r.choice(names) if r.random() < 0.6 else names[0] for _ in range(400)]
    texts = [None if r.random() < 0.05 else "" if s == "empty" else " ".join(["w"] * r.randint(0, 30)) + "\n" for s in sources]
    got = mixing.mix(clashing(frame(spark, texts, sources))).collect()
    assert len(got) == 400
    sizes = defaultdict(int)
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    target = filled(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    taken = defaultdict(int)
    for row in got:
        words = len((texts[row.doc_id] or "").split())
        assert (row.source, row.size, row.source_size) == (sources[row.doc_id], words, sizes[sources[row.doc_id]])
        assert abs(row.target - target[row.source]) < 1e-6 and row.taken in (0, words, 2 * words)
        taken[row.source] += row.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 30
    again = {r.doc_id: r.taken for r in mixing.mix(frame(spark, texts, sources).repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    rows = mixing.mixed_rows(clashing(frame(spark, texts, sources)))
    times = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert times == {r.doc_id: r.taken // r.size for r in got if r.taken} and rows.columns == clashing(frame(spark, [])).columns


def test_mixing_defined_cases(spark):
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mixed_rows(frame(spark, [])).count() == 0
    assert [(r.size, r.taken) for r in mixing.mix(frame(spark, [None, ""])).collect()] == [(0, 0)] * 2
    rows = [(1, "a b c", "en", "s", 0)] * 5 + [(None, "a", "en", None, 0)] * 3
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 8 and abs(sum(r.taken for r in got if r.source) - got[0].target) <= 3
    assert mixing.mixed_rows(spark.createDataFrame(rows, DOCS)).count() > 0


# --- personal data ----------------------------------------------------------------------------------------------------


def plain_spans(text):
    """The base's patterns, written as they stand."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_base_patterns():
    r = random.Random(5)
    bits = ["a", "b.c", "@", ".", "-", " ", "1", "22", "255", "256", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "+", "(", ")", "1.2.3.4", "01.002.3.4", "x@y.z", "é", "a@b.c.d@e.f", "%_", "\n", "0000"]
    for _ in range(6000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "-" * 200_000, "a@" * 50_000):
        assert pii.base_spans(text) is not None


def test_personal_data(spark):
    texts = ["mail x.y@z.com now", None, "", 'api_key = "f3a9c8d7e6b5a4f3a9c8d7e6b5a4"', "call (555) 123-4567 today", "plain words only, in 1999.", "é 10.0.0.1 and 4111 1111 1111 1111"]
    got = {r.doc_id: r for r in pii.find(clashing(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        base = plain_spans(t or "")
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        written = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest() and set(filter(None, written.split(","))) <= set(got[i].spans.split(","))
    assert got[3].spans.startswith("secret:") and got[4].spans.startswith("number:") and got[5].spans == "" and got[1].spans == ""
    assert pii.find(frame(spark, [])).count() == 0


def test_field_is_right_on_sentences_it_has_not_seen():
    tables, moves = pii.default_model()
    held = pii.labelled_table(400, seed=99)
    right = wrong = missed = 0
    for (_, spans), found in zip(held, pii.field_spans([t for t, _ in held], tables, moves), strict=True):
        for tag, a, b in spans:
            hit = any(x < b and a < y and pii.KINDS[k] == {"S": "secret", "N": "number"}[tag] for x, k, y in found)
            right, missed = right + hit, missed + (not hit)
        wrong += sum(not any(x < b and a < y for _, a, b in spans) for x, _, y in found)
    assert right / (right + missed) > 0.95 and wrong / max(1, right) <= 0.05  # 5 false spans for 100 right ones


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(2)
    moves = r.normal(size=(3, 3)).astype(np.float32)
    text_of = np.repeat([0, 1, 2], [4, 1, 5])
    scores = r.normal(size=(10, 3)).astype(np.float32)
    import itertools

    got = pii.viterbi(scores, text_of, moves)
    for k in range(3):
        at = np.flatnonzero(text_of == k)
        value = lambda path, at=at: sum(scores[i, t] for i, t in zip(at, path, strict=True)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False))
        best = max(itertools.product(range(3), repeat=len(at)), key=value)
        assert abs(value(tuple(got[at])) - value(best)) < 1e-5
