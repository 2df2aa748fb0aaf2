"""Near-dedup's verification in stars and blocks against all pairs."""

import random

import numpy as np
import pytest

from gramloom.llm import near_dedup
from test_index_operators import near_texts, plain_classes, plain_shingles, plain_similarity
from test_text_operators import frame


def family(seed, n, words=120, share=0.9):
    """Texts of one template, many of them a little less alike than the threshold."""
    r = random.Random(seed)
    base = [f"b{seed}x{k}" for k in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(r.choice([1, 2, 3, 4])):
            own[r.randrange(words)] = f"e{seed}x{i}x{r.randrange(1000)}"
        if r.random() < 0.3:
            own += own[:20] * r.randint(1, 3)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("how", [{}, {"star": 3, "block_texts": 7}, {"unit_texts": 4, "block_texts": 5, "block_bytes": 3000}])
def test_classes_are_those_of_all_pairs(spark, how):
    texts = family(1, 60) + family(2, 25) + near_texts(5)
    random.Random(1).shuffle(texts)
    label = plain_classes(texts)
    got = {r.doc_id: r for r in near_dedup._classes(frame(spark, texts), **how).collect()}
    assert [got[i].class_id for i in range(len(texts))] == label
    assert len(set(label)) > 30


def test_bound_holds_and_is_tight_for_sets():
    r = random.Random(3)
    texts = family(4, 30) + family(5, 10, 12)
    held = near_dedup.Texts.of(texts)
    plain = [plain_shingles(t) for t in texts]
    for _ in range(300):
        i, j = r.randrange(len(texts)), r.randrange(len(texts))
        shared = np.intersect1d(held.part(i)[0], held.part(j)[0])
        p, q = (held.shares[held.at[k] : held.at[k + 1]][np.isin(held.part(k)[0], shared)].sum() for k in (i, j))
        bound, exact = float(near_dedup.highest(p, q)), near_dedup.similarity(*held.part(i), *held.part(j))
        set_only = len(plain[i].keys() & plain[j].keys()) / len(plain[i].keys() | plain[j].keys())
        assert max(bound, set_only) >= exact - 1e-9
    assert abs(float(near_dedup.highest(np.float64(0.9), np.float64(0.9))) - 0.9 / 1.1) < 1e-12


def test_joins_connects_what_links_connect(monkeypatch):
    for few in (2, 8):
        monkeypatch.setattr(near_dedup, "FEW", few)
        texts = family(6, 40) + near_texts(7)[:60]
        held = near_dedup.Texts.of([" ".join((t or "").lower().split()) for t in texts])
        r = np.random.default_rng(few)
        label = r.integers(0, 70, len(texts))
        rows, cols = np.sort(r.permutation(len(texts))[:50]), np.arange(len(texts))
        found = held.joins(rows, cols, label, 0.8)
        plain = [plain_shingles(t) for t in texts]
        links = [(i, j) for i in rows for j in cols if label[i] != label[j] and plain_similarity(plain[i], plain[j]) >= 0.8]
        assert set(found) <= {(int(i), int(j)) for i, j in links}

        def classes(pairs):
            root = {}

            def find(x):
                while x in root:
                    x = root[x]
                return x

            for i, j in pairs:
                x, y = sorted((find(label[i]), find(label[j])))
                if x != y:
                    root[y] = x
            return [find(x) for x in label]

        assert classes(found) == classes(links) and len(found) < 70


def test_nodes_that_share_a_hash_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = F.xxhash64
    # Nodes are 3 bits of the key's hash, so that keys collide; the second hash is the real one.
    monkeypatch.setattr(near_dedup.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(8)) if c == ("key",) else real(*c))
    texts = family(8, 12) + ["some words alone here now", "other words alone here now", None, ""]
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(frame(spark, texts)).collect()}
    label = plain_classes(texts)
    assert [got[i] for i in range(len(texts))] == label
