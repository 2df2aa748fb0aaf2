"""Vector best-fit with the query's own parameters against the rule looked at bin by bin."""

import math
import random

import pytest

from gramloom.llm import packing
from test_text_operators import DOCS


def plain_fit(items, capacity, weights, rule):
    open_, bins = [], []
    for k, n in sorted(items, key=lambda x: (-x[1], x[0])):
        need = (n, 1, n * n)
        can = [b for b, rest in enumerate(open_) if all(x >= y for x, y in zip(rest, need, strict=True))]
        if rule == "norm":
            score = lambda b, need=need: sum(w * (x - y) ** 2 / c**2 for w, x, y, c in zip(weights, open_[b], need, capacity, strict=True))
        else:
            score = lambda b, need=need: -sum(w * x * y / c**2 for w, x, y, c in zip(weights, open_[b], need, capacity, strict=True))
        if not can:
            open_.append(capacity)
            bins.append([])
        best = len(open_) - 1
        if can:
            least = min(map(score, can))
            best = next(b for b in can if score(b) <= least + 1e-12)
        open_[best] = tuple(x - y for x, y in zip(open_[best], need, strict=True))
        bins[best].append(k)
    return bins


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_the_query_s_own_rule(rule):
    r = random.Random(4)
    capacity = (packing.SEQUENCE, packing.SEQUENCE, packing.SEQUENCE**2)
    assert all(w > 0 for w in packing.WEIGHTS)
    for _ in range(4):
        items = [(k, min(2048, int(r.paretovariate(0.7) * 20))) for k in range(400)]
        got = packing.best_fit(items, rule=rule)
        assert got == plain_fit(items, capacity, packing.WEIGHTS, rule)
        if rule == "norm":
            assert got != packing.best_fit(items, weights=(1.0, 0.0, 0.0))  # the other residuals decide too
            assert len(got) <= math.ceil(sum(n for _, n in items) / 2048) + 1


def test_capacities_bind():
    r = random.Random(5)
    items = [(k, r.randint(1, 60)) for k in range(600)]
    for capacity in ((64, 4, 64 * 64), (64, 64, 3600), (200, 7, 5000)):
        got = packing.best_fit(items, capacity, rule="norm")
        assert got == plain_fit(items, capacity, packing.WEIGHTS, "norm")
    with pytest.raises(ValueError):
        packing.best_fit([(0, 61)], (64, 64, 3600))


def test_rows_without_ids_are_dealt_to_many_tasks(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "PIECES_A_TASK", 50)
    docs = spark.createDataFrame([(None, f"word {i}", None, None, None) for i in range(400)], DOCS)
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(rows) == 400 and len({r.sequence_id >> 32 for r in rows}) == 8 and len({(r.sequence_id, r.offset) for r in rows}) == 400
