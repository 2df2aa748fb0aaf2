"""The mix's rows against its figures, where ids are null, repeated or on rows without words."""

import random
from collections import Counter

import pytest

from gramloom.llm import mixing
from test_text_operators import DOCS, clashing


def taken(rows):
    return Counter({k: n for k, n in rows.items() if n})


@pytest.mark.parametrize("seed", range(3))
def test_rows_are_what_the_mix_says(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(300):
        words = r.choice([0, 0, 1, 10, 10, r.randint(2, 30)])
        rows.append((r.choice([None, None, 7, 7, r.randint(0, 400)]), " ".join(["w"] * words) if words or r.random() < 0.5 else None, "en", r.choice(["a", "b", None, "c"]), 0))
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    told = Counter()
    sums, target = Counter(), {}
    for x in mixing.mix(clashing(docs)).collect():
        assert x.taken in (0, x.size, 2 * x.size)
        told[x.doc_id, x.source, x.size] += x.taken // x.size if x.size else 0
        sums[x.source] += x.taken
        target[x.source] = x.target
    got = Counter((x.doc_id, x.source, len((x.text or "").split())) for x in mixing.mixed_rows(clashing(docs)).collect())
    assert got == taken(told)
    assert all(abs(sums[s] - target[s]) <= 30 for s in target)


def test_rows_without_ids_stay_beside_an_empty_one(spark):
    rows = [(None, " ".join(["w"] * 10), "en", "a", 0)] * 3 + [(None, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    total = sum(x.taken for x in mixing.mix(docs).collect())
    assert total in (40, 50) and total == 10 * mixing.mixed_rows(docs).count()  # 45 is the target


def test_one_id_on_most_rows(spark):
    """The end lies among rows of one id: as many of them are taken as come nearest to the target."""
    rows = [(5, "a b c", "en", "x", 0)] * 200 + [(i, "a b c d", "en", "y", 0) for i in range(6, 90)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    got = mixing.mix(docs).collect()
    for s in "xy":
        own = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 2
    assert mixing.mixed_rows(docs).count() == sum(x.taken // x.size for x in got)
