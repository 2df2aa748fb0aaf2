"""Connected components: what the joins make, and odd shapes of links."""

import random

import pytest

from gramloom.llm import graph


def joined_rows(spark, since: int = -1) -> tuple[int, int]:
    """Rows that joins made in executions after the given one, and the last execution."""
    store, rows, last = spark._jsparkSession.sharedState().statusStore(), 0, since
    runs = store.executionsList()
    for k in range(runs.size()):
        run = runs.apply(k).executionId()
        last = max(last, run)
        if run <= since:
            continue
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())) if "Join" in node.name() else ():
                if m.name() == "number of output rows" and (v := values.get(m.accumulatorId())).isDefined():
                    rows += int(v.get().replace(",", ""))
    return rows, last


def labels_of(pairs):
    label = {}
    for a, b in pairs:
        x, y = label.setdefault(a, {a}), label.setdefault(b, {b})
        if x is not y:
            x |= y
            for k in y:
                label[k] = x
    return {k: min(v) for k, v in label.items() if len(v) > 1}


def test_a_large_group_s_links_are_joined_once(spark):
    r = random.Random(2)
    names = r.sample(range(10**9), 700)
    leads = sorted(names[:60])
    group = [(x, n) for n in names[60:] for x in r.sample(leads, 12)]  # each text is linked to many of the group's leads
    chain = [(2 * 10**9 + k, 2 * 10**9 + k + 1) for k in range(40)]  # takes the rounds
    frame = spark.createDataFrame(group + chain, "a long, b long").localCheckpoint()
    _, last = joined_rows(spark)
    got = {x.node: x.label for x in graph.components(frame).collect()}
    made, _ = joined_rows(spark, last)
    assert got == labels_of(group + chain)
    assert 0 < made <= 3 * len(group + chain), made


@pytest.mark.parametrize("shape", ["none", "loops", "star of a large one", "comb", "zigzag"])
def test_odd_shapes(spark, shape):
    pairs = {
        "none": [],
        "loops": [(5, 5), (7, 8), (8, 7), (7, 8), (8, 8)],
        "star of a large one": [(900, k) for k in range(-40, 40)],
        "comb": [(k, k + 1) for k in range(50)] + [(k, 1000 - k) for k in range(50)],
        "zigzag": [e for k in range(60) for e in ((k, 500 + k * 7 % 60), (k + 1, 500 + k * 7 % 60))],
    }[shape]
    got = {x.node: x.label for x in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == labels_of(pairs)
