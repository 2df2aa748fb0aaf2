"""The classifier's views, teachers and threshold."""

import numpy as np

from gramloom.llm import quality
from test_text_operators import DOCS, frame

SF = "/root/testdata/sf0.1"


def test_the_page_view_sees_nothing_of_the_text(spark):
    one = spark.createDataFrame([(1, "some words", "en", "web", 10), (2, None, None, None, None)], DOCS)
    other = spark.createDataFrame([(1, "quite\nother\nwords and more of them", "en", "web", 10), (2, "x" * 5000, None, None, None)], DOCS)
    a, b = (quality._unpacked(quality.features(d).orderBy("doc_id").toArrow()) for d in (one, other))
    assert np.array_equal(a[1], b[1]) and not np.array_equal(a[0], b[0])
    assert a[1].shape == (2, quality.N_META) and (a[1][:, : quality.N_META - 2].sum(1) == 3).all()


def test_teachers_look_through_all_rows(spark):
    r = np.random.default_rng(1)
    docs = frame(spark, [" ".join(["word"] * int(n)) + "#" * int(m) for n, m in r.integers(1, 60, (300, 2))]).repartition(5)
    pool = quality.scratch(quality.features(docs), "test-pool")
    got = pool.toArrow()
    text, meta = quality._unpacked(got)
    scale = quality.Scale(text.mean(0), text.std(0) + 1e-3)
    w = np.concatenate([r.normal(size=quality.N_TEXT) * 3, [0.0]])
    p = quality._chance(quality._logit(scale(text), w))
    uids = got["uid"].to_numpy()
    known = {int(uids[p.argmax()]): (text[0], meta[0], 1.0)}
    free = np.array([u not in known for u in uids])
    order = np.lexsort((got["doc_id"].to_numpy(), p))
    bad = [int(uids[k]) for k in order if p[k] < 0.05 and free[k]][:7]
    order = np.lexsort((got["doc_id"].to_numpy(), -p))
    good = [int(uids[k]) for k in order if p[k] > 0.95 and free[k]][:11]
    taught = quality.surest_of(pool)("text", w, scale, known, 11, 7)
    assert {u for u, x in taught.items() if x[2] == 0} == set(bad) and len({u for u, x in taught.items() if x[2] == 1}) == len(good)
    assert all(p[list(uids).index(u)] > 0.95 for u, x in taught.items() if x[2] == 1) and len(bad) == 7


def test_threshold_tolerates_wrong_labels():
    r = np.random.default_rng(5)
    good = (r.random(3000) < 0.85).astype(int)
    p = np.where(good == 1, 1 - r.beta(1, 60, 3000), r.beta(1, 60, 3000))
    for flipped in (0, 0.01, 0.03):
        marks = np.where(r.random(3000) < flipped, 1 - good, good)
        at = quality.threshold_of(p, marks)
        assert (p[good == 0] < at).mean() > 0.9 and (p[good == 1] < at).mean() < 0.005, (flipped, at)


def test_wrong_labels_on_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    wrong = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 40 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    m = quality.fit(docs, wrong)
    rows = quality.score(docs, m).join(labels, "doc_id").collect()
    bad, good = [x for x in rows if x.quality == 0], [x for x in rows if x.quality == 1]
    assert sum(not x.keep for x in bad) / len(bad) > 0.95 and sum(x.keep for x in good) / len(good) > 0.995


def test_repeated_and_missing_rows(spark):
    rows = [(None, None, None, None, None)] * 3 + [(1, "a b", "en", "s", 3)] * 4 + [(2, "x" * 300_000, "en", "s", 300_000)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)] * 5, "doc_id long, quality int, toxic int")
    m = quality.fit(docs, labels)
    assert quality.score(docs, m).count() == 8 and quality.keep_good(docs, m).count() <= 8
    again = quality.fit(docs.repartition(3), labels)
    assert (m.text is None) == (again.text is None)
