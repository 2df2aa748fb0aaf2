"""Odd rows through whole operators: no ids, repeated rows, very long texts, very frequent texts, extra columns with clashing names."""

from collections import Counter

import corpus_pipeline
from gramloom.llm import mixing, near_dedup, quality
from test_text_operators import DOCS, clashing, frame


def odd_rows():
    long = " ".join(f"w{i % 7000}x{i % 13}" for i in range(60_000))
    prose = [" ".join(f"v{k}{(i * k) % 97}" for i in range(1, 60)) for k in range(30)]
    rows = [(None, None, None, None, None)] * 4 + [(None, "", "en", "web", 0)] * 3 + [(5, "the same words in a row", "en", "web", 23)] * 5
    rows += [(6, long, "de", "books", len(long)), (7, long + " more", "de", None, len(long) + 5), (None, long, "de", "books", len(long))]
    rows += [(10 + k, t, "en", "web" if k % 3 else "books", len(t)) for k, t in enumerate(prose)]
    return rows + rows[-3:]  # whole rows again


def test_pipeline_takes_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10 + k, 1, 0) for k in range(20)] + [(5, 1, 0), (999, 0, 0), (None, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages, sizes = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stages = corpus_pipeline.scratch(stage(spark, stages, str(tmp_path)), "stage")
        sizes.append(stages.count())
        assert k == 4 or stages.columns == docs.columns
        if k == 2:
            left = stages.collect()
    # One label class only: all stay; then one of each text and of each near copy.
    assert sizes[0] == docs.count() and sizes[1] == len({"".join((t or "").split()) for _, t, *_ in odd_rows()})
    assert sizes[2] == sizes[1] - 1 and sum(len(r.text or "") > 100_000 for r in left) == 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sizes[4] > 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_long_texts_are_near_copies(spark):
    long = [f"w{i % 9000}y{i % 11}" for i in range(80_000)]
    texts = [" ".join(long), " ".join(long[:-500]), " ".join(reversed(long)), " ".join(long[40_000:])]
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(clashing(frame(spark, texts))).collect()}
    assert got[0] == got[1] == 0 and got[2] == 2


def test_long_texts_are_mixed_and_judged(spark):
    texts = ["word " * 200_000, "one two three", None]
    got = {r.doc_id: r.size for r in mixing.mix(clashing(frame(spark, texts))).collect()}
    assert got == {0: 200_000, 1: 3, 2: 0}
    m = quality.fit(frame(spark, texts * 10), spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int"))
    assert quality.score(clashing(frame(spark, texts)).drop("score"), m).count() == 3


def test_one_text_on_most_rows(spark):
    rows = [(None if k % 2 else k, "exactly these words stand on most of the rows", "en", "web", 0) for k in range(3000)] + [(5000 + k, f"another text number {k} of its own words", "en", "web", 0) for k in range(5)]
    got = Counter((r.class_size, r.kept) for r in near_dedup.near_classes(spark.createDataFrame(rows, DOCS)).collect())
    assert got[3000, True] == 1 and got[3000, False] == 2999 and got[1, True] == 5
