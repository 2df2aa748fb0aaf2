from datetime import datetime

from gramloom.config import BuildConfig
from gramloom.operators import corpus, estimate
from gramloom.streaming import scoring


def test_windowed_counts_as_a_stream(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [(at(1), "a b"), (at(2), "a"), (at(31), "b"), (at(59), "")]
    spark.createDataFrame(rows, "ts timestamp, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    query = scoring.windowed_counts(stream, 1, "30 minutes").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.start.minute, r.ngram): r.c for r in spark.table("windows").collect()}
    assert got == {(0, "a"): 2, (0, "b"): 1, (0, "<s>"): 2, (0, "</s>"): 2, (30, "b"): 1, (30, "<s>"): 1, (30, "</s>"): 1}


def test_scored_stream(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a b a"), (1, "b")], "doc_id int, text string")
    m = estimate.build(corpus.sentences(docs), BuildConfig(order=2))
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    query = scoring.score_stream(stream, ["doc_id"], m, lambda batch, _: batch.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "state"))
    query.awaitTermination()
    got = {r.doc_id: (r.tokens, r.oov) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (4, 0), 1: (2, 0)}


def test_chains(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    from gramloom.errors import ConfigError
    from gramloom.streaming.chain import Chain, ChainConfig, source

    rows = spark.createDataFrame([(3,), (1,), (2,), (1,)], "x int")
    plain = Chain().add("double", lambda d: d.select((F.col("x") * 2).alias("x")))
    chain = plain.sort("x", distinct=True)
    assert [r.x for r in chain.run(rows).collect()] == [2, 4, 6] and [r.x for r in plain.sort("x").run(rows).collect()] == [2, 2, 4, 6]
    assert chain.position("sort") == 1 and len(plain.steps) == 1 and sorted(r.x for r in chain.run(rows, upto="double").collect()) == [2, 2, 4, 6]
    for bad in (lambda: plain.add("double", None), lambda: ChainConfig(batch_rows=0)):
        with pytest.raises(ConfigError):
            bad()
    for k in range(5):
        rows.coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    ChainConfig(batch_rows=77).apply(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "77"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    sizes = []
    stream = plain.run(source(spark, str(tmp_path / "in" / "*"), "x int", ChainConfig(files_per_trigger=2)))
    query = stream.writeStream.foreachBatch(lambda batch, _: sizes.append(batch.count())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sizes == [8, 8, 4]
