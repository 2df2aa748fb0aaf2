"""Stored models: Parquet entries by order, the vocabulary, and a note of what it is."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.config import VARIANTS, ModelConfig
from gramloom.errors import FormatError, VersionError
from gramloom.operators import quantize
from gramloom.operators.model import Model
from gramloom.sources.arpa import load_arpa

KIND, VERSION = "gramloom-model", 1


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_model(model: Model, path: str, variant: str | None = None) -> None:
    """Writes entries by order (so that a read of one order opens only its files), vocabulary and note.

    The quantised variants keep codes and tables of centres instead of values for n-grams of two words and more.
    """
    spark, variant = model.rows.sparkSession, variant or model.config.variant
    if variant not in VARIANTS:
        raise FormatError(f"no such variant: {variant}")
    rows = model.rows
    if variant.startswith("quant"):
        bits = model.config.prob_bits, model.config.backoff_bits
        tables = quantize.train(rows.where("not is_blank"), model.order, *bits)
        tables.write.parquet(f"{path}/centres")
        rows = quantize.encode(rows, spark.read.parquet(f"{path}/centres"), *bits)
        single = F.col("n") == 1
        rows = rows.withColumn("prob", F.when(single, F.col("prob"))).withColumn("backoff", F.when(single, F.col("backoff")))
    rows.repartition("n", F.pmod(F.xxhash64("ngram"), F.lit(64))).write.partitionBy("n").parquet(f"{path}/entries")
    if model.config.include_vocab:
        model.vocab().write.parquet(f"{path}/vocab")
    about = {"kind": KIND, "version": VERSION, "variant": variant, "order": model.order, "counts": {str(k): c for k, c in model.counts().items()}, "semantics": model.config.semantics, "complete": model.complete, "flat": model.flat, "unk_inside": model.unk_inside, "prob_bits": model.config.prob_bits, "backoff_bits": model.config.backoff_bits}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")  # last: a folder without it isn't a model


def recognise(spark: SparkSession, path: str) -> dict | None:
    """The note of a stored model; None for anything else."""
    if not _exists(spark, f"{path}/about"):
        return None
    try:
        about = json.loads("".join(r[0] for r in spark.read.text(f"{path}/about").limit(2).collect()))
    except ValueError:
        return None
    return about if about.get("kind") == KIND else None


def load_stored(spark: SparkSession, path: str, variant: str | None = None) -> Model:
    about = recognise(spark, path)
    if about is None:
        raise FormatError(f"{path} holds no stored model")
    if about["version"] != VERSION:
        raise VersionError(f"{path} has version {about['version']}, this library reads {VERSION}")
    if variant and about["variant"] != variant:
        raise FormatError(f"{path} holds a {about['variant']} model, not {variant}")
    rows = spark.read.parquet(f"{path}/entries").withColumn("n", F.col("n").cast("int"))
    if about["variant"].startswith("quant"):
        rows = quantize.decode(rows, spark.read.parquet(f"{path}/centres"))
        rows = rows.withColumn("prob", F.when(F.col("is_blank"), F.lit(0.0).cast("float")).otherwise(F.col("prob"))) if about["semantics"] == "reference" else rows
    columns = ["n", "ngram", "prob", "backoff", "extends_right", "independent_left", "is_blank"]
    config = ModelConfig(semantics=about["semantics"], variant=about["variant"], prob_bits=about["prob_bits"], backoff_bits=about["backoff_bits"])
    return Model(rows.select(*columns), about["order"], config, about["complete"], about["flat"], about["unk_inside"])


def load_model(spark: SparkSession, path: str, config: ModelConfig = ModelConfig()) -> Model:
    """A stored model, or else model text."""
    return load_stored(spark, path) if recognise(spark, path) else load_arpa(spark, path, config)


def stored_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vocab")


def header(spark: SparkSession, path: str) -> dict:
    """What the note says, with the bytes of the model's files."""
    about = recognise(spark, path)
    if about is None:
        raise FormatError(f"{path} holds no stored model")
    return about | {"bytes": stored_bytes(spark, path)}


def stored_bytes(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
