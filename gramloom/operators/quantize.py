"""Quantisation of log probabilities and backoffs to a table of centres for each order above 1.

Bin i of B holds the sorted values at places floor(N i / B) up to floor(N (i + 1) / B), its centre is their mean; an empty
bin repeats the one before. Places come from a sort by all tasks, so no task sees all values of an order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramloom.errors import ConfigError
from gramloom.storage import ranked, scratch, small

#: Bits up to which the tables of all orders are sent to all tasks (4 bytes a centre).
TABLE_BITS = 16


def check_bits(bits: int) -> int:
    if not 1 <= bits <= 25:
        raise ConfigError(f"bits must be 1 to 25, not {bits}")
    return bits


#: Different values whose counts one task sums up.
SPAN = 100_000


def bins(values: DataFrame, n_bins: int, value: str = "value") -> DataFrame:
    """n, bin, centre of values(n, value); only bins that hold a value are listed. Equal values are sorted as one, with their count."""
    counts = values.where(F.col(value).isNotNull()).groupBy("n", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("__k"))
    placed = ranked(counts, [F.col("n"), F.col("v")], "__place").withColumn("__span", F.floor(F.col("__place") / SPAN))
    spans = scratch(placed.groupBy("n", "__span").agg(F.sum("__k").alias("__sum")), "spans")  # a row for SPAN values
    w = Window.partitionBy("n")
    before = F.coalesce(F.sum("__sum").over(w.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("n", "__span", before.alias("__before"), F.sum("__sum").over(w).alias("__n"))
    within = Window.partitionBy("n", "__span").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn("__end", F.sum("__k").over(within)).join(small(spans), ["n", "__span"]).withColumn("__end", F.col("__before") + F.col("__end"))
    found = found.withColumn("__start", F.col("__end") - F.col("__k"))
    at = lambda row: F.floor(((row + 1) * n_bins + F.col("__n") - 1) / F.col("__n")) - 1
    found = found.withColumn("__bin", F.explode(F.sequence(at(F.col("__start")), at(F.col("__end") - 1))))
    edge = lambda k: F.floor(k * F.col("__n") / n_bins)
    share = F.least("__end", edge(F.col("__bin") + 1)) - F.greatest("__start", edge(F.col("__bin")))
    found = found.select("n", F.col("__bin").cast("int").alias("bin"), "v", share.alias("__share")).where("__share > 0")
    return found.groupBy("n", "bin").agg((F.sum(F.col("v").cast("double") * F.col("__share")) / F.sum("__share")).cast("float").alias("centre"))


def full_table(found: DataFrame, n_bins: int, reserved: int = 0) -> DataFrame:
    """n, code, centre for every bin; reserved codes (0: no extension, 1: unused) come first, an empty bin repeats the last one."""
    orders = found.select("n").distinct()
    every = orders.select("n", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    w = Window.partitionBy("n").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = every.join(found, ["n", "bin"], "left").withColumn("centre", F.coalesce(F.last("centre", ignorenulls=True).over(w), F.lit(float("-inf")).cast("float")))
    rows = rows.select("n", (F.col("bin") + reserved).alias("code"), "centre")
    if reserved:
        fixed = orders.select("n", F.explode(F.array(F.struct(F.lit(0).alias("code"), F.lit(0.0).cast("float").alias("centre")), F.struct(F.lit(1).alias("code"), F.lit(float("-inf")).cast("float").alias("centre")))).alias("x")).select("n", "x.*")
        rows = fixed.unionByName(rows)
    return rows


def train(rows: DataFrame, order: int, prob_bits: int = 8, backoff_bits: int = 8) -> DataFrame:
    """n, kind ("prob" or "backoff"), code, centre of a model's rows(n, prob, backoff), single words left out."""
    check_bits(prob_bits), check_bits(backoff_bits)
    if backoff_bits < 2:
        raise ConfigError("backoffs need two bits at least: two codes are reserved")
    longer = rows.where("n > 1")
    probs = full_table(bins(longer.select("n", F.col("prob").alias("value")), 1 << prob_bits), 1 << prob_bits).withColumn("kind", F.lit("prob"))
    inner = longer.where(F.col("n") < order)
    n_backoff = (1 << backoff_bits) - 2
    backoffs = full_table(bins(inner.select("n", F.coalesce("backoff", F.lit(0.0).cast("float")).alias("value")), n_backoff), n_backoff, reserved=2).withColumn("kind", F.lit("backoff"))
    return probs.unionByName(backoffs).select("n", "kind", "code", "centre")


def nearest(values: np.ndarray, centres: np.ndarray, reserved: int = 0) -> np.ndarray:
    """The code of the nearest centre from `reserved` on, in single precision; of two equally near the upper one."""
    values, centres = values.astype(np.float32), centres.astype(np.float32)
    at = np.searchsorted(centres[reserved:], values, "left") + reserved
    inside = np.clip(at, reserved + 1, len(centres) - 1) if len(centres) > reserved + 1 else np.full(len(values), reserved)
    with np.errstate(invalid="ignore"):
        lower = values - centres[np.maximum(inside - 1, 0)] < centres[inside] - values
    code = np.where(lower, inside - 1, inside)
    return np.where(at == reserved, reserved, np.where(at >= len(centres), len(centres) - 1, code)).astype(np.int32)


def encode(rows: DataFrame, tables: DataFrame, prob_bits: int = 8, backoff_bits: int = 8) -> DataFrame:
    """rows with prob_code and backoff_code (null for single words, and no backoff_code at the highest order)."""
    if max(prob_bits, backoff_bits) > TABLE_BITS:
        raise ConfigError(f"tables of over {TABLE_BITS} bits aren't sent to the tasks")
    held = {}
    for n, kind, code, centre in tables.orderBy("n", "kind", "code").collect():  # at most 2 ** TABLE_BITS rows for each order and kind
        held.setdefault((n, kind), []).append(centre)
    held = {k: np.array(v, np.float32) for k, v in held.items()}
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", prob_code int, backoff_code int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prob, back = pd.Series(pd.NA, pdf.index, dtype="Int32"), pd.Series(pd.NA, pdf.index, dtype="Int32")
            for n, part in pdf.groupby("n"):
                if (n, "prob") in held:
                    prob[part.index] = nearest(part["prob"].to_numpy(), held[n, "prob"])
                if (n, "backoff") in held:
                    b = part["backoff"].fillna(0.0).to_numpy(np.float32)
                    back[part.index] = np.where(b == 0, 0, nearest(b, held[n, "backoff"], 2))
            yield pdf.assign(prob_code=prob, backoff_code=back)

    return rows.mapInPandas(run, schema)


def decode(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """rows whose prob and backoff are their codes' centres; single words stay as they are."""
    side = lambda kind: tables.where(F.col("kind") == kind).select("n", F.col("code").alias(f"{kind}_code"), F.col("centre").alias(f"__{kind}"))
    found = rows.join(small(side("prob")), ["n", "prob_code"], "left").join(small(side("backoff")), ["n", "backoff_code"], "left")
    found = found.withColumn("prob", F.coalesce("__prob", "prob")).withColumn("backoff", F.coalesce("__backoff", "backoff"))
    return found.select(*rows.columns)


def packed(prob_code: Column, backoff_code: Column, backoff_bits: int = 8) -> Column:
    """Both codes in one whole number."""
    return F.shiftleft(prob_code.cast("long"), backoff_bits).bitwiseOR(F.coalesce(backoff_code, F.lit(0)).cast("long"))


def table_bytes(order: int, prob_bits: int = 8, backoff_bits: int = 8) -> int:
    """Bytes of the tables of all orders."""
    longest = (1 << prob_bits) * 4
    return (order - 2) * ((1 << backoff_bits) * 4 + longest) + longest + 8


def quantised_rows(rows: DataFrame, order: int, prob_bits: int = 8, backoff_bits: int = 8) -> DataFrame:
    tables = train(rows, order, prob_bits, backoff_bits)
    return decode(encode(rows, tables, prob_bits, backoff_bits), tables).drop("prob_code", "backoff_code")
