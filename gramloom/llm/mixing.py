"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

A source's target is min(cap, level * weight), where the level makes the targets add up to the budget: the fixed point of
clamping sources at their cap and resharing the excess by weight. A source is then taken floor(target / size) whole times,
and for the rest the documents that come first in a seeded order, up to the one that brings the sum nearest to the target.
That cut is found through two histograms of the order's hash (4096 cells each), so that no window sees more of a source
than its documents in one of 16 million cells, and there rows of one id and size as one.

Defined cases: a null text has size 0; null is a source, the last one; rows with equal ids are ordered by size, then by
their place in the table, and each is taken on its own; a source of size 0 has target 0; an empty table gives an empty
result; other columns aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramloom.llm.common import bounded_batches, maybe_broadcast, scratch

WORD = "[^\\x20\\x09-\\x0D]+"
#: One histogram level has 16 ** CELL_HEX cells.
CELL_HEX = 3


def n_words(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: float, epochs: float) -> DataFrame:
    """sources(source, size, weight) with target: the level is found where sources, by the level at which they fill up, stop being full.

    The window orders the sources, not the documents: a table of one row per source.
    """
    s = sources.withColumn("cap", F.col("size") * F.lit(epochs)).withColumn("full_at", F.col("cap") / F.col("weight"))
    by = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(by), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(by), F.lit(0.0)))
    level = (F.sum("size").over(every) * F.lit(budget) - F.col("cap_before")) / (F.sum("weight").over(every) - F.col("weight_before"))
    s = s.withColumn("level", F.when(level <= F.col("full_at"), level))
    # The first source that doesn't fill up has the highest of these levels (those after it fall); null: all are full.
    s = s.withColumn("level", F.max("level").over(every))
    return s.select("source", F.col("size").alias("source_size"), F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken. how: see planned()."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"))
    rows = scratch(rows.withColumn("uid", F.monotonically_increasing_id()), "mix-rows")
    return planned(rows, **how).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as the mix takes it (none, once or more); a row without words is never taken."""
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"))
    wide = scratch(wide.withColumn("uid", F.monotonically_increasing_id()), "mix-whole")  # from here on a row can be told from all others
    taken = planned(wide, **how).where("size > 0 and times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def planned(rows: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, epochs: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """rows(doc_id, source, size, uid), stored ones, with source_size, target and times (how often a row is taken).

    weights are dealt to the sources in code-point order, again and again; budget: share of all sizes to take; epochs:
    the most repetitions of a source. uid is a row's place, of monotonically_increasing_id().
    """
    bounded_batches(rows.sparkSession)
    rows = rows.withColumn("h", F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    narrow = rows.select("doc_id", "source", "size", "uid", "h")
    sized = narrow.groupBy("source").agg(F.sum("size").alias("size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    sized = sized.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    plan = water_fill(sized, budget, epochs).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = scratch(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "s"), "mix-plan")
    place_in = lambda r, p, more=F.lit(True): r.join(maybe_broadcast(p), r["source"].eqNullSafe(p["s"]) & more)

    def cell(level: int) -> Column:
        return F.substring("h", 1 + CELL_HEX * level, CELL_HEX)

    def cut(inside: DataFrame, level: int) -> DataFrame:
        """Of each source the cell in which the rest runs out, and what the cells before it hold."""
        sums = inside.groupBy("s", "rest", "before", cell(level).alias("cell")).agg(F.sum("size").alias("n"))
        run = F.sum("n").over(Window.partitionBy("s").orderBy("cell")) + F.col("before")
        sums = sums.select("s", "cell", "rest", (run - F.col("n")).alias("start"), run.alias("stop"))
        return sums.where("start <= rest and rest < stop").select("s", F.col("cell").alias(f"cell{level}"), F.col("start").alias(f"before{level}"))

    first = scratch(cut(place_in(narrow, plan).withColumn("before", F.lit(0).cast("long")), 0), "mix-cells")
    inner = plan.join(first.withColumnRenamed("s", "s0"), F.col("s").eqNullSafe(F.col("s0"))).drop("s0")
    inside = place_in(narrow, inner, F.substring(narrow["h"], 1, CELL_HEX) == inner["cell0"]).withColumn("before", F.col("before0"))
    second = scratch(cut(inside, 1), "mix-cells")
    inner = inner.join(second.withColumnRenamed("s", "s1"), F.col("s").eqNullSafe(F.col("s1"))).drop("s1")
    last = place_in(narrow, inner, (F.substring(narrow["h"], 1, CELL_HEX) == inner["cell0"]) & (F.substring(narrow["h"], 1 + CELL_HEX, CELL_HEX) == inner["cell1"]))
    # Rows of one id and size are one step of n equal ones, of which the first k are within the rest; the last step with any is the end.
    steps = last.groupBy("s", "rest", "before1", "cell0", "cell1", "h", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("s").orderBy("h", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("size") * F.col("n")).over(order) + F.col("before1") - F.col("size") * F.col("n")
    steps = steps.withColumn("k", F.when(F.col("size") > 0, F.greatest(F.least(F.floor((F.col("rest") - start) / F.col("size") + 0.5), F.col("n")), F.lit(0))).otherwise(F.lit(0)))
    key = F.struct("h", F.col("doc_id").isNull().alias("no_id"), "doc_id", "size")
    ends = steps.groupBy("s").agg(F.first(F.concat("cell0", "cell1")).alias("cells"), F.max(F.when(F.col("k") > 0, F.struct(key.alias("key"), "k", "n"))).alias("end"))
    ends = scratch(ends.select("s", "cells", F.col("end.key").alias("end"), F.col("end.k").alias("k"), F.col("end.n").alias("n")), "mix-ends")
    ends = ends.join(_kth(narrow, ends).withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2")
    plan = scratch(plan.join(ends.withColumnRenamed("s", "e"), F.col("s").eqNullSafe(F.col("e")), "left").drop("e"), "mix-cuts")
    out = rows.join(maybe_broadcast(plan), rows["source"].eqNullSafe(plan["s"]))
    here = F.struct(F.col("h"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("size"))
    at_end = (here == F.col("end")) & (F.col("last_uid").isNull() | (F.col("uid") <= F.col("last_uid")))
    more = (F.substring("h", 1, 2 * CELL_HEX) < F.col("cells")) | (F.col("end").isNotNull() & ((here < F.col("end")) | at_end))
    return out.withColumn("times", F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")).select(*rows.columns, "source_size", "target", "times")


def _kth(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """s, last_uid: the place of the k-th of the n rows that are equal at a source's end, where k < n.

    Counts by the partition in which rows were written come first, so that only one such partition's rows are numbered.
    """
    some = ends.where("k < n")
    key = F.struct(rows["h"], rows["doc_id"].isNull().alias("no_id"), rows["doc_id"], rows["size"])
    equal = rows.join(maybe_broadcast(some), rows["source"].eqNullSafe(some["s"]) & (key == some["end"])).select("s", "uid", "k", F.shiftright("uid", 33).alias("part"))
    parts = equal.groupBy("s", "k", "part").agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("n").over(Window.partitionBy("s").orderBy("part"))
    parts = parts.withColumn("before", run - F.col("n")).where("before < k and k <= before + n").select(F.col("s").alias("s3"), F.col("part").alias("part3"), (F.col("k") - F.col("before")).alias("j"))
    found = equal.join(maybe_broadcast(scratch(parts, "mix-parts")), F.col("s").eqNullSafe(F.col("s3")) & (F.col("part") == F.col("part3")))
    numbered = found.withColumn("place", F.row_number().over(Window.partitionBy("s").orderBy("uid")))
    return numbered.where("place = j").select("s", F.col("uid").alias("last_uid"))
