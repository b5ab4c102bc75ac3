"""Decoding of the best label sequence, and its collapse into segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def viterbi(emissions: Column, switch: float) -> Column:
    """The best state (from 0) at each step of array<array<double>>: staying is free, a switch costs
    `switch` and is made only if it is strictly better; the first of equal states wins. A fold
    forward keeps scores and back-pointers, a fold backward walks them."""
    first = F.struct(F.get(emissions, F.lit(0)).alias("s"), F.array().cast("array<array<int>>").alias("b"))

    def step(a: Column, x: Column) -> Column:
        best = F.array_max(a["s"]) - switch
        state = F.array_position(a["s"], F.array_max(a["s"])).cast("int") - 1
        return F.struct(
            F.transform(x, lambda v, i: F.greatest(F.get(a["s"], i), best) + v).alias("s"),
            F.array_append(a["b"], F.transform(x, lambda v, i: F.when(best > F.get(a["s"], i), state).otherwise(i))).alias("b"),
        )

    done = F.aggregate(F.slice(emissions, F.lit(2), F.greatest(F.size(emissions) - 1, F.lit(0))), first, step)
    start = lambda d: F.array(F.array_position(d["s"], F.array_max(d["s"])).cast("int") - 1)
    walk = F.transform(F.array(done), lambda d: F.aggregate(F.reverse(d["b"]), start(d), lambda p, b: F.array_prepend(p, F.get(b, F.get(p, F.lit(0))))))
    return F.when(F.size(emissions) > 0, F.get(walk, F.lit(0)))


def runs(labels: DataFrame, key: str, order: str, label: str, start: str, end: str, score: str) -> DataFrame:
    """Neighbouring rows of one label as a run, with its best score."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.coalesce(F.col(label) != F.lag(label).over(w), F.lit(True)).cast("int")
    marked = labels.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_run", label).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.max(score).alias("score"), F.count("*").alias("n")).withColumnRenamed("_run", "run")


def split_overlaps(rows: DataFrame, key: str) -> DataFrame:
    """Where neighbouring runs overlap, both end at the middle of the overlap."""
    w = Window.partitionBy(key).orderBy("run")
    before, after = F.lag("end").over(w), F.lead("start").over(w)
    start = F.when(before > F.col("start"), (before + F.col("start")) / 2).otherwise(F.col("start"))
    end = F.when(after < F.col("end"), (after + F.col("end")) / 2).otherwise(F.col("end"))
    return rows.withColumns({"start": start, "end": end})


def surviving(rows: DataFrame, key: str, label: str, none: str, min_seconds: float, min_share: float, total: str) -> DataFrame:
    """Runs of a label that last long enough or take a large enough share of their file; neighbours
    of one label that a dropped run parted are one run again, with the best score."""
    long = (F.col("end") - F.col("start") >= min_seconds) | (F.col("end") - F.col("start") >= min_share * F.col(total))
    kept = rows.where((F.col(label) != none) & long)
    return runs(kept, key, "run", label, "start", "end", "score")
