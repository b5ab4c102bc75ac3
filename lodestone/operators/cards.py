"""Titles read off frames: readings, grouping, thinning, and how they settle segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .titleindex import readings as readings


def grouped(reads: DataFrame, key: str, gap: float = 12.0) -> DataFrame:
    """Readings (t, codes, score) of a file in groups: one that comes at most `gap` after the one before
    and shares a code with it belongs to its group; each group keeps its best reading."""
    order = Window.partitionBy(key).orderBy("t")
    near = (F.col("t") - F.lag("t").over(order) <= gap) & F.arrays_overlap("codes", F.lag("codes").over(order))
    marked = reads.withColumn("_new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("card", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "card").agg(F.min("t").alias("time"), F.max("t").alias("last"), F.count("*").alias("frames"), F.max_by("codes", F.struct("score", -F.col("t"))).alias("codes"), F.max("score").alias("score"))


def thinned(cards: DataFrame, key: str, span: float = 120.0) -> DataFrame:
    """Best card first, others within `span` seconds of a kept one are dropped; of equal scores the earlier one is
    better. What is kept depends on what was kept before, so it is a fold over a file's cards from the best on,
    each looking at the neighbours in time that are kept so far."""
    names = [c for c in cards.columns if c != key]
    order = F.struct((-F.col("score")).alias("_a"), F.col("time").alias("_b"), F.struct(*names).alias("_c"))
    listed = cards.groupBy(key).agg(F.sort_array(F.collect_list(order)).alias("_x"))
    kept = F.aggregate("_x", F.slice("_x", 1, 0), lambda a, c: F.when(F.forall(a, lambda k: F.abs(k["_b"] - c["_b"]) >= span), F.array_append(a, c)).otherwise(a))
    return listed.select(key, F.explode(kept).alias("_k")).select(*[F.col(key) if c == key else F.col(f"_k._c.{c}") for c in cards.columns])


def fits(expected: Column, candidates: Column) -> Column:
    """A card fits names that say nothing, or that hold any of its candidates."""
    return (F.size(expected) == 0) | F.arrays_overlap(expected, candidates)


def resolve_partial(confident: Column, named: Column, weak: Column, candidates: Column) -> Column:
    """The candidate that confident dialogue, else the file name, else weaker dialogue already has."""
    first = lambda c: F.get(F.array_intersect(c, candidates), F.lit(0))
    return F.coalesce(first(confident), first(named), first(weak))


def absorbed(segments: DataFrame, key: str, runtime: float, limit: float = 1.4) -> DataFrame:
    """Weak segments behind a card-confirmed one fold into it while it stays within 1.4 runtimes: a fold over
    a file's segments in order, since each step depends on how far the last one has grown. The fold
    carries the segment that is growing and puts it out when the next one starts."""
    rows = segments.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "code", "card", "weak"))).alias("x"))
    plain = lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "code", "card", "weak")])

    def step(a: Column, s: Column) -> Column:
        last = a["last"]
        folds = s["weak"] & last["card"] & (s["end"] - last["start"] <= limit * runtime)
        grown = F.struct(last["start"].alias("start"), s["end"].alias("end"), last["code"].alias("code"), F.lit(True).alias("card"), F.lit(False).alias("weak"))
        return F.when(folds, F.struct(grown.alias("last"), a["out"].alias("out"))).otherwise(F.struct(plain(s).alias("last"), F.array_append(a["out"], last).alias("out")))

    first = F.struct(plain(F.get("x", F.lit(0))).alias("last"), F.slice("x", 1, 0).alias("out"))
    joined = F.aggregate(F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0))), first, step, lambda a: F.array_append(a["out"], a["last"]))
    return rows.select(key, F.explode(joined).alias("s")).select(key, "s.start", "s.end", "s.code", "s.card")
