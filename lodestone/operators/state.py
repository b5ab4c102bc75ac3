"""State kept between runs: snapshots, versions, mappings, coverage and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, sig: str) -> DataFrame:
    """added, removed and changed keys. A signature is `size:mtime`; where the old one has no
    mtime (`size:`), sizes alone are compared."""
    a = old.select(key, F.col(sig).alias("before"))
    b = new.select(key, F.col(sig).alias("after"))
    sized = F.col("before").endswith(":")
    differs = F.when(sized, F.split_part("before", F.lit(":"), F.lit(1)) != F.split_part("after", F.lit(":"), F.lit(1))).otherwise(F.col("before") != F.col("after"))
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(differs, "changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status")).where("status is not null")


def compare_inventories(ours: DataFrame, theirs: DataFrame, key: str, codes: str) -> DataFrame:
    """ours_only, theirs_only and differs of two lists of files with their sets of codes."""
    a, b = ours.select(key, F.sort_array(codes).alias("a")), theirs.select(key, F.sort_array(codes).alias("b"))
    status = F.when(F.col("b").isNull(), "ours_only").when(F.col("a").isNull(), "theirs_only").when(F.col("a") != F.col("b"), "differs")
    return a.join(b, key, "full_outer").select(key, status.alias("status")).where("status is not null")


def latest(rows: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """The latest version of each key: highest in `order`, which makes the choice unique."""
    keys = [key] if isinstance(key, str) else key
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("x"))
    return best.select(*keys, *[f"x.{c}" for c in others])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and old ones whose key has no new row."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def remap(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Replace values by mapping (old, new) in one step, so that swaps are safe."""
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return rows.join(m, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def moved_by_unique_name(old: DataFrame, new: DataFrame, name: str, code: str) -> DataFrame:
    """Names that occur once in either version under different codes: name, old, new."""
    one = lambda d, alias: d.groupBy(name).agg(F.count("*").alias("n"), F.min(code).alias(alias)).where("n = 1").select(name, alias)
    return one(old, "old").join(one(new, "new"), name).where("old != new")


def upper_median(values: Column) -> Column:
    """The upper middle of an array in order."""
    s = F.sort_array(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def upper_medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The upper middle value of each key, from counts per value and their running sums: groups of any size are
    reduced to their distinct values before they meet."""
    n = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    total = n.groupBy(key).agg(F.sum("n").alias("total"))
    below = F.sum("n").over(Window.partitionBy(key).orderBy(value))
    return n.withColumn("below", below).join(total, key).where(F.col("below") > F.floor(F.col("total") / 2)).groupBy(key).agg(F.min(value).alias("middle"))


def usual(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, ties by value."""
    n = rows.groupBy(*key, value).agg(F.count("*").alias("n"))
    return n.groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("x")).select(*key, F.col("x.v").alias(value), (-F.col("x.n")).alias("n"))


def even_sample(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """At most `most` rows of each key, evenly spread over their order."""
    w = Window.partitionBy(key)
    ranked = rows.withColumns({"_k": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    step = F.greatest(F.lit(1.0), F.col("_n") / most)
    # row k is taken if it is the first at or after a multiple of the step
    return ranked.where(F.floor(F.col("_k") / step) != F.floor((F.col("_k") - 1) / step)).drop("_k", "_n")


def coverage(wanted: DataFrame, before: DataFrame, after: DataFrame, key: str, code: str) -> DataFrame:
    """Per key: sorted codes now, after, lost, gained, missing and doubled."""
    w = wanted.groupBy(key).agg(F.collect_set(code).alias("want"))
    b = before.groupBy(key).agg(F.collect_set(code).alias("now"))
    a = after.groupBy(key).agg(F.collect_list(code).alias("all"))
    rows = w.join(b, key, "left").join(a, key, "left")
    nothing = F.array().cast(rows.schema["want"].dataType)
    now, every = F.coalesce("now", nothing), F.coalesce("all", nothing)
    then = F.array_distinct(every)
    twice = F.filter(then, lambda x: F.size(F.array_remove(every, x)) < F.size(every) - 1)
    s = F.sort_array
    return rows.select(key, s(now).alias("now"), s(then).alias("after"), s(F.array_except(now, then)).alias("lost"), s(F.array_except(then, now)).alias("gained"), s(F.array_except("want", then)).alias("missing"), s(twice).alias("doubled"))


def integrity_verdict(duration: Column, decoded: Column, errors: Column, audio: Column, video: Column, start_gap: Column) -> Column:
    """bad: cut short or five errors; warn: any error, or streams of different lengths or starts; else ok."""
    short = decoded < duration - F.greatest(F.lit(10.0), 0.03 * duration)
    apart = F.abs(audio - video) > F.greatest(F.lit(3.0), 0.02 * duration)
    return F.when(short | (errors >= 5), "bad").when((errors > 0) | apart | (start_gap > 1), "warn").otherwise("ok")


def spaced(times: Column, gap: float) -> Column:
    """Times in order without those less than `gap` after the last one that is kept."""
    nothing = F.slice(times, 1, 0)
    first = F.struct(F.get(nothing, F.lit(0)).alias("last"), nothing.alias("kept"))
    add = lambda a, t: F.struct(t.alias("last"), F.array_append(a["kept"], t).alias("kept"))
    return F.aggregate(F.sort_array(times), first, lambda a, t: F.when(a["last"].isNull() | (t - a["last"] >= gap), add(a, t)).otherwise(a), lambda a: a["kept"])
