"""Hopping windows over timed text, and joins of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_count(end: Column, size: float, hop: float) -> Column:
    return F.ceil(F.greatest(end - size / 2, F.lit(hop)) / hop)


def cue_windows(cues: DataFrame, key: str, size: float = 90.0, hop: float = 45.0, duration: str | None = None) -> DataFrame:
    """A row per cue and window that it overlaps strictly. A file's windows start every `hop`
    seconds from 0 up to its end less half a window; the end of the last cue counts as the file's end
    if it is later. The windows of a cue are computed, not searched, so there is no interval join."""
    end = F.max("end") if duration is None else F.greatest(F.max("end"), F.max(duration))
    ends = cues.groupBy(key).agg(end.alias("file_end"))
    rows = cues.join(ends, key)
    low = F.greatest(F.lit(0), F.floor((F.col("start") - size) / hop) + 1).cast("long")
    high = F.least(window_count(F.col("file_end"), size, hop) - 1, F.ceil(F.col("end") / hop) - 1).cast("long")
    rows = rows.withColumns({"low": low, "high": high}).where("low <= high")
    rows = rows.withColumn("win", F.explode(F.sequence("low", "high"))).drop("low", "high")
    return rows.withColumns({"win_start": F.col("win") * hop, "win_end": F.least(F.col("win") * hop + size, F.col("file_end"))})


def window_words(windows: DataFrame, key: str, min_words: int = 8) -> DataFrame:
    """Text in order and number of words of each window; windows of fewer than min_words are silent."""
    held = windows.groupBy(key, "win", "win_start", "win_end").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("x"))
    text = F.array_join(F.transform("x", lambda y: y["text"]), " ")
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")
    return held.select(key, "win", "win_start", "win_end", text.alias("text"), words.alias("words"), (words < min_words).alias("silent"))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, start: str) -> DataFrame:
    """Each row of left with the latest `start` of right at or before its time: one shuffle by key,
    the rows of both sides in time order, the last start carried forward."""
    from pyspark.sql.window import Window

    names = [c for c in left.columns if c not in (key, time)]
    both = left.select(key, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*names, F.lit(True).alias("_row")).alias("_x"), F.lit(None).cast(left.schema[time].dataType).alias("_s"))
    other = right.select(key, F.col(start).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_x"].dataType).alias("_x"), F.col(start).alias("_s"))
    order = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    joined = both.unionByName(other).withColumn("as_of_start", F.last("_s", ignorenulls=True).over(order)).where("_side = 1")
    return joined.select(key, F.col("_t").alias(time), *[f"_x.{c}" for c in names], "as_of_start")


def within(points: DataFrame, spans: DataFrame, key: str, time: str, before: float, after: float, bucket: float = 3600.0) -> DataFrame:
    """Each point with the last span (by index) whose tolerated range holds it: spans are put into
    time buckets, so this is an equality join on key and bucket."""
    lo, hi = F.floor((F.col("start") - before) / bucket), F.floor((F.col("end") + after) / bucket)
    wide = spans.withColumn("_bucket", F.explode(F.sequence(lo, hi)))
    near = points.withColumn("_bucket", F.floor(F.col(time) / bucket))
    hit = near.join(wide, [key, "_bucket"]).where((F.col(time) >= F.col("start") - before) & (F.col(time) <= F.col("end") + after))
    return hit.groupBy(key, *[c for c in points.columns if c != key]).agg(F.max("index").alias("index"))


def expected_at(expected: Column, time: Column, duration: Column) -> Column:
    """Which of the named episodes a time belongs to if they share the file evenly."""
    n = F.size(expected)
    return F.get(expected, F.least(n - 1, F.greatest(F.lit(0), F.floor(time / (duration / n)).cast("int"))))


def merge_intervals(spans: DataFrame, key: str, gap: float) -> DataFrame:
    """Unions of spans (start, end) with gaps of at most `gap`."""
    from pyspark.sql.window import Window

    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.coalesce(F.col("start") > reach + gap, F.lit(True)).cast("int"))
    marked = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_island")
