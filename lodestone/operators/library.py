"""Views of a library: files against episodes, history, orders of lists, places where episodes start or can be cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def matched_history(grabs: DataFrame, history: DataFrame, slack: float = 3600.0) -> DataFrame:
    """grab and download of each grab (grab, norm, episode, at): the history's entry (download, norm, episode, at)
    of its episode not more than `slack` seconds before it that has its name, else the first that no
    other grab has by its name."""
    near = grabs.join(history.withColumnsRenamed({"norm": "h_norm", "at": "h_at"}), "episode").where(F.col("h_at") >= F.col("at") - slack)
    named = near.where("h_norm = norm").groupBy("grab").agg(F.min_by("download", F.struct("h_at", "download")).alias("named"))
    free = near.join(named.select(F.col("named").alias("download")).distinct(), "download", "left_anti")
    first = free.groupBy("grab").agg(F.min_by("download", F.struct("h_at", "download")).alias("first"))
    return grabs.select("grab").join(named, "grab", "left").join(first, "grab", "left").select("grab", F.coalesce("named", "first").alias("download"))


def carried(new: DataFrame, old: DataFrame, key: Sequence[str], same: str, value: str) -> DataFrame:
    """New rows with the old ones' value where key and `same` haven't changed and the new ones have none."""
    before = old.select(*key, F.col(same).alias("_same"), F.col(value).alias("_value"))
    kept = F.when(F.col(same).eqNullSafe(F.col("_same")), F.col("_value"))
    return new.join(before, list(key), "left").withColumn(value, F.coalesce(kept, value)).drop("_same", "_value")


def holds(sure: Column, named: Column) -> Column:
    """What a file holds: the codes that are sure, else those of its name."""
    return F.when(F.size(sure) > 0, sure).otherwise(named)


def subtitle_pick(found: DataFrame, key: str) -> DataFrame:
    """The best subtitle of each key: title or name fits, name fits, not for the deaf, most downloads; those whose
    name is another episode's are out, as are machine-made ones (`usable`)."""
    order = F.struct((F.col("title_fits") | (F.col("named") == "match")).alias("a"), (F.col("named") == "match").alias("b"), (~F.col("hearing_impaired")).alias("c"), F.col("downloads").alias("d"), (-F.col("id")).alias("e"))
    return found.where("usable and named != 'other'").groupBy(key).agg(F.max_by("id", order).alias("id"))


def dashboard(series: DataFrame, episodes: DataFrame, references: DataFrame, checks: DataFrame, requests: DataFrame) -> DataFrame:
    """A row per series: regular episodes, those with a reference, bad and warned files, open requests."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    regular = episodes.where("season > 0").join(references.select("series", "season", "episode").distinct().withColumn("_ref", F.lit(1)), ["series", "season", "episode"], "left")
    eps = regular.groupBy("series").agg(F.count("*").alias("episodes"), F.count("_ref").alias("with_reference"))
    files = checks.groupBy("series").agg(F.count_if(F.col("status") == "bad").alias("bad"), F.count_if(F.col("status") == "warn").alias("warn"))
    asked = requests.groupBy("series").agg(F.count_if(~F.col("over")).alias("open"))
    out = series.select("series")
    for part in (eps, files, asked):
        out = out.join(part, "series", "left")
    return out.select("series", *map(n, ("episodes", "with_reference", "bad", "warn", "open")))


def job_order() -> list[Column]:
    """Running jobs first, then the latest."""
    return [F.desc(F.col("status") == "running"), F.desc("id")]


def catalogue_order() -> list[Column]:
    """Specials last."""
    return [F.col("season") == 0, F.col("season"), F.col("episode")]


def tail(rows: DataFrame, key: str, order: str, last: int) -> DataFrame:
    """The last rows of each key, numbered from 1 in order."""
    back = Window.partitionBy(key).orderBy(F.desc(order))
    few = rows.withColumn("_k", F.row_number().over(back)).where(F.col("_k") <= last)
    return few.withColumn("line", F.row_number().over(Window.partitionBy(key).orderBy(order))).drop("_k")


def probe_sample(episodes: DataFrame, series: str, per_season: int = 2, most: int = 6) -> DataFrame:
    """The first episodes of each season, so many of a series at most, in order."""
    one = Window.partitionBy(series, "season").orderBy("episode")
    every = Window.partitionBy(series).orderBy("season", "episode")
    few = episodes.where("season > 0").withColumn("_k", F.row_number().over(one)).where(F.col("_k") <= per_season)
    return few.withColumn("_k", F.row_number().over(every)).where(F.col("_k") <= most).drop("_k")


def spaced_from_start(times: Column, gap: float) -> Column:
    """Times in order, each at least `gap` after the one kept before it."""
    kept = F.aggregate(
        F.array_sort(times), F.struct(F.lit(None).cast("double").alias("last"), F.slice(times, 1, 0).alias("out")),
        lambda a, t: F.when(a["last"].isNull() | (t - a["last"] >= gap), F.struct(t.alias("last"), F.array_append(a["out"], t).alias("out"))).otherwise(a),
    )
    return kept["out"]


def episode_starts(duration: Column, segments: Column, runtime_minutes: Column, named: Column) -> Column:
    """Where the episodes of a file probably begin, for segments (start, end) in order: at 0, shortly before each
    change of segment, behind a gap of a minute or more, and where the named episodes would start if they
    shared the file; a long file with one segment may have a second half. Rounded to a tenth, 45 s apart."""
    later = F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0)))
    changes = F.transform(later, lambda s: s["start"] - 20)
    next_start = lambda i: F.coalesce(F.get(segments, i + 1)["start"], duration)
    gaps = F.filter(F.transform(segments, lambda s, i: F.when((next_start(i) - s["end"] >= 60) & (s["end"] < duration - 120), s["end"] - 20)), lambda x: x.isNotNull())
    shares = F.when((named > 1) & (duration > 0), F.transform(F.sequence(F.lit(1), F.greatest(named - 1, F.lit(1))), lambda k: duration * k / named - 90))
    half = F.when((F.size(segments) <= 1) & (duration > 1.6 * 60 * runtime_minutes), F.array(duration / 2 - 90))
    everything = F.concat(F.array(F.lit(0.0)), changes, gaps, F.coalesce(shares, half, F.array().cast("array<double>")))
    sane = F.transform(everything, lambda x: F.round(F.greatest(F.lit(0.0), x), 1))
    return spaced_from_start(F.filter(sane, lambda x: x < duration), 45.0)


def unmatched_runs(frames: DataFrame, key: str, gap: float = 2.5, near: float = 3.0, most: int = 3) -> DataFrame:
    """The longest runs of frames (t, big, hit) with big text and no full reading, none near a full one: start, end
    and rank, longest first."""
    order = Window.partitionBy(key).orderBy("t")
    around = Window.partitionBy(key).orderBy((F.col("t") * 1000).cast("long")).rangeBetween(int(-1000 * near), int(1000 * near))
    spots = frames.withColumn("_near", F.max((F.col("hit") == "full").cast("int")).over(around))
    spots = spots.where("big and coalesce(hit, '') != 'full' and coalesce(_near, 0) = 0")
    new = F.coalesce(F.col("t") - F.lag("t").over(order) > gap, F.lit(True)).cast("int")
    runs = spots.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(key, "_run").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("start") - F.col("end"), "start"))
    return runs.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "start", "end", "rank")


def cut_points(gaps: Column, keyframes: Column, before: Column, after: Column, most: int = 6) -> Column:
    """Places for a cut between two episodes, best first, from gaps (start, end, kind) and key frames: a long gap,
    black and silent at once, near the middle between what is said before and after. Each is moved to the key
    frame nearest to its middle, one inside the gap if there is one; places less than a second apart are one."""
    centre = (before + after) / 2
    points = lambda g: 2 * (g["end"] - g["start"]) + F.when(g["kind"] == "both", 1.5).otherwise(0.0) - F.abs((g["start"] + g["end"]) / 2 - centre) / 30
    nearest = lambda frames, t: F.array_min(F.transform(frames, lambda x: F.struct(F.abs(x - t).alias("d"), x.alias("x"))))["x"]

    def place(g: Column) -> Column:
        middle = (g["start"] + g["end"]) / 2
        inside = F.filter(keyframes, lambda x: (x >= g["start"] - 0.05) & (x <= g["end"] + 0.05))
        return F.round(F.coalesce(nearest(F.when(F.size(inside) > 0, inside).otherwise(keyframes), middle), middle), 3)

    ranked = F.transform(F.sort_array(F.transform(gaps, lambda g: F.struct((-points(g)).alias("p"), g["start"].alias("s"), place(g).alias("t")))), lambda x: x["t"])
    none = F.array().cast("array<double>")
    return F.aggregate(ranked, none, lambda kept, t: F.when((F.size(kept) < most) & ~F.exists(kept, lambda x: F.abs(x - t) < 1.0), F.array_append(kept, t)).otherwise(kept))


# ---- checks of files
def problem_list(messages: DataFrame, key: str, apart: float = 2.0, most: int = 40) -> DataFrame:
    """Per file the number of a decoder's complaints (t, level, message; those about damage) and the first `most`
    of them, a complaint that differs in its numbers only counting anew `apart` seconds after it was last kept."""
    text = F.left(F.regexp_replace(F.trim(F.regexp_replace("message", r"\s+", " ")), r" @ 0x[0-9a-f]+", ""), F.lit(200))
    rows = messages.select(key, "t", "level", text.alias("message")).withColumn("_mask", F.regexp_replace("message", r"\d+", "#"))
    same = rows.groupBy(key, "_mask").agg(F.sort_array(F.collect_list(F.struct("t", "message", "level"))).alias("x"), F.count("*").alias("n"))
    first = F.struct(F.lit(None).cast("double").alias("last"), F.slice("x", 1, 0).alias("out"))
    kept = F.aggregate("x", first, lambda a, x: F.when(a["last"].isNull() | (x["t"] - a["last"] >= apart), F.struct(x["t"].alias("last"), F.array_append(a["out"], x).alias("out"))).otherwise(a))["out"]
    found = same.select(key, "n", kept.alias("kept"))
    return found.groupBy(key).agg(F.sum("n").alias("errors"), F.slice(F.sort_array(F.flatten(F.collect_list("kept"))), 1, most).alias("problems"))


def summary(errors: Column, problems: Column, issues: Column) -> Column:
    """One line on a file: how many errors, the first four times, an example, and what else is wrong."""
    from ..functions.text import clock

    times = F.array_sort(F.array_distinct(F.transform(problems, lambda p: F.floor(p["t"]).cast("long"))))
    shown = F.array_join(F.transform(F.slice(times, 1, 4), lambda t: F.when(t >= 3600, clock(t, True)).otherwise(clock(t))), ", ")
    more = F.when(F.size(times) > 4, F.concat(F.lit(" (+"), (F.size(times) - 4).cast("string"), F.lit(" more)"))).otherwise("")
    where = F.when(F.size(times) > 0, F.concat(F.lit(" around "), shown, more)).otherwise("")
    example = F.get(problems, F.lit(0))["message"]
    eg = F.coalesce(F.when(example != "", F.concat(F.lit(" (e.g. "), example, F.lit(")"))), F.lit(""))
    decoding = F.when(errors > 0, F.array(F.concat(errors.cast("string"), F.when(errors == 1, " error").otherwise(" errors"), F.lit(" while decoding"), where, eg)))
    line = F.array_join(F.concat(F.coalesce(decoding, F.array().cast("array<string>")), issues), "; ")
    return F.when(line == "", "decodes cleanly").otherwise(line)


def checked_again(files: DataFrame, known: DataFrame, forced: DataFrame, key: str) -> DataFrame:
    """Which files a run has to check: those without a result for their content (key), and those asked for."""
    return files.join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left").join(forced.select("path").distinct().withColumn("_forced", F.lit(True)), "path", "left").where("_known is null or _forced").drop("_known", "_forced")
