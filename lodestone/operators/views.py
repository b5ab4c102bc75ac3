"""What is missing, what follows a file, what has room, what may be shown: small joins and rules with parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_title


def missing(wanted: DataFrame, have: DataFrame, key: str, *without: DataFrame) -> DataFrame:
    """Wanted keys that aren't there, nor in any of the other tables (known misses, blocked ones)."""
    out = wanted.select(key)
    for rows in (have, *without):
        out = out.join(rows.select(key), key, "left_anti")
    return out


def followed(files: DataFrame, results: DataFrame, key: str, path: str, value: str) -> DataFrame:
    """Results that follow files: by content (key), so that renamed files keep theirs; where the content has none, by
    path, if the result there is of a file whose content isn't known. The latest of several counts."""
    by_key = results.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias("_by_key"))
    by_path = results.where(F.col(key).isNull()).groupBy(path).agg(F.max(value).alias("_by_path"))
    rows = files.join(by_key, key, "left").join(by_path, path, "left")
    return rows.withColumn(value, F.coalesce("_by_key", "_by_path")).drop("_by_key", "_by_path").where(F.col(value).isNotNull())


def bucket_sums(files: DataFrame, *bucket: str | Column, size: str = "size") -> DataFrame:
    return files.groupBy(*bucket).agg(F.count("*").alias("files"), F.sum(size).cast("long").alias("bytes"))


def pruned(cache: DataFrame, live: DataFrame, key: str, roots: DataFrame | None = None) -> DataFrame:
    """What of a cache no file needs any more. roots (root, there): as long as one of them is missing nothing is given up,
    since its files may only be out of reach."""
    gone = cache.join(live.select(key).distinct(), key, "left_anti")
    if roots is None:
        return gone
    all_there = roots.agg(F.coalesce(F.bool_and(F.coalesce("there", F.lit(False))), F.lit(True)).alias("_there"))
    return gone.crossJoin(F.broadcast(all_there)).where("_there").drop("_there")  # one row


def too_little_room(needed: Column, free: Column, least: float, share: float) -> Column:
    """Would a copy of `needed` bytes leave less than a reserve, `least` or a share of the copy?"""
    return needed + F.greatest(F.lit(float(least)), share * needed) > free


def only_swaps(files: DataFrame, file: str, group: str, named: str, holds: str) -> DataFrame:
    """Pairs a < b of files of a group, each named for what the other one holds, where neither has another such partner."""
    a = files.select(F.col(file).alias("a"), group, F.col(named).alias("_x"), F.col(holds).alias("_y"))
    b = files.select(F.col(file).alias("b"), group, F.col(named).alias("_y"), F.col(holds).alias("_x"))
    only = a.join(b, [group, "_x", "_y"]).where("a != b").groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1").select("a", "b")
    return only.join(only.select(F.col("a").alias("b")), "b", "left_semi").where("a < b").select("a", "b")


def settled(frames: DataFrame, hits: DataFrame, key: str, time: str, delay: float, partial_delay: float | None = None) -> DataFrame:
    """Frames up to `delay` after their file's first hit, or `partial_delay` where there was only a partial one; all
    frames of files without a hit. hits: key, time and, with partial_delay, partial."""
    if partial_delay is None:
        until = hits.groupBy(key).agg((F.min(time) + delay).alias("_until"))
    else:
        full = F.min(F.when(~F.col("partial"), F.col(time))) + delay
        until = hits.groupBy(key).agg(F.coalesce(full, F.min(time) + partial_delay).alias("_until"))
    return frames.join(until, key, "left").where(F.col("_until").isNull() | (F.col(time) <= F.col("_until"))).drop("_until")


def pool(sources: Sequence[Column], claimed: Column, most: int = 12) -> Column:
    """Candidates of several sources in order, each once, those already claimed left out, the first of them."""
    return F.slice(F.filter(F.array_distinct(F.concat(*sources)), lambda x: ~F.array_contains(claimed, x)), 1, most)


def by_priority(key: str, value: str, *sources: tuple[str, DataFrame]) -> DataFrame:
    """The union of named sources, of each key the row of the first source that has it."""
    rows = None
    for k, (name, d) in enumerate(sources):
        own = d.select(key, F.struct(F.lit(k).alias("k"), F.lit(name).alias(value)).alias("x"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy(key).agg(F.min("x").alias("x")).select(key, F.col(f"x.{value}").alias(value))


def cache_key(*parts: str | Column) -> Column:
    return F.sha1(F.concat_ws("|", *parts))


def soft(reasons: Column, hard: str) -> Column:
    """Do none of the reasons for a rejection match `hard`?"""
    return ~F.exists(reasons, lambda x: x.rlike(hard))


def accepted(results: DataFrame, marks: DataFrame, key: str, status: str, good: str) -> DataFrame:
    """Results with those that a person has marked as fine as `good`, and what they were. A mark is tied to the
    file's content (key), so it follows renames and goes when the file is replaced."""
    rows = results.join(marks.select(key).distinct().withColumn("_marked", F.lit(True)), key, "left")
    changed = F.coalesce("_marked", F.lit(False)) & (F.col(status) != good)
    return rows.withColumn("was", F.when(changed, F.col(status))).withColumn(status, F.when(changed, good).otherwise(F.col(status))).drop("_marked")


def found_folders(folders: DataFrame, folder: str, search: str, most: int = 40) -> DataFrame:
    """Folders whose name has all words of a search, the best first: the same name, then those that begin with it."""
    words = search.lower().split()
    name = norm_title(F.col(folder))
    fit = F.forall(F.array(*map(F.lit, words)), lambda w: name.contains(w)) if words else F.lit(True)
    rank = F.when(name == " ".join(words), 0).when(name.startswith(" ".join(words)), 1).otherwise(2)
    return folders.where(fit).withColumn("rank", rank).orderBy("rank", folder, *[c for c in folders.columns if c != folder]).limit(most)


def layouts(files: DataFrame, path: str, depth: int) -> DataFrame:
    """Per show (the path's part number `depth`, from 1) whether it has season folders, and whether any video lies at
    its root."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(depth + 2), F.greatest(F.size(parts) - depth - 2, F.lit(0)))
    season = F.exists(folders, lambda x: F.lower(x).rlike(r"^season [0-9]+$"))
    return files.groupBy(F.get(parts, F.lit(depth)).alias("show")).agg(F.bool_or(season).alias("seasons"), F.bool_or(F.size(folders) == 0).alias("flat"))


def kept_frames(frames: DataFrame, key: str, time: str, values: str, least: float = 3.0) -> DataFrame:
    """Frames that differ from the last one kept by a mean of `least` or more: key and time. A fold in order of time,
    as each step depends on what was kept before."""
    rows = frames.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(values).alias("v")))).alias("x"))
    far = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q).cast("double")), F.lit(0.0), lambda s, d: s + d) / F.size(a) >= least
    first = F.struct(F.get("x", F.lit(0))["v"].alias("v"), F.array(F.get("x", F.lit(0))["t"]).alias("kept"))
    step = lambda a, f: F.when(far(a["v"], f["v"]), F.struct(f["v"].alias("v"), F.array_append(a["kept"], f["t"]).alias("kept"))).otherwise(a)
    kept = F.aggregate(F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0))), first, step)["kept"]
    return rows.select(key, F.explode(kept).alias(time))


def json_rows(table: DataFrame, key: str, raw: str, element: str) -> DataFrame:
    """key, place (from 0) and the fields of each element of a JSON array; a document that can't be read has none."""
    rows = table.select(key, F.posexplode(F.from_json(raw, f"array<{element}>")).alias("place", "x"))
    return rows.select(key, F.col("place").cast("long").alias("place"), "x.*")


def json_length(raw: Column) -> Column:
    return F.coalesce(F.json_array_length(raw), F.lit(0)).cast("long")


def imported_settings(remote: DataFrame, names: dict[str, str], series_type: str = "standard") -> DataFrame:
    """name, value and note of settings taken over from another system (name, value, type): under our names, with a
    note on templates with tokens that we don't have, and on series of another type; names we don't know are out."""
    from ..functions.naming import TOKENS

    ours = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    bare = lambda t: F.lower(F.regexp_replace(F.regexp_replace(t, r":.*$", ""), "[^A-Za-z0-9]", ""))
    tokens = F.array_distinct(F.regexp_extract_all(F.col("value"), F.lit(r"\{([^{}]*)\}"), 1))
    unknown = F.filter(tokens, lambda t: ~bare(t).isin(*TOKENS) & (bare(t) != ""))
    note = F.when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(F.transform(unknown, lambda t: F.concat(F.lit("{"), t, F.lit("}"))), ", "))).when(F.col("type") != series_type, F.concat(F.col("type"), F.lit(" series")))
    return remote.select(F.try_element_at(ours, F.col("name")).alias("name"), "value", note.alias("note")).where("name is not null")
