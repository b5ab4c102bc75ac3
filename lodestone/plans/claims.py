"""Competing claims, plan items, elimination, parts and operation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import part_of
from ..storage import stored

KIND_ORDER = ("join", "split", "rename", "aside", "review", "ok")


def classify(expected: Column, found: Column, words: Column, high: Column) -> Column:
    """How what a file holds stands to what its name says."""
    same = F.array_sort(expected) == F.array_sort(found)
    once = F.size(F.array_distinct(found)) == F.size(found)
    return (
        F.when(F.size(found) == 0, F.when(words == 0, "NO_TEXT").otherwise("NO_MATCH")).when(~high, "LOW_CONFIDENCE")
        .when(expected == found, "OK").when(same & once, "OK_ORDER_DIFFERS").otherwise("MISMATCH")
    )


def ranked_claims(claims: DataFrame, code: str) -> DataFrame:
    """Claims (rank, named, score, path, start) on a code in order: evidence, already named for it,
    score, path, start, all descending; place 1 wins."""
    order = Window.partitionBy(code).orderBy(F.desc("rank"), F.desc("named"), F.desc("score"), F.desc("path"), F.desc("start"))
    return claims.withColumn("place", F.row_number().over(order))


def winners(claims: DataFrame, code: str) -> DataFrame:
    """The winning claim of each code by an aggregate, which reduces hot codes before the shuffle."""
    others = [c for c in claims.columns if c != code]
    best = claims.groupBy(code).agg(F.max_by(F.struct(*others), F.struct("rank", "named", "score", "path", "start")).alias("x"))
    return best.select(code, *[f"x.{c}" for c in others])


def plan_kind(won: Column, named: Column, held: Column, found: Column) -> Column:
    """ok: named for what it holds and won it; review: nothing sure, or partly; aside: lost all it holds;
    split: holds several; rename: holds another one."""
    return (
        F.when(F.size(found) == 0, "review").when(F.size(won) == 0, "aside").when(named == won, "ok").when(held, "review")
        .when(F.size(won) > 1, "split").otherwise("rename")
    )


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Rows numbered from 1 in an order: sorted by ranges in parallel and written once, so that ranges stay
    as they are; each range comes after the rows of those before it (one count a range). `order` is unique."""
    ranged = stored(rows.orderBy(order).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    part, at = F.shiftright("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1) + 1
    ranged = ranged.select("*", part.alias("_part"), at.alias("_at")).drop("_row")
    sizes = ranged.groupBy("_part").agg(F.max("_at").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_before")


def plan_order(items: DataFrame, kind: str = "kind", path: str = "path") -> DataFrame:
    """Items with ids in path order, then sorted by kind and path: ids come before the sort."""
    ids = numbered(items, path, "id").withColumn("id", F.col("id").cast("int"))
    rank = F.lit(len(KIND_ORDER))
    for k, name in enumerate(KIND_ORDER):
        rank = F.when(F.col(kind) == name, k).otherwise(rank)
    return ids.withColumn("kind_rank", rank).orderBy("kind_rank", path)


def eliminate(unsettled: DataFrame, free: DataFrame, season: str) -> DataFrame:
    """Seasons with one unsettled file and one free episode: they belong together."""
    one = lambda d, name: d.groupBy(season).agg(F.count("*").alias("n"), F.min(name).alias(name)).where("n = 1").select(season, name)
    return one(unsettled, "path").join(one(free, "episode"), season)


def between_neighbours(unsettled: DataFrame, confirmed: DataFrame, season: str, episode: str) -> DataFrame:
    """Unsettled rows whose episodes before and after are both confirmed."""
    side = lambda d: confirmed.select(season, (F.col(episode) - d).alias(episode)).distinct()
    return unsettled.join(side(-1), [season, episode], "left_semi").join(side(1), [season, episode], "left_semi")


def join_groups(parts: DataFrame, key: str, runtime: Column) -> DataFrame:
    """Groups of files that are parts of one episode: numbers are unique and there are several. A gap
    in the numbers, or more than 1.6 times the runtime in all, leaves the group unticked."""
    rows = parts.groupBy(key).agg(
        F.sort_array(F.collect_list("part")).alias("parts"), F.sum("duration").alias("duration"), F.max(runtime).alias("runtime"),
        F.transform(F.sort_array(F.collect_list(F.struct("part", "path"))), lambda x: x["path"]).alias("sources"),
    )
    rows = rows.where((F.size("parts") > 1) & (F.size(F.array_distinct("parts")) == F.size("parts")))
    whole = F.col("parts") == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))
    return rows.select(key, "parts", "sources", (whole & (F.col("duration") <= 1.6 * F.col("runtime"))).alias("selected"))


def story_neighbours(episodes: DataFrame, group: list[str], number: str, title: str, within: int = 1) -> DataFrame:
    """Pairs a, b of episode numbers of a group, at most `within` apart, whose titles are one but for their part markers."""
    key, part = part_of(F.col(title))
    rows = episodes.select(*group, F.col(number).alias("a"), key.alias("_key"), part.alias("_part")).where("_part is not null and _key != ''")
    return near(rows, [*group, "_key"], "a", "b", within, ["_part"]).where("_part != _part_b").select(*group, "a", "b")


def near(rows: DataFrame, group: list[str], number: str, other: str, within: int, more: list[str] = []) -> DataFrame:  # noqa: B006
    """Pairs of different numbers of a group, at most `within` apart: group, number, `more`, the other number and its
    `more` (`_b`). Numbers meet in stretches as long as `within`, and in those beside them, not in whole groups."""
    at = F.floor(F.col(number) / max(within, 1))
    one = rows.select(*group, number, *more, at.alias("_at"))
    two = rows.select(*group, F.col(number).alias(other), *[F.col(c).alias(f"{c}_b") for c in more], F.explode(F.array(at - 1, at, at + 1)).alias("_at"))
    return one.join(two, [*group, "_at"]).where((F.col(number) != F.col(other)) & (F.abs(F.col(number) - F.col(other)) <= within)).drop("_at")


def story_parts(start: Column, end: Column, codes: Column) -> Column:
    """A segment shared evenly by several episodes: array of (code, start, end)."""
    n = F.size(codes)
    step = (end - start) / n
    return F.transform(codes, lambda c, i: F.struct(c.alias("code"), (start + step * i).alias("start"), (start + step * (i + 1)).alias("end")))


def swaps(rows: DataFrame, group: str, named: str, holds: str, path: str) -> DataFrame:
    """Pairs x < y of a group where files named x hold y and files named y hold x, with the first file of each."""
    one = rows.where(F.col(named) != F.col(holds)).groupBy(group, F.col(named).alias("x"), F.col(holds).alias("y")).agg(F.min(path).alias("first"))
    other = one.select(group, F.col("x").alias("y"), F.col("y").alias("x"), F.col("first").alias("second"))
    return one.join(other, [group, "x", "y"]).where("x < y")


def rename_ops(renames: DataFrame, src: str, dst: str) -> DataFrame:
    """Moves in two passes, so that swaps and chains never overwrite: all to temporary names, then all
    to their targets. ordinal orders the whole table."""
    rows = numbered(renames, src, "k")
    total = rows.agg(F.count("*").alias("total"))
    temp = F.concat(F.col(src), F.lit(".tmp"))
    first = rows.select(F.col("k").alias("ordinal"), F.lit("move").alias("op"), F.col(src).alias("src"), temp.alias("dst"))
    second = rows.crossJoin(F.broadcast(total)).select((F.col("k") + F.col("total")).alias("ordinal"), F.lit("move").alias("op"), temp.alias("src"), F.col(dst).alias("dst"))
    return first.unionByName(second)


def operations(moves: DataFrame, cuts: DataFrame, parts: DataFrame, present: DataFrame, parked: str = "parked/") -> DataFrame:
    """The operations of a plan in order (ordinal, op, src, dst, start, end), which never overwrite anything.

    moves: (src, dst); cuts: (src, dst, start, end), pieces of a file; parts: (src, dst, place), files joined into
    one; present: (path), what is there now. First whatever stands at a target and isn't touched itself is
    parked; then all sources go to temporary names; pieces are cut and parts joined from there, and what they
    were made of is parked; last, moved files go to their targets.
    """
    text = lambda c: F.col(c) if isinstance(c, str) else c
    temp = lambda c: F.concat(text(c), F.lit(".tmp"))
    none = F.lit(None).cast("double")
    row = lambda d, phase, op, src, dst, start=none, end=none, place=F.lit(0): d.select(F.lit(phase).alias("phase"), F.lit(op).alias("op"), text(src).alias("src"), text(dst).alias("dst"), start.cast("double").alias("start"), end.cast("double").alias("end"), place.cast("long").alias("place"))  # noqa: E731, B008
    sources = moves.select("src").unionByName(cuts.select("src")).unionByName(parts.select("src")).distinct()
    targets = moves.select(F.col("dst").alias("path")).unionByName(cuts.select(F.col("dst").alias("path"))).unionByName(parts.select(F.col("dst").alias("path"))).distinct()
    stands = present.select("path").distinct().join(targets, "path", "left_semi").join(sources.withColumnRenamed("src", "path"), "path", "left_anti")
    consumed = cuts.select("src").unionByName(parts.select("src")).distinct()
    rows = row(stands, 0, "move", "path", F.concat(F.lit(parked), "path"))
    rows = rows.unionByName(row(sources, 1, "move", "src", temp("src")))
    rows = rows.unionByName(row(cuts, 2, "cut", temp("src"), "dst", F.col("start"), F.col("end")))
    rows = rows.unionByName(row(parts, 2, "join", temp("src"), "dst", place=F.col("place")))
    rows = rows.unionByName(row(consumed, 3, "move", temp("src"), F.concat(F.lit(parked), "src")))
    rows = rows.unionByName(row(moves, 4, "move", temp("src"), "dst"))
    order = F.struct("phase", "dst", "place", "src")
    return numbered(rows.withColumn("_order", order), "_order", "ordinal").select("ordinal", "op", "src", "dst", "start", "end")


def undo_conflicts(undo: DataFrame, present: DataFrame) -> DataFrame:
    """Steps of an undo whose target is taken by a file that no step moves away: src, dst."""
    leaves = undo.select(F.col("src").alias("dst")).distinct()
    taken = present.select(F.col("path").alias("dst")).distinct().join(leaves, "dst", "left_anti")
    return undo.join(taken, "dst", "left_semi").select("src", "dst")


def undo_ops(ops: DataFrame) -> DataFrame:
    """The operations that take others back: last first, source and target exchanged; what was created is parked."""
    most = ops.agg(F.max("ordinal").alias("most"))
    rows = ops.crossJoin(F.broadcast(most))
    created = F.col("op").isin("create", "cut", "join")  # what the operation made
    return rows.select((F.col("most") - F.col("ordinal") + 1).alias("ordinal"), F.lit("move").alias("op"), F.col("dst").alias("src"), F.when(created, F.concat(F.lit("parked/"), "dst")).otherwise(F.col("src")).alias("dst"))


def free_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Names made unique: the first of a name keeps it, the others are `name (n).ext` with the smallest
    numbers that no row is named with. The f-th free number is f and the number of taken ones that
    have fewer than f free ones below them; a running count gives it, without lists of names."""
    parted = r"^(.*?)(\.[^./]*)?$"
    numbered = r"^(.*) \(([1-9][0-9]{0,17})\)(\.[^./]*)?$"
    per = Window.partitionBy(name)
    ranked = rows.withColumn("_f", F.row_number().over(per.orderBy(order)) - 1)
    one = ranked.where("_f = 0").select(F.concat(F.regexp_extract(name, numbered, 1), F.regexp_extract(name, numbered, 3)).alias(name), F.regexp_extract(name, numbered, 2).try_cast("long").alias("t")).where("t is not null").distinct()
    below = one.withColumn("_v", F.col("t") - F.row_number().over(per.orderBy("t"))).select(name, "_v")
    asks = ranked.where("_f > 0").select(F.struct(*rows.columns).alias("_row"), name, F.col("_f").cast("long").alias("_v"), F.lit(0).alias("_kind"))
    both = asks.unionByName(below.select(F.lit(None).cast(asks.schema["_row"].dataType).alias("_row"), name, "_v", F.lit(1).alias("_kind")))
    taken = F.sum("_kind").over(per.orderBy("_v", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    number = both.withColumn("_n", F.col("_v") + taken).where("_kind = 0")
    stem, ext = F.regexp_extract(name, parted, 1), F.regexp_extract(name, parted, 2)
    made = number.select("_row.*", F.concat(stem, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), ext).alias("free"))
    return ranked.where("_f = 0").drop("_f").withColumn("free", F.col(name)).unionByName(made)


def multi_episode(style: str, season: Column, numbers: Column) -> Column:
    """`S01E02` forms for several episodes of a file in six styles."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    s = F.concat(F.lit("S"), two(season))
    e = F.transform(numbers, lambda x: F.concat(F.lit("E"), two(x)))
    if style == "extend":
        return F.concat(s, F.get(e, F.lit(0)), F.array_join(F.transform(F.slice(numbers, F.lit(2), F.greatest(F.size(numbers) - 1, F.lit(0))), lambda x: F.concat(F.lit("-"), two(x))), ""))
    if style == "duplicate":
        return F.array_join(F.transform(e, lambda x: F.concat(s, x)), ".")
    if style == "repeat":
        return F.concat(s, F.array_join(e, ""))
    if style == "scene":
        return F.concat(s, F.array_join(e, "-"))
    last = F.element_at(numbers, -1)
    more = F.size(numbers) > 1
    tail = F.concat(F.lit("-E"), two(last)) if style == "prefixed_range" else F.concat(F.lit("-"), two(last))
    return F.concat(s, F.get(e, F.lit(0)), F.when(more, tail).otherwise(""))


def release_order() -> list[Column]:
    """Candidates: kind, most covered, least extra, not hard rejected, same quality, preferred protocol, youngest."""
    return [F.col("kind_rank"), F.desc(F.size("covers")), F.size("extra"), F.col("rejected"), F.desc("same_quality"), F.desc("preferred"), F.col("age"), F.col("guid")]


def set_cover(ranked: Column, wanted: Column) -> Column:
    """Indexes (from 0) of candidates, in their order, that each add something still wanted."""
    none = F.struct(F.slice(wanted, 1, 0).alias("got"), F.array().cast("array<int>").alias("picks"), F.lit(0).alias("i"))

    def step(a: Column, c: Column) -> Column:
        new = F.array_except(F.array_intersect(c, wanted), a["got"])
        useful = F.size(new) > 0
        return F.struct(F.array_union(a["got"], new).alias("got"), F.when(useful, F.array_append(a["picks"], a["i"])).otherwise(a["picks"]).alias("picks"), (a["i"] + 1).alias("i"))

    return F.aggregate(ranked, none, step, lambda a: a["picks"])
