"""The whole plan of a library as one chain, in which each stage sees what the stages before have settled.

Claims over all files (build.verdicts), then the process of elimination within seasons, then files between
confirmed neighbours, then parts of one episode that are joined; at last ids and order. A season is
any number that groups episodes, so several series are planned at once if their codes and seasons differ.
All stages are joins and aggregates by code, by season, and by file. They read the few columns that they need and
give the files that they settle; items with all they hold meet those once, at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PART, part_of
from ..storage import stored
from .build import gave_way, verdicts
from .claims import numbered

#: How kinds sort; joins and splits come first, together.
PLACE = {"join": 0, "split": 0, "rename": 1, "aside": 2, "review": 3, "ok": 4}
TARGET = "array<struct<path:string,codes:array<string>,start:double,end:double,duplicate:boolean>>"


def standard_path(file: Column, codes: Column, season: Column) -> Column:
    """`Season n/codes.ext`."""
    return F.concat(F.lit("Season "), season.cast("string"), F.lit("/"), F.array_join(codes, "-"), F.regexp_extract(file, r"(\.[^./]*)$", 1))


def _targets(items: DataFrame, path: Callable, parked: str) -> DataFrame:
    """items with the paths that they lead to."""
    one = lambda p, codes, start, end, duplicate: F.struct(p.alias("path"), codes.alias("codes"), start.cast("double").alias("start"), end.cast("double").alias("end"), duplicate.alias("duplicate"))
    none, no = F.lit(None).cast("double"), F.lit(False)
    nothing = F.array().cast("array<string>")
    renamed = F.array(one(path(F.col("file"), F.col("codes"), F.get("pieces", F.lit(0))["season"]), F.col("codes"), none, none, no))

    def piece(s: Column) -> Column:
        own = F.array(s["code"])
        there = path(F.col("file"), own, s["season"])
        return one(F.when(s["lost"], F.concat(F.lit(f"{parked}/duplicates/"), F.regexp_extract(there, r"([^/]*)$", 1))).otherwise(there), own, s["start"], s["end"], s["lost"])

    bucket = F.when(F.col("reason") == "unverified", "unverified").otherwise("duplicates")
    aside = F.array(one(F.concat(F.lit(f"{parked}/"), bucket, F.lit("/"), F.col("file")), nothing, none, none, no))
    made = F.when(F.col("kind") == "rename", renamed).when(F.col("kind") == "split", F.transform("pieces", piece)).when(F.col("kind") == "aside", aside).otherwise(F.array().cast(TARGET))
    return items.withColumn("targets", made)


def by_code(items: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episodes with what the items (kind, expected, codes, pieces) say of them: covered (a file has it or will have it: it stays
    and is named so, or is the target of a change and no duplicate), named (by so many files), spoken_for (by one that
    isn't for review), sure (by one that stays)."""
    ok = F.col("kind") == "ok"
    holds = F.when(ok, F.col("expected")).when(F.col("kind") == "rename", F.col("codes")).when(F.col("kind") == "split", F.transform(F.filter("pieces", lambda c: ~c["lost"]), lambda c: c["code"]))
    said = lambda c, covered, named: F.struct(c.alias("code"), F.lit(covered).alias("covered"), F.lit(named).alias("named"), (F.lit(bool(named)) & (F.col("kind") != "review")).alias("spoken_for"), (F.lit(bool(named)) & ok).alias("sure"))
    every = F.concat(F.transform(F.coalesce(holds, F.array().cast("array<string>")), lambda c: said(c, True, 0)), F.transform(F.coalesce("expected", F.array().cast("array<string>")), lambda c: said(c, False, 1)))
    codes = items.select(F.explode(every).alias("c")).select("c.*").groupBy("code").agg(F.max("covered").alias("covered"), F.sum("named").alias("named"), F.max("spoken_for").alias("spoken_for"), F.max("sure").alias("sure"))
    no = F.lit(False)
    return episodes.join(codes, "code", "left").withColumns({"covered": F.coalesce("covered", no), "named": F.coalesce("named", F.lit(0)), "spoken_for": F.coalesce("spoken_for", no), "sure": F.coalesce("sure", no)})


def unsettled(reviews: DataFrame, codes: DataFrame) -> DataFrame:
    """file, named, code, season_hint, and what is known of the code: files for review that name one episode at most, hold nothing
    else for sure, and whose name no other file claims."""
    open_ = reviews.where((F.size("expected") <= 1) & ~F.col("elsewhere") & F.col("claimed_by").isNull())
    return open_.select("file", "season_hint", (F.size("expected") == 1).alias("one"), F.get("expected", F.lit(0)).alias("code")).join(codes.select("code", "season", "number", "covered", "named"), "code", "left")


def by_season(open_: DataFrame, codes: DataFrame) -> DataFrame:
    """file, free and _season of files found by elimination: where one file of a season is unsettled and one aired episode of
    it is left, they belong together."""
    left = codes.where("aired and not covered and not spoken_for").groupBy("season").agg(F.count("*").alias("n"), F.min("code").alias("free")).where("n = 1").select("season", "free")
    season = F.when(F.col("code").isNotNull(), F.col("season")).otherwise(F.col("season_hint"))
    alone = open_.select("file", season.alias("season")).where("season is not null").groupBy("season").agg(F.count("*").alias("n"), F.min("file").alias("file")).where("n = 1").select("season", "file")
    return alone.join(left, "season").select("file", "free", F.col("season").alias("_season"))


def by_neighbours(open_: DataFrame, codes: DataFrame, found: DataFrame) -> DataFrame:
    """Files found by a look at neighbours: a file that alone is named for an episode nothing covers stands, if the episodes
    before and after are confirmed as named. What elimination has found is settled, and confirmed where it is named so."""
    met = open_.where("one and season is not null").join(found.select("file", "free"), "file", "left")
    sure = codes.where("sure").select("season", "number").unionByName(met.where("free = code").select("season", "number")).distinct()
    rest = met.where("free is null and not covered and named = 1").select("file", "code", "season", "number").join(found.select(F.col("free").alias("code")), "code", "left_anti")
    beside = lambda d: sure.select("season", (F.col("number") - d).alias("number"))
    return rest.join(beside(1), ["season", "number"], "left_semi").join(beside(-1), ["season", "number"], "left_semi").select("file", F.lit(True).alias("_between"))


def settled(items: DataFrame, path: Callable) -> DataFrame:
    """items, joined with what the stages have found, as these leave them. Elimination: a file that is named so already
    stands; another one gets an offer that isn't ticked."""
    named, hit, between = F.array_contains("expected", F.col("free")), F.col("free").isNotNull(), F.coalesce("_between", F.lit(False))
    none = F.lit(None).cast("double")
    offer = F.array(F.struct(path(F.col("file"), F.array("free"), F.col("_season")).alias("path"), F.array("free").alias("codes"), none.alias("start"), none.alias("end"), F.lit(False).alias("duplicate")))
    return items.withColumns({
        "kind": F.when((hit & named) | between, "ok").when(hit, "rename").otherwise(F.col("kind")), "reason": F.when(between, "between neighbours").when(hit, "elimination").otherwise(F.col("reason")), "codes": F.when(hit & ~named, F.array("free")).otherwise(F.col("codes")),
        "targets": F.when(hit & ~named, offer).otherwise(F.col("targets")), "selected": F.when(hit, F.lit(False)).otherwise(F.col("selected")), "eliminated": hit | between,
    }).drop("free", "_season", "_between")


def joined_parts(items: DataFrame, episodes: DataFrame, path: Callable) -> DataFrame:
    """The items of files that are parts of one episode: file (of the first part), sources, codes, selected, targets, reason.

    A group's numbers are unique. Its parts are one episode if all hold it alone, or if all are named for it and hold
    nothing else; names that give parts listed episodes of their own are no group. With a gap in the numbers, or
    running longer than 1.6 times the episode, a group is offered without a tick.
    """
    stem = F.regexp_replace("file", r"\.[^./]*$", "")
    key, part = part_of(stem)
    held = F.array_sort(F.array_distinct(F.transform("pieces", lambda s: s["code"])))
    # names are read once, and only those with a marker go on
    rows = items.where(stem.rlike(PART)).select("file", key.alias("key"), part.alias("part"), "expected", held.alias("held"), F.coalesce("duration", F.lit(0.0)).alias("duration"))
    rows = stored(rows, "parts").where("part is not null")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("part").alias("k"), F.max("part").alias("last")).where("n > 1 and n = k").select("key", "n", "last")
    rows = rows.join(sizes, "key")
    one_name = F.when(F.size("expected") == 1, F.get("expected", F.lit(0)))
    one_held = F.when(F.size("held") == 1, F.get("held", F.lit(0)))
    agree = rows.groupBy("key", "n", "last").agg(
        F.count(one_held).alias("hs"), F.count_distinct(one_held).alias("hd"), F.max(one_held).alias("heard"), F.count(one_name).alias("ns"), F.count_distinct(one_name).alias("nd"), F.max(one_name).alias("name"),
        F.count_if((F.size("held") > 1) | ((F.size("held") == 1) & ~F.coalesce(F.col("held") == F.col("expected"), F.lit(False)))).alias("against"), F.sum("duration").alias("total"),
    )
    names = rows.select("key", F.explode("expected").alias("code")).distinct().join(episodes.select("code", F.lit(True).alias("listed")), "code", "left")
    own = names.groupBy("key").agg(F.count("*").alias("c"), F.count("listed").alias("l")).where("c > 1 and c = l").select("key")
    same_name = (F.col("ns") == F.col("n")) & (F.col("nd") == 1)
    code = F.when((F.col("hs") == F.col("n")) & (F.col("hd") == 1), F.col("heard")).when(same_name & (F.col("against") == 0), F.col("name"))
    groups = agree.join(own, "key", "left_anti").withColumn("code", code).where("code is not null").join(episodes.select("code", "season", "runtime"), "code")
    whole = (F.col("last") == F.col("n")) & ~F.coalesce(F.col("total") > 1.6 * 60 * F.nullif("runtime", F.lit(0.0)), F.lit(False))
    sources = rows.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "file"))), lambda x: x["file"]).alias("sources"))
    made = groups.join(sources, "key").withColumn("file", F.get("sources", F.lit(0)))
    target = F.array(F.struct(path(F.col("file"), F.array("code"), F.col("season")).alias("path"), F.array("code").alias("codes"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit(False).alias("duplicate")))
    return made.select("file", "sources", F.array("code").alias("codes"), F.coalesce(whole, F.lit(False)).alias("selected"), target.alias("targets"), F.when(F.col("last") > F.col("n"), "parts, some missing").when(~whole, "parts, too long").otherwise("parts").alias("reason"))


def whole_plan(files: DataFrame, episodes: DataFrame, overrides: DataFrame, splits: bool = True, path: Callable[[Column, Column, Column], Column] = standard_path, parked: str = "parked") -> DataFrame:
    """id, kind, kind_place, file, sources, codes, reason, selected, ref_warning, claimed_by, eliminated and targets (TARGET) of each item.

    files: file (a path), status, expected, duration, hold, segments (build.SEGMENT) and season_hint (where the path says
    one). episodes: code, season, number, low_trust, aired, runtime (minutes). ids number joins first, then the
    other items, each in order of their file, before anything is sorted by kind; files are unique.
    """
    episodes = stored(episodes.select("code", "season", "number", "low_trust", "aired", "runtime"), "episodes")
    items, met = verdicts(files, episodes, overrides, splits, path, ("season_hint",))
    met = stored(met, "met")
    # what is for review may make way; the rest stays as it is for now
    reviews = gave_way(items.where("kind = 'review'").select("file", "kind", "reason", "selected", "expected", "season_hint", "sure_card", "elsewhere").join(met, "file", "left"))
    reviews = stored(reviews.drop("reason", "selected", "sure_card"), "reviews")
    told = items.where("kind != 'review'").select("kind", "expected", "codes", "pieces")
    made_way = reviews.select("kind", "expected").withColumns({c: F.lit(None).cast(items.schema[c].dataType) for c in ("codes", "pieces")})
    codes = stored(by_code(told.unionByName(made_way), episodes), "codes")
    open_ = stored(unsettled(reviews.where("kind = 'review'"), codes), "unsettled")
    found = stored(by_season(open_, codes), "by_season")
    between = stored(by_neighbours(open_, codes, found), "by_neighbours")
    joins = stored(joined_parts(items, episodes, path), "joins")
    # ids are given to names alone, then all that is known of a file meets its id
    first, after = joins.select("file", F.lit(0).alias("_after")), items.select("file").join(joins.select(F.explode("sources").alias("file")), "file", "left_anti").withColumn("_after", F.lit(1))
    ids = numbered(first.unionByName(after).withColumn("_order", F.struct("_after", "file")), "_order", "id").select("file", "_after", (F.col("id") - 1).alias("id"))
    left = items.join(met, "file", "left").join(found, "file", "left").join(between, "file", "left").join(ids.where("_after = 1").select("file", "id"), "file")
    left = settled(_targets(gave_way(left), path, parked), path)
    names = ["id", "kind", "file", "sources", "codes", "reason", "selected", "ref_warning", "claimed_by", "eliminated", "targets"]
    others = left.withColumn("sources", F.array("file")).select(*names)
    made = joins.join(ids.where("_after = 0").select("file", "id"), "file").withColumns({"kind": F.lit("join"), "ref_warning": F.lit(False), "claimed_by": F.lit(None).cast("string"), "eliminated": F.lit(False)}).select(*names)
    place = F.lit(len(PLACE))
    for kind, n in PLACE.items():
        place = F.when(F.col("kind") == kind, n).otherwise(place)
    return made.unionByName(others).select("id", "kind", place.cast("int").alias("kind_place"), *names[2:])
