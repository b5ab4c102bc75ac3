"""From what files hold to a plan: what to rename, split, set aside, look at or leave."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rules import proper_subset, segment_choice
from ..storage import stored
from .claims import winners

#: A segment as plans read it.
SEGMENT = "struct<start:double,end:double,code:string,score:double,confidence:string,model_code:string,override:string,title_card:boolean>"
RANK = {"manual": 3, "high": 2, "ai": 1, "low": 0}


def with_overrides(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """Files with what was set by hand (file, codes): a code for each segment; one code for the whole file; else
    so many episodes of the whole file. The status of such a file is MANUAL."""
    rows = files.join(overrides.select("file", F.col("codes").alias("_own")), "file", "left")
    whole = lambda c: F.struct(F.lit(0.0).alias("start"), F.coalesce("duration", F.lit(0.0)).alias("end"), c.alias("code"), F.lit(1.0).alias("score"), F.lit("manual").alias("confidence"), F.lit(None).cast("string").alias("model_code"), c.alias("override"), F.lit(False).alias("title_card"))
    names = ("start", "end", "code", "score", "confidence", "model_code")
    each = F.zip_with("segments", "_own", lambda s, c: F.struct(*[s[n].alias(n) for n in names], c.alias("override"), s["title_card"].alias("title_card")))
    given = F.size("_own") > 0
    one_each = (F.size("_own") == F.size("segments")) & (F.size("_own") > 1)
    segments = F.when(given & one_each, each).when(given, F.transform("_own", whole)).otherwise(F.col("segments"))
    return rows.withColumn("segments", segments).withColumn("status", F.when(given, "MANUAL").otherwise(F.col("status"))).drop("_own")


def choices(segments: Column) -> Column:
    """What each segment says it is, and how surely; segments that say nothing are left out."""

    def one(s: Column) -> Column:
        c = segment_choice(s["override"], s["confidence"], s["code"], s["model_code"])
        return F.struct(c["code"].alias("code"), c["strength"].alias("strength"), F.coalesce(s["start"], F.lit(0.0)).alias("start"), F.coalesce(s["end"], F.lit(0.0)).alias("end"), F.coalesce(s["score"], F.lit(0.0)).alias("score"))

    return F.filter(F.transform(segments, one), lambda c: c["code"].isNotNull())


def build(files: DataFrame, episodes: DataFrame, overrides: DataFrame, splits: bool = True) -> DataFrame:
    """file, kind, reason, codes, selected, ref_warning and claimed_by of each file's item, as `verdicts` finds them."""
    items, met = verdicts(files, episodes, overrides, splits)
    return gave_way(items.join(met, "file", "left")).select("file", "kind", "reason", "codes", "selected", "ref_warning", "claimed_by")


def verdicts(files: DataFrame, episodes: DataFrame, overrides: DataFrame, splits: bool = True, path: Callable[[Column, Column, Column], Column] | None = None, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Each file's item: kind, reason, codes, selected, ref_warning, and what it follows from: expected, duration, the usable
    segments (`pieces`, with `lost`: another file has the better claim), sure_card, elsewhere (something that it isn't named
    for is sure) and `more` columns of files; and the files that stand where a confirmed one belongs, for `gave_way`.

    files: (file, status, expected, duration, hold, segments); episodes: (code, season, number, low_trust).
    Claims are settled over all files first: each episode belongs to the segment with the best evidence.
    A file's kind follows from its claims and its name. Ticks are taken off changes that rest on a
    doubtful reference; files that can't be verified make way for confirmed ones that need their name.
    path: where a file (its path) with given codes of a season belongs; one that stands there is not renamed.
    """
    expected = F.col("expected")
    rows = with_overrides(files, overrides).withColumn("chosen", choices(F.col("segments"))).withColumn("usable", F.filter("chosen", lambda c: c["strength"] != "low"))
    rows = stored(rows.select(
        "file", "status", "expected", "duration", "hold", "usable", F.size("chosen").alias("n_chosen"), *more,
        ((F.size("segments") > 0) & F.forall("segments", lambda s: F.coalesce(s["title_card"], F.lit(False)))).alias("by_title"), F.exists("segments", lambda s: s["override"].isNotNull()).alias("by_hand"),
        F.exists("segments", lambda s: F.coalesce(s["title_card"], F.lit(False)) & F.array_contains(expected, s["code"])).alias("sure_card"),
        F.coalesce(F.exists("segments", lambda s: s["confidence"].isin("high", "manual") & F.coalesce(~F.array_contains(expected, s["code"]), F.lit(True))), F.lit(False)).alias("elsewhere"),
    ), "claims")

    # who owns what
    claim = rows.select("file", "expected", F.explode("usable").alias("c"))
    rank = F.lit(0)
    for name, n in RANK.items():
        rank = F.when(F.col("c.strength") == name, n).otherwise(rank)
    claim = claim.select(F.col("c.code").alias("code"), rank.alias("rank"), F.array_contains("expected", F.col("c.code")).alias("named"), F.col("c.score").alias("score"), F.col("file").alias("path"), F.col("c.start").alias("start"))
    won = winners(claim, "code").select("code", F.col("path").alias("_owner"), F.col("start").alias("_start"))

    # what is known of the codes that a file is named for or holds
    held = F.transform("usable", lambda c: c["code"])
    of = rows.select("file", F.explode(F.array_distinct(F.concat(held, expected))).alias("code"))
    of = of.join(won, "code", "left").join(episodes.select("code", "season", "number", F.coalesce("low_trust", F.lit(False)).alias("low"), F.lit(True).alias("listed")), "code", "left").where("code is not null")
    one = F.struct("season", "number", F.coalesce("low", F.lit(False)).alias("low"), F.coalesce("listed", F.lit(False)).alias("listed"), F.when(F.col("_owner") == F.col("file"), F.col("_start")).alias("own"))
    known = of.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("code", one))).alias("known"))
    info = lambda code: F.try_element_at("known", code)
    no = F.lit(False)

    def piece(c: Column) -> Column:
        k = info(c["code"])
        return F.struct(*[c[n].alias(n) for n in ("code", "start", "end", "strength")], *[k[n].alias(n) for n in ("season", "number")], *[F.coalesce(k[n], no).alias(n) for n in ("low", "listed")], (~F.coalesce(k["own"] == c["start"], no)).alias("lost"))

    rows = rows.join(known, "file", "left").withColumns({
        "pieces": F.transform("usable", piece), "codes": held, "unlisted": F.exists("expected", lambda c: ~F.coalesce(info(c)["listed"], no)), "low_name": F.exists("expected", lambda c: F.coalesce(info(c)["low"], no)),
    }).drop("known", "usable")
    has = lambda strength: F.exists("pieces", lambda c: c["strength"] == strength)
    rows = rows.withColumns({"ai": has("ai"), "manual": has("manual"), "lost": F.size(F.filter("pieces", lambda c: c["lost"])), "first": F.get("pieces", F.lit(0))})

    codes = F.col("codes")
    covered = F.aggregate("pieces", F.lit(0.0), lambda a, c: a + F.greatest(F.lit(0.0), c["end"] - c["start"]))
    partial = (F.size(expected) > 0) & ~F.col("manual") & proper_subset(codes, expected) & (F.col("ai") | ((F.coalesce("duration", F.lit(0.0)) > 0) & (covered < 0.75 * F.col("duration"))))
    follows = F.transform("pieces", lambda c, i: F.coalesce((c["season"] == F.col("first.season")) & (c["number"] == F.col("first.number") + i), no))
    rows = rows.withColumn("in_row", (F.size(F.array_distinct(codes)) == F.size(codes)) & F.forall(follows, lambda x: x))
    in_row = F.col("in_row")
    there = F.coalesce(path(F.col("file"), codes, F.col("first.season")) == F.col("file"), no) if path else no
    undecided = (F.col("status") == "NO_TEXT") | (F.size("pieces") == 0) | (F.size("pieces") != F.col("n_chosen")) | (F.coalesce("hold", no) & (F.col("status") != "MANUAL"))
    steps = [
        (undecided, "review", "undecided"), (F.col("unlisted") & ~F.col("manual"), "review", "name not listed"),
        (F.col("lost") == F.size("pieces"), "aside", "duplicate"), ((F.col("status") == "OK") & ~F.col("ai") & ~F.col("manual"), "ok", "correct"), (codes == expected, "ok", "agrees"),
        (partial, "review", "part confirmed"), (F.exists("pieces", lambda c: ~c["listed"]), "review", "not listed"),
        (in_row & (F.col("lost") > 0), "review", "part is a duplicate"), (in_row & there, "ok", "in place"), (in_row, "rename", "name"), (F.lit(not splits), "review", "splits are off"),
        (F.exists("pieces", lambda c: c["end"] <= c["start"]), "review", "no boundaries"),
    ]
    verdict = F.struct(F.lit("split").alias("kind"), F.lit("split").alias("reason"))
    for when, kind, reason in reversed(steps):
        verdict = F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))).otherwise(verdict)
    moved = F.col("v.kind").isin("rename", "split")
    shaky = ((moved & F.exists("pieces", lambda c: c["low"])) | F.col("low_name")) & ~F.col("by_title") & ~F.col("by_hand")
    rows = rows.withColumn("v", verdict).withColumn("ref_warning", F.col("v.kind").isin("rename", "split", "aside") & shaky)
    items = stored(rows.select(
        "file", "v.kind", "v.reason", "codes", (F.col("v.kind").isin("rename", "split", "aside") & ~F.col("ai") & ~F.col("ref_warning")).alias("selected"), "ref_warning", "expected", "duration",
        F.transform("pieces", lambda c: F.struct(*[c[n].alias(n) for n in ("code", "start", "end", "season", "lost")])).alias("pieces"), "sure_card", "elsewhere", *more,
    ), "verdicts")

    # files that stand where a confirmed one belongs
    taken = items.where(F.col("kind").isin("rename", "split")).select(F.col("file").alias("_by"), F.explode(F.filter("pieces", lambda c: ~c["lost"])).alias("c"), F.col("selected").alias("_ticked")).select("_by", F.col("c.code").alias("code"), "_ticked")
    stands = items.where("kind = 'review'").select("file", F.explode("expected").alias("code"))
    met = stands.join(taken, "code").where("file != _by").groupBy("file").agg(F.min(F.struct("code", "_by", "_ticked")).alias("x"))
    return items, met.select("file", F.col("x._by").alias("claimed_by"), F.col("x._ticked").alias("_ticked"))


def gave_way(items: DataFrame) -> DataFrame:
    """Items, joined with who needs their names, after those that aren't sure have made way."""
    gives_way = F.col("claimed_by").isNotNull() & ~F.col("sure_card")
    return items.withColumns({"kind": F.when(gives_way, "aside").otherwise(F.col("kind")), "reason": F.when(gives_way, "unverified").otherwise(F.col("reason")), "selected": F.when(gives_way, F.col("_ticked")).otherwise(F.col("selected"))}).drop("_ticked")


def by_release_name(files: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Files (file, expected, duration, segments) and what the name of the release says that each was imported from
    (verdicts: file, verdict `match` or `other`, code): segments and evidence afterwards. A match settles a
    file whose dialogue isn't sure of something else or of all of it already; another title is worth a
    look where nothing is sure."""
    rows = files.join(verdicts.select("file", "verdict", F.col("code").alias("_code")), "file", "left")
    strong = F.filter("segments", lambda s: s["confidence"].isin("high", "manual"))
    elsewhere = F.exists(strong, lambda s: ~F.array_contains("expected", s["code"]))
    settles = (F.col("verdict") == "match") & ~elsewhere & (F.size(strong) != F.size("expected"))
    flags = (F.col("verdict") == "other") & (F.size(strong) == 0)
    made = lambda start, end, code, sure: F.struct(F.round(start, 1).alias("start"), F.round(end, 1).alias("end"), code.alias("code"), F.lit(0.0).alias("score"), F.lit(sure).alias("confidence"), F.lit(None).cast("string").alias("model_code"), F.lit(None).cast("string").alias("override"), F.lit(False).alias("title_card"))
    step = F.coalesce("duration", F.lit(0.0)) / F.size("expected")
    shared = F.transform("expected", lambda c, i: made(step * i, step * (i + 1), c, "high"))
    flagged = F.array(made(F.lit(0.0), F.coalesce("duration", F.lit(0.0)), F.col("_code"), "low"))
    segments = F.when(settles, shared).when(flags, flagged).otherwise(F.col("segments"))
    evidence = F.when(settles | flags, "release name")
    return rows.withColumns({"segments": segments, "evidence": evidence}).drop("verdict", "_code")


def after_apply(items: DataFrame, applied: DataFrame, targets: DataFrame) -> DataFrame:
    """The plan after some of its items were applied: these are `ok` under their new paths, what was set aside is
    gone, the others stay as they were. applied: (file); targets: (file, path)."""
    done = items.join(applied.select("file").distinct(), "file", "left_semi")
    left = items.join(applied.select("file").distinct(), "file", "left_anti")
    moved = done.where("kind != 'aside'").join(targets.select("file", "path"), "file", "left")
    moved = moved.withColumn("file", F.coalesce("path", "file")).withColumn("kind", F.lit("ok")).withColumn("reason", F.lit("applied")).withColumn("selected", F.lit(False)).drop("path")
    return left.unionByName(moved.select(left.columns))


def accepted_wikis(candidates: DataFrame, least: int = 5, share: float = 0.15, plainly: float = 0.8) -> DataFrame:
    """series and site: of a series' candidate sites in order (place; mapped: episodes found on it, of `episodes`;
    same_name), those before and with the first that has nearly all episodes (`plainly`) are looked at; the
    best accepted one wins: enough of its pages map to episodes, or its name is the series'."""
    enough = F.col("mapped") >= F.greatest(F.lit(least), F.floor(share * F.col("episodes")))
    ok = (F.col("mapped") > 0) & (enough | F.col("same_name"))
    stop = candidates.where(ok & (F.col("mapped") >= plainly * F.col("episodes"))).groupBy("series").agg(F.min("place").alias("stop"))
    seen = candidates.where(ok).join(stop, "series", "left").where("stop is null or place <= stop")
    return seen.groupBy("series").agg(F.max_by("site", F.struct("mapped", -F.col("place"))).alias("site"), F.max("mapped").alias("mapped"))
